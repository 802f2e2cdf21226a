"""End-user jobs: blind bundles, benchmark runs, evaluation, drift audits, ordered treatments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import ContractError, strict
from veriledge.operators import policy, retrieve, rows, score
from veriledge.operators.ledger import LEDGER, prediction_ledger_binding, verify_chain
from veriledge.session import broadcast_if_bounded, materialise
from veriledge.sources.jsonl import canonical_lines, write_canonical_jsonl

_EVIDENCE = S.PREDICTION["evidence"].dataType
# Fixed texts of the rule backend: query suffixes, prompt markers, reasons and probabilities.
SUPPORT_SUFFIX = " evidence result mechanism"
COUNTER_SUFFIX = " limitation failure counterexample boundary precedent"
NARROW_MARKER = "narrowly scoped claim"
BOUND_MARKERS = ("all practically relevant", "is sufficient", "intrinsically stable")
REASON_NO_SUPPORT = "offline lexical fixture retrieved no passage"
REASON_SUPPORT = "deterministic plumbing fixture selected top support passage"
REASON_NO_COUNTER = "offline counter retrieval returned no passage"
REASON_COUNTER = "deterministic plumbing fixture selected top counter-search passage"
PROBE_KIND = "boundary_probe"
PROBE_PATTERN = "search direct prior work, operating boundaries, and failure mechanisms"


# --- blind bundles ---------------------------------------------------------------------------

def bundle_manifest(tasks: DataFrame) -> DataFrame:
    """Digest and count of a blind task set, one row."""
    lines = canonical_lines(tasks.select(*S.TASK_FIELDS))
    digest = score.dataset_digest(lines, F.col("value")).withColumnRenamed(
        "digest", "task_sha256")
    ids = score.dataset_digest(tasks, F.col("challenge_id")).withColumnRenamed(
        "digest", "challenge_ids_sha256")
    count = tasks.agg(F.count(F.lit(1)).alias("tasks"))
    return (digest.crossJoin(ids).crossJoin(count)  # one row each
            .withColumn("forbidden_gold_keys",
                        F.lit(",".join(sorted(S.FORBIDDEN_GOLD_KEYS)))))


def blind_bundle(challenges: DataFrame, path: str | None = None) -> DataFrame:
    """Validate, project, validate again, write; returns the manifest row."""
    tasks = rows.blind_project(strict(rows.validate_challenges(challenges)))
    tasks = strict(rows.validate_blind_tasks(tasks))
    if path:
        write_canonical_jsonl(tasks, path)
    return bundle_manifest(tasks)


def verify_blind_bundle(tasks: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row (digest_ok, count_ok, contract_violations)."""
    checked = rows.validate_blind_tasks(tasks)
    bad = checked.agg(F.count_if(F.size("violations") > 0).alias("contract_violations"))
    found = bundle_manifest(tasks).select(
        F.col("task_sha256").alias("__sha"), F.col("tasks").alias("__n"))
    return manifest.crossJoin(found).crossJoin(bad).select(  # one row each
        (F.col("task_sha256") == F.col("__sha")).alias("digest_ok"),
        (F.col("tasks") == F.col("__n")).alias("count_ok"), "contract_violations")


# --- benchmark runs --------------------------------------------------------------------------

def plan_queries(tasks: DataFrame) -> DataFrame:
    """One support and one counter query per task."""
    intents = F.explode(F.array(
        F.struct(F.lit("support").alias("intent"), F.lit(SUPPORT_SUFFIX).alias("suffix")),
        F.struct(F.lit("counterevidence").alias("intent"),
                 F.lit(COUNTER_SUFFIX).alias("suffix"))))
    planned = tasks.select("challenge_id", "prompt", "cutoff_date", intents.alias("i"))
    return planned.select(
        "challenge_id", F.col("i.intent").alias("intent"),
        F.concat(F.col("i.intent"), F.lit("-0")).alias("query_name"),
        F.concat_ws("#", "challenge_id", "i.intent").alias("query_id"),
        F.concat("prompt", F.col("i.suffix")).alias("query"),
        F.to_date("cutoff_date").alias("cutoff_date"))


def retrieve_for_tasks(tasks: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """Passages for both intents of every task, ranked. Passage ids name the task's own query."""
    queries = plan_queries(tasks)
    found = retrieve.retrieve_capsules(queries.select("query_id", "query", "cutoff_date"),
                                       corpus, k)
    named = queries.select("query_id", "challenge_id", "intent", "query_name")
    snapshot = F.substring_index("passage_id", "@", 1)
    return found.join(broadcast_if_bounded(named), "query_id").select(
        "challenge_id", "intent", F.col("query_name").alias("query_id"), "rank",
        fn.capsule_passage_id(snapshot, "query_name").alias("passage_id"), "doc_id", "text",
        "locator", "content_sha256", "publication_date")


def rule_decisions(tasks: DataFrame, methods: DataFrame, passages: DataFrame) -> DataFrame:
    """Deterministic decisions from the top passage of each intent.

    ``tasks`` x ``methods`` is the job list itself: methods are a handful of treatments.
    """
    top = passages.where(F.col("rank") == 1).groupBy("challenge_id").agg(
        F.max(F.when(F.col("intent") == "support", F.col("passage_id"))).alias("support"),
        F.max(F.when(F.col("intent") == "counterevidence", F.col("passage_id")))
        .alias("counter"))
    jobs = tasks.crossJoin(broadcast_if_bounded(methods)).join(top, "challenge_id", "left")
    prompt = F.lower("prompt")
    narrow = prompt.contains(NARROW_MARKER) | ~F.col("external_counter_retrieval")
    bounded = prompt.contains(BOUND_MARKERS[0])
    for marker in BOUND_MARKERS[1:]:
        bounded = bounded | prompt.contains(marker)
    corpus_boundary = F.concat(F.lit("offline capsule corpus through "),
                               F.col("cutoff_date").cast("string"))

    def cite(passage: str, relation: Column) -> Column:
        return F.array(F.struct(F.col(passage).alias("passage_id"),
                                relation.alias("relation")))

    nothing = F.array().cast("array<struct<passage_id:string,relation:string>>")
    no_strategy = F.array().cast("array<struct<kind:string,pattern:string>>")
    no_support, no_counter = F.col("support").isNull(), F.col("counter").isNull()

    def branch(none_found, survives, no_challenge, challenged):
        return (F.when(no_support, none_found).when(narrow, survives)
                .when(no_counter, no_challenge).otherwise(challenged))

    unresolved = F.lit("UNRESOLVED")
    return jobs.select(
        "challenge_id", "method_id", "cedg", "external_counter_retrieval", "task_family",
        "prompt", "cutoff_date",
        branch(unresolved, F.lit("SURVIVED"), unresolved,
               F.when(bounded, "NARROWED").otherwise("REFUTED")).alias("decision"),
        branch(F.lit(0.5), F.lit(0.1), F.lit(0.5), F.lit(0.9))
        .alias("counterevidence_probability"),
        branch(nothing, cite("support", F.lit("SUPPORTS")), nothing,
               cite("counter", F.when(bounded, "BOUNDS").otherwise("CONTRADICTS")))
        .alias("evidence"),
        branch(F.lit(REASON_NO_SUPPORT), F.lit(REASON_SUPPORT), F.lit(REASON_NO_COUNTER),
               F.lit(REASON_COUNTER)).alias("reason"),
        branch(F.lit(""), corpus_boundary, F.lit(""),
               F.when(bounded, corpus_boundary).otherwise("")).alias("boundary"),
        branch(no_strategy, no_strategy, no_strategy, F.array(F.struct(
            F.lit(PROBE_KIND).alias("kind"), F.lit(PROBE_PATTERN).alias("pattern"))))
        .alias("strategy_candidates"))


def assemble_predictions(decisions: DataFrame, passages: DataFrame, run_id: str) -> DataFrame:
    """J16 + F04: prediction rows with their commitments. A support query costs one call, a
    counter query another one."""
    cited = retrieve.resolve_citations(decisions, passages)
    shaped = cited.select(
        F.lit(1).alias("schema_version"), "challenge_id",
        F.concat(F.lit(run_id + ":"), "method_id").alias("run_id"), "method_id",
        F.lit("completed").alias("status"), F.col("decision").alias("predicted_decision"),
        "counterevidence_probability", F.col("citations").cast(_EVIDENCE).alias("evidence"),
        F.when(F.col("external_counter_retrieval"), 2).otherwise(1).cast("bigint")
        .alias("calls"), F.lit(0).cast("bigint").alias("tokens"))
    return shaped.withColumn("prediction_commitment_sha256", fn.prediction_commitment())


def run_methods(tasks: DataFrame, methods: DataFrame, corpus: DataFrame, run_id: str,
                k: int = 3) -> DataFrame:
    """C09 without gold: plan, retrieve once per task, decide per method, commit.

    Only ``evaluate_predictions`` joins gold, after this plan.
    """
    passages = materialise(retrieve_for_tasks(tasks, corpus, k))
    return assemble_predictions(rule_decisions(tasks, methods, passages), passages, run_id)


def run_and_score(challenges: DataFrame, methods: DataFrame, corpus: DataFrame, run_id: str,
                  max_calls: int, max_tokens: int, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(items, summaries) for all methods."""
    predictions = run_methods(rows.blind_project(challenges), methods, corpus, run_id, k)
    items = score.score_items(predictions, challenges, max_calls, max_tokens)
    return items, score.score_summary(items)


def evaluate_predictions(challenges: DataFrame, predictions: DataFrame, events: DataFrame,
                         max_calls: int, max_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Contracts, ledger binding, coverage, one run, item scores and summary.

    ``predictions`` keep their ledger path ``<tenant>/<job>/events.jsonl``.
    """
    strict(rows.validate_challenges(challenges))
    valid = strict(rows.validate_predictions(predictions))
    located = valid.withColumn(
        "tenant_id", F.split_part("ledger_relpath", F.lit("/"), F.lit(1))).withColumn(
        "job_id", F.split_part("ledger_relpath", F.lit("/"), F.lit(2)))
    wanted = events.join(located.select(*LEDGER).distinct(), LEDGER, "left_semi")
    # Checked, counted and scored below: the binding is computed once.
    bound = materialise(prediction_ledger_binding(located, verify_chain(wanted), wanted))
    predictions = strict(bound).drop(*LEDGER)
    gaps = score.coverage_gaps(predictions, challenges).limit(1).collect()
    if gaps:
        raise ContractError(f"prediction coverage mismatch: {gaps[0]['coverage']} "
                            f"{gaps[0]['challenge_id']}")
    run = score.single_run(predictions).first()
    if run["methods"] != 1 or run["runs"] != 1:
        raise ContractError("predictions must have exactly one method_id and run_id")
    items = score.score_items(predictions, challenges, max_calls, max_tokens)
    return items, score.score_summary(items)


def sealed_benchmark(challenges: DataFrame, snapshots: DataFrame, **facts: str) -> DataFrame:
    """A04 with everything a seal asserts, as (field, key, value) rows.

    Raises ``ContractError`` for an empty set, for a challenge or snapshot that breaks its
    contract, and for a reference finding of J03 (a missing, differing or unreferenced
    snapshot). The digests are those that ``write_canonical_jsonl`` gives for the same tables, so
    a written file can be held against its manifest. ``facts`` (created_at, file names) are added.
    """
    if challenges.isEmpty():
        raise ContractError("challenge set is empty")
    strict(rows.validate_challenges(challenges))
    strict(rows.validate_snapshots(snapshots))
    found = score.snapshot_reference_check(challenges, snapshots).limit(1).collect()
    if found:
        raise ContractError(f"{found[0]['codes']}: {found[0]['snapshot_id']}")
    out = score.seal_benchmark(challenges, snapshots)
    for field, table in (("challenge_sha256", challenges),
                         ("evidence_snapshot_sha256", snapshots)):
        digest = score.dataset_digest(canonical_lines(table), F.col("value"))
        out = out.unionByName(digest.select(F.lit(field).alias("field"), F.lit("").alias("key"),
                                            F.col("digest").alias("value")))
    stated = [(name, "", text) for name, text in {"schema_version": "1", **facts}.items()]
    return out.unionByName(challenges.sparkSession.createDataFrame(
        stated, "field string, key string, value string"))


def audit_evidence_drift(snapshots: DataFrame, observations: DataFrame
                         ) -> tuple[DataFrame, DataFrame]:
    """(records, report)."""
    records = score.drift_records(snapshots, observations)
    return records, score.drift_report(records)


def failed_prediction_rows(tasks: DataFrame, jobs: DataFrame, completed: DataFrame, run_id: str
                           ) -> DataFrame:
    """C11: predictions for finished jobs; failed and cancelled ones become neutral rows.

    ``jobs``: challenge_id, method_id, status, used_calls, used_tokens.
    """
    ended = jobs.where(F.col("status").isin("FAILED", "CANCELLED")).join(
        tasks.select("challenge_id"), "challenge_id", "left_semi")
    neutral = ended.select(
        F.lit(1).alias("schema_version"), "challenge_id",
        F.concat(F.lit(run_id + ":"), "method_id").alias("run_id"), "method_id",
        F.lit("failed").alias("status"), F.lit("UNRESOLVED").alias("predicted_decision"),
        F.lit(0.5).alias("counterevidence_probability"),
        F.array().cast(_EVIDENCE).alias("evidence"), F.col("used_calls").alias("calls"),
        F.col("used_tokens").alias("tokens"))
    neutral = neutral.withColumn("prediction_commitment_sha256", fn.prediction_commitment())
    succeeded = jobs.where(F.col("status") == "SUCCEEDED").select("challenge_id", "method_id")
    kept = completed.join(succeeded, ["challenge_id", "method_id"], "left_semi")
    return kept.unionByName(neutral.select(*completed.columns))


# --- event rows ------------------------------------------------------------------------------

def _event(position: int, sub: Column, kind: str, agg_type: str, agg_id: Column, stage: str,
           suffix: Column, payload: Column) -> Column:
    return F.struct(
        F.lit(position).alias("position"), sub.cast("int").alias("sub"),
        F.lit(agg_type).alias("aggregate_type"), agg_id.alias("aggregate_id"),
        F.lit(kind).alias("event_type"), F.to_json(payload).alias("payload"),
        F.concat(F.col("job_id"), F.lit(f":{stage}:v1:"), suffix).alias("idempotency_key"))


def task_events(decisions: DataFrame, passages: DataFrame, tenant_id: str, run_id: str,
                predictions: DataFrame | None = None) -> DataFrame:
    """The events each (task, method) job emits, in order, ready for ``build_ledger``.

    A job's events number a few per query and passage, so they are made inside one row per job
    and exploded. Claim-graph events are only made for claim-graph methods.
    """
    passage = F.struct("intent", "query_id", "rank", "passage_id", "doc_id", "locator",
                       "content_sha256")
    packed = passages.groupBy("challenge_id").agg(F.array_sort(F.collect_list(passage))
                                                  .alias("p"))
    jobs = decisions.join(packed, "challenge_id", "left").withColumn(
        "job_id", F.concat_ws(":", F.lit(run_id), "method_id", "challenge_id"))
    empty = F.array().cast(packed.schema["p"].dataType)
    jobs = jobs.withColumn("p", F.coalesce("p", empty))
    claim, zero = F.col("challenge_id"), F.lit(0)

    def obj(**fields):
        return F.to_variant_object(F.struct(*[c.alias(n) for n, c in fields.items()]))

    def searched(position, intent, stage, suffix_text):
        mine = F.filter("p", lambda x: x["intent"] == intent)
        query = F.concat("prompt", F.lit(suffix_text))
        name = F.lit(f"{intent}-0")
        ran = _event(position, zero, "query.executed", "query", name, stage, F.lit("query:0"),
                     obj(query_id=name, claim_id=claim, text=query, intent=F.lit(intent),
                         n_hits=F.size(mine)))
        seen = F.transform(mine, lambda x: _event(
            position + 1, x["rank"], "passage.observed", "passage", x["passage_id"], stage,
            F.concat(F.lit("passage:"), x["passage_id"]),
            obj(passage_id=x["passage_id"], doc_id=x["doc_id"], query_id=x["query_id"],
                offset=x["locator"]["offset"], content_sha256=x["content_sha256"])))
        return F.concat(F.array(ran), seen)

    def moved(position, state, reason, suffix, boundary=None):
        fields = {"claim_id": claim, "to_state": state, "reason": reason}
        plain = obj(**fields)
        payload = plain if boundary is None else F.when(
            boundary != "", obj(**fields, boundary=boundary)).otherwise(plain)
        return _event(position, zero, "claim.transitioned", "claim", claim, "DECIDE",
                      F.lit(f"transition:{suffix}"), payload)

    proposed = F.array(_event(0, zero, "claim.proposed", "claim", claim, "PLAN",
                              F.lit("claim"), obj(
        claim_id=claim, text=F.col("prompt"), scope=F.concat(
            F.col("task_family"), F.lit(" through "), F.col("cutoff_date").cast("string")))))
    decided = F.array(_event(
        5, zero, "benchmark.decision_recorded", "benchmark", claim, "DECIDE", F.lit("decision"),
        obj(challenge_id=claim, method_id=F.col("method_id"), decision=F.col("decision"),
            counterevidence_probability=F.col("counterevidence_probability"),
            evidence=F.to_variant_object("evidence"), reason=F.col("reason"),
            boundary=F.col("boundary"),
            strategy_candidate_hashes=F.transform("strategy_candidates", lambda c: fn.sha256(
                F.concat(c["kind"], F.lit("|"), c["pattern"]))))))
    linked = F.transform("evidence", lambda e, i: _event(
        6, i, "evidence.linked", "claim", claim, "DECIDE",
        F.concat(F.lit("edge:"), i.cast("string")),
        obj(claim_id=claim, passage_id=e["passage_id"], relation=e["relation"])))
    kind = proposed
    cedg, counter = F.col("cedg"), F.col("external_counter_retrieval")

    def only(condition, items):
        return F.when(condition, items).otherwise(F.filter(items, lambda _x: F.lit(False)))

    terminal = F.array(moved(9, F.col("decision"), F.col("reason"), "terminal",
                             F.col("boundary")))
    stream = F.concat(
        only(cedg, kind), searched(1, "support", "RETRIEVE", SUPPORT_SUFFIX),
        only(counter, searched(3, "counterevidence", "CHALLENGE", COUNTER_SUFFIX)),
        decided, only(cedg, linked),
        only(cedg & (F.col("decision") == "SURVIVED"), F.array(
            moved(7, F.lit("SUPPORTED"), F.col("reason"), "supported"))),
        only(cedg & counter, F.array(
            moved(8, F.lit("CHALLENGED"), F.lit("counter-query executed"), "challenged"))),
        only(cedg, terminal))
    if predictions is not None:
        commits = predictions.select("challenge_id", "method_id", F.col("run_id").alias("__run"),
                                     F.col("prediction_commitment_sha256").alias("__sha"))
        jobs = jobs.join(commits, ["challenge_id", "method_id"])
        fields = obj(challenge_id=claim, run_id=F.col("__run"), method_id=F.col("method_id"),
                     prediction_commitment_sha256=F.col("__sha"))
        outcome = obj(challenge_id=claim, run_id=F.col("__run"), method_id=F.col("method_id"),
                      status=F.lit("completed"),
                      prediction_commitment_sha256=F.col("__sha"))
        stream = F.concat(
            stream,
            F.array(_event(10, zero, "benchmark.prediction_candidate_recorded",
                           "benchmark_prediction", claim, "SYNTHESIZE", F.lit("commitment"),
                           fields)),
            F.array(F.struct(
                F.lit(11).alias("position"), F.lit(0).alias("sub"),
                F.lit("benchmark_prediction").alias("aggregate_type"),
                claim.alias("aggregate_id"),
                F.lit("benchmark.prediction_committed").alias("event_type"),
                F.to_json(outcome).alias("payload"),
                fn.idempotency_key("outcome", F.col("__run"), F.col("method_id"), claim,
                                   "completed").alias("idempotency_key"))))
    return jobs.select(F.lit(tenant_id).alias("tenant_id"), "job_id",
                       F.explode(stream).alias("e")).select(
        "tenant_id", "job_id", "e.*",
        F.concat_ws("/", "job_id", F.col("e.position").cast("string"),
                    F.col("e.sub").cast("string")).alias("event_id"))


# --- ordered treatment -----------------------------------------------------------------------

def ordered_step(steps: DataFrame, predictions: DataFrame, outcomes_of, state: dict[str, DataFrame],
                 now: float, min_evaluations: int = 3, activation: float = 0.2,
                 exploration_period: int = 3) -> dict[str, DataFrame]:
    """One step of the ordered treatment for all tenants and runs together.

    ``steps``: tenant_id, run_id, method_id, sequence_index, challenge_id, target_task_family,
    memory_mode, order_sha256 - at most one step per (tenant, run, method).
    ``predictions``: challenge_id, run_id, method_id, job_id, counter_query, calls, tokens,
    status, strategy_candidates. ``outcomes_of(applied)`` is the external credit evaluator (E05):
    it returns challenge_id, run_id, method_id, evaluator_kind, success, false_gap_avoided,
    valid_finding_delta, evidence_ref. ``state``: strategies, applications, outcomes and
    sequence_interventions tables; the next versions are returned under the same names.
    """
    strategies, applications = state["strategies"], state["applications"]
    outcomes, bound = state["outcomes"], state["sequence_interventions"]
    # One row per strategy, read by every kind of recall.
    scores = materialise(policy.strategy_scores(strategies, applications, outcomes))
    key = ["tenant_id", "run_id", "method_id", "sequence_index"]
    fresh = steps.join(bound.select(*key), key, "left_anti")
    chosen = policy.select_intervention(fresh, scores, applications, exploration_period)
    new_bound = chosen.select(
        *key, "challenge_id", "order_sha256", "memory_mode",
        F.to_json("strategy_ids").alias("strategy_ids"), F.lit(now).alias("created_at"))
    all_bound = materialise(bound.unionByName(new_bound.select(*bound.columns)))
    current = all_bound.join(steps.select(*key, "target_task_family"), key)
    picked = current.select(*key, "challenge_id", "memory_mode", "target_task_family",
                            F.explode(F.from_json("strategy_ids", "array<string>"))
                            .alias("strategy_id"))
    run = ["challenge_id", "run_id", "method_id"]
    used = picked.join(predictions.select(*run, "job_id", "counter_query", "calls", "tokens"),
                       run).where(F.col("counter_query").isNotNull())
    idem = fn.idempotency_key(F.col("run_id"), F.col("method_id"), F.col("sequence_index"),
                              F.col("strategy_id"), "application")
    # A step adds few rows to long logs: it is stored once, the logs are held against it where they
    # lie, and only strategies that it touches are scored anew.
    applied = materialise(used.withColumn("idempotency_key", idem).withColumn(
        "application_id", fn.sha256(F.concat_ws("|", "tenant_id", "idempotency_key"))))
    new_applications = materialise(
        _without(applied, applications, ["tenant_id", "idempotency_key"]).select(
            "application_id", "strategy_id", "tenant_id", F.col("job_id").alias("target_job_id"),
            "target_task_family", fn.sha256("counter_query").alias("rendered_query_sha256"),
            "idempotency_key", F.lit(now).alias("created_at")))
    next_applications = applications.unionByName(
        new_applications.select(*applications.columns))
    pending = _without(applied.where(F.col("memory_mode") == "delayed_external_credit"),
                       outcomes, ["application_id"])
    credit = outcomes_of(pending.select(*run).distinct())
    new_outcomes = materialise(pending.join(credit, run).select(
        "application_id", "evaluator_kind", "success", "false_gap_avoided",
        "valid_finding_delta", "calls", "tokens", "evidence_ref",
        F.lit(now).alias("recorded_at")))
    next_outcomes = outcomes.unionByName(new_outcomes.select(*outcomes.columns))
    added = new_applications.select("application_id").union(new_outcomes.select("application_id"))
    refreshed = policy.strategy_status(
        _rescored(scores, strategies, next_applications, next_outcomes, added),
        min_evaluations, activation)
    next_strategies = materialise(policy.apply_statuses(strategies, refreshed, now))
    family = steps.select("tenant_id", *run, "target_task_family")
    proposals = (predictions.where(F.col("status") == "completed").join(family, run)
                 .select("tenant_id", "target_task_family", "job_id",
                         F.posexplode("strategy_candidates").alias("i", "c"))
                 .select("tenant_id", "c.kind", "c.pattern",
                         F.col("job_id").alias("source_job_id"),
                         F.col("target_task_family").alias("source_task_family"),
                         F.lit(now).alias("created_at"),
                         fn.sha256(F.concat_ws("|", "tenant_id", "job_id",
                                               F.col("i").cast("string"))).alias("proposal_id")))
    proposed = policy.propose_strategies(proposals, next_strategies)
    out = {
        "strategies": next_strategies.unionByName(
            proposed.select(*next_strategies.columns)),
        "applications": next_applications, "outcomes": next_outcomes,
        "sequence_interventions": all_bound,
    }
    # What the step adds is stored, so a next step does not run this one again. The logs are the
    # caller's and are not copied.
    return {**out, "strategies": materialise(out["strategies"])}


def _held(log: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a long log whose keys are among a few ``wanted`` ones; the log is not moved."""
    return log.join(broadcast_if_bounded(wanted.select(*keys).distinct()), keys, "left_semi")


def _without(rows_: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """A few rows without those whose keys a long log holds."""
    return rows_.join(_held(log, rows_, keys).select(*keys).distinct(), keys, "left_anti")


def _rescored(scores: DataFrame, strategies: DataFrame, applications: DataFrame,
              outcomes: DataFrame, added: DataFrame) -> DataFrame:
    """A08 after rows were added to the logs: only strategies with an application among ``added``
    ids can score otherwise than before."""
    touched = materialise(_held(applications, added, ["application_id"]).select(
        "strategy_id").distinct())
    used = materialise(_held(applications, touched, ["strategy_id"]).select(
        "application_id", "strategy_id", "target_task_family"))
    renewed = policy.strategy_scores(
        _held(strategies, touched, ["strategy_id"]), used,
        _held(outcomes, used, ["application_id"]))
    return scores.join(touched, "strategy_id", "left_anti").select(*scores.columns).unionByName(
        renewed)

"""Row contracts of the data model, each as a DataFrame with a ``violations`` column."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import (
    Rule, any_of, duplicated, is_blank, is_missing, missing_fields, with_violations,
)
from veriledge.session import broadcast_if_bounded


def _no_text() -> Column:
    return F.array().cast("array<string>")


def _count_ok(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) >= 0)


# --- key scans -------------------------------------------------------------------------------

def _key_paths(pattern: str, prefix: str):
    """Arrow UDF: JSON paths of all keys that match, in document order."""
    @F.pandas_udf(ArrayType(StringType()))
    def scan(texts: pd.Series) -> pd.Series:
        wanted = re.compile(pattern)

        def walk(value, path):
            if isinstance(value, dict):
                for key, item in value.items():
                    here = f"{path}.{key}"
                    if wanted.search(key):
                        yield here
                    yield from walk(item, here)
            elif isinstance(value, list):
                for index, item in enumerate(value):
                    yield from walk(item, f"{path}[{index}]")

        def paths(text):
            if text is None:
                return None
            try:
                return list(walk(json.loads(text), prefix))
            except ValueError:
                return []

        return texts.map(paths, na_action="ignore")

    return scan


def sensitive_paths(text: str | Column, prefix: str = "payload") -> Column:
    """Paths of secret-like keys at any depth. Only texts that contain such a word at all
    leave the JVM."""
    value = F.col(text) if isinstance(text, str) else text
    maybe = value.rlike(
        "(?i)api_?key|authorization|cookie|credential|password|secret|token|\\\\u")
    scan = _key_paths(S.SENSITIVE_KEY, prefix)
    return F.when(maybe, scan(F.when(maybe, value))).otherwise(_no_text())


def forbidden_paths(text: str | Column, prefix: str = "task") -> Column:
    """Paths of gold field names."""
    value = F.col(text) if isinstance(text, str) else text
    maybe = value.rlike("|".join(S.FORBIDDEN_GOLD_KEYS) + "|\\\\u")
    scan = _key_paths("^(" + "|".join(S.FORBIDDEN_GOLD_KEYS) + ")$", prefix)
    return F.when(maybe, scan(F.when(maybe, value))).otherwise(_no_text())


def payload_rules(column: str = "payload") -> list[Rule]:
    """Durable payloads are finite JSON objects without secret-like keys."""
    parsed = fn.parse_json_strict(column)
    found = sensitive_paths(column, column)
    return [
        Rule("payload_not_object",
             ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))),
        Rule("payload_sensitive", F.size(found) > 0, F.array_join(found, ", ")),
        Rule("payload_not_finite", F.coalesce(
            F.col(column).rlike(r"[:\[,]\s*(NaN|-?Infinity)"), F.lit(False))),
    ]


# --- events ----------------------------------------------------------------------------------

def validate_events(events: DataFrame, mode: str = "exact") -> DataFrame:
    """P06."""
    text_fields = ("event_id", "occurred_at", "tenant_id", "job_id", "aggregate_type",
                   "aggregate_id", "event_type", "idempotency_key")
    stamp = F.col("occurred_at")
    parsed = F.try_to_timestamp(stamp)
    hashed = events.withColumn("__hash", fn.event_hash(mode=mode))
    rules = [
        Rule("schema_version", F.coalesce(F.col("schema_version") != 1, F.lit(True))),
        Rule("sequence", F.coalesce(F.col("sequence") < 1, F.lit(True))),
        *[Rule(f"empty_{name}", is_blank(name)) for name in text_fields],
        Rule("occurred_at_format", ~is_blank("occurred_at") & parsed.isNull()),
        Rule("occurred_at_zone", parsed.isNotNull() & fn.zoned_timestamp(stamp).isNull()),
        *payload_rules(),
        Rule("previous_hash_shape",
             (F.coalesce("previous_hash", F.lit("")) != "") & ~fn.is_sha256("previous_hash")),
        Rule("event_hash_shape", ~fn.is_sha256("event_hash")),
        Rule("event_hash_mismatch",
             fn.is_sha256("event_hash") & ~F.col("__hash").eqNullSafe(F.col("event_hash"))),
    ]
    return with_violations(hashed, rules).drop("__hash")


# --- benchmark rows --------------------------------------------------------------------------

def _locator_bad(item: Column) -> Column:
    locator = item["locator"]
    return locator.isNull() | fn.locator_kind(locator).isNull() | (
        fn.locator_position(locator) < 0)


def validate_challenges(challenges: DataFrame) -> DataFrame:
    """P07, with A22 (groups that cross splits) joined in."""
    evidence, cutoff = F.col("accepted_evidence"), fn.iso_date("cutoff_date")
    available = F.filter(evidence, lambda e: e["oracle_scope"] == "available_by_cutoff")
    relations = F.transform(available, lambda e: e["relation"])
    has_counter = F.exists(available, lambda e: e["relation"].isin(*S.COUNTER_RELATIONS))
    wanted_missing = any_of([
        (F.col("expected_decision") == decision)
        & ~F.arrays_overlap(relations, F.array(*[F.lit(r) for r in wanted]))
        for decision, wanted in S.DECISION_GOLD.items()
    ])

    def item(code, condition):
        return Rule(code, F.exists(evidence, condition),
                    F.array_join(F.transform(F.filter(evidence, condition),
                                             lambda e: e["evidence_id"]), ","))

    def published(e):
        return fn.iso_date(e["publication_date"])

    marked = duplicated(challenges, ["challenge_id"], "__dup")
    ids = (challenges.select("challenge_id", F.explode("accepted_evidence").alias("e"))
           .groupBy(F.col("e.evidence_id").alias("evidence_id"))
           .agg(F.count(F.lit(1)).alias("n"))
           .where("n > 1").select("evidence_id"))
    repeated = (challenges.select("challenge_id", F.explode("accepted_evidence").alias("e"))
                .select("challenge_id", F.col("e.evidence_id").alias("evidence_id"))
                .join(ids, "evidence_id", "left_semi")
                .select("challenge_id", F.lit(True).alias("__repeated")).distinct())
    leaking = leakage_groups(challenges).select("leakage_group", F.lit(True).alias("__leaks"))
    joined = (marked.join(repeated, "challenge_id", "left")
              .join(leaking, "leakage_group", "left"))
    provenance = F.col("construction_provenance")
    rules = [
        missing_fields([f.name for f in S.CHALLENGE.fields
                        if f.name in challenges.columns and f.name != "accepted_evidence"]),
        Rule("version_or_track", (F.col("schema_version") != 1)
             | ~F.col("benchmark_track").isin(*S.TRACKS)),
        Rule("split_or_decision", ~F.col("split").isin(*S.SPLITS)
             | ~F.col("expected_decision").isin(*S.DECISIONS)),
        Rule("duplicate_challenge_id", F.col("__dup")),
        Rule("cutoff_date", cutoff.isNull()),
        Rule("accepted_evidence", evidence.isNull()),
        item("evidence_missing_fields", lambda e: any_of(
            [is_missing(e[n]) for n in (
                "evidence_id", "doc_id", "relation", "content_sha256", "publication_date",
                "oracle_scope", "snapshot_id", "source_url", "doi", "license_spdx",
                "source_locator")])),
        Rule("duplicate_evidence_id", F.col("__repeated").isNotNull()),
        item("evidence_relation", lambda e: ~e["relation"].isin(*S.GOLD_RELATIONS)),
        item("evidence_locator", _locator_bad),
        item("evidence_digest", lambda e: ~fn.is_sha256(e["content_sha256"])),
        item("evidence_https", lambda e: ~e["source_url"].startswith("https://")),
        item("evidence_doi", lambda e: ~F.lower(e["doi"]).startswith("10.")),
        item("evidence_licence", lambda e: e["license_spdx"] != S.LICENSE),
        item("evidence_date", lambda e: published(e).isNull()),
        item("evidence_scope", lambda e: ~e["oracle_scope"].isin(*S.ORACLE_SCOPES)),
        item("evidence_after_cutoff", lambda e: (e["oracle_scope"] == "available_by_cutoff")
             & (published(e) > cutoff)),
        item("evidence_before_cutoff", lambda e: (e["oracle_scope"] == "post_cutoff_validation")
             & (published(e) <= cutoff)),
        item("known_answer_scope", lambda e: (F.col("benchmark_track") == "known_answer")
             & (e["oracle_scope"] != "available_by_cutoff")),
        Rule("label_disagrees", F.col("counterevidence_exists") != has_counter),
        Rule("decision_without_gold", wanted_missing),
        Rule("provenance_fields", provenance.isNull() | is_missing(provenance["source"])
             | is_missing(provenance["curator"])),
        Rule("curation_status", ~provenance["status"].isin(*S.CURATION_STATUSES)),
        Rule("leakage_across_splits", F.col("__leaks").isNotNull()),
    ]
    return with_violations(joined, rules).select(*challenges.columns, "violations")


def leakage_groups(challenges: DataFrame) -> DataFrame:
    """Groups found in more than one split."""
    return (challenges.groupBy("leakage_group")
            .agg(F.sort_array(F.collect_set("split")).alias("splits"))
            .where(F.size("splits") > 1))


def validate_snapshots(snapshots: DataFrame) -> DataFrame:
    """P08."""
    words = F.size(F.split(fn.collapse_spaces("content"), " "))
    marked = duplicated(snapshots, ["snapshot_id"], "__dup")
    rules = [
        missing_fields(["schema_version", "snapshot_id", "content", "content_sha256",
                        "source_url", "doi", "source_locator", "retrieved_at", "license_spdx",
                        "attribution", "normalization", "publication_date"]),
        Rule("schema_version", F.col("schema_version") != 1),
        Rule("duplicate_snapshot_id", F.col("__dup")),
        Rule("content_words", (fn.collapse_spaces("content") == "")
             | (words > S.SNAPSHOT_MAX_WORDS)),
        Rule("content_digest", ~fn.sha256("content").eqNullSafe(F.col("content_sha256"))),
        Rule("source_https", ~F.col("source_url").startswith("https://")),
        Rule("doi", ~F.lower("doi").startswith("10.")),
        Rule("licence", F.col("license_spdx") != S.LICENSE),
        Rule("publication_date", fn.iso_date("publication_date").isNull()),
        Rule("retrieved_at", fn.zoned_timestamp("retrieved_at").isNull()),
    ]
    return with_violations(marked, rules).drop("__dup")


def blind_project(challenges: DataFrame) -> DataFrame:
    """P05."""
    return challenges.select(*S.TASK_FIELDS)


def validate_blind_tasks(tasks: DataFrame, raw: str | None = None) -> DataFrame:
    """P09. ``raw`` names a column with the row's JSON text, checked for gold keys at any depth;
    without it the column names themselves are checked."""
    extra = sorted(set(tasks.columns) - set(S.TASK_FIELDS) - {raw})
    found = forbidden_paths(raw) if raw else F.array(*[
        F.lit(f"task.{name}") for name in extra if name in S.FORBIDDEN_GOLD_KEYS]
    ).cast("array<string>")
    if raw:
        keys = F.map_keys(F.try_variant_get(F.try_parse_json(F.col(raw)), "$",
                                            "map<string,variant>"))
        exact = F.array_sort(keys) != F.array(*[F.lit(n) for n in sorted(S.TASK_FIELDS)])
    else:
        exact = F.lit(bool(extra))
    marked = duplicated(tasks, ["challenge_id"], "__dup")
    rules = [
        Rule("task_fields", F.coalesce(exact, F.lit(True)), F.lit(",".join(extra))),
        Rule("gold_leaked", F.size(found) > 0, F.array_join(found, ", ")),
        Rule("schema_version", F.coalesce(F.col("schema_version") != 1, F.lit(True))),
        Rule("challenge_id", is_missing("challenge_id") | F.col("__dup")),
        *[Rule(f"empty_{name}", is_blank(name)) for name in S.TASK_FIELDS[2:]],
    ]
    return with_violations(marked, rules).drop("__dup")


def validate_predictions(predictions: DataFrame) -> DataFrame:
    """P10."""
    probability = F.col("counterevidence_probability")
    neutral = ((F.col("predicted_decision") == "UNRESOLVED") & (probability == 0.5)
               & (F.size("evidence") == 0))
    rules = [
        missing_fields([f.name for f in S.PREDICTION.fields if f.name != "evidence"]),
        Rule("version_or_status", (F.col("schema_version") != 1)
             | ~F.col("status").isin("completed", "failed")),
        Rule("decision", ~F.col("predicted_decision").isin(*S.DECISIONS)),
        Rule("probability", F.isnan(probability) | (probability < 0) | (probability > 1)),
        *[Rule(name, ~_count_ok(name)) for name in ("calls", "tokens", "ledger_event_count")],
        Rule("evidence", F.col("evidence").isNull()),
        Rule("evidence_items", F.exists("evidence", lambda e: (
            ~F.coalesce(e["relation"].isin(*S.GOLD_RELATIONS), F.lit(False))
            | ~fn.is_sha256(e["content_sha256"]) | _locator_bad(e)))),
        Rule("failed_not_neutral", (F.col("status") == "failed") & ~neutral),
        Rule("ledger_head", ~fn.is_sha256("ledger_head")),
        Rule("commitment", ~fn.is_sha256("prediction_commitment_sha256")),
        Rule("ledger_relpath", ~fn.safe_relpath("ledger_relpath")),
    ]
    return with_violations(predictions, rules)


def validate_observations(pairs: DataFrame) -> DataFrame:
    """P11 over J04 pairs: struct columns ``s`` (snapshot) and ``o`` (observation)."""
    s, o = F.col("s"), F.col("o")
    retrieval = o["retrieval"]
    observed, sealed = fn.zoned_timestamp(o["observed_at"]), fn.zoned_timestamp(s["retrieved_at"])
    carries = o["content"].isNotNull() | o["content_sha256"].isNotNull()
    available = o["status"] == "available"
    empty = o["content"].isNull() | (fn.collapse_spaces(o["content"]) == "")
    both = s.isNotNull() & o.isNotNull()
    rules = [
        Rule("missing_observation", o.isNull()),
        Rule("unexpected_observation", s.isNull()),
        Rule("schema_version", both & (o["schema_version"] != 1)),
        Rule("source_url", both & ~o["source_url"].eqNullSafe(s["source_url"])),
        Rule("doi", both & ~o["doi"].eqNullSafe(s["doi"])),
        Rule("observed_at", both & observed.isNull()),
        Rule("not_after_sealing", both & (observed <= sealed)),
        Rule("retrieval_fields", both & retrieval.isNull()),
        Rule("retrieval_method", both & (~retrieval["method"].isin(*S.DRIFT_METHODS)
                                         | is_blank(retrieval["actor"]))),
        Rule("independently_verified", both & retrieval["independently_verified"].isNull()),
        Rule("receipt", both & ~fn.is_sha256(retrieval["receipt_sha256"])),
        Rule("unavailable_with_content", both & (o["status"] == "unavailable") & carries),
        Rule("status", both & ~o["status"].isin("available", "unavailable")),
        Rule("content", both & available & empty),
        Rule("content_digest", both & available & ~empty
             & ~fn.sha256(o["content"]).eqNullSafe(o["content_sha256"])),
    ]
    return with_violations(pairs, rules)


# --- run artefacts ---------------------------------------------------------------------------

def validate_query_plan(plans: DataFrame) -> DataFrame:
    """Queries array<string>, calls, tokens."""
    queries = F.col("queries")
    rules = [
        Rule("usage", ~_count_ok("calls") | ~_count_ok("tokens")),
        Rule("query_count", F.coalesce(~F.size(queries).between(1, 8), F.lit(True))),
        Rule("query_text", F.exists(queries, lambda q: is_blank(q) | (F.length(q) > 1000))),
    ]
    return with_violations(plans, rules)


def validate_passages(passages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Passage rows; ids are unique within ``keys`` (one retrieval result)."""
    marked = duplicated(passages, [*(keys or ["challenge_id", "query_id"]), "passage_id"],
                        "__dup")
    locator = F.col("locator")
    rules = [
        Rule("empty_identity", any_of([is_blank(n) for n in
                                       ("passage_id", "query_id", "doc_id", "text")])),
        Rule("locator", locator.isNull() | fn.locator_kind(locator).isNull()),
        Rule("locator_position", fn.locator_position(locator) < 0),
        Rule("content_digest", ~fn.sha256("text").eqNullSafe(F.col("content_sha256"))),
        Rule("duplicate_passage_id", F.col("__dup")),
    ]
    return with_violations(marked, rules).drop("__dup")


def validate_decisions(decisions: DataFrame) -> DataFrame:
    """Decision rows with ``exposed`` passage ids, ``evidence`` array<struct<passage_id,
    relation>> and ``strategy_candidates`` array<struct<kind, pattern>>."""
    evidence, strategies = F.col("evidence"), F.col("strategy_candidates")
    cited = F.transform(evidence, lambda e: e["passage_id"])
    probability = F.col("counterevidence_probability")
    identities = F.transform(strategies, lambda c: F.struct(
        c["kind"], fn.normalize_query(c["pattern"])))
    rules = [
        Rule("usage", ~_count_ok("calls") | ~_count_ok("tokens")),
        Rule("decision", F.coalesce(~F.col("decision").isin(*S.DECISIONS), F.lit(True))),
        Rule("probability", F.coalesce(F.isnan(probability) | (probability < 0)
                                       | (probability > 1), F.lit(True))),
        Rule("reason", is_blank("reason")),
        Rule("cites_unexposed", F.size(F.array_except(cited, F.col("exposed"))) > 0),
        Rule("relation", F.exists(evidence, lambda e: ~F.coalesce(
            e["relation"].isin(*S.RELATIONS), F.lit(False)))),
        Rule("cited_twice", F.size(F.array_distinct(cited)) < F.size(cited)),
        Rule("boundary", F.col("decision").isin("SURVIVED", "NARROWED") & is_blank("boundary")),
        Rule("too_many_strategies", F.size(strategies) > 3),
        Rule("strategy_kind", F.exists(strategies, lambda c: ~F.coalesce(
            c["kind"].isin(*S.STRATEGY_KINDS), F.lit(False)))),
        Rule("strategy_pattern", F.exists(strategies, lambda c: is_blank(c["pattern"])
                                          | (F.length(c["pattern"]) > 240))),
        Rule("duplicate_strategy", F.size(F.array_distinct(identities)) < F.size(strategies)),
    ]
    return with_violations(decisions, rules)


_EVIDENCE_ITEMS = "array<struct<passage_id:string,relation:string>>"
_STRATEGY_ITEMS = "array<struct<kind:string,pattern:string>>"


def parse_model_output(responses: DataFrame, kind: str) -> DataFrame:
    """Raw model texts to typed plan (``kind='plan'``) or decision rows.

    ``responses``: text, input_tokens, output_tokens, request_id; decisions also need ``cedg``.
    Rows that break a rule keep their violations and can be set aside with ``split_valid``.
    """
    fields = {"plan": ("queries",),
              "decision": ("decision", "counterevidence_probability", "evidence", "reason",
                           "boundary", "strategy_candidates")}[kind]
    parsed = responses.withColumn("__v", fn.parse_json_strict("text"))
    value = F.col("__v")
    keys = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    exact = keys == F.array(*[F.lit(n) for n in sorted(fields)])
    fenced = F.ltrim("text").startswith("```")

    def items_exact(path, names):
        items = F.try_variant_get(value, path, "array<map<string,variant>>")
        wanted = F.array(*[F.lit(n) for n in sorted(names)])
        return F.coalesce(F.forall(items, lambda m: F.coalesce(
            F.array_sort(F.map_keys(m)) == wanted, F.lit(False))), F.lit(False))

    rules = [
        Rule("metadata", is_blank("text") | is_blank("request_id")
             | ~_count_ok("input_tokens") | ~_count_ok("output_tokens")),
        Rule("code_fence", fenced),
        Rule("invalid_json", ~fenced & value.isNull()),
        Rule("fields", value.isNotNull() & ~F.coalesce(exact, F.lit(False))),
    ]
    ok = F.coalesce(exact, F.lit(False))
    usage = [F.lit(1).cast("bigint").alias("calls"),
             (F.col("input_tokens") + F.col("output_tokens")).cast("bigint").alias("tokens")]
    if kind == "plan":
        listed = F.try_variant_get(value, "$.queries", "array<variant>")
        rules.append(Rule("query_type", ok & (listed.isNull() | F.exists(
            listed, lambda q: F.schema_of_variant(q) != "STRING"))))
        typed = [F.try_variant_get(value, "$.queries", "array<string>").alias("queries")]
    else:
        rules += [
            Rule("evidence_items", ok & ~items_exact("$.evidence", ("passage_id", "relation"))),
            Rule("strategy_items",
                 ok & ~items_exact("$.strategy_candidates", ("kind", "pattern"))),
            Rule("strategies_not_allowed", ok & ~F.col("cedg") & (F.size(F.try_variant_get(
                value, "$.strategy_candidates", "array<variant>")) > 0)),
        ]
        typed = [F.try_variant_get(value, f"$.{name}", sql).alias(name) for name, sql in (
            ("decision", "string"), ("counterevidence_probability", "double"),
            ("evidence", _EVIDENCE_ITEMS), ("reason", "string"), ("boundary", "string"),
            ("strategy_candidates", _STRATEGY_ITEMS))]
    return with_violations(parsed, rules).select(
        *responses.columns, *typed, *usage, "violations")


def build_decision_requests(tasks: DataFrame, passages: DataFrame, methods: DataFrame,
                            max_passages: int = 20, max_chars: int = 60_000) -> DataFrame:
    """One request per task and method with its passages, checked against context limits.

    Only tasks and methods meet in full; the number of passages per task is bounded by the
    retrieval depth. Passage counts over the limit are found before any text is gathered.
    """
    counted = passages.groupBy("challenge_id").agg(
        F.count(F.lit(1)).alias("n_passages"),
        F.count_if(F.col("intent") == "counterevidence").alias("n_counter"))
    fits = counted.where(F.col("n_passages") <= max_passages).select("challenge_id")
    item = F.struct(
        "intent", "query_id", "rank", "passage_id", "doc_id", "content_sha256",
        "publication_date", "text", "locator")
    packed = (passages.join(fits, "challenge_id", "left_semi").groupBy("challenge_id")
              .agg(F.array_sort(F.collect_list(item)).alias("items")))

    def part(intent):
        return F.transform(
            F.filter(F.col("items"), lambda p: p["intent"] == intent),
            lambda p: F.to_variant_object(F.struct(
                p["passage_id"].alias("passage_id"), p["query_id"].alias("query_id"),
                p["doc_id"].alias("doc_id"),
                fn.locator_variant(p["locator"]).alias("locator"),
                p["publication_date"].cast("string").alias("publication_date"),
                p["content_sha256"].alias("content_sha256"), p["text"].alias("text"))))

    task_object = F.to_variant_object(F.struct(*[F.col(n).alias(n) for n in S.TASK_FIELDS]))
    joined = (tasks.crossJoin(broadcast_if_bounded(methods))  # methods: a handful of treatments
              .join(counted, "challenge_id", "left").join(packed, "challenge_id", "left"))
    counter_part = F.when(F.col("external_counter_retrieval"),
                          part("counterevidence")).otherwise(F.array().cast("array<variant>"))
    user = F.to_json(F.to_variant_object(F.struct(
        task_object.alias("task"), F.col("decision_mode").alias("decision_mode"),
        F.coalesce(part("support"), F.array().cast("array<variant>")).alias("support_passages"),
        F.coalesce(counter_part, F.array().cast("array<variant>")).alias("counter_passages"))))
    n_used = F.when(F.col("external_counter_retrieval"), F.col("n_passages")).otherwise(
        F.col("n_passages") - F.col("n_counter"))
    # Over the limit there is no request: a text without its passages would be another request.
    whole = F.coalesce(F.col("n_passages"), F.lit(0)) <= max_passages
    out = joined.withColumn("passages", F.coalesce(n_used, F.lit(0))).withColumn(
        "user", F.when(whole, user))
    rules = [
        Rule("too_many_passages", F.col("passages") > max_passages),
        Rule("context_too_long", F.length("user") > max_chars),
    ]
    return with_violations(out, rules).select(
        "challenge_id", "method_id", "passages", "user",
        fn.sha256("user").alias("request_sha256"), "violations")


# --- search, service and policy rows ---------------------------------------------------------

def validate_hypotheses(hypotheses: DataFrame) -> DataFrame:
    """Objectives array<double>, action, prior."""
    values = F.col("objectives")
    rules = [
        Rule("objective_count", F.coalesce(F.size(values) != len(S.OBJECTIVES), F.lit(True))),
        Rule("objective_range", F.exists(values, lambda x: x.isNull() | F.isnan(x)
                                         | (x < 0) | (x > 1))),
        Rule("action", is_blank("action")),
        Rule("prior", F.coalesce(F.isnan("prior") | (F.col("prior") < 0)
                                 | (F.col("prior") == float("inf")), F.lit(True))),
    ]
    return with_violations(hypotheses, rules)


def validate_submission(submissions: DataFrame, body: str = "body") -> DataFrame:
    """Job submission bodies as JSON text."""
    submissions = submissions.withColumn("__v", fn.parse_json_strict(body))
    value = F.col("__v")
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    allowed = F.array(*[F.lit(n) for n in S.SUBMISSION_LIMITS])
    unknown = F.array_sort(F.array_except(keys, allowed))

    def text(name):
        member = F.try_variant_get(value, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(member) == "STRING",
                      F.try_variant_get(value, f"$.{name}", "string"))

    def amount(name):
        member = F.try_variant_get(value, f"$.{name}", "variant")
        spelled = F.to_json(member)
        whole = F.schema_of_variant(member).rlike(r"^(BIGINT|DECIMAL)") & spelled.rlike(
            "^-?[0-9]+$")
        return F.when(whole, F.try_variant_get(value, f"$.{name}", "bigint"))

    key, task, limits = text("idempotency_key"), text("task"), S.SUBMISSION_LIMITS
    rules = [
        Rule("not_object", keys.isNull()),
        Rule("unknown_fields", F.size(unknown) > 0, F.array_join(unknown, ", ")),
        Rule("idempotency_key", keys.isNotNull() & ~F.coalesce(
            F.length(key).between(1, limits["idempotency_key"]), F.lit(False))),
        Rule("task", keys.isNotNull() & (is_blank(task) | (F.length(task) > limits["task"]))),
        *[Rule(name, keys.isNotNull() & ~F.coalesce(
            amount(name).between(0, limits[name]), F.lit(False)))
          for name in ("max_calls", "max_tokens", "max_cost_microunits")],
    ]
    return with_violations(submissions, rules).drop("__v")


def tenant_scope(df: DataFrame, tenant_id: str, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; other tenants' rows look like missing ones."""
    if not tenant_id or not tenant_id.strip():
        raise ValueError("tenant_id is required")
    return df.where(F.col(column) == tenant_id)


def validate_strategies(strategies: DataFrame) -> DataFrame:
    """P24 for strategies."""
    rules = [
        Rule("kind", F.coalesce(~F.col("kind").isin(*S.STRATEGY_KINDS), F.lit(True))),
        *[Rule(f"empty_{n}", is_blank(n)) for n in
          ("tenant_id", "pattern", "source_job_id", "source_task_family")],
    ]
    return with_violations(strategies, rules)


def validate_applications(applications: DataFrame, strategies: DataFrame) -> DataFrame:
    """P24 for applications: the strategy exists in the tenant and is not retired."""
    known = strategies.select("strategy_id", "tenant_id", F.col("status").alias("__status"))
    joined = applications.join(known, ["strategy_id", "tenant_id"], "left")
    rules = [
        Rule("unknown_strategy", F.col("__status").isNull()),
        Rule("retired_strategy", F.col("__status") == "RETIRED"),
        *[Rule(f"empty_{n}", is_blank(n)) for n in ("target_job_id", "target_task_family")],
    ]
    return with_violations(joined, rules).drop("__status")


def validate_outcomes(outcomes: DataFrame, applications: DataFrame) -> DataFrame:
    """P24 for outcomes."""
    known = applications.select("application_id", F.lit(True).alias("__known"))
    delta = F.col("valid_finding_delta")
    rules = [
        Rule("evaluator_kind", F.coalesce(~F.col("evaluator_kind").isin(*S.EVALUATORS),
                                          F.lit(True))),
        Rule("cost", ~_count_ok("calls") | ~_count_ok("tokens")),
        Rule("delta", F.coalesce(F.isnan(delta) | (F.abs(delta) == float("inf")), F.lit(True))),
        Rule("evidence_ref", is_blank("evidence_ref")),
        Rule("unknown_application", F.col("__known").isNull()),
    ]
    return with_violations(outcomes.join(known, "application_id", "left"), rules).drop("__known")


def validate_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """P25: payload contract, and the same key never carries other content."""
    mark = fn.sha256(F.concat_ws("|", "stage", fn.canonical_json("payload", "exact")))
    marked = checkpoints.withColumn("__mark", mark)
    conflicting = (marked.groupBy("job_id", "checkpoint_key")
                   .agg(F.min("__mark").alias("lo"), F.max("__mark").alias("hi"))
                   .where("lo <> hi").select("job_id", "checkpoint_key",
                                             F.lit(True).alias("__conflict")))
    joined = marked.join(conflicting, ["job_id", "checkpoint_key"], "left")
    rules = [*payload_rules(), Rule("key_conflict", F.col("__conflict").isNotNull())]
    return with_violations(joined, rules).drop("__mark", "__conflict")


def control_finalizer(events: DataFrame) -> DataFrame:
    """Exactly one decision and one prediction candidate per job."""
    def hits(name):
        return F.count_if(F.col("event_type") == name)

    counted = events.groupBy("tenant_id", "job_id").agg(
        hits("benchmark.decision_recorded").alias("benchmark_decisions"),
        hits("benchmark.prediction_candidate_recorded").alias("prediction_candidates"))
    rules = [
        Rule("decision_count", F.col("benchmark_decisions") != 1,
             F.col("benchmark_decisions").cast("string")),
        Rule("candidate_count", F.col("prediction_candidates") != 1,
             F.col("prediction_candidates").cast("string")),
    ]
    return with_violations(counted, rules)


def fixed_vocabulary(requests: DataFrame, duration: str = "duration_ms",
                     with_ids: bool = True) -> DataFrame:
    """P27."""
    rules = [
        Rule("method", F.coalesce(~F.col("method").isin(*S.HTTP_METHODS), F.lit(True))),
        Rule("route", F.coalesce(~F.col("route").isin(*S.HTTP_ROUTES), F.lit(True))),
        Rule("status", F.coalesce(~F.col("status").between(100, 599), F.lit(True))),
        Rule("duration", F.coalesce(F.col(duration) < 0, F.lit(True))),
    ]
    if with_ids:
        def hexed(name, size):
            return F.coalesce(F.col(name).rlike(f"^[0-9a-f]{{{size}}}$"), F.lit(False))

        rules += [
            Rule("trace_id", ~hexed("trace_id", 32) | (F.col("trace_id") == "0" * 32)),
            Rule("span_id", ~hexed("span_id", 16) | (F.col("span_id") == "0" * 16)),
            Rule("parent_span_id", (F.coalesce("parent_span_id", F.lit("")) != "")
                 & ~hexed("parent_span_id", 16)),
            Rule("request_id_sha256", ~fn.is_sha256("request_id_sha256")),
        ]
    return with_violations(requests, rules)


def provenance_manifest(runs: DataFrame) -> DataFrame:
    """Provider and index provenance; ready only when the index is attested."""
    rules = [Rule(f"empty_{n}", is_blank(n)) for n in
             ("route_id", "request_alias", "operator_declared_backend", "index_snapshot_id")]
    ready = F.coalesce(F.col("index_snapshot_attested"), F.lit(False))
    out = runs.withColumn("publication_ready", ready).withColumn(
        "cutoff_policy",
        F.lit("exact date when available; unknown same-year dates excluded"))
    return with_violations(out, rules)


def publication_ready(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """P28 folded over runs: every run must be attested and clean."""
    return manifests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.bool_and(F.col("publication_ready") & (F.size("violations") == 0))
        .alias("publication_ready"))

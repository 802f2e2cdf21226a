"""Benchmark contracts, scoring, statistics and drift."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import split_valid, violation_codes
from veriledge.operators import ledger, rows, score, stats
from veriledge.plans import composites
from veriledge.plans.catalog.q_scalars import _CLASS, SPACE
from veriledge.plans.catalog.registry import query
from veriledge.session import materialise

GOLD = ("gold", "gold_evidence")
BOTH = (*GOLD, "predicted", "predicted_evidence")
COUNTER = "('CONTRADICTS', 'BOUNDS', 'PRECEDENT_FOR')"
MAX_CALLS, MAX_TOKENS = 24, 30_000


@query("P05_blind_project", "gold", sql="""
    SELECT schema_version, challenge_id, benchmark_track, split, task_family,
        sha256(prompt) AS prompt_sha256, cutoff_date FROM gold""")
def _(t):
    return rows.blind_project(t.gold).withColumn("prompt_sha256", fn.sha256("prompt")).drop(
        "prompt")


_CHALLENGE_CODES = f"""
    WITH e AS (SELECT *, count(*) OVER (PARTITION BY evidence_id) AS same_id FROM gold_evidence),
    leaks AS (SELECT leakage_group FROM gold GROUP BY leakage_group
              HAVING count(DISTINCT split) > 1),
    per AS (SELECT challenge_id,
        bool_or(same_id > 1) AS dup,
        bool_or(page_no IS NULL AND locator_offset IS NULL) AS locator,
        bool_or(source_url NOT LIKE 'https://%') AS https,
        bool_or(lower(doi) NOT LIKE '10.%') AS doi,
        bool_or(license_spdx <> 'CC-BY-4.0') AS licence,
        bool_or(oracle_scope <> 'available_by_cutoff') AS later,
        bool_or(oracle_scope = 'available_by_cutoff' AND relation IN {COUNTER}) AS has_counter,
        bool_or(oracle_scope = 'available_by_cutoff' AND relation = 'SUPPORTS') AS s,
        bool_or(oracle_scope = 'available_by_cutoff' AND relation = 'BOUNDS') AS b,
        bool_or(oracle_scope = 'available_by_cutoff' AND relation = 'CONTRADICTS') AS c
        FROM e GROUP BY challenge_id)
    SELECT g.challenge_id, concat_ws(',',
        CASE WHEN dup THEN 'duplicate_evidence_id' END,
        CASE WHEN locator THEN 'evidence_locator' END, CASE WHEN https THEN 'evidence_https' END,
        CASE WHEN doi THEN 'evidence_doi' END, CASE WHEN licence THEN 'evidence_licence' END,
        CASE WHEN benchmark_track = 'known_answer' AND later THEN 'known_answer_scope' END,
        CASE WHEN counterevidence_exists <> has_counter THEN 'label_disagrees' END,
        CASE WHEN expected_decision = 'SURVIVED' AND NOT s OR expected_decision = 'NARROWED'
            AND NOT b OR expected_decision = 'REFUTED' AND NOT c
            THEN 'decision_without_gold' END,
        CASE WHEN l.leakage_group IS NOT NULL THEN 'leakage_across_splits' END) AS codes
    FROM gold g JOIN per p ON p.challenge_id = g.challenge_id
    LEFT JOIN leaks l ON l.leakage_group = g.leakage_group"""


@query("P07_validate_challenges", *GOLD, sql=_CHALLENGE_CODES)
def _(t):
    return rows.validate_challenges(t.challenges()).select(
        "challenge_id", violation_codes().alias("codes"))


@query("A22_leakage_check", "gold", sql="""
    SELECT leakage_group, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM gold
    GROUP BY leakage_group HAVING count(DISTINCT split) > 1""")
def _(t):
    return rows.leakage_groups(t.gold).select(
        "leakage_group", F.array_join("splits", ",").alias("splits"))


_SNAPSHOT_CODES = f"""
    SELECT snapshot_id, concat_ws(',',
        CASE WHEN attribution = '' THEN 'missing_fields' END,
        CASE WHEN len(string_split(trim(regexp_replace(content, '{SPACE}', ' ', 'g')), ' ')) > 120
            THEN 'content_words' END,
        CASE WHEN content_sha256 <> sha256(content) THEN 'content_digest' END,
        CASE WHEN source_url NOT LIKE 'https://%' THEN 'source_https' END,
        CASE WHEN doi NOT LIKE '10.%' THEN 'doi' END,
        CASE WHEN license_spdx <> 'CC-BY-4.0' THEN 'licence' END,
        CASE WHEN retrieved_at NOT LIKE '%Z' THEN 'retrieved_at' END) AS codes
    FROM snapshots"""


@query("P08_validate_snapshots", "snapshots", sql=_SNAPSHOT_CODES)
def _(t):
    return rows.validate_snapshots(t.snapshots).select("snapshot_id",
                                                       violation_codes().alias("codes"))


def _raw_tasks(t):
    i = F.col("item_id")
    raw = F.concat(
        F.lit('{"schema_version":1,"challenge_id":"t'), i.cast("string"),
        F.lit('","benchmark_track":"known_answer","split":"test","task_family":"f",'),
        F.when(i % 7 == 0, F.lit('"expected_decision":"REFUTED",')).otherwise(""),
        F.when(i % 9 == 0, F.lit('"prompt":{"x":[{"oracle_scope":1}]},')).otherwise(
            F.lit('"prompt":"p",')), F.lit('"cutoff_date":"2020-01-01"}'))
    return t.tasks.join(t.benchmark.select(
        F.concat(F.lit("t"), i.cast("string")).alias("challenge_id"), raw.alias("raw")),
        "challenge_id").withColumn("split", F.when(
            F.expr("cast(substr(challenge_id, 2) as bigint) % 5 = 0"), " ").otherwise(
                F.col("split")))


@query("P09_validate_blind_tasks", sql="""
    SELECT 't' || item_id AS challenge_id, concat_ws(',',
        CASE WHEN item_id % 7 = 0 THEN 'task_fields' END,
        CASE WHEN item_id % 7 = 0 OR item_id % 9 = 0 THEN 'gold_leaked' END,
        CASE WHEN item_id % 5 = 0 THEN 'empty_split' END) AS codes FROM benchmark""")
def _(t):
    return rows.validate_blind_tasks(_raw_tasks(t), raw="raw").select(
        "challenge_id", violation_codes().alias("codes"))


@query("P04_forbidden_paths", sql="""
    SELECT 't' || item_id AS challenge_id, concat_ws(',',
        CASE WHEN item_id % 7 = 0 THEN 'task.expected_decision' END,
        CASE WHEN item_id % 9 = 0 THEN 'task.prompt.x[0].oracle_scope' END) AS paths
    FROM benchmark""")
def _(t):
    return _raw_tasks(t).select("challenge_id", F.array_join(
        rows.forbidden_paths("raw"), ",").alias("paths"))


@query("P10_validate_predictions", "predicted", sql="""
    SELECT challenge_id, method_id, concat_ws(',',
        CASE WHEN doc_id % 6 = 1 THEN 'probability' END, CASE WHEN calls = 0 THEN 'calls' END,
        CASE WHEN status = 'failed' AND doc_id % 6 IN (0, 1) THEN 'failed_not_neutral' END,
        CASE WHEN doc_id % 10 = 0 THEN 'ledger_head' END,
        CASE WHEN doc_id % 15 = 0 THEN 'ledger_relpath' END) AS codes
    FROM (SELECT * REPLACE (CASE WHEN calls % 9 = 0 THEN 0 ELSE calls END AS calls)
          FROM predicted)""")
def _(t):
    i = F.expr("cast(substr(challenge_id, 2) as bigint)")
    p = t.predictions().withColumn("calls", F.when(F.col("calls") % 9 == 0, -1).otherwise(
        F.col("calls"))).withColumn(
        "counterevidence_probability", F.when(i % 6 == 1, 1.5).when(
            (F.col("status") == "failed") & (i % 6 == 0), 0.4).otherwise(
            F.col("counterevidence_probability"))).withColumn(
        "ledger_head", F.when(i % 10 == 0, "nope").otherwise(fn.sha256("run_id"))).withColumn(
        "ledger_event_count", F.lit(3).cast("bigint")).withColumn(
        "ledger_relpath", F.when(i % 15 == 0, "../x.jsonl").otherwise(F.lit("t/j/e.jsonl"))) \
        .withColumn("prediction_commitment_sha256", fn.prediction_commitment())
    return rows.validate_predictions(p).select("challenge_id", "method_id",
                                               violation_codes().alias("codes"))


def _partial(t):
    """Predictions with gaps, strangers and repeats."""
    i = F.expr("cast(substr(challenge_id, 2) as bigint)")
    p = t.predictions().select("run_id", "method_id", "challenge_id")
    kept = p.where(i % 8 != 0).withColumn("challenge_id", F.when(
        i % 9 == 0, F.concat(F.lit("z"), "challenge_id")).otherwise(F.col("challenge_id")))
    return kept.unionByName(p.where(i % 10 == 1))


_PARTIAL = """
    p AS (SELECT run_id, method_id, CASE WHEN doc_id % 9 = 0 THEN 'z' ELSE '' END || challenge_id
              AS challenge_id FROM predicted WHERE doc_id % 8 <> 0
          UNION ALL SELECT run_id, method_id, challenge_id FROM predicted
          WHERE doc_id % 10 = 1)"""


_COVERAGE = f"""WITH {_PARTIAL},
    n AS (SELECT run_id, method_id, challenge_id, count(*) AS n FROM p GROUP BY ALL),
    w AS (SELECT g.challenge_id, m.run_id, m.method_id FROM gold g
          CROSS JOIN (SELECT DISTINCT run_id, method_id FROM p) m)
    SELECT COALESCE(w.run_id, n.run_id) AS run_id, COALESCE(w.method_id, n.method_id)
        AS method_id, COALESCE(w.challenge_id, n.challenge_id) AS challenge_id,
        CASE WHEN w.run_id IS NULL THEN 'unknown' WHEN n.n IS NULL THEN 'missing'
             WHEN n.n > 1 THEN 'duplicate' ELSE 'covered' END AS coverage
    FROM w FULL OUTER JOIN n ON n.run_id = w.run_id AND n.method_id = w.method_id
        AND n.challenge_id = w.challenge_id"""


@query("J01_coverage_join", "predicted", sql=_COVERAGE)
def _(t):
    return score.coverage_join(_partial(t), t.gold)


@query("J01_coverage_gaps", "predicted", sql=f"""
    SELECT * FROM ({_COVERAGE}) WHERE coverage <> 'covered'""")
def _(t):
    return score.coverage_gaps(_partial(t), t.gold)


@query("U02_coverage_diff", "predicted", sql=f"""WITH {_PARTIAL}
    SELECT challenge_id, 'missing' AS side FROM (SELECT challenge_id FROM gold
        EXCEPT SELECT challenge_id FROM p)
    UNION ALL SELECT challenge_id, 'unknown' FROM (SELECT challenge_id FROM p
        EXCEPT SELECT challenge_id FROM gold)""")
def _(t):
    from veriledge.operators.tables import coverage_diff

    return coverage_diff(t.gold, _partial(t), "challenge_id")


_KEYS = """
    gk AS (SELECT DISTINCT challenge_id, lower({trim}(doc_id)) AS doc, relation,
        page_no IS NULL AS off, COALESCE(page_no, locator_offset) AS pos, content_sha256 AS sha
        FROM gold_evidence WHERE oracle_scope = 'available_by_cutoff'),
    pk AS (SELECT DISTINCT challenge_id, method_id, lower({trim}(doc_id)) AS doc, relation,
        page_no IS NULL AS off, COALESCE(page_no, locator_offset) AS pos, content_sha256 AS sha
        FROM predicted_evidence),
    mk AS (SELECT p.challenge_id, p.method_id, p.relation FROM pk p JOIN gk g
        ON g.challenge_id = p.challenge_id AND g.doc = p.doc AND g.relation = p.relation
        AND g.off = p.off AND g.pos = p.pos AND g.sha = p.sha),
    counts AS (SELECT p.challenge_id, p.method_id,
        COALESCE(a.n, 0) AS predicted_evidence, COALESCE(b.n, 0) AS matched_evidence,
        COALESCE(a.c, 0) AS predicted_counter, COALESCE(b.c, 0) AS matched_counter
        FROM predicted p
        LEFT JOIN (SELECT challenge_id, method_id, count(*) AS n, count(*) FILTER (WHERE relation
            IN ('CONTRADICTS', 'BOUNDS')) AS c FROM pk GROUP BY 1, 2) a
            ON a.challenge_id = p.challenge_id AND a.method_id = p.method_id
        LEFT JOIN (SELECT challenge_id, method_id, count(*) AS n, count(*) FILTER (WHERE relation
            IN ('CONTRADICTS', 'BOUNDS')) AS c FROM mk GROUP BY 1, 2) b
            ON b.challenge_id = p.challenge_id AND b.method_id = p.method_id)"""
_TRIM = _KEYS.format(trim="trim")


@query("J02_evidence_match", *BOTH, sql=f"""WITH {_TRIM}
    SELECT 'run:' || method_id AS run_id, method_id, challenge_id,
        CAST(predicted_evidence AS INTEGER) AS predicted_evidence,
        CAST(matched_evidence AS INTEGER) AS matched_evidence,
        CAST(predicted_counter AS INTEGER) AS predicted_counter,
        CAST(matched_counter AS INTEGER) AS matched_counter FROM counts""")
def _(t):
    return score.evidence_match(t.predictions(), t.challenges())


@query("U03_evidence_intersect", *BOTH, sql=f"""WITH {_TRIM}
    SELECT challenge_id, method_id, CAST(matched_evidence AS INTEGER) AS matched FROM counts""")
def _(t):
    from veriledge.operators.tables import evidence_intersect

    gold = score.gold_evidence(t.challenges()).groupBy("challenge_id").agg(F.collect_set(
        F.struct("doc_id", "relation", "locator_kind", "position", "content_sha256"))
        .alias("gold"))
    mine = t.predictions().select("challenge_id", "method_id", F.transform(
        "evidence", lambda e: fn.evidence_key(e)).alias("mine"))
    joined = mine.join(gold, "challenge_id", "left")
    return joined.select("challenge_id", "method_id", F.coalesce(F.size(evidence_intersect(
        "mine", "gold")), F.lit(0)).alias("matched"))


_ITEMS = f"""{_TRIM},
    items AS (SELECT 'run:' || p.method_id AS run_id, p.method_id, p.challenge_id,
        g.task_family, g.leakage_group, p.status = 'completed' AS completed,
        p.calls > {MAX_CALLS} OR p.tokens > {MAX_TOKENS} AS over_budget,
        CASE WHEN g.counterevidence_exists THEN 1 ELSE 0 END AS counterevidence_label,
        CASE WHEN g.counterevidence_exists THEN matched_counter > 0 ELSE predicted_counter > 0
            END AS counterevidence_detected,
        g.counterevidence_exists AND matched_counter > 0 AND p.status = 'completed'
            AND p.calls <= {MAX_CALLS} AND p.tokens <= {MAX_TOKENS} AS true_positive,
        NOT g.counterevidence_exists AND predicted_counter > 0 AS false_positive,
        p.predicted_decision = g.expected_decision AND p.status = 'completed'
            AND p.calls <= {MAX_CALLS} AND p.tokens <= {MAX_TOKENS} AS decision_correct,
        predicted_evidence, matched_evidence,
        CASE WHEN predicted_evidence > 0 THEN matched_evidence / predicted_evidence ELSE 1 END
            AS replay_precision,
        p.counterevidence_probability AS probability,
        pow(p.counterevidence_probability - CASE WHEN g.counterevidence_exists THEN 1 ELSE 0 END,
            2) AS brier, p.calls, p.tokens
        FROM predicted p JOIN gold g ON g.challenge_id = p.challenge_id
        JOIN counts c ON c.challenge_id = p.challenge_id AND c.method_id = p.method_id)"""


def scored(t):
    return score.score_items(t.predictions(), t.challenges(), MAX_CALLS, MAX_TOKENS)


@query("A01_score_items", *BOTH, sql=f"""WITH {_ITEMS}
    SELECT challenge_id, method_id, completed, over_budget, counterevidence_label,
        counterevidence_detected, true_positive, false_positive, decision_correct,
        round(replay_precision, 6) AS replay_precision, round(brier, 6) AS brier FROM items""")
def _(t):
    return scored(t).select(
        "challenge_id", "method_id", "completed", "over_budget", "counterevidence_label",
        "counterevidence_detected", "true_positive", "false_positive", "decision_correct",
        F.round("replay_precision", 6).alias("replay_precision"),
        F.round("brier", 6).alias("brier"))


_ECE = """bins AS (SELECT run_id, method_id, least(9, CASE WHEN probability >= 0.9 THEN 9
        WHEN probability >= 0.8 THEN 8 WHEN probability >= 0.7 THEN 7 WHEN probability >= 0.6
        THEN 6 WHEN probability >= 0.5 THEN 5 WHEN probability >= 0.4 THEN 4 WHEN probability
        >= 0.3 THEN 3 WHEN probability >= 0.2 THEN 2 WHEN probability >= 0.1 THEN 1 ELSE 0 END)
        AS bin, count(*) AS n, sum(probability) AS p, sum(counterevidence_label) AS y FROM items
        GROUP BY 1, 2, 3),
    ece AS (SELECT run_id, method_id, sum(abs(y - p)) / sum(n) AS ece_10 FROM bins
        GROUP BY 1, 2)"""


@query("A03_ece", *BOTH, sql=f"""WITH {_ITEMS}, {_ECE}
    SELECT method_id, round(ece_10, 6) AS ece_10 FROM ece""")
def _(t):
    return score.ece(scored(t), ["method_id"]).select("method_id",
                                                      F.round("ece_10", 6).alias("ece_10"))


_SUMMARY = f"""WITH {_ITEMS}, {_ECE}
    SELECT i.run_id, i.method_id, count(*) AS n,
        round(avg(CASE WHEN completed THEN 1 ELSE 0 END), 6) AS completed_rate,
        round(1 - avg(CASE WHEN over_budget THEN 1 ELSE 0 END), 6) AS budget_compliance_rate,
        round(avg(CASE WHEN counterevidence_label = 1 THEN CASE WHEN true_positive THEN 1 ELSE 0
            END END), 6) AS counterevidence_recall,
        round(avg(CASE WHEN counterevidence_label = 0 THEN CASE WHEN false_positive THEN 1 ELSE 0
            END END), 6) AS counterevidence_false_positive_rate,
        round(avg(CASE WHEN decision_correct THEN 1 ELSE 0 END), 6) AS decision_accuracy,
        round(sum(matched_evidence) / sum(predicted_evidence), 6) AS evidence_replay_precision,
        round(avg(brier), 6) AS brier_score, CAST(sum(calls) AS BIGINT) AS total_calls,
        CAST(sum(tokens) AS BIGINT) AS total_tokens, round(max(ece_10), 6) AS ece_10
    FROM items i JOIN ece e ON e.run_id = i.run_id AND e.method_id = i.method_id
    GROUP BY 1, 2"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c)
                       for c in df.columns])


@query("A02_score_summary", *BOTH, sql=_SUMMARY)
def _(t):
    return _rounded(score.score_summary(scored(t)))


def _of_run(sql: str) -> str:
    """The same summary over one run: tables ``asked`` and ``run`` in place of all."""
    sql = re.sub(r"\b(FROM|JOIN) predicted\b", r"\1 run", sql)
    return re.sub(r"\b(FROM|JOIN) gold\b", r"\1 asked", sql)


@query("C03_evaluate_predictions", *BOTH, sql=f"""
    WITH asked AS (SELECT * FROM gold WHERE challenge_id IN (
        SELECT challenge_id FROM ({_CHALLENGE_CODES}) WHERE codes = '')),
    run AS (SELECT p.* FROM predicted p JOIN asked a ON a.challenge_id = p.challenge_id
        WHERE p.method_id = 'alpha'), {_of_run(_SUMMARY).removeprefix('WITH ')}""")
def _(t):
    """One method's run over the valid challenges, with its commitments in two ledgers."""
    clean, _ = split_valid(rows.validate_challenges(t.challenges()))
    number = F.expr("cast(substr(challenge_id, 2) as bigint)")
    asked = materialise(clean)
    made = (t.predictions().where("method_id = 'alpha'")
            .join(asked.select("challenge_id"), "challenge_id", "left_semi")
            .withColumn("prediction_commitment_sha256", fn.prediction_commitment())
            .withColumn("tenant_id", F.lit("bench"))
            .withColumn("job_id", F.concat(F.lit("alpha-"), (number % 2).cast("string"))))
    payload = F.to_json(F.to_variant_object(F.struct(
        "challenge_id", "run_id", "method_id", "prediction_commitment_sha256")))
    events = made.select(
        "tenant_id", "job_id", F.concat(F.lit("p-"), "challenge_id").alias("event_id"),
        F.lit("2024-01-01T00:00:00+00:00").alias("occurred_at"),
        F.lit("benchmark_prediction").alias("aggregate_type"),
        F.col("challenge_id").alias("aggregate_id"),
        F.lit("benchmark.prediction_committed").alias("event_type"), payload.alias("payload"),
        F.concat_ws(":", "run_id", "challenge_id").alias("idempotency_key"), number.alias("n"))
    log = materialise(ledger.build_ledger(events, ["n"]).drop("violations"))
    heads = ledger.verify_chain(log).select(
        "tenant_id", "job_id", F.col("head_hash").alias("ledger_head"),
        F.col("event_count").alias("ledger_event_count"))
    named = made.join(heads, ["tenant_id", "job_id"]).withColumn(
        "ledger_relpath", F.concat_ws("/", "tenant_id", "job_id", F.lit("events.jsonl")))
    _, summary = composites.evaluate_predictions(
        asked, named.drop("tenant_id", "job_id"), log, MAX_CALLS, MAX_TOKENS)
    return _rounded(summary)


@query("A21_known_answer_credit", *BOTH, sql=f"""WITH {_KEYS.format(trim='')}
    SELECT p.challenge_id, p.method_id, 'known_answer' AS evaluator_kind,
        ok AND matched_evidence > 0 AND p.predicted_decision = g.expected_decision AS success,
        ok AND g.counterevidence_exists AND matched_counter > 0 AS false_gap_avoided,
        'sha256:feed#challenge:' || p.challenge_id AS evidence_ref
    FROM (SELECT *, status = 'completed' AND calls <= {MAX_CALLS} AND tokens <= {MAX_TOKENS}
          AS ok FROM predicted) p JOIN gold g ON g.challenge_id = p.challenge_id
    JOIN counts c ON c.challenge_id = p.challenge_id AND c.method_id = p.method_id""")
def _(t):
    return score.known_answer_credit(
        t.predictions(), t.challenges(), MAX_CALLS, MAX_TOKENS, "feed").select(
        "challenge_id", "method_id", "evaluator_kind", "success", "false_gap_avoided",
        "evidence_ref")


@query("E05_credit_evaluator", *BOTH, sql=f"""WITH {_KEYS.format(trim='')}
    SELECT p.method_id, CAST(sum(CASE WHEN status = 'completed' AND calls <= {MAX_CALLS} AND
        tokens <= {MAX_TOKENS} AND matched_evidence > 0 AND p.predicted_decision =
        g.expected_decision THEN 1 ELSE 0 END) AS BIGINT) AS successes
    FROM predicted p JOIN gold g ON g.challenge_id = p.challenge_id
    JOIN counts c ON c.challenge_id = p.challenge_id AND c.method_id = p.method_id
    GROUP BY p.method_id""")
def _(t):
    from veriledge.functions.hooks import credit_outcomes

    def evaluator(predictions, gold):
        return score.known_answer_credit(predictions, gold, MAX_CALLS, MAX_TOKENS, "feed")

    return credit_outcomes(t.predictions(), t.challenges(), evaluator).groupBy(
        "method_id").agg(F.count_if("success").alias("successes"))


@query("J03_snapshot_reference_check", *GOLD, sql="""
    SELECT e.challenge_id, e.snapshot_id, concat_ws(',',
        CASE WHEN s.snapshot_id IS NULL THEN 'missing_snapshot' END,
        CASE WHEN e.source_locator <> s.source_locator THEN 'disagrees_source_locator' END,
        CASE WHEN e.publication_date <> s.publication_date THEN 'disagrees_publication_date' END,
        CASE WHEN NOT COALESCE(e.page_no IS NULL AND e.locator_offset = 0, FALSE)
            AND s.snapshot_id IS NOT NULL THEN 'locator_not_zero' END) AS codes
    FROM gold_evidence e LEFT JOIN snapshots s ON s.snapshot_id = e.snapshot_id
    WHERE s.snapshot_id IS NULL OR e.source_locator <> s.source_locator
        OR e.publication_date <> s.publication_date
        OR NOT COALESCE(e.page_no IS NULL AND e.locator_offset = 0, FALSE)
    UNION ALL SELECT NULL, snapshot_id, 'unreferenced' FROM snapshots
    WHERE snapshot_id NOT IN (SELECT snapshot_id FROM gold_evidence)""")
def _(t):
    return score.snapshot_reference_check(t.challenges(), t.snapshots)


_DOTS = """
    SELECT 'counts' AS field, benchmark_track || ':' || split AS key, CAST(count(*) AS VARCHAR)
        AS value FROM gold GROUP BY 1, 2
    UNION ALL SELECT 'curation_statuses', CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'frozen'
        END, CAST(count(*) AS VARCHAR) FROM gold GROUP BY 1, 2
    UNION ALL SELECT 'challenges', '', CAST(count(*) AS VARCHAR) FROM gold
    UNION ALL SELECT 'leakage_groups', '', CAST(count(DISTINCT leakage_group) AS VARCHAR)
        FROM gold
    UNION ALL SELECT 'publication_ready', '', CAST(bool_and(doc_id % 3 <> 0) AS VARCHAR)
        FROM gold
    UNION ALL SELECT 'snapshots', '', CAST(count(DISTINCT snapshot_id) AS VARCHAR)
        FROM snapshots
    UNION ALL SELECT 'referenced_snapshots', '', CAST(count(DISTINCT snapshot_id) AS VARCHAR)
        FROM gold_evidence"""


@query("A04_seal_benchmark", *GOLD, sql=_DOTS)
def _(t):
    return score.seal_benchmark(t.challenges(), t.snapshots)


def fold_sql(lines: str, source: str) -> str:
    """The three-level dataset digest of a line expression."""
    return f"""(WITH l0 AS (SELECT sha256({lines}) AS g, count(*) AS n FROM {source} GROUP BY 1),
    l1 AS (SELECT substr(g, 1, 6) AS g, sha256(string_agg(g || ':' || n, chr(10)
           ORDER BY g || ':' || n)) AS d FROM l0 GROUP BY 1),
    l2 AS (SELECT substr(g, 1, 3) AS g, sha256(string_agg(g || ':' || d, chr(10)
           ORDER BY g || ':' || d)) AS d FROM l1 GROUP BY 1)
    SELECT sha256(string_agg(g || ':' || d, chr(10) ORDER BY g || ':' || d)) FROM l2)"""


@query("A04_sealed_benchmark", *GOLD, "snapshots", sql=f"""
    WITH used AS (SELECT * FROM snapshots WHERE snapshot_id IN (
        SELECT snapshot_id FROM ({_SNAPSHOT_CODES}) WHERE codes = '')),
    one AS (SELECT challenge_id FROM gold_evidence GROUP BY challenge_id
        HAVING bool_and(page_no IS NULL AND locator_offset = 0
            AND snapshot_id IN (SELECT snapshot_id FROM used))),
    kept AS (SELECT * FROM gold WHERE challenge_id IN (SELECT challenge_id FROM one)
        AND challenge_id IN (SELECT challenge_id FROM ({_CHALLENGE_CODES}) WHERE codes = '')),
    refs AS (SELECT * FROM gold_evidence WHERE challenge_id IN (SELECT challenge_id FROM kept)),
    sealed AS (SELECT * FROM used WHERE snapshot_id IN (SELECT snapshot_id FROM refs)),
    cl AS (SELECT CAST(to_json({{'accepted_evidence': [{{'content_sha256': e.content_sha256,
        'doc_id': e.doc_id, 'doi': e.doi, 'evidence_id': e.evidence_id,
        'license_spdx': e.license_spdx,
        'locator': {{'offset': e.locator_offset, 'page_no': e.page_no}},
        'oracle_scope': e.oracle_scope, 'publication_date': e.publication_date,
        'relation': e.relation, 'snapshot_id': e.snapshot_id,
        'source_locator': e.source_locator, 'source_url': e.source_url}}],
        'benchmark_track': benchmark_track, 'challenge_id': k.challenge_id,
        'construction_provenance': {{'curator': 'curator', 'source': source, 'status':
            CASE WHEN k.doc_id % 3 = 0 THEN 'draft' ELSE 'frozen' END}},
        'counterevidence_exists': counterevidence_exists, 'cutoff_date': cutoff_date,
        'expected_decision': expected_decision, 'leakage_group': leakage_group,
        'prompt': prompt, 'schema_version': schema_version, 'split': split,
        'task_family': task_family}}) AS VARCHAR) AS line
        FROM kept k JOIN refs e ON e.challenge_id = k.challenge_id),
    sl AS (SELECT CAST(to_json({{'attribution': attribution, 'content': content,
        'content_sha256': content_sha256, 'doi': doi, 'license_spdx': license_spdx,
        'normalization': normalization, 'publication_date': publication_date,
        'retrieved_at': retrieved_at, 'schema_version': schema_version,
        'snapshot_id': snapshot_id, 'source_locator': source_locator,
        'source_url': source_url}}) AS VARCHAR) AS line FROM sealed)
    SELECT 'counts' AS field, benchmark_track || ':' || split AS key, CAST(count(*) AS VARCHAR)
        AS value FROM kept GROUP BY 1, 2
    UNION ALL SELECT 'curation_statuses', CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'frozen'
        END, CAST(count(*) AS VARCHAR) FROM kept GROUP BY 1, 2
    UNION ALL SELECT 'challenges', '', CAST(count(*) AS VARCHAR) FROM kept
    UNION ALL SELECT 'leakage_groups', '', CAST(count(DISTINCT leakage_group) AS VARCHAR)
        FROM kept
    UNION ALL SELECT 'publication_ready', '', CAST(bool_and(doc_id % 3 <> 0) AS VARCHAR)
        FROM kept
    UNION ALL SELECT 'snapshots', '', CAST(count(*) AS VARCHAR) FROM sealed
    UNION ALL SELECT 'referenced_snapshots', '', CAST(count(*) AS VARCHAR) FROM sealed
    UNION ALL SELECT 'schema_version', '', '1'
    UNION ALL SELECT 'challenge_sha256', '', {fold_sql('line', 'cl')}
    UNION ALL SELECT 'evidence_snapshot_sha256', '', {fold_sql('line', 'sl')}""")
def _(t):
    """The challenges without findings and the snapshots that they refer to, sealed."""
    clean, _ = split_valid(rows.validate_challenges(t.challenges()))
    good, _ = split_valid(rows.validate_snapshots(t.snapshots.select(*S.SNAPSHOT.fieldNames())))
    found = score.snapshot_reference_check(clean, good).select("challenge_id").distinct()
    sealed = materialise(clean.join(found, "challenge_id", "left_anti").select(
        *S.CHALLENGE.fieldNames()))
    refs = sealed.select(F.explode("accepted_evidence.snapshot_id").alias("snapshot_id"))
    return composites.sealed_benchmark(sealed, materialise(good.join(
        refs.distinct(), "snapshot_id", "left_semi").select(*good.columns)))


@query("C01_blind_bundle", *GOLD, sql=f"""
    WITH kept AS (SELECT * FROM gold WHERE challenge_id IN (
        SELECT challenge_id FROM ({_CHALLENGE_CODES}) WHERE codes = ''))
    SELECT {fold_sql('challenge_id', 'kept')} AS challenge_ids_sha256,
        (SELECT count(*) FROM kept) AS tasks""")
def _(t):
    """The challenges without violations go through both contracts of the bundle."""
    clean, _ = split_valid(rows.validate_challenges(t.challenges()))
    return composites.blind_bundle(materialise(clean)).select("challenge_ids_sha256", "tasks")


@query("C02_verify_blind_bundle", "gold", sql="""
    SELECT c.kase, c.kase = 'same' OR c.n = 0 AS digest_ok, c.kase <> 'dropped' OR c.n = 0
        AS count_ok, CAST(0 AS BIGINT) AS contract_violations
    FROM (SELECT 'same' AS kase, count(*) AS n FROM gold WHERE FALSE
        UNION ALL SELECT 'changed', count(*) FROM gold WHERE doc_id % 5 = 0
        UNION ALL SELECT 'dropped', count(*) FROM gold WHERE doc_id % 5 = 0) c""")
def _(t):
    """A bundle as it was sealed, one with changed prompts, one with tasks left out."""
    tasks = rows.blind_project(t.gold)
    manifest = composites.bundle_manifest(tasks)
    fifth = F.expr("cast(substr(challenge_id, 2) as bigint) % 5 = 0")
    bundles = {"same": tasks,
               "changed": tasks.withColumn("prompt", F.when(fifth, F.concat("prompt", F.lit(" now")))
                                           .otherwise(F.col("prompt"))),
               "dropped": tasks.where(~fifth)}
    found = [composites.verify_blind_bundle(b, manifest).select(F.lit(name).alias("kase"), "*")
             for name, b in bundles.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("C11_failed_prediction_rows", *BOTH, sql="""
    SELECT challenge_id, method_id, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE status END
        AS status, CASE WHEN doc_id % 4 = 0 THEN 'UNRESOLVED' ELSE predicted_decision END
        AS predicted_decision,
        CASE WHEN doc_id % 4 = 0 THEN sha256('{"calls":' || calls || ',"challenge_id":"'
            || challenge_id || '","counterevidence_probability":0.5,"evidence":[],"method_id":"'
            || method_id || '","predicted_decision":"UNRESOLVED","run_id":"r:' || method_id
            || '","schema_version":1,"status":"failed","tokens":' || tokens || '}')
            ELSE '' END AS commitment
    FROM predicted WHERE doc_id % 4 <> 1""")
def _(t):
    i = F.expr("cast(substr(challenge_id, 2) as bigint)")
    p = t.predictions()
    jobs = p.select(
        "challenge_id", "method_id", F.when(i % 4 == 0, "FAILED").when(i % 4 == 1, "RUNNING")
        .otherwise("SUCCEEDED").alias("status"), F.col("calls").alias("used_calls"),
        F.col("tokens").alias("used_tokens"))
    done = p.withColumn("prediction_commitment_sha256", F.lit(""))
    out = composites.failed_prediction_rows(t.gold, jobs, done, "r")
    return out.select("challenge_id", "method_id", "status", "predicted_decision",
                      F.col("prediction_commitment_sha256").alias("commitment"))


# --- statistics ------------------------------------------------------------------------------

@query("J05_paired_methods", *BOTH, sql=f"""WITH {_ITEMS}
    SELECT r.challenge_id, m.method_id AS treatment, CASE WHEN t.challenge_id IS NULL
        THEN 'missing_treatment_row' ELSE '' END AS codes
    FROM items r CROSS JOIN (SELECT 'beta' AS method_id UNION ALL SELECT 'gamma') m
    LEFT JOIN items t ON t.challenge_id = r.challenge_id AND t.method_id = m.method_id
        AND NOT (t.method_id = 'beta' AND t.calls % 10 = 0)
    WHERE r.method_id = 'alpha'""")
def _(t):
    s = scored(t).where(~((F.col("method_id") == "beta") & (F.col("calls") % 10 == 0)))
    return stats.paired_methods(s, "alpha").select(
        "challenge_id", "treatment", violation_codes().alias("codes"))


_CLUSTERS = f"""{_ITEMS},
    long AS (SELECT challenge_id, method_id, leakage_group, metric, value FROM (
        SELECT challenge_id, method_id, leakage_group,
            unnest(['decision_accuracy', 'counterevidence_recall',
                'counterevidence_false_positive_rate', 'evidence_replay_precision',
                'brier_score', 'completed_rate', 'budget_compliance_rate']) AS metric,
            unnest([CASE WHEN decision_correct THEN 1e0 ELSE 0e0 END,
                CASE WHEN counterevidence_label = 1 THEN CASE WHEN true_positive THEN 1e0 ELSE
                    0e0 END END,
                CASE WHEN counterevidence_label = 0 THEN CASE WHEN false_positive THEN 1e0 ELSE
                    0e0 END END,
                replay_precision, brier, CASE WHEN completed THEN 1e0 ELSE 0e0 END,
                CASE WHEN over_budget THEN 0e0 ELSE 1e0 END]) AS value FROM items)
        WHERE value IS NOT NULL),
    clusters AS (SELECT t.method_id AS treatment, t.metric, t.leakage_group,
        avg(t.value - r.value) AS difference, count(*) AS observations
        FROM long t JOIN long r ON r.challenge_id = t.challenge_id AND r.metric = t.metric
            AND r.method_id = 'alpha' WHERE t.method_id <> 'alpha' GROUP BY 1, 2, 3),
    arrays AS (SELECT treatment, metric, list(difference ORDER BY leakage_group) AS d,
        count(*) AS k, abs(avg(difference)) AS observed,
        list_position(['decision_accuracy', 'counterevidence_recall',
            'counterevidence_false_positive_rate', 'evidence_replay_precision', 'brier_score',
            'completed_rate', 'budget_compliance_rate'], metric) - 1 AS mi
        FROM clusters GROUP BY 1, 2)"""


def clusters(t):
    return materialise(stats.cluster_effects(scored(t), "alpha"))


@query("A14_cluster_effects", *BOTH, sql=f"""WITH {_CLUSTERS}
    SELECT treatment, metric, leakage_group, round(difference + 1e-9, 6) AS difference, observations
    FROM clusters""")
def _(t):
    return clusters(t).select("treatment", "metric", "leakage_group",
                              F.round(F.col("difference") + 1e-9, 6).alias("difference"),
                              "observations")


@query("E01_metric_spec", *BOTH, sql=f"""WITH {_ITEMS}
    SELECT t.method_id AS treatment, 'cheap' AS metric, round(avg(CASE WHEN t.calls < 10 THEN 1e0
        ELSE 0e0 END - CASE WHEN r.calls < 10 THEN 1e0 ELSE 0e0 END), 6) AS mean_difference
    FROM items t JOIN items r ON r.challenge_id = t.challenge_id AND r.method_id = 'alpha'
    WHERE t.method_id <> 'alpha' AND t.completed AND r.completed GROUP BY 1""")
def _(t):
    from veriledge.functions.hooks import MetricSpec

    spec = MetricSpec("cheap", (F.col("calls") < 10).cast("double"), F.col("completed"))
    c = stats.cluster_effects(scored(t), "alpha", (spec,))
    return c.groupBy("treatment", "metric").agg(F.round(F.sum(
        F.col("difference") * F.col("observations")) / F.sum("observations"), 6)
        .alias("mean_difference"))


def _draw(factor: int, i: str, j: str) -> str:
    return (f"CAST('0x' || substr(md5((20260812 + mi * {factor}) || '|' || metric || '|' || {i} "
            f"|| '|' || {j}), 1, 8) AS BIGINT)")


@query("A15_cluster_bootstrap_ci", *BOTH, sql=f"""WITH {_CLUSTERS},
    samples AS (SELECT treatment, metric, i, avg(d[CAST({_draw(1009, 'i', 'j')} % k AS INTEGER)
        + 1]) AS sample FROM arrays, range(10000) x(i), range(100) y(j) WHERE j < k
        GROUP BY 1, 2, 3)
    SELECT treatment, metric, round(quantile_cont(sample, 0.025), 6) AS ci_low,
        round(quantile_cont(sample, 0.975), 6) AS ci_high FROM samples GROUP BY 1, 2""")
def _(t):
    return stats.cluster_bootstrap_ci(clusters(t)).select(
        "treatment", "metric", F.round("ci_low", 6).alias("ci_low"),
        F.round("ci_high", 6).alias("ci_high"))


@query("A16_sign_flip_exact", *BOTH, sql=f"""WITH {_CLUSTERS},
    sums AS (SELECT treatment, metric, m, k, observed, sum(CASE WHEN (m >> CAST(j AS INTEGER)) & 1
        = 1 THEN d[CAST(j AS INTEGER) + 1] ELSE -d[CAST(j AS INTEGER) + 1] END) AS s
        FROM arrays, range(65536) x(m), range(20) y(j)
        WHERE j < k AND m < pow(2, k) GROUP BY 1, 2, 3, 4, 5)
    SELECT treatment, metric, round(avg(CASE WHEN abs(s / k) >= observed - 1e-12 THEN 1e0 ELSE
        0e0 END), 6) AS p_value_raw, count(*) AS permutations FROM sums GROUP BY 1, 2""")
def _(t):
    return stats.sign_flip_exact(clusters(t)).select(
        "treatment", "metric", F.round("p_value_raw", 6).alias("p_value_raw"), "permutations")


@query("A17_sign_flip_monte_carlo", *BOTH, sql=f"""WITH {_CLUSTERS},
    samples AS (SELECT treatment, metric, i, any_value(observed) AS observed, avg(
        d[CAST(j AS INTEGER) + 1] * ({_draw(2027, 'i', 'j')} % 2 * 2 - 1)) AS sample
        FROM arrays, range(10000) x(i), range(100) y(j) WHERE j < k AND k > 5 GROUP BY 1, 2, 3)
    SELECT treatment, metric, round((count(*) FILTER (WHERE abs(sample) >= observed - 1e-12)
        + 1) / 10001, 6) AS p_value_raw FROM samples GROUP BY 1, 2""")
def _(t):
    return stats.sign_flip_monte_carlo(clusters(t), above=5).select(
        "treatment", "metric", F.round("p_value_raw", 6).alias("p_value_raw"))


@query("A18_quantile", sql="""
    SELECT l_suppkey, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.025), 6) AS q_low,
        round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.975), 6) AS q_high
    FROM lineitem GROUP BY l_suppkey""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(stats.quantile("l_extendedprice", 0.025), 6).alias("q_low"),
        F.round(stats.quantile("l_extendedprice", 0.975), 6).alias("q_high"))


@query("A19_holm", sql="""
    WITH p AS (SELECT l_suppkey, l_linenumber, round(avg(l_discount) / 2e0, 6) AS p
        FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_suppkey) AS m
        FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY p, l_linenumber))
    SELECT l_suppkey, l_linenumber, round(max(least(1.0, (m - rn + 1) * p)) OVER (PARTITION BY
        l_suppkey ORDER BY p, l_linenumber ROWS UNBOUNDED PRECEDING), 6) AS p_value_holm
    FROM r""")
def _(t):
    p = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(
        F.round(F.avg("l_discount") / 2, 6).alias("p_value_raw"))
    return stats.holm(p, ["l_suppkey"], order="l_linenumber").select(
        "l_suppkey", "l_linenumber", F.round("p_value_holm", 6).alias("p_value_holm"))


@query("A20_compare_methods", *BOTH, sql=f"""WITH {_CLUSTERS},
    sums AS (SELECT treatment, metric, mi, m, k, observed, sum(CASE WHEN (m >> CAST(j AS INTEGER))
        & 1 = 1 THEN d[CAST(j AS INTEGER) + 1] ELSE -d[CAST(j AS INTEGER) + 1] END) AS s
        FROM arrays, range(65536) x(m), range(20) y(j)
        WHERE j < k AND m < pow(2, k) GROUP BY 1, 2, 3, 4, 5, 6),
    p AS (SELECT treatment, metric, mi, k, avg(CASE WHEN abs(s / k) >= observed - 1e-12 THEN 1e0
        ELSE 0e0 END) AS p FROM sums GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY p, mi) AS rn,
        count(*) OVER (PARTITION BY treatment) AS n FROM p),
    e AS (SELECT treatment, metric, avg(difference) AS effect, CAST(sum(observations) AS BIGINT)
        AS observations FROM clusters GROUP BY 1, 2)
    SELECT r.treatment, r.metric, round(effect, 6) AS effect, round(p, 6) AS p_value_raw,
        round(max(least(1.0, (n - rn + 1) * p)) OVER (PARTITION BY r.treatment ORDER BY p, mi
            ROWS UNBOUNDED PRECEDING), 6) AS p_value_holm, k AS clusters, observations
    FROM r JOIN e ON e.treatment = r.treatment AND e.metric = r.metric""")
def _(t):
    c = stats.compare_methods(scored(t), "alpha")
    return c.select("treatment", "metric", *[F.round(n, 6).alias(n) for n in (
        "effect", "p_value_raw", "p_value_holm")], "clusters", "observations")


# --- drift -----------------------------------------------------------------------------------

_PAIRS = "snapshots s FULL OUTER JOIN observations o ON o.snapshot_id = s.snapshot_id"
_OBS_CODES = """concat_ws(',', CASE WHEN o.snapshot_id IS NULL THEN 'missing_observation' END,
    CASE WHEN s.snapshot_id IS NULL THEN 'unexpected_observation' END,
    CASE WHEN s.snapshot_id IS NOT NULL AND o.observed_at LIKE '2023%' AND s.retrieved_at LIKE
        '%Z' THEN 'not_after_sealing' END,
    CASE WHEN s.snapshot_id IS NOT NULL AND o.method = 'rumour' THEN 'retrieval_method' END,
    CASE WHEN s.snapshot_id IS NOT NULL AND o.status = 'available' AND o.content_sha256 <>
        sha256(o.content) THEN 'content_digest' END)"""


@query("J04_observation_pairing", "snapshots", "observations", sql=f"""
    SELECT COALESCE(s.snapshot_id, o.snapshot_id) AS snapshot_id, s.snapshot_id IS NOT NULL
        AS sealed, o.snapshot_id IS NOT NULL AS observed FROM {_PAIRS}""")
def _(t):
    return score.observation_pairing(t.snapshots, t.observed()).select(
        "snapshot_id", F.col("s").isNotNull().alias("sealed"),
        F.col("o").isNotNull().alias("observed"))


@query("P11_validate_observations", "snapshots", "observations", sql=f"""
    SELECT COALESCE(s.snapshot_id, o.snapshot_id) AS snapshot_id, {_OBS_CODES} AS codes
    FROM {_PAIRS}""")
def _(t):
    pairs = score.observation_pairing(t.snapshots, t.observed())
    return rows.validate_observations(pairs).select("snapshot_id",
                                                    violation_codes().alias("codes"))


_REPORT = f"""WITH r AS (SELECT CASE WHEN {_OBS_CODES} = '' THEN {_CLASS} END AS c,
        {_OBS_CODES} <> '' AS bad, o.independently_verified AS iv FROM {_PAIRS})
    SELECT count(*) AS snapshots, count(*) FILTER (WHERE c = 'EXACT') AS exact,
        count(*) FILTER (WHERE c = 'LOCATOR_DRIFT') AS locator_drift,
        count(*) FILTER (WHERE c = 'NORMALIZATION_DRIFT') AS normalization_drift,
        count(*) FILTER (WHERE c = 'CONTENT_DRIFT') AS content_drift,
        count(*) FILTER (WHERE c = 'UNAVAILABLE') AS unavailable,
        count(*) FILTER (WHERE bad) AS invalid,
        bool_and(COALESCE(c = 'EXACT', FALSE)) AS all_exact,
        bool_and(COALESCE(iv, FALSE)) AS all_independently_verified,
        bool_and(COALESCE(c = 'EXACT' AND iv, FALSE)) AS publication_gate_passed FROM r"""


@query("A11_drift_report", "snapshots", "observations", sql=_REPORT)
def _(t):
    return score.drift_report(score.drift_records(t.snapshots, t.observed()))


@query("C04_audit_evidence_drift", "snapshots", "observations", sql=f"""
    SELECT COALESCE(s.snapshot_id, o.snapshot_id) AS snapshot_id,
        CASE WHEN {_OBS_CODES} = '' THEN {_CLASS} END AS classification,
        s.content_sha256 AS expected_sha256, CASE WHEN o.status = 'available' THEN
        o.content_sha256 END AS observed_sha256, {_OBS_CODES} AS codes FROM {_PAIRS}""")
def _(t):
    records, _ = composites.audit_evidence_drift(t.snapshots, t.observed())
    return records.select("snapshot_id", "classification", "expected_sha256", "observed_sha256",
                          violation_codes().alias("codes"))

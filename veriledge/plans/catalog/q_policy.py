"""Strategy memory and Pareto ranking."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import hooks
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import violation_codes
from veriledge.operators import pareto, policy, rows
from veriledge.plans import composites
from veriledge.plans.catalog.q_scalars import WILSON, norm
from veriledge.plans.catalog.registry import query

STORE = ("strategies", "applications", "outcomes")
_BOUND = re.sub(r"\bn\b", "CAST(evaluations AS DOUBLE)", re.sub(r"\bs\b", "successes", WILSON))
_SCORES = f"""
    j AS (SELECT s.strategy_id, s.tenant_id, o.application_id, o.success, o.calls, o.tokens
        FROM strategies s
        LEFT JOIN applications a ON a.strategy_id = s.strategy_id
            AND a.target_task_family <> s.source_task_family
        LEFT JOIN outcomes o ON o.application_id = a.application_id),
    g AS (SELECT tenant_id, strategy_id, count(application_id) AS evaluations,
        CAST(COALESCE(sum(CASE WHEN success THEN 1 ELSE 0 END), 0) AS BIGINT) AS successes,
        COALESCE(avg(calls), 0) AS mean_calls, COALESCE(avg(tokens), 0) AS mean_tokens
        FROM j GROUP BY 1, 2),
    sc AS (SELECT g.tenant_id, g.strategy_id, s.kind, s.status, s.source_task_family,
        s.created_at, evaluations, successes,
        CASE WHEN evaluations > 0 THEN round(successes / evaluations, 6) ELSE 0 END
            AS success_rate,
        CASE WHEN evaluations > 0 THEN round({_BOUND}, 6) ELSE 0 END AS wilson_lower,
        round(mean_calls, 6) AS mean_calls, round(mean_tokens, 6) AS mean_tokens
        FROM g JOIN strategies s ON s.strategy_id = g.strategy_id)"""


def scores(t):
    return policy.strategy_scores(t.strategies, t.applications, t.outcomes)


@query("J09_strategy_outcomes", *STORE, sql=f"""WITH {_SCORES}
    SELECT strategy_id, count(*) AS joined, count(application_id) AS credited FROM j
    GROUP BY strategy_id""")
def _(t):
    j = policy.strategy_outcomes(t.strategies, t.applications, t.outcomes)
    return j.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("joined"),
                                        F.count("credited").alias("credited"))


@query("J10_credited_outcomes", *STORE, sql="""
    SELECT tenant_id, count(*) AS credited FROM applications WHERE application_id IN
        (SELECT application_id FROM outcomes) GROUP BY tenant_id""")
def _(t):
    return policy.credited_outcomes(t.applications, t.outcomes).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("credited"))


_UNSEEN = """fresh AS (SELECT s.*, f.target_task_family FROM {source} s JOIN families f
        ON f.tenant_id = s.tenant_id AND f.target_task_family <> s.source_task_family
        WHERE NOT EXISTS (SELECT 1 FROM applications p WHERE p.strategy_id = s.strategy_id
            AND p.target_task_family = f.target_task_family))"""


@query("J11_unseen_family", *STORE, "families", sql=f"""
    WITH {_UNSEEN.format(source='strategies')}
    SELECT strategy_id, count(*) AS unseen FROM fresh GROUP BY strategy_id""")
def _(t):
    return policy.unseen_counts(t.strategies, t.applications, t.families).groupBy(
        "strategy_id").agg(F.sum("unseen").alias("unseen"))


@query("A08_strategy_scores", *STORE, sql=f"""WITH {_SCORES}
    SELECT tenant_id, strategy_id, evaluations, successes, success_rate, wilson_lower,
        mean_calls, mean_tokens FROM sc""")
def _(t):
    return scores(t).select("tenant_id", "strategy_id", "evaluations", "successes",
                            "success_rate", "wilson_lower", "mean_calls", "mean_tokens")


_STATUS = """st AS (SELECT *, CASE WHEN status = 'RETIRED' THEN 'RETIRED' WHEN evaluations < 3
        THEN 'CANDIDATE' WHEN wilson_lower >= 0.2 THEN 'ACTIVE' WHEN wilson_lower < 0.05
        THEN 'SUSPENDED' ELSE 'CANDIDATE' END AS to_status FROM sc)"""


@query("W12_strategy_status", *STORE, sql=f"""WITH {_SCORES}, {_STATUS}
    SELECT strategy_id, status, to_status, status <> to_status AS changed FROM st""")
def _(t):
    return policy.strategy_status(scores(t)).select("strategy_id", "status", "to_status",
                                                    "changed")


_ACTIVE = """act AS (SELECT f.tenant_id, f.target_task_family, s.strategy_id, row_number() OVER
        (PARTITION BY f.tenant_id, f.target_task_family ORDER BY wilson_lower DESC,
         success_rate DESC, mean_calls, s.strategy_id) AS rank
        FROM sc s JOIN families f ON f.tenant_id = s.tenant_id
        AND f.target_task_family <> s.source_task_family WHERE s.status = 'ACTIVE')"""
_REPLAY = """rep AS (SELECT f.tenant_id, f.target_task_family, s.strategy_id, row_number() OVER
        (PARTITION BY f.tenant_id, f.target_task_family ORDER BY created_at DESC, s.strategy_id)
        AS rank FROM sc s JOIN families f ON f.tenant_id = s.tenant_id
        AND f.target_task_family <> s.source_task_family WHERE s.status <> 'RETIRED')"""
_CAND = f"""{_UNSEEN.format(source='sc')}, cand AS (SELECT tenant_id, target_task_family,
        strategy_id, row_number() OVER (PARTITION BY tenant_id, target_task_family
        ORDER BY evaluations, created_at, strategy_id) AS rank FROM fresh
        WHERE status = 'CANDIDATE')"""
_PICK = ("tenant_id, target_task_family, strategy_id, CAST(rank AS INTEGER) AS rank")
_PICKED = ("tenant_id", "target_task_family", "strategy_id", "rank")


@query("K03_recall_active", *STORE, "families", sql=f"""WITH {_SCORES}, {_ACTIVE}
    SELECT {_PICK} FROM act WHERE rank <= 5""")
def _(t):
    return policy.recall_active(scores(t), t.families).select(*_PICKED)


@query("K04_recall_uncredited", *STORE, "families", sql=f"""WITH {_SCORES}, {_REPLAY}
    SELECT {_PICK} FROM rep WHERE rank <= 5""")
def _(t):
    return policy.recall_uncredited(scores(t), t.families).select(*_PICKED)


@query("K05_recall_candidate", *STORE, "families", sql=f"""WITH {_SCORES}, {_CAND}
    SELECT {_PICK} FROM cand WHERE rank = 1""")
def _(t):
    return policy.recall_candidate(scores(t), t.applications, t.families).select(*_PICKED)


_SELECT = f"""{_SCORES}, {_ACTIVE}, {_REPLAY}, {_CAND},
    r2 AS (SELECT tenant_id, target_task_family, string_agg(strategy_id, ',' ORDER BY rank) AS ids
        FROM rep WHERE rank <= 2 GROUP BY 1, 2),
    chosen AS (SELECT s.tenant_id, s.run_id, s.sequence_index, CASE
        WHEN memory_mode = 'uncredited_replay' THEN COALESCE(r2.ids, '')
        WHEN memory_mode = 'none' THEN ''
        WHEN c.strategy_id IS NOT NULL AND (a.strategy_id IS NULL OR sequence_index % 3 = 0)
            THEN c.strategy_id ELSE COALESCE(a.strategy_id, '') END AS strategy_ids
        FROM steps s
        LEFT JOIN act a ON a.tenant_id = s.tenant_id AND a.target_task_family =
            s.target_task_family AND a.rank = 1
        LEFT JOIN cand c ON c.tenant_id = s.tenant_id AND c.target_task_family =
            s.target_task_family AND c.rank = 1
        LEFT JOIN r2 ON r2.tenant_id = s.tenant_id AND r2.target_task_family =
            s.target_task_family)"""


@query("K06_select_intervention", *STORE, "families", "steps", sql=f"""WITH {_SELECT}
    SELECT * FROM chosen""")
def _(t):
    return policy.select_intervention(t.steps, scores(t), t.applications).select(
        "tenant_id", "run_id", "sequence_index",
        F.array_join("strategy_ids", ",").alias("strategy_ids"))


def _bindings(t):
    return t.interventions.withColumn("strategy_ids", F.from_json("strategy_ids",
                                                                  "array<string>"))


@query("J19_plan_selection_check", "interventions", "strategies", sql="""
    WITH x AS (SELECT *, from_json(strategy_ids, '["VARCHAR"]') AS ids FROM interventions)
    SELECT sequence_index, concat_ws(',', CASE WHEN length(order_sha256) <> 64
        THEN 'order_digest' END, CASE WHEN ids[1] = ids[2] THEN 'repeated_strategy' END,
        CASE WHEN NOT EXISTS (SELECT 1 FROM strategies s WHERE s.tenant_id = x.tenant_id AND
            s.strategy_id = ids[1]) OR NOT EXISTS (SELECT 1 FROM strategies s WHERE s.tenant_id =
            x.tenant_id AND s.strategy_id = ids[2]) THEN 'unknown_strategy' END) AS codes
    FROM x""")
def _(t):
    return policy.plan_selection_check(_bindings(t), t.strategies).select(
        "sequence_index", violation_codes().alias("codes"))


@query("K11_replay_intervention", *STORE, "interventions", sql=f"""WITH {_SCORES},
    x AS (SELECT tenant_id, run_id, method_id, sequence_index, unnest([0, 1]) AS position,
        unnest(from_json(strategy_ids, '["VARCHAR"]')) AS strategy_id FROM interventions)
    SELECT x.sequence_index, CAST(x.position AS INTEGER) AS position, x.strategy_id,
        sc.evaluations, sc.wilson_lower FROM x LEFT JOIN sc ON sc.tenant_id = x.tenant_id
        AND sc.strategy_id = x.strategy_id""")
def _(t):
    return policy.replay_intervention(t.interventions, scores(t)).select(
        "sequence_index", "position", "strategy_id", "evaluations", "wilson_lower")


@query("A09_policy_audit_snapshot", *STORE, "outbox", "interventions", sql="""
    SELECT s.tenant_id, s.n AS strategies, a.n AS applications, c.n AS credited_outcomes,
        o.n AS undispatched_events, i.n AS sequence_interventions
    FROM (SELECT tenant_id, count(*) AS n FROM strategies GROUP BY 1) s
    JOIN (SELECT tenant_id, count(*) AS n FROM applications GROUP BY 1) a USING (tenant_id)
    JOIN (SELECT tenant_id, count(*) AS n FROM applications WHERE application_id IN (SELECT
        application_id FROM outcomes) GROUP BY 1) c USING (tenant_id)
    JOIN (SELECT tenant_id, count(*) AS n FROM outbox WHERE dispatched_at IS NULL GROUP BY 1) o
        USING (tenant_id)
    JOIN (SELECT tenant_id, count(*) AS n FROM interventions GROUP BY 1) i USING (tenant_id)""")
def _(t):
    return policy.policy_audit_snapshot(t.strategies, t.applications, t.outcomes, t.outbox,
                                        t.interventions)


@query("C13_propose_strategies", "strategies", sql=f"""
    WITH v AS (SELECT *, sha256(kind || '|' || {norm('pattern')}) AS k FROM strategies
        WHERE kind <> 'other_kind')
    SELECT tenant_id, k AS strategy_key, min_by(strategy_id, (created_at, strategy_id))
        AS strategy_id FROM v GROUP BY 1, 2""")
def _(t):
    p = t.strategies.drop("strategy_key").withColumnRenamed("strategy_id", "proposal_id")
    return policy.propose_strategies(p).select("tenant_id", "strategy_key", "strategy_id")


@query("P24_validate_policy_rows", *STORE, sql="""
    SELECT 'strategy' AS kind, strategy_id AS id, 'kind' AS codes FROM strategies
        WHERE kind = 'other_kind'
    UNION ALL SELECT 'application', a.application_id, CASE WHEN s.strategy_id IS NULL
        THEN 'unknown_strategy' ELSE 'retired_strategy' END FROM applications a
        LEFT JOIN strategies s ON s.strategy_id = a.strategy_id AND s.tenant_id = a.tenant_id
        WHERE s.strategy_id IS NULL OR s.status = 'RETIRED'
    UNION ALL SELECT 'outcome', application_id, concat_ws(',', CASE WHEN evaluator_kind =
        'self_rating' THEN 'evaluator_kind' END, CASE WHEN evidence_ref = ' ' THEN 'evidence_ref'
        END) FROM outcomes WHERE evaluator_kind = 'self_rating' OR evidence_ref = ' '""")
def _(t):
    def bad(df, kind, key):
        return df.where(F.size("violations") > 0).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"), violation_codes().alias("codes"))

    return bad(rows.validate_strategies(t.strategies), "strategy", "strategy_id").unionByName(
        bad(rows.validate_applications(t.applications, t.strategies), "application",
            "application_id")).unionByName(
        bad(rows.validate_outcomes(t.outcomes, t.applications), "outcome", "application_id"))


@query("C12_ordered_step", *STORE, "families", "steps", sql=f"""WITH {_SELECT}
    SELECT tenant_id, run_id, sequence_index, strategy_ids,
        CAST(CASE WHEN strategy_ids = '' THEN 0 ELSE len(string_split(strategy_ids, ',')) END
            AS BIGINT) AS applied FROM chosen""")
def _(t):
    state = {
        "strategies": t.strategies, "applications": t.applications, "outcomes": t.outcomes,
        "sequence_interventions": t.spark.createDataFrame(
            [], S.RUNTIME_TABLES["sequence_interventions"]["schema"])}
    steps = t.steps
    predictions = steps.select(
        "challenge_id", "run_id", "method_id", F.concat(F.lit("job-"), "challenge_id")
        .alias("job_id"), F.lit("q").alias("counter_query"),
        F.lit(2).cast("bigint").alias("calls"), F.lit(5).cast("bigint").alias("tokens"),
        F.lit("completed").alias("status"), F.array(F.struct(
            F.lit("boundary_probe").alias("kind"), F.col("challenge_id").alias("pattern")))
        .alias("strategy_candidates"))

    def credit(asked):
        return asked.select("*", F.lit("known_answer").alias("evaluator_kind"),
                            F.lit(True).alias("success"), F.lit(False).alias("false_gap_avoided"),
                            F.lit(0.0).alias("valid_finding_delta"),
                            F.lit("ref").alias("evidence_ref"))

    out = composites.ordered_step(steps, predictions, credit, state, 1.0)
    bound = out["sequence_interventions"]
    used = out["applications"].where(F.col("target_job_id").startswith("job-")).groupBy(
        "tenant_id", F.expr("substr(target_job_id, 5)").alias("challenge_id")).agg(
        F.count(F.lit(1)).alias("applied"))
    return bound.join(used, ["tenant_id", "challenge_id"], "left").select(
        "tenant_id", "run_id", "sequence_index", F.array_join(F.from_json(
            "strategy_ids", "array<string>"), ",").alias("strategy_ids"),
        F.coalesce("applied", F.lit(0)).alias("applied"))


# --- ranking ---------------------------------------------------------------------------------

_O = ", ".join(f"o{i}" for i in range(1, 8))
_PICKS = f"""pk AS (SELECT hypothesis_id, {_O}, iteration FROM (SELECT *, row_number() OVER (
        PARTITION BY hypothesis_id ORDER BY {', '.join(f'o{i} DESC' for i in range(1, 8))},
        iteration) AS rn FROM results) WHERE rn = 1)"""


@query("K10_pareto_revision_pick", "results", sql=f"""WITH {_PICKS}
    SELECT hypothesis_id, {_O}, iteration FROM pk""")
def _(t):
    return pareto.pareto_revision_pick(t.hypotheses()).select(
        "hypothesis_id", *[F.get("objectives", F.lit(i)).alias(f"o{i + 1}") for i in range(7)],
        "iteration")


@query("X01_pareto_front", "results", sql=f"""WITH {_PICKS}
    SELECT hypothesis_id, iteration FROM pk a WHERE NOT EXISTS (SELECT 1 FROM pk b WHERE
        {' AND '.join(f'b.o{i} >= a.o{i}' for i in range(1, 8))}
        AND ({' OR '.join(f'b.o{i} > a.o{i}' for i in range(1, 8))}))""")
def _(t):
    return pareto.pareto_front(t.hypotheses()).select("hypothesis_id", "iteration")


def _bound_hypotheses(t):
    i = F.col("p_partkey")
    text = F.array().cast("array<string>")
    objectives = F.array(*[((i * (k + 3)) % 10 / 10.0) for k in range(7)])
    return t.part.select(
        "p_partkey", F.concat(F.lit("h"), i.cast("string")).alias("hypothesis_id"),
        F.when(i % 11 == 0, " ").otherwise(F.col("p_name")).alias("claim"),
        F.when(i % 7 == 0, "").otherwise(F.col("p_type")).alias("boundary"),
        F.when(i % 13 == 0, text).when(i % 17 == 0, F.array(F.lit("d1@"))).otherwise(
            F.array(F.concat(F.lit("d@"), "p_brand"))).alias("support_evidence"),
        F.when(i % 19 == 0, text).otherwise(F.array("p_brand")).alias("counter_queries"),
        F.when(i % 23 == 0, text).otherwise(F.array("p_type")).alias("physical_checks"),
        objectives.alias("objectives"), F.col("p_brand").alias("action"),
        (F.col("p_size") / 10.0).alias("prior"), F.col("p_brand").alias("parent_id"))


_GATE = """CASE WHEN p_partkey % 11 = 0 THEN 'missing_claim' WHEN p_partkey % 7 = 0
    THEN 'missing_boundary' WHEN p_partkey % 13 = 0 THEN 'missing_support_evidence'
    WHEN p_partkey % 17 = 0 THEN 'invalid_evidence_locator' WHEN p_partkey % 19 = 0
    THEN 'counterevidence_search_not_declared' WHEN p_partkey % 23 = 0
    THEN 'physical_checks_not_declared' WHEN (p_partkey * 4) % 10 = 0
    THEN 'zero_evidence_sufficiency' WHEN (p_partkey * 8) % 10 = 0 THEN 'zero_physical_validity'
    ELSE 'accepted' END"""


@query("P18_acceptance_gate", sql=f"""
    SELECT p_partkey, {_GATE} = 'accepted' AS accepted, {_GATE} AS reason FROM part""")
def _(t):
    return _bound_hypotheses(t).select("p_partkey", pareto.acceptance_gate().alias("g")).select(
        "p_partkey", "g.*")


@query("E02_objective_evaluator", sql=f"""
    SELECT reason, count(*) AS n FROM (SELECT {_GATE} AS reason FROM part) GROUP BY reason""")
def _(t):
    scored = hooks.evaluate_objectives(
        _bound_hypotheses(t), lambda h: h, pareto.acceptance_gate)
    return scored.groupBy(F.col("gate.reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


@query("P17_validate_hypotheses", sql="""
    SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 9 = 0 THEN 'objective_range' END,
        CASE WHEN p_partkey % 10 = 0 THEN 'action' END, CASE WHEN p_partkey % 12 = 0 THEN 'prior'
        END) AS codes FROM part""")
def _(t):
    i = F.col("p_partkey")
    h = _bound_hypotheses(t).withColumn("objectives", F.when(i % 9 == 0, F.array_repeat(
        F.lit(1.5), 7)).otherwise(F.col("objectives"))).withColumn(
        "action", F.when(i % 10 == 0, " ").otherwise(F.col("action"))).withColumn(
        "prior", F.when(i % 12 == 0, F.lit(float("inf"))).otherwise(F.col("prior")))
    return rows.validate_hypotheses(h).select("p_partkey", violation_codes().alias("codes"))


@query("K08_rank_expansions", sql="""
    SELECT parent_id, hypothesis_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY
        prior DESC, action, hypothesis_id) AS INTEGER) AS rank FROM (
        SELECT p_brand AS parent_id, 'h' || (p_partkey % 40) AS hypothesis_id, p_type AS action,
            p_size / 1e1 AS prior, row_number() OVER (PARTITION BY p_brand, p_partkey % 40
            ORDER BY p_size DESC, p_type) AS rn FROM part) WHERE rn = 1""")
def _(t):
    none = F.array().cast("array<string>")
    p = t.part.select(
        F.col("p_brand").alias("parent_id"), F.concat(F.lit("h"), (F.col("p_partkey") % 40)
                                                      .cast("string")).alias("hypothesis_id"),
        F.lit("c").alias("claim"), F.lit("b").alias("boundary"), none.alias("support_evidence"),
        none.alias("counter_queries"), none.alias("physical_checks"),
        F.col("p_type").alias("action"), (F.col("p_size") / 10.0).alias("prior"))
    return pareto.rank_expansions(p).select("parent_id", "hypothesis_id", "rank")


def _search_log(t):
    return t.hypotheses().select(
        F.array(F.lit("root"), F.concat(F.lit("s"), (F.col("suppkey") % 10).cast("string")),
                F.col("hypothesis_id")).alias("path"),
        (F.col("orderkey") % 4 != 0).alias("accepted"), "objectives")


_NODES = """nodes AS (SELECT node_id, count(*) AS visits, {avgs} FROM (
        SELECT unnest(['root', 's' || (suppkey % 10), hypothesis_id]) AS node_id,
            orderkey % 4 <> 0 AS acc, * FROM results) GROUP BY node_id)""".format(avgs=", ".join(
    f"avg(CASE WHEN acc THEN o{i} ELSE 0 END) AS m{i}" for i in range(1, 8)))


@query("A23_backpropagation_stats", "results", sql=f"""WITH {_NODES}
    SELECT node_id, visits, {', '.join(f'round(m{i} + 1e-9, 6) AS {n}'
                                       for i, n in enumerate(S.OBJECTIVES, 1))} FROM nodes""")
def _(t):
    s = pareto.backpropagation_stats(_search_log(t))
    return s.select("node_id", "visits", *[F.round(F.col(n) + 1e-9, 6).alias(n)
                                           for n in S.OBJECTIVES])


@query("K09_score_children", "results", sql=f"""WITH {_NODES},
    ch AS (SELECT DISTINCT 's' || (suppkey % 10) AS parent_id, hypothesis_id AS node_id,
        (CAST(substr(hypothesis_id, 2) AS BIGINT) % 7) / 7e0 AS prior FROM results),
    sc AS (SELECT ch.parent_id, ch.node_id, ({' + '.join(f'm{i}' for i in range(1, 8))}
        - 0e0) / 7e0 + 1.25e0 * prior * sqrt(p.visits) / (1 + n.visits) AS score, prior
        FROM ch JOIN nodes n ON n.node_id = ch.node_id
        JOIN (SELECT node_id, visits FROM nodes) p ON p.node_id = ch.parent_id)
    SELECT parent_id, arg_max(node_id, (score, prior, node_id)) AS node_id,
        round(max(score), 6) AS score FROM sc GROUP BY parent_id""")
def _(t):
    children = t.hypotheses().select(
        F.concat(F.lit("s"), (F.col("suppkey") % 10).cast("string")).alias("parent_id"),
        F.col("hypothesis_id").alias("node_id"),
        ((F.expr("cast(substr(hypothesis_id, 2) as bigint)") % 7) / 7.0).alias("prior")).distinct()
    s = pareto.backpropagation_stats(_search_log(t))
    return pareto.score_children(children, s).select(
        "parent_id", "node_id", F.round("score", 6).alias("score"))


@query("F21_application_key", *STORE, sql="""
    SELECT application_id, 'application:' || application_id || ':outcome' AS outcome_key
    FROM outcomes""")
def _(t):
    return t.outcomes.select("application_id", fn.idempotency_key(
        "application", F.col("application_id"), "outcome").alias("outcome_key"))

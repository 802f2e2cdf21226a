"""One step of the ordered treatment: every table it returns, and logs that are not copied."""
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.operators import policy
from veriledge.plans import composites
from veriledge.plans.bindings import Tables


def test_a_step_scores_touched_strategies_as_a_whole_run_would(spark, folder, monkeypatch):
    t = Tables(spark, folder)
    steps = t.steps
    predictions = steps.select(
        "challenge_id", "run_id", "method_id", F.concat(F.lit("job-"), "challenge_id").alias("job_id"),
        F.lit("q").alias("counter_query"), F.lit(2).cast("bigint").alias("calls"),
        F.lit(5).cast("bigint").alias("tokens"), F.lit("completed").alias("status"),
        F.array(F.struct(F.lit("boundary_probe").alias("kind"), F.col("challenge_id").alias("pattern")))
        .alias("strategy_candidates"))

    def credit(asked):
        return asked.select("*", F.lit("known_answer").alias("evaluator_kind"), F.lit(True).alias("success"),
                            F.lit(False).alias("false_gap_avoided"), F.lit(0.0).alias("valid_finding_delta"),
                            F.lit("ref").alias("evidence_ref"))

    logs = {"applications": t.applications, "outcomes": t.outcomes}
    state = {**logs, "strategies": t.strategies, "sequence_interventions": spark.createDataFrame(
        [], S.RUNTIME_TABLES["sequence_interventions"]["schema"])}
    stored = []
    kept = composites.materialise
    monkeypatch.setattr(composites, "materialise", lambda df: stored.append(kept(df)) or stored[-1])
    out = composites.ordered_step(steps, predictions, credit, state, 1.0)
    for name, log in logs.items():
        size = log.count()
        assert out[name].count() > size
        assert all(df.count() < size for df in stored if set(df.columns) == set(log.columns))
    whole = policy.strategy_status(
        policy.strategy_scores(t.strategies, out["applications"], out["outcomes"]), 3, 0.2)
    wanted = policy.apply_statuses(t.strategies, whole, 1.0)
    old = out["strategies"].join(t.strategies, "strategy_id", "left_semi").select(*wanted.columns)
    assert old.exceptAll(wanted).isEmpty() and wanted.exceptAll(old).isEmpty()
    assert out["strategies"].count() > wanted.count()
    again = composites.ordered_step(steps, predictions, credit, out, 2.0)
    for name in out:
        assert again[name].count() == out[name].count()

"""Extension points: what a user may plug in, and the shape each plug must have."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MetricSpec:
    """A metric over scored rows, as Columns."""

    name: str
    value: Column
    applicable: Column
    higher_is_better: bool = True


def default_metrics() -> tuple[MetricSpec, ...]:
    def number(name):
        return F.col(name).cast("double")

    label = F.col("counterevidence_label").cast("boolean")
    always = F.lit(True)
    return (
        MetricSpec("decision_accuracy", number("decision_correct"), always),
        MetricSpec("counterevidence_recall", number("true_positive"), label),
        MetricSpec("counterevidence_false_positive_rate", number("false_positive"), ~label,
                   higher_is_better=False),
        MetricSpec("evidence_replay_precision", number("replay_precision"), always),
        MetricSpec("brier_score", number("brier"), always, higher_is_better=False),
        MetricSpec("completed_rate", number("completed"), always),
        MetricSpec("budget_compliance_rate", (~F.col("over_budget").cast("boolean"))
                   .cast("double"), always),
    )


# Hypotheses -> the same rows with an `objectives array<double>` column / with a gate struct.
ObjectiveEvaluator = Callable[[DataFrame], DataFrame]
AcceptanceGate = Callable[[], Column]
# Events -> (one metrics row per ledger, one row per issue).
EventValidator = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
# Queries -> passages, and (tasks x methods, passages) -> decisions.
Retriever = Callable[[DataFrame], DataFrame]
DecisionRule = Callable[[DataFrame, DataFrame], DataFrame]
# (predictions, gold) -> credit outcomes.
CreditEvaluator = Callable[[DataFrame, DataFrame], DataFrame]


def require_columns(df: DataFrame, names, what: str) -> DataFrame:
    """Check a plug's output shape before the plan goes on."""
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise TypeError(f"{what} lacks columns: {', '.join(absent)}")
    return df


def evaluate_objectives(hypotheses: DataFrame, evaluator: ObjectiveEvaluator,
                        gate: AcceptanceGate) -> DataFrame:
    """Run the plugged evaluator, then the plugged gate."""
    scored = require_columns(evaluator(hypotheses), ["hypothesis_id", "objectives"], "evaluator")
    return scored.withColumn("gate", gate())


def validate_events(events: DataFrame, validator: EventValidator) -> tuple[DataFrame, DataFrame]:
    """E03."""
    metrics, issues = validator(events)
    return (require_columns(metrics, ["tenant_id", "job_id"], "validator metrics"),
            require_columns(issues, ["tenant_id", "job_id", "issue"], "validator issues"))


def retrieve_and_decide(tasks: DataFrame, queries: DataFrame, retriever: Retriever,
                        rule: DecisionRule) -> DataFrame:
    """No gold column may reach either plug."""
    from veriledge.schemas import FORBIDDEN_GOLD_KEYS

    leaked = sorted(set(tasks.columns + queries.columns) & set(FORBIDDEN_GOLD_KEYS))
    if leaked:
        raise ValueError("gold columns reached a retriever: " + ", ".join(leaked))
    passages = require_columns(
        retriever(queries), ["query_id", "passage_id", "doc_id"], "retriever")
    return require_columns(rule(tasks, passages), ["challenge_id", "decision"], "decision rule")


def credit_outcomes(predictions: DataFrame, gold: DataFrame,
                    evaluator: CreditEvaluator) -> DataFrame:
    """E05."""
    return require_columns(
        evaluator(predictions, gold),
        ["challenge_id", "evaluator_kind", "success", "false_gap_avoided",
         "valid_finding_delta", "evidence_ref"], "credit evaluator")

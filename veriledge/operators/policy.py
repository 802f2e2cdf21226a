"""Strategy memory: delayed credit, recall and interventions, for all tenants at once."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.functions.contracts import Rule, is_blank, with_violations
from veriledge.operators.ledger import idempotent_dedup
from veriledge.session import broadcast_if_bounded, cols, materialise

STRATEGY = ["tenant_id", "strategy_id"]
# Places of a sorted candidate list that are looked through together.
_PLACES = 4_096


def strategy_outcomes(strategies: DataFrame, applications: DataFrame, outcomes: DataFrame
                      ) -> DataFrame:
    """Strategies with their cross-family applications and those applications' outcomes."""
    base = strategies.select(*STRATEGY, "source_task_family")
    used = applications.select("application_id", "strategy_id", "target_task_family")
    joined = base.join(
        used, (base["strategy_id"] == used["strategy_id"])
        & (used["target_task_family"] != base["source_task_family"]), "left"
    ).select(base["tenant_id"], base["strategy_id"], base["source_task_family"],
             used["application_id"], used["target_task_family"])
    result = outcomes.select("application_id", F.lit(True).alias("credited"), "success",
                             "calls", "tokens")
    return joined.join(result, "application_id", "left")


def credited_outcomes(applications: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Applications that already have an outcome."""
    return applications.join(outcomes.select("application_id"), "application_id", "left_semi")


def unseen_family(strategies: DataFrame, applications: DataFrame, families: DataFrame
                  ) -> DataFrame:
    """(strategy, target family) pairs of a tenant with no prior application there.

    ``families``: tenant_id, target_task_family - the task families asked about.
    """
    wanted = strategies.join(families, "tenant_id").where(
        F.col("source_task_family") != F.col("target_task_family"))
    prior = applications.select("strategy_id", "target_task_family").distinct()
    return wanted.join(prior, ["strategy_id", "target_task_family"], "left_anti")


def unseen_counts(strategies: DataFrame, applications: DataFrame, families: DataFrame
                  ) -> DataFrame:
    """J11 as numbers: (tenant_id, strategy_id, source_task_family, unseen), zeros left out.

    The families of a tenant are counted once; a strategy subtracts its own family and those it
    was applied to. Strategies never meet the families they are new to, so the work grows with
    strategies and applications. Repeated rows count as often as in ``unseen_family``.
    """
    key = [*STRATEGY, "source_task_family"]
    asked = families.where(F.col("target_task_family").isNotNull()).groupBy(*ASKED).agg(
        F.count(F.lit(1)).alias("__asked"))
    total = asked.groupBy("tenant_id").agg(F.sum("__asked").alias("__total"))
    own = strategies.where(F.col("source_task_family").isNotNull()).groupBy(*key).agg(
        F.count(F.lit(1)).alias("__rows"))
    seen = own.select(*key, F.col("source_task_family").alias("target_task_family")).union(
        own.select(*key).join(applications.select("strategy_id", "target_task_family"),
                              "strategy_id").select(*key, "target_task_family")).distinct()
    gone = seen.join(asked, ASKED).groupBy(*key).agg(F.sum("__asked").alias("__gone"))
    left = F.col("__rows") * (F.col("__total") - F.coalesce("__gone", F.lit(0)))
    counted = own.join(gone.select(*[F.col(k).alias(f"__{k}") for k in key], "__gone"), F.expr(
        " AND ".join(f"{k} <=> __{k}" for k in key)), "left")
    return (counted.join(broadcast_if_bounded(total), "tenant_id")
            .select(*key, left.alias("unseen")).where(F.col("unseen") > 0))


def strategy_scores(strategies: DataFrame, applications: DataFrame, outcomes: DataFrame
                    ) -> DataFrame:
    """A08. Applications and outcomes are combined per strategy before the strategies join, so
    a strategy with a large share of all applications is one partial sum per task."""
    family = strategies.select("strategy_id", "source_task_family")
    credited = (
        outcomes.select("application_id", "success", "calls", "tokens")
        .join(applications.select("application_id", "strategy_id", "target_task_family"),
              "application_id")
        .join(family, "strategy_id")
        .where(F.col("target_task_family") != F.col("source_task_family"))
        .groupBy("strategy_id").agg(
            F.count(F.lit(1)).alias("evaluations"),
            F.sum(F.col("success").cast("bigint")).alias("successes"),
            F.avg("calls").alias("mean_calls"), F.avg("tokens").alias("mean_tokens")))
    joined = strategies.join(credited, "strategy_id", "left").fillna(
        0, ["evaluations", "successes", "mean_calls", "mean_tokens"])
    rate = F.when(F.col("evaluations") > 0, F.round(
        F.col("successes") / F.greatest(F.col("evaluations"), F.lit(1)), 6)).otherwise(0.0)
    return joined.select(
        *STRATEGY, "kind", "pattern", "status", "source_task_family", "created_at",
        "evaluations", "successes", rate.alias("success_rate"),
        F.round(fn.wilson_lower("successes", "evaluations"), 6).alias("wilson_lower"),
        F.round("mean_calls", 6).alias("mean_calls"),
        F.round("mean_tokens", 6).alias("mean_tokens"))


def strategy_status(scores: DataFrame, min_evaluations: int = 3, activation: float = 0.2,
                    suspension: float = 0.05) -> DataFrame:
    """Target status per strategy; ``changed`` marks those that need an event."""
    if min_evaluations < 1 or not 0 <= suspension <= activation <= 1:
        raise ValueError("invalid promotion thresholds")
    target = (F.when(F.col("status") == "RETIRED", "RETIRED")
              .when(F.col("evaluations") < min_evaluations, "CANDIDATE")
              .when(F.col("wilson_lower") >= activation, "ACTIVE")
              .when(F.col("wilson_lower") < suspension, "SUSPENDED")
              .otherwise("CANDIDATE"))
    return scores.withColumn("to_status", target).withColumn(
        "changed", F.col("to_status") != F.col("status"))


def status_changes(statuses: DataFrame) -> DataFrame:
    """Outbox rows for the changed strategies."""
    digest = fn.transition_hash("strategy_id", "status", "to_status", "evaluations",
                                "successes", "wilson_lower")
    return statuses.where("changed").select(
        "tenant_id", F.lit("policy.status_changed").alias("event_type"),
        F.lit("strategy").alias("aggregate_type"), F.col("strategy_id").alias("aggregate_id"),
        F.col("status").alias("from_status"), "to_status", "evaluations", "successes",
        "wilson_lower", fn.idempotency_key("strategy", F.col("strategy_id"), "transition",
                                           digest).alias("idempotency_key"))


def apply_statuses(strategies: DataFrame, statuses: DataFrame, now: float) -> DataFrame:
    """The next version of the strategy table."""
    moved = statuses.where("changed").select(
        *STRATEGY, F.col("to_status").alias("__to"))
    return strategies.join(moved, STRATEGY, "left").select(*[
        F.coalesce("__to", "status").alias("status") if c == "status" else
        F.when(F.col("__to").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
        .alias("updated_at") if c == "updated_at" else F.col(c)
        for c in strategies.columns])


def _best(df: DataFrame, keys: list[str], order, limit: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(
        Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


ASKED = ["tenant_id", "target_task_family"]


def _asked(scores: DataFrame, families: DataFrame, order, limit: int) -> DataFrame:
    """The best ``limit`` strategies of the tenant from another family than the one asked about.

    A source family can fill at most ``limit`` places, and leaving one family out takes at most
    ``limit`` places away. So the best ``2 * limit`` of every family's best are all that any
    target family needs, and no more than those meet the families of a tenant.
    """
    short = _best(scores, ["tenant_id", "source_task_family"], order, limit).drop("rank")
    short = _best(short, ["tenant_id"], order, 2 * limit).drop("rank")
    met = short.join(families.select(*ASKED).distinct(), "tenant_id").where(
        F.col("source_task_family") != F.col("target_task_family"))
    return _best(met, ASKED, order, limit)


def recall_active(scores: DataFrame, families: DataFrame, limit: int = 5) -> DataFrame:
    """K03."""
    return _asked(scores.where(F.col("status") == "ACTIVE"), families, [
        F.desc("wilson_lower"), F.desc("success_rate"), F.asc("mean_calls"),
        F.asc("strategy_id")], limit)


def recall_uncredited(scores: DataFrame, families: DataFrame, limit: int = 5) -> DataFrame:
    """K04."""
    return _asked(scores.where(F.col("status") != "RETIRED"), families,
                  [F.desc("created_at"), F.asc("strategy_id")], limit)


def recall_candidate(scores: DataFrame, applications: DataFrame, families: DataFrame
                     ) -> DataFrame:
    """One candidate per family that was never applied there, least evaluated first.

    The candidates of a tenant have places in one sorted list. A family excludes the places of
    its own candidates and of those already applied to it; it gets the first place left. The list
    is looked through in runs of 4,096 places: full runs are passed over by their counts, and only
    the first run with a gap is sorted. No candidate meets a family that it is new to.
    """
    order = [F.asc("evaluations"), F.asc("created_at"), F.asc("strategy_id")]
    usable = scores.where((F.col("status") == "CANDIDATE")
                          & F.col("source_task_family").isNotNull())
    listed = _placed(usable, ["tenant_id"], order)
    asked = families.select(*ASKED).where(
        F.col("target_task_family").isNotNull()).distinct()
    taken = listed.select("tenant_id", F.col("source_task_family").alias("target_task_family"),
                          "__place").union(
        applications.select("strategy_id", "target_task_family").join(
            listed.select(*STRATEGY, "__place"), "strategy_id")
        .select(*ASKED, "__place")).distinct().join(asked, ASKED, "left_semi")
    first = _first_gaps(materialise(taken), asked)  # read by both of its passes
    return listed.join(first, ["tenant_id", "__place"]).select(
        *scores.columns, "target_task_family", F.lit(1).alias("rank"))


def _placed(df: DataFrame, keys: list[str], order) -> DataFrame:
    """Add ``__place``, 0 for the first row of a key. Rows are range partitioned on key and
    order, so a key with a third of the rows is numbered by a third of the tasks."""
    parts = materialise(df.repartitionByRange(*cols(keys), *order)
                        .withColumn("__p", F.spark_partition_id()))
    rows = parts.groupBy("__p", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = rows.select("__p", *keys, F.coalesce(F.sum("__n").over(
        Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*order)) - 1
    return parts.withColumn("__in", inside).join(broadcast_if_bounded(before), ["__p", *keys]).select(
        *df.columns, (F.col("__before") + F.col("__in")).alias("__place"))


def _first_gaps(taken: DataFrame, asked: DataFrame) -> DataFrame:
    """The first place from 0 that is not ``taken``, for every family ``asked`` about."""
    run = F.floor(F.col("__place") / F.lit(_PLACES)).alias("__run")
    runs = taken.groupBy(*ASKED, run).agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.row_number().over(Window.partitionBy(*ASKED).orderBy("__run")) - 1
    full = runs.where(F.col("__n") == _PLACES).select(
        *ASKED, (F.col("__run") == ahead).cast("bigint").alias("__full"))
    opened = asked.join(full.groupBy(*ASKED).agg(F.sum("__full").alias("__run")), ASKED,
                        "left").fillna(0, ["__run"])
    inside = taken.select(*ASKED, run, "__place").join(opened, [*ASKED, "__run"])
    nth = (F.col("__run") * _PLACES - 1 + F.row_number().over(
        Window.partitionBy(*ASKED).orderBy("__place")))
    led = inside.select(*ASKED, (F.col("__place") == nth).cast("bigint").alias("__led")).groupBy(
        *ASKED).agg(F.sum("__led").alias("__led"))
    return opened.join(led, ASKED, "left").select(*ASKED, (
        F.col("__run") * _PLACES + F.coalesce("__led", F.lit(0))).alias("__place"))


def select_intervention(steps: DataFrame, scores: DataFrame, applications: DataFrame,
                        exploration_period: int = 3) -> DataFrame:
    """Strategy ids for each (tenant, run, method, sequence_index) step.

    ``steps`` also carries target_task_family and memory_mode.
    """
    families = steps.select(*ASKED).distinct()
    active = recall_active(scores, families, 1).select(
        *ASKED, F.col("strategy_id").alias("__active"))
    candidate = recall_candidate(scores, applications, families).select(
        *ASKED, F.col("strategy_id").alias("__candidate"))
    replay = (recall_uncredited(scores, families, 2).groupBy(*ASKED)
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "strategy_id"))),
                               lambda x: x["strategy_id"]).alias("__replay")))
    joined = (steps.join(active, ASKED, "left").join(candidate, ASKED, "left")
              .join(replay, ASKED, "left"))
    none = F.array().cast("array<string>")
    explore = F.col("__candidate").isNotNull() & (
        F.col("__active").isNull() | (F.col("sequence_index") % exploration_period == 0))
    chosen = (F.when(F.col("memory_mode") == "uncredited_replay", F.coalesce("__replay", none))
              .when(F.col("memory_mode") == "none", none)
              .when(explore, F.array("__candidate"))
              .when(F.col("__active").isNotNull(), F.array("__active")).otherwise(none))
    return joined.select(*steps.columns, chosen.alias("strategy_ids"))


def plan_selection_check(bindings: DataFrame, strategies: DataFrame) -> DataFrame:
    """J19 with the identity rules of a binding. ``bindings``: tenant_id, run_id, method_id,
    sequence_index, challenge_id, order_sha256, memory_mode, strategy_ids array<string>."""
    key = ["tenant_id", "run_id", "method_id", "sequence_index"]
    unknown = (bindings.select(*key, F.explode("strategy_ids").alias("strategy_id"))
               .join(strategies.select(*STRATEGY), STRATEGY, "left_anti")
               .groupBy(*key).agg(F.count(F.lit(1)).alias("__unknown")))
    ids = F.col("strategy_ids")
    rules = [
        *[Rule(f"empty_{n}", is_blank(n)) for n in
          ("tenant_id", "run_id", "method_id", "challenge_id", "order_sha256", "memory_mode")],
        Rule("sequence_index", F.col("sequence_index") < 0),
        Rule("order_digest", F.length("order_sha256") != 64),
        Rule("repeated_strategy", F.size(F.array_distinct(ids)) < F.size(ids)),
        Rule("unknown_strategy", F.coalesce("__unknown", F.lit(0)) > 0,
             F.col("__unknown").cast("string")),
    ]
    return with_violations(bindings.join(unknown, key, "left"), rules).drop("__unknown")


def bind_interventions(bindings: DataFrame, strategies: DataFrame) -> DataFrame:
    """Checked and deduplicated bindings: the first binding of a step stays, another meaning of
    the same step is a conflict."""
    checked = plan_selection_check(bindings, strategies)
    mark = fn.sha256(F.concat_ws("|", "challenge_id", "order_sha256", "memory_mode",
                                 F.to_json("strategy_ids")))
    return idempotent_dedup(checked, ["tenant_id", "run_id", "method_id", "sequence_index"],
                            ["created_at"], mark)


def replay_intervention(interventions: DataFrame, scores: DataFrame) -> DataFrame:
    """Stored id lists with current scores, one row per position in stored order."""
    key = ["tenant_id", "run_id", "method_id", "sequence_index"]
    listed = interventions.select(
        *key, F.posexplode(F.from_json("strategy_ids", "array<string>"))
        .alias("position", "strategy_id"))
    return listed.join(scores, STRATEGY, "left").select(
        *key, "position", "strategy_id", "status", "evaluations", "success_rate",
        "wilson_lower")


def policy_audit_snapshot(strategies: DataFrame, applications: DataFrame, outcomes: DataFrame,
                          outbox: DataFrame, interventions: DataFrame) -> DataFrame:
    """Counters per tenant."""
    def per_tenant(df, name):
        return df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))

    parts = [
        per_tenant(strategies, "strategies"), per_tenant(applications, "applications"),
        per_tenant(credited_outcomes(applications, outcomes), "credited_outcomes"),
        per_tenant(outbox.where(F.col("dispatched_at").isNull()), "undispatched_events"),
        per_tenant(interventions, "sequence_interventions"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "tenant_id", "full_outer")
    return out.fillna(0)


def propose_strategies(proposals: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New strategies by normalised text; the first proposal in a tenant wins.

    ``proposals``: tenant_id, kind, pattern, source_job_id, source_task_family, created_at,
    proposal_id (orders equal times and becomes the id).
    """
    from veriledge.operators.rows import validate_strategies

    valid = validate_strategies(proposals).where(F.size("violations") == 0).drop("violations")
    keyed = valid.withColumn("strategy_key", fn.strategy_key())
    first = idempotent_dedup(keyed, ["tenant_id", "strategy_key"],
                             ["created_at", "proposal_id"], F.lit(0))
    if existing is not None:
        first = first.join(existing.select("tenant_id", "strategy_key"),
                           ["tenant_id", "strategy_key"], "left_anti")
    return first.select(
        F.col("proposal_id").alias("strategy_id"), "tenant_id", "strategy_key", "kind",
        "pattern", "source_job_id", "source_task_family",
        F.lit(S.STRATEGY_STATUSES[0]).alias("status"), "created_at",
        F.col("created_at").alias("updated_at"))

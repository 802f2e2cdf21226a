"""Multi-objective ranking: acceptance gate, revisions, fronts, expansion and child scores."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions import scalars as fn
from veriledge.session import materialise

# Distinct vectors of a block; a task holds two blocks.
SLICE_ROWS = 20_000
_DIGITS = 9


def acceptance_gate(objectives: str = "objectives") -> Column:
    """struct(accepted, reason) by the first rule that rejects."""
    def blank(name):
        return F.trim(F.coalesce(name, F.lit(""))) == ""

    def none(name):
        return F.coalesce(F.size(name), F.lit(0)) <= 0

    located = F.forall("support_evidence", lambda x: (F.locate("@", x) > 0) & (F.trim(
        F.substring(x, F.locate("@", x) + 1, F.length(x))) != ""))
    index = {name: i for i, name in enumerate(S.OBJECTIVES)}
    value = F.col(objectives)
    reason = (
        F.when(blank("hypothesis_id"), "missing_hypothesis_id")
        .when(blank("claim"), "missing_claim")
        .when(blank("boundary"), "missing_boundary")
        .when(none("support_evidence"), "missing_support_evidence")
        .when(~located, "invalid_evidence_locator")
        .when(none("counter_queries"), "counterevidence_search_not_declared")
        .when(none("physical_checks"), "physical_checks_not_declared")
        .when(F.get(value, F.lit(index["evidence_sufficiency"])) <= 0,
              "zero_evidence_sufficiency")
        .when(F.get(value, F.lit(index["physical_validity"])) <= 0, "zero_physical_validity")
        .otherwise("accepted"))
    return F.struct((reason == "accepted").alias("accepted"), reason.alias("reason"))


def pareto_revision_pick(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per hypothesis the lexicographically largest vector, the earliest on ties.

    A dominating vector is also the lexicographically larger one, so this equals comparing
    revisions one after the other.
    """
    names = [*(keys or []), "hypothesis_id"]
    rank = F.struct("objectives", (-F.col("iteration")).alias("earlier"))
    row = F.struct(*[F.col(c) for c in results.columns])
    return (results.groupBy(*[F.col(n).alias(f"__k_{n}") for n in names])
            .agg(F.max_by(row, rank).alias("r")).select("r.*"))


def _undominated(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Mask of ``points`` that no row of ``others`` dominates, in bounded memory."""
    keep = np.ones(len(points), dtype=bool)
    if not len(points) or not len(others):
        return keep
    step = max(1, 4_000_000 // max(1, others.size))
    for begin in range(0, len(points), step):
        block = points[begin:begin + step, None, :]
        worse = (others[None] >= block).all(axis=2) & (others[None] > block).any(axis=2)
        keep[begin:begin + step] = ~worse.any(axis=1)
    return keep


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("__v"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _local_front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop rows dominated inside their own batch; the best rows of a batch are tested first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        points = _vectors(batch)
        order = np.argsort(-points.sum(axis=1), kind="stable")
        strong = points[order[:512]]
        alive = np.flatnonzero(_undominated(points, strong))
        alive = alive[_undominated(points[alive], points[alive])]
        yield batch.take(pa.array(alive))


def _blocks_by_strength(vectors: DataFrame) -> DataFrame:
    """Distinct vectors in blocks of some SLICE_ROWS, strongest first."""
    rows = vectors.count()
    strength = F.aggregate("__v", F.lit(0.0), lambda acc, x: acc + x)
    placed = vectors.repartitionByRange(
        max(1, -(-rows // SLICE_ROWS)), F.desc(strength), F.xxhash64("__v"))
    return materialise(placed.withColumn("__b", F.spark_partition_id()))


def _pairs(blocks: DataFrame) -> DataFrame:
    """(target, source) of the blocks of which the source may dominate vectors of the target.

    A source is not weaker than its target, and none of its largest objectives is smaller than the
    target's smallest one.
    """
    size = blocks.agg(F.max(F.size("__v"))).first()[0] or 0
    corners = blocks.groupBy("__b").agg(
        F.array(*[F.max(F.get("__v", F.lit(k))) for k in range(size)]).alias("top"),
        F.array(*[F.min(F.get("__v", F.lit(k))) for k in range(size)]).alias("low"))
    corners = materialise(corners)  # one row per block
    return corners.alias("t").join(corners.alias("s"), F.expr(
        "s.__b <= t.__b AND forall(arrays_zip(s.top, t.low), x -> x.top >= x.low)")).select(
        F.col("t.__b").alias("__t"), F.col("s.__b").alias("__s"))


def _beaten(targets: pa.Table, sources: pa.Table) -> pa.Table:
    """Vectors of a target block that some vector of the source block dominates."""
    def matrix(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(
            len(column), -1)

    rows = pa.table({"__v": targets.column("t__v")})
    if not targets.num_rows or not sources.num_rows:
        return rows.slice(0, 0)
    mask = _undominated(matrix(targets.column("t__v")), matrix(sources.column("s__v")))
    return rows.filter(pa.array(~mask))


def pareto_front(results: DataFrame) -> DataFrame:
    """Hypotheses whose latest pick no other pick dominates; equal vectors all stay.

    Objectives are compared after rounding to 1e-9, which makes dominance transitive: each batch
    first drops what it dominates itself. The distinct vectors that are left lie in blocks by
    falling strength; a block meets those stronger blocks that its corners do not rule out, one
    pair of blocks per task, and only beaten vectors come out. No row passes the driver and no
    pair of rows is ever produced, also where the front is the whole table.
    """
    picks = pareto_revision_pick(results).withColumn(
        "__v", F.transform("objectives", lambda x: F.round(x, _DIGITS) + F.lit(0.0)))
    remaining = materialise(picks.mapInArrow(_local_front, picks.schema))
    blocks = _blocks_by_strength(remaining.select("__v").distinct())
    if blocks.isEmpty():
        return remaining.drop("__v")
    pairs = materialise(_pairs(blocks))

    def side(block: str, name: str) -> DataFrame:
        """Rows of every pair under names of their own."""
        return blocks.join(pairs, F.col("__b") == F.col(block)).select(
            *[F.col(c).alias(f"{name}{c}") for c in ("__t", "__s", "__v")])

    targets = side("__t", "t").groupBy("t__t", "t__s")
    sources = side("__s", "s").groupBy("s__t", "s__s")
    beaten = targets.cogroup(sources).applyInArrow(
        _beaten, blocks.select("__v").schema).distinct()
    return remaining.join(beaten, "__v", "left_anti").drop("__v")


def rank_expansions(proposals: DataFrame) -> DataFrame:
    """Proposals of a parent by falling prior, action, id; repeated contents dropped.

    ``proposals``: parent_id, action, prior and the hypothesis columns.
    """
    order = [F.desc("prior"), F.asc("action"), F.asc("hypothesis_id")]
    digest = proposals.withColumn("content_sha256", fn.hypothesis_digest())
    row = F.struct(*[F.col(c) for c in digest.columns])
    first = (digest.groupBy("parent_id", "content_sha256")
             .agg(F.min_by(row, F.struct((-F.col("prior")).alias("p"), "action",
                                         "hypothesis_id")).alias("r")).select("r.*"))
    return first.withColumn("rank", F.row_number().over(
        Window.partitionBy("parent_id").orderBy(*order)))


def backpropagation_stats(log: DataFrame) -> DataFrame:
    """Visits and mean reward per node from (path array, accepted, objectives) rows."""
    size = len(S.OBJECTIVES)
    reward = F.when(F.col("accepted"), F.col("objectives")).otherwise(
        F.array_repeat(F.lit(0.0), size))
    touched = log.select(F.explode("path").alias("node_id"), reward.alias("r"))
    sums = touched.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("visits"),
        *[F.avg(F.get("r", F.lit(i))).alias(name) for i, name in enumerate(S.OBJECTIVES)])
    return sums


def score_children(children: DataFrame, stats: DataFrame, iteration: int = 0,
                   exploration: float = 1.25) -> DataFrame:
    """The child to visit next per parent. ``children``: parent_id, node_id, prior."""
    weights = S.WEIGHT_BANK[iteration % len(S.WEIGHT_BANK)]
    total = sum(weights)
    child = stats.select("node_id", F.col("visits").alias("__n"), *S.OBJECTIVES)
    parent = stats.select(F.col("node_id").alias("parent_id"), F.col("visits").alias("__pn"))
    joined = (children.join(child, "node_id", "left").join(parent, "parent_id", "left")
              .fillna(0, ["__n", "__pn"]).fillna(0.0, list(S.OBJECTIVES)))
    exploit = sum((F.lit(w / total) * F.col(name) for w, name in zip(weights, S.OBJECTIVES)),
                  F.lit(0.0))
    explore = (F.lit(exploration) * F.col("prior")
               * F.sqrt(F.greatest(F.lit(1), F.col("__pn"))) / (F.col("__n") + 1))
    scored = joined.withColumn("score", exploit + explore)
    best = F.max_by(F.struct("node_id", "score", "prior"),
                    F.struct("score", "prior", "node_id")).alias("b")
    return scored.groupBy("parent_id").agg(best).select("parent_id", "b.*")

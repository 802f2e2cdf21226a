"""Mixing sources to target weights by pivotal dependent rounding of copy numbers."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledge.llm.common import WORD, stored, unit_hash

# Fixed values of the contract: weights of the sources in code point order, and the most copies.
WEIGHTS = (5, 2, 1)
MOST = 3
# Documents that one pairing group holds on average, and residuals that meet in the next level.
GROUP, FAN_IN = 4096, 64


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): weighted shares of all sizes under a cap per source.

    The target of a source is min(most * size, level * weight); the level fills all sizes. One row
    per source, so the ordered windows are short whatever the number of documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                         F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (rank % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = (totals.withColumn("weight", weight)
            .withColumn("cap", (F.col("source_size") * most).cast("double"))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("all", F.sum("source_size").over(everything))
            .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / F.sum("weight").over(after))
            .withColumn("place", F.row_number().over(by_ratio)))
    # The level is that of the first source, by ratio, which it leaves below its cap.
    level = F.min(F.when(F.col("ratio") >= F.col("level"),
                         F.struct("place", "level"))).over(everything)["level"]
    return full.withColumn("fill", level).select(
        "source", "source_size", "n_docs",
        F.least("cap", F.coalesce(F.col("fill") * F.col("weight"), F.col("cap"))).alias("target"))


def _pair(p1: float, w1: float, p2: float, w2: float, u: float) -> tuple[float, float]:
    """Move words between two documents until one is settled; words and expectations are kept."""
    up, down = min((1 - p1) * w1, p2 * w2), min(p1 * w1, (1 - p2) * w2)
    if u * (up + down) < down:
        a, b = p1 + up / w1, p2 - up / w2
        return (1.0, b) if up == (1 - p1) * w1 else (a, 0.0)
    a, b = p1 - down / w1, p2 + down / w2
    return (0.0, b) if down == p1 * w1 else (a, 1.0)


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    """One pass over a group: at most the returned row with 0 < p < 1 is left open."""
    # Long documents first: what is left open at the end is then short, and the sum near its target.
    rows = group.sort_values(["size", "draw", "row_key"], ascending=[False, True, True],
                             kind="stable").reset_index(drop=True)
    p, w, u = rows["p"].tolist(), rows["size"].astype(float).tolist(), rows["draw"].tolist()
    open_at = None
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if open_at is None:
            open_at = i
            continue
        p[open_at], p[i] = _pair(p[open_at], w[open_at], p[i], w[i], u[i])
        if not 0.0 < p[open_at] < 1.0:
            open_at = i if 0.0 < p[i] < 1.0 else None
    rows["p"] = p
    return rows


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 9) -> DataFrame:
    """Whole copies per document, whose words add up to the target of each source.

    Every document of a source has the same expected number of copies, target / source size. Its
    whole part is given to all; the fractions are rounded by weighted pivotal sampling: two open
    documents exchange words at random until one of them is settled, which keeps the words of the
    pair. Groups of about 4,096 documents leave one open document each, those meet 64 at a time
    on the next level, until one per source is left, which is rounded by its own draw. A hot
    source is many groups. Draws are hashes of the document, so reruns agree, whatever the
    partitions.

    Returns doc_id, size, source_size, target, taken, copies, source, row_key. Null text has
    size 0; documents without words take no part in pairing and are drawn on their own. Null
    sources form one source, after all others. Repeated rows are drawn separately where they
    meet; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_key")), "mix-sizes")
    targets = stored(source_targets(sized, weights, most), "mix-targets")
    share = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")),
                       F.lit(0.0))
    near = F.round(share, 12)
    rows = (sized.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source"))
            .select("doc_id", "d.source", "size", "source_size", "target", "row_key",
                    F.floor(near).cast("int").alias("whole"), (near - F.floor(near)).alias("p"),
                    unit_hash(seed, F.col("row_key"), F.col("doc_id")).alias("draw"),
                    F.ceil(F.col("n_docs") / GROUP).cast("long").alias("groups")))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "row_key"), F.col("groups"))
    rows = stored(rows.withColumn("bucket", bucket), "mix-rows")
    alone = rows.where("size = 0").withColumn("p", F.when(F.col("draw") < F.col("p"), 1.0).otherwise(0.0))
    most_groups = rows.agg(F.max("groups")).first()[0] or 1
    finished, level = [alone], rows.where("size > 0")
    while True:
        done = stored(level.groupBy("source", "bucket").applyInPandas(_settle, rows.schema),
                      "mix-level")
        is_open = F.expr("p > 0 and p < 1")
        finished.append(done.where(~is_open))
        last = done.where(is_open)
        if most_groups <= 1:
            break
        most_groups = -(-most_groups // FAN_IN)
        level = last.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    finished.append(last.withColumn("p", F.when(F.col("draw") < F.col("p"), 1.0).otherwise(0.0)))
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    copies = F.col("whole") + F.col("p").cast("int")
    return result.select("doc_id", "size", "source_size", "target",
                         (F.col("size") * copies).cast("long").alias("taken"),
                         copies.alias("copies"), "source", "row_key")


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it; documents without a copy go."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    # Null-free names of the source, so that window and join share one placement of the rows.
    names = [F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("no_s")]
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"),
                        F.xxhash64(F.col("doc_id").cast("long"), text).alias("k"), *names)
    # Repeated rows share a key; each takes its own number of copies.
    taken = mixed.select(F.col("row_key").alias("k"), *names, "copies").groupBy("k", "s", "no_s").agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    place = F.row_number().over(Window.partitionBy("k", "s", "no_s").orderBy("k"))
    return (keyed.withColumn("place", place).join(taken, ["k", "s", "no_s"])
            .withColumn("n", F.element_at("copies", F.col("place"))).where("n > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*"))

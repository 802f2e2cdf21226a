"""Cluster-aware paired statistics for many (reference, treatment) pairs at once.

Resampling uses counter-based draws: the index of draw ``j`` in iteration ``i`` is a hash of
(seed, metric, i, j). Clusters are kept in blocks; a multinomial split says how many draws of an
iteration a block serves, and the block adds one partial sum. Draws depend neither on partitioning
nor on each other, so a rerun gives the same interval, and there is one plan for all sizes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledge.functions.contracts import Rule, with_violations
from veriledge.functions.hooks import MetricSpec, default_metrics
from veriledge.session import BROADCAST_ROW_LIMIT, broadcast_if_bounded, materialise

PAIR = ["reference", "treatment"]
TEST = [*PAIR, "metric"]
EXACT_CLUSTERS = 20
# Clusters that a block of a test holds on average.
BLOCK_CLUSTERS = 4096


def paired_methods(scored: DataFrame, reference: str) -> DataFrame:
    """Pair every other method's rows with the reference's on the challenge id.

    Full outer, so an id one side lacks is a violation, as are differing cluster columns.
    """
    names = [c for c in scored.columns if c not in ("method_id", "run_id")]
    ref = scored.where(F.col("method_id") == reference).select(
        "challenge_id", F.struct(*names).alias("ref"))
    others = scored.where(F.col("method_id") != reference)
    treatments = others.select(F.col("method_id").alias("treatment")).distinct()
    wanted = ref.crossJoin(broadcast_if_bounded(treatments))  # one row per treatment name
    tests = others.select("challenge_id", F.col("method_id").alias("treatment"),
                          F.struct(*names).alias("test"))
    joined = wanted.join(tests, ["challenge_id", "treatment"], "full_outer")
    r, t = F.col("ref"), F.col("test")
    both = r.isNotNull() & t.isNotNull()
    rules = [
        Rule("missing_treatment_row", t.isNull()),
        Rule("missing_reference_row", r.isNull()),
        Rule("leakage_group", both & ~r["leakage_group"].eqNullSafe(t["leakage_group"])),
        Rule("task_family", both & ~r["task_family"].eqNullSafe(t["task_family"])),
        Rule("label", both & ~r["counterevidence_label"].eqNullSafe(
            t["counterevidence_label"])),
    ]
    return with_violations(joined, rules).select(
        F.lit(reference).alias("reference"), "treatment", "challenge_id", "ref", "test",
        "violations")


def _metric_values(scored: DataFrame, metrics: tuple[MetricSpec, ...], side: str) -> DataFrame:
    """Long form (challenge_id, method_id, leakage_group, metric, value) in one pass."""
    values = F.array(*[
        F.struct(F.lit(i).alias("metric_index"), F.lit(m.name).alias("metric"),
                 F.lit(m.higher_is_better).alias("higher_is_better"),
                 F.when(m.applicable, m.value).alias("value"))
        for i, m in enumerate(metrics)])
    return (scored.select("challenge_id", "method_id", "leakage_group",
                          F.inline(values))
            .where(F.col("value").isNotNull()).withColumnRenamed("value", side))


def cluster_effects(scored: DataFrame, reference: str,
                    metrics: tuple[MetricSpec, ...] | None = None) -> DataFrame:
    """Mean difference (treatment - reference) per metric and leakage group."""
    metrics = metrics or default_metrics()
    ref = _metric_values(scored.where(F.col("method_id") == reference), metrics, "ref_value")
    test = _metric_values(scored.where(F.col("method_id") != reference), metrics, "test_value")
    joined = test.join(ref.select("challenge_id", "metric", "ref_value"),
                       ["challenge_id", "metric"])
    return (joined.groupBy(F.lit(reference).alias("reference"),
                           F.col("method_id").alias("treatment"), "metric", "metric_index",
                           "higher_is_better", "leakage_group")
            .agg(F.avg(F.col("test_value") - F.col("ref_value")).alias("difference"),
                 F.count(F.lit(1)).alias("observations")))


def effects(clusters: DataFrame) -> DataFrame:
    """Mean over clusters of the cluster means."""
    return clusters.groupBy(*TEST, "metric_index", "higher_is_better").agg(
        F.avg("difference").alias("effect"), F.count(F.lit(1)).alias("clusters"),
        F.sum("observations").alias("observations"))


def quantile(value: str | Column, probability: float) -> Column:
    """Linear interpolation at ``p * (n - 1)``."""
    return F.percentile(value, F.lit(probability))


def _draw(seed: Column, metric: Column, iteration: Column, position: Column) -> Column:
    """Unsigned 32-bit draw, the same in any engine that has MD5."""
    text = F.concat_ws("|", seed.cast("string"), metric, iteration.cast("string"),
                       position.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _arrays(clusters: DataFrame) -> DataFrame:
    """One row per test with its differences in cluster order; for bounded cluster counts."""
    return clusters.groupBy(*TEST, "metric_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("leakage_group", "difference"))),
                    lambda x: x["difference"]).alias("d"))


def _blocks(clusters: DataFrame) -> DataFrame:
    """Clusters of each test in blocks of some 4,096: test, n, block and its differences ``d``."""
    sizes = clusters.groupBy(*TEST).agg(F.count(F.lit(1)).alias("n"))
    many = F.ceil(F.col("n") / BLOCK_CLUSTERS)
    placed = clusters.join(broadcast_if_bounded(sizes), TEST).withColumn(
        "block", F.pmod(F.xxhash64("leakage_group"), many).cast("bigint"))
    return materialise(placed.groupBy(*TEST, "metric_index", "n", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("leakage_group", "difference"))),
                    lambda x: x["difference"]).alias("d")))


def _split_counts(blocks: DataFrame, iterations: int, seed: int, factor: int) -> DataFrame:
    """How many of a test's ``n`` draws fall into each block, per iteration: test, iter, block, c.

    A multinomial count is a chain of conditional binomials; each iteration has its own generator,
    so a rerun splits alike. Blocks without a draw have no row.
    """
    tests = blocks.groupBy(*TEST, "metric_index", "n").agg(
        F.array_sort(F.collect_list(F.struct("block", F.size("d").alias("m")))).alias("parts"))

    def split(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array([p["m"] for p in row["parts"]], np.float64)
                numbers = np.array([p["block"] for p in row["parts"]], np.int64)
                share = sizes / sizes.sum()
                for start in range(0, iterations, 1000):
                    rounds = range(start, min(iterations, start + 1000))
                    counts = np.array([
                        np.random.default_rng([seed + row["metric_index"] * factor, i])
                        .multinomial(row["n"], share) for i in rounds]) if len(sizes) > 1 else \
                        np.full((len(rounds), 1), row["n"])
                    at, which = np.nonzero(counts)
                    size = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([row[c]] * size, pa.string()) for c in TEST],
                         pa.array(at + start, pa.int64()), pa.array(numbers[which], pa.int64()),
                         pa.array(counts[at, which], pa.int64())],
                        names=[*TEST, "iter", "block", "c"])

    schema = ", ".join([*[f"{c} string" for c in TEST], "iter long", "block long", "c long"])
    return tests.mapInArrow(split, schema)


def _resampled(blocks: DataFrame, rounds: DataFrame, value_of) -> DataFrame:
    """Mean of the drawn values per test and iteration, from partial sums per block.

    ``rounds`` has test, iter, block and the number ``c`` of values that the block gives;
    ``value_of(position)`` is one of them. Positions of block 0 are those of an undivided test.
    """
    spread = rounds.repartition(*[F.col(c) for c in TEST], F.col("iter"))
    values = blocks.agg(F.sum(F.size("d"))).first()[0] or 0
    data = F.broadcast(blocks) if values <= BROADCAST_ROW_LIMIT else blocks
    joined = spread.join(data, [*TEST, "block"])
    part = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1), F.lit(0.0),
        lambda acc, j: acc + value_of(F.col("block") * (1 << 32) + j))
    return (joined.select(*TEST, "metric_index", "iter", "n", part.alias("part"))
            .groupBy(*TEST, "metric_index", "iter").agg((F.sum("part") / F.first("n")).alias("sample")))


def cluster_bootstrap_ci(clusters: DataFrame, iterations: int = 10_000, seed: int = 20260812
                         ) -> DataFrame:
    """95% percentile interval from resampled clusters; the seed differs per metric."""
    if iterations < 100:
        raise ValueError("at least 100 bootstrap iterations are required")
    blocks = _blocks(clusters)
    seed_column = F.lit(seed) + F.col("metric_index") * 1009

    def drawn(position):
        draw = _draw(seed_column, F.col("metric"), F.col("iter"), position)
        return F.get(F.col("d"), F.pmod(draw, F.size("d").cast("bigint")).cast("int"))

    found = _resampled(blocks, _split_counts(blocks, iterations, seed, 1009), drawn)
    return found.groupBy(*TEST).agg(quantile("sample", 0.025).alias("ci_low"),
                                    quantile("sample", 0.975).alias("ci_high"))


def half_sums(values: np.ndarray) -> np.ndarray:
    """Sums of all sign vectors of a few values, sorted."""
    sums = np.zeros(1)
    for value in values:
        sums = np.concatenate([sums - value, sums + value])
    return np.sort(sums)


def count_extreme(d: np.ndarray) -> int:
    """How many sign vectors have a mean at least as far from 0 as the plain one.

    Meet in the middle: the vectors of each half give a sorted list of sums, and for every sum of
    one half the partners in the other that reach the limit on either side are two searches.
    """
    limit = abs(d.sum()) - 1e-12 * max(1.0, np.abs(d).sum())
    if limit <= 0:
        return 2 ** len(d)
    low, high = half_sums(d[:len(d) // 2]), half_sums(d[len(d) // 2:])
    above = len(high) - np.searchsorted(high, limit - low, side="left")
    below = np.searchsorted(high, -limit - low, side="right")
    return int(above.sum() + below.sum())


def sign_flip_exact(clusters: DataFrame, at_most: int = EXACT_CLUSTERS) -> DataFrame:
    """All sign vectors of tests with at most ``at_most`` clusters (40 can be asked for).

    A test is one row with its few differences; counting takes 2 ** (k / 2) steps and memory.
    """
    if at_most > 40:
        raise ValueError("exact tests have at most 40 clusters")
    # Tests are counted before anything is gathered, so only short ones become arrays.
    small = (clusters.groupBy(*TEST).agg(F.count(F.lit(1)).alias("__k"))
             .where(F.col("__k") <= at_most).select(*TEST))
    arrays = _arrays(clusters.join(small, TEST, "left_semi")).select(*TEST, "d")

    def count(batches):
        for batch in batches:
            values = [np.array(d, np.float64) for d in batch.column(len(TEST)).to_pylist()]
            total = [2 ** len(d) for d in values]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(TEST)],
                 pa.array([count_extreme(d) / t for d, t in zip(values, total)], pa.float64()),
                 pa.array(total, pa.int64())], names=[*TEST, "p_value_raw", "permutations"])

    schema = ", ".join([*[f"{c} string" for c in TEST], "p_value_raw double", "permutations long"])
    return (arrays.repartition(*TEST).mapInArrow(count, schema)
            .select(*TEST, "p_value_raw", F.lit("exact_cluster_sign_flip").alias("test"),
                    "permutations"))


def sign_flip_monte_carlo(clusters: DataFrame, iterations: int = 10_000, seed: int = 20260812,
                          above: int = EXACT_CLUSTERS) -> DataFrame:
    """Random sign vectors for tests with more than ``above`` clusters."""
    size = clusters.groupBy(*TEST).agg(F.count(F.lit(1)).alias("k"),
                                       F.abs(F.avg("difference")).alias("observed"))
    large = size.where(F.col("k") > above)
    blocks = _blocks(clusters.join(large.select(*TEST), TEST, "left_semi"))
    seed_column = F.lit(seed) + F.col("metric_index") * 2027
    # Every cluster is taken once an iteration, with a drawn sign.
    rounds = blocks.select(*TEST, "block", F.size("d").cast("bigint").alias("c"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1)
                                                .cast("bigint"))).alias("iter"))

    def signed(position):
        draw = _draw(seed_column, F.col("metric"), F.col("iter"), position)
        place = F.pmod(position, F.lit(1 << 32)).cast("int")
        return F.get(F.col("d"), place) * (F.pmod(draw, F.lit(2)) * 2 - 1)

    found = _resampled(blocks, rounds, signed)
    extreme = F.count_if(F.abs("sample") >= F.col("observed") - 1e-15)
    return (found.join(large, TEST).groupBy(*TEST).agg(
        ((extreme + 1) / F.lit(iterations + 1)).alias("p_value_raw"),
        F.lit("monte_carlo_cluster_sign_flip").alias("test"),
        F.lit(iterations).cast("bigint").alias("permutations")))


def holm(results: DataFrame, keys: list[str] = PAIR, p: str = "p_value_raw",
         order: str = "metric_index") -> DataFrame:
    """Holm step-down within each comparison (one row per metric, so a small group)."""
    ranked = Window.partitionBy(*keys).orderBy(p, order)
    all_rows = Window.partitionBy(*keys)
    factor = F.count(F.lit(1)).over(all_rows) - F.row_number().over(ranked) + 1
    adjusted = results.withColumn("__adj", F.least(F.lit(1.0), factor * F.col(p)))
    running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return adjusted.withColumn("p_value_holm", F.max("__adj").over(running)).drop("__adj")


def compare_methods(scored: DataFrame, reference: str, iterations: int = 10_000,
                    seed: int = 20260812, metrics: tuple[MetricSpec, ...] | None = None
                    ) -> DataFrame:
    """One row per treatment and metric with effect, interval and corrected p-value."""
    # A few rows per test, read by every statistic below.
    clusters = materialise(cluster_effects(scored, reference, metrics))
    pvalues = sign_flip_exact(clusters).unionByName(
        sign_flip_monte_carlo(clusters, iterations, seed))
    joined = (effects(clusters).join(cluster_bootstrap_ci(clusters, iterations, seed), TEST)
              .join(pvalues, TEST))
    return holm(joined)


def comparison_report(summaries: DataFrame, comparison: DataFrame, expected_sha256: str,
                      publication_ready: bool) -> DataFrame:
    """A20 report header: inputs must score the same sealed challenges, and a comparison is a
    scientific result only for a publication-ready benchmark without sanity inputs."""
    checked = with_violations(summaries, [
        Rule("challenge_digest", ~F.col("challenge_sha256").eqNullSafe(F.lit(expected_sha256))),
    ])
    sane = F.bool_and(F.coalesce(F.col("scientific_result"), F.lit(True)))
    header = checked.agg(
        F.count_if(F.size("violations") > 0).alias("digest_mismatches"),
        (F.lit(publication_ready) & sane).alias("scientific_result"))
    tests = comparison.agg(F.count(F.lit(1)).alias("tests"))
    return header.crossJoin(tests)  # one row each



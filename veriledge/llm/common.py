"""Helpers shared by the corpus operators: tables, shared folders, files, links to components."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledge.session import checkpoint_dir

# White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the checkpoint folder, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back, cutting the lineage."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Most bytes of a table that is sent to every executor, by its measured rows.
SENT_BYTES = 64 << 20


def sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast where the measured size allows it; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(SENT_BYTES // row_bytes + 1).count() * row_bytes \
        <= SENT_BYTES else df


def placed(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with ``place``, the row's number within its keys by ``order``, and ``n``, their rows.

    Rows are range partitioned on keys and order; a key of any size spreads over as many
    partitions as its rows need. A partition's running numbers are stored with its rows, and the
    rows of a key in earlier partitions are added from one count per key and partition.
    """
    by = [*keys, *order]
    numbered = stored(df.repartitionByRange(*by).sortWithinPartitions(*by)
                      .withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33)
    counts = (numbered.groupBy(*keys, part.alias("part"))
              .agg(F.min("at").alias("first"), F.count("*").alias("rows")))
    of_key = Window.partitionBy(*keys)
    earlier = of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select(
        *keys, "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0))
                        - F.col("first")).alias("shift"), F.sum("rows").over(of_key).alias("n")),
        f"{label}-counts")
    joined = numbered.withColumn("part", part).join(sent_if_small(counts, 128), [*keys, "part"])
    return joined.select(*df.columns, (F.col("at") + F.col("shift")).alias("place"), "n")


def open_store(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI; usable on driver and executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def slices(batches, rows: int = 512):
    """Record batches in small parts, so few texts at a time become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def giving_back(rows):
    """The rows of a Python task; freed memory then goes back to the system.

    Workers outlive their tasks, and what a library keeps for later use would add up over stages.
    """
    import ctypes

    import pyarrow as pa

    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the values and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node of each part.

    Alternating large-star and small-star rounds: every round keeps at most one link per link, so
    no neighbourhood is gathered, and rounds grow with the logarithm of a chain's length. Each
    round is written to the shared folder; only two counts reach the driver.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                   .where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        edges = stored(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(joined.select("u", F.col("m").alias("v")))
                       .where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

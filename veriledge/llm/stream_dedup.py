"""Exact dedup as a stateful stream with disk-backed keyed state that never expires.

The stream groups documents by digest in RocksDB state without watermark. Each key retains the
digest, how many rows had it, and the stable identifier and content locator (file and row) of the
row that stays. The state is read back with Spark's state reader. Hits are confirmed on full
bytes; digests that two different texts share are settled by the texts themselves.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriledge.llm.common import sent_if_small, shared_folder, stored
from veriledge.session import cloned

# State on disk, without space set aside ahead of its use by each of many partitions.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(rows: DataFrame, digest) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        text.alias("text"))


def stream_state(spark: SparkSession, path: str, state: str, digest=_sha256,
                 max_bytes_per_trigger: str | None = None) -> DataFrame:
    """Advance the keyed state at ``state`` by the files of ``path`` that it has not seen.

    Returns the whole state: digest, keep (struct of doc_id, file, row), group_size. Calling it
    again after new files arrived goes on from the retained state.
    """
    table = spark.read.parquet(path)
    # The settings hold in a session of their own; other queries of ``spark`` are not touched.
    session = cloned(spark, **STATE)
    reader, folder = session.readStream.schema(table.schema), path.rstrip("/")
    parent, _, name = folder.rpartition("/")
    files = table.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}"):
        # The table is a single file; streams read folders.
        folder, reader = parent, reader.option("pathGlobFilter", name)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    keyed = (_located(reader.parquet(folder), digest).groupBy("digest")
             .agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"),
                  F.count("*").alias("group_size")))
    query = (keyed.writeStream.outputMode("update").format("noop")
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    held = spark.read.format("statestore").load(state)
    kept, counted = held.schema["value"].dataType.fieldNames()
    return held.select(F.col("key.digest").alias("digest"), F.col(f"value.{kept}").alias("keep"),
                       F.col(f"value.{counted}").alias("group_size"))


def stream_dedup(spark: SparkSession, path: str, state: str | None = None, digest=_sha256,
                 max_bytes_per_trigger: str | None = None) -> DataFrame:
    """One row per document of the Parquet table at ``path``: which row of its equal texts stays.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty. Of equal
    texts the largest doc_id stays (null is smallest); repeated rows with that same doc_id are told
    apart by their place, so exactly one row of a group is kept. Other columns are not read. An
    empty table gives no rows.
    """
    state = state or shared_folder(spark, "dedup-state")
    groups = stored(stream_state(spark, path, state, digest, max_bytes_per_trigger), "dedup-groups")
    rows = _located(spark.read.parquet(path), digest)
    # Full bytes are checked on hits: a digest of one row meets no other. Of digests with more rows
    # the texts must be one; copies collapse before the shuffle, so a text that a third of all rows
    # share is sent once per task.
    hits = sent_if_small(groups.where("group_size > 1").select("digest"), 96)
    texts = rows.join(hits, "digest", "left_semi").groupBy("digest", "text").agg(F.lit(1).alias("one"))
    shared = stored(texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
                    .select("digest"), "dedup-collisions")
    place = F.struct("doc_id", "file", "row")
    sha = _sha256(F.col("text")).alias("text_sha256")
    columns = ["doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
               (F.struct("doc_id", "file", "row").eqNullSafe(F.col("keep"))).alias("kept"),
               "text_sha256"]
    light = rows.select("doc_id", "file", "row", "digest", sha)
    if shared.isEmpty():
        return light.join(groups, "digest").select(*columns)
    clean = groups.join(shared, "digest", "left_anti")
    same = Window.partitionBy("digest", "text")
    settled = (rows.join(shared, "digest").withColumn("keep", F.max(place).over(same))
               .withColumn("group_size", F.count("*").over(same)).withColumn("text_sha256", sha))
    return light.join(clean, "digest").select(*columns).unionByName(settled.select(*columns))

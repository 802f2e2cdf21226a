"""Session defaults and the few places where a plan has to be materialised."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a relation may have before it is no longer sent to every executor.
BROADCAST_ROW_LIMIT = 2_000_000


def build_session(app_name: str = "veriledge", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cloned(spark: SparkSession, **conf) -> SparkSession:
    """A session of the same application with its settings and some others; ``spark`` is unchanged."""
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            session.conf.set(name, value)
    for name, value in conf.items():
        session.conf.set(name, value)
    return session


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local folder is used only on a local master."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        import tempfile

        configured = tempfile.mkdtemp(prefix="veriledge-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor loses no rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_bounded(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    return df.limit(limit + 1).count() <= limit


def broadcast_if_bounded(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only for a relation whose size was just measured."""
    return F.broadcast(df) if is_bounded(df, limit) else df


def cols(names) -> list[Column]:
    return [F.col(name) for name in names]

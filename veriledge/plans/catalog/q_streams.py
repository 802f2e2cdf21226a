"""Structured Streaming jobs, driven over everything available and compared with SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.operators import jobs
from veriledge.operators.ledger import LEDGER
from veriledge.plans.catalog.q_jobs import BUCKET, BUDGET, CIRCUIT, calls
from veriledge.plans.catalog.q_ledger import _CHAIN, _SIMPLE, chained
from veriledge.plans.catalog.registry import query
from veriledge.streaming import streams
from veriledge.streaming.stateful import state_session


def as_stream(t, df, placed, session=None, batch_mb=256):
    """Write a table to the shared folder and read it back as a stream.

    ``placed`` is a number of files, or the keys whose rows must share a file: files arrive in any
    order and in several micro-batches, so a key's rows in two files would lose their order. Keys of a
    micro-batch are stepped through side by side, so few files of a batch keep few tasks busy.
    """
    path = t.scratch()
    rows = df.repartition(placed) if isinstance(placed, int) else df.repartition(*placed)
    rows.write.parquet(path)
    reader = (session or t.spark).readStream.schema(df.schema)
    return reader.option("maxBytesPerTrigger", str(batch_mb << 20)).parquet(path)


def with_state(t, df, *keys, batch_mb=256):
    """The stream in a session that keeps its state in RocksDB."""
    return as_stream(t, df, keys, state_session(t.spark), batch_mb)


def drained(t, stream, mode: str = "append"):
    out = t.scratch()
    streams.run_available_now(stream, out, t.scratch(), mode)
    return t.spark.read.parquet(out)


@query("ST01_stream_verify_chain", "raw_events", recursive=True, sql=f"""WITH {_CHAIN}
    SELECT c.event_id, c.seq < COALESCE(b.first_bad, 1000000000) AS ok FROM chain c LEFT JOIN (
        SELECT tenant_id, job_id, min(seq) AS first_bad FROM chain WHERE n % 307 = 0
        GROUP BY 1, 2) b ON b.tenant_id = c.tenant_id AND b.job_id = c.job_id""")
def _(t):
    n = F.expr("cast(substr(event_id, 2) as bigint)")
    log = chained(t).withColumn("payload", F.when(n % 307 == 0, F.lit('{"k":-1}')).otherwise(
        F.col("payload")))
    return drained(t, streams.stream_verify_chain(with_state(t, log, *LEDGER))) \
        .select("event_id", "ok")


@query("ST02_stream_claim_state", sql=f"""WITH {_SIMPLE}
    SELECT 'm' || conv_id || '-' || turn AS event_id, applied,
           CASE WHEN seq >= stop THEN seq = stop END AS stopping,
           CASE WHEN seq = stop THEN code ELSE '' END AS codes FROM a""")
def _(t):
    states = streams.stream_claim_state(with_state(t, t.claim_log, *LEDGER))
    return drained(t, states).select(
        "event_id", "applied", (F.col("sequence") == F.col("stopped_at")).alias("stopping"), "codes")


def updated(t, stream, keys):
    """Drive an aggregating stream in update mode; the last version of every row."""
    target = t.scratch()

    def append(batch, number):
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    streams.run_available_now(stream, target, t.scratch(), "update", append)
    rows = t.spark.read.parquet(target)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch")
    return rows.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


@query("ST03_stream_latency_histogram", "requests", sql="""
    WITH r AS (SELECT *, date_trunc('day', ts) AS day FROM requests)
    SELECT strftime(day, '%Y-%m-%d') AS day, method, route, 'count' AS series,
        CAST(count(*) AS DOUBLE) AS value FROM r GROUP BY 1, 2, 3
    UNION ALL SELECT strftime(day, '%Y-%m-%d'), method, route, 'sum',
        round(sum(CAST(duration_seconds AS DOUBLE)), 4) FROM r GROUP BY 1, 2, 3""")
def _(t):
    """All windows, the last open one included: update mode gives each its newest values."""
    source = t.requests.select("ts", "method", "route", "duration_seconds")
    hist = streams.stream_latency_histogram(as_stream(t, source, 1), window="1 day", mode="update")
    latest = updated(t, hist, ["window_start", "method", "route", "series", "le"])
    return latest.where("series <> 'bucket'").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "method", "route", "series",
        F.round("value", 4).alias("value"))


@query("ST04_stream_budget_admission", "jobs", "charges", recursive=True, sql=BUDGET)
def _(t):
    order = ["created_at", "tokens", "provider"]
    first = jobs.deduplicated_charges(t.charges, order)
    budgets = t.jobs.select("job_id", "max_calls", "max_tokens", "max_cost_microunits")
    log = first.join(budgets, "job_id").drop("occurrences", "conflict")
    out = streams.stream_budget_admission(with_state(t, log, "job_id"), ["charge_key"], order)
    return drained(t, out).select("job_id", "charge_key", "admitted")


@query("ST05_stream_circuit", "calls", recursive=True, sql=CIRCUIT + """
    SELECT event_id, ev AS event_type, st AS next_state, CAST(fails AS BIGINT) AS failures
    FROM walk""")
def _(t):
    out = streams.stream_circuit(as_stream(t, calls(t), ["circuit_id"]), ["event_id"], ["at", "event_id"],
                                 threshold=2, cooldown=5.0, probe_timeout=20.0)
    return drained(t, out).select("event_id", "event_type", "next_state", "failures")


@query("ST06_stream_token_bucket", "requests", recursive=True, sql=BUCKET + """
    SELECT event_id, ok AS allowed, CAST(retry AS BIGINT) AS retry_after FROM walk""")
def _(t):
    log = t.requests.select("tenant_id", "principal_id", "event_id", (F.col("moment") / 1e4)
                            .alias("at"))
    out = streams.stream_token_bucket(as_stream(t, log, ["tenant_id", "principal_id"]),
                                      ["event_id"], ["at", "event_id"], 2, 2)
    return drained(t, out).select("event_id", "allowed", "retry_after")


@query("ST07_stream_outbox", "outbox", sql="""
    SELECT tenant_id, event_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at,
        event_id) AS sequence FROM outbox WHERE dispatched_at IS NULL""")
def _(t):
    target = t.scratch()
    stream = with_state(t, t.outbox, "tenant_id", batch_mb=2048)
    streams.stream_outbox(stream, target, t.scratch(), "policy-memory").awaitTermination()
    held = t.spark.read.schema(S.EVENT).option("recursiveFileLookup", "true").parquet(target)
    return held.select("tenant_id", "event_id", "sequence")


@query("ST08_stream_dedup", sql="""
    SELECT DISTINCT user_id FROM events""")
def _(t):
    out = streams.stream_dedup(as_stream(t, t.events, 1), "user_id", "ts", "60 days")
    return drained(t, out).select("user_id")

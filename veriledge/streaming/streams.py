"""Streaming twins of the batch operators.

Ledgers, claim graphs, budgets and the outbox are stateful processors (``stateful.py``) and need a
session of ``state_session``. Sources must deliver a key's rows in order across batches, as
append-only logs do; inside a batch any order will do.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from veriledge import schemas as S
from veriledge.functions.contracts import violation_codes, with_violations
from veriledge.functions.scalars import envelope_parts, semantic_fingerprint
from veriledge.operators.graph import flatten_claim_events, row_rules
from veriledge.operators.jobs import _budget_machine
from veriledge.operators.ledger import shaped_outbox
from veriledge.operators.ordered import Machine
from veriledge.operators.rows import validate_events
from veriledge.operators.service import (
    circuit_machine, histogram_rows, token_bucket_machine,
)
from veriledge.streaming.stateful import (
    GROUPS, ChainRows, ClaimRows, MachineRows, PackedOutbox, run_packed, run_processor,
)

_STATE = "state string"


def _native(value):
    """Python value of a pandas cell; missing values become None."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def stateful_fold(stream: DataFrame, keys: list[str], order: list[str], machine: Machine,
                  keep: list[str]) -> DataFrame:
    """Run a batch ``Machine`` over a stream; outputs ``keys + keep + machine outputs``."""
    fields = [f for f in stream.schema.fields if f.name in keys] + [
        f for f in stream.schema.fields if f.name in keep]
    out = StructType(sorted(fields, key=lambda f: (f.name not in keys, stream.columns.index(
        f.name))) + machine.output.fields)
    names, produced = out.fieldNames(), machine.output.fieldNames()
    reads = tuple(dict.fromkeys((*keys, *machine.reads)))
    step, start = machine.step, machine.start

    def run(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        current = json.loads(state.get[0]) if state.exists else None
        results = []
        for values in rows[list(reads)].itertuples(index=False, name=None):
            row = dict(zip(reads, map(_native, values)))
            if current is None:
                current = start(row)
            current, outputs = step(current, row)
            results.append(outputs)
        state.update((json.dumps(current),))
        added = pd.DataFrame(results, columns=produced, index=rows.index)
        for field in machine.output.fields:
            if field.dataType.typeName() == "long":
                added[field.name] = added[field.name].astype("Int64")
        yield pd.concat([rows, added], axis=1)[names]

    return stream.groupBy(*keys).applyInPandasWithState(
        run, out, _STATE, "append", GroupStateTimeout.NoTimeout)


def stream_budget_admission(charges: DataFrame, keep: list[str], order: list[str]) -> DataFrame:
    """ST04: charges joined with their job's budgets beforehand."""
    machine = _budget_machine()
    kept = ["job_id", *keep]
    out = StructType([charges.schema[n] for n in kept] + machine.output.fields)
    grouped = charges.withColumn("__group", F.pmod(F.xxhash64("job_id"), F.lit(GROUPS)))
    return run_processor(grouped, ["__group"], MachineRows(
        charges.schema, ("job_id",), tuple(order), out, machine, tuple(kept)))


def stream_circuit(log: DataFrame, keep: list[str], order: list[str], threshold: int = 3,
                   cooldown: float = 60.0, probe_timeout: float = 900.0) -> DataFrame:
    """ST05."""
    return stateful_fold(log, ["circuit_id"], order,
                         circuit_machine(threshold, cooldown, probe_timeout), keep)


def stream_token_bucket(requests: DataFrame, keep: list[str], order: list[str],
                        per_minute: int = 600, burst: int = 100) -> DataFrame:
    """ST06."""
    return stateful_fold(requests, ["tenant_id", "principal_id"], order,
                         token_bucket_machine(per_minute, burst), keep)


def stream_verify_chain(events: DataFrame) -> DataFrame:
    """ST01: every rule of W01, event by event; the first break of a ledger is final.

    Event rules and exact hashes are checked row by row before the state, which carries the chain
    and the ids and keys that the ledger has.
    """
    checked = validate_events(events).select(
        "tenant_id", "job_id", "sequence", "event_id", "idempotency_key", "previous_hash",
        "event_hash", violation_codes().alias("row_error"))
    out = S.flat("tenant_id string, job_id string, sequence bigint, event_id string, ok boolean, "
                 "verified bigint, error string")
    return run_processor(checked, ["tenant_id", "job_id"],
                         ChainRows(checked.schema, ("sequence", "event_id"), out))


def stream_claim_state(events: DataFrame) -> DataFrame:
    """ST02: the rules of W02 over a stream of claim events, up to each ledger's first illegal one.

    One row per event: the claim's state after it, the codes it breaks, whether it was applied or
    is a replay of an event id, and where its ledger stopped. Later events are not judged.
    """
    flat = flatten_claim_events(events)
    names = ("tenant_id", "job_id", "sequence", "event_id", "event_type", "claim_id", "query_id",
             "intent", "passage_id", "relation", "to_state")
    judged = with_violations(flat, row_rules()).select(
        *names, violation_codes().alias("row_codes"))
    out = S.flat("tenant_id string, job_id string, sequence bigint, event_id string, "
                 "event_type string, claim_id string, state string, codes string, applied boolean, "
                 "replayed boolean, stopped_at bigint")
    return run_processor(judged, ["tenant_id", "job_id"],
                         ClaimRows(judged.schema, ("sequence", "event_id"), out))


def stream_latency_histogram(requests: DataFrame, ts: str = "ts",
                             duration: str = "duration_seconds", window: str = "1 hour",
                             delay: str = "10 minutes", mode: str = "append") -> DataFrame:
    """ST03: A06 per tumbling window; rows later than the watermark are dropped."""
    timed = requests.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark(
        "__ts", delay)
    wide = timed.groupBy(F.window("__ts", window).alias("w"), "method", "route").agg(
        *[F.count_if(F.col(duration) <= edge).alias(f"le_{i}")
          for i, edge in enumerate(S.LATENCY_BUCKETS)],
        F.count(F.lit(1)).alias("n"), F.sum(duration).alias("total"))
    flat = wide.withColumn("window_start", F.col("w.start"))
    return histogram_rows(flat, ("window_start", "method", "route"))


def outbox_events(outbox: DataFrame, audit_job_id: str, held: DataFrame | None = None
                  ) -> DataFrame:
    """Outbox rows as chained events; ``problem`` says why a row is not appended.

    ``held`` is a stream of the events that the ledgers had before; they are verified once.
    """
    base = shaped_outbox(outbox.where(F.col("dispatched_at").isNull()), audit_job_id)
    names = [n for n in S.EVENT.fieldNames() if n != "schema_version"]
    extra = {n: F.lit(None).cast(S.EVENT[n].dataType) for n in names if n not in base.columns}
    rows = base.withColumns(extra).withColumn("row_error", F.lit(""))
    if held is not None:
        rows = rows.unionByName(validate_events(held).withColumn(
            "row_error", violation_codes()).select(*names, "row_error").withColumn(
            "created_at", F.lit(None).cast(base.schema["created_at"].dataType)))
    head, tail = envelope_parts()
    ready = rows.select(*names, "created_at", "row_error", semantic_fingerprint().alias("meaning"),
                        head.alias("head"), tail.alias("tail"),
                        F.coalesce("sequence", F.lit(1 << 62)).alias("turn"))
    out = StructType([S.EVENT[n] for n in (
        "event_id", "occurred_at", "tenant_id", "job_id", "aggregate_type", "aggregate_id",
        "event_type", "payload", "idempotency_key", "sequence", "previous_hash", "event_hash")]
        + S.flat("problem string").fields)
    return run_packed(ready, ["tenant_id", "job_id"],
                      PackedOutbox(ready.schema, ("turn", "created_at", "event_id"), out),
                      {"event_mark": (b"i", "event_id"), "key_mark": (b"k", "idempotency_key"),
                       "meaning_mark": (b"m", "meaning")})


def stream_outbox(outbox: DataFrame, ledger_path: str, checkpoint: str, audit_job_id: str,
                  held: DataFrame | None = None):
    """ST07: append new outbox rows to the ledger table, once each.

    The ledger itself is never read again: receipts, keys and ids are the query's state. A batch
    that is run again starts from the same state and overwrites its own folder. Rows that the
    ledger refuses go to a folder ``-refused`` beside it; ``-batch`` has the rows of the last batch.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("schema_version", F.lit(1).cast(S.EVENT["schema_version"].dataType))
        # Read twice below; the state runs once.
        rows.write.mode("overwrite").parquet(f"{ledger_path.rstrip('/')}-batch")
        rows = batch.sparkSession.read.schema(rows.schema).parquet(f"{ledger_path.rstrip('/')}-batch")
        rows.where("problem = ''").select(*S.EVENT.fieldNames()).write.mode("overwrite").parquet(
            f"{ledger_path}/batch={batch_id}")
        rows.where("problem NOT IN ('', 'replay', 'held')").write.mode("overwrite").parquet(
            f"{ledger_path.rstrip('/')}-refused/batch={batch_id}")

    return (outbox_events(outbox, audit_job_id, held).writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_dedup(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """ST08: first row per key within the watermark."""
    return (stream.withColumn("__ts", F.col(ts).cast("timestamp"))
            .withWatermark("__ts", delay).dropDuplicatesWithinWatermark([key]).drop("__ts"))


def run_available_now(result: DataFrame, name: str, checkpoint: str, mode: str = "append",
                      sink: Callable | None = None):
    """Drive a stream over everything that is available, into a table folder or a sink."""
    writer = result.writeStream.outputMode(mode).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", name)
    query = writer.start()
    query.awaitTermination()
    return query

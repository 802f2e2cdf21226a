"""Order-dependent computation over logs, without putting one key's whole log into one task.

``prefix_scan`` serves running aggregates that combine (max, sum, min): fixed-width blocks of the
sequence number, one value per block, a window over block values, a window inside each block.

``ordered_fold`` serves folds that do not combine, where a step depends on the whole state (budget
admission, circuit breakers, token buckets). Rows are range partitioned on key *and* order, so a
key that holds a third of the log spreads over a third of the partitions. Each partition streams
its sorted rows once with constant memory. A partition that starts in the middle of a key needs
the state its predecessor ended with: all such partitions start from a guess, and only those whose
guess turns out wrong run again. State machines that reset often settle after a round or two; the
result is exact in any case, because a round is repeated until no start state changes. A round is a
job over the partitions in question only; without a given number, Spark sizes the partitions by their
bytes, so a small log has few of them and needs few rounds.
"""
from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veriledge.session import cols, materialise


def prefix_scan(df: DataFrame, keys: list[str], seq: str, running: dict[str, tuple[str, Column]],
                width: int = 65_536) -> DataFrame:
    """Add running aggregates over all *earlier* rows of a key (``max``, ``min`` or ``sum``).

    ``seq`` must be a dense integer per key, as a ledger sequence is: a block then holds at most
    ``width`` rows, and block values are one row per ``width`` rows of the key.
    """
    block = F.floor(F.col(seq) / F.lit(width)).alias("__block")
    base = df.select("*", block, *[expr.alias(f"__in_{name}")
                                   for name, (_, expr) in running.items()])
    per_block = base.groupBy(*keys, "__block").agg(*[
        getattr(F, kind)(f"__in_{name}").alias(f"__b_{name}")
        for name, (kind, _) in running.items()])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = per_block.select(*keys, "__block", *[
        getattr(F, kind)(f"__b_{name}").over(before).alias(f"__c_{name}")
        for name, (kind, _) in running.items()])
    inside = Window.partitionBy(*keys, "__block").orderBy(seq).rowsBetween(
        Window.unboundedPreceding, -1)
    out = base.join(carried, [*keys, "__block"], "left")
    combine = {
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
        "sum": lambda a, b: F.when(a.isNull() & b.isNull(), F.lit(None))
        .otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    }
    return out.select(*df.columns, *[
        combine[kind](getattr(F, kind)(f"__in_{name}").over(inside),
                      F.col(f"__c_{name}")).alias(name)
        for name, (kind, _) in running.items()])


# Column with the number of the partition that a row was placed in.
PART = "__part"


@dataclass(frozen=True)
class Machine:
    """A fold: ``step(state, row) -> (state, outputs)`` with a JSON-able state.

    ``row`` is a dict of the columns named in ``reads``; ``outputs`` is a tuple that matches
    ``output``. ``start`` gets the first row of a key and returns the initial state. ``guesses`` is
    false where a guessed state is never right, as that of a hash chain.
    """

    start: Callable[[dict], Any]
    step: Callable[[Any, dict], tuple[Any, tuple]]
    reads: tuple[str, ...]
    output: StructType
    guesses: bool = True


def _values(column: pa.Array) -> list:
    """``to_pylist``; texts, and numbers without nulls, leave by numpy in a tenth of the time."""
    kind = column.type
    if pa.types.is_string(kind) or not column.null_count and (
            pa.types.is_integer(kind) or pa.types.is_float64(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _rows(batch: pa.RecordBatch, names: tuple[str, ...]):
    columns = [_values(batch.column(batch.schema.get_field_index(n))) for n in names]
    return zip(*columns) if columns else iter([()] * batch.num_rows)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], machine: Machine,
                 partitions: int | None = None, derived: dict[str, Column] | None = None
                 ) -> DataFrame:
    """Run ``machine`` over each key's rows in order and append its outputs to every row.

    ``derived`` are columns that the machine reads and nobody else: they are computed where the
    rows lie after placing, so they are neither moved, stored nor returned.
    """
    place = cols(keys + order)
    log = df.repartitionByRange(partitions, *place) if partitions else df.repartitionByRange(*place)
    log = log.sortWithinPartitions(*keys, *order)
    fields = StructType(df.schema.fields + machine.output.fields)
    key_names, step, start = tuple(keys), machine.step, machine.start
    reads = tuple(dict.fromkeys(key_names + machine.reads))
    width = len(key_names)
    incoming: dict[int, str] = {}

    # The number of its partition is stored with each row: a later coalesce or union changes which
    # task streams a partition, not where the rows of a partition begin.
    log = log.withColumn(PART, F.lit(0) if partitions == 1 else F.spark_partition_id())
    if partitions != 1:
        log = materialise(log)
        incoming = _incoming_states(log, keys, machine, derived)
    log = log.withColumns(derived or {})

    arrow_fields = to_arrow_schema(StructType(machine.output.fields))
    names, kept = fields.names, tuple(df.columns)
    reads = (*reads, PART)

    def run(batches):
        current, state, part = None, None, None
        for batch in batches:
            produced = [[] for _ in arrow_fields]
            for values in _rows(batch, reads):
                row = dict(zip(reads, values))
                key = values[:width]
                if values[-1] != part:
                    part = values[-1]
                    given = incoming.get(part)
                    current = key
                    state = json.loads(given) if given is not None else start(row)
                elif key != current:
                    state = start(row)
                    current = key
                state, outputs = step(state, row)
                for column, value in zip(produced, outputs):
                    column.append(value)
            arrays = [pa.array(column, type=field.type)
                      for column, field in zip(produced, arrow_fields)]
            held = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays(held + arrays, names=names)

    return log.mapInArrow(run, fields)


def _incoming_states(log: DataFrame, keys: list[str], machine: Machine,
                     derived: dict[str, Column] | None = None) -> dict[int, str]:
    """State each partition of a materialised log starts with; the driver handles one small row
    per partition."""
    if PART not in log.columns:
        log = log.withColumn(PART, F.spark_partition_id())
    spans = (log.select(F.col(PART).alias("pid"), F.struct(*keys).alias("k"))
             .groupBy("pid").agg(F.min("k").alias("first"), F.max("k").alias("last"))
             .orderBy("pid").collect())
    spans = [(row["pid"], tuple(row["first"]), tuple(row["last"])) for row in spans]
    # Partitions whose last key goes on in the next partition.
    open_ended: dict[int, tuple] = {}
    successor: dict[int, int] = {}
    for (pid, _, last), (next_pid, first, _) in zip(spans, spans[1:]):
        if last == first:
            open_ended[pid] = last
            successor[pid] = next_pid
    if not open_ended:
        return {}
    whole = {pid: first == last for pid, first, last in spans}

    key_names, step, start = tuple(keys), machine.step, machine.start
    reads = tuple(dict.fromkeys(key_names + machine.reads))
    width = len(key_names)
    # Rows of keys that end where they began are left before Python.
    log = log.where(_any_key(log, keys, set(open_ended.values()))).withColumns(derived or {})

    def end_states(wanted: dict[int, str | None]) -> dict[int, tuple[str, str]]:
        """Start and end state of each wanted partition; a null start asks for the guess."""
        def run(batches):
            pid = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if pid is None:
                    pid = batch.column(batch.schema.get_field_index(PART))[0].as_py()
                    target, given = open_ended[pid], wanted[pid]
                    state = json.loads(given) if given is not None else None
                    began = given
                for values in _rows(batch, reads):
                    if values[:width] != target:
                        continue
                    row = dict(zip(reads, values))
                    if state is None:
                        state = start(row)
                        began = json.dumps(state)
                    state, _ = step(state, row)
            if pid is None:
                return
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int32()), pa.array([began], pa.string()),
                 pa.array([json.dumps(state)], pa.string())], names=["pid", "began", "ended"])

        # Partitions are numbered as they were stored, so a job runs the wanted ones only.
        found = log.mapInArrow(run, "pid int, began string, ended string").rdd
        rows = log.sparkSession.sparkContext.runJob(found, list, sorted(wanted))
        return {row["pid"]: (row["began"], row["ended"]) for row in rows}

    # Only a partition that lies wholly inside the key depends on its predecessor.
    after = {pid: nxt for pid, nxt in successor.items() if nxt in open_ended and whole[nxt]}
    used, ends = {}, {}
    wanted = {pid: None for pid in open_ended
              if machine.guesses or pid not in set(after.values())}
    while wanted:
        for pid, (began, ended) in end_states(wanted).items():
            used[pid], ends[pid] = began, ended
        wanted = {nxt: ends[pid] for pid, nxt in after.items()
                  if pid in ends and used.get(nxt) != ends[pid]}
    return {successor[pid]: ends[pid] for pid in open_ended}


def _any_key(log: DataFrame, keys: list[str], wanted: set[tuple]) -> Column:
    """Whether a row's key is one of ``wanted``; null parts of a key are equal."""
    kinds = [log.schema[k].dataType for k in keys]
    listed = [F.struct(*[F.lit(v).cast(kind).alias(k) for k, kind, v in zip(keys, kinds, key)])
              for key in wanted]
    return F.struct(*keys).isin(listed)

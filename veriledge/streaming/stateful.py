"""Stateful processors: a key's rows are stepped through one at a time, in their order.

State lives in RocksDB under the query's checkpoint. A call to the state store costs far more than a
step, so none is made per row where a key may have many: ids and keys that were seen are packed
records in buckets (``Records``), and small states of many keys share an entry (``MachineRows``). A
micro-batch hands over the rows of a key as an iterator in any order; they are sorted in runs, of which
all but the last lie in a temporary file of the task.

A key with very many rows (the outbox) is one task's, where every row that becomes a Python object
counts. Its rows are sorted and packed as Arrow tables where they are read, by many tasks (``packer``); the
state's task merges tables and steps through lists of the few values it needs, and its results are
unpacked after it.
"""
from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import pickle
import tempfile
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from veriledge import schemas as S
from veriledge.operators.ordered import Machine
from veriledge.session import cloned

# Waiting rows of one key that are held in memory; more go to a temporary file.
HELD_ROWS = 65_536
# Rows of a run that are read back at once.
RUN_BLOCK = 512
# Packed rows of one key, in rows and bytes at most, and the packs of a batch; rows and bytes that are
# packed at once, and those in memory before a run is written to a file.
PACKED_ROWS, PACKED_BYTES, PACKED_TOGETHER = 4096, 1 << 20, 64
PACK_ROWS, PACK_BYTES = 65_536, 64 << 20
# Blocks of sorted runs that are merged at once.
MERGED_BLOCKS = 64
# Records a bucket of the first level is meant to hold, and new ones that wait in memory.
BUCKET_RECORDS = 4096
NEW_RECORDS = 1 << 20
# Groups that share the states of small machines, and the state entries of a group.
GROUPS, PARTS = 1024, 16


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streaming state is kept in RocksDB."""
    return cloned(spark, **{
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"})


class SortedRuns:
    """Rows in the order of some columns (nulls first), the first that came first where they tie."""

    def __init__(self, names: list[str], order: tuple[str, ...]):
        self.names, self.order = names, order
        self.rows, self.runs, self.count, self.file = [], [], 0, None

    def add(self, row) -> None:
        place = tuple((row[c] is not None, row[c]) for c in self.order)
        self.rows.append((place, self.count, tuple(row[n] for n in self.names)))
        self.count += 1
        if len(self.rows) >= HELD_ROWS:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.rows.sort()
        blocks = []
        for at in range(0, len(self.rows), RUN_BLOCK):
            blocks.append(self.file.tell())
            pickle.dump(self.rows[at:at + RUN_BLOCK], self.file, pickle.HIGHEST_PROTOCOL)
        self.runs.append(blocks)
        self.rows = []

    def _run(self, blocks: list[int]):
        for offset in blocks:
            self.file.seek(offset)
            yield from pickle.load(self.file)

    def __iter__(self):
        self.rows.sort()
        for _, _, values in heapq.merge(*[self._run(b) for b in self.runs], self.rows):
            yield dict(zip(self.names, values))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def digest(kind: bytes, text: str | None) -> bytes:
    data = b"0" if text is None else b"1" + text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(kind + data, digest_size=16).digest()


class Records:
    """What a key's rows had before: digests of 16 bytes, each with a value of 16 bytes.

    Level n has 4 ** n buckets by digest, each one map entry of packed records; new records go to the
    first level that has room, so none is moved later. A micro-batch reads a touched bucket once and
    writes it once per ``NEW_RECORDS``. Only digests that the batch has twice or that are held
    already are looked up row by row.
    """

    def __init__(self, handle):
        self.map = handle.getMapState("records", "bucket bigint", "packed binary")

    def begin(self, count: int) -> None:
        self.count, self.seen = count, bytearray()

    def see(self, *digests: bytes) -> None:
        for item in digests:
            self.seen += item[:8]

    def see_all(self, digests: bytes) -> None:
        """Look at digests that follow one another without gaps."""
        self.seen += np.frombuffer(digests, "<u8")[::2].tobytes()

    @staticmethod
    def _level(count: int) -> int:
        level = 0
        while count > BUCKET_RECORDS * (4 ** (level + 1) - 1) // 3:
            level += 1
        return level

    @staticmethod
    def _by_bucket(hashes: np.ndarray, level: int):
        """(map key, positions) of every bucket that the hashes fall into."""
        buckets = hashes & np.uint64(4 ** level - 1)
        places = np.argsort(buckets, kind="stable")
        kept = buckets[places]
        starts = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], len(kept)]):
            yield (level << 48) + int(kept[start]), places[start:end]

    def ready(self) -> None:
        hashes, self.seen = np.frombuffer(self.seen, "<u8"), bytearray()
        hashes.sort()
        self.suspects = set(hashes[1:][hashes[1:] == hashes[:-1]].tolist())
        self.known, self.new = {}, bytearray()
        if self.count:
            hashes = np.unique(hashes)
        for level in range(self._level(self.count) + 1 if self.count and len(hashes) else 0):
            for bucket, places in self._by_bucket(hashes, level):
                found = self.map.getValue((bucket,))
                if found is None:
                    continue
                packed = bytes(found[0])
                held = np.frombuffer(packed, "<u8").reshape(-1, 4)[:, 0]
                for i in np.flatnonzero(np.isin(held, hashes[places])).tolist():
                    self.suspects.add(int(held[i]))
                    self.known[packed[32 * i:32 * i + 16]] = packed[32 * i + 16:32 * i + 32]

    def get(self, item: bytes) -> bytes | None:
        return self.known.get(item)

    def put(self, item: bytes, value: bytes = bytes(16)) -> None:
        if int.from_bytes(item[:8], "little") in self.suspects:
            self.known[item] = value
        self.new += item + value
        if len(self.new) >= 32 * NEW_RECORDS:
            self.flush()

    def flush(self) -> None:
        if self.new:
            rows = np.frombuffer(bytes(self.new), "<u8").reshape(-1, 4)
            level = self._level(self.count + len(rows))
            for bucket, places in self._by_bucket(rows[:, 0], level):
                found = self.map.getValue((bucket,)) if self.count else None
                packed = (bytes(found[0]) if found is not None else b"") + rows[places].tobytes()
                self.map.updateValue((bucket,), (packed,))
            self.count += len(rows)
            self.new = bytearray()


def _sorted(table: pa.Table, order) -> pa.Table:
    """The rows by some columns, nulls first; ties stay as they are."""
    places = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
    return table.take(places).combine_chunks()


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def parts(table: pa.Table, rows: int, starts=(0,)):
    """(start, end) of rows to pack together: at most so many and, unless it is a single row,
    ``PACKED_BYTES``, and none across the ``starts``."""
    sizes = None
    if table.nbytes > PACKED_BYTES:
        sizes = np.zeros(table.num_rows + 1, np.int64)
        for column in table.columns:
            sizes[1:] += 8 if pa.types.is_primitive(column.type) else pc.fill_null(
                pc.binary_length(column), 0).to_numpy()
        sizes = np.cumsum(sizes)
    for start, end in zip(starts, [*starts[1:], table.num_rows]):
        while start < end:
            stop = min(end, start + rows)
            if sizes is not None:
                fit = int(np.searchsorted(sizes, sizes[start] + PACKED_BYTES, "right")) - 1
                stop = min(stop, max(start + 1, fit))
            yield start, stop
            start = stop


def packer(keys: tuple[str, ...], order: tuple[str, ...], marks: dict[str, tuple[bytes, str]]):
    """For ``mapInArrow``: rows become sorted runs of one key each, in a column ``packed``.

    ``marks`` are columns to add: the digest, of a kind, of a column.
    """
    def runs(batches):
        table = pa.Table.from_batches(batches)
        for name, (kind, column) in marks.items():
            table = table.append_column(name, pa.array(
                [digest(kind, text) for text in table[column].to_pylist()], pa.binary(16)))
        table = _sorted(table, [*keys, *order])
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in keys:
            codes = table[name].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        places, found = [], []
        for start, end in parts(table, PACKED_ROWS, np.flatnonzero(new).tolist()):
            places.append(start)
            found.append(packed(table.slice(start, end - start)))
            if len(found) >= PACKED_TOGETHER:
                yield listed(table, places, found)
                places, found = [], []
        if found:
            yield listed(table, places, found)

    def listed(table, places, found):
        return pa.RecordBatch.from_arrays(
            [*[table[k].combine_chunks().take(places) for k in keys], pa.array(found, pa.binary())],
            names=[*keys, "packed"])

    def pack(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= PACK_ROWS or size >= PACK_BYTES:
                yield from runs(held)
                held, rows, size = [], 0, 0
        if held:
            yield from runs(held)

    return pack


def unpack(batches):
    """For ``mapInArrow``: the rows of packed tables, of many short ones together."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for data in batch.column(0):
            data = data.as_py()
            held.append(unpacked(data))
            rows, size = rows + held[-1].num_rows, size + len(data)
            if rows >= PACKED_ROWS or size >= PACKED_BYTES:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, rows, size = [], 0, 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


class PackedRuns:
    """``SortedRuns`` of Arrow tables: sorted tables go in in any order, and the rows of all come out in
    order, as many at once as some blocks have. Memory holds these and, of every run, a block at most."""

    def __init__(self, order: tuple[str, ...]):
        self.order, self.file, self.blocks = order, None, []
        self.held, self.rows, self.size = [], 0, 0

    def add(self, data: bytes) -> pa.Table:
        table = unpacked(data)
        self.held.append(table)
        self.rows, self.size = self.rows + table.num_rows, self.size + len(data)
        if self.rows >= PACK_ROWS or self.size >= PACK_BYTES:
            self._spill()
        return table

    def _taken(self) -> pa.Table:
        table = self.held[0] if len(self.held) == 1 else _sorted(pa.concat_tables(self.held), self.order)
        self.held, self.rows, self.size = [], 0, 0
        return table

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        table = self._taken()
        for start, end in parts(table, RUN_BLOCK):
            block = packed(table.slice(start, end - start))
            self.blocks.append((self._place(table, start), len(self.blocks), self.file.tell(), len(block)))
            self.file.write(block)

    def _place(self, table: pa.Table, i: int) -> tuple:
        values = [table[c][i].as_py() for c in self.order]
        return tuple((v is not None, v) for v in values)

    def _read(self, block) -> pa.Table:
        self.file.seek(block[2])
        return unpacked(self.file.read(block[3]))

    def __iter__(self):
        if self.file is None:
            if self.held:
                yield self._taken()
            return
        if self.held:
            self._spill()
        # Rows before the first row of the next block lie in the blocks read so far.
        self.blocks.sort()
        left = []
        for at in range(0, len(self.blocks), MERGED_BLOCKS):
            end = at + MERGED_BLOCKS
            table = _sorted(pa.concat_tables([*left, *map(self._read, self.blocks[at:end])]), self.order)
            cut = table.num_rows
            if end < len(self.blocks):
                bound = self.blocks[end][0]
                cut = bisect.bisect_left(range(cut), bound, key=lambda i: self._place(table, i))
            if cut:
                yield table.slice(0, cut)
            left = [table.slice(cut)]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class OrderedRows(StatefulProcessor):
    """Base of the processors below: ``step`` sees the rows of a key in the order of ``order``."""

    def __init__(self, schema: StructType, order: tuple[str, ...], output: StructType):
        self.schema, self.order, self.output = schema, order, output

    def init(self, handle) -> None:
        self.open(handle)

    def open(self, handle) -> None:
        """Get the state variables."""

    def load(self) -> None:
        """Read the small part of a key's state that every step needs."""

    def see(self, row) -> None:
        """Look at a row of the micro-batch, in any order, before the first step."""

    def ready(self) -> None:
        """Read what the rows seen need of the state."""

    def save(self) -> None:
        """Write it back after the last row."""

    def step(self, row) -> tuple:
        raise NotImplementedError

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        made = Row(*self.output.fieldNames())
        self.load()
        runs = SortedRuns(self.schema.fieldNames(), self.order)
        try:
            for row in rows:
                self.see(row)
                runs.add(row)
            self.ready()
            for row in runs:
                yield made(*self.step(row))
        finally:
            runs.close()
        self.save()


def run_packed(stream: DataFrame, keys: list[str], processor: PackedOutbox, marks) -> DataFrame:
    """A processor of packed rows: packed before the shuffle and unpacked after the state."""
    fields = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    runs = stream.mapInArrow(packer(tuple(keys), processor.order, marks), f"{fields}, packed binary")
    return runs.groupBy(*keys).transformWithStateInPandas(
        processor, "packed binary", "append", "none").mapInArrow(unpack, processor.output)


def run_processor(stream: DataFrame, keys: list[str], processor: OrderedRows) -> DataFrame:
    return stream.groupBy(*keys).transformWithState(processor, processor.output, "append", "none")


class MachineRows(OrderedRows):
    """A batch ``Machine`` over a stream, keyed by a hash of its keys; ``PARTS`` entries, each a JSON
    text with the states of some keys, are all the state of a group."""

    def __init__(self, schema, keys, order, output, machine: Machine, keep: tuple[str, ...]):
        super().__init__(schema, (*keys, *order), output)
        self.keys = keys
        self.start, self.advance, self.reads, self.keep = (
            machine.start, machine.step, machine.reads, keep)

    def open(self, handle) -> None:
        self.states = handle.getMapState("machines", "part int", "states string")

    def load(self) -> None:
        self.parts = {}

    def save(self) -> None:
        for part, states in self.parts.items():
            self.states.updateValue((part,), (json.dumps(states),))

    def step(self, row) -> tuple:
        key = json.dumps([row[k] for k in self.keys])
        part = zlib.crc32(key.encode()) % PARTS
        states = self.parts.get(part)
        if states is None:
            found = self.states.getValue((part,))
            states = self.parts[part] = json.loads(found[0]) if found is not None else {}
        now = states.get(key)
        if now is None:
            now = self.start(row)
        states[key], outputs = self.advance(now, row)
        return (*[row[n] for n in self.keep], *outputs)


class ChainRows(OrderedRows):
    """Sequence, previous hash, row rules, and ids and keys that occurred before; a break is final."""

    def open(self, handle) -> None:
        self.state = handle.getValueState(
            "chain", "n bigint, head string, error string, records bigint")
        self.held = Records(handle)

    def load(self) -> None:
        found = self.state.get()
        self.n, self.head, self.error, records = found if found is not None else (0, "", "", 0)
        self.held.begin(records)

    def see(self, row) -> None:
        if not self.error:
            self.held.see(digest(b"i", row["event_id"]), digest(b"k", row["idempotency_key"]))

    def ready(self) -> None:
        self.held.ready()

    def save(self) -> None:
        self.held.flush()
        self.state.update((self.n, self.head, self.error, self.held.count))

    def step(self, row) -> tuple:
        ok = False
        if not self.error:
            found = digest(b"i", row["event_id"]), digest(b"k", row["idempotency_key"])
            self.error = self._problem(row, *found)
            if not self.error:
                ok, self.n, self.head = True, row["sequence"], row["event_hash"]
                for item in found:
                    self.held.put(item)
        return (row["tenant_id"], row["job_id"], row["sequence"], row["event_id"], ok, self.n,
                self.error)

    def _problem(self, row, event_id: bytes, key: bytes) -> str:
        if row["sequence"] != self.n + 1:
            return "sequence_repeated" if (row["sequence"] or 0) <= self.n else "sequence_gap"
        if row["row_error"]:
            return row["row_error"]
        if (row["previous_hash"] or "") != self.head:
            return "previous_hash"
        if self.held.get(event_id) is not None:
            return "duplicate_event_id"
        if self.held.get(key) is not None:
            return "duplicate_idempotency_key"
        return ""


class ClaimRows(OrderedRows):
    """The claim graph of a ledger, event by event, up to its first illegal event.

    Everything a rule asks for is one map entry: the claim's state, relations and counter query,
    a query's claim and intent, a passage's origin, an edge. A replayed event id changes nothing.
    """

    def open(self, handle) -> None:
        self.state = handle.getValueState("ledger", "last bigint, stopped bigint")
        self.events = handle.getMapState("events", "event_id string", "sequence bigint")
        self.claims = handle.getMapState(
            "claims", "claim_id string", "state string, relations string, counter boolean")
        self.queries = handle.getMapState("queries", "query_id string",
                                          "claim_id string, intent string")
        self.passages = handle.getMapState("passages", "passage_id string",
                                           "claim_id string, intent string")
        self.edges = handle.getMapState(
            "edges", "claim_id string, passage_id string, relation string", "sequence bigint")

    def load(self) -> None:
        self.last, self.stopped = self.state.get() if self.state.exists() else (0, None)

    def save(self) -> None:
        self.state.update((self.last, self.stopped))

    def step(self, row) -> tuple:
        codes, state = "", None
        self.last = max(self.last, row["sequence"] or 0)
        replayed = self.events.containsKey((row["event_id"],))
        if self.stopped is None and not replayed:
            self.events.updateValue((row["event_id"],), (row["sequence"],))
            found = [c for c in (row["row_codes"] or "").split(",") if c]
            claim = self.claims.getValue((row["claim_id"],)) if row["claim_id"] is not None else None
            problems, change = self._judge(row, claim)
            codes = ",".join(sorted({*found, *problems}))
            if codes:
                self.stopped = row["sequence"]
            else:
                claim = change() or claim
            state = claim[0] if claim else None
        applied = not replayed and self.stopped is None
        return (row["tenant_id"], row["job_id"], row["sequence"], row["event_id"],
                row["event_type"], row["claim_id"], state, codes, applied, replayed, self.stopped)

    def _judge(self, row, claim):
        """(problems, change): the graph rules that an event breaks, and what it does if none."""
        kind, claim_id, out = row["event_type"], row["claim_id"], []
        if kind in ("query.executed", "evidence.linked", "claim.transitioned") and \
                claim_id is not None and claim is None:
            out.append("unknown_claim")
        if kind == "claim.proposed":
            if claim is not None:
                out.append("claim_exists")
            return out, lambda: self._claim(claim_id, ("PROPOSED", "", False))
        if kind == "query.executed":
            query_id = row["query_id"]
            if query_id is not None and self.queries.containsKey((query_id,)):
                out.append("query_exists")

            def executed():
                self.queries.updateValue((query_id,), (claim_id, row["intent"]))
                return self._claim(claim_id, (claim[0], claim[1], claim[2]
                                              or row["intent"] == "counterevidence"))
            return out, executed
        if kind == "passage.observed":
            passage_id, query_id = row["passage_id"], row["query_id"]
            origin = self.queries.getValue((query_id,)) if query_id is not None else None
            if query_id is not None and origin is None:
                out.append("unknown_query")
            if passage_id is not None and self.passages.containsKey((passage_id,)):
                out.append("passage_exists")
            return out, lambda: self.passages.updateValue((passage_id,), tuple(origin))
        if kind == "evidence.linked":
            return self._link(row, claim, out)
        if kind == "claim.transitioned":
            return self._move(row, claim, out)
        return out, lambda: None

    def _claim(self, claim_id, value) -> tuple:
        self.claims.updateValue((claim_id,), value)
        return value

    def _link(self, row, claim, out):
        claim_id, passage_id, relation = row["claim_id"], row["passage_id"], row["relation"]
        passage = self.passages.getValue((passage_id,)) if passage_id is not None else None
        if passage_id is not None and passage is None:
            out.append("unknown_passage")
        if passage is not None:
            if passage[0] != claim_id:
                out.append("foreign_passage")
            if relation == "SUPPORTS" and passage[1] not in (None, "support"):
                out.append("support_intent")
            if relation in S.COUNTER_RELATIONS and passage[1] not in (None, "counterevidence"):
                out.append("counter_intent")
        edge = (claim_id, passage_id, relation)
        if None not in edge and self.edges.containsKey(edge):
            out.append("duplicate_edge")

        def linked():
            self.edges.updateValue(edge, (row["sequence"],))
            known = {r for r in claim[1].split(",") if r}
            return self._claim(claim_id, (claim[0], ",".join(sorted(known | {relation})), claim[2]))
        return out, linked

    def _move(self, row, claim, out):
        target = row["to_state"]
        state, relations, counter = claim if claim else ("PROPOSED", "", False)
        has = set(relations.split(","))
        if target in S.CLAIM_STATES and target not in S.CLAIM_TRANSITIONS.get(state, ()):
            out.append("illegal_transition")
        needs = {"SUPPORTED": ("supported_without_edge", "SUPPORTS" in has),
                 "CHALLENGED": ("challenged_without_query", counter),
                 "SURVIVED": ("survived_without_evidence", "SUPPORTS" in has and counter),
                 "NARROWED": ("narrowed_without_edge", "BOUNDS" in has),
                 "REFUTED": ("refuted_without_edge", bool({"CONTRADICTS", "PRECEDENT_FOR"} & has))}
        code, met = needs.get(target, ("", True))
        if not met:
            out.append(code)
        return out, lambda: self._claim(row["claim_id"], (target, relations, counter))


class OutboxRows(OrderedRows):
    """Chain new outbox rows after what a ledger holds; work does not grow with the ledger.

    The receipt (count, head) and the keys and ids that the ledger has are state. Rows with a
    sequence number are events that the ledger held before the stream began: they are verified and
    taken over, and a ledger that breaks takes nothing more.
    """

    def open(self, handle) -> None:
        self.state = handle.getValueState(
            "receipt", "n bigint, head string, error string, records bigint")
        self.held = Records(handle)

    def load(self) -> None:
        found = self.state.get()
        self.n, self.head, self.error, records = found if found is not None else (0, "", "", 0)
        self.held.begin(records)

    def see(self, row) -> None:
        self.held.see(digest(b"i", row["event_id"]), digest(b"k", row["idempotency_key"]))

    def ready(self) -> None:
        self.held.ready()

    def save(self) -> None:
        self.held.flush()
        self.state.update((self.n, self.head, self.error, self.held.count))

    def step(self, row) -> tuple:
        key, event_id = digest(b"k", row["idempotency_key"]), digest(b"i", row["event_id"])
        if row["sequence"] is not None:
            found = self._take_over(key, event_id, digest(b"m", row["meaning"]), row["sequence"],
                                    row["previous_hash"], row["event_hash"], row["row_error"])
        else:
            found = self._chain(key, event_id, digest(b"m", row["meaning"]), row["head"], row["tail"])
        return (*[row[n] for n in self.output.fieldNames()[:-4]], *found)

    def _chain(self, key: bytes, event_id: bytes, meaning: bytes, head: str, tail: str) -> tuple:
        """(sequence, previous hash, hash, problem) of an outbox row."""
        if self.error:
            return None, None, None, "ledger_invalid"
        known = self.held.get(key)
        if known is not None:
            return None, None, None, "replay" if known == meaning else "idempotency_conflict"
        if self.held.get(event_id) is not None:
            return None, None, None, "duplicate_event_id"
        sequence, previous = self.n + 1, self.head
        text = f'{head}"{previous}","schema_version":1,"sequence":{sequence}{tail}'
        sealed = hashlib.sha256(text.encode("utf-8")).hexdigest()
        self._hold(key, event_id, meaning, sequence, sealed)
        return sequence, previous, sealed, ""

    def _hold(self, key: bytes, event_id: bytes, meaning: bytes, sequence: int, head: str) -> None:
        self.n, self.head = sequence, head
        self.held.put(key, meaning)
        self.held.put(event_id)

    def _take_over(self, key: bytes, event_id: bytes, meaning: bytes, sequence: int, previous: str,
                   event_hash: str, row_error: str) -> tuple:
        broken = (sequence != self.n + 1 or (previous or "") != self.head or row_error
                  or self.held.get(event_id) is not None or self.held.get(key) is not None)
        if broken:
            self.error = self.error or f"sequence {sequence}"
        elif not self.error:
            self._hold(key, event_id, meaning, sequence, event_hash)
        return None, None, None, "held"


class PackedOutbox(OutboxRows):
    """``OutboxRows`` over packed rows, which bring the digests of their key, id and meaning."""

    def handleInputRows(self, key, rows, timerValues):
        self.load()
        runs = PackedRuns(self.order)
        try:
            for frame in rows:
                for data in frame["packed"]:
                    table = runs.add(data)
                    for name in ("event_mark", "key_mark"):
                        self.held.see_all(b"".join(table[name].to_pylist()))
            self.ready()
            for table in map(self._stepped, runs):
                yield pd.DataFrame({"packed": [packed(table.slice(start, end - start))
                                               for start, end in parts(table, PACKED_ROWS)]})
        finally:
            runs.close()
        self.save()

    def _stepped(self, table: pa.Table) -> pa.Table:
        marks = [table[n].to_pylist() for n in ("key_mark", "event_mark", "meaning_mark")]
        own = [table[n].to_pylist() for n in ("head", "tail")]
        held = [table[n].to_pylist() for n in ("sequence", "previous_hash", "event_hash", "row_error")]
        found = [self._chain(*mark, *text) if event[0] is None else self._take_over(*mark, *event)
                 for mark, text, event in zip(zip(*marks), zip(*own), zip(*held))]
        fields = self.output.fields
        made = table.select([f.name for f in fields[:-4]])
        for field, values in zip(fields[-4:], zip(*found)):
            kind = pa.int64() if field.dataType.typeName() == "long" else pa.string()
            made = made.append_column(field.name, pa.array(values, kind))
        return made

"""State of the stream processors: calls to the state store, packed records, rows in order."""
import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from veriledge import schemas as S
from veriledge.streaming import stateful, streams


class Store:
    """A map and a value state that count their calls."""

    def __init__(self):
        self.maps, self.values, self.calls = {}, {}, 0

    def getMapState(self, name, *_):
        held = self.maps.setdefault(name, {})

        def get(key):
            self.calls += 1
            return held.get(key)

        def put(key, value):
            self.calls += 1
            held[key] = value
        return SimpleNamespace(getValue=get, updateValue=put)

    def getValueState(self, name, *_):
        def get():
            self.calls += 1
            return self.values.get(name)

        def put(value):
            self.calls += 1
            self.values[name] = value
        return SimpleNamespace(get=get, update=put)


def test_outbox_state_is_not_called_for_every_row():
    """Batches of 3,000 rows, half of the later ones replays, conflicts or taken ids."""
    schema = S.flat("event_id string, occurred_at string, tenant_id string, job_id string, "
                    "aggregate_type string, aggregate_id string, event_type string, payload string, "
                    "idempotency_key string, sequence bigint, meaning string, head string, "
                    "tail string, turn bigint")
    out = S.flat("event_id string, occurred_at string, tenant_id string, job_id string, "
                 "aggregate_type string, aggregate_id string, event_type string, payload string, "
                 "idempotency_key string, sequence bigint, previous_hash string, event_hash string, "
                 "problem string")
    store, rnd, keys, ids = Store(), random.Random(1), {}, set()
    sequence = 0
    for batch in range(3):
        rows = []
        for n in range(3000):
            number = batch * 3000 + n
            key, event = number, number
            if batch and n % 2:
                key = rnd.randrange(number) if n % 4 == 1 else key
                event = rnd.randrange(number) if n % 8 == 3 else event
            meaning = f"m{key}" if n % 3 else "other"
            rows.append({**dict.fromkeys(schema.fieldNames(), "x"), "event_id": f"e{event}",
                         "idempotency_key": f"k{key}", "sequence": None, "meaning": meaning,
                         "turn": number})
        processor = stateful.OutboxRows(schema, ("turn",), out)
        processor.init(store)
        store.calls = 0
        rnd.shuffle(rows)
        got = {}
        for row in processor.handleInputRows(("t",), iter(rows), None):
            got.setdefault((row["event_id"], row["idempotency_key"]), []).append(
                (row["problem"], row["sequence"]))
        assert store.calls < 200
        want = {}
        for row in sorted(rows, key=lambda r: r["turn"]):
            name = (row["event_id"], row["idempotency_key"])
            if name[1] in keys:
                problem = "replay" if keys[name[1]] == row["meaning"] else "idempotency_conflict"
            else:
                problem = "duplicate_event_id" if name[0] in ids else ""
            if not problem:
                sequence += 1
                keys[name[1]] = row["meaning"]
                ids.add(name[0])
            want.setdefault(name, []).append((problem, None if problem else sequence))
        assert got == want


def test_states_of_small_machines_share_entries():
    schema = S.flat("job_id string, at bigint")
    machine = streams.Machine(lambda _: 0, lambda n, _: (n + 1, (n + 1,)), ("at",),
                              S.flat("seen bigint"))
    store, seen = Store(), []
    for at in (1, 2):
        processor = stateful.MachineRows(schema, ("job_id",), ("at",), S.flat(
            "job_id string, seen bigint"), machine, ("job_id",))
        processor.init(store)
        store.calls = 0
        rows = [{"job_id": f"j{n}", "at": at} for n in range(1000)]
        seen.append({r["job_id"]: r["seen"] for r in processor.handleInputRows(
            (0,), iter(rows), None)})
        assert store.calls <= 2 * stateful.PARTS
    assert set(seen[0].values()) == {1} and set(seen[1].values()) == {2}


@pytest.mark.parametrize("held", [3, 100])
def test_rows_beyond_memory_keep_their_order(monkeypatch, held):
    monkeypatch.setattr(stateful, "HELD_ROWS", held)
    runs = stateful.SortedRuns(["a", "b"], ("a",))
    for n in range(50):
        runs.add({"a": None if n % 7 == 0 else n % 5, "b": n})
    rows = [(r["a"], r["b"]) for r in runs]
    runs.close()
    assert rows == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_records_grow_by_levels(monkeypatch):
    monkeypatch.setattr(stateful, "BUCKET_RECORDS", 4)
    monkeypatch.setattr(stateful, "NEW_RECORDS", 50)
    store, count = Store(), 0
    for batch in range(4):
        records = stateful.Records(store)
        records.begin(count)
        fresh = [stateful.digest(b"k", f"{batch}-{n}") for n in range(120)]
        old = [stateful.digest(b"k", f"{b}-{n}") for b in range(batch) for n in range(120)]
        records.see(*fresh, *old)
        records.ready()
        assert all(records.get(d) == bytes(16) for d in old)
        assert all(records.get(d) is None for d in fresh)
        for item in fresh:
            records.put(item)
        records.flush()
        count = records.count
    assert count == 480 and len(store.maps["records"]) > 30


MARKS = {"event_mark": (b"i", "event_id"), "key_mark": (b"k", "idempotency_key"), "meaning_mark": (b"m", "meaning")}
READY = ("event_id string, occurred_at string, tenant_id string, job_id string, aggregate_type string, "
         "aggregate_id string, event_type string, payload string, idempotency_key string, "
         "sequence bigint, previous_hash string, event_hash string")


def packs(rows, order, names, batch=50):
    """What the packer makes of rows that come as some Arrow batches."""
    kinds = {"sequence": pa.int64(), "turn": pa.int64(), "created_at": pa.float64()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
    batches = [pa.RecordBatch.from_pylist(rows[i:i + batch], schema) for i in range(0, len(rows), batch)]
    return list(stateful.packer(("tenant_id", "job_id"), order, MARKS)(iter(batches)))


@pytest.mark.parametrize("held, each", [(65_536, 4096), (64, 16), (10, 3)])
def test_packed_rows_are_chained_like_single_rows(monkeypatch, held, each):
    """Rows of a key reach the state in packs, as one where they are few; its layout stays as it was."""
    for name, value in {"PACK_ROWS": held, "PACKED_ROWS": each, "RUN_BLOCK": each, "MERGED_BLOCKS": 2}.items():
        monkeypatch.setattr(stateful, name, value)
    schema = S.flat(READY + ", created_at double, row_error string, meaning string, head string, tail string, "
                    "turn bigint")
    out = S.flat(READY + ", problem string")
    order, rnd, stores, number = ("turn", "created_at", "event_id"), random.Random(5), (Store(), Store()), 0
    for step in range(3):
        rows = []
        for n in range(400):
            number += 1
            key = rnd.randrange(number) if n % 5 == 1 else number
            event = rnd.randrange(number) if n % 7 == 3 else number
            rows.append({**dict.fromkeys(schema.fieldNames()), "event_id": f"e{event}", "payload": None if n % 4 else "é" * n,
                         "tenant_id": "t", "job_id": "j", "idempotency_key": f"k{key}", "row_error": "",
                         "meaning": f"m{key}" if n % 3 else "other", "head": "{", "tail": "}", "turn": number,
                         "created_at": None if n % 2 else float(n)})
        if not step:  # the ledger held an event before
            rows[0] |= {"sequence": 1, "turn": 1, "event_hash": "h" * 64}
        rnd.shuffle(rows)
        single = stateful.OutboxRows(schema, order, out)
        single.init(stores[0])
        want = [tuple(r) for r in single.handleInputRows(("t", "j"), iter(rows), None)]
        made = packs(rows, order, schema.fieldNames())
        if held > 64:
            assert sum(b.num_rows for b in made) == 1
        # The state of single rows is gone on with by packed ones.
        kind = stateful.PackedOutbox if step else stateful.OutboxRows
        processor = kind(schema, order, out)
        processor.init(stores[1])
        if not step:
            list(processor.handleInputRows(("t", "j"), iter(rows), None))
            continue
        frames = processor.handleInputRows(("t", "j"), (b.to_pandas() for b in made), None)
        got = [tuple(r.values()) for b in stateful.unpack(
            pa.RecordBatch.from_pandas(f, preserve_index=False) for f in frames) for r in b.to_pylist()]
        assert got == want
    assert stores[0].maps == stores[1].maps and stores[0].values == stores[1].values
    assert {r[-1] for r in want} == {"", "replay", "idempotency_conflict", "duplicate_event_id"}


def test_packs_have_one_key_and_few_bytes(monkeypatch):
    monkeypatch.setattr(stateful, "PACKED_BYTES", 4000)
    names = [c.split()[0] for c in READY.split(", ")] + ["meaning"]
    rows = [{**dict.fromkeys(names), "tenant_id": (None, "a", "b")[n % 3], "job_id": "j", "event_id": f"e{n:03}",
             "payload": "x" * (9000 if n == 30 else 40)} for n in range(200)]
    made = packs(rows, ("event_id",), names)
    seen = []
    for batch in made:
        for tenant, data in zip(batch["tenant_id"].to_pylist(), batch["packed"].to_pylist()):
            table = stateful.unpacked(data)
            events = table["event_id"].to_pylist()
            assert set(table["tenant_id"].to_pylist()) == {tenant} and events == sorted(events)
            assert len(events) == 1 or sum(len(p) for p in table["payload"].to_pylist()) <= 4000
            seen += events
    assert sorted(seen) == [r["event_id"] for r in rows] and sum(b.num_rows for b in made) < 30

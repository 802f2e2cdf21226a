"""Ledgers: building, tampering, replays, conflicts, bindings."""
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veriledge.functions import scalars as fn
from veriledge.functions.contracts import violation_codes
from veriledge.operators import ledger
from veriledge.sources import ledgers as source


def events(spark, rows):
    return spark.createDataFrame(
        [(f"e{i}", "2024-01-01T00:00:00+00:00", "t", job, "claim", agg, "made", payload, key, i)
         for i, (job, agg, payload, key) in enumerate(rows)],
        "event_id string, occurred_at string, tenant_id string, job_id string, "
        "aggregate_type string, aggregate_id string, event_type string, payload string, "
        "idempotency_key string, n long")


def python_hash(row):
    value = {k: row[k] for k in (
        "schema_version", "sequence", "event_id", "occurred_at", "tenant_id", "job_id",
        "aggregate_type", "aggregate_id", "event_type", "idempotency_key", "previous_hash")}
    value["payload"] = json.loads(row["payload"])
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


PAYLOADS = ['{"b": 1.0, "a": "é\\n\\"x"}', '{"x": -0.0}', '{"y": 1e-05, "z": 12345678901234567890}',
            '{"emoji": "\\ud83d\\ude00", "\\uff5e": 1, "nested": {"k": [1, 2.50, null, true]}}',
            '{"previous_hash": "\\"previous_hash\\":", "schema_version": 1}']


def build(spark, partitions=None):
    rows = [("j1" if i % 3 else "j2", f"a\"{i}", p, f"k{i}")
            for i, p in enumerate(PAYLOADS * 4)]
    return ledger.build_ledger(events(spark, rows), ["n"], partitions=partitions)


@pytest.mark.parametrize("partitions", [1, 6])
def test_chain_hashes_equal_plain_python(spark, partitions):
    rows = build(spark, partitions).orderBy("job_id", "sequence").collect()
    heads = {}
    for row in rows:
        assert row["previous_hash"] == heads.get(row["job_id"], "")
        assert row["event_hash"] == python_hash(row.asDict())
        heads[row["job_id"]] = row["event_hash"]
    receipts = {r["job_id"]: r for r in ledger.verify_chain(build(spark)).collect()}
    assert all(r["ok"] for r in receipts.values())
    assert {j: r["head_hash"] for j, r in receipts.items()} == heads


def test_fingerprint_keeps_number_spellings_and_the_place_of_nulls(spark):
    df = spark.createDataFrame(
        [("t", "j", "a", None, "x", '{"x": 1.0, "b": 1e-05}'), ("t", "j", None, "a", "x", "{}"),
         ("t", "j", "a", "i", "x", '{"x": 1}')],
        "tenant_id string, job_id string, aggregate_type string, aggregate_id string, "
        "event_type string, payload string")
    texts = [r[0] for r in df.select(fn.semantic_fingerprint_json()).collect()]
    for text, row in zip(texts, df.collect()):
        value = {**row.asDict(), "payload": json.loads(row["payload"])}
        assert text == json.dumps(value, sort_keys=True, separators=(",", ":"))
    digests = [r[0] for r in df.select(fn.semantic_fingerprint()).collect()]
    assert digests == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


@pytest.mark.parametrize("change, code", [
    (lambda df: df.where("sequence <> 3"), "sequence_gap"),
    (lambda df: df.withColumn("payload", F.when(F.col("sequence") == 2, F.lit('{"x":1}'))
                              .otherwise(F.col("payload"))), "event_hash_mismatch"),
    (lambda df: df.unionByName(df.where("sequence = 1")), "sequence_repeated"),
    (lambda df: df.withColumn("event_id", F.lit("same")), "duplicate_event_id"),
    (lambda df: df.withColumn("previous_hash", F.when(F.col("sequence") == 4, F.lit("0" * 64))
                              .otherwise(F.col("previous_hash"))), "previous_hash"),
])
def test_tampering_is_found(spark, change, code):
    receipts = ledger.verify_chain(change(build(spark).drop("violations"))).collect()
    assert all(not r["ok"] and r["event_count"] == 0 and r["head_hash"] == "" for r in receipts)
    assert any(code in r["error"] for r in receipts)


def test_replay_conflict_and_continuation(spark):
    first = ledger.build_ledger(events(spark, [
        ("j", "a", '{"v":1}', "k1"), ("j", "a", '{"v": 1}', "k1"), ("j", "a", '{"v":2}', "k2"),
        ("j", "b", '{"v":2}', "k2")]), ["n"])
    rows = first.collect()
    assert len(rows) == 2
    refused = [r for r in rows if r["violations"]]
    assert [r["idempotency_key"] for r in refused] == ["k2"]
    assert refused[0]["sequence"] is None
    kept = first.where(F.size("violations") == 0).drop("violations")
    receipts = ledger.verify_chain(kept)
    more = ledger.build_ledger(
        events(spark, [("j", "a", '{"v":3}', "k3")]).withColumn("event_id", F.lit("late")),
        ["n"], receipts).drop("violations")
    both = kept.unionByName(more)
    assert ledger.verify_chain(both).first()["event_count"] == 2
    stale = ledger.build_ledger(
        events(spark, [("j", "a", "{}", "k4")]), ["n"], receipts,
        spark.createDataFrame([("t", "j", "nope")],
                              "tenant_id string, job_id string, expected_head string"))
    assert stale.select(violation_codes().alias("v")).first()["v"] == "head_mismatch"


def test_read_ledger_files(spark, tmp_path):
    built = build(spark).drop("violations")
    for row in built.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(
            "sequence", F.to_json(F.struct(*built.columns)).alias("line")))).alias("l")).collect():
        target = tmp_path / "t" / row["job_id"]
        target.mkdir(parents=True)
        lines = []
        for item in row["l"]:
            value = json.loads(item["line"])
            value["payload"] = json.loads(value["payload"])
            lines.append(json.dumps(value, ensure_ascii=False))
        (target / "events.jsonl").write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    back = source.read_ledgers(spark, str(tmp_path))
    assert {(r["path_tenant"], r["path_job"]) for r in back.collect()} == {("t", "j1"),
                                                                          ("t", "j2")}
    assert all(r["ok"] for r in ledger.verify_chain(back).collect())


def ledger_lines(spark):
    """Lines of one ledger with numbers that the JVM would spell differently."""
    rows = [("j", "a", p, f"k{i}") for i, p in enumerate(['{"v":1.0}', '{"w":1e-05}', '{"x":3}'])]
    lines = []
    for row in ledger.build_ledger(events(spark, rows), ["n"]).orderBy("sequence").collect():
        value = {k: row[k] for k in row.asDict() if k != "violations"}
        value["payload"] = json.loads(value["payload"])
        lines.append(json.dumps(value, sort_keys=True, separators=(",", ":")))
    return lines


@pytest.mark.parametrize("change, error", [
    (lambda lines: lines, ""),
    (lambda lines: lines + [lines[-1][:50]], "line_invalid"),
    (lambda lines: lines[:2] + ['{"extra":1,' + lines[2][1:]], "line_invalid"),
    (lambda lines: [lines[0], lines[1] + " {}", lines[2]], "line_invalid"),
    (lambda lines: [x.replace('"job_id":"j"', '"job_id":"k"') for x in lines], "line_invalid"),
])
def test_only_exact_envelopes_make_a_ledger(spark, tmp_path, change, error):
    target = tmp_path / "t" / "j"
    target.mkdir(parents=True)
    (target / "events.jsonl").write_text("\n".join(change(ledger_lines(spark))), encoding="utf-8")
    receipts = ledger.verify_chain(source.read_ledgers(spark, str(tmp_path))).collect()
    assert len(receipts) == 1 and receipts[0]["job_id"] == "j"
    assert receipts[0]["ok"] == (not error) and error in receipts[0]["error"]


def test_held_keys_ids_and_broken_ledgers_are_respected(spark):
    batch = [("j", "a", '{"v":1}', "k1"), ("j", "a", '{"v":2}', "k2")]
    held = ledger.build_ledger(events(spark, batch), ["n"]).drop("violations")
    receipts = ledger.verify_chain(held)
    assert ledger.build_ledger(events(spark, batch), ["n"], receipts, held=held).count() == 0
    mixed = events(spark, [("j", "a", '{"v":1}', "k1"), ("j", "b", '{"v":2}', "k2"),
                           ("j", "a", '{"v":9}', "k9")]).withColumn(
        "event_id", F.concat(F.lit("new"), "event_id"))
    rows = {r["idempotency_key"]: r for r in
            ledger.build_ledger(mixed, ["n"], receipts, held=held).collect()}
    assert set(rows) == {"k2", "k9"} and rows["k9"]["sequence"] == 3
    assert [v["code"] for v in rows["k2"]["violations"]] == ["idempotency_conflict"]
    taken = ledger.build_ledger(events(spark, [("j", "a", "{}", "k7")]), ["n"], receipts, held=held)
    assert taken.select(violation_codes().alias("v")).first()["v"] == "duplicate_event_id"
    broken = ledger.verify_chain(held.withColumn("event_hash", F.lit("0" * 64)))
    refused = ledger.build_ledger(mixed, ["n"], broken, held=held).collect()
    assert all("ledger_invalid" in [v["code"] for v in r["violations"]] for r in refused)
    assert all(r["sequence"] is None for r in refused)


def test_outbox_is_dispatched_once(spark):
    outbox = spark.createDataFrame(
        [(f"o{i}", "t", "policy.x", "strategy", "s", "{}", f"k{i}", float(i), None)
         for i in range(3)],
        "event_id string, tenant_id string, event_type string, aggregate_type string, "
        "aggregate_id string, payload string, idempotency_key string, created_at double, "
        "dispatched_at double")
    empty = spark.createDataFrame([], "tenant_id string, idempotency_key string")
    first = ledger.flush_outbox(outbox, empty, "policy").drop("violations")
    assert [r["sequence"] for r in first.orderBy("sequence").collect()] == [1, 2, 3]
    assert ledger.flush_outbox(outbox, first, "policy").count() == 0
    marked = ledger.mark_dispatched(outbox, first, 9.0)
    assert marked.where("dispatched_at = 9.0").count() == 3


def test_exact_canonical_json(spark):
    df = spark.createDataFrame([(p,) for p in PAYLOADS] + [("not json",)], "p string")
    for row in df.select("p", fn.canonical_json("p", "exact").alias("c")).collect():
        if row["p"] == "not json":
            assert row["c"] is None
        else:
            assert row["c"] == json.dumps(json.loads(row["p"]), ensure_ascii=False,
                                          sort_keys=True, separators=(",", ":"))

"""How much work ledgers cost: partitions of a fold, and how often events are made."""
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.operators import ledger
from veriledge.sources import ledgers


def _events(spark, n, jobs=1):
    return spark.range(n).select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("j"), F.col("id") % jobs).alias("job_id"),
        F.concat(F.lit("e"), "id").alias("event_id"),
        F.lit("2024-01-01T00:00:00+00:00").alias("occurred_at"), F.lit("a").alias("aggregate_type"),
        F.lit("b").alias("aggregate_id"), F.lit("c").alias("event_type"),
        F.concat(F.lit('{"k":'), "id", F.lit("}")).alias("payload"),
        F.concat(F.lit("key"), "id").alias("idempotency_key"), F.col("id").alias("n"))


def test_small_ledger_needs_few_partitions_and_rounds(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    try:
        built = ledger.build_ledger(_events(spark, 2_000), ["n"])
        assert built.rdd.getNumPartitions() < 24
        wide = ledger.build_ledger(_events(spark, 2_000), ["n"], partitions=24)
        assert sorted(built.collect()) == sorted(wide.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_events_are_made_once_for_all_rules_of_a_ledger(spark):
    events = ledger.build_ledger(_events(spark, 300, jobs=3), ["n"], partitions=4).drop("violations")
    rows = events.collect()
    made = spark.sparkContext.accumulator(0)

    def counted(row):
        made.add(1)
        return row

    read = spark.createDataFrame(
        spark.sparkContext.parallelize(rows, 4).map(counted), events.schema)
    assert all(r["ok"] for r in ledger.verify_chain(read).collect())
    assert made.value == 300


def test_folder_names_are_those_of_the_pattern(spark):
    pattern = r"(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?([^/]+)/[^/]+\.(?:jsonl|txt)$"
    paths = ["file:/a/b/t/j/e.jsonl", "file:///r=1/t=x/j=y/e.txt", "s3://b/t=/=j/e.jsonl",
             "file:/a/t=x=y/j=/e.x.jsonl", "file:/a/%20t/j%2F=k/events-0.jsonl"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(
        F.regexp_extract("p", pattern, 1).alias("a"), F.regexp_extract("p", pattern, 2).alias("b"),
        ledgers._folder(F.col("p"), 2).alias("c"), ledgers._folder(F.col("p"), 1).alias("d"))
    for row in rows.collect():
        assert (row["a"], row["b"]) == (row["c"], row["d"])


def test_ledger_files_come_back_by_parts(spark, tmp_path):
    events = ledger.build_ledger(_events(spark, 40, jobs=3), ["n"], partitions=2)
    line = F.to_json(F.struct(*S.EVENT.fieldNames()), {"ignoreNullFields": "false"})
    root = str(tmp_path / "l")
    lines = events.select("tenant_id", "job_id", F.floor(F.col("sequence") / 5).alias("part"),
                          line.alias("value"))
    assert ledgers.write_ledger_files(lines, root) == 9
    back = ledgers.read_ledgers(spark, root)
    found = {r["job_id"]: r["event_count"] for r in ledger.verify_chain(back).collect()}
    assert found == {"j0": 14, "j1": 13, "j2": 13}
    with pytest.raises(Exception, match="not a folder name"):
        ledgers.write_ledger_files(lines.withColumn("job_id", F.lit("..")), root)


def test_single_keys_are_neither_grouped_nor_joined(spark, monkeypatch):
    """Keys and ids are counted as numbers; without repeats the rows move once, to their places."""
    monkeypatch.setattr(ledger, "idempotent_dedup", None)
    plans, kept = [], ledger.ordered_fold
    monkeypatch.setattr(ledger, "ordered_fold",
                        lambda df, *a: plans.append(df) or kept(df, *a))
    built = ledger.build_ledger(_events(spark, 400, jobs=4), ["n"])
    assert built.where(F.size("violations") == 0).count() == 400
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_neighbours_across_blocks_gaps_and_repeats(spark):
    from veriledge.operators.ledger import _with_neighbours

    rows = [("t", "j", n, f"h{n}") for n in (65_534, 65_535, 65_536, 65_537, 65_540, -1, 0, 1)]
    rows += [("t", "j", 65_535, "a"), ("t", "k", 65_536, "x"), ("t", None, 1, "y"),
             ("t", "j", None, "z"), ("t", "j", None, "w"), ("t", "j", 2**63 - 1, "top"),
             ("t", "j", -(2**63), "low")]
    found = {(r[0], r[1], r[2], r[3]): (r[4], r[5]) for r in _with_neighbours(spark.createDataFrame(
        rows, "tenant_id string, job_id string, sequence bigint, event_hash string")).collect()}
    assert len(found) == len(rows)
    for row in rows:
        peers = [r for r in rows if None not in row[:3] and r[:3] == row[:3]]
        prior = [r[3] for r in rows if None not in row[:3] and r[2] is not None
                 and r[:2] == row[:2] and r[2] + 1 == row[2]]
        assert found[row] == (min(prior, default=None), max(len(peers), 1)), row


def test_quotes_need_no_printer_and_odd_numbers_chain_alike(spark):
    rows = [('a"b\\c', '{"x":1.0,"a":[1e5,-0.0]}'), ("é\n\t", '{"b":1}'), ("", '{"s":"\\u00e9"}')]
    raw = spark.createDataFrame([(f"e{i}", name, payload, i) for i, (name, payload) in
                                 enumerate(rows)], "event_id string, aggregate_id string, "
                                "payload string, n bigint").select(
        F.lit("t").alias("tenant_id"), F.lit("j").alias("job_id"), "event_id",
        F.lit("2024-01-01T00:00:00+00:00").alias("occurred_at"), F.lit("a").alias("aggregate_type"),
        "aggregate_id", F.lit("c").alias("event_type"), "payload",
        F.concat(F.lit('key"'), "event_id").alias("idempotency_key"), "n")
    previous = ""
    for row in ledger.build_ledger(raw, ["n"]).orderBy("sequence").collect():
        event = {k: v for k, v in row.asDict().items() if k not in ("event_hash", "violations")}
        event["payload"] = json.loads(row["payload"])
        text = json.dumps(event, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert row["previous_hash"] == previous
        assert row["event_hash"] == hashlib.sha256(text.encode()).hexdigest()
        previous = row["event_hash"]
    assert row["sequence"] == 3


def test_repeats_among_many_keep_the_first_and_its_conflicts(spark):
    rows = _events(spark, 200, jobs=4)
    again = rows.where("n % 10 = 0").withColumns({
        "n": F.col("n") + 1_000, "event_id": F.concat(F.lit("r"), "event_id"),
        "aggregate_id": F.when(F.col("n") % 20 == 0, "other").otherwise(F.col("aggregate_id"))})
    same = rows.where("n = 7").withColumns({"n": F.lit(5_000).cast("bigint"),
                                            "idempotency_key": F.lit("another")})
    built = ledger.build_ledger(rows.union(again).union(same), ["n"]).collect()
    codes = {r["event_id"] + r["idempotency_key"]: [v["code"] for v in r["violations"]]
             for r in built}
    assert len(built) == 201
    bad = {k for k, v in codes.items() if v}
    assert bad == {f"e{n}key{n}" for n in range(0, 200, 20)} | {"e7key7", "e7another"}
    assert codes["e0key0"] == ["idempotency_conflict"]
    assert codes["e7key7"] == ["duplicate_event_id"]

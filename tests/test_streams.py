"""Stateful streams against their batch twins, over several micro-batches and in any order."""
import pytest
from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions.contracts import violation_codes
from veriledge.operators import graph, jobs, ledger
from veriledge.plans.bindings import Tables
from veriledge.streaming import stateful, streams

EVENT_COLUMNS = ("event_id string, occurred_at string, tenant_id string, job_id string, "
                 "aggregate_type string, aggregate_id string, event_type string, payload string, "
                 "idempotency_key string, n long")


def streamed(spark, folder, *parts):
    """A stream with one micro-batch per part."""
    session = stateful.state_session(spark)
    for number, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/part={number}")
    return (session.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(f"{folder}/in"))


def drained(spark, folder, stream):
    streams.run_available_now(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def chain(spark, count=40):
    rows = [(f"e{i}", "2024-01-01T00:00:00+00:00", "t", f"j{i % 2}", "claim", "a", "made",
             f'{{"x": {i}.0}}', f"k{i}", i) for i in range(count)]
    return ledger.build_ledger(spark.createDataFrame(rows, EVENT_COLUMNS), ["n"]).drop("violations")


@pytest.mark.parametrize("held", [4096, 3])
def test_chain_in_any_order_over_batches(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(stateful, "HELD_ROWS", held)
    log = chain(spark).cache()
    parts = [log.where("sequence <= 9").orderBy(F.desc("sequence")), log.where("sequence > 9")]
    rows = drained(spark, tmp_path, streams.stream_verify_chain(streamed(spark, tmp_path, *parts)))
    got = {(r["job_id"], r["sequence"]): (r["ok"], r["verified"]) for r in rows.collect()}
    assert got == {(f"j{k}", s): (True, s) for k in (0, 1) for s in range(1, 21)}


@pytest.mark.parametrize("change, error", [
    (lambda df: df.where("NOT (job_id = 'j0' AND sequence = 5)"), "sequence_gap"),
    (lambda df: df.unionByName(df.where("job_id = 'j0' AND sequence = 4")), "sequence_repeated"),
    (lambda df: df.withColumn("payload", F.when(F.expr("job_id = 'j0' AND sequence = 5"), F.lit("{}"))
                              .otherwise(F.col("payload"))), "event_hash_mismatch"),
])
def test_first_break_of_a_chain_is_final(spark, tmp_path, change, error):
    rows = drained(spark, tmp_path, streams.stream_verify_chain(
        streamed(spark, tmp_path, change(chain(spark))))).collect()
    assert all(r["ok"] for r in rows if r["job_id"] == "j1")
    bad = [r for r in rows if not r["ok"]]
    assert bad and {r["error"] for r in bad} == {error} and {r["verified"] for r in bad} == {4}
    assert {r["sequence"] for r in rows if r["ok"] and r["job_id"] == "j0"} == {1, 2, 3, 4}


@pytest.mark.parametrize("field, error", [("event_id", "duplicate_event_id"),
                                          ("idempotency_key", "duplicate_idempotency_key")])
def test_chain_remembers_ids_and_keys_of_earlier_batches(spark, tmp_path, field, error):
    import hashlib
    import json

    first = chain(spark, 6).where("job_id = 'j0'").orderBy("sequence").collect()
    last = first[-1].asDict()
    value = {n: last[n] for n in S.EVENT.fieldNames() if n != "event_hash"}
    value.update(sequence=4, previous_hash=last["event_hash"], event_id="new", idempotency_key="new",
                 payload=json.loads(last["payload"]))
    value[field] = first[0][field]
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    row = {**value, "payload": last["payload"],
           "event_hash": hashlib.sha256(text.encode()).hexdigest()}
    more = spark.createDataFrame([tuple(row[n] for n in S.EVENT.fieldNames())], S.EVENT)
    old = spark.createDataFrame(first).select(*S.EVENT.fieldNames())
    rows = drained(spark, tmp_path, streams.stream_verify_chain(
        streamed(spark, tmp_path, spark.createDataFrame(old.rdd, S.EVENT), more))).collect()
    assert {r["sequence"]: r["error"] for r in rows} == {1: "", 2: "", 3: "", 4: error}


def test_claim_rules_equal_the_batch_rules(spark, tmp_path, folder):
    """All rules, broken and whole ledgers, replays; events after a stop are not judged."""
    log = Tables(spark, folder).claim_log
    n = F.substring_index("job_id", "j", -1).cast("int")
    broken = (log.withColumn("payload", F.when((n % 5 == 0) & (F.col("sequence") == 4), F.lit("{}"))
                             .when((n % 7 == 0) & (F.col("sequence") == 3),
                                   F.regexp_replace("payload", '"query_id":"[^"]*"', '"query_id":"?"'))
                             .otherwise(F.col("payload")))
              .where(~((n % 11 == 0) & (F.col("sequence") == 2)))).cache()
    replay = broken.where("sequence = 1").withColumn("sequence", F.lit(3).cast("bigint"))
    projected = graph.claim_projection(broken)
    stop = graph.first_violation(projected).select("job_id", F.col("sequence").alias("stop"))
    want = {r["event_id"]: (r["applied"], r["codes"]) for r in projected.join(stop, "job_id", "left")
            .select("event_id", "applied", F.when(F.col("sequence") <= F.coalesce("stop", F.lit(1 << 40)),
                                                  violation_codes()).alias("codes")).collect()}
    rows = drained(spark, tmp_path, streams.stream_claim_state(streamed(
        spark, tmp_path, broken.where("sequence <= 3").unionByName(replay.limit(2)),
        broken.where("sequence > 3"))))
    got = {r["event_id"]: (r["applied"], r["codes"]) for r in rows.where("NOT replayed").collect()}
    assert got.keys() == want.keys()
    assert len({c for _, c in want.values() if c}) >= 4
    for event, (applied, codes) in want.items():
        assert got[event] == (applied, ",".join(sorted((codes or "").split(",")))), event
    states = {(r["job_id"], r["claim_id"]): r["state"] for r in graph.claim_states(projected).collect()}
    last = rows.where("applied AND state IS NOT NULL").groupBy("job_id", "claim_id").agg(
        F.max_by("state", "sequence").alias("state")).collect()
    assert {(r["job_id"], r["claim_id"]): r["state"] for r in last} == states


def outbox(spark, rows):
    return spark.createDataFrame(
        [(f"o{i}", tenant, "policy", "a", "made", payload, key, float(at), None)
         for i, tenant, payload, key, at in rows],
        "event_id string, tenant_id string, aggregate_type string, aggregate_id string, "
        "event_type string, payload string, idempotency_key string, created_at double, "
        "dispatched_at double")


def read_events(spark, path):
    return spark.read.schema(S.EVENT).option("recursiveFileLookup", "true").parquet(path)


def test_outbox_goes_on_from_its_state_and_refuses_conflicts(spark, tmp_path):
    session = stateful.state_session(spark)
    source, target = f"{tmp_path}/in", f"{tmp_path}/ledger"
    first = outbox(spark, [(1, "t", '{"a":1.0}', "k1", 2), (2, "t", "{}", "k2", 1), (3, "u", "{}", "k1", 1)])
    first.coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = session.readStream.schema(first.schema).parquet(source)
        streams.stream_outbox(stream, target, f"{tmp_path}/state", "policy").awaitTermination()
        return {(r["tenant_id"], r["sequence"]): r["event_id"] for r in read_events(spark, target).collect()}

    assert run() == {("t", 1): "o2", ("t", 2): "o1", ("u", 1): "o3"}
    assert len(run()) == 3
    again = outbox(spark, [(1, "t", '{"a":1.0}', "k1", 2), (4, "t", '{"a":1}', "k1", 3),
                           (2, "t", "{}", "k9", 4), (5, "t", "{}", "k5", 5)])
    again.coalesce(1).write.mode("append").parquet(source)
    assert run() == {("t", 1): "o2", ("t", 2): "o1", ("u", 1): "o3", ("t", 3): "o5"}
    assert all(r["ok"] for r in ledger.verify_chain(read_events(spark, target)).collect())
    refused = spark.read.option("recursiveFileLookup", "true").parquet(f"{target}-refused").collect()
    assert sorted(r["problem"] for r in refused) == ["duplicate_event_id", "idempotency_conflict"]


def test_outbox_takes_over_a_held_ledger(spark, tmp_path):
    held = ledger.flush_outbox(outbox(spark, [(1, "t", "{}", "k1", 1), (2, "u", "{}", "k1", 1)]),
                               spark.createDataFrame([], S.EVENT), "policy").drop("violations")
    held = held.withColumn("payload", F.when(F.col("tenant_id") == "u", F.lit('{"x":1}'))
                           .otherwise(F.col("payload")))
    held.write.parquet(f"{tmp_path}/held")
    more = outbox(spark, [(1, "t", "{}", "k1", 1), (3, "t", "{}", "k3", 1), (4, "u", "{}", "k4", 1)])
    more.write.parquet(f"{tmp_path}/in")
    session = stateful.state_session(spark)
    streams.stream_outbox(
        session.readStream.schema(more.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ledger",
        f"{tmp_path}/state", "policy",
        session.readStream.schema(S.EVENT).parquet(f"{tmp_path}/held")).awaitTermination()
    rows = read_events(spark, f"{tmp_path}/ledger").collect()
    assert [(r["tenant_id"], r["sequence"], r["event_id"]) for r in rows] == [("t", 2, "o3")]


def test_negative_and_missing_usage_is_refused(spark, tmp_path):
    charges = spark.createDataFrame(
        [("j", "k1", "p", 8, 0, 0, 1), ("j", "k2", "p", 8, 0, 0, 2), ("j", "k3", "p", -7, 0, 0, 3),
         ("i", "k1", "p", 1, None, 0, 1), ("i", "k2", "p", 1, 0, 0, 2), ("h", "k1", "p", 10, 0, 0, 1)],
        "job_id string, charge_key string, provider string, calls long, tokens long, "
        "cost_microunits long, at long")
    budgets = spark.createDataFrame([(j, 10, 10, 10) for j in "jih"],
                                    "job_id string, max_calls long, max_tokens long, max_cost_microunits long")
    want = {("j", "k1"): "", ("j", "k2"): "calls", ("j", "k3"): "invalid_calls", ("i", "k1"): "invalid_tokens",
            ("i", "k2"): "", ("h", "k1"): ""}
    got = {(r["job_id"], r["charge_key"]): (r["admitted"], r["exceeded"])
           for r in jobs.budget_admission(charges, budgets, ["at"]).collect()}
    assert got == {k: (v == "", v) for k, v in want.items()}
    log = charges.join(budgets, "job_id")
    rows = drained(spark, tmp_path, streams.stream_budget_admission(
        streamed(spark, tmp_path, log.where("at < 2"), log.where("at >= 2")), ["charge_key"], ["at"]))
    assert {(r["job_id"], r["charge_key"]): (r["admitted"], r["exceeded"]) for r in rows.collect()} == got

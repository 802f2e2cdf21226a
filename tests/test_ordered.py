"""Ordered folds against a plain loop, with a hot key that spans many partitions."""
import random

import pytest
from pyspark.sql import functions as F

from veriledge.operators import jobs, service
from veriledge.operators.ordered import _incoming_states, ordered_fold, prefix_scan
from veriledge.session import materialise


def loop(rows, machine, keys, order):
    out, state = {}, {}
    for row in sorted(rows, key=lambda r: [r[o] for o in order]):
        key = tuple(row[k] for k in keys)
        if key not in state:
            state[key] = machine.start(row)
        state[key], outputs = machine.step(state[key], row)
        out[row["n"]] = outputs
    return out


def skewed_requests(n=3000, seed=5):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for i in range(n):
        at += rng.choice([0.01, 0.2, 3.0])
        hot = rng.random() < 0.6
        rows.append({"tenant_id": "t", "principal_id": "hot" if hot else f"p{i % 7}",
                     "at": at, "n": i})
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_token_bucket_matches_loop_for_any_partitioning(spark, partitions):
    rows = skewed_requests()
    machine = service.token_bucket_machine(60, 3)
    wanted = loop(rows, machine, ["tenant_id", "principal_id"], ["at", "n"])
    found = service.token_bucket(spark.createDataFrame(rows).repartition(5), ["at", "n"], 60, 3,
                                 partitions=partitions).collect()
    assert len(found) == len(rows)
    for row in found:
        allowed, retry, left = wanted[row["n"]]
        assert (row["allowed"], row["retry_after"]) == (allowed, retry)
        assert row["tokens_left"] == pytest.approx(left)


@pytest.mark.parametrize("partitions", [1, 8])
def test_circuit_matches_loop(spark, partitions):
    rng = random.Random(1)
    rows = [{"circuit_id": "hot" if i % 3 else f"c{i % 5}", "operation_id": f"o{i % 4}",
             "kind": rng.choice(["before", "success", "failure"]), "reason_code": "r",
             "at": float(i), "n": i} for i in range(1200)]
    machine = service.circuit_machine(2, 5.0, 7.0)
    wanted = loop(rows, machine, ["circuit_id"], ["at", "n"])
    found = service.circuit_states(spark.createDataFrame(rows), ["at", "n"], 2, 5.0, 7.0,
                                   partitions=partitions).collect()
    for row in found:
        assert (row["verdict"], row["prior_state"], row["next_state"], row["event_type"]) == \
            wanted[row["n"]][:4]


def test_hot_key_is_split_over_partitions(spark):
    df = spark.createDataFrame(skewed_requests())
    log = materialise(df.repartitionByRange(12, "tenant_id", "principal_id", "at")
                      .sortWithinPartitions("tenant_id", "principal_id", "at"))
    holders = log.where("principal_id = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert holders >= 5
    states = _incoming_states(log, ["tenant_id", "principal_id"],
                              service.token_bucket_machine(60, 3))
    assert len(states) >= holders - 1


def test_budget_rejects_and_lets_smaller_charges_pass(spark):
    charges = spark.createDataFrame(
        [("j", "a", "p", 1, 400, 0, 1.0), ("j", "b", "p", 1, 700, 0, 2.0),
         ("j", "c", "p", 1, 600, 0, 3.0), ("j", "a", "p", 1, 400, 0, 4.0),
         ("k", "a", "p", 1, 1, 1, 1.0)],
        "job_id string, charge_key string, provider string, calls long, tokens long, "
        "cost_microunits long, created_at double")
    budget = spark.createDataFrame([("j", 10, 1000, 10), ("k", 1, 1, 1)],
                                   "job_id string, max_calls long, max_tokens long, "
                                   "max_cost_microunits long")
    found = {(r["job_id"], r["charge_key"]): r["admitted"]
             for r in jobs.budget_admission(charges, budget, ["created_at"]).collect()}
    assert found == {("j", "a"): True, ("j", "b"): False, ("j", "c"): True, ("k", "a"): True}


def test_budget_settled_and_contested_jobs_agree_with_loop(spark):
    rng = random.Random(3)
    rows = [{"job_id": f"j{i % 9}", "charge_key": str(i), "provider": "p",
             "calls": rng.randint(0, 3), "tokens": rng.randint(0, 50),
             "cost_microunits": rng.randint(0, 9), "created_at": float(i), "n": i}
            for i in range(900)]
    limits = {f"j{k}": (10_000, 10_000 if k % 2 else 900, 300) for k in range(9)}
    budget = spark.createDataFrame([(j, *v) for j, v in limits.items()],
                                   "job_id string, max_calls long, max_tokens long, "
                                   "max_cost_microunits long")
    used, wanted = {}, {}
    for r in rows:
        u = used.setdefault(r["job_id"], [0, 0, 0])
        after = [u[0] + r["calls"], u[1] + r["tokens"], u[2] + r["cost_microunits"]]
        ok = all(a <= m for a, m in zip(after, limits[r["job_id"]]))
        wanted[r["n"]] = ok
        if ok:
            used[r["job_id"]] = after
    found = jobs.budget_admission(spark.createDataFrame(rows), budget, ["created_at"],
                                  partitions=7).collect()
    assert {r["n"]: r["admitted"] for r in found} == wanted


def test_prefix_scan_equals_window(spark):
    df = spark.range(1, 2001).select(
        F.lit("k").alias("k"), F.col("id").alias("seq"),
        ((F.col("id") * 7919) % 1009).alias("x"))
    got = prefix_scan(df, ["k"], "seq", {
        "hi": ("max", F.col("x")), "total": ("sum", F.col("x"))}, width=64)
    best, total = None, None
    rows = got.orderBy("seq").collect()
    for row in rows:
        assert (row["hi"], row["total"]) == (best, total)
        best = row["x"] if best is None else max(best, row["x"])
        total = (total or 0) + row["x"]


def test_lease_cycle(spark):
    log = spark.createDataFrame(
        [("j", 1, "acquire", "w1", 0.0), ("j", 2, "acquire", "w2", 5.0),
         ("j", 3, "heartbeat", "w1", 9.0), ("j", 4, "acquire", "w2", 30.0),
         ("j", 5, "heartbeat", "w1", 31.0)],
        "job_id string, n long, kind string, worker_id string, at double").withColumn(
        "lease_seconds", F.lit(10.0)).withColumn("status", F.lit("RUNNING"))
    found = jobs.lease_audit(log, ["n"]).orderBy("n").collect()
    assert [r["problem"] for r in found] == ["", "leased_elsewhere", "", "",
                                             "heartbeat_rejected"]
    assert found[-1]["attempts"] == 2


def test_fold_on_empty_input(spark):
    df = spark.createDataFrame([], "tenant_id string, principal_id string, at double, n long")
    assert ordered_fold(df, ["tenant_id", "principal_id"], ["at"],
                        service.token_bucket_machine()).count() == 0


@pytest.mark.parametrize("reshape", [
    lambda df: df.coalesce(1), lambda df: df.coalesce(3), lambda df: df.repartition(4),
    lambda df: df.where("n < 0").union(df)])
def test_results_do_not_depend_on_how_they_are_read(spark, reshape):
    rows = skewed_requests()
    machine = service.token_bucket_machine(60, 3)
    wanted = loop(rows, machine, ["tenant_id", "principal_id"], ["at", "n"])
    found = reshape(service.token_bucket(spark.createDataFrame(rows), ["at", "n"], 60, 3,
                                         partitions=12)).collect()
    assert len(found) == len(rows)
    assert all(row["allowed"] == wanted[row["n"]][0] for row in found)

"""Recall of strategies against plain loops."""
import random

import pytest
from pyspark.sql import functions as F

from veriledge.operators import policy

STRATEGIES = ("tenant_id string, strategy_id string, source_task_family string, status string, "
              "evaluations bigint, created_at double")
APPLIED = "application_id string, strategy_id string, target_task_family string"
ASKED = "tenant_id string, target_task_family string"


def _store(seed, strategies, families, applied):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(families)] + [None]
    rows = [(rng.choice(("a", "a", "b", None)), f"s{i:04d}", rng.choice(names),
             rng.choice(("CANDIDATE", "CANDIDATE", "ACTIVE")), rng.randrange(3),
             float(rng.randrange(4))) for i in range(strategies)]
    used = [(f"x{i}", rng.choice(rows)[1], rng.choice(names)) for i in range(applied)]
    asked = [(tenant, name) for tenant in ("a", "b", "c", None) for name in names]
    return rows, used, asked + asked[:3]


def _plain(rows, used, asked):
    seen = {(s, f) for _, s, f in used}
    return [(row, family) for tenant, family in asked for row in rows
            if tenant is not None and row[0] == tenant and row[2] is not None
            and family is not None and row[2] != family and (row[1], family) not in seen]


@pytest.mark.parametrize("places", [2, 4_096])
def test_first_candidate_of_every_family(spark, monkeypatch, places):
    monkeypatch.setattr(policy, "_PLACES", places)
    rows, used, asked = _store(5, 40, 5, 160)
    # One family has seen every candidate, one all but the last in order.
    mine = sorted((r for r in rows if r[0] == "a" and r[3] == "CANDIDATE" and r[2]),
                  key=lambda r: (r[4], r[5], r[1]))
    used += [(f"y{i}", r[1], "all") for i, r in enumerate(mine)]
    used += [(f"z{i}", r[1], "last") for i, r in enumerate(mine[:-1])]
    asked += [("a", "all"), ("a", "last"), ("a", "new")]
    best = {}
    for row, family in _plain(rows, used, asked):
        if row[3] == "CANDIDATE":
            key = (row[0], family)
            best[key] = min(best.get(key, (9, 9.0, "z")), (row[4], row[5], row[1]))
    found = policy.recall_candidate(
        spark.createDataFrame(rows, STRATEGIES), spark.createDataFrame(used, APPLIED),
        spark.createDataFrame(asked, ASKED)).collect()
    assert {(r["tenant_id"], r["target_task_family"]): (
        r["evaluations"], r["created_at"], r["strategy_id"]) for r in found} == best
    assert ("a", "all") not in best and best["a", "last"][2] == mine[-1][1]
    assert len(found) == len(best) and {r["rank"] for r in found} == {1}


def test_counts_of_unseen_families(spark):
    rows, used, asked = _store(6, 30, 6, 120)
    rows.append(rows[0])
    frames = (spark.createDataFrame(rows, STRATEGIES), spark.createDataFrame(used, APPLIED),
              spark.createDataFrame(asked, ASKED))
    expected = {}
    for row, _ in _plain(rows, used, asked):
        expected[row[1]] = expected.get(row[1], 0) + 1
    found = policy.unseen_counts(*frames).groupBy("strategy_id").agg(F.sum("unseen").alias("n"))
    assert {r["strategy_id"]: r["n"] for r in found.collect()} == expected
    pairs = policy.unseen_family(*frames).groupBy("strategy_id").count()
    assert {r["strategy_id"]: r["count"] for r in pairs.collect()} == expected


def test_empty_store(spark):
    rows, used, asked = (spark.createDataFrame([], s) for s in (STRATEGIES, APPLIED, ASKED))
    assert policy.recall_candidate(rows, used, asked).count() == 0
    assert policy.unseen_counts(rows, used, asked).count() == 0

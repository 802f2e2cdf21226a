"""Claim graphs: single rules, and set form against a step-by-step fold on random logs."""
import json
import random
from functools import reduce

from pyspark.sql import functions as F

from veriledge import schemas as S
from veriledge.functions.contracts import violation_codes
from veriledge.operators import graph

SHA = "a" * 64


def log(spark, steps, job="j"):
    rows = [("t", job, i + 1, f"e{i}", kind, json.dumps(payload))
            for i, (kind, payload) in enumerate(steps)]
    return spark.createDataFrame(rows, "tenant_id string, job_id string, sequence long, "
                                 "event_id string, event_type string, payload string")


def claim(c="c"):
    return ("claim.proposed", {"claim_id": c, "text": "x", "scope": "s"})


def asked(q, intent, c="c"):
    return ("query.executed", {"query_id": q, "claim_id": c, "text": "x", "intent": intent,
                               "n_hits": 1})


def seen(p, q, **extra):
    return ("passage.observed", {"passage_id": p, "doc_id": "d", "query_id": q, "offset": 0,
                                 "content_sha256": SHA, **extra})


def linked(p, relation, c="c"):
    return ("evidence.linked", {"claim_id": c, "passage_id": p, "relation": relation})


def moved(state, boundary=None, c="c"):
    value = {"claim_id": c, "to_state": state, "reason": "r"}
    return ("claim.transitioned", value | ({"boundary": boundary} if boundary else {}))


SUPPORT = [claim(), asked("q1", "support"), seen("p1", "q1"), linked("p1", "SUPPORTS"),
           moved("SUPPORTED")]
FULL = [*SUPPORT, asked("q2", "counterevidence"), moved("CHALLENGED"), moved("SURVIVED", "b")]


def test_complete_path_survives_and_publishes(spark):
    projected = graph.claim_projection(log(spark, FULL))
    assert projected.where(~F.col("applied")).count() == 0
    state = graph.claim_states(projected).first()
    assert (state["state"], state["boundary"], state["version"]) == ("SURVIVED", "b", 4)
    assert graph.publication_issues(log(spark, FULL), graph.claim_states(projected)).count() == 0
    metrics = graph.graph_metrics(projected).first()
    assert (metrics["claims"], metrics["queries"], metrics["claims_survived"]) == (1, 2, 1)


RULES = [
    ([claim(), claim()], "claim_exists"),
    ([asked("q", "support")], "unknown_claim"),
    ([claim(), asked("q", "rumour")], "intent"),
    ([claim(), asked("q", "support"), asked("q", "support")], "query_exists"),
    ([claim(), seen("p", "q")], "unknown_query"),
    ([claim(), asked("q", "support"), seen("p", "q", offset=None)], "locator_missing"),
    ([claim(), asked("q", "support"), seen("p", "q", offset=True)], "locator_value"),
    ([claim(), asked("q", "support"), seen("p", "q", content_sha256="x")], "content_sha256"),
    ([claim(), linked("p", "SUPPORTS")], "unknown_passage"),
    ([claim(), claim("d"), asked("q", "support"), seen("p", "q"), linked("p", "SUPPORTS", "d")],
     "foreign_passage"),
    ([claim(), asked("q", "counterevidence"), seen("p", "q"), linked("p", "SUPPORTS")],
     "support_intent"),
    ([claim(), asked("q", "support"), seen("p", "q"), linked("p", "CONTRADICTS")],
     "counter_intent"),
    ([*SUPPORT[:4], linked("p1", "SUPPORTS")], "duplicate_edge"),
    ([claim(), moved("SUPPORTED")], "supported_without_edge"),
    ([claim(), moved("CHALLENGED")], "challenged_without_query"),
    ([*FULL[:7], moved("SURVIVED")], "boundary"),
    ([*FULL[:7], moved("NARROWED", "b")], "narrowed_without_edge"),
    ([*FULL[:7], moved("REFUTED")], "refuted_without_edge"),
    ([*FULL, moved("UNRESOLVED")], "illegal_transition"),
    ([claim(), moved("SURVIVED", "b")], "illegal_transition"),
    ([("claim.proposed", {"claim_id": "c", "text": ""})], "missing_claim.proposed"),
]


def test_every_rule_stops_its_ledger(spark):
    frames = [log(spark, steps, f"j{i}") for i, (steps, _) in enumerate(RULES)]
    projected = graph.claim_projection(reduce(lambda a, b: a.unionByName(b), frames))
    stopped = {r["job_id"]: r for r in graph.first_violation(projected).collect()}
    for i, (steps, code) in enumerate(RULES):
        assert stopped[f"j{i}"]["sequence"] == len(steps), code
        assert code in stopped[f"j{i}"]["codes"].split(",")


def plain_fold(steps):
    """Number of events a step-by-step reading applies before it has to stop."""
    claims, queries, passages, edges = {}, {}, {}, set()
    for count, (kind, p) in enumerate(steps):
        c = p.get("claim_id")
        if kind == "claim.proposed":
            ok = c not in claims
            claims.setdefault(c, "PROPOSED")
        elif kind == "query.executed":
            ok = c in claims and p["query_id"] not in queries
            queries.setdefault(p["query_id"], (c, p["intent"]))
        elif kind == "passage.observed":
            ok = p["query_id"] in queries and p["passage_id"] not in passages
            passages.setdefault(p["passage_id"], p["query_id"])
        elif kind == "evidence.linked":
            edge = (c, p["passage_id"], p["relation"])
            ok = c in claims and p["passage_id"] in passages and edge not in edges
            if ok:
                owner, intent = queries[passages[p["passage_id"]]]
                wanted = {"SUPPORTS": "support", "CHECKED": intent}.get(
                    p["relation"], "counterevidence")
                ok = owner == c and intent == wanted
                edges.add(edge)
        else:
            target = p["to_state"]
            mine = {r for (k, _, r) in edges if k == c}
            counter = any(k == c and i == "counterevidence" for k, i in queries.values())
            need = {"SUPPORTED": "SUPPORTS" in mine, "CHALLENGED": counter,
                    "SURVIVED": "SUPPORTS" in mine and counter and bool(p.get("boundary")),
                    "NARROWED": "BOUNDS" in mine and bool(p.get("boundary")),
                    "REFUTED": bool({"CONTRADICTS", "PRECEDENT_FOR"} & mine)}
            ok = (c in claims and target in S.CLAIM_TRANSITIONS.get(claims[c], ())
                  and need.get(target, True))
            if ok:
                claims[c] = target
        if not ok:
            return count
    return len(steps)


def test_set_form_equals_fold_on_random_logs(spark):
    rng = random.Random(11)
    frames, wanted = [], {}
    for k in range(60):
        names = ["c1", "c2"]
        steps = [claim("c1"), claim("c2")]
        for i in range(14):
            c = rng.choice(names)
            steps.append(rng.choice([
                asked(f"q{rng.randint(0, 9)}", rng.choice(["support", "counterevidence"]), c),
                seen(f"p{i}", f"q{rng.randint(0, 9)}"),
                linked(f"p{rng.randint(0, i)}", rng.choice(S.RELATIONS), c),
                moved(rng.choice(S.CLAIM_STATES), "b", c)]))
        # Keep the longest legal prefix and a few events after it, so that logs get deep.
        while (stop := plain_fold(steps)) < len(steps) and rng.random() < 0.9:
            del steps[stop]
        wanted[f"j{k}"] = plain_fold(steps)
        frames.append(log(spark, steps, f"j{k}"))
    everything = frames[0]
    for frame in frames[1:]:
        everything = everything.unionByName(frame)
    projected = graph.claim_projection(everything.repartition(5))
    found = {r["job_id"]: r["n"] for r in projected.groupBy("job_id").agg(
        F.count_if("applied").alias("n")).collect()}
    assert found == wanted


def test_finalize(spark):
    receipts = spark.createDataFrame(
        [("t", "ok", True, 1, "h", ""), ("t", "open", True, 1, "h", ""),
         ("t", "torn", False, 0, "", "sequence 1")],
        "tenant_id string, job_id string, ok boolean, event_count long, head_hash string, "
        "error string")
    events = log(spark, FULL, "ok").unionByName(log(spark, SUPPORT, "open")).unionByName(
        log(spark, FULL, "torn"))
    found = {r["job_id"]: (r["status"], r["first_issue"])
             for r in graph.finalize_jobs(events, receipts=receipts).collect()}
    assert found == {"ok": ("SUCCEEDED", None),
                     "open": ("FAILED", "c: non-terminal state SUPPORTED"),
                     "torn": ("FAILED", "ledger: sequence 1")}


def test_replayed_event_is_skipped(spark):
    steps = log(spark, FULL)
    again = steps.where("sequence = 1").withColumn("sequence", F.lit(20).cast("bigint"))
    projected = graph.claim_projection(steps.unionByName(again))
    assert projected.select(violation_codes().alias("v")).where("v <> ''").count() == 0

import re

import pytest

from veriledge.llm import mixing


def fill(sizes, weights):
    """Targets by sharing the excess again and again."""
    target = {s: 0.0 for s in sizes}
    left, open_ = float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        unit = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += unit * weights[s]
            if target[s] >= 3 * sizes[s] - 1e-12:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets_and_words_per_source(spark, documents):
    rows = []
    for s, n in (("a", 40), ("b", 300), ("ä", 3), (None, 500), ("c", 2)):
        rows += [(len(rows) + i, "w " * ((i * 37) % 50 + 1), None, s) for i in range(n)]
    rows += [(9000, None, None, "b"), (9001, "", None, "a"), (9002, " \t\n", None, "empty")]
    got = mixing.mix(documents(rows).repartition(7)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 50


def test_reruns_agree_and_hot_sources_split(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = [(i, "w " * (i % 9 + 1), None, "hot" if i % 3 else "s%d" % (i % 5)) for i in range(900)]
    docs = documents(rows)
    a = sorted(map(tuple, mixing.mix(docs.repartition(11)).collect()), key=repr)
    b = sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=repr)
    assert a == b and len(a) == 900
    hot = [r for r in a if r[6] == "hot"]
    assert abs(sum(r[4] for r in hot) - hot[0][3]) <= 9


def test_copies_are_unbiased(spark):
    import pandas as pd

    total = 0.0
    for seed in range(200):
        draws = pd.Series(range(40)).map(lambda i: hash((seed, i)) % 10_007 / 10_007)
        group = pd.DataFrame({"p": 0.3, "size": [1 + i % 7 for i in range(40)], "draw": draws,
                              "row_key": range(40)})
        done = mixing._settle(group)
        assert (done.p * done["size"]).sum() == pytest.approx(0.3 * group["size"].sum())
        assert ((done.p > 0) & (done.p < 1)).sum() <= 1
        total += done.p.mean()
    assert 0.27 < total / 200 < 0.33


def test_repeated_rows_empty_table_and_rows_of_the_mix(spark, documents):
    assert mixing.mix(documents([])).collect() == []
    docs = documents([(1, "a b", None, "s"), (1, "a b", None, "s"), (2, "c", None, None), (None, "d d", None, "t")])
    docs = docs.selectExpr("*", "'x' AS copies", "1 AS k", "2 AS place")
    mixed = mixing.mix(docs)
    out = mixing.repeated(docs, mixed)
    assert out.columns == docs.columns
    assert out.count() == mixed.groupBy().sum("copies").first()[0]

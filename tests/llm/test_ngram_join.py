import random

import numpy as np
import pytest

from veriledge.llm import ngram_join as nj
from veriledge.llm.common import components


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, num, den):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def corpus(seed, size=160):
    """Copies, near copies in chains, a passage that many share, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    passage = [word() for _ in range(55)]
    texts = []
    for _ in range(size):
        kind = rng.random()
        if texts and kind < 0.45:
            words = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randrange(0, max(2, len(words) // 12))):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
        elif kind < 0.7:
            own = [word() for _ in range(rng.randrange(5, 120))]
            texts.append(" ".join(own + passage))
        elif kind < 0.75:
            texts.append(rng.choice([None, "", "A", "a", "a b", "A\tB", "\x1c", " x\n"]))
        else:
            texts.append(" ".join(word() for _ in range(rng.randrange(1, 200))))
    return list(enumerate(texts))


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("seed,n,num,den", [(1, 3, 90, 100), (2, 5, 80, 100), (3, 2, 70, 100)])
def test_components_equal_brute_force(documents, seed, n, num, den):
    rows = corpus(seed)
    docs = documents([(i, t, None, None) for i, t in rows]).repartition(5)
    assert result(nj.ngram_join(docs, n, num, den)) == brute(rows, n, num, den)


def test_blocks_of_large_buckets_lose_nothing(documents, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 300)
    monkeypatch.setattr("veriledge.llm.common.SENT_BYTES", 0)
    rows = corpus(4, 90)
    docs = documents([(i, t, None, None) for i, t in rows])
    assert result(nj.ngram_join(docs)) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_connect_what_brute_force_links(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 90, 60)) for _ in range(4)]
    sets = []
    for _ in range(70):
        mine = base[rng.integers(4)]
        sets.append(np.unique(np.r_[rng.choice(mine, int(len(mine) * 0.9), replace=False),
                                    rng.integers(100, 140, rng.integers(0, 6))]).astype(np.uint64))
    want = components_of(len(sets), [
        (a, b) for a in range(len(sets)) for b in range(a)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))])
    assert components_of(len(sets), nj.bucket_links(sets, 80, 100)) == want


def components_of(n, links):
    name = list(range(n))
    for _ in range(n):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    return name


def test_shingles_split_at_ascii_space_only_and_lower_only_ascii():
    sets = list(nj.Shingler(3).sets(["A\x0bb\x1cc d É", "a b\x1cc d É", "a b\x1cc d é", None, " \t", "a b", "A  b"]))
    assert [len(s) for s in sets] == [2, 2, 2, 0, 0, 1, 1]
    assert (sets[0] == sets[1]).all() and not (sets[1] == sets[2]).all() and sets[5] == sets[6]
    long = " ".join("v%d" % (i % 777) for i in range(300_000))
    assert len(next(nj.Shingler(3).sets([long]))) == 777


def test_rows_without_id_repeated_rows_and_empty_table(documents):
    text = "a b c d e f g"
    docs = documents([(3, text, None, None), (3, text, None, None), (1, text, None, None), (None, text, None, None),
                      (None, "other words here", None, None), (None, None, None, None)])
    docs = docs.selectExpr("*", "'x' AS k", "1 AS n", "2 AS row")
    got = sorted(map(tuple, nj.ngram_join(docs).collect()), key=repr)
    assert got == sorted([(3, 5, 1), (3, 5, 1), (1, 5, 1), (None, 5, 1), (None, 1, None), (None, 0, None)], key=repr)
    kept = nj.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == sorted(
        [(1, text), (None, "other words here"), (None, None)], key=repr)
    assert nj.ngram_join(documents([])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    assert {r["component"] for r in components(links, "a", "b").collect()} == {0}
    assert components(links.where("a < 0"), "a", "b").collect() == []


def test_sketches_never_rule_out_a_pair_at_the_threshold():
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100)):
        sets = []
        for _ in range(60):
            base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64) * np.uint64(2))
            sets.append(base)
            for _ in range(2):
                keep = base[rng.random(len(base)) < rng.choice([0.99, 0.93, 0.85, 0.7])]
                more = rng.integers(0, 1 << 63, rng.integers(0, 1 + len(base) // 12)).astype(np.uint64)
                sets.append(np.unique(np.r_[keep, more]))
        sets = sorted((s for s in sets if len(s)), key=len)
        alive = nj.plausible(np.array([len(s) for s in sets]), [nj.sketch(s) for s in sets], num, den)
        linked = {x for a in range(len(sets)) for b in range(a) for x in (a, b)
                  if den * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))}
        assert linked and all(alive[i] for i in linked)
        assert alive.sum() < len(sets)

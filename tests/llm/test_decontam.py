import random

import numpy as np

from veriledge.llm import decontam as dc


def brute_distance(item, words):
    best = len(item)
    row = [0] * (len(words) + 1)
    for i, s in enumerate(item):
        new = [i + 1]
        for j, w in enumerate(words):
            new.append(min(row[j] + (s != w), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(best, *row)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = "zz%d" % rng.randrange(99)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "yy")
    return words


def setting(spark, seed=1):
    rng = random.Random(seed)
    items = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(12, 60))] for _ in range(40)]
    bench = spark.createDataFrame([(i, " ".join(w).title()) for i, w in enumerate(items)]
                                  + [(100, None), (101, ""), (102, "?!")], "item_id long, text string")
    return rng, items, bench


def test_exact_edit_distance_with_free_ends():
    rng = np.random.default_rng(1)
    for _ in range(300):
        item = rng.integers(0, 5, rng.integers(1, 12))
        words = rng.integers(0, 5, rng.integers(0, 25))
        want = brute_distance(item.tolist(), words.tolist())
        got = dc.best_match(item, words, len(item))
        assert got[0] == want
        piece = words[got[1]:got[2]]
        row = list(range(len(piece) + 1))
        for i, s in enumerate(item):
            new = [i + 1]
            for j, w in enumerate(piece):
                new.append(min(row[j] + (s != w), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert row[-1] == want


def test_recall_at_the_threshold_and_no_false_hit(spark, documents):
    rng, items, bench = setting(spark)
    rows, planted = [], {}
    for d in range(240):
        host = [f"h{rng.randrange(500)}" if rng.random() < 0.6 else f"w{rng.randrange(300)}" for _ in range(150)]
        if d % 2:
            m = rng.randrange(len(items))
            part = edited(rng, items[m], rng.randrange(dc.max_edits(len(items[m]), dc.SHARE) + 1))
            at = rng.randrange(len(host))
            host[at:at] = part
            planted[d] = m
        rows.append((d, ", ".join(host), None, None))
    docs = documents(rows)
    got = dc.contaminated(docs, bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert sum((d, m) in pairs for d, m in planted.items()) >= 0.95 * len(planted)
    assert all(d in planted for d, _ in pairs)
    texts = {i: [w.lower() for w in dc.WORDS.findall(t)] for i, t, _, _ in rows}
    for r in got:
        words = texts[r["doc_id"]][r["first_word"]:r["end_word"]]
        assert brute_distance(items[r["item_id"]], words) <= r["edits"] <= dc.max_edits(r["item_words"], dc.SHARE)
    clean = dc.without_benchmark(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, *_ in rows} - {d for d, _ in pairs}


def test_nulls_repeats_long_texts_and_empty_tables(spark, documents):
    rng, items, bench = setting(spark, 2)
    hit = " ".join(items[0])
    docs = documents([(1, None, None, None), (2, "", None, None), (3, hit, None, None), (3, hit, None, None),
                      (None, hit, None, None), (5, "h " * 100_000 + hit, None, None)])
    docs = docs.selectExpr("*", "1 AS item_id", "2 AS edits")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in dc.contaminated(docs, bench).collect())
    assert got == [(0, 0), (3, 0), (3, 0), (5, 0)]
    assert dc.contaminated(docs, bench.where("item_id > 99")).collect() == []
    assert dc.contaminated(documents([]), bench).collect() == []


def test_word_hashes_follow_the_words_of_the_pattern():
    texts = ["", "Ab_c d", "İstanbul ΣΑΣ ſ", "x\n\ty", "١٢ 中文,字", "😀a😀", "_", "ab_c D" * 3, "éa"]
    hashes, borders = dc.WordHasher(dc.letters()).words(texts)
    seen = {}
    for i, text in enumerate(texts):
        words = dc.WORDS.findall(text.lower())
        mine = hashes[borders[i]:borders[i + 1]].tolist()
        assert len(mine) == len(words)
        for w, h in zip(words, mine):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_null_and_negative_item_ids_and_blocks(spark, documents, monkeypatch):
    rng, items, _ = setting(spark, 3)
    text = " ".join(items[0])
    bench = spark.createDataFrame([(None, text), (-1, text), (5, " ".join(items[1])), (5, text)],
                                  "item_id long, text string")
    docs = documents([(1, text, None, None), (2, "nothing here", None, None)])
    want = [(1, None), (1, -1), (1, 5)]
    got = [(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(dc, "SENT", 100)
    got = [(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [r["doc_id"] for r in dc.without_benchmark(docs, bench).collect()] == [2]


def test_walks_need_no_tables():
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50_000, 60))) for i in range(2000)]
    held = dc.prepare(rows, dc.SHARE, 12)
    bits = sum(len(w) for *_, walks in held.classes for w in walks)
    assert bits == 3 * 12 * len(held.classes)

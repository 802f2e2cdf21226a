import random

import numpy as np

from veriledge.llm import lang_id, subwords, toxicity

WORDS = {"aa": "alo bero cima doru".split(), "bb": "xen yuk zor weft".split(), "çç": "ñandú über été ção".split()}


def text(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "."]) for _ in range(n))


def test_held_out_accuracy_and_unknown_texts(documents):
    rng = random.Random(1)
    rows = [(i, text(rng, lang), lang, "s") for i, lang in enumerate(rng.choices(sorted(WORDS), k=240))]
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "123 !!", "bb", "s"),
             (903, "ben", None, "s"), (904, text(rng, "bb", 60_000), "bb", "s")]
    docs = documents(rows).selectExpr("*", "1 AS score", "'x' AS lang_pred", "'y' AS rejected")
    got = {r["doc_id"]: r for r in lang_id.language_ids(docs, per_language=40).collect()}
    assert len(got) == len(rows)
    held = [i for i, r in got.items() if r["held_out"] and i < 900]
    assert len(held) > 40
    assert sum(got[i]["lang_pred"] == dict((r[0], r[2]) for r in rows)[i] for i in held) == len(held)
    for i in (900, 901, 902):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[904]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got.values())
    model = lang_id.fit(lang_id.training_rows(docs, 40))
    kept = lang_id.identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id < 900").count() == 240


def test_folds_are_checksums_of_the_key_text(spark):
    import zlib

    from pyspark.sql import functions as F

    for r in spark.range(50).withColumn("h", lang_id.held_out(F.col("id"), 3, 1)).collect():
        assert r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1)


def test_no_language_and_no_rows(documents):
    docs = documents([(1, "abc", None, None)])
    assert lang_id.language_ids(docs).first()["lang_pred"] == "und"
    assert lang_id.language_ids(documents([])).collect() == []


def test_pieces_of_a_long_text_count_every_window_once(monkeypatch):
    rng = random.Random(2)
    texts = [text(rng, "çç", 300), "", None, text(rng, "aa", 5)]

    def counted():
        out = []
        for points, owner in subwords.blocks(texts):
            for n in (2, 3, 5):
                bucket, own = subwords.grams(points, owner, n, 1 << 16)
                out += list(zip(own.tolist(), [n] * len(own), bucket.tolist()))
        return sorted(out)

    whole = counted()
    monkeypatch.setattr(subwords, "PIECE", 64)
    assert counted() == whole


def test_ngrams_of_a_text_do_not_depend_on_its_neighbours():
    def counted(texts):
        out = {i: [] for i in range(len(texts))}
        for points, owner in subwords.blocks(texts):
            for n in (2, 3):
                for b, i in zip(*(x.tolist() for x in subwords.grams(points, owner, n, 1 << 16))):
                    out[i].append((n, b))
        return out

    texts = ["a", "ab cd", "", "é", "xyz."]
    together = counted(texts)
    for i, alone in enumerate(texts):
        assert counted([alone])[0] == together[i]
    assert together[0]


def toxic_rows(spark, documents, n=500):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = text(rng, rng.choice(["aa", "bb"]), 60).split()
        if bad:
            words[rng.randrange(60)] = rng.choice(["Grumpf,", "SKRONK", "vlarg."])
        rows.append((i, " ".join(words), "aa", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(9000, None, None, None), (9001, "", None, None), (9000, None, None, None)]
    labels += [(9000, 0, 0), (None, 0, 1), (3, None, None)]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxic_texts_score_high_held_out(spark, documents):
    docs, labels, known = toxic_rows(spark, documents)
    docs = docs.selectExpr("*", "7 AS toxic", "'x' AS score", "'y' AS k")
    got = [tuple(r) for r in toxicity.toxicity(docs, labels).collect()]
    assert len(got) == 503
    truth = {i: t for i, _, t in known if t is not None}
    held = [r for r in got if r[1] and r[0] < 9000]
    right = sum(r[3] == truth[r[0]] for r in held)
    assert len(held) > 60 and right >= 0.97 * len(held)
    assert all(0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.3) for r in got)
    assert [r[3] for r in got if r[0] >= 9000] == [0, 0, 0]


def test_a_fit_does_not_change_with_the_size_of_its_sample(monkeypatch):
    made = np.random.default_rng
    rounds = []

    class Counted:
        def __init__(self, seed):
            self.rng = made(seed)

        def permutation(self, n):
            rounds.append(n)
            return self.rng.permutation(n)

    monkeypatch.setattr(toxicity.np.random, "default_rng", Counted)
    for n in (40, 3_999, 4_000):
        bags = [np.array([i % 2]) for i in range(n)]
        toxicity.fit_linear(bags, [i % 2 for i in range(n)], np.array([-1.0, 1.0] + [0.0] * (toxicity.BUCKETS - 2)), 0.5)
    assert rounds.count(40) == rounds.count(3_999) == rounds.count(4_000) > 0


def test_toxicity_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(documents([(1, "a", None, None)]), none).first()["predicted"] == 0
    assert toxicity.toxicity(documents([]), none).collect() == []


def plain_grams(text, sizes, buckets):
    """Hashed n-grams of one text, one after the other; a word's edge may be first or last."""
    points = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()] + [0]
    out = []
    for n in sizes:
        for i in range(len(points) - n + 1):
            part = points[i:i + n]
            if i == len(points) - 1 or not all(part[1:n - 1]) or not (part[0] or part[-1]):
                continue
            h = n * 0x9E3779B1 & 0xFFFFFFFF
            for p in part:
                h = ((h ^ p) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h % buckets)
    return out


ODD = ["", None, "a", "ab c", "Ünï-cödé 中文 x1y", "one two", "😀 🙂a", "a" * 50, " b", "c "]


def test_counts_and_presence_equal_a_plain_count():
    from collections import Counter

    for i, (ids, weight) in enumerate(lang_id._counts(ODD)):
        want = Counter(plain_grams(ODD[i], lang_id.SIZES, lang_id.BUCKETS))
        total = max(1, sum(want.values()))
        assert ids.tolist() == sorted(want)
        assert np.allclose(weight, [want[b] / total for b in sorted(want)])
    who, bucket = toxicity.presence(ODD)
    want = {(i, b) for i, t in enumerate(ODD) for b in plain_grams(t, toxicity.SIZES, toxicity.BUCKETS)}
    assert set(zip(who.tolist(), bucket.tolist())) == want and len(who) == len(want)


def test_prediction_is_the_mean_of_the_rows_of_the_n_grams():
    rng = np.random.default_rng(3)
    table, bias = rng.normal(size=(lang_id.BUCKETS, 3)).astype(np.float32), rng.normal(size=3)
    names, scores, _ = lang_id.predict(ODD, (["x", "y", "z"], table, bias, 0.7, 0.5))
    for text, name, score in zip(ODD, names, scores):
        grams = plain_grams(text, lang_id.SIZES, lang_id.BUCKETS)
        if not grams:
            assert (name, score) == ("und", 0.0)
            continue
        z = (table[grams].astype(float).mean(axis=0) + bias) / 0.7
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert name == "xyz"[int(p.argmax())] and abs(score - p.max()) < 1e-6


def test_log_ratios_equal_the_formula_bucket_by_bucket():
    import math

    pos, neg = np.array([0, 5, 90, 3, 0]), np.array([0, 80, 1, 3, 40])
    got = toxicity.log_ratios(pos, neg, 100, 200)
    for p, n, r in zip(pos.tolist(), neg.tolist(), got.tolist()):
        ratio = math.log((p + 1) / 102) - math.log((n + 1) / 202)
        left = max(0.0, abs(ratio) - 3 * math.sqrt(1 / (p + 1) + 1 / (n + 1)))
        assert abs(r - math.copysign(left, ratio)) < 1e-12


def test_toxicity_of_very_long_texts(documents, spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["kind", "calm", "nice"]) for _ in range(20))
             + (" vileword" if i % 2 else ""), None, None) for i in range(200)]
    rows += [(500, "calm " * 300_000 + "vileword " * 300_000, None, None), (501, "nice " * 300_000, None, None)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(documents(rows), labels).collect()}
    assert got[500] > got[501]

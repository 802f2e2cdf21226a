"""Quotient filters against dictionaries, phrases against a plain count."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from veriledge.llm import phrases as P
from veriledge.llm import quotient as Q


@pytest.mark.parametrize("word_bits", [1, 2, 7, 20, 21, 22, 31, 42])
def test_packing_and_permutation_are_undone(word_bits):
    rng = np.random.default_rng(word_bits)
    ids = [rng.integers(0, 1 << word_bits, 500, dtype=np.uint64) for _ in range(3)]
    h = Q.half_bits(word_bits)
    left, right = Q.permute(*Q.pack(*ids, word_bits), h)
    assert left.max() < 1 << h and right.max() < 1 << h
    for got, want in zip(Q.unpack(*Q.restore(left, right, h), word_bits), ids):
        assert (got == want).all()


@pytest.mark.parametrize("h, s, n", [(2, 0, 40), (9, 3, 400), (32, 4, 3000), (60, 5, 3000), (8, 0, 0)])
def test_filters_are_lossless_and_merge_by_adding(h, s, n):
    rng = np.random.default_rng(h)

    def shard():
        left, right = (rng.integers(0, 1 << h, n, dtype=np.uint64) for _ in range(2))
        counts = rng.choice(np.array([1, 1, 1, 2, 300, 1 << 40], np.uint64), n)
        return left, right, counts

    truth, slices = Counter(), {}
    for _ in range(3):
        left, right, counts = shard()
        for key, c in zip(zip(left.tolist(), right.tolist()), counts.tolist()):
            truth[key] += c
        for f in Q.sliced(*Q.summed(left, right, counts, h), h, s):
            slices.setdefault(f.slice, []).append(f)
    found = {}
    for filters in slices.values():
        whole = Q.merged(filters)
        left, right, counts = whole.entries()
        order = list(zip(left.tolist(), right.tolist()))
        assert order == sorted(order)
        found.update(zip(order, counts.tolist()))
        for key in order[:20]:
            assert whole.count(*key) == truth[key]
            assert whole.count(key[0], key[1] ^ 1) == truth.get((key[0], key[1] ^ 1), 0)
    assert found == dict(truth)


def plain(rows, least=10, covered=50, top=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = []
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in found.items():
        longer = [b for (other, w), b in found.items() if other == lang and len(w) > len(words)
                  and any(w[i:i + len(words)] == words for i in range(len(w)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        score, _, left, right = min(
            (1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]],
             f[lang, words[k:]]) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        rows = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(rows[:top])]
    return sorted(ranked)


def corpus(seed=3, docs=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "À", "a\x01", "a", "x-ray", " ", "zz"]
    words += [f"w{i}" for i in range(60)]
    seps = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\r\n", "\x0b"]
    out = []
    for i in range(docs):
        text = "".join(rng.choice(words[:rng.choice([6, 12, 72])]) + rng.choice(seps)
                       for _ in range(rng.randint(0, 200)))
        out.append((text, rng.choice(["en", "en", "en", "de", None])))
    return out + [(None, "en"), ("", "de"), ("...", None), ("only", "fr")] + out[:5]


def found(spark, rows, **options):
    df = spark.createDataFrame([(t, lang, i) for i, (t, lang) in enumerate(rows)],
                               "text string, lang string, word long")
    return sorted(tuple(r) for r in P.collocations(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 500}, {"least": 3, "top": 7}])
def test_phrases_equal_a_plain_count(spark, options):
    rows = corpus()
    keep = {k: v for k, v in options.items() if k != "chunk_bytes"}
    want = plain(rows, **keep)
    assert want and found(spark, rows, **options) == want


def test_one_long_text_is_cut_at_pieces(spark):
    text = "alpha beta gamma, " * 40_000 + "tail " * 30
    assert found(spark, [(text, "en")], chunk_bytes=10_000) == plain([(text, "en")])


def test_many_slices_and_wide_word_numbers(spark, monkeypatch):
    rows = corpus(5, 60)
    monkeypatch.setattr(P, "SLICE", 64)
    assert found(spark, rows) == plain(rows)
    monkeypatch.setattr(Q, "half_bits", lambda bits: 60)
    # Halves of 60 bits take the path of keys beyond 64 bits.
    assert found(spark, rows) == plain(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    two = [(1, 2, 0, 3 * 10 ** 12)]
    vocabulary = [("en", "a", 10 ** 13 + 1, 1), ("en", "b", 10 ** 13 + 7, 2)]
    row = P.ranked(spark.createDataFrame(two, "w1 long, w2 long, w3 long, a long"),
                   spark.createDataFrame(vocabulary, "lang string, word string, f long, id long"),
                   spark.createDataFrame([("en", 10 ** 14)], "lang string, n long"), 50, 5).first()
    assert row["score"] == 10 ** 6 * 9 * 10 ** 24 // ((10 ** 13 + 1) * (10 ** 13 + 7))


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert P.collocations(df).collect() == []

"""Merkle manifest: midstates against hashlib, trees and folds against a plain recomputation."""
import hashlib
import zlib

import numpy as np
import pytest

from veriledge.llm import merkle, sha_states


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def proof_and_fold(levels, place, leaf):
    proof = []
    for level in levels[:-1]:
        start = place - place % 16
        run = level[start:start + 16]
        proof += run[:place - start] + run[place - start + 1:]
        leaf = H(*run[:place - start], leaf, *run[place - start + 1:])
        place //= 16
    return proof, leaf


def expected(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    def leaf(row, text):
        return H(field(row[0]), field(row[3]), field(row[2]), field(row[4]), field(text))

    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row, leaf(row, row[1])))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        order = sorted(by_source[name], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        by_source[name], trees[name] = order, levels_of([x[1] for x in order])
    top = levels_of([trees[n][-1][0] for n in names])
    root = top[-1][0]
    out = []
    for rank, name in enumerate(names):
        for place, (row, digest) in enumerate(by_source[name]):
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            proof, new = proof_and_fold(trees[name], place, leaf(row, text))
            more, new = proof_and_fold(top, rank, new)
            out.append((row[0], digest, trees[name][-1][0], root, H(*proof, *more), new, new == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in merkle.tamper_check(df).collect()]


def test_states_equal_hashlib():
    rng = np.random.default_rng(1)
    children = rng.integers(0, 256, (50, 16, 32), dtype=np.uint8)
    counts = rng.integers(1, 17, 50)
    digests, states = sha_states.absorb(children, counts)
    for i in range(50):
        hexes = [children[i, k].tobytes().hex() for k in range(counts[i])]
        assert digests[i].tobytes().hex() == H(*hexes)
        slot = int(rng.integers(0, counts[i]))
        new = rng.integers(0, 256, (1, 32), dtype=np.uint8)
        right = np.zeros((1, 15, 32), np.uint8)
        rest = children[i, slot + 1:counts[i]]
        right[0, :len(rest)] = rest
        got = sha_states.resume(sha_states.from_bytes(states[i, slot:slot + 1]), new, right,
                                np.array([len(rest)]), counts[i:i + 1])
        hexes[slot] = new[0].tobytes().hex()
        assert got[0].tobytes().hex() == H(*hexes)


@pytest.mark.parametrize("sizes", [[1], [16], [1, 17], [300, 2, 33, 1]])
def test_trees_proofs_and_folds_equal_plain_python(spark, sizes):
    rows, i = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            i += 1
            rows.append((i * 7 % 5003, f"Text É {i}" * (i % 3), "en", f"s{s}", i))
    assert sorted(found(spark, rows)) == sorted(expected(rows))


def test_more_than_one_level_of_sources_and_hot_source(spark):
    rows = [(i, "A" * i, None, f"ü{i % 20}" if i % 3 else "hot", 5) for i in range(120)]
    got = found(spark, rows)
    assert sorted(got) == sorted(expected(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_nulls_repeats_and_long_texts(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (None, "A", "x", "y", 1),
            (3, "LONG é " * 200_000, "x", None, 9), (None, None, None, None, None), (5, "ÀB", "x", "", 1)]
    key = repr
    assert sorted(found(spark, rows), key=key) == sorted(expected(rows), key=key)


def test_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(4, "B", "x", "s", 1, 7, "z")],
                               SCHEMA + ", place long, digest string")
    assert [tuple(r) for r in merkle.tamper_check(df).collect()] == expected([(4, "B", "x", "s", 1)])
    assert merkle.tamper_check(df.limit(0)).collect() == []

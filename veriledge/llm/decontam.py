"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit check.

Texts are sequences of normalised words. The CGK random walk maps a sequence to a longer one: at
step j it writes the symbol it stands on and moves on if the j-th random bit of that symbol is
set, so sequences at small edit distance agree in most places. Each repetition has its own bits
and samples a few places of the walk; a window and an item whose samples agree are compared by
exact edit distance.

The random bits of a word are a hash of its number, so a walk needs no tables. Many texts are
coded and walked together as numpy arrays; words meet by 64-bit hashes there, and the edit check
of the documents that have a candidate compares the words themselves.
"""
from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledge.llm.common import giving_back, slices

WORDS = re.compile(r"[^\W_]+")
# Most places sampled per repetition, and the smallest share of edited words that is an error.
SAMPLES, SHARE = 3, 0.15
# Items whose lengths differ by less than this factor share their walks and their windows.
SPREAD = 1.35
# Benchmark bytes that are sent to the executors at once, and characters coded at once.
SENT, TEXT = 4 << 20, 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def letters() -> np.ndarray:
    """One bit per code point: whether it is part of words."""
    return np.packbits(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))


class WordHasher:
    """Hashes of the words of many texts at once, by running sums over code points."""

    BASE = 0x2545F4914F6CDD1D

    def __init__(self, letter_bits: np.ndarray):
        self.letter = np.unpackbits(letter_bits).astype(bool)
        self.powers = np.ones(0, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers = np.full(size, self.BASE, np.uint64)
            self.inverse = np.full(size, pow(self.BASE, -1, 1 << 64), np.uint64)
            self.powers[0] = self.inverse[0] = 1
            self.powers, self.inverse = np.cumprod(self.powers), np.cumprod(self.inverse)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, borders): text i has the hashes from border i to border i + 1."""
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        self._grow(len(points) + 1)
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = self.letter[points]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        values = (points + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        values ^= values >> np.uint64(29)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values * self.powers[:len(points)], out=total[1:])
        hashes = _mix((total[end] - total[start]) * self.inverse[start]
                      + (end - start).astype(np.uint64))
        texts_at = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        return hashes, np.searchsorted(start, texts_at)


def word_codes(text: str, known: dict) -> np.ndarray:
    """A number per word: that of a benchmark word, or 0 for any other."""
    get = known.get
    return np.fromiter((get(w, 0) for w in WORDS.findall(text.lower())), np.int32)


def max_edits(length: int, share: float) -> int:
    return int(length * share)


def move_bits(codes: np.ndarray, salt: int, block: int) -> np.ndarray:
    """The random bits of every word at 64 steps: a hash of the word, the walk and the steps."""
    key = np.uint64((salt + block * 0xD6E8FEB86659FD93) & ((1 << 64) - 1))
    return _mix(codes.astype(np.uint64) + key)


def walk(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int, steps: tuple, items
         ) -> list:
    """Starts whose samples agree with an item's, as (start, items); starts drop out as they fail.

    ``ends`` is the last word that each start may reach. ``items`` is the nested dictionary of
    sampled symbols. All starts walk together, a step at a time; after each sampled step only
    starts that still follow some item go on.
    """
    out = []
    bits = [move_bits(codes, salt, block) for block in range(steps[-1] // 64 + 1)]
    one = np.uint64(1)
    groups = [(starts, starts.copy(), ends, items)]
    before = 0
    for depth, step in enumerate(steps):
        following = []
        for origin, at, end, tree in groups:
            for j in range(before, step):
                move = (bits[j // 64][at] >> np.uint64(j % 64)) & one
                at = np.minimum(at + move.view(np.int64), end)
            seen = codes[at]
            for symbol in set(seen.tolist()) & tree.keys():
                pick = seen == symbol
                if depth + 1 == len(steps):
                    out.append((origin[pick], tree[symbol]))
                else:
                    following.append((origin[pick], at[pick], end[pick], tree[symbol]))
        groups, before = following, step
    return out


def plan_walks(items: list, share: float, repetitions: int, seed: int = 5) -> list:
    """(span, need, walks) per class of item lengths; a walk is (salt, steps, items by sample).

    A window within d edits of an item keeps all but 2d of the item's word pairs, so a start whose
    next ``span`` words hold fewer than ``need`` benchmark pairs matches no item of the class.
    """
    out = []
    classes: dict[int, list] = {}
    for number, codes in enumerate(items):
        classes.setdefault(int(math.log(len(codes), SPREAD)), []).append(number)
    for kind, members in sorted(classes.items()):
        lengths = [len(items[i]) for i in members]
        shortest, longest = min(lengths), max(lengths)
        need = max(0, min(n - 1 - 2 * max_edits(n, share) for n in lengths))
        walks = []
        for r in range(repetitions):
            rng = np.random.default_rng([seed, kind, r])
            salt = int(rng.integers(1 << 63))
            # A walk stands on word n/2 after n steps on average: sample where it is inside.
            choice = np.arange(max(min(SAMPLES, shortest), int(1.5 * shortest)))
            steps = tuple(sorted(rng.choice(choice, min(SAMPLES, shortest), replace=False).tolist()))
            tree: dict = {}
            for i in members:
                path = _samples(items[i], salt, steps)
                node = tree
                for symbol in path[:-1]:
                    node = node.setdefault(symbol, {})
                node.setdefault(path[-1], []).append(i)
            walks.append((salt, steps, tree))
        out.append((longest + max_edits(longest, share), need, walks))
    return out


def _samples(item: np.ndarray, salt: int, steps: tuple) -> list:
    """Symbols that the walk of an item stands on at the sampled steps."""
    bits = [move_bits(item, salt, block).tolist() for block in range(steps[-1] // 64 + 1)]
    place, path = 0, []
    for step in range(steps[-1] + 1):
        if step in steps:
            path.append(int(item[place]))
        place = min(place + (bits[step // 64][place] >> step % 64 & 1), len(item) - 1)
    return path


def best_match(item: np.ndarray, words: np.ndarray, limit: int):
    """(distance, first word, end) of the part of ``words`` nearest to ``item``, or None.

    Exact edit distance in words, with free ends on the side of ``words``; ties take the earliest
    end, then the latest start.
    """
    n = len(words)
    cost = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, symbol in enumerate(item):
        swap = cost[:-1] + (words != symbol)
        drop = cost[1:] + 1
        use = swap <= drop
        here = np.r_[i + 1, np.where(use, swap, drop)]
        source = np.r_[0, np.where(use, begin[:-1], begin[1:])]
        # Insertions: running minimum of (cost - place), keeping where the minimum came from.
        level = here - ramp
        low = np.minimum.accumulate(level)
        first = np.maximum.accumulate(np.where(level == low, ramp, 0))
        cost, begin = low + ramp, source[first]
    end = int(cost.argmin())
    return (int(cost[end]), int(begin[end]), end) if cost[end] <= limit else None


@dataclass
class Prepared:
    """A block of benchmark items as it is sent to the executors."""

    letter_bits: np.ndarray
    names: dict
    ids: list
    items: list
    pairs: np.ndarray
    # Sorted word hashes, the word number of each, and which low bits of a hash some word has.
    hashes: np.ndarray
    numbers: np.ndarray
    low_bits: np.ndarray
    classes: list


def prepare(rows: list, share: float, repetitions: int) -> Prepared:
    """Words, items and walks of (item_id, text) rows; items without words are left out."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    split = [(i, WORDS.findall(t.lower())) for i, t in rows]
    split = [(i, w) for i, w in split if w]
    names = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
    items = [np.array([names[w] for w in ws], np.int32) for _, ws in split]
    base = len(names) + 1
    pairs = [c[:-1].astype(np.int64) * base + c[1:] for c in items]
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    table = letters()
    hashes, _ = WordHasher(table).words([" ".join(names)])
    order = np.argsort(hashes)
    low = np.zeros(1 << max(16, (8 * base).bit_length()), bool)
    low[(hashes & np.uint64(len(low) - 1)).astype(np.int64)] = True
    return Prepared(table, names, [i for i, _ in split], items, pairs, hashes[order],
                    (order + 1).astype(np.int32), low, plan_walks(items, share, repetitions))


def candidates(codes: np.ndarray, borders: np.ndarray, held: Prepared) -> dict:
    """{(text, item): starts} of the windows whose samples agree with an item's."""
    total = np.zeros(len(codes) + 1, np.int64)
    near = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    if len(held.pairs):
        key = codes[near].astype(np.int64) * (len(held.names) + 1) + codes[near + 1]
        hit = near[held.pairs[np.minimum(np.searchsorted(held.pairs, key), len(held.pairs) - 1)] == key]
        # A pair across two texts is none.
        hit = np.setdiff1d(hit, borders[1:-1] - 1, assume_unique=False)
        total[hit + 1] = 1
        total = np.cumsum(total)
    owner = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    stop = borders[1:][owner]
    places = np.arange(len(codes))
    found: dict[tuple, list] = {}
    for span, need, walks in held.classes:
        starts = np.flatnonzero(total[np.minimum(places + span, stop)] - total[:-1] >= need)
        if not len(starts):
            continue
        # Only the words that some walk may stand on.
        reach = np.minimum(starts + max(steps[-1] for _, steps, _ in walks), stop[starts] - 1)
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, reach + 1, -1)
        there = np.flatnonzero(np.cumsum(cover)[:-1])
        near, begin, last = codes[there], *(np.searchsorted(there, x) for x in (starts, reach))
        for salt, steps, tree in walks:
            for origins, members in walk(near, begin, last, salt, steps, tree):
                origins = there[origins]
                texts = owner[origins]
                for text in np.unique(texts).tolist():
                    mine = origins[texts == text] - borders[text]
                    for m in members:
                        found.setdefault((text, m), []).append(mine)
    return found


def nearest(item: np.ndarray, codes: np.ndarray, origins: np.ndarray, share: float):
    """(edits, first word, end) of the nearest run of words around some starts, or None."""
    best, slack = None, max_edits(len(item), share)
    # Starts close to each other are looked at together.
    for run in np.split(origins, np.flatnonzero(np.diff(origins) > slack + 1) + 1):
        low, high = max(0, int(run[0]) - slack), int(run[-1]) + len(item) + 2 * slack
        got = best_match(item, codes[low:high], slack)
        if got and (best is None or got[0] < best[0]):
            best = (got[0], got[1] + low, got[2] + low)
    return best


def search(texts: list, hasher: WordHasher, held: Prepared, share: float) -> list:
    """(text, item, edits, first word, end) of the items in many texts, in this order."""
    out, begin = [], 0
    while begin < len(texts):
        stop, size = begin, 0
        while stop < len(texts) and (stop == begin or size + len(texts[stop]) <= TEXT):
            size += len(texts[stop])
            stop += 1
        hashes, borders = hasher.words(texts[begin:stop])
        codes = np.zeros(len(hashes), np.int32)
        if len(held.hashes):
            maybe = np.flatnonzero(held.low_bits[(hashes & np.uint64(len(held.low_bits) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(held.hashes, hashes[maybe]), len(held.hashes) - 1)
            same = held.hashes[at] == hashes[maybe]
            codes[maybe[same]] = held.numbers[at[same]]
        exact: dict[int, np.ndarray] = {}
        for (text, m), starts in sorted(candidates(codes, borders, held).items()):
            if text not in exact:
                exact[text] = word_codes(texts[begin + text], held.names)
            best = nearest(held.items[m], exact[text], np.unique(np.concatenate(starts)), share)
            if best is not None:
                out.append((begin + text, m, *best))
        begin = stop
    return out


def blocks(benchmark: DataFrame, share: float, repetitions: int):
    """The benchmark's items in blocks of about ``SENT`` bytes, each prepared and broadcast.

    One block reaches the driver at a time; its size is measured before it is fetched.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("i"),
                             F.col("text").cast("string").alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    count = -(-size // SENT)
    for number in range(count):
        part = F.pmod(F.xxhash64(F.lit(11), "i", "t"), F.lit(count)) == number
        prepared = prepare([tuple(r) for r in items.where(part).collect()], share, repetitions)
        yield benchmark.sparkSession.sparkContext.broadcast(prepared)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE,
                 repetitions: int = 12) -> DataFrame:
    """One row per (document, benchmark item) found: doc_id, item_id, edits, item_words, first_word, end_word.

    A document is contaminated where some run of its words is within ``share`` of an item's words,
    by exact edit distance in words; words are lower-cased runs of letters and digits. Of several
    runs the nearest, then earliest of those looked at, is returned. Candidates come from
    ``repetitions`` walks; at the largest allowed distance one walk finds a passage with a
    probability of about a fifth, at a few edits of a half, and starts beside it count as well.

    The benchmark is a set of queries: it is sent in blocks of 4 MB, and the documents are passed
    over once per block. A null item_id stays null; items with equal texts are each reported, and
    ties between items change nothing. Null or wordless texts and items match nothing; repeated
    documents are each reported; an empty table on either side gives no rows; further columns are
    ignored.
    """
    schema = ("doc_id long, item_id long, edits long, item_words long, first_word long, "
              "end_word long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))

    def finder(sent):
        def find(batches):
            held = sent.value
            hasher = WordHasher(held.letter_bits)
            for batch in slices(batches):
                keys = batch.column(0).to_pylist()
                texts = [t or "" for t in batch.column(1).to_pylist()]
                found = [(keys[t], held.ids[m], edits, len(held.items[m]), first, end)
                         for t, m, edits, first, end in search(texts, hasher, held, share)]
                columns = list(zip(*found)) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"])
        return find

    out = docs.sparkSession.createDataFrame([], schema)
    for number, sent in enumerate(blocks(benchmark, share, repetitions)):
        found = rows.mapInArrow(lambda b, find=finder(sent): giving_back(find(b)), schema)
        out = out.unionByName(found) if number else found
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, share: float = SHARE,
                      repetitions: int = 12) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; a pass without a shuffle per block."""
    place = docs.columns.index("text")

    def cleaner(sent):
        def clean(batches):
            held = sent.value
            hasher = WordHasher(held.letter_bits)
            for batch in slices(batches):
                texts = [str(t or "") for t in batch.column(place).to_pylist()]
                keep = np.ones(len(texts), bool)
                keep[[t for t, *_ in search(texts, hasher, held, share)]] = False
                yield batch.filter(pa.array(keep))
        return clean

    for sent in blocks(benchmark, share, repetitions):
        docs = docs.mapInArrow(lambda b, clean=cleaner(sent): giving_back(clean(b)), docs.schema)
    return docs

"""Counting quotient filters over packed word-id n-grams: lossless, sorted, mergeable.

An n-gram of word numbers is packed into two halves of ``h`` bits and moved by an invertible
Feistel permutation, so keys spread evenly whatever the text. The leading bits of the permuted key
are its slice and its quotient, all other bits its remainder; as the remainder is kept whole, no
two keys ever share a counter. A filter has one bit per quotient (occupied), one bit per entry
(last of its quotient's run), the remainders, one bit per entry (count above one), and the larger
counts as variable-length numbers. Entries stand in the order of the permuted key, for any number
of quotient bits, so filters of different shards merge by one sorted pass.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Rounds of the permutation; each mixes one half into the other and is undone on its own.
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def half_bits(word_bits: int) -> int:
    """Bits of each half that three word numbers of ``word_bits`` take (42 at most)."""
    if word_bits > 42:
        raise ValueError("word numbers of more than 42 bits")
    return word_bits + word_bits - word_bits // 2


def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def pack(a, b, c, word_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of (a, b, c): the second number is shared between them."""
    a, b, c = (np.asarray(x).astype(np.uint64) for x in (a, b, c))
    lower = word_bits // 2
    return ((a << np.uint64(word_bits - lower)) | (b >> np.uint64(lower)),
            ((b & _low(lower)) << np.uint64(word_bits)) | c)


def unpack(left, right, word_bits: int):
    lower = word_bits // 2
    upper = word_bits - lower
    b = ((left & _low(upper)) << np.uint64(lower)) | (right >> np.uint64(word_bits))
    return left >> np.uint64(upper), b, right & _low(word_bits)


def _mix(x: np.ndarray, key: int, h: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - h)


def permute(left, right, h: int):
    for key in _ROUNDS:
        left, right = right, left ^ _mix(right, key, h)
    return left, right


def restore(left, right, h: int):
    for key in reversed(_ROUNDS):
        left, right = right ^ _mix(left, key, h), left
    return left, right


def summed(left, right, counts, h: int):
    """Sorted distinct keys with the sum of their counts."""
    if not len(left):
        return left, right, counts
    if 2 * h <= 64:
        key = (left << np.uint64(h)) | right
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key = key[first]
        return key >> np.uint64(h), key & _low(h), np.add.reduceat(counts, first)
    order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    return left[first], right[first], np.add.reduceat(counts, first)


def _to_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(raw: bytes, count: int, width: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(count, width)
    return out.view("<u8").astype(np.uint64).ravel()


def _varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, low first; the high bit says that more follow."""
    groups = np.ones(len(values), np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        groups += rest > 0
        rest = rest >> np.uint64(7)
    start = np.cumsum(groups) - groups
    out = np.zeros(int(groups.sum()), np.uint8)
    for g in range(int(groups.max(initial=0))):
        live = groups > g
        byte = (values[live] >> np.uint64(7 * g)) & np.uint64(127)
        out[start[live] + g] = byte | ((groups[live] > g + 1).astype(np.uint64) << np.uint64(7))
    return out.tobytes()


def _read_varints(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(data < 128)
    start = np.r_[0, last[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(start, last - start + 1)
    value = (data & 127).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    return np.add.reduceat(value, start)


@dataclass
class QuotientFilter:
    """Counts of one slice (the keys whose leading ``s`` bits are ``slice``) or of all keys."""

    h: int
    s: int
    slice: int
    q: int
    n: int
    occupied: bytes
    runends: bytes
    low: bytes
    high: bytes
    above_one: bytes
    counters: bytes

    @classmethod
    def build(cls, left, right, counts, h: int, s: int = 0, number: int = 0) -> "QuotientFilter":
        """From sorted distinct permuted keys of one slice; about one entry per quotient."""
        n = len(left)
        q = min(h - s, max(0, n.bit_length() - 1))
        quotient = (left >> np.uint64(h - s - q)) & _low(q)
        occupied = np.zeros(1 << q, np.uint8)
        occupied[quotient.astype(np.int64)] = 1
        ends = np.r_[quotient[1:] != quotient[:-1], True] if n else np.zeros(0, bool)
        many = counts > 1
        return cls(h, s, number, q, n, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(),
                   _to_bytes(left & _low(h - s - q), -(-(h - s - q) // 8)),
                   _to_bytes(right, -(-h // 8)), np.packbits(many).tobytes(),
                   _varints(counts[many].astype(np.uint64)))

    def entries(self):
        """Sorted permuted keys (two halves) and counts."""
        h, s, q, n = self.h, self.s, self.q, self.n
        there = np.flatnonzero(np.unpackbits(np.frombuffer(self.occupied, np.uint8), count=1 << q))
        ends = np.unpackbits(np.frombuffer(self.runends, np.uint8), count=n).astype(np.int64)
        run = np.cumsum(ends) - ends
        quotient = there[run].astype(np.uint64)
        left = ((np.uint64(self.slice) << np.uint64(h - s)) | (quotient << np.uint64(h - s - q))
                | _from_bytes(self.low, n, -(-(h - s - q) // 8)))
        counts = np.ones(n, np.uint64)
        counts[np.unpackbits(np.frombuffer(self.above_one, np.uint8), count=n).astype(bool)] = \
            _read_varints(self.counters)
        return left, _from_bytes(self.high, n, -(-h // 8)), counts

    def count(self, left: int, right: int) -> int:
        """Count of one permuted key: its quotient's bit, then only the run of that quotient."""
        h, s, q = self.h, self.s, self.q
        if left >> (h - s) != self.slice:
            return 0
        quotient = (left >> (h - s - q)) & ((1 << q) - 1)
        bits = np.unpackbits(np.frombuffer(self.occupied, np.uint8), count=1 << q)
        if not self.n or not bits[quotient]:
            return 0
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(self.runends, np.uint8), count=self.n))
        rank = int(bits[:quotient].sum())
        start, end = (int(ends[rank - 1]) + 1 if rank else 0), int(ends[rank]) + 1
        wl, wh = -(-(h - s - q) // 8), -(-h // 8)
        low = _from_bytes(self.low[start * wl:end * wl], end - start, wl)
        high = _from_bytes(self.high[start * wh:end * wh], end - start, wh)
        at = np.flatnonzero((low == np.uint64(left & ((1 << (h - s - q)) - 1))) & (high == np.uint64(right)))
        if not len(at):
            return 0
        many = np.unpackbits(np.frombuffer(self.above_one, np.uint8), count=self.n)
        place = start + int(at[0])
        return int(_read_varints(self.counters)[many[:place].sum()]) if many[place] else 1


def sliced(left, right, counts, h: int, s: int):
    """One filter per slice that has entries, from sorted distinct keys."""
    if not len(left):
        return
    number = left >> np.uint64(h - s) if s else np.zeros(len(left), np.uint64)
    cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    for start, end in zip(cut, np.r_[cut[1:], len(left)]):
        yield QuotientFilter.build(left[start:end], right[start:end], counts[start:end], h, s,
                                   int(number[start]))


def merged(filters) -> QuotientFilter:
    """One filter with the counts of several of the same slice; counts are added."""
    filters = list(filters)
    parts = [f.entries() for f in filters]
    h, s, number = filters[0].h, filters[0].s, filters[0].slice
    return QuotientFilter.build(
        *summed(*(np.concatenate([p[i] for p in parts]) for i in range(3)), h), h, s, number)

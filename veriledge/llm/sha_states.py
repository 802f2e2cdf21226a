"""SHA-256 over many messages at once, with states that can be kept and resumed.

Children of a tree enter their parent as hex text: 64 bytes, exactly one block of the hash. The
state before a child slot is therefore 32 bytes, with nothing buffered beside it, and a parent can
retain one per slot. A batch of messages moves through the rounds together as numpy columns.
"""
from __future__ import annotations

import numpy as np


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _root_bits(n: int, degree: int) -> int:
    """First 32 bits of the fraction of the ``degree``-th root of ``n``."""
    target, low, high = n << (32 * degree), 0, n << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** degree <= target else (low, middle - 1)
    return low & 0xFFFFFFFF


START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States (n, 8) after one block of 16 words each (n, 16); all uint32."""
    w = [words[:, i] for i in range(16)]
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3)))
                 + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = (state[:, i] for i in range(8))
    for i in range(64):
        one = (h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25))
               + ((e & f) ^ (~e & g)) + ROUND[i] + w[i])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hex_words(digests: np.ndarray) -> np.ndarray:
    """The block of 16 words that each 32-byte digest (n, 32) makes as lower-case hex text."""
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return text.view(">u4").astype(np.uint32)


def begin(rows: int) -> np.ndarray:
    return np.tile(START, (rows, 1))


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of messages that ended after that many whole blocks."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0] = 1 << 31
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[:, 14], last[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return as_bytes(compress(state, last))


def as_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.astype(">u4")).view(np.uint8).reshape(len(state), 32)


def from_bytes(raw: np.ndarray) -> np.ndarray:
    """States (n, 8) from their 32 bytes (n, 32)."""
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).reshape(len(raw), 8)


def absorb(children: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents of children (n, width, 32): digests (n, 32) and the copied state before each slot
    (n, width, 32); only the first ``counts`` children and slots of a parent mean anything."""
    rows, width, _ = children.shape
    state, kept = begin(rows), np.zeros((rows, width, 32), np.uint8)
    for slot in range(width):
        live = np.flatnonzero(counts > slot)
        if not len(live):
            break
        kept[live, slot] = as_bytes(state[live])
        state[live] = compress(state[live], hex_words(children[live, slot]))
    return finish(state, counts), kept


def resume(state: np.ndarray, child: np.ndarray, right: np.ndarray, n_right: np.ndarray,
           counts: np.ndarray) -> np.ndarray:
    """Parent digests from a kept state, the replacement in its slot and the siblings to its right.

    ``right`` is (n, width, 32); nothing to the left of the slot is read.
    """
    state = compress(state, hex_words(child))
    for slot in range(right.shape[1]):
        live = np.flatnonzero(n_right > slot)
        if not len(live):
            break
        state[live] = compress(state[live], hex_words(right[live, slot]))
    return finish(state, counts)

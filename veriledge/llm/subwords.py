"""Hashed character n-grams of whole texts, as arrays over many documents at once."""
from __future__ import annotations

import numpy as np

PIECE = 1 << 18
REACH = 8
_LETTERS: list = []


def _letters() -> np.ndarray:
    """Which of the first 65,536 code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16))
    return _LETTERS[0]


def blocks(texts):
    """(code points, owner) blocks of lower-cased texts; anything but a letter is 0.

    ``owner`` has the text's number at each place, -1 between texts. A text of more than a quarter
    of a million characters is cut into pieces that repeat the few characters a window may reach into, with
    owner -1 there, so every window is seen once.
    """
    held, owners, size = [], [], 0
    for number, text in enumerate(texts):
        low = (text or "").lower()
        for start in range(0, max(1, len(low)), PIECE):
            piece = low[start:start + PIECE + REACH]
            held.append(piece)
            owners.append((number, min(len(piece), PIECE), len(piece)))
            size += len(piece) + 1
            if size >= PIECE:
                yield _block(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _block(held, owners)


def _block(held, owners):
    # The last text is closed like any other, so its edge counts too.
    points = np.frombuffer("\0".join([*held, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    low = points < 1 << 16
    letter = np.zeros(len(points), bool)
    letter[low] = _letters()[points[low]]
    if not low.all():
        letter[~low] = [chr(c).isalpha() for c in points[~low]]
    owner = np.full(len(points), -1, np.int32)
    at = 0
    for number, own, length in owners:
        owner[at:at + own] = number
        at += length + 1
    return np.where(letter, points, 0).astype(np.uint32), owner


def grams(points, owner, n: int, buckets: int):
    """(bucket, owner) of all n-grams inside words; a word's edge may be the first or last place."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    letter = points > 0
    ok = (owner[:m] >= 0) & (letter[:m] | letter[n - 1:])
    for k in range(1, n - 1):
        ok &= letter[k:k + m]
    h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ points[k:k + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h[ok] % np.uint32(buckets)).astype(np.int64), owner[:m][ok]


def add_by_owner(total: np.ndarray, values: np.ndarray, owner: np.ndarray) -> None:
    """Add the rows of ``values`` to the rows of ``total``; ``owner`` ascends."""
    if not len(owner):
        return
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    np.add.at(total, owner[first], np.add.reduceat(values, first, axis=0))

"""Sets of word shingles as sorted arrays of 64-bit marks, for whole texts, by flat numpy arrays.

A word's mark mixes its bytes eight at a time, each step a permutation of 64 bits, so that words of up to eight bytes
never share one by their form, nor do longer ones; of words of over 64 bytes it is 64 bits of a BLAKE2 digest."""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.default_rng(1234567)
#: A mark of each byte, and an odd base whose powers tell places apart.
BYTES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NO_SPACE = np.ones(256, bool)
NO_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: The bytes of a lane that belong to a word with so many bytes left.
INSIDE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONGEST = 64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_marks(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The marks of words that lie at begins to ends in flat bytes, which go on for 8 bytes behind the last."""
    sizes = ends - begins
    lanes = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    mark = mixed((lanes[begins] & INSIDE[np.minimum(sizes, 8)]) + BASE)
    for at in range(8, LONGEST, 8):
        some = np.flatnonzero(sizes > at)
        if not len(some):
            break
        lane = lanes[begins[some] + at] & INSIDE[np.minimum(sizes[some] - at, 8)]
        mark[some] = mixed((mark[some] ^ mixed(lane + INVERSE)) * BASE)
    mark = mixed(mark + sizes.astype(np.uint64) * INVERSE)
    for k in np.flatnonzero(sizes > LONGEST):
        digest = hashlib.blake2b(flat[begins[k] : ends[k]].tobytes(), digest_size=8).digest()
        mark[k] = np.frombuffer(digest, "<u8")[0]
    return mark


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingles of ``width`` words of each text (letters A-Z in lower case), sorted. A text of fewer
    words is one shingle of all of them; a text without words is an empty set."""
    raw = [t.encode().lower() for t in texts]  # bytes.lower() changes A-Z only
    sizes = np.array([len(r) + 1 for r in raw])
    flat = np.frombuffer(b"\n".join([*raw, b" " * 8]), np.uint8)
    solid = NO_SPACE[flat]
    begins = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    ends = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
    word = word_marks(flat, begins, ends)
    first = np.searchsorted(begins, np.r_[0, np.cumsum(sizes)])
    out = []
    joined = word
    for _ in range(width - 1):  # the mark of the shingle that begins at each word
        joined = mixed(joined[:-1] * BASE + word[len(word) - len(joined) + 1 :]) if len(joined) else joined
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(joined[a : b - width + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            own = word[a : a + 1]
            for k in range(a + 1, b):
                own = mixed(own * BASE + word[k : k + 1])
            out.append(own + np.uint64(1))
        else:
            out.append(np.empty(0, np.uint64))
    return out

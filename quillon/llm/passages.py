"""Passages around anchors: which stretches of a text can hold a repeated string of a given length.

Every string of ``length`` bytes has an anchor: the place of the least mark among its grams of ``gram`` bytes, the
first of equal ones. Equal strings have their anchors at the same place within them. Neighbouring strings with
one anchor make a passage, which holds all of them; passages that hold equal strings share the anchor's mark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shingles import BYTES, _power_tables, mixed

#: A text is at most 2 ** 31 bytes long; marks whose bits above are equal are told apart by their places.
PLACE = np.uint64((1 << 31) - 1)


@dataclass
class Passages:
    """Arrays with an entry for each passage of some texts; places count bytes of the joined texts."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    mark: np.ndarray
    bounds: np.ndarray

    def __getitem__(self, keep: np.ndarray) -> Passages:
        parts = (self.text, self.first, self.last, self.anchor, self.mark)
        return Passages(*(x[keep] for x in parts), self.bounds)


def passages(raw: list[bytes], length: int, gram: int) -> Passages:
    """The passages of texts of less than 2 GB together; first and last are starts of strings."""
    sizes = np.array([len(r) for r in raw], np.int64)
    bounds = np.r_[0, np.cumsum(sizes)]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    starts, n, width = len(flat) - length + 1, len(flat) - gram + 1, length - gram + 1
    if starts < 1:
        none = np.empty(0, np.int64)
        return Passages(none, none, none, none, none.astype(np.uint64), bounds)
    power, inverse = _power_tables(len(flat) + 1)
    upto = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTES[flat] * power[: len(flat)], dtype=np.uint64, out=upto[1:])
    mark = mixed((upto[gram:] - upto[:-gram]) * inverse[:n])
    # marks with the place below them: the least of a window tells its first place, too
    least = (mark & ~PLACE) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)[:starts]
    inside = np.arange(length, length + starts) <= bounds[1:][text]
    turn = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(np.r_[True, turn | ~inside[:-1]] & inside)
    last = np.flatnonzero(np.r_[turn | ~inside[1:], True] & inside)
    anchor = anchor[first]
    return Passages(text[first].astype(np.int64), first, last, anchor, mark[anchor], bounds)

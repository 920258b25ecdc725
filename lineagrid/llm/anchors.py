"""Anchors of byte windows: which seed stands for each window, decided by the window's own bytes.

Of the seeds that begin in a window the one with the smallest hash is its anchor (the first of equals). Equal windows have
their anchor at the same place, so windows only need to be compared inside the group of one seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .wordbytes import MULTIPLIER, mixed, powers


def seed_length(length: int) -> int:
    """Two fifths of the window, or more where windows of one anchor would not fit the bits of a 64-bit mask."""
    return max(1, length * 2 // 5, length - 61)


@dataclass(frozen=True)
class Anchors:
    """Arrays over anchors: row of the text, seed hash, context hash, anchor place, first and last window it stands for."""

    row: np.ndarray
    seed: np.ndarray
    context: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Rolling:
    """Hashes of byte ranges from one running sum."""

    def __init__(self, data: np.ndarray, multiplier: np.uint64 = MULTIPLIER):
        self.up, self.down = powers(len(data) + 1, multiplier)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.total[1:], dtype=np.uint64)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all(self, length: int) -> np.ndarray:
        n = len(self.total) - length
        return mixed((self.total[length:] - self.total[:n]) * self.down[:n] + np.uint64(length))


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[Anchors, Rolling]:
    """Anchors of all windows of `length` bytes that lie in one row of the concatenated texts."""
    seed = seed_length(length)
    rolling, span = Rolling(data), length - seed + 1
    nothing = np.zeros(0, np.int64)
    if len(data) < length:
        return Anchors(nothing, nothing.astype(np.uint64), nothing.astype(np.uint64), nothing, nothing, nothing), rolling
    seeds = rolling.all(seed)
    least = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(len(place), bool)
    for end in offsets[1:].tolist():  # windows that would run into the next text
        valid[max(0, end - length + 1) : end] = False
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start < length:
            valid[start:end] = False
    windows = np.flatnonzero(valid)
    if not len(windows):
        return Anchors(nothing, nothing.astype(np.uint64), nothing.astype(np.uint64), nothing, nothing, nothing), rolling
    at = place[windows]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first, last = windows[new], windows[np.r_[new[1:], len(windows)] - 1]
    at = at[new]
    context = mixed(rolling.hash(first, last + length) + (at - first).astype(np.uint64))
    return Anchors(np.searchsorted(offsets, first, side="right") - 1, seeds[at], context, at, first, last), rolling

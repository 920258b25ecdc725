"""Words of UTF-8 texts in numpy, a whole Arrow slice at a time: where they are and 64-bit hashes of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACES = (0x20, *range(0x09, 0x0E))
_powers: dict[int, list[np.ndarray]] = {}


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


IS_SPACE, LOWER = space_table(), lower_table()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, multiplier: np.uint64 = MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n and those of its inverse, modulo 2^64."""
    held = _powers.get(int(multiplier))
    if held is None or len(held[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(multiplier), -1, 1 << 64))
        held = _powers[int(multiplier)] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, base, np.uint64)])) for base in (multiplier, inverse)]
    return held[0], held[1]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets in them; null is empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without separators, never across rows), and the number of words before each row."""
    inside = ~is_space[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of `words` consecutive words, A-Z lower-cased; fewer words make one shingle."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, IS_SPACE)
    h = word_hashes(data, starts, ends)
    factors = [np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(words)]
    joined = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k, factor in enumerate(factors):
        joined += h[k : k + len(joined)] * factor
    joined = mixed(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            part = np.zeros(1, np.uint64) + np.uint64(b - a)
            for k in range(b - a):
                part += h[a + k] * np.full(1, factors[k])
            out.append(mixed(part))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

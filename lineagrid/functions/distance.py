"""Pair scores of annotated sequences, as column expressions and as numpy kernels of the same arithmetic.

    score = germline + (distance + length penalty - bonus * shared mutations) / shorter length, at least 0.001
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Penalties for different germline genes, and the least score.
V_PENALTY, J_PENALTY, LEAST_SCORE = 10.0, 5.0, 0.001


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two strings of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, d: t + d)


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Hamming distance for equal lengths, else Levenshtein; with `most`, null for a Levenshtein distance over it."""
    far = F.levenshtein(a, b) if most is None else F.nullif(F.levenshtein(a, b, most), F.lit(-1))
    return F.when(F.length(a) == F.length(b), hamming(a, b)).otherwise(far)


def shared_mutations(a: Column, b: Column) -> Column:
    """Distinct mutations in both lists."""
    return F.size(F.array_intersect(a, b))


def germline_penalty(v_a: Column, v_b: Column, j_a: Column, j_b: Column) -> Column:
    return F.when(~v_a.eqNullSafe(v_b), V_PENALTY).otherwise(0.0) + F.when(~j_a.eqNullSafe(j_b), J_PENALTY).otherwise(0.0)


def score(germline: Column, distance: Column, length_a: Column, length_b: Column, shared: Column, bonus: float, multiplier: float) -> Column:
    penalty = F.abs(length_a - length_b) * F.lit(float(multiplier))
    shorter = F.greatest(F.least(length_a, length_b), F.lit(1))
    return F.greatest(germline + (distance + penalty - shared * F.lit(float(bonus))) / shorter, F.lit(LEAST_SCORE))


def too_different(length_a: Column, length_b: Column, cutoff: float, multiplier: float) -> Column:
    """The length test before any distance: pairs that fail it never merge (so empty sequences never do)."""
    return (F.lit(cutoff) > 0) & (F.abs(length_a - length_b) * F.lit(float(multiplier)) >= F.least(length_a, length_b) * F.lit(float(cutoff)))


def reach(shorter: int, more: int, mutations: int, cutoff: float, bonus: float, multiplier: float) -> int:
    """The largest distance of a pair within the cutoff that shares so many mutations; a little more at a float's edge."""
    return math.floor(cutoff * shorter + max(0.0, bonus) * mutations - multiplier * more + 1e-6)


def letters(sequences: list[str]) -> np.ndarray:
    """(sequences, length) code points of sequences of one length."""
    return np.frombuffer("".join(sequences).encode("utf-32-le"), "<u4").reshape(len(sequences), -1)


def equal_positions(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many positions of each row of x and each of y hold one code point: products of 0/1 matrices, some positions each."""
    both = np.concatenate([x, y])
    alike = (both == both[:1]).all(axis=0) if len(both) else np.zeros(x.shape[1], bool)
    same = np.full((len(x), len(y)), alike.sum(), np.float32)
    found, number = np.unique(both[:, ~alike], return_inverse=True)
    number = number.reshape(len(x) + len(y), -1)
    step = max(1, 1024 // max(1, len(found)))
    for at in range(0, number.shape[1], step):
        part = number[:, at : at + step]
        hot = np.zeros((len(part), part.shape[1] * len(found)), np.float32)
        np.put_along_axis(hot, part + np.arange(part.shape[1]) * len(found), 1, axis=1)
        same += hot[: len(x)] @ hot[len(x) :].T
    return same


def hamming_matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between code points of one length."""
    return (x.shape[1] - equal_positions(x, y)).astype(np.int64)


def shared_matrix(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """All counts of distinct mutations in both lists, some mutations at a time."""
    number = {m: k for k, m in enumerate(sorted({m for ms in a for m in ms or ()} & {m for ms in b for m in ms or ()}))}
    places = [np.array([(r, number[m]) for r, ms in enumerate(lists) for m in ms or () if m in number], np.int64).reshape(-1, 2) for lists in (a, b)]
    shared = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(number), 1024):
        hot = []
        for lists, p in zip((a, b), places, strict=True):
            p = p[(p[:, 1] >= at) & (p[:, 1] < at + 1024)]
            hot.append(np.zeros((len(lists), min(1024, len(number) - at)), np.float32))
            hot[-1][p[:, 0], p[:, 1] - at] = 1
        shared += hot[0] @ hot[1].T
    return shared.astype(np.int64)


def levenshtein_pairs(a: list[str], b: list[str], most: int = 100_000) -> np.ndarray:
    """Unit-cost edit distances of a[k] and b[k]: a table row at a time, for all pairs of one pair of lengths at once."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for n, m in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes == (n, m)).all(axis=1))
        for part in np.array_split(rows, -(-len(rows) // most)):
            x, y = (letters([side[k] for k in part]).T for side in (a, b))
            row = np.tile(np.arange(m + 1, dtype=np.int32)[:, None], (1, len(part)))
            for i in range(n):
                best = np.minimum(row[1:] + 1, row[:-1] + (y != x[i]))
                row[0] = i + 1
                for j in range(m):
                    row[j + 1] = np.minimum(best[j], row[j] + 1)
            out[part] = row[-1]
    return out


def levenshtein(a: str, b: str) -> int:
    """Unit-cost edit distance."""
    return int(levenshtein_pairs([a], [b])[0])


def levenshtein_block(x: np.ndarray, y: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """All unit-cost edit distances of code points of one length (rows of x) and of another (rows of y)."""
    out = np.zeros((len(x), len(y)), np.int64)
    step = max(1, most // max(1, len(y) * (y.shape[1] + 1)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        row = [np.full((len(part), len(y)), j, np.int32) for j in range(y.shape[1] + 1)]
        for i in range(x.shape[1]):
            before, row[0] = row[0], row[0] + 1
            for j in range(y.shape[1]):
                best = np.minimum(np.minimum(row[j], row[j + 1]) + 1, before + (part[:, i, None] != y[None, :, j]))
                before, row[j + 1] = row[j + 1], best
        out[at : at + step] = row[-1]
    return out


def distance_block(a: list[str], b: list[str]) -> np.ndarray:
    """All distances of a and b: Hamming for equal lengths, else Levenshtein. Equal texts are compared once."""
    (left, from_left), (right, from_right) = (np.unique(np.array(x, object).astype(str) if x else np.zeros(0, "<U1"), return_inverse=True) for x in (a, b))
    lengths = [np.array([len(t) for t in side], np.int64) for side in (left, right)]
    found = np.zeros((len(left), len(right)), np.int64)
    same = len(left) == len(right) and bool((left == right).all())
    for n in np.unique(lengths[0]).tolist():
        rows = np.flatnonzero(lengths[0] == n)
        x = letters([left[r] for r in rows])
        for m in np.unique(lengths[1]).tolist():
            if same and m < n:
                continue
            columns = np.flatnonzero(lengths[1] == m)
            y = letters([right[c] for c in columns])
            part = hamming_matrix(x, y) if n == m else levenshtein_block(x, y)
            found[np.ix_(rows, columns)] = part
            if same and n != m:
                found[np.ix_(columns, rows)] = part.T
    return found[np.ix_(from_left.ravel(), from_right.ravel())]


Side = tuple[list, list, list[str], list[list[str]]]


def score_block(a: Side, b: Side, bonus: float, multiplier: float) -> np.ndarray:
    """All scores of two sides, each V genes, J genes, CDR3s and mutation lists."""
    number: dict = {}
    genes = [[np.array([number.setdefault((k, g), len(number)) for g in side[k]], np.int64) for k in (0, 1)] for side in (a, b)]
    germline = np.where(genes[0][0][:, None] != genes[1][0][None, :], V_PENALTY, 0.0) + np.where(genes[0][1][:, None] != genes[1][1][None, :], J_PENALTY, 0.0)
    length = [np.array([len(t) for t in side[2]], np.int64) for side in (a, b)]
    out = shared_matrix(a[3], b[3]) * -float(bonus)
    out += np.abs(length[0][:, None] - length[1][None, :]) * float(multiplier)
    out += distance_block(a[2], b[2])
    out /= np.maximum(np.minimum(length[0][:, None], length[1][None, :]), 1)
    out += germline
    return np.maximum(out, LEAST_SCORE, out=out)


def score_matrix(v: list, j: list, cdr3: list[str], mutations: list[list[str]], bonus: float, multiplier: float) -> np.ndarray:
    """All pair scores; sequences may differ in length."""
    return score_block((v, j, cdr3, mutations), (v, j, cdr3, mutations), bonus, multiplier)

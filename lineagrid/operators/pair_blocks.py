"""Pairs of rows within a cutoff, found in blocks: no pair that is not a result leaves a task.

A bucket is a group and two lengths, cut into blocks of rows; each two blocks are one numpy problem. Rows of one CDR3 are a
text there, and texts come first: a position at a time, a byte for each of many pairs. Equal lengths count the positions that
differ. Of other lengths, a pair of k edits leaves at most k - difference letters of the shorter one without a like letter of
the longer one nearby; pairs that pass have their distance counted by words of bits. What mutations the rows of a text hold
tells how far a pair may be. Rows of the texts left are scored one pair at a time, some at once.

The work is quadratic in the texts of a bucket, a nanosecond or some a pair; what moves is each row, once for each block that
it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance
from ..functions.distance import reach
from ..storage import staged
from .runs import runs

#: Rows of a block; texts of one side that meet MANY of the other at a time; pairs of rows that are scored at once.
BLOCK, FEW, MANY, AT_ONCE = 200_000, 64, 4096, 1 << 18
#: Words of bits for a row's mutations; where a block has more different ones, lists are compared instead.
MOST_WORDS = 32
EDGES = "id_a string, id_b string, score double"


@dataclass(frozen=True)
class Scoring:
    """The score of a pair of rows from its parts, and whether it is within the cutoff. This one is of sequences."""

    cutoff: float
    bonus: float
    multiplier: float
    #: Texts of one length differ by position; else by edits like others.
    by_position = True

    def genes(self, names: pa.Array) -> list[np.ndarray]:
        """What is compared of a column of gene names, as numbers."""
        return [codes_of(names)]

    def germline(self, v: list[np.ndarray], j: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(v[0][x] != v[0][y], distance.V_PENALTY, 0.0) + np.where(j[0][x] != j[0][y], distance.J_PENALTY, 0.0)

    def score(self, germline: np.ndarray, far: np.ndarray, shared: np.ndarray, more: int, shorter: int) -> np.ndarray:
        return np.maximum(germline + (far + more * float(self.multiplier) - shared * float(self.bonus)) / shorter, distance.LEAST_SCORE)

    def near(self, score: np.ndarray) -> np.ndarray:
        return score <= self.cutoff


def codes_of(names: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(names, null_encoding="encode").indices.to_numpy()


@dataclass(frozen=True)
class Texts:
    """Rows sorted by CDR3: which text each is, and for each text its code points, rows and most mutations."""

    codes: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Texts:
        codes = distance.letters(table.column("cdr3").to_pylist())
        starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1)))
        sizes = pc.list_value_length(table.column("muts").combine_chunks()).to_numpy(zero_copy_only=False)
        return cls(codes[starts], starts, np.diff(np.append(starts, len(codes))), np.maximum.reduceat(sizes, starts).astype(np.int64))


class Mutations:
    """How many mutations rows share."""

    def __init__(self, column: pa.ListArray):
        found = pc.list_flatten(column).dictionary_encode()
        row, number = pc.list_parent_indices(column).to_numpy(), found.indices.to_numpy().astype(np.int64)
        self.words = None
        if len(found.dictionary) <= 64 * MOST_WORDS:
            self.words = np.zeros((len(column), max(1, -(-len(found.dictionary) // 64))), np.uint64)
            np.bitwise_or.at(self.words, (row, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
        else:
            sizes = np.bincount(row, minlength=len(column))
            self.lists = np.full((len(column), sizes.max()), -1, np.int64)
            self.lists[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = number

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """By rows x[k] and y[k]."""
        if self.words is not None:
            return common(self.words, x, self.words, y)
        out = np.zeros(len(x), np.int64)
        for k in range(self.lists.shape[1]):
            one = self.lists[x, k]
            out += (one >= 0) & (self.lists[y] == one[:, None]).any(axis=1)
        return out


def common(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that words a[x[k]] and b[y[k]] both have."""
    out = np.zeros(len(x), np.int64)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[x, k] & b[y, k])
    return out


def edits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Levenshtein distances of code points x[k] and y[k], of one length each."""
    n, out = x.shape[1], np.zeros(len(x), np.int64)
    if not n or n > 64:
        return out + y.shape[1] if not n else distance.levenshtein_pairs(["".join(map(chr, r)) for r in x.tolist()], ["".join(map(chr, r)) for r in y.tolist()])
    kind = next(k for k, bits in ((np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if n <= bits)
    mask = kind((1 << n) - 1)
    up, down = np.full(len(x), mask), np.zeros(len(x), kind)
    for at in range(y.shape[1]):
        eq = np.zeros(len(x), kind)
        for p in range(n):
            eq |= (x[:, p] == y[:, at]).astype(kind) << kind(p)
        across = (((eq & up) + up) ^ up) | eq
        eq |= down
        right = ((down | ~(across | up)) << kind(1)) | kind(1)
        up, down = ((up & across) << kind(1)) | ~(eq | right), right & eq
    return out + np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down & mask) + y.shape[1]


def near_texts(a: Texts, b: Texts, cutoff: float, bonus: float, multiplier: float, by_position: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of texts and their distances: all pairs that mutations as many as both have could bring within the cutoff.

    Of a block itself (a is b) a pair comes once, and each text with itself.
    """
    n, more, own = a.codes.shape[1], b.codes.shape[1] - a.codes.shape[1], a is b
    plain = by_position and not more
    # what all begin and end with costs no edit
    alike = lambda x, y: (x == x[0]).all(axis=0) & (y == x[0]).all(axis=0)
    head = int(np.argmin(np.append(alike(a.codes, b.codes[:, :n]), False)))
    tail = min(n - head, int(np.argmin(np.append(alike(a.codes[:, ::-1], b.codes[:, ::-1][:, :n]), False))))
    x, y = a.codes[:, head : n - tail], b.codes[:, head : n + more - tail]
    found, number = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    number = number.astype(np.uint8 if len(found) <= 256 else np.uint32)
    left, right = np.ascontiguousarray(number[: x.size].reshape(x.shape).T), np.ascontiguousarray(number[x.size :].reshape(y.shape).T)
    size = np.uint8 if n < 255 else np.uint32
    bound = np.array([reach(n, more, m, cutoff, bonus, multiplier) for m in range(int(min(a.most.max(), b.most.max())) + 1)])

    def met() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for p in range(0, len(x), FEW):
            for q in range(p // MANY * MANY if own else 0, len(y), MANY):
                s, t = left[:, p : p + FEW, None], right[:, None, q : q + MANY]
                k = int(bound[min(a.most[p : p + FEW].max(), b.most[q : q + MANY].max())])
                if k < more:
                    continue
                off = np.zeros((s.shape[1], t.shape[2]), size)
                differ, also = np.empty(off.shape, bool), np.empty(off.shape, bool)
                for at in range(len(s)):
                    if plain:
                        np.not_equal(s[at], t[at], out=differ)
                    else:
                        if at and not at % 3 and np.count_nonzero(off <= k - more) <= off.size >> 14:
                            break  # of so few pairs the distances are sooner counted
                        differ.fill(True)
                        for place in range(max(0, at - (k - more) // 2), min(len(t), at + (k + more) // 2 + 1)):
                            differ &= np.not_equal(s[at], t[place], out=also)
                    off += differ
                r, c = np.divmod(np.flatnonzero(off <= k - more), off.shape[1])
                r, c, d = r + p, c + q, off[r, c].astype(np.int64)
                kept = (d <= bound[np.minimum(a.most[r], b.most[c])] - more) & ((c >= r) | (not own))
                yield r[kept], c[kept], d[kept]

    # small parts would cost more calls than work
    for r, c, d in gathered(met()):
        for at in range(0, len(r), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            one, other = r[part], c[part]
            far = d[part] if plain else edits(x[one], y[other])
            kept = far <= bound[np.minimum(a.most[one], b.most[other])]
            if kept.any():
                yield one[kept], other[kept], far[kept]


def gathered(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same in parts of about AT_ONCE / 4 at least."""
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= AT_ONCE // 4:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def of_texts(a: Texts, b: Texts, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (counted from each side's first) and distances of pairs of texts, AT_ONCE at a time."""
    ends = np.cumsum(a.counts[r] * b.counts[c])
    for first in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        last = min(first + AT_ONCE, int(ends[-1]))
        low, high = np.searchsorted(ends, (first, last - 1), side="right")
        begin = np.append(0, ends)[low : high + 1]
        which = np.repeat(np.arange(low, high + 1), np.minimum(ends[low : high + 1], last) - np.maximum(begin, first))
        inside = np.arange(first, last) - np.append(0, ends)[which]
        x, y = np.divmod(inside, b.counts[c[which]])
        yield a.starts[r[which]] + x, b.starts[c[which]] + y, d[which]


def near_rows(table: pa.Table, cut: int | None, by: Scoring, star: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers and scores of the pairs of rows before `cut` with those from it on, or of all with each other (None), within the cutoff."""
    table, cutoff, bonus, multiplier = table.combine_chunks(), by.cutoff, by.bonus, by.multiplier
    a = Texts.of(table if cut is None else table.slice(0, cut))
    b, shift = (a, 0) if cut is None else (Texts.of(table.slice(cut)), cut)
    n, more = a.codes.shape[1], b.codes.shape[1] - a.codes.shape[1]
    mutations = Mutations(table.column("muts").chunk(0))
    v, j = (by.genes(table.column(c).chunk(0)) for c in ("v", "j"))
    rank = pc.rank(table.column("id").chunk(0), tiebreaker="min").to_numpy().astype(np.int64)
    any_of = None
    if mutations.words is not None and bonus > 0:
        any_of = [np.bitwise_or.reduceat(mutations.words[at : at + t.counts.sum()], t.starts, axis=0) for t, at in ((a, 0), (b, shift))]
    for r, c, d in near_texts(a, b, cutoff, bonus, multiplier, by.by_position):
        if any_of:
            open_ = d > reach(n, more, 0, cutoff, bonus, multiplier)
            shared = common(any_of[0], r[open_], any_of[1], c[open_])
            open_[open_] = d[open_] > np.floor(cutoff * n + bonus * shared - multiplier * more + 1e-6)
            r, c, d = r[~open_], c[~open_], d[~open_]
        for x, y, far in of_texts(a, b, r, c, d):
            y = y + shift
            kept = rank[x] != rank[y]
            if cut is None:
                kept &= (far > 0) | (x < y)
            if star and not more:
                kept &= (far > 0) | (v[0][x] != v[0][y]) | (j[0][x] != j[0][y])
            x, y, far = x[kept], y[kept], far[kept]
            score = by.score(by.germline(v, j, x, y), far, mutations.shared(x, y), more, n)
            near = by.near(score)
            if near.any():
                yield x[near], y[near], score[near]


def block_edges(table: pa.Table, cut: int | None, by: Scoring, star: bool) -> Iterator[pa.RecordBatch]:
    """near_rows by their ids."""
    ids = table.column("id").combine_chunks()
    rank = pc.rank(ids, tiebreaker="min").to_numpy()
    for x, y, score in near_rows(table, cut, by, star):
        first = rank[x] < rank[y]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.where(first, x, y))), ids.take(pa.array(np.where(first, y, x))), pa.array(score)], names=["id_a", "id_b", "score"])


def spread_rows(rows: DataFrame, cutoff: float, bonus: float, multiplier: float, one_length: bool, block: int, *carried: str) -> DataFrame:
    """g, n, n_b (two lengths of a group), low, high (two blocks), side, id, v, j, cdr3, muts and the columns carried: a row for each block it meets."""
    widest = F.lit(0) if one_length else (F.lit(float(cutoff)) * F.col("n") + F.lit(max(0.0, float(bonus))) * F.least("most", "most_b")) / F.lit(1.0 + float(multiplier)) + 1e-6
    sizes = staged(rows.groupBy("g", "n").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max(F.size("muts")).alias("most")), "lengths")
    longer = sizes.select("g", F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("blocks").alias("blocks_b"))
    met = sizes.join(longer, "g").where((F.col("n_b") >= F.col("n")) & (F.col("n_b") - F.col("n") <= widest)).select(F.col("g").alias("_g"), F.col("n").alias("_n"), "n_b", "blocks", "blocks_b")
    met = F.broadcast(staged(met, "met-lengths"))
    # rows of one text stay together but for a text that would fill blocks
    own = lambda blocks: F.pmod(F.xxhash64("cdr3", F.pmod(F.xxhash64("id"), F.ceil(F.col(blocks) / 4))), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    columns = ["g", "_n", "n_b", "low", "high", "side", "id", "v", "j", "cdr3", "muts", *carried]
    equal = rows.join(met, (F.col("g") == F.col("_g")) & (F.col("n") == F.col("_n")) & (F.col("n_b") == F.col("_n"))).withColumn("own", own("blocks")).withColumn("other", each("blocks"))
    out = equal.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int")).select(*columns)
    if not one_length:
        first = rows.join(met, (F.col("g") == F.col("_g")) & (F.col("n") == F.col("_n")) & (F.col("n_b") > F.col("_n"))).withColumn("low", own("blocks")).withColumn("high", each("blocks_b")).withColumn("side", F.lit(0))
        second = rows.join(met, (F.col("g") == F.col("_g")) & (F.col("n") == F.col("n_b")) & (F.col("n_b") > F.col("_n"))).withColumn("low", each("blocks")).withColumn("high", own("blocks_b")).withColumn("side", F.lit(1))
        out = out.unionByName(first.select(*columns)).unionByName(second.select(*columns))
    return out.withColumnRenamed("_n", "n")


def met_in_blocks(rows: DataFrame, cutoff: float, bonus: float, multiplier: float, compare: Callable[[pa.Table, int | None], Iterator[pa.RecordBatch]], schema: str, one_length: bool = False, block: int | None = None, carried: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """What `compare` tells of each two blocks whose rows (id, grp, v, j, cdr3, muts and the columns carried) could be within the cutoff.

    It is given the rows of both, each side by CDR3 and then by `order`, and where the second begins (None: a block and itself).
    Rows of one id and CDR3 are in one block.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    muts = F.array_distinct(F.filter(F.coalesce("muts", F.array().cast("array<string>")), lambda m: m.isNotNull()))
    full = rows.where("cdr3 <> '' and id is not null").select(F.to_json(F.struct("grp"), {"ignoreNullFields": "false"}).alias("g"), F.length("cdr3").alias("n"), "id", "v", "j", "cdr3", muts.alias("muts"), *carried)
    key = ["g", "n", "n_b", "low", "high"]
    spread = spread_rows(full, cutoff, bonus, multiplier, one_length, block or BLOCK, *carried).repartition(4 * partitions, *key).sortWithinPartitions(*key, "side", "cdr3", *order)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, key):
            n, n_b, low, high = (table.column(c)[0].as_py() for c in key[1:])
            own = n == n_b and low == high
            cut = None if own else int(np.searchsorted(table.column("side").to_numpy(), 1))
            if own or 0 < cut < table.num_rows:
                yield from compare(table, cut)

    return spread.mapInArrow(found, schema)


def edges_in_blocks(rows: DataFrame, cutoff: float, bonus: float, multiplier: float, star: bool = False, one_length: bool = False, block: int | None = None, by: Scoring | None = None) -> DataFrame:
    """id_a, id_b, score of the pairs of rows (id, grp, v, j, cdr3, muts) of a group within the cutoff, once each.

    A score that `by` tells must not let in pairs at a distance that reach() says is too far.

    id_a is below id_b; rows without id or CDR3 have no edges. star leaves out pairs of equal genes and CDR3, one_length pairs
    of different lengths.
    """
    by = by or Scoring(cutoff, bonus, multiplier)
    return met_in_blocks(rows, cutoff, bonus, multiplier, lambda table, cut: block_edges(table, cut, by, star), EDGES, one_length, block)


def nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least Levenshtein distance of each code points x[p] to any of y, and the first y at it."""
    ends = min(x.shape[1], y.shape[1])
    alike = lambda a, b: (a == a[0]).all(axis=0) & (b == a[0]).all(axis=0)
    head = int(np.argmin(np.append(alike(x[:, :ends], y[:, :ends]), False)))
    tail = min(ends - head, int(np.argmin(np.append(alike(x[:, ::-1][:, :ends], y[:, ::-1][:, :ends]), False))))
    x, y = x[:, head : x.shape[1] - tail], y[:, head : y.shape[1] - tail]
    n, m = x.shape[1], y.shape[1]
    best, which = np.full(len(x), 1 << 30, np.int64), np.zeros(len(x), np.int64)
    kind = next((k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if m <= bits), None)
    if kind:
        found, number = np.unique(x, return_inverse=True)
        number, mask = number.reshape(x.shape), kind((1 << m) - 1)
    for q in range(0, len(y), MANY // 4):
        part = y[q : q + MANY // 4]
        if kind:
            where = np.zeros((len(found), len(part)), kind)
            for at in range(m):
                where |= (part[:, at] == found[:, None]).astype(kind) << kind(at)
        for p in range(0, len(x), FEW):
            if kind:
                up, down = np.full((len(x[p : p + FEW]), len(part)), mask), np.zeros((len(x[p : p + FEW]), len(part)), kind)
                for at in range(n):
                    eq = where[number[p : p + FEW, at]]
                    across = eq & up
                    across += up
                    across ^= up
                    across |= eq
                    eq |= down
                    right = across | up
                    np.invert(right, out=right)
                    right |= down
                    up &= across
                    right <<= kind(1)
                    right |= kind(1)
                    up <<= kind(1)
                    np.bitwise_and(right, eq, out=down)
                    right |= eq
                    up |= np.invert(right, out=right)
                up &= mask
                down &= mask
                far = np.bitwise_count(up).view(np.int8) - np.bitwise_count(down).view(np.int8)
            else:
                far = distance.levenshtein_block(x[p : p + FEW], part)
            at = far.argmin(axis=1)
            least = far[np.arange(len(far)), at].astype(np.int64) + (n if kind else 0)
            better = least < best[p : p + FEW]
            best[p : p + FEW] = np.where(better, least, best[p : p + FEW])
            which[p : p + FEW] = np.where(better, at + q, which[p : p + FEW])
    return best, which


def nearest_in_blocks(light: DataFrame, heavy: DataFrame, block: int = 1 << 15) -> DataFrame:
    """genes, cdr3, edits, center: for rows of light (genes, cdr3, at) the nearest of heavy (genes, center) of the length `at`.

    Ties go to the least center. light and heavy are cut into blocks; each two are one task's work, and a row leaves it for
    each block of centers. genes are texts.
    """
    partitions = int(light.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda df, name: df.groupBy(F.col("genes").alias("_g"), F.col("at").alias("_at")).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    lights, heavies = light.select("genes", F.col("cdr3").alias("text"), "at", F.length("cdr3").alias("n")), heavy.select("genes", F.col("center").alias("text"), F.length("center").alias("at"))
    per = light.groupBy(F.col("genes").alias("_g"), F.col("at").alias("_at"), F.length("cdr3").alias("_n")).agg(F.ceil(F.count("*") / block).cast("int").alias("lights"))
    met = F.broadcast(staged(per.join(count(heavies, "heavies"), ["_g", "_at"]), "met-centers"))
    on = (F.col("genes") == F.col("_g")) & (F.col("at") == F.col("_at"))
    own = lambda blocks: F.pmod(F.xxhash64("text"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    key = ["genes", "_n", "_at", "low", "high"]
    first = lights.join(met, on & (F.col("n") == F.col("_n"))).withColumn("low", own("lights")).withColumn("high", each("heavies")).select(*key, F.lit(1).alias("side"), "text")
    second = heavies.join(met, on).withColumn("low", each("lights")).withColumn("high", own("heavies")).select(*key, F.lit(0).alias("side"), "text")
    spread = first.unionByName(second).repartition(4 * partitions, *key).sortWithinPartitions(*key, "side", "text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, key):
            cut = int(np.searchsorted(table.column("side").to_numpy(), 1))
            if not 0 < cut < table.num_rows:
                continue
            text = table.column("text").combine_chunks()
            x, y = (distance.letters(t.to_pylist()) for t in (text.slice(cut), text.slice(0, cut)))
            best, which = nearest(x, y)
            genes = pa.array([table.column("genes")[0].as_py()] * len(x), pa.string())
            yield pa.RecordBatch.from_arrays([genes, text.slice(cut), pa.array(best.astype(np.int32)), text.take(pa.array(which))], names=["genes", "cdr3", "edits", "center"])

    return spread.mapInArrow(found, "genes string, cdr3 string, edits int, center string")

"""Near-duplicate documents by HyperMinHash sketches, banded registers and exact confirmation.

A sketch has a register for each of 128 buckets of the shingle hash: the leading-zero count of the bucket's smallest
hash and the mantissa bits behind its first one. Empty buckets borrow another's register along a fixed probe sequence.
Bands of r registers give a pair of Jaccard similarity s a common band with probability 1 - (1 - s^r)^(128 / r); r is the
largest with which fewer than one in a million pairs at the threshold is missed: 5 at 0.85 (4 in 10 million), 4 at 0.80
(1 in 10 million).

1. Documents with one shingle set are one class; its smallest doc_id stands for it.
2. In each band bucket every class is held against the bucket's smallest doc_id (linear in the bucket), after the
   collision-corrected register estimate; the shingle sets confirm.
3. Components of these links. Only buckets that still hold several components go on: there all pairs of different
   components are estimated in blocks of bounded size and confirmed on the sets. So no link between different texts is
   lost to step 2, and no task ever holds a whole bucket.
4. Components of all links.

Null, empty and blank texts have an empty set and link with nothing, and so do rows with a null doc_id (component_id is
null, kept is true). Rows of one doc_id are one document: what links with any of them links with all. Repeated rows are
returned each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import SMALL, need, slices, staged, unused
from .wordbytes import column_bytes, mixed, shingle_sets

BUCKET_BITS, MANTISSA_BITS = 7, 10
REGISTERS = 1 << BUCKET_BITS
#: Share of the pairs at the threshold that may share no band.
MISSED = 1e-6
#: Documents of a block in which all pairs are estimated.
BLOCK = 256
#: Chance that two registers of unrelated sets agree: cells are a 2^-10th part of an octave, on average ln 2 of it, and
#: two smallest values with one rate meet in a cell around x with density rate^2 exp(-2 rate x), which integrates to 1/4.
COLLISION = np.log(2) / 4 / (1 << MANTISSA_BITS)


@lru_cache(maxsize=1)
def probes() -> np.ndarray:
    """For each bucket the fixed order in which it looks for a register to borrow."""
    dice = np.random.default_rng(20231)
    return np.stack([dice.permutation(REGISTERS) for _ in range(REGISTERS)])


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sets, REGISTERS) 16-bit registers, and how many buckets each set fills itself. Sets are sorted distinct hashes."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    filled = np.zeros((len(sets), REGISTERS), bool)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out, filled.sum(axis=1)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = row * REGISTERS + bucket
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])  # sorted, so a bucket's first value is its smallest
    rest = (values[first] << np.uint64(BUCKET_BITS)) | np.uint64(1)
    zeros = 63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros - ((rest << np.clip(zeros, 0, 63).astype(np.uint64)) < np.uint64(1 << 63)) * -1, 0, 63)
    head = rest << zeros.astype(np.uint64)
    mantissa = (head >> np.uint64(63 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out[row[first], bucket[first]] = (zeros << MANTISSA_BITS) + mantissa.astype(np.int64)
    filled[row[first], bucket[first]] = True
    own = filled.sum(axis=1)
    sparse = np.flatnonzero((own > 0) & (own < REGISTERS))
    if len(sparse):
        order, missing = probes(), ~filled[sparse]
        source = np.tile(np.arange(REGISTERS), (len(sparse), 1))
        for turn in range(REGISTERS):
            if not missing.any():
                break
            r, b = np.nonzero(missing)
            candidate = order[b, turn]
            hit = filled[sparse[r], candidate]
            source[r[hit], b[hit]] = candidate[hit]
            missing[r[hit], b[hit]] = False
        out[sparse] = np.take_along_axis(out[sparse], source, axis=1)
    return out, own


def band_rows(percent: int) -> int:
    """Registers to a band for pairs at `percent`."""
    s = percent / 100
    return max((r for r in range(1, 17) if (1 - s**r) ** (REGISTERS // r) <= MISSED), default=1)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys of each band's registers."""
    bands = REGISTERS // rows
    parts = registers[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(parts), 1))
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return key


def estimate_passes(equal: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Whether the collision-corrected estimate from `equal` registers is within five standard deviations of `least`."""
    jaccard = (equal / REGISTERS - COLLISION) / (1 - COLLISION)
    return jaccard >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(own, 1)) - 1e-9


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    at = np.searchsorted(b, a)
    common = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (the set's 128-bit hash), own and regs of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL):
            sets = shingle_sets(*column_bytes(batch.column("text")), words)
            regs, own = sketch(sets)
            ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(own.astype(np.int32)), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "n_shingles", "s1", "s2", "own", "regs"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_shingles long, s1 long, s2 long, own int, regs binary")


def text_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """shingle_sets of a column, some texts at a time."""
    parts = slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text", SMALL)
    return [s for part in parts for s in shingle_sets(*column_bytes(part.column("text")), words)]


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(classes: DataFrame, per_band: int) -> DataFrame:
    """key, doc_id of every class and band."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(matrix(batch.column("regs")), per_band)
                ids = np.repeat(batch.column("doc_id").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64).reshape(-1)), pa.array(ids)], names=["key", "doc_id"])

    return classes.select("doc_id", "regs").mapInArrow(rows, "key long, doc_id long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (doc_id, pivot) those that link, as src, dst. Each row brings both texts together."""
    both = pairs.join(texts, pairs["doc_id"] == texts["_id"]).select("pivot", "doc_id", F.col("text").alias("text_a"))
    both = both.join(texts, both["pivot"] == texts["_id"]).select("pivot", "doc_id", "text_a", F.col("text").alias("text_b"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", SMALL):
            pivot, doc = batch.column("pivot").to_numpy(), batch.column("doc_id").to_numpy()
            ours = shingle_sets(*column_bytes(batch.column("text_a")), words)
            new = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]]) if len(pivot) else np.zeros(0, np.int64)
            theirs = text_sets(batch.column("text_b").take(pa.array(new)), words)
            which = np.searchsorted(new, np.arange(len(pivot)), side="right") - 1
            texts_b = batch.column("text_b")
            ok = np.array([linked(ours[i], theirs[w], percent) or (new[w] != i and texts_b[int(new[w])] != texts_b[i] and linked(ours[i], shingle_sets(*column_bytes(texts_b.slice(i, 1)), words)[0], percent)) for i, w in enumerate(which.tolist())], bool)
            yield pa.RecordBatch.from_arrays([pa.array(pivot[ok]), pa.array(doc[ok])], names=["src", "dst"])

    return both.mapInArrow(rows, "src long, dst long")


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of equal values of a sorted column, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == 0 and held and held[-1].column(column)[0].as_py() != int(values[0]):
                yield pa.Table.from_batches(held)
                held = []
            elif a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def blocks(members: DataFrame) -> DataFrame:
    """Members (key, doc_id, n, ...) once for each pair of blocks of their bucket: adds g (the pair of blocks), side.

    side 0 and 1 are the two blocks, 2 a block held against itself. A bucket of n rows makes (n / BLOCK)^2 / 2 groups.
    """
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), count).cast("int")
    spread = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), count - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int"))
    return spread.withColumn("g", F.xxhash64("key", low, high)).withColumn("side", side).drop("_own", "_other", "n")


def residual_links(members: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int, partitions: int) -> DataFrame:
    """Links between different components inside buckets: members are key, doc_id, n (of the bucket), component."""
    least, per_band = percent / 100, band_rows(percent)

    def allowed(table: pa.Table) -> np.ndarray:
        comp, side = table.column("component").to_numpy(), table.column("side").to_numpy()
        ok = comp[:, None] != comp[None, :]
        ok &= ((side[:, None] == 0) & (side[None, :] == 1)) | ((side[:, None] == 2) & (side[None, :] == 2) & np.triu(np.ones((len(side),) * 2, bool), 1))
        return ok

    def passing(table: pa.Table, regs: np.ndarray, own: np.ndarray) -> np.ndarray:
        ok = allowed(table)
        r, c = np.nonzero(ok)
        for at in range(0, len(r), 20_000):
            a, b = r[at : at + 20_000], c[at : at + 20_000]
            ok[a, b] = estimate_passes((regs[a] == regs[b]).sum(axis=1), np.minimum(own[a], own[b]), least)
        return ok

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "g"):
            regs = matrix(table.column("regs"))
            ok = passing(table, regs, table.column("own").to_numpy())
            if ok.any():  # a pair is taken up in the first band that it shares
                r, c = np.nonzero(ok)
                keys = band_keys(regs, per_band).astype(np.int64)
                ok[r, c] = keys[r, (keys[r] == keys[c]).argmax(axis=1)] == table.column("key").to_numpy()[r]
                hit = ok.any(axis=0) | ok.any(axis=1)
                if hit.any():
                    yield from table.select(["g", "side", "doc_id", "component"]).filter(pa.array(hit)).to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "g"):
            sets = text_sets(table.column("text").combine_chunks(), words)
            regs, own = sketch(sets)
            ids, comp = table.column("doc_id").to_pylist(), table.column("component").to_pylist()
            root = {c: c for c in comp}

            def find(c: int) -> int:
                while root[c] != c:  # noqa: B023
                    root[c] = c = root[root[c]]  # noqa: B023
                return c

            out = []
            for a, b in zip(*(x.tolist() for x in np.nonzero(passing(table, regs, own))), strict=True):
                if (x := find(comp[a])) != (y := find(comp[b])) and linked(sets[a], sets[b], percent):
                    root[x] = y
                    out.append((ids[a], ids[b]))
            if out:
                src, dst = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    spread = blocks(members.join(classes.select("doc_id", "own", "regs"), "doc_id"))
    spread = spread.select("g", "side", "key", "doc_id", "component", "own", "regs").repartition(partitions, "g").sortWithinPartitions("g", "doc_id")
    chosen = staged(spread.mapInArrow(promising, "g long, side int, doc_id long, component long"), "promising")
    full = chosen.join(texts, F.col("doc_id") == F.col("_id")).select("g", "side", "doc_id", "component", "text")
    return full.repartition(partitions, "g").sortWithinPartitions("g", "doc_id").mapInArrow(confirm, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; percent is the least Jaccard similarity of a link."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(sketches(docs, words), "sketches")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    # with at most `limit` shingles only equal sets can reach percent
    limit = percent // (100 - percent) if percent < 100 else None
    sets = staged(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    classes = known.join(sets.select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), "rep"), (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("doc_id") == F.col("rep")))
    classes = staged(classes.select("doc_id", "n_shingles", "own", "regs").where(F.col("n_shingles") >= limit if limit is not None else F.lit(False)).dropDuplicates(["doc_id", "regs"]), "class-sketches")
    keys = staged(bands(classes, band_rows(percent)), "bands")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("_last"), F.count("*").alias("n")).where("pivot < _last")
    members = staged(keys.join(shared.select(F.col("key").alias("_key"), "pivot", "n"), F.col("key") == F.col("_key")).select("key", "doc_id", "pivot", "n"), "members")

    # the only time that all texts move: those of documents that share a bucket are kept aside
    asked = members.select(F.col("doc_id").alias("_asked")).distinct().hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    texts = staged(texts.join(asked, F.col("_id") == F.col("_asked"), "left_semi"), "texts")

    pairs = members.where("doc_id <> pivot").select("doc_id", "pivot").distinct()
    regs = classes.select(F.col("doc_id").alias("_id"), "own", "regs")
    near = pairs.join(regs, F.col("doc_id") == F.col("_id")).select("doc_id", "pivot", F.col("own").alias("own_a"), F.col("regs").alias("regs_a"))
    near = near.join(regs, F.col("pivot") == F.col("_id")).select("doc_id", "pivot", "own_a", "regs_a", "own", "regs")

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = (matrix(batch.column("regs_a")) == matrix(batch.column("regs"))).sum(axis=1)
                own = np.minimum(batch.column("own_a").to_numpy(), batch.column("own").to_numpy())
                yield batch.select(["doc_id", "pivot"]).filter(pa.array(estimate_passes(equal, own, percent / 100)))

    near = staged(near.mapInArrow(estimated, "doc_id long, pivot long").distinct(), "near")
    # a document with several texts joins their classes
    several = known.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("a"), F.max(F.struct("s1", "s2")).alias("b")).where("a <> b").select(F.col("doc_id").alias("_doc"))
    same = known.join(several, F.col("doc_id") == F.col("_doc")).join(sets.select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), "rep"), (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2"))).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    links = staged(confirmed(near, texts, words, percent).unionByName(same), "links")
    first = staged(connected_components(links), "components")

    placed = members.join(first, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    mixed_keys = placed.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b").select(F.col("key").alias("_key"))
    left = staged(placed.join(mixed_keys, F.col("key") == F.col("_key")).drop("_key"), "mixed")
    late = staged(residual_links(left, classes, texts, words, percent, partitions), "late-links")
    if not late.isEmpty():
        first = staged(connected_components(links.unionByName(late)), "components")

    home = sets.join(first, F.col("rep") == F.col("node"), "left").select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(home, (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, but for those of a document that is not its group's smallest doc_id."""
    name = unused(docs, "_near_gone")
    gone = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct().hint("shuffle_hash")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")

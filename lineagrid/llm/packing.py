"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

All pieces of one length are alike to best fit, so the exact best-fit-decreasing result follows from the histogram of
lengths: at most `capacity` numbers, whatever the corpus. The plan is made from it with a segment tree over remaining
capacities; Spark then ranks the pieces of each length (counts for each length and bucket, a prefix sum over buckets, a
row number inside a bucket) and looks the rank up in the plan. No length is collected into one task.

Nulls and empty texts are texts without tokens (the end id alone makes them a piece of length 1; with no end id they
give no piece). A text of any length is encoded whole and cut into pieces, one row in a worker's memory. Repeated rows are
packed each, and spread: `copy` counts the rows of a doc_id in a batch. Other columns of the input are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, slices, staged, texts
from .tokens import encoder

#: Pieces to a bucket, over all lengths; and the least number of buckets, so that one common length is dealt out too.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 32
#: Words that a worker remembers (some 40 MB): fewer than elsewhere, since executors sort here between tasks that encode.
WORDS = 250_000
#: What orders pieces of one length.
ORDER = ["doc_id", "piece", "copy"]


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: how many open bins each holds."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        node = remaining + self.leaves
        while node:
            self.count[node] += n
            node //= 2

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity >= size of which a bin is open."""
        node = size + self.leaves
        if self.count[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Runs of the best-fit-decreasing result, ordered: rows (length, first rank, pieces a bin, first bin, offset in the bin).

    Piece number r of a length belongs to the last run of that length whose first rank is not above r.
    """
    tree, open_bins, bins, runs = CapacityTree(capacity), defaultdict(deque), 0, []

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_bins[remaining].append((first, n))
            tree.add(remaining, n)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            else:
                first, n = open_bins[room].popleft()
                tree.add(room, -n)
            each = room // size
            full = min(n, left // each)
            if full:
                runs.append((size, rank, each, first, capacity - room))
                put(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer pieces than would fill the next bin
                runs.append((size, rank, left, first + full, capacity - room))
                put(room - left * size, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int | None, with_ids: bool = False) -> DataFrame:
    """The documents' token ids, cut where longer than capacity: doc_id, copy, piece, start, length, ids_crc32 (and ids).

    copy is 0 but for rows of a doc_id that stood before in the same batch.
    """
    need(docs, "doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, copy int, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, WORDS).encode
        for whole in batches:
            seen: Counter = Counter()
            for batch in slices([whole], "text"):
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((doc, seen[doc], k, at // 4, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
                    seen[doc] += 1
                if rows:
                    kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names[: len(rows[0])])

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to `items`, whose column length is 1..capacity. `order` names rows inside a length.

    `items` is read three times: hand in a stored table.
    """
    need(items, "length", *order)
    buckets = max(LEAST_BUCKETS, -(-items.count() // BUCKET_ROWS))
    items = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = items.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_length"), F.col("_bucket").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must be 1..{capacity}")
    runs = plan(histogram, capacity)
    keys = runs[:, 0] * (1 << 48) + runs[:, 1]
    inside = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = items.withColumn("_rank", F.row_number().over(inside)).join(base, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_in")))
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_base")).drop("_length", "_in", "_base", "_bucket")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            run = runs[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            bin_, place_ = np.divmod(rank - run[:, 1], np.maximum(run[:, 2], 1))
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(run[:, 3] + bin_), pa.array(run[:, 4] + place_ * length)], names=[*names, "sequence_id", "offset"])

    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 0, with_ids: bool = False) -> DataFrame:
    """Tokenises and packs documents: a row for each piece with its sequence_id and offset (and its ids, as bytes)."""
    cut = staged(pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    return pack(cut, capacity, ORDER).drop("copy")

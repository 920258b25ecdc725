"""Line dedup over the whole corpus by range-partitioned line hashes; the result is a keep bitmap for each document.

Every line's 128-bit key hash is range-partitioned together with its document, so that a line found in a third of all
documents spreads over many partitions, and sorted by (hash, document, position). Each partition is streamed once: a run
of one hash that reaches `min_docs` documents loses its lines at once. Only the first and the last hash of a partition
can go on elsewhere; their counts (two rows a partition at most) are added up and sent to the few lines that wait.

Null and empty texts are one empty line; keys shorter than min_chars code points are never dropped; a text of any length
is one row and is split whole. Rows of one doc_id count as one document, whatever their texts; rows equal in doc_id and
text get the same bitmap: a task hashes such a row once (of the last REMEMBERED different rows it saw), and a position is
gathered once, so a row that makes up a third of the table neither fills one partition nor one list. A null doc_id is an id like any other. The operator hands all columns on, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, numbered, numbered_schema, quoted, slices, staged, unused

KEY = ["h1", "h2"]
DOC = ["doc_id", "_text"]
DROP, WAITS, COUNT = 0, 1, 2
#: Rows of an undecided line that a task holds.
WAITING = 100_000
#: Different rows that a task remembers, to hash repeated ones once.
REMEMBERED = 100_000


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased (bytes methods do just that)."""
    return line.strip().lower()


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, _text (the text's hash) and pos of every line whose key is long enough; a task leaves repeated rows out."""
    schema = f"h1 long, h2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, _text long, pos int"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches, "text"):
            digests, rows, places = [], [], []
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist(), strict=True)
            for row, (key, text) in enumerate(zip(keys, batch.column("text"), strict=True)):
                if key in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                for place, line in enumerate((text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        places.append(place)
            if rows:
                h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("doc_id").take(at), batch.column("_text").take(at), pa.array(places, pa.int32())], names=[*KEY, *DOC, "pos"])

    return docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_text"), "text").mapInArrow(hashed, schema)


def frequent_lines(hashes: DataFrame, min_docs: int, partitions: int, most_waiting: int = WAITING) -> DataFrame:
    """doc_id, _text, pos of the lines whose key min_docs documents hold at least. `hashes` should be a stored table."""
    ordered = hashes.repartitionByRange(partitions, *KEY, "doc_id").sortWithinPartitions(*KEY, *DOC, "pos")
    id_type = hashes.schema["doc_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n_docs, last, waiting, keys_seen, early = None, 0, None, [], 0, False

        def marked(part: pa.RecordBatch, state: int, n: int = 0) -> pa.RecordBatch:
            return part.append_column("state", pa.array(np.full(part.num_rows, state, np.int32))).append_column("n", pa.array(np.full(part.num_rows, n, np.int64)))

        def finish(edge: bool) -> Iterator[pa.RecordBatch]:
            if key is not None and (edge or early):
                for part in waiting:
                    yield marked(part, WAITS)
                yield marked(sample.slice(0, 1), COUNT, n_docs).set_column(0, "h1", pa.array([key[0]])).set_column(1, "h2", pa.array([key[1]]))

        for batch in batches:
            if not batch.num_rows:
                continue
            sample = batch
            h1, h2 = (batch.column(c).to_numpy() for c in KEY)
            ids = pc.dictionary_encode(batch.column("doc_id"), null_encoding="encode").indices.to_numpy()
            new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_key | np.r_[True, ids[1:] != ids[:-1]]
            starts = np.flatnonzero(new_key)
            ends = np.r_[starts[1:], batch.num_rows]
            counts = np.add.reduceat(new_doc.astype(np.int64), starts)
            inner = np.ones(len(starts), bool)  # runs that begin and end inside this batch
            inner[0] = inner[-1] = False
            drop = np.repeat(inner & (counts >= min_docs), ends - starts)
            if drop.any():
                yield marked(batch.filter(pa.array(drop)), DROP)
            for i in dict.fromkeys((0, len(starts) - 1)):
                first, end = int(starts[i]), int(ends[i])
                part, now = batch.slice(first, end - first), (int(h1[first]), int(h2[first]))
                if now != key:
                    yield from finish(edge=keys_seen == 1)
                    key, n_docs, last, waiting, keys_seen, early = now, 0, None, [], keys_seen + 1, False
                n_docs += int(counts[i]) - ((part.column("doc_id")[0].as_py(),) == last)
                last = (part.column("doc_id")[-1].as_py(),)
                waiting.append(part)
                if n_docs >= min_docs:
                    for part in waiting:
                        yield marked(part, DROP)
                    waiting = []
                elif sum(part.num_rows for part in waiting) > most_waiting:
                    # few documents repeat the line this often: its count decides behind the run, as at an edge
                    for part in waiting:
                        yield marked(part, WAITS)
                    waiting, early = [], True
        yield from finish(edge=True)

    found = staged(ordered.mapInArrow(runs, f"h1 long, h2 long, doc_id {id_type}, _text long, pos int, state int, n long"), "line-runs")
    # two rows a partition for its edges, and one for WAITING rows at most, whatever the lines are
    edges = found.where(F.col("state") == COUNT).groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select(*KEY)
    late = found.where(F.col("state") == WAITS).join(F.broadcast(edges), KEY, "left_semi")
    return found.where(F.col("state") == DROP).unionByName(late).select(*DOC, "pos")


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """A compressed bitmap of kept lines: the highest bit of the first byte is line 0, lines behind its end are kept."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8 if len(dropped) else 0, bool)  # whole bytes, else their last bits would read as dropped
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_lines(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of n lines the bitmap keeps; None keeps all."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[: len(bits)] = bits != 0
    return keep


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, partitions: int | None = None) -> DataFrame:
    """doc_id, _text and keep_bitmap of the documents that lose lines; a document without a row keeps all."""
    need(docs, "doc_id", "text")
    hashes = staged(line_hashes(docs, min_chars), "line-hashes")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dropped = frequent_lines(hashes, min_docs, n).groupBy(*DOC).agg(F.collect_set("pos").alias("dropped"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [pack_bitmap(d.values.to_numpy()) for d in batch.column("dropped")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_text"), pa.array(maps, pa.binary())], names=[*DOC, "keep_bitmap"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return dropped.mapInArrow(packed, f"doc_id {id_type}, _text long, keep_bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """All documents with one more column, the bitmap (null: keep all), and that column's name.

    Only texts' own partitions move; the bitmaps are hashed in memory.
    """
    names = [unused(docs, n) for n in ("_line_doc", "_line_text", "_line_bitmap")]
    right = bitmaps.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "_text", "keep_bitmap"), names, strict=True)]).hint("shuffle_hash")
    same_text = F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col(names[1])
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col(names[0])) & same_text, "left").drop(*names[:2]), names[2]


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents' rows with the frequent lines taken out of `text` (null stays null); all columns are kept."""
    joined, bitmap_name = with_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars))
    plain, columns = numbered(joined.select(*quoted(*docs.columns, bitmap_name)))
    at = columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}"):
            out = []
            for text, bitmap in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is not None and bitmap is not None:
                    lines = text.split("\n")
                    text = "\n".join([x for x, k in zip(lines, kept_lines(bitmap, len(lines)).tolist(), strict=True) if k])
                out.append(text)
            yield batch.select(batch.schema.names[:-1]).set_column(at, f"c{at}", pa.array(out, pa.string()))

    return plain.mapInArrow(apply, numbered_schema(docs.schema)).toDF(*docs.columns)


def line_digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the kept lines joined by a line feed) of every document."""
    joined, bitmap_name = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, min_docs, min_chars))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, bitmap in zip(batch.column("text"), batch.column(bitmap_name).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = data.split(b"\n")
                if bitmap is not None:
                    keep = kept_lines(bitmap, len(lines)).tolist()
                    data = b"\n".join([x for x, k in zip(lines, keep, strict=True) if k])
                    rows.append((len(lines), len(lines) - sum(keep), hashlib.sha256(data).hexdigest()))
                else:
                    rows.append((len(lines), 0, hashlib.sha256(data).hexdigest()))
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")

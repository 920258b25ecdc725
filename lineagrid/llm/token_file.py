"""Token files: patched frame-of-reference blocks, written and read by Spark on any file system it knows.

A file holds one shard, all numbers little-endian:

    "PFB1" | u32 partition | u32 shard | u64 ids of this partition before it | u32 documents n | u64 ids m | u32 blocks k | u32 block length
    i64 doc_id x n | u64 ids of each document x n | u32 place of each block from the first block's byte x (k + 1)
    blocks: u32 minimum | u8 width | u16 exceptions e | packed (value - minimum) mod 2^width | u16 place x e | u32 value - minimum x e
    one byte 0x0A

A block's width is the number of bits that the `percentile` of its values (less the minimum) needs; values that need
more are its exceptions. Shards of a partition follow one another, and so do partitions, in ascending doc_id order.

Null and empty texts are documents of the end id alone; a text of any length is one document, encoded whole. A null doc_id
is stored as -2^63 and the number of ids with its highest bit set, so that a true -2^63 stays itself. Repeated rows are stored
each, and spread over partitions. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need, slices, texts
from .tokens import encoder

MAGIC = b"PFB1"
HEAD = struct.Struct("<4sIIQIQII")
BLOCK_HEAD = 7
NO_ID, NULL_BIT = -(1 << 63), 1 << 63


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits needed by each unsigned 32-bit value."""
    return np.frexp(values.astype(np.float64))[1]


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, length) values below 2^width as (blocks, bytes), the highest bit first."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    kind = ">u2" if width <= 16 else ">u4"
    bits = np.unpackbits(values.astype(kind).view(np.uint8).reshape(*values.shape, -1), axis=2)
    return np.packbits(bits[:, :, bits.shape[2] - width :].reshape(len(values), -1), axis=1)


def unpack_bits(packed: np.ndarray, width: int, length: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), length), np.uint32)
    bits = np.unpackbits(packed, axis=1, count=length * width).reshape(len(packed), length, width)
    kind, size = (">u2", 16) if width <= 16 else (">u4", 32)
    wide = np.zeros((len(packed), length, size), np.uint8)
    wide[:, :, size - width :] = bits
    return np.packbits(wide, axis=2).reshape(len(packed), -1).view(kind).astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = 256, percentile: float = 99.0) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes and where each starts. A last short block is filled up with its own minimum."""
    n_blocks = -(-len(ids) // block)
    out: list[bytes] = [b""] * n_blocks
    for at in range(0, n_blocks, 1024):
        part = ids[at * block : (at + 1024) * block].astype(np.uint32)
        short = -len(part) % block
        if short:
            part = np.concatenate([part, np.full(short, part[-(len(part) % block) :].min(), np.uint32)])
        part = part.reshape(-1, block)
        low = part.min(axis=1)
        part = part - low[:, None]
        cut = np.sort(part, axis=1)[:, min(block - 1, int(np.ceil(block * percentile / 100)) - 1)]
        widths = bit_widths(cut)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            over = part[rows] >> np.uint32(width) if width < 32 else np.zeros_like(part[rows])
            packed = pack_bits(part[rows] & np.uint32((1 << int(width)) - 1), int(width))
            hit = over != 0
            for k, r in enumerate(rows.tolist()):
                places = np.flatnonzero(hit[k])
                out[at + r] = struct.pack("<IBH", low[r], width, len(places)) + packed[k].tobytes() + places.astype("<u2").tobytes() + part[r][places].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(b) for b in out], dtype=np.int64)])
    return b"".join(out), starts


def decode_blocks(data: bytes, starts: np.ndarray, n_ids: int, block: int) -> np.ndarray:
    """The ids of encode_blocks, in blocks of one width at a time."""
    raw, starts = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)
    first = starts[:-1]
    if not len(first):
        return np.zeros(0, np.uint32)
    head = raw[first[:, None] + np.arange(BLOCK_HEAD)]
    low, width, n_over = head[:, :4].copy().view("<u4")[:, 0], head[:, 4], head[:, 5:7].copy().view("<u2")[:, 0]
    out = np.empty((len(first), block), np.uint32)
    for w in np.unique(width).tolist():
        size = -(-block * w // 8)
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 1024)):
            packed = raw[first[part][:, None] + BLOCK_HEAD + np.arange(size)]
            out[part] = unpack_bits(packed, w, block)
    for r in np.flatnonzero(n_over).tolist():
        at, n = first[r] + BLOCK_HEAD + -(-block * int(width[r]) // 8), int(n_over[r])
        out[r, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    return (out + low[:, None]).reshape(-1)[:n_ids]


def encode_shard(partition: int, shard: int, before: int, doc_ids: list[int | None], documents: list[bytes], block: int, percentile: float) -> bytes:
    ids = np.frombuffer(b"".join(documents), "<u4")
    data, starts = encode_blocks(ids, block, percentile)
    head = HEAD.pack(MAGIC, partition, shard, before, len(doc_ids), len(ids), len(starts) - 1, block)
    sizes = np.array([len(d) // 4 | (NULL_BIT if i is None else 0) for i, d in zip(doc_ids, documents, strict=True)], "<u8")
    return b"".join([head, np.array([NO_ID if i is None else i for i in doc_ids], "<i8").tobytes(), sizes.tobytes(), starts.astype("<u4").tobytes(), data])


def decode_shard(content: bytes) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """partition, ids before the shard in its partition, doc_ids, which of them are null, ids of each document, ids."""
    magic, partition, _, before, n, m, k, block = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    doc_ids = np.frombuffer(content, "<i8", n, at)
    sizes = np.frombuffer(content, "<u8", n, at := at + 8 * n)
    starts = np.frombuffer(content, "<u4", k + 1, at := at + 8 * n)
    at += 4 * (k + 1)
    absent = sizes >> np.uint64(63) == 1
    sizes = (sizes & np.uint64(NULL_BIT - 1)).astype(np.int64)
    return partition, before, doc_ids, absent, sizes, decode_blocks(content[at : at + int(starts[-1])], starts, m, block)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, shard_ids: int = 2 << 20, block: int = 256, percentile: float = 99.0, partitions: int | None = None) -> None:
    """Tokenises documents in ascending doc_id order into token files of about shard_ids ids under `path`."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        doc_ids, documents, held, before, shard = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_shard(partition, shard, before, doc_ids, documents, block, percentile)], pa.binary())], names=["shard"])

        for batch in slices(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                if documents and held + len(ids) // 4 > shard_ids:
                    yield close()
                    doc_ids, documents, held, before, shard = [], [], 0, before + held, shard + 1
                doc_ids.append(doc)
                documents.append(ids + end)
                held += len(documents[-1]) // 4
        if documents:
            yield close()

    # The range's ends come from a sample of the rows; a third of all rows with one doc_id spreads by the text's hash, and
    # rows that are alike by their number.
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    ordered = keyed.repartitionByRange(n, "doc_id", "_h", "_row").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    # Spark's text writer puts a string's bytes into the file as they are, and a line feed behind: binary files on any store.
    ordered.mapInArrow(shards, "shard binary").select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, partition, local_start (ids of the partition before it), n_tokens, ids_crc32 (and ids)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                partition, before, doc_ids, absent, sizes, ids = decode_shard(content.as_buffer().to_pybytes())
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                parts = [data[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, mask=absent), pa.array(np.full(len(doc_ids), partition, np.int32)), pa.array(before + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, names=["doc_id", "partition", "local_start", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, partition int, local_start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(documents, schema)


def with_global_start(read: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before. The one-task window sees a row for each written partition only."""
    totals = read.groupBy("partition").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("partition", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return read.join(base, "partition").withColumn("start", F.col("local_start") + F.col("_base")).drop("_base")

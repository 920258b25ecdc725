"""Benchmark decontamination with one Aho-Corasick automaton over the words of all items.

Texts are normalised to words (letters, digits and all non-ASCII characters, A-Z lower-cased). Every window of `window`
consecutive item words is a pattern, an item of fewer words is one pattern; the automaton runs over word numbers, so each
text is scanned once however many patterns there are, and word numbers map back to byte offsets of the original.

An automaton has at most `automaton_nodes` nodes (about 100 bytes each in a Python worker). A benchmark with more is cut
into groups of windows, however long its items are. The corpus is then read once for all groups: hashes of each text's
word windows are looked up in a Bloom filter of the benchmark's windows, and texts that can hold one are stored, each
different text once. The groups are read one at a time and scan these candidates only; hits are stored under a hash of
the text, so that no more than one automaton is alive anywhere. The hits are then added up and joined to the documents.
The filter has FILTER_BITS bits a window, MOST_BITS at most; a fuller filter lets more texts through, the rows are the
same.

Null and empty texts have no words and hit nothing; a text of any length is one row and scanned whole; items without
words have no window. Repeated items with one id count as one; an item with a null id hits words like any other and is
not listed or counted among the items. Repeated documents are returned each. All columns are handed on, whatever their
names; an empty benchmark contaminates nothing, an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, numbered, numbered_schema, quoted, slices, staged, unused
from .wordbytes import column_bytes, mixed, powers, word_hashes, word_spans

#: The columns that a scan adds.
ADDED = ("n_words", "n_hit", "items", "spans")
#: Nodes of one automaton: about 100 MB of each Python worker.
AUTOMATON_NODES = 1 << 20
#: The window filter: bits for each window, bits in all (64 MB of each Python worker), places looked at.
FILTER_BITS, MOST_BITS, PROBES = 64, 1 << 29, 4


def normalising_table() -> bytes:
    """A-Z to a-z, digits, a-z and high bytes to themselves, the rest to blanks."""
    table = bytearray(b" " * 256)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[low:high] = bytes(range(low, high))
    table[0x41:0x5B] = bytes(range(0x61, 0x7B))
    return bytes(table)


NORMAL = normalising_table()
NORMAL_BYTES = np.frombuffer(NORMAL, np.uint8)
IS_BLANK = np.arange(256) == 0x20


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def word_places(text: bytes) -> np.ndarray:
    """(words, 2) byte offsets of the words in the original text."""
    inside = np.concatenate([[False], np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges.reshape(-1, 2)


class Benchmark:
    """Words of items and the automaton of their windows; it is built in each Python worker that asks for it."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.names = sorted({i for i, _ in items if i is not None})
        number = {n: k for k, n in enumerate(self.names)}
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item, words in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[at : at + window])].update([] if item is None else [number[item]])
        self.patterns = [(p, sorted(o)) for p, o in owners.items()]
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def build(self):
        if self.automaton is None and self.patterns:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for k, (p, _) in enumerate(self.patterns):
                self.automaton.add_word(p, k)
            self.automaton.make_automaton()
        return self.automaton

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the names of the items found."""
        hit, items = np.zeros(len(words) + 1, np.int32), set()
        if (automaton := self.build()) and words:
            look = self.words.get
            for end, k in automaton.iter(tuple([look(w, 0) for w in words])):
                pattern, owners = self.patterns[k]
                hit[end - len(pattern) + 1] += 1
                hit[end + 1] -= 1
                items.update(owners)
        return np.cumsum(hit[:-1]) > 0, [self.names[k] for k in sorted(items)]


def window_groups(benchmark: DataFrame, id_column: str, window: int, most_nodes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items' words in groups whose windows need at most most_nodes nodes, one group at a time on the driver.

    A longer item goes in pieces that overlap by one word less than a window, so that each window is in one piece.
    """
    group, held = [], 0
    per = max(1, most_nodes // window)
    for item, text in benchmark.select(F.col(id_column).cast("string"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        words = normal_words(text.encode())
        for at in range(0, max(1, len(words) - window + 1) if words else 0, per):
            piece = words[at : at + per + window - 1]
            nodes = max(1, len(piece) - window + 1) * min(window, len(piece))
            if group and held + nodes > most_nodes:
                yield group
                group, held = [], 0
            group.append((item, piece))
            held += nodes
    yield group


def word_ranges(hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words: number of the first, and of the one behind the last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


RANGES = "array<struct<start:long,end:long>>"
RANGE = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def window_hashes(column: pa.Array, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: hashes of the texts' windows of so many words, the text's row, and how many words that text has."""
    data, offsets = column_bytes(column)
    data = NORMAL_BYTES[data]
    starts, ends, first = word_spans(data, offsets, IS_BLANK)
    up, down = powers(len(starts))
    total = np.concatenate([[np.uint64(0)], np.cumsum(word_hashes(data, starts, ends) * up[: len(starts)], dtype=np.uint64)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n in lengths:
        at = np.flatnonzero(np.arange(len(starts)) + n <= first[row + 1])
        yield mixed((total[at + n] - total[at]) * down[at] + np.uint64(n)), row[at], np.diff(first)[row[at]]


def probe(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each hash in a filter; bits is a power of two."""
    return mixed(hashes + np.uint64(k) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def window_filter(benchmark: DataFrame, window: int, most_bits: int = MOST_BITS) -> tuple[np.ndarray, list[int]]:
    """The filter's 64-bit words, and the lengths that the benchmark's windows have. Its size is bounded by most_bits."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for n, (h, _, words) in zip(range(1, window + 1), window_hashes(batch.column("text"), list(range(1, window + 1))), strict=True):
                h = h[words == n] if n < window else h  # an item of fewer words is one window
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32))], names=["h", "n"])

    hashes = staged(benchmark.select("text").where("text is not null").mapInArrow(hashed, "h long, n int").distinct(), "benchmark-windows")
    counts = {r["n"]: r["count"] for r in hashes.groupBy("n").count().collect()}
    bits = min(most_bits, max(64, 1 << (FILTER_BITS * sum(counts.values()) - 1).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(PROBES):
                at = probe(batch.column("h").to_numpy().view(np.uint64), k, bits)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    filled = hashes.select("h").mapInArrow(placed, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return words, sorted(counts)


def candidates(docs: DataFrame, benchmark: DataFrame, window: int, most_bits: int = MOST_BITS) -> DataFrame:
    """_h1, _h2 and text of each different text that can hold a window of the benchmark, stored; one pass over docs."""
    words, lengths = window_filter(benchmark, window, most_bits)
    shared, bits = docs.sparkSession.sparkContext.broadcast(words), 64 * len(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            can = np.zeros(batch.num_rows, bool)
            for hashes, row, _ in window_hashes(batch.column("text"), lengths):
                left = np.arange(len(hashes))
                for k in range(PROBES):
                    at = probe(hashes[left], k, bits)
                    left = left[(shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0]
                can[row[left]] = True
            if can.any():
                yield batch.filter(pa.array(can))

    able = docs.where("text is not null").select(*text_keys("text"), "text").mapInArrow(rows, "_h1 long, _h2 long, text string")
    return staged(able.dropDuplicates(["_h1", "_h2"]), "candidates")


def group_hits(texts: DataFrame, group: list, window: int) -> DataFrame:
    """_h1, _h2, ranges (of words) and items of each of the (different) texts that windows of the group occur in, stored."""
    shared = texts.sparkSession.sparkContext.broadcast(Benchmark(group, window))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            told = [shared.value.scan(normal_words(text.as_buffer().to_pybytes())) for text in batch.column("text")]
            some = [k for k, (hit, _) in enumerate(told) if hit.any()]
            if some:
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(some)) for c in ("_h1", "_h2")] + [pa.array([word_ranges(told[k][0]) for k in some], pa.list_(RANGE)), pa.array([told[k][1] for k in some], pa.list_(pa.string()))], names=["_h1", "_h2", "ranges", "items"])

    stored = staged(texts.mapInArrow(rows, f"_h1 long, _h2 long, ranges {RANGES}, items array<string>"), "group-hits")
    shared.destroy()
    return stored


def text_keys(text: str, names: tuple[str, str] = ("_h1", "_h2")) -> list[Column]:
    return [F.xxhash64(F.col(text)).alias(names[0]), F.xxhash64(F.lit(1), F.col(text)).alias(names[1])]


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_column: str = "item_id", automaton_nodes: int = AUTOMATON_NODES) -> DataFrame:
    """All columns of docs and n_words, n_hit, items (sorted strings), spans (hit byte ranges of the original text).

    Columns of docs by these four names are replaced.
    """
    need(docs, "text")
    need(benchmark, id_column, "text")
    out = docs.drop("n_words", "n_hit", "items", "spans")
    plain, columns = numbered(out)
    at = columns.index("text")
    text = f"c{at}"
    groups = window_groups(benchmark, id_column, window, automaton_nodes)
    group, more = next(groups), next(groups, None)
    if more is None:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(group, window))
    else:
        texts = candidates(docs, benchmark, window)
        hits = group_hits(texts, group, window)
        while more is not None:
            hits = hits.unionByName(group_hits(texts, more, window))
            more = next(groups, None)
        hits = hits.groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        keyed = plain.select("*", *text_keys(text, ("_k1", "_k2")))
        plain = keyed.join(hits, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")) & F.col(text).isNotNull(), "left").drop("_k1", "_k2", "_h1", "_h2")

    def found(batch: pa.RecordBatch, k: int, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        if "ranges" not in batch.schema.names:
            return shared.value.scan(words)
        hit = np.zeros(len(words), bool)
        for r in batch.column("ranges")[k].as_py() or ():
            hit[r["start"] : r["end"]] = True
        return hit, batch.column("items")[k].as_py() or []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            n_words, n_hit, items, spans = [], [], [], []
            for k, value in enumerate(batch.column(at)):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                words = normal_words(data)
                hit, names = found(batch, k, words)
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                items.append(names)
                spans.append(hit_spans(data, hit))
            extra = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(RANGE))]
            names = [f"c{i}" for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(columns))] + extra, names=[*names, *ADDED])

    span = T.StructType().add("start", "long").add("end", "long")
    schema = T.StructType(list(out.schema.fields)).add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(span))
    return plain.mapInArrow(rows, numbered_schema(schema, *ADDED)).toDF(*columns, *ADDED)


def hit_spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Byte ranges of the original that runs of hit words cover."""
    if not hit.any():
        return []
    places = word_places(text)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": int(places[a, 0]), "end": int(places[b - 1, 1])} for a, b in edge.reshape(-1, 2)]


def contaminated(scanned: DataFrame, share: int = 20) -> DataFrame:
    """Adds `contaminated`: some word is hit, and at least one word in `share` is."""
    return scanned.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' own columns."""
    clash = {c: unused(docs, f"_own_{c}") for c in docs.columns if c in (*ADDED, "contaminated")}
    marked = contaminated(scan_documents(docs.toDF(*[clash.get(n, n) for n in docs.columns]), benchmark, window), share)
    return marked.where("not contaminated").select(*[c.alias(n) for c, n in zip(quoted(*[clash.get(n, n) for n in docs.columns]), docs.columns, strict=True)])

"""Spelling variants: words one edit apart, each led to the commonest of its neighbours, by tries and edit automata.

Words are counted in Spark, partial sums first. The words kept are sorted and cut into shards of consecutive words; a
shard is a compact trie (single endings are kept as strings) in a few flat arrays of bounded size, so that a fixed number
of shards is broadcast at a time, whatever the vocabulary's size. Every word's distance-one automaton (a place in the word
and whether the edit is spent) is run through every shard from its root, depth first: a shard whose words begin
otherwise is left at its first edges. A task emits for each word what its shards hold in sum (how many near words, the best
of them), never the pairs. Forms are followed by pointer doubling; each form is at least twice as frequent as the word
before, so the number of rounds is bounded by the logarithm of the logarithm of the largest count.

Null and empty texts have no words. A row counts as often as it is there; repeated rows of one doc_id draw the same
mistakes. A null doc_id draws as an empty one. Very long texts are read whole, a row at a time. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, slices, staged, texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct words that a task counts before it sends them on.
HELD = 200_000
#: Words of a shard, and shards that are broadcast together: some 5 MB as they are sent, 100 MB in a worker.
SHARD_WORDS, SHARDS_AT_ONCE = 32_768, 8


def mistaken(doc_id: str, run: str, every: int) -> str:
    """The run, one code point short if the checksum of `doc_id:run` is a multiple of `every`."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int = 97) -> DataFrame:
    """word, n: how often each word occurs over all documents, some of them misspelt by rule (none if every is 0)."""
    need(docs, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                runs: Counter[str] = Counter()
                for run, n in Counter(RUN.findall(text)).items():
                    runs[run.lower() if run.isascii() else run.translate(LOWER)] += n
                for run, n in runs.items():
                    held[mistaken(doc, run, every) if every else run] += n
                if len(held) > HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A compact trie of sorted words: nodes in breadth-first order, so that a node's children stand side by side.

    A node is its first child's number, the letters of its children, and its word's number (-1 if none). A subtree of one
    word is a single node whose `tail` holds the rest of it.
    """

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.first, self.letters, self.word, self.tail = [], [], [], []
        self.beyond: list[dict[str, list[int]] | None]
        spans = [(0, len(words), 0)]
        for low, high, depth in spans:  # grows as it is walked
            alone = high - low == 1
            self.tail.append(words[low][depth:] if alone else None)
            ends = high > low and len(words[low]) == depth
            self.word.append(low if alone or ends else -1)
            self.first.append(len(spans))
            letters = []
            if not alone:
                at = low + ends
                while at < high:
                    letter, stop = words[at][depth], at + 1
                    while stop < high and words[stop][depth] == letter:
                        stop += 1
                    letters.append(letter)
                    spans.append((at, stop, depth + 1))
                    at = stop
            self.letters.append("".join(letters))
        self.beyond = [None] * len(spans)

    def ways(self, node: int) -> dict[str, list[int]]:
        """The children that can go on with a letter, by that letter; those where a word ends by none. Kept once asked for."""
        out = self.beyond[node] = {}
        for child in range(self.first[node], self.first[node] + len(self.letters[node])):
            tail = self.tail[child]
            for letter in self.letters[child] if tail is None else [tail[:1]]:
                out.setdefault(letter, []).append(child)
            if tail is None and self.word[child] >= 0:
                out.setdefault("", []).append(child)
        return out

    def __reduce__(self):
        return Trie, (self.words, self.counts)

    def near(self, word: str) -> list[int]:
        """Numbers of the words that differ from `word` by exactly one code point inserted, deleted or replaced."""
        first, letters, ends, tails, beyond, size = self.first, self.letters, self.word, self.tail, self.beyond, len(word)
        found = set()
        stack = [(0, 0, False)]
        while stack:
            node, at, spent = stack.pop()
            tail = tails[node]
            if tail is not None:
                if word[at:] == tail if spent else one_edit(word[at:], tail):
                    found.add(ends[node])
                continue
            if ends[node] >= 0 and at == size - (not spent):
                found.add(ends[node])
            here, start = letters[node], first[node]
            if spent:
                if at < size and (k := here.find(word[at])) >= 0:
                    stack.append((start + k, at + 1, True))
                continue
            letter, after = word[at : at + 1], word[at + 1 : at + 2]
            onward = beyond[node] or self.ways(node)
            same = start + here.find(letter) if letter and letter in here else -1
            if same >= 0:
                stack.append((same, at + 1, False))
            if letter:
                stack += [(child, at + 1, True) for child in onward.get(after, ()) if child != same]  # replaced
            # one more here; the letter itself once more is found behind it
            stack += [(child, at, True) for child in onward.get(letter, ()) if child != same]
            if letter and (not after or after in here):
                stack.append((node, at + 1, True))  # one less here
        return list(found)


def one_edit(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == (b[k:] if len(a) > len(b) else b[k + 1 :])


def tries(words: DataFrame, shard_words: int) -> DataFrame:
    """number, trie: shards of at most shard_words consecutive words of `words` (word, n), their tries pickled.

    The words are range-partitioned, so consecutive words meet in a shard and no task holds more than one shard.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, number = [], [], TaskContext.get().partitionId() << 32

        def shard(part: list[str], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(Trie(part, n), protocol=5)], pa.binary())], names=["number", "trie"])

        for batch in batches:
            names += batch.column("word").to_pylist()
            counts += batch.column("n").to_pylist()
            while len(names) >= shard_words:
                yield shard(names[:shard_words], counts[:shard_words])
                del names[:shard_words], counts[:shard_words]
                number += 1
        if names:
            yield shard(names, counts)

    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = words.select("word", "n").repartitionByRange(partitions, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(build, "number long, trie binary")


#: The tries of the turn that a worker has opened last.
_open: dict[str, list[Trie]] = {}


def opened(turn: str, sent: Broadcast) -> list[Trie]:
    """A turn's tries, unpacked once for each worker; those of another turn go first."""
    if turn not in _open:
        _open.clear()
        _open[turn] = [pickle.loads(t) for t in sent.value]
    return _open[turn]


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, at_once: int = SHARDS_AT_ONCE) -> DataFrame:
    """word, n_near, best_n and best (the near word of largest n, then the smallest) of the words that have near words.

    Each turn broadcasts at most at_once shards, which hold at most shard_words words each, and streams all words past.
    """
    spark = words.sparkSession
    shards = staged(tries(words, shard_words), "tries")
    numbers = [r["number"] for r in shards.select("number").orderBy("number").toLocalIterator()]
    found = []
    for at in range(0, len(numbers), at_once):
        chosen = shards.where(F.col("number").isin(numbers[at : at + at_once])).select("trie")
        sent, turn = spark.sparkContext.broadcast([bytes(r["trie"]) for r in chosen.toLocalIterator()]), uuid.uuid4().hex

        def meet(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                loaded, out = opened(turn, sent), []
                for word in batch.column("word").to_pylist():
                    total, best = 0, None
                    for trie in loaded:
                        near = trie.near(word)
                        total += len(near)
                        for k in near:
                            rank = (-trie.counts[k], trie.words[k])
                            if best is None or rank < best:
                                best = rank
                    if best:
                        out.append((word, total, -best[0], best[1]))
                if out:
                    a, b, c, d = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["word", "n_near", "best_n", "best"])

        # one table a turn: the broadcast can go before the next is made
        found.append(staged(words.select("word").mapInArrow(meet, "word string, n_near long, best_n long, best string"), "near-words"))
        sent.destroy()
    every = found[0] if found else spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    for part in found[1:]:
        every = every.unionByName(part)
    leading = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("name")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), leading.alias("lead")).select("word", "n_near", (-F.col("lead.minus")).alias("best_n"), F.col("lead.name").alias("best"))


def spelling_forms(counts: DataFrame, least_n: int = 3, least_length: int = 5, ratio: int = 2, shard_words: int = SHARD_WORDS, at_once: int = SHARDS_AT_ONCE) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of counts (word, n) with enough occurrences and code points.

    A word's form is its near word of largest n (ties: the smallest) if that n is at least `ratio` times its own, else
    null; the root is what forms lead to in the end, the word itself where it has no form.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms can't lead in a circle")
    kept = counts.where((F.length("word") >= least_length) & (F.col("n") >= least_n)).select("word", "n")
    # the search is the work and the words are few bytes, so they are dealt out by hash
    words = staged(kept.repartition(4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"), "words")
    near = near_words(words, shard_words, at_once)
    good = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")
    )
    told = staged(joined, "forms")
    steps = staged(told.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("to"), F.lit(True).alias("moved")), "steps")
    while not steps.where("moved").isEmpty():
        further = steps.select(F.col("at").alias("_at"), F.col("to").alias("_to"))
        jumped = steps.join(further, F.col("to") == F.col("_at"), "left")
        steps = staged(jumped.select("at", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "steps")
    roots = steps.select(F.col("at").alias("_at"), F.col("to").alias("root"))
    return told.join(roots, F.col("word") == F.col("_at"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

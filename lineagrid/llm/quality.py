"""Text quality by regularised quadratic discriminant analysis over document statistics.

Statistics are computed from each whole text in numpy. Class means and covariances come from the sums and cross products
of all labelled training rows, added up by Spark; each class covariance is shrunk towards the pooled one and towards the
identity, and its Cholesky factor is computed once. A score is the logistic function of the difference of the classes'
log densities (squared Mahalanobis distances and log determinants) plus the log odds.

For the fit alone statistics are rounded to multiples of 2^-16, so that sums and products are whole numbers: they are
added up exactly, in any order, and a score does not depend on which task came first or on a rerun.

Null and empty texts have statistics like any other and get a score; a text of any length is one row and read whole.
Labels that are null count as no label; a doc_id with several labels trains with each. Rows with a null doc_id are scored
and never trained on. Repeated rows are scored each. With fewer than two classes in training the score is the share of
label 1 (0.5 without labels). Extra columns are ignored by scores and kept by the filter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL, need, numbered, numbered_schema, slices, staged, unused
from .wordbytes import IS_SPACE, LOWER, column_bytes, mixed, word_hashes, word_spans

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_bytes_sd", "upper", "digit", "symbol", "stop", "other_punctuation",
    "high_bytes", "space", "distinct_words", "repeated_next", "word_entropy", "letter_words", "capital_words", "symbol_words", "distinct_bigrams", "line_repeats",
)


def byte_classes() -> np.ndarray:
    """0 other, 1 upper, 2 digit, 3 symbol, 4 full stop or comma, 5 other punctuation, 6 high byte, 7 white space, 8 lower."""
    kind = np.zeros(256, np.uint8)
    for code, chars in ((1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, "#$%&*+<=>@\\^_`{|}~/"), (4, ".,"), (5, "!\"'():;?[]-"), (7, " \t\n\x0b\x0c\r"), (8, "abcdefghijklmnopqrstuvwxyz")):
        kind[[ord(c) for c in chars]] = code
    kind[128:] = 6
    return kind


KIND = byte_classes()


def separator(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


IS_BREAK = separator(0x0A)
#: Short texts say little: a share is blended with its usual value as if so many bytes or words more had been seen.
BLEND_BYTES, BLEND_WORDS = 100.0, 15.0
#: Usual shares of the byte classes (fixed values, in the order of byte_classes).
SHARES = (0.0, 0.02, 0.003, 0.002, 0.025, 0.003, 0.02, 0.16, 0.767)


def blend(total: np.ndarray, size: np.ndarray, usual: float, weight: float) -> np.ndarray:
    return (total + usual * weight) / (size + weight)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def distinct(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and the entropy of their frequencies in nats."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])]) if len(v) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[new, len(v)])
    of = r[new] if len(new) else np.zeros(0, np.int64)
    size = np.bincount(row, minlength=n).astype(np.float64)
    weighted = np.bincount(of, weights=counts * np.log(np.maximum(counts, 1)), minlength=n)
    return np.bincount(of, minlength=n).astype(np.float64), np.log(np.maximum(size, 1)) - weighted / np.maximum(size, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, FEATURES) transformed statistics of whole texts."""
    data, offsets = column_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kind = KIND[data]
    share = [blend(sums(kind == k, offsets), size, SHARES[k], BLEND_BYTES) for k in range(9)]
    starts, ends, first = word_spans(data, offsets, IS_SPACE)
    words = np.diff(first).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(first))
    per_word = lambda total, usual: blend(total, words, usual, BLEND_WORDS)
    length = (ends - starts).astype(np.float64)
    mean = per_word(sums(length, first), 6.0)
    sd = np.sqrt(np.maximum(per_word(sums(length**2, first), 45.0) - mean**2, 0))
    h = word_hashes(LOWER[data], starts, ends)
    uniq, entropy = distinct(h, row, n)
    same_row = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    next_same = np.concatenate([(h[1:] == h[:-1]) & same_row, [False]]) if len(h) else np.zeros(0, bool)
    pair = mixed(h[:-1] * np.uint64(31) + h[1:])[same_row] if len(h) > 1 else np.zeros(0, np.uint64)
    pairs, _ = distinct(pair, row[1:][same_row] if len(h) > 1 else np.zeros(0, np.int64), n)
    running = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letters, symbols, upper = (running(m) for m in (np.isin(kind, (1, 6, 8)), (kind == 3) | (kind == 5), kind == 1))
    letters, symbols, upper = (t[ends] - t[starts] for t in (letters, symbols, upper))
    lines = sums(data == 10, offsets) + 1
    line_start, line_end, line_first = word_spans(data, offsets, IS_BREAK)
    full_lines = np.diff(line_first).astype(np.float64)
    line_uniq, _ = distinct(word_hashes(LOWER[data], line_start, line_end), np.repeat(np.arange(n), np.diff(line_first)), n)
    root = np.sqrt
    return np.stack(
        [
            np.log(size + BLEND_BYTES), np.log(words + BLEND_WORDS), np.log(lines + 2), np.log(mean), np.log1p(sd), root(share[1]), root(share[2]), root(share[3]), root(share[4]), root(share[5]),
            root(share[6]), root(share[7]), per_word(uniq, 0.9), root(per_word(sums(next_same, first), 0.0)), per_word(entropy / np.log(words + 2) * words, 0.95), per_word(sums(letters >= length, first), 0.85),
            root(per_word(sums(upper >= np.maximum(letters, 1), first), 0.01)), root(per_word(sums(symbols >= 2, first), 0.01)), per_word(pairs, 0.98), root(blend(full_lines - line_uniq, full_lines, 0.0, 4.0)),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and constants; `centre` and `scale` standardise the statistics first."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray
    flat: float | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), np.log(self.flat / (1 - self.flat)))
        z = (x - self.centre) / self.scale
        log = []
        for mean, factor, constant in zip(self.means, self.inverse_factors, self.constants, strict=True):
            d = (z - mean) @ factor.T
            log.append(constant - 0.5 * (d * d).sum(axis=1))
        return log[1] - log[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


#: Statistics are whole multiples of 2^-GRAIN_BITS in the fit; they stay below 2^5.
GRAIN_BITS = 16
#: Rows whose products stay exact in one matrix product of doubles: 2 * (GRAIN_BITS + 5) bits each, 53 in all.
EXACT_ROWS = 1 << (53 - 2 * (GRAIN_BITS + 5))


def whole(x: np.ndarray) -> np.ndarray:
    """(rows, 1 + FEATURES) whole numbers in doubles: one, and the statistics in grains."""
    grains = np.clip(np.rint(x * (1 << GRAIN_BITS)), -(1 << (GRAIN_BITS + 5)) + 1, (1 << (GRAIN_BITS + 5)) - 1)
    return np.concatenate([np.ones((len(x), 1)), grains], axis=1)


def exact_products(x: np.ndarray) -> np.ndarray:
    """(1 + FEATURES, 1 + FEATURES) sums of products of whole(x), as Python integers."""
    z = whole(x)
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), EXACT_ROWS):
        part = z[at : at + EXACT_ROWS]
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def moments(sums: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and covariance from exact products: the subtraction is done in whole numbers, nothing cancels."""
    n, total, product = int(sums[0, 0]), sums[0, 1:], sums[1:, 1:]
    if not n:
        return 0, np.zeros(len(total)), np.zeros(product.shape)
    unit = float(1 << GRAIN_BITS)
    covariance = (n * product - np.outer(total, total)).astype(np.float64) / (float(n) * n * unit * unit)
    return n, total.astype(np.float64) / (n * unit), covariance


def fit(sums: dict[int, np.ndarray], to_pooled: float, to_identity: float) -> Discriminant:
    """From each class's exact_products. to_pooled and to_identity are the shrinkage intensities."""
    k = len(FEATURES)
    told = {c: moments(sums[c]) for c in (0, 1)}
    n = {c: t[0] for c, t in told.items()}
    if min(n.values()) < 2:
        share = (n[1] + 1) / (n[0] + n[1] + 2) if sum(n.values()) else 0.5
        return Discriminant(np.zeros(k), np.ones(k), np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2), share)
    _, centre, spread = moments(sums[0] + sums[1])
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-8))
    means = [(told[c][1] - centre) / scale for c in (0, 1)]
    covariances = [told[c][2] / np.outer(scale, scale) for c in (0, 1)]
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / (n[0] + n[1])
    factors, constants = [], []
    for c in (0, 1):
        shrunk = (1 - to_pooled) * covariances[c] + to_pooled * pooled
        shrunk = (1 - to_identity) * shrunk + to_identity * np.eye(k) * np.trace(shrunk) / k
        factor = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(factor))
        constants.append(np.log(n[c] / (n[0] + n[1])) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.stack(means), np.stack(factors), np.array(constants))


def featured(docs: DataFrame, name: str = "x") -> DataFrame:
    """docs' columns (text among them only if it is there) and `name`, the statistics of each row's text."""
    schema = T.StructType(list(docs.schema.fields)).add(name, T.ArrayType(T.DoubleType()))
    plain, original = numbered(docs)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", SMALL):
            x = statistics(batch.column(at))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "x"])

    return plain.mapInArrow(rows, numbered_schema(schema, "x")).toDF(*original, name)


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(FEATURES))


def train(features: DataFrame, labels: DataFrame, to_pooled: float, to_identity: float) -> Discriminant:
    """Fits on all rows of features with a label 0 or 1 in labels(doc_id, label)."""
    k = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros((k + 1, k + 1), object) for c in (0, 1)}
        for batch in batches:
            if batch.num_rows:
                x, y = vectors(batch.column("x")), batch.column("label").to_numpy()
                for c in (0, 1):
                    held[c] = held[c] + exact_products(x[y == c])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([[str(v) for v in m.reshape(-1)] for m in held.values()], pa.list_(pa.string()))], names=["label", "m"])

    labelled = features.select("doc_id", "x").join(labels.where("label in (0, 1)"), "doc_id").select(F.col("label").cast("int"), "x")
    parts = labelled.mapInArrow(partial, "label int, m array<string>")
    spread = parts.select("label", F.posexplode("m").alias("i", "v")).groupBy("label", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {c: np.zeros((k + 1) ** 2, object) for c in (0, 1)}
    for r in spread.collect():  # 2 (k + 1)^2 numbers, whatever the corpus
        found[r["label"]][r["i"]] = int(r["v"])
    return fit({c: v.reshape(k + 1, k + 1) for c, v in found.items()}, to_pooled, to_identity)


def quality_scores(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, to_pooled: float = 0.1, to_identity: float = 0.02) -> DataFrame:
    """doc_id and score of every row: the probability of label 1. labels: doc_id, label; train_on: which labels to learn."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "label")
    features = staged(featured(docs.select("doc_id", "text")).drop("text"), "features")
    model = train(features, (labels if train_on is None else labels.where(train_on)).select("doc_id", "label"), to_pooled, to_identity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(vectors(batch.column("x"))))], names=["doc_id", "score"])

    return features.mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, train_on: Column | None = None, to_pooled: float = 0.1, to_identity: float = 0.02) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`.

    Statistics are computed once and stored beside the rows until the model is known; texts are never shuffled.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "label")
    labelled = (labels if train_on is None else labels.where(train_on)).select("doc_id", "label")
    name = unused(docs, "x")
    stored = staged(featured(docs, name), "rows-with-features")
    model = train(stored.select("doc_id", F.col(name).alias("x")), labelled, to_pooled, to_identity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = batch.filter(pa.array(model.scores(vectors(batch.column(batch.num_columns - 1))) >= least))
                yield kept.select(kept.schema.names[:-1])

    return numbered(stored)[0].mapInArrow(rows, numbered_schema(docs.schema)).toDF(*docs.columns)

"""Embedding near-dedup: a hierarchical navigable small-world graph for each shard, every shard queried by every vector.

Vectors are compared inside a label only. Equal vectors of a label are one class, so a vector repeated over a third of
the table is one node. The classes of a label are dealt by hash into shards of about `shard_size`; each shard's graph is
built once and stored. Every two shards of a label meet once: the vectors of one query the graph of the other, by turns,
and what is found counts for both sides, as links have no direction. A graph goes to one task and the blocks that query it
stream past; a shard's vectors go to half of the label's shards, which is quadratic in a label's size over shard_size.

A beam search runs on while it finds vectors over the threshold, so dense groups are walked whole. Each meeting is audited
by brute force on `audit` of its queries, without the match of a vector with itself, and on as many of the graph's vectors
turned away until their cosine is the threshold's: the share of the links found, its mean over the queries that have
links, and its mean over the turned ones must each reach `recall`, else the beam is doubled (at the shard's size the
search is exhaustive). Cosines are taken in double precision. A meeting returns link counts and a spanning forest of its
links, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id, link with
nothing: n_links 0, component_id their own vec_id. vec_id is taken to be unique; a repeated row counts as another vector.
Vectors of different lengths do not link. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import need, staged


#: Products of one vector with some or with all others differ in their last bits; the audit looks past that.
ROUNDING = 1e-9


class SmallWorld:
    """A navigable small-world graph over unit vectors; similarity is the dot product."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, build_beam: int = 64, seed: int = 1):
        self.x, self.degree = vectors, degree
        dice = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - dice.random(len(vectors))) / np.log(degree)).astype(int), 12).tolist()
        self.links: list[dict[int, list[int]]] = [{} for _ in range(max(self.level, default=0) + 1)]
        self.entry, self.top = -1, -1
        for node in range(len(vectors)):
            self._insert(node, build_beam)
        for layer in self.links:
            for node, near in layer.items():
                if len(near) > self._most(layer is self.links[0]):
                    layer[node] = self._chosen(node, near, self._most(layer is self.links[0]))

    def _most(self, ground: bool) -> int:
        return self.degree * (2 if ground else 1)

    def _chosen(self, node: int, candidates: list[int], most: int) -> list[int]:
        """Near ones that are nearer to the node than to those already chosen; then the nearest of the rest."""
        ids = np.array(candidates)
        similar = self.x[ids] @ self.x[node]
        order = np.argsort(-similar, kind="stable")
        ids, similar = ids[order], similar[order]
        between = self.x[ids] @ self.x[ids].T
        worst = np.full(len(ids), -np.inf)
        kept, rest = [], []
        for k in range(len(ids)):
            if len(kept) < most and similar[k] > worst[k]:
                kept.append(k)
                np.maximum(worst, between[k], out=worst)
            else:
                rest.append(k)
        return ids[kept + rest[: most - len(kept)]].tolist()

    def _insert(self, node: int, beam: int) -> None:
        level = self.level[node]
        if self.entry >= 0:
            q, near = self.x[node], [self.entry]
            for layer in range(self.top, -1, -1):
                found = self.search_layer(q, near, beam if layer <= level else 1, layer)
                near = [n for _, n in found]
                if layer <= level:
                    most = self._most(layer == 0)
                    chosen = self._chosen(node, near, self.degree)
                    table = self.links[layer]
                    table[node] = chosen
                    for other in chosen:
                        back = table[other]
                        back.append(node)
                        if len(back) > 2 * most:
                            table[other] = self._chosen(other, back, most)
        for layer in range(level + 1):
            self.links[layer].setdefault(node, [])
        if level > self.top:
            self.entry, self.top = node, level

    def search_layer(self, q: np.ndarray, start: list[int], beam: int, layer: int, least: float = 2.0) -> list[tuple[float, int]]:
        """(similarity, node), the best first: a beam, and all nodes of at least `least` that are reached."""
        table, x = self.links[layer], self.x
        seen = set(start)
        todo = [(-float(s), n) for s, n in zip(x[start] @ q, start, strict=True)]
        heapq.heapify(todo)
        best = [(-s, n) for s, n in todo]
        heapq.heapify(best)
        over = [(s, n) for s, n in best if s >= least]
        while todo:
            s, node = heapq.heappop(todo)
            if -s < least and len(best) >= beam and -s < best[0][0]:
                break
            fresh = [n for n in table[node] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for s, n in zip((x[fresh] @ q).tolist(), fresh, strict=True):
                if s >= least:
                    over.append((s, n))
                if s >= least or len(best) < beam or s > best[0][0]:
                    heapq.heappush(todo, (-s, n))
                    heapq.heappush(best, (s, n))
                    if len(best) > beam:
                        heapq.heappop(best)
        return sorted(set(best) | set(over), reverse=True)

    def near(self, q: np.ndarray, beam: int, least: float, start: int | None = None) -> list[int]:
        """Nodes of at least `least` that the search finds."""
        if beam >= len(self.x):
            return np.flatnonzero(self.x @ q >= least).tolist()
        at = [self.entry]
        for layer in range(self.top, 0, -1):
            at = [self.search_layer(q, at, 1, layer)[0][1]]
        if start is not None and start not in at:
            at.append(start)
        return [n for s, n in self.search_layer(q, at, beam, 0, least) if s >= least]

    def dump(self) -> bytes:
        return pickle.dumps((self.links, self.entry, self.top, self.degree), protocol=5)

    @classmethod
    def load(cls, vectors: np.ndarray, data: bytes) -> SmallWorld:
        self = cls.__new__(cls)
        self.x = vectors
        self.links, self.entry, self.top, self.degree = pickle.loads(data)
        return self


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first so that squares stay finite."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def turned(vectors: np.ndarray, cosine: float, seed: int = 2) -> np.ndarray:
    """Unit vectors at the given cosine from unit vectors, each in a direction of its own."""
    away = np.random.default_rng(seed).normal(size=vectors.shape)
    away -= (away * vectors).sum(axis=1, keepdims=True) * vectors
    length = np.linalg.norm(away, axis=1, keepdims=True)
    return cosine * vectors + np.sqrt(max(0.0, 1 - cosine * cosine)) * away / np.where(length > 0, length, 1)


def audited_links(index: SmallWorld, queries: np.ndarray, own: bool, least: float, beam: int, audit: int, recall: float) -> tuple[list[list[int]], int]:
    """Linked nodes for each query, and the beam that passed the audit. own: the queries are the index's vectors."""
    spread = lambda n: np.unique(np.linspace(0, n - 1, min(audit, n)).astype(int))
    sample = spread(len(queries)).tolist()
    truth = {}
    for k in sample:
        similar = index.x @ queries[k]
        if own:
            similar[k] = -2.0
        truth[k] = np.flatnonzero(similar >= least + ROUNDING)
    total = sum(map(len, truth.values()))
    # links may be too rare for the sample to hold any, so vectors turned to the threshold must find what is near them too
    probes = turned(index.x[spread(len(index.x))], min(1.0, least + 1e-6))
    around = [np.flatnonzero(index.x @ q >= least + ROUNDING) for q in probes]
    while True:
        start = lambda k: k if own else None
        got = {k: index.near(queries[k], beam, least, start(k)) for k in sample}
        if beam >= len(index.x):
            break
        hits = {k: len(np.intersect1d(truth[k], got[k])) for k in sample if len(truth[k])}
        told = [len(np.intersect1d(t, index.near(q, beam, least))) / len(t) for q, t in zip(probes, around, strict=True) if len(t)]
        if sum(told) >= recall * len(told) and sum(hits.values()) >= recall * total and sum(h / len(truth[k]) for k, h in hits.items()) >= recall * len(hits):
            break
        beam *= 2
    return [got[k] if k in got else index.near(queries[k], beam, least, start(k)) for k in range(len(queries))], beam


def forest(ids: np.ndarray, q_ids: np.ndarray, found: list[list[int]]) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and what they found."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = v = root.get(up, up)
        return v

    out = []
    for me, nodes in zip(q_ids.tolist(), found, strict=True):
        for other in ids[nodes].tolist():
            if (a := find(me)) != (b := find(other)):
                root[a] = b
                out.append((me, other))
    return out


def near_vectors(embeddings: DataFrame, least: float = 0.93, shard_size: int = 4096, beam: int = 32, audit: int = 48, recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    need(embeddings, "vec_id", "embedding", "label")
    partitions = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))

    classes = staged(rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    group = ["label", "size"]
    classes_by = classes.withColumn("size", F.size("v"))
    shards = classes_by.groupBy(*group).agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    placed = classes_by.join(shards, group).withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("shards")).cast("int"))
    label_type = classes.schema["label"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def index() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            size = table.column("size")[0].as_py()
            vectors = unit(table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size))
            graph = SmallWorld(vectors)
            keys = [table.column(c).slice(0, 1).combine_chunks() for c in ("label", "size", "shard", "shards")]
            blobs = [pa.array([b], pa.binary()) for b in (table.column("rep").to_numpy().tobytes(), table.column("n").to_numpy().tobytes(), vectors.tobytes(), graph.dump())]
            return pa.RecordBatch.from_arrays([k.chunk(0) if isinstance(k, pa.ChunkedArray) else k for k in keys] + blobs, names=["label", "size", "shard", "shards", "ids", "counts", "vectors", "graph"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "size", "shard")), strict=True))
            first = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[first]:
                    if held and (held[0].column("label")[0].as_py(), held[0].column("size")[0].as_py(), held[0].column("shard")[0].as_py()) != keys[first]:
                        yield index()
                        held = []
                    held.append(batch.slice(first, k - first))
                    first = k
        if held:
            yield index()

    spread = placed.select(*group, "shard", "shards", "rep", "n", "v").repartition(partitions, *group, "shard").sortWithinPartitions(*group, "shard", "rep")
    indexes = staged(spread.mapInArrow(build, f"label {label_type}, size int, shard int, shards int, ids binary, counts binary, vectors binary, graph binary"), "small-worlds")
    # of two shards the one whose turn it is holds the graph, and the other's vectors go to it; each has half of the turns
    low, high = F.least("shard", "_other"), F.greatest("shard", "_other")
    keeper = F.when((low + high) % 2 == 0, low).otherwise(high)
    meetings = indexes.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where((F.col("_other") != F.col("shard")) & (keeper == F.col("_other")))
    queries = meetings.select(*group, F.col("_other").alias("shard"), F.col("shard").alias("block"), "ids", "counts", "vectors", F.lit(None).cast("binary").alias("graph"))
    graphs = indexes.select(*group, "shard", F.lit(-1).alias("block"), "ids", "counts", "vectors", "graph")
    units = graphs.unionByName(queries).repartition(partitions, *group, "shard").sortWithinPartitions(*group, "shard", "block").select("size", "ids", "counts", "vectors", "graph")

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, counts = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                own = row["graph"] is not None
                q_ids, q_counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64)
                q = np.frombuffer(row["vectors"]).reshape(-1, row["size"])
                if own:
                    index, ids, counts = SmallWorld.load(q, row["graph"]), q_ids, q_counts
                found, _ = audited_links(index, q, own, least, beam, audit, recall)
                if own:  # found from one side is a link of both
                    near = np.zeros((len(ids), len(ids)), bool)
                    for j, nodes in enumerate(found):
                        near[j, nodes] = near[nodes, j] = True
                    np.fill_diagonal(near, False)
                    links = near @ counts
                    told = [(ids, links)]
                else:
                    theirs, mine = np.zeros(len(q_ids), np.int64), np.zeros(len(ids), np.int64)
                    for j, nodes in enumerate(found):
                        theirs[j] = counts[nodes].sum()
                        mine[nodes] += q_counts[j]
                    told = [(q_ids, theirs), (ids, mine)]
                for who, links in told:
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([None] * len(who), pa.int64()), pa.array(links)], names=["src", "dst", "links"])
                if edges := forest(ids, q_ids, found):
                    src, dst = zip(*edges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(np.zeros(len(src), np.int64))], names=["src", "dst", "links"])

    found = staged(units.mapInArrow(query, "src long, dst long, links long"), "vector-links")
    counts = found.where("dst is null").groupBy("src").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("dst is not null").select("src", "dst"))
    told = classes.join(counts, F.col("rep") == F.col("src"), "left").join(components, F.col("rep") == F.col("node"), "left")
    told = told.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(told, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

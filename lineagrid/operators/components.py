"""Connected components of an edge table, by contraction with random priorities.

Each round every node moves to the neighbour (or itself) with the smallest hash of (node, round); edges follow, loops and
repeats go. A constant share of the nodes vanishes in each expected round, whatever the graph's shape, so chains and
stars alike end after a logarithmic number of rounds. Once at most `finish` contracted edges are left, whatever the
graph's size was, one task joins them up. Nothing but the edges' count reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import staged

#: Edges that one task may join up at the end: some megabytes.
FINISH = 50_000


def joined_up(edges: DataFrame) -> DataFrame:
    """_at, _to: every node of a small edge table and one node for its component, in one task."""
    kind = edges.schema["src"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        arrow = None
        for batch in batches:
            arrow = batch.schema.field("src").type
            for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
                if (x := find(a)) != (y := find(b)):
                    root[x] = y
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([find(n) for n in nodes], arrow)], names=["_at", "_to"])

    return edges.coalesce(1).mapInArrow(rows, f"_at {kind.simpleString()}, _to {kind.simpleString()}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", finish: int = FINISH) -> DataFrame:
    """node, component (its smallest node reachable) for each node of an edge between different nodes.

    Loops and edges with a null end are ignored, repeats and direction do not matter; no edges give no rows.
    """
    ends = edges.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), (F.col(src).isNull() | F.col(dst).isNull()).alias("_null"))
    edges = staged(ends.where("not _null and src <> dst").select("src", "dst").distinct(), "edges")
    labels = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node"))
    for turn in range(10_000):
        left = edges.count()
        if not left:
            break
        if left <= finish:
            moves = staged(joined_up(edges), "moves")
        else:
            ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("v"))  # noqa: B023, E731
            both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            moves = staged(both.groupBy("src").agg(F.min(ranked("dst")).alias("best")).select(F.col("src").alias("_at"), F.least("best", ranked("src"))["v"].alias("_to")), "moves")
        labels = staged(labels.join(moves, F.col("label") == F.col("_at"), "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
        if left <= finish:
            break
        moved = edges.join(moves.toDF("src", "s"), "src").join(moves.toDF("dst", "d"), "dst")
        edges = staged(moved.where("s <> d").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).distinct(), "edges")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")


def followed(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, root: where the links of a forest (one parent a node) lead in the end, by doubling what each link spans."""
    steps = staged(links.select(F.col(node).alias("at"), F.col(parent).alias("to"), F.lit(True).alias("moved")), "steps")
    while not steps.where("moved").isEmpty():
        further = steps.select(F.col("at").alias("_at"), F.col("to").alias("_to"))
        jumped = steps.join(further, F.col("to") == F.col("_at"), "left")
        steps = staged(jumped.select("at", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "steps")
    return steps.select(F.col("at").alias("node"), F.col("to").alias("root"))

"""A growing table of lineages, kept by V family and group: a micro-batch reads and writes the parts it touches alone.

The table lies in parts, store/data/part_batch=<n>/part_family=<f>/part_bucket=<b>; all rows of a group are in one part. A
manifest for each batch says which batch's files hold each part. A batch reads the parts of its own groups by the manifest
before it, adds its rows to the groups it has rows of (comparing them with those and with each other, not those among
themselves), copies the other groups of those parts, and writes its own files and manifest. Nothing is changed in place, so a batch that is replayed after a failure gives the same again, and readers of
an older manifest are undisturbed; `forget` removes what no manifest that is kept refers to.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.prepare import Keys, group_key, quoted, resolve_keys
from ..options import LineageOptions
from ..plans.lineages import assign_lineages, grown_lineages
from ..storage import dropped, staged

PARTS = ("part_family", "part_bucket")


class Store:
    """The files and manifests under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches that have a manifest."""
        folder = self.hadoop.Path(f"{self.path}/manifest")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, below: int | None = None) -> dict[str, int]:
        """Each part's folder and the batch that wrote it last, by the newest manifest (before `below`)."""
        numbers = [n for n in self.batches() if below is None or n < below]
        if not numbers:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{numbers[-1]}.json", wholetext=True).first()[0])

    def write_manifest(self, number: int, parts: dict[str, int]) -> None:
        """In one step: a file is there whole or not at all."""
        draft, final = (self.hadoop.Path(f"{self.path}/manifest/{n}") for n in (f"{number}.draft", f"{number}.json"))
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        self.fs.delete(final, False)
        self.fs.rename(draft, final)

    def read(self, parts: dict[str, int]) -> DataFrame | None:
        """The rows of some parts; no more of the table is listed or read."""
        paths = [f"{self.path}/data/part_batch={n}/{part}" for part, n in sorted(parts.items())]
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "true").parquet(*paths).drop("part_batch", *PARTS)

    def forget(self, keep: int = 2) -> None:
        """Removes manifests but the newest `keep`, and the parts that those do not refer to."""
        numbers = self.batches()
        kept = {(n, p) for k in numbers[-keep:] for p, n in self.manifest(k + 1).items()}
        for number in numbers[:-keep]:
            self.fs.delete(self.hadoop.Path(f"{self.path}/manifest/{number}.json"), False)
        for number in numbers:
            batch = self.hadoop.Path(f"{self.path}/data/part_batch={number}")
            families = [s.getPath() for s in self.fs.listStatus(batch) if s.isDirectory()] if self.fs.exists(batch) else []
            for part in [s.getPath() for f in families for s in self.fs.listStatus(f) if s.isDirectory()]:
                if (number, f"{part.getParent().getName()}/{part.getName()}") not in kept:
                    self.fs.delete(part, True)


def placed(df: DataFrame, keys: Keys, options: LineageOptions, buckets: int) -> DataFrame:
    """df with the part of each row: its V gene's family and its group's bucket."""
    family = F.regexp_replace(F.regexp_extract(F.coalesce(quoted(keys.v).cast("string"), F.lit("")), "^[^-*]*", 0), "[^A-Za-z0-9]", "-")
    # rows of a group may differ in V gene where V is no key, so the family counts only where it is
    family = F.when(F.lit(options.group_by_v) & (family != ""), family).otherwise("none")
    return df.withColumns({"part_family": family, "part_bucket": F.pmod(F.xxhash64(group_key(keys, options)), F.lit(buckets)).cast("int")})


def assign_batch(batch: DataFrame, store: str, number: int, options: LineageOptions, buckets: int = 64) -> None:
    """Adds a batch's rows to the store under its number and renews the lineages of the groups it touches."""
    spark = batch.sparkSession
    if taken := {*PARTS, "part_batch"} & {c.lower() for c in batch.columns}:
        raise ValueError(f"the store needs these column names for itself: {', '.join(sorted(taken))}")
    kept = Store(spark, store)
    before = kept.manifest(number)
    new = staged(batch.drop(options.lineage_field, options.lineage_size_field), "arrivals")
    keys = resolve_keys(new, options)
    touched = [f"part_family={r[0]}/part_bucket={r[1]}" for r in placed(new, keys, options, buckets).select(*PARTS).distinct().toLocalIterator()]
    old = kept.read({p: before[p] for p in touched if p in before})
    rest = None
    assigned = None
    if old is not None:
        key: Column = group_key(keys, options)
        groups = new.select(key.alias("__grp")).distinct()
        marked = old.withColumn("__grp", group_key(resolve_keys(old, options), options))
        assigned = grown_lineages(marked.join(groups, "__grp", "left_semi").drop("__grp"), new, options)
        rest = marked.join(groups, "__grp", "left_anti").drop("__grp")
    assigned = assign_lineages(new, options) if assigned is None else assigned
    assigned = assigned.withColumn(options.lineage_size_field, F.col(options.lineage_size_field).cast("long"))
    if rest is not None:
        assigned = assigned.unionByName(rest, allowMissingColumns=True)
    rows = placed(assigned, resolve_keys(assigned, options), options, buckets)
    if touched:
        rows.repartition(*PARTS).write.mode("overwrite").partitionBy(*PARTS).parquet(f"{kept.path}/data/part_batch={number}")
    kept.write_manifest(number, before | dict.fromkeys(touched, number))
    dropped(new)


def assign_into_store(stream: DataFrame, store: str, options: LineageOptions | None = None, buckets: int = 64, **given) -> DataStreamWriter:
    """A writer that keeps a table of assigned rows by parts; start it with a checkpointLocation. Always use the same buckets."""
    o = LineageOptions.of(options, **given)
    return stream.writeStream.foreachBatch(lambda batch, number: assign_batch(batch, store, number, o, buckets))


def read_store(spark: SparkSession, store: str) -> DataFrame | None:
    """The table as of the newest batch; None before the first row."""
    kept = Store(spark, store)
    return kept.read(kept.manifest())

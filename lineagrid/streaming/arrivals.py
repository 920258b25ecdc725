"""Lineages of a growing table: each micro-batch of new sequences is added to a stored table and assigned anew.

A lineage can merge two older ones when a sequence between them arrives, so a batch re-assigns the groups it touches and
no others: a group's rows depend on nothing outside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.prepare import group_key, resolve_keys
from ..options import LineageOptions
from ..plans.lineages import assign_lineages


def assign_arrivals(stream: DataFrame, store: str, options: LineageOptions | None = None, **given) -> DataStreamWriter:
    """A writer that keeps a Parquet table of assigned rows under store/v<batch>; start it with a checkpointLocation.

    A batch that is replayed after a failure reads the version before it and writes its own again.
    """
    o = LineageOptions.of(options, **given)

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest_version(batch, store, number)
        new = batch.drop(o.lineage_field, o.lineage_size_field)
        if before is None:
            assigned = assign_lineages(new, o)
        else:
            old = spark.read.parquet(before)
            key = group_key(resolve_keys(new, o), o)
            touched = new.select(key.alias("__grp")).distinct()
            marked = old.withColumn("__grp", key)
            again = marked.join(touched, "__grp", "left_semi").drop("__grp", o.lineage_field, o.lineage_size_field)
            rest = marked.join(touched, "__grp", "left_anti").drop("__grp")
            assigned = assign_lineages(again.unionByName(new, allowMissingColumns=True), o).unionByName(rest, allowMissingColumns=True)
        assigned.withColumn(o.lineage_size_field, F.col(o.lineage_size_field).cast("long")).write.mode("overwrite").parquet(f"{store}/v{number}")

    return stream.writeStream.foreachBatch(one_batch)


def latest_version(df: DataFrame, store: str, below: int) -> str | None:
    """The newest complete version before `below`."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName()[:1] == "v" and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = [n for p in done if (n := int(p.getName()[1:])) < below]
    return f"{store}/v{max(numbers)}" if numbers else None

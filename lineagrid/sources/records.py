"""Pretty-printed JSON arrays read in parallel and in order, and text files written in a given order.

An array of records over many lines is split like any text file. How deep each line stands in braces follows from the
sums of the blocks before it, a row for each block, and a running sum inside the block; so the records are found and
numbered without one task reading a file, and the lines of one record alone are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import staged

#: Fixed value: letters of a junction that count.
JUNCTION_LETTERS = 64
SCHEMA = "struct<v_gene: struct<`all`: string, gene: string, fam: string>, j_gene: struct<`all`: string, gene: string>, junc_aa: string, {}>"


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0, in the file's order) and json of each record of files that hold an array of objects over lines.

    Records begin on lines of their own. Empty files and empty arrays have no records.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    bare = F.regexp_replace("value", r'"(\\.|[^"\\])*"', "")
    many = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c)))
    lines = staged(lines.withColumn("step", many("{") - many("}")).withColumn("opens", many("{") > 0), "lines")

    def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """rows with the sum of value over all lines before, in its file."""
        sums = rows.groupBy("file", "block").agg(F.sum(value).alias("_sum"))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
        inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        told = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        return told.join(base, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).withColumn(name, F.col("_base") + F.col("_in")).drop("_file", "_block", "_base", "_in")

    deep = running(lines, F.col("step"), "depth").withColumn("first", ((F.col("depth") == 0) & F.col("opens")).cast("int"))
    deep = staged(deep.where((F.col("depth") > 0) | (F.col("first") == 1)), "deep-lines")
    placed = running(deep, F.col("first"), "number").withColumn("number", F.col("number") + F.col("first") - 1)
    whole = placed.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("_l"))
    return whole.select("file", "number", F.regexp_replace(F.array_join(F.col("_l.value"), "\n"), r",\s*$", "").alias("json"))


def read_annotated_json(spark: SparkSession, path: str, mutations: str = "var_muts_nt.muts") -> DataFrame:
    """file, number, sequence_id, v_family, v_gene, j_gene, cdr3 and v_mutations of annotated sequences as JSON records.

    Genes are written gene*allele. A junction counts 64 letters. mutations is where a record's list of {loc, mut} stands.
    A record that can't be read has nulls.
    """
    outer, _, inner = mutations.rpartition(".")
    shape = f"`{inner}`: array<struct<loc: string, mut: string>>"
    for name in reversed(outer.split(".") if outer else []):
        shape = f"`{name}`: struct<{shape}>"
    records = json_records(spark, path).withColumn("r", F.from_json("json", SCHEMA.format(shape)))
    allele = lambda c: F.concat_ws("*", F.col(f"r.{c}.gene"), F.col(f"r.{c}.all"))
    listed = F.coalesce(F.transform(F.col(f"r.{mutations}"), lambda m: F.concat(m["loc"], m["mut"])), F.array().cast("array<string>"))
    return records.select(
        "file",
        "number",
        F.concat_ws("@", F.col("number").cast("string"), "file").alias("sequence_id"),
        F.col("r.v_gene.fam").alias("v_family"),
        allele("v_gene").alias("v_gene"),
        allele("j_gene").alias("j_gene"),
        F.substring(F.col("r.junc_aa"), 1, JUNCTION_LETTERS).alias("cdr3"),
        F.array_join(listed, "|").alias("v_mutations"),
    )


def write_in_order(df: DataFrame, column: str, order: list[str], path: str, partitions: int | None = None) -> None:
    """One line for each row, `column` as text (null: empty), in the order of `order` through the files by their names.

    Rows are range-partitioned, so each task sorts its own range only.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)

"""From an annotated table to the rows that are compared: keys resolved, mutations split, groups, allelic variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import LineageOptions


@dataclass(frozen=True)
class Keys:
    """The columns that hold each part of a sequence; locus and light chain may be absent."""

    id: str
    v: str
    j: str
    cdr3: str
    mutations: str
    locus: str | None
    light_v: str | None
    light_j: str | None


def quoted(name: str) -> Column:
    """A column whose name may hold dots, colons or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_keys(df: DataFrame, options: LineageOptions) -> Keys:
    """Given names first, else the first present of X:0 and X. Missing columns raise ValueError before any job."""

    def found(given: str | None, *names: str) -> str | None:
        if given is not None:
            return given
        return next((n for n in names if n in df.columns), None)

    o = options
    keys = {
        "id": found(o.id_key, "sequence_id:0", "sequence_id") or "sequence_id",
        "v": found(o.vgene_key, "v_gene:0", "v_gene") or "v_gene",
        "j": found(o.jgene_key, "j_gene:0", "j_gene") or "j_gene",
        "cdr3": found(o.cdr3_key, "cdr3:0", "cdr3") or "cdr3",
        "mutations": found(o.mutations_key, "v_mutations:0", "v_mutations") or "v_mutations",
    }
    if missing := [k for k in keys.values() if k not in df.columns]:
        raise ValueError(f"Missing column: {', '.join(missing)}")
    optional = {"locus": found(o.locus_key, "locus:0", "locus"), "light_v": found(o.light_vgene_key, "v_gene:1"), "light_j": found(o.light_jgene_key, "j_gene:1")}
    return Keys(**keys, **{k: n if n in df.columns else None for k, n in optional.items()})


def mutation_list(column: Column, kind: T.DataType, delimiter: str) -> Column:
    """Mutations as an array of non-empty strings; null and "" are empty, an array column is taken as it is."""
    if isinstance(kind, T.ArrayType):
        parts = F.coalesce(column.cast("array<string>"), F.array().cast("array<string>"))
    else:
        parts = F.split(F.coalesce(column.cast("string"), F.lit("")), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    return F.filter(parts, lambda m: m.isNotNull() & (m != ""))


def group_key(keys: Keys, options: LineageOptions) -> Column:
    """The grouping genes as an array, in which nulls equal each other; no grouping is an empty array."""
    names = [keys.v] * options.group_by_v + [keys.j] * options.group_by_j
    if options.group_by_light_chain_vj and keys.light_v and keys.light_j:
        names += [keys.light_v, keys.light_j]
    return F.array(*[quoted(n).cast("string") for n in names]) if names else F.array().cast("array<string>")


def compared_rows(df: DataFrame, keys: Keys, options: LineageOptions, *more: Column) -> DataFrame:
    """id, grp, v, j, cdr3, muts, igh (identity, where preclustering asks for it, and `more`): the only columns that later steps read."""
    if options.precluster and options.preclustering_key is not None and options.preclustering_key not in df.columns:
        raise ValueError(f"Missing column: {options.preclustering_key}")
    identity = [quoted(options.preclustering_key or keys.cdr3).cast("string").alias("identity")] * options.precluster
    igh = F.coalesce(quoted(keys.locus) == "IGH", F.lit(False)) if keys.locus else F.lit(True)
    return df.select(
        quoted(keys.id).cast("string").alias("id"),
        group_key(keys, options).alias("grp"),
        quoted(keys.v).cast("string").alias("v"),
        quoted(keys.j).cast("string").alias("j"),
        quoted(keys.cdr3).cast("string").alias("cdr3"),
        mutation_list(quoted(keys.mutations), df.schema[keys.mutations].dataType, options.mutation_delimiter).alias("muts"),
        igh.alias("igh"),
        *identity,
        *more,
    )


def allelic_variants(rows: DataFrame, threshold: float = 0.35, min_seqs: int = 200) -> DataFrame:
    """v, mutation, n, total: mutations that occur in rows * threshold occurrences or more of a V gene with min_seqs rows.

    Occurrences count repeats inside a row; rows without V gene are not looked at.
    """
    totals = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("total")).where(F.col("total") >= min_seqs)
    counts = rows.where("v is not null").select("v", F.explode("muts").alias("mutation")).groupBy("v", "mutation").agg(F.count("*").alias("n"))
    return counts.join(totals, "v").where(F.col("n") >= F.col("total") * F.lit(float(threshold))).select("v", "mutation", "n", "total")


def masked_rows(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """rows with distinct mutations, less the allelic variants of their own V gene.

    The variants are at most 1 / threshold times a row's mutations for each V gene, so the join's small side stays small;
    Spark broadcasts it by its measured size or else shuffles.
    """
    lists = variants.groupBy(F.col("v").alias("_v")).agg(F.collect_set("mutation").alias("_allelic"))
    joined = rows.join(lists, F.col("v") == F.col("_v"), "left")
    return joined.withColumn("muts", F.array_except("muts", F.coalesce("_allelic", F.array().cast("array<string>")))).drop("_v", "_allelic")


def prepared_rows(df: DataFrame, options: LineageOptions, *more: Column) -> tuple[DataFrame, Keys]:
    """The rows that are compared, with the columns `more` of df, and the keys."""
    keys = resolve_keys(df, options)
    rows = compared_rows(df, keys, options, *more)
    if options.ignore_likely_allelic_variants:
        seen = rows.where("igh") if keys.locus else rows
        rows = masked_rows(rows, allelic_variants(seen, options.allelic_variant_threshold, options.min_seqs_for_allelic_variants))
    else:
        rows = rows.withColumn("muts", F.array_distinct("muts"))
    return (rows.where("igh") if options.restrict_to_igh and keys.locus else rows), keys

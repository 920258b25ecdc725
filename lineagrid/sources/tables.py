"""Tables in and out: csv, tsv, parquet, ndjson and json by extension or by name."""

from __future__ import annotations

import csv
import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

#: Extensions and the format they stand for.
EXTENSIONS = {".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".parquet": "parquet", ".pq": "parquet", ".jsonl": "ndjson", ".ndjson": "ndjson", ".json": "json"}
#: "airr" is a tab-separated table of the AIRR community.
ALIASES = {"airr": "tsv", "tab": "tsv", "jsonl": "ndjson", "pq": "parquet"}


def format_of(path: str) -> str:
    """The format that a path's extension stands for, upper or lower case."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    extension = name[name.rfind(".") :] if "." in name else ""
    if extension not in EXTENSIONS:
        raise ValueError(f"no table format is known for the extension {extension or '(none)'} of {path}; name one with input_format")
    return EXTENSIONS[extension]


def read_table(spark: SparkSession, path: str, input_format: str | None = None, has_header: bool = True, delimiter: str | None = None) -> DataFrame:
    """Columns of delimited text are strings (gene names and ids are never numbers); without header column_1, column_2 ..."""
    kind = (input_format or format_of(path)).lower()
    kind = ALIASES.get(kind, kind)
    if kind in ("csv", "tsv"):
        read = spark.read.option("header", has_header).option("sep", delimiter or {"csv": ",", "tsv": "\t"}[kind]).option("quote", '"').option("escape", '"')
        df = read.csv(path)
        return df if has_header else df.toDF(*[f"column_{i + 1}" for i in range(len(df.columns))])
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "ndjson":
        return spark.read.json(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind in ("fasta", "fastq"):
        raise ValueError(f"{kind} needs germline annotation first; annotate the sequences and read the annotated table")
    raise ValueError(f"Unsupported table format to read: {kind}")


def write_table(df: DataFrame, path: str, output_format: str | None = None, single_file: bool = False, mode: str = "overwrite") -> None:
    """Writes a directory of part files, or with single_file one file of that name (for results that one task can write)."""
    kind = (output_format or format_of(path)).lower()
    kind = ALIASES.get(kind, kind)
    if kind not in ("csv", "tsv", "parquet", "ndjson", "json"):
        raise ValueError(f"Unsupported table format to write: {kind} ({path})")
    target = path + ".parts" if single_file else path
    writer = (df.coalesce(1) if single_file else df).write.mode(mode)
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if kind == "csv" else "\t").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(target)
    elif kind == "parquet":
        writer.parquet(target)
    else:
        writer.option("ignoreNullFields", False).json(target)
    if single_file:
        _to_one_file(df.sparkSession, target, path, as_array=kind == "json")


def _to_one_file(spark: SparkSession, parts: str, path: str, as_array: bool) -> None:
    """Moves the only part file to `path` by the file system's own rename; a json array is streamed around its lines."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    found = [s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")]
    if fs.exists(target):
        fs.delete(target, True)
    if as_array:
        out = fs.create(target, True)
        reader = spark.read.text(parts).toLocalIterator()
        out.write(bytearray(b"["))
        for k, row in enumerate(reader):
            out.write(bytearray((",\n" if k else "").encode() + row[0].encode()))
        out.write(bytearray(b"]\n"))
        out.close()
    elif found:
        fs.rename(found[0], target)
    fs.delete(source, True)


def print_csv(df: DataFrame, out: TextIO | None = None) -> None:
    """The rows as CSV with header, one partition at a time on the driver."""
    writer = csv.writer(out or sys.stdout, lineterminator="\n")
    writer.writerow(df.columns)
    for row in df.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])


def write_assignments_json(assignments: DataFrame, path: str) -> None:
    """{sequence_id: lineage} as one JSON object, streamed from the driver a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for k, (name, lineage) in enumerate(assignments.toLocalIterator()):
            f.write((", " if k else "") + json.dumps(name, ensure_ascii=False) + ": " + json.dumps(lineage, ensure_ascii=False))
        f.write("}")

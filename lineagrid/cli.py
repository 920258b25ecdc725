"""Command line: python -m lineagrid --input table.tsv --output lineages.parquet"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import __version__
from .options import LineageOptions
from .plans.lineages import assign
from .session import ship_package
from .sources.tables import print_csv, write_assignments_json, write_table


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lineagrid", description="Assigns antibody sequences to clonal lineages.")
    flag = argparse.BooleanOptionalAction
    p.add_argument("--version", action="version", version=f"lineagrid {__version__}")
    p.add_argument("--input", required=True, help="table of annotated sequences")
    p.add_argument("--input-format", choices=["csv", "tsv", "airr", "parquet", "ndjson", "json"], help="taken from the extension by default")
    p.add_argument("--header", action=flag, default=True, help="whether delimited text has a header")
    p.add_argument("--delimiter", help="of delimited text")
    p.add_argument("--output", help="where the assigned table goes; CSV to standard output by default")
    p.add_argument("--single-file", action="store_true", help="one output file instead of a directory of parts")
    p.add_argument("--assignments-json", help="also write {sequence_id: lineage}")
    p.add_argument("--distance-cutoff", type=float, default=0.35)
    p.add_argument("--shared-mutation-bonus", type=float, default=0.4)
    p.add_argument("--length-penalty-multiplier", type=float, default=2.0)
    for name in ("v", "j", "light-chain-vj"):
        p.add_argument(f"--group-by-{name}", action=flag, default=True)
    for name in ("id", "vgene", "jgene", "cdr3", "mutations", "locus", "light-vgene", "light-jgene"):
        p.add_argument(f"--{name}-key", help="column name; found by default")
    p.add_argument("--mutation-delimiter", default="|")
    p.add_argument("--ignore-likely-allelic-variants", action=flag, default=False)
    p.add_argument("--allelic-variant-threshold", type=float, default=0.35)
    p.add_argument("--min-seqs-for-allelic-variants", type=int, default=200)
    p.add_argument("--restrict-to-igh", action=flag, default=False)
    p.add_argument("--precluster", action=flag, default=False, help="group sequences by identity before distances")
    p.add_argument("--preclustering-threshold", type=float, default=0.65)
    p.add_argument("--preclustering-key", help="column that preclustering compares; the CDR3 by default")
    p.add_argument("--mnemonic-names", action=flag, default=True)
    p.add_argument("--name-seed", type=int)
    p.add_argument("--word-list", help="file of words for mnemonic names")
    p.add_argument("--progressive", action=flag, default=True, help="single linkage of equal lengths, else average linkage")
    p.add_argument("--verbose", action=flag, default=False)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 on success, else 1 with the reason on standard error."""
    a = vars(parser().parse_args(argv))
    own = {k: a[k] for k in ("input", "input_format", "header", "delimiter", "output", "single_file", "assignments_json", "progressive", "verbose")}
    options = {k: v for k, v in a.items() if k not in own}
    try:
        LineageOptions.of(None, **options)
        spark = spark or SparkSession.builder.appName("lineagrid").getOrCreate()
        ship_package(spark)
        told, assigned = assign(own["input"], spark, input_format=own["input_format"], has_header=own["header"], delimiter=own["delimiter"], progressive=own["progressive"], verbose=own["verbose"], **options)
        if own["output"]:
            write_table(assigned, own["output"], single_file=own["single_file"])
        else:
            print_csv(assigned)
        if own["assignments_json"]:
            write_assignments_json(told, own["assignments_json"])
    except Exception as e:  # whatever went wrong is the user's message
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0

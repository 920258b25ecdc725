"""Annotated JSON records read in parallel and in order, and cluster numbers written in that order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lineagrid.operators.essences import cluster_numbers
from lineagrid.sources.records import json_records, read_annotated_json, write_in_order


def record(dice):
    muts = [{"loc": str(dice.randint(1, 300)), "mut": dice.choice(("A>C", "T>G"))} for _ in range(dice.randint(0, 3))]
    return {"v_gene": {"all": "01", "gene": f"IGHV{dice.randint(1, 3)}-2", "fam": "3"}, "j_gene": {"all": "02", "gene": "IGHJ4"}, "junc_aa": "CAR" + "{}\"\\"[: dice.randint(0, 4)] + "A" * dice.randint(1, 90), "var_muts_nt": {"muts": muts}}


@pytest.mark.parametrize("split", ["100k", "1k"])
def test_records_in_order(spark, tmp_path, split):
    dice = random.Random(2)
    files = {name: [record(dice) for _ in range(n)] for name, n in (("a.json", 60), ("b.json", 1), ("c.json", 0))}
    for name, records in files.items():
        (tmp_path / name).write_text(json.dumps(records, indent=2))
    (tmp_path / "d.json").write_text("[\n" + ",\n".join(json.dumps(r) for r in files["a.json"][:5]) + "\n]\n")
    files["d.json"] = files["a.json"][:5]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert split == "100k" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        found = json_records(spark, str(tmp_path)).collect()
        table = read_annotated_json(spark, str(tmp_path)).cache()
        told = table.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(r["file"].rsplit("/", 1)[1], r["number"]): json.loads(r["json"]) for r in found}
    assert got == {(name, k): r for name, records in files.items() for k, r in enumerate(records)}
    for r in told:
        x = got[r["file"].rsplit("/", 1)[1], r["number"]]
        assert (r["v_gene"], r["j_gene"], r["v_family"], r["cdr3"]) == (x["v_gene"]["gene"] + "*01", "IGHJ4*02", "3", x["junc_aa"][:64])
        assert r["v_mutations"] == "|".join(m["loc"] + m["mut"] for m in x["var_muts_nt"]["muts"])
    # numbers of clusters, one a line, in the order of the records
    placed = table.select(F.col("sequence_id").alias("id"), F.col("v_gene").alias("component"))
    numbered = table.select("file", "number", "sequence_id").join(cluster_numbers(placed, 3), F.col("sequence_id") == F.col("id"))
    write_in_order(numbered, "cluster_no", ["file", "number"], str(tmp_path / "out"), partitions=4)
    parts = sorted((tmp_path / "out").glob("part-*.txt"))
    genes = sorted({x["v_gene"]["gene"] + "*01" for x in got.values()})
    assert len(parts) > 1 and [int(n) for p in parts for n in p.read_text().split()] == [genes.index(got[k]["v_gene"]["gene"] + "*01") for k in sorted(got)]


def test_null_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    write_in_order(df, "v", ["k"], str(tmp_path / "o"), 1)
    assert next((tmp_path / "o").glob("part-*")).read_text() == "x\n\n"

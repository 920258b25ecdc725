import json

import pytest
from lineage_cases import partition, table
from test_lineages import R1, R13

from lineagrid import cli
from lineagrid.plans.lineages import assign
from lineagrid.sources.tables import format_of, read_table, write_table
from lineagrid.streaming.arrivals import assign_arrivals


@pytest.mark.parametrize("name", ["x.csv", "x.tsv", "x.parquet", "x.ndjson", "x.json"])
@pytest.mark.parametrize("single", [False, True])
def test_round_trip(spark, tmp_path, name, single):
    df = table(spark, [*R1, ("q", "V", "J", 'A"B', None)])
    write_table(df, str(tmp_path / name), single_file=single)
    assert (tmp_path / name).is_file() == single
    back = read_table(spark, str(tmp_path / name))
    key = lambda d: sorted((r["sequence_id"], r["cdr3"], r["v_mutations"] or "") for r in d.collect())
    assert key(back) == key(df)
    if name == "x.json" and single:
        assert len(json.loads((tmp_path / name).read_text())) == 4


def test_formats():
    assert [format_of(p) for p in ("a.CSV", "a.tab", "a.pq", "a.jsonl", "d/a.json/")] == ["csv", "tsv", "parquet", "ndjson", "json"]
    with pytest.raises(ValueError, match="extension"):
        format_of("a.txt")


def test_no_header_and_unsupported(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2\n")
    assert read_table(spark, str(tmp_path / "x.csv"), has_header=False).columns == ["column_1", "column_2"]
    with pytest.raises(ValueError, match="annotation"):
        read_table(spark, "x.fasta", input_format="fasta")
    with pytest.raises(ValueError, match="Unsupported"):
        read_table(spark, "x.xyz", input_format="xyz")
    with pytest.raises(ValueError):
        write_table(table(spark, R1), str(tmp_path / "x.xlsx"))


def test_assign_from_path(spark, tmp_path):
    write_table(table(spark, R1), str(tmp_path / "in.tsv"), single_file=True)
    told, assigned = assign(str(tmp_path / "in.tsv"), spark, output_path=str(tmp_path / "out.parquet"), distance_cutoff=1.0, progressive=True)
    assert told.count() == assigned.count() == spark.read.parquet(str(tmp_path / "out.parquet")).count() == 3


def test_cli(spark, tmp_path, capsys):
    source = str(tmp_path / "in.csv")
    write_table(table(spark, R1), source, single_file=True)
    assert cli.main(["--input", source, "--distance-cutoff", "1.0"], spark) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0].endswith("lineage,lineage_size") and len(lines) == 4
    out, told = tmp_path / "out.parquet", tmp_path / "a.json"
    assert cli.main(["--input", source, "--output", str(out), "--assignments-json", str(told), "--no-mnemonic-names"], spark) == 0
    assert len(json.loads(told.read_text())) == 3 and spark.read.parquet(str(out)).count() == 3


def test_cli_custom_columns_and_allelic(spark, tmp_path, capsys):
    source = str(tmp_path / "in.tsv")
    write_table(table(spark, R13).toDF("id_col", "v_col", "j_col", "cdr3_col", "mut_col"), source, single_file=True)
    keys = ["--id-key", "id_col", "--vgene-key", "v_col", "--jgene-key", "j_col", "--cdr3-key", "cdr3_col", "--mutations-key", "mut_col"]
    assert cli.main(["--input", source, "--distance-cutoff", "0.3", "--ignore-likely-allelic-variants", "--allelic-variant-threshold", "1.0", "--min-seqs-for-allelic-variants", "2", *keys], spark) == 0
    assert {line.rsplit(",", 1)[1] for line in capsys.readouterr().out.strip().splitlines()[1:]} == {"1"}


def test_cli_errors_and_version(spark, tmp_path, capsys):
    source = str(tmp_path / "in.csv")
    write_table(table(spark, R1).drop("v_mutations"), source, single_file=True)
    assert cli.main(["--input", source], spark) == 1
    assert "Missing column" in capsys.readouterr().err
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0


def test_arrivals(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    rows = [R1[0], R1[1], R1[2], ("z", "IGHV9", "IGHJ1", "CARZZZ", "M1")]
    for k, part in enumerate((rows[:1], rows[1:2], rows[2:])):
        write_table(table(spark, part), str(folder / f"{k}.json"), "ndjson", single_file=True)
        stream = spark.readStream.schema("sequence_id string, v_gene string, j_gene string, cdr3 string, v_mutations string").json(str(folder))
        assign_arrivals(stream, store, distance_cutoff=1.0).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{store}/v2")
    assert partition(last) == {frozenset(("a1", "a2", "a3")), frozenset("z")}
    assert {r["sequence_id"]: r["lineage_size"] for r in last.collect()} == {"a1": 3, "a2": 3, "a3": 3, "z": 1}


def test_registry():
    import __spark_entry__ as registry

    assert set(registry.oracle_sql()) <= set(registry.queries())

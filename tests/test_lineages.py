import random
import re

import lineage_cases
import pytest
from lineage_cases import SCHEMA, average_linkage, partition, single_linkage, table

from lineagrid.operators import dendrogram, linkage
from lineagrid.options import LineageOptions
from lineagrid.plans.lineages import assign, assign_lineages, assignments

R1 = [("a1", "IGHV3-7", "IGHJ4", "CARAAAAWGQGTLV", "M1|M2"), ("a2", "IGHV3-7", "IGHJ4", "CARAAATWGQGTLV", "M1|M3"), ("a3", "IGHV3-7", "IGHJ4", "CARAATTWGQGTLV", "M2|M4")]
R13 = [("h1", "IGHV6-1", "IGHJ6", "ABCDEFGHIJKL", "A10|A20|X1"), ("h2", "IGHV6-1", "IGHJ6", "ABCDZZZZIJKL", "A10|A20|Y2")]


def lineages(spark, rows, **options):
    return assign_lineages(table(spark, rows), **options)


def test_wide_cutoff_merges_and_zero_splits(spark):
    merged = lineages(spark, R1, distance_cutoff=1.0)
    assert partition(merged) == {frozenset(("a1", "a2", "a3"))}
    assert {r["lineage_size"] for r in merged.collect()} == {3}
    assert set(merged.columns) == {"sequence_id", "v_gene", "j_gene", "cdr3", "v_mutations", "lineage", "lineage_size"}
    assert len(partition(lineages(spark, R1, distance_cutoff=0.0))) == 3


def test_one_row(spark):
    assert lineages(spark, R1[:1]).first()["lineage_size"] == 1


def test_grouping_and_germline_penalty(spark):
    rows = [("a", "IGHV1-1", "IGHJ4", "CARTESTWGQGTLV", "M1|M2"), ("b", "IGHV2-1", "IGHJ6", "CARTESTWGQGTLV", "M1|M2")]
    assert len(partition(lineages(spark, rows, distance_cutoff=1.0))) == 2
    assert len(partition(lineages(spark, rows, distance_cutoff=1.0, group_by_v=False, group_by_j=False))) == 2
    assert len(partition(lineages(spark, rows, distance_cutoff=14.96, group_by_v=False, group_by_j=False))) == 1


def test_light_chain_grouping(spark):
    rows = [("a", "V1", "J1", "CARTEST", "M1", "IGKV1", "IGKJ1"), ("b", "V1", "J1", "CARTEST", "M1", "IGLV2", "IGLJ2")]
    df = table(spark, rows, SCHEMA + ", `v_gene:1` string, `j_gene:1` string")
    assert len(partition(assign_lineages(df))) == 2
    assert len(partition(assign_lineages(df, group_by_light_chain_vj=False))) == 1


def test_paired_columns(spark):
    paired = table(spark, R1).toDF("sequence_id:0", "v_gene:0", "j_gene:0", "cdr3:0", "v_mutations:0")
    out = assign_lineages(paired, distance_cutoff=1.0)
    assert {r["lineage_size"] for r in out.collect()} == {3}
    assert assignments(out).columns == ["sequence_id", "lineage"]


def test_names(spark):
    random_name = lineages(spark, R1, distance_cutoff=1.0, mnemonic_names=False).first()["lineage"]
    assert re.fullmatch("[A-Za-z0-9]{16}", random_name)
    assert lineages(spark, R1, distance_cutoff=1.0).first()["lineage"].count("_") == 7
    again = [lineages(spark, r, distance_cutoff=1.0, name_seed=123).first()["lineage"] for r in (R1, R1[::-1])]
    assert again[0] == again[1] != lineages(spark, R1, distance_cutoff=1.0).first()["lineage"]


def test_empty_null_and_repeated_mutations(spark):
    rows = [(f"s{k}", "V", "J", "CARDUP", m) for k, m in enumerate(("", None, "M1|M2", "M1|M1|M2", "M1|M2|M2"))]
    assert len(partition(lineages(spark, rows, distance_cutoff=1.0))) == 1


def test_delimiter_is_literal(spark):
    rows = [("a", "V", "J", "ABCD", "D1.D2"), ("b", "V", "J", "ABCE", "D1.D3")]
    assert len(partition(lineages(spark, rows, distance_cutoff=0.2, mutation_delimiter="."))) == 1  # (1 - .35) / 4
    assert len(partition(lineages(spark, rows, distance_cutoff=0.2))) == 2


def test_lengths_never_meet_in_default_mode(spark):
    rows = [("a", "V", "J", "CARA", None), ("b", "V", "J", "CARAAAAAAAAA", None)]
    assert len(partition(lineages(spark, rows, distance_cutoff=0.05))) == 2


def test_allelic_variants_flip_a_merge(spark):
    assert len(partition(lineages(spark, R13, distance_cutoff=0.3))) == 1
    strict = dict(ignore_likely_allelic_variants=True, allelic_variant_threshold=1.0, min_seqs_for_allelic_variants=2)
    assert len(partition(lineages(spark, R13, distance_cutoff=0.3, **strict))) == 2


def test_locus_limits_the_allelic_scan_only(spark):
    df = table(spark, [(*R13[0], "IGH"), (*R13[1], "IGK")], SCHEMA + ", locus string")
    strict = dict(distance_cutoff=0.3, ignore_likely_allelic_variants=True, allelic_variant_threshold=1.0, min_seqs_for_allelic_variants=2)
    assert len(partition(assign_lineages(df, **strict))) == 1  # one IGH row is too few to scan
    rest = {r["sequence_id"]: r["lineage_size"] for r in assign_lineages(df, restrict_to_igh=True).collect()}
    assert rest == {"h1": 1, "h2": None}


def test_custom_keys_and_other_columns(spark):
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(R1)], "id_col string, v_col string, j_col string, cdr3_col string, mut_col string, n int, lineage string")
    out = assign_lineages(df, distance_cutoff=1.0, id_key="id_col", vgene_key="v_col", jgene_key="j_col", cdr3_key="cdr3_col", mutations_key="mut_col")
    assert sorted(r["n"] for r in out.collect()) == [0, 1, 2]
    assert out.columns.count("lineage") == 1 and out.first()["lineage"] != "x"


def test_missing_column_and_bad_ids(spark):
    with pytest.raises(ValueError, match="Missing column"):
        lineages(spark, R1).drop("x") and assign_lineages(table(spark, R1).drop("v_mutations"))
    with pytest.raises(ValueError, match="unique"):
        lineages(spark, [R1[0], R1[0]])
    with pytest.raises(ValueError, match="null"):
        lineages(spark, [(None, *R1[0][1:])])
    with pytest.raises(TypeError, match="unknown option"):
        LineageOptions.of(None, colour=1)
    with pytest.raises(TypeError):
        assign(42)


def test_null_genes_group_together_and_null_cdr3_stays_alone(spark):
    rows = [("a", None, "J", "CARAAA", None), ("b", None, "J", "CARAAA", None), ("c", "V", "J", None, None), ("d", "V", "J", None, None), ("e", "V", "J", "", None), ("f", "V", "J", "", None)]
    assert partition(lineages(spark, rows)) == {frozenset("ab"), *map(frozenset, "cdef")}


def test_empty_table(spark):
    assert lineages(spark, []).count() == 0


def sample(seed, n, lengths=(6, 7, 8)):
    dice = random.Random(seed)
    return [(f"s{k:03}", dice.choice(("V1", "V2")), dice.choice(("J1", "J2")), "".join(dice.choice("AC") for _ in range(dice.choice(lengths))), "|".join(dice.sample(["M1", "M2", "M3", "M4"], dice.randint(0, 3)))) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_single_linkage_against_brute_force(spark, seed):
    rows = sample(seed, 70)
    same = lambda a, b: a[1:3] == b[1:3] and len(a[3]) == len(b[3])
    expected = single_linkage(rows, 0.2, same)
    assert partition(lineages(spark, rows, distance_cutoff=0.2)) == expected
    random.Random(seed).shuffle(rows)
    assert partition(assign_lineages(table(spark, rows).repartition(3), distance_cutoff=0.2)) == expected


def test_ungrouped_bands_against_brute_force(spark):
    rows = sample(3, 50, lengths=(12, 13))
    meet = lambda a, b: len(a[3]) == len(b[3]) and (a[3][:6] == b[3][:6] or a[3][-6:] == b[3][-6:] or a[1:3] == b[1:3])
    got = partition(lineages(spark, rows, distance_cutoff=5.3, group_by_v=False, group_by_j=False))
    assert got == single_linkage(rows, 5.3, meet)


def test_blocks_do_not_change_components(spark, monkeypatch):
    from lineagrid.operators import linkage

    rows = sample(4, 120, lengths=(8,))
    expected = partition(lineages(spark, rows, distance_cutoff=0.2))
    monkeypatch.setattr(linkage, "BLOCK", 7)
    assert partition(lineages(spark, rows, distance_cutoff=0.2)) == expected


@pytest.mark.parametrize("seed", [5, 6])
def test_average_linkage_against_brute_force(spark, seed):
    dice = random.Random(seed)
    rows = [(f"s{k:02}", "V", "J", "".join(dice.choice("ACDE") for _ in range(dice.choice((9, 10, 11)))), "|".join(dice.sample([f"M{m}" for m in range(6)], dice.randint(0, 3)))) for k in range(26)]
    reachable = lambda a, b: True
    assert partition(lineages(spark, rows, distance_cutoff=0.55, mode="average")) == average_linkage(rows, 0.55, reachable)


@pytest.mark.parametrize("dense", [1, 6, 2000])
def test_average_linkage_of_a_large_component(spark, monkeypatch, dense):
    """Components over DENSE merge in rounds of tiles; copies of a row weigh by their number."""
    monkeypatch.setattr(dendrogram, "DENSE", dense)
    monkeypatch.setattr(dendrogram, "BLOCK", 5)
    dice = random.Random(31)
    kinds = [("V", "J", "".join(dice.choice("ACDE") for _ in range(dice.choice((11, 13)))), "|".join(dice.sample([f"M{m}" for m in range(6)], dice.randint(0, 3)))) for _ in range(22)]
    rows = [(f"s{k:02}", *dice.choice(kinds)) for k in range(36)]
    options = {"distance_cutoff": 0.66, "shared_mutation_bonus": 0.3137, "mode": "average"}
    monkeypatch.setattr(lineage_cases.pair_score, "__defaults__", (0.3137, 2.0))
    expected = average_linkage(rows, 0.66, lambda a, b: True)
    assert 1 < len(expected) < 22 and max(map(len, expected)) > 8
    assert partition(lineages(spark, rows, **options)) == expected


def test_average_linkage_ignores_row_order(spark):
    rows = [("A", "V", "J", "AAAAAAAAAA", None), ("B", "V", "J", "AAAAAAAACC", None), ("C", "V", "J", "GGGGGGGGGG", None), ("D", "V", "J", "GGGGGGGGGT", None)]
    both = {partition_key(lineages(spark, r, distance_cutoff=0.15, mode="average")) for r in (rows, rows[2:] + rows[:2])}
    assert both == {frozenset({frozenset("CD"), frozenset("A"), frozenset("B")})}


def partition_key(df):
    return frozenset(partition(df))


def test_capped_buckets_are_an_option(spark):
    rows = [(f"s{k}", "V", "J", "CARAAA", None) for k in range(6)]
    assert len(partition(lineages(spark, rows))) == 1
    assert len(partition(lineages(spark, rows, max_pairs_per_bucket=2))) == 4  # pairs (0, 1) and (0, 2)


def test_one_tree_cut_at_several_heights(spark):
    """Cuts of one tree equal assignments of their own; parents are never lower, and roots stay."""
    from lineagrid.operators.dendrogram import average_tree, cut_tree
    from lineagrid.operators.prepare import prepared_rows

    rows = sample(21, 60, lengths=(7, 8))
    found, _ = prepared_rows(table(spark, rows), LineageOptions())
    tree = average_tree(found, 0.5, 0.35, 2.0, 4).cache()
    heights = {r["node"]: (r["parent"], r["height"]) for r in tree.collect()}
    assert all(p not in heights or heights[p][1] >= h - 1e-9 for p, h in heights.values())
    sizes = []
    for height in (0.05, 0.2, 0.5):
        groups = {}
        for r in cut_tree(found, tree, height).collect():
            groups.setdefault(r["component"], set()).add(r["node"])
        assert {frozenset(g) for g in groups.values()} == average_linkage(rows, height, lambda a, b: a[1:3] == b[1:3])
        assert all(min(g) == name for name, g in groups.items())
        sizes.append(len(groups))
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[2]

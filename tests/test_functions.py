import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineagrid.functions import distance, naming
from lineagrid.operators import linkage
from lineagrid.operators.components import connected_components, followed
from lineagrid.operators.dendrogram import average_clusters
from lineagrid.operators.essences import canonical_mutations, cluster_numbers, essences, megaclusters, nearest_centers


@given(st.text("ABC", max_size=8), st.text("ABC", max_size=8))
@settings(max_examples=200, deadline=None)
def test_levenshtein(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    table[0], table[:, 0] = range(len(b) + 1), range(len(a) + 1)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = min(table[i, j + 1] + 1, table[i + 1, j] + 1, table[i, j] + (a[i] != b[j]))
    assert distance.levenshtein(a, b) == table[-1, -1]


def test_worked_scores(spark):
    rows = [("CARA", "CARB", ["M1", "M2"], ["M1", "M3"], "V", "V", "J", "J", 0.1625), ("ABCDEFGHIJKL", "ABCDZZZZIJKL", ["A10", "A20"], ["A10", "A20"], "V", "V", "J", "J", 0.275), ("CARTESTWGQGTLV", "CARTESTWGQGTLV", ["M1", "M2"], ["M2", "M1"], "V", "W", "J", "K", 14.95)]
    df = spark.createDataFrame(rows, "a string, b string, m array<string>, n array<string>, va string, vb string, ja string, jb string, expected double")
    c = F.col
    germline = distance.germline_penalty(c("va"), c("vb"), c("ja"), c("jb"))
    got = df.select("expected", distance.score(germline, distance.edit_distance(c("a"), c("b")), F.length("a"), F.length("b"), distance.shared_mutations(c("m"), c("n")), 0.35, 2.0).alias("s")).collect()
    for r in got:
        assert r["s"] == pytest.approx(r["expected"], abs=1e-12)
    for a, b, m, n, va, vb, ja, jb, expected in rows:
        assert distance.score_matrix([va, vb], [ja, jb], [a, b], [m, n], 0.35, 2.0)[0, 1] == pytest.approx(expected, abs=1e-12)


def test_name_vector(spark):
    h = hashlib.sha256(b"7\0a\0b").hexdigest()
    assert h == "f12e3cd01c8b0299f792d1a27195bcb3d3d3debf7f324c038e95c124fc672746"
    df = spark.createDataFrame([(["b", "a"],)], "ids array<string>")
    assert df.select(naming.digest_column(F.col("ids"), 7)).first()[0] == h
    members = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, component string")
    row = naming.named(members, False, 7, None, 2).first()
    assert (row["digest"], row["lineage_size"], row["lineage"]) == (h, 2, naming.lineage_name(["b", "a"], False, 7))


def test_word_list(tmp_path):
    assert len(set(naming.words())) == 2048
    path = tmp_path / "words.txt"
    path.write_text("one\ntwo\n")
    assert set(naming.lineage_name(["x"], True, None, naming.words(str(path))).split("_")) <= {"one", "two"}


def test_components_against_union_find(spark):
    dice = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 60)] + [(dice.randint(1000, 1100), dice.randint(1000, 1100)) for _ in range(70)] + [(5, 5), (None, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for finish in (50_000, 60, 0):  # in one task, after some rounds, and by rounds alone
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), finish=finish).collect()}
        assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def table_of(rows):
    return pa.table({c: [r[k] for r in rows] for k, c in enumerate(("rep", "v", "j", "cdr3", "muts"))})


@pytest.mark.parametrize("tile", [1024, 3])
def test_forest_connects_what_is_within_the_cutoff(monkeypatch, tile):
    """Blocks against themselves and each other, with shared mutations that decide, against single pair scores."""
    monkeypatch.setattr(linkage, "TILE", tile)
    dice = random.Random(7)
    rows = [(f"r{k // 2:02}", dice.choice("VW"), "J", "", [f"M{m}" for m in range(6) if dice.random() < 0.4]) for k in range(40)]
    essence = {}
    rows = [(r, *essence.setdefault(r, (v, j, "".join(dice.choice("ACD") for _ in range(9)))), m) for r, v, j, _, m in rows]
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and distance.score_matrix([a[1], b[1]], [a[2], b[2]], [a[3], b[3]], [a[4], b[4]], 0.35, 2.0)[0, 1] <= 0.3}
    genes = {}
    left, right = linkage.Block.of(table_of(rows[:24]), genes), linkage.Block.of(table_of(rows[24:]), genes)
    for a, b in ((left, left), (right, right), (left, right)):
        found = list(linkage.forest(a, b, 0.3, 0.35))
        meet = {(x, y) for x, y in near if (x in a.reps and y in b.reps)}
        graphs = [parts(a.reps + b.reps, links) for links in (found, meet)]
        assert set(found) <= meet | {(y, x) for x, y in meet} and graphs[0] == graphs[1] and len(found) == len({*a.reps, *b.reps}) - len(graphs[0])


def parts(nodes, links):
    """The sets of connected nodes."""
    groups = {n: {n} for n in nodes}
    for a, b in links:
        both = groups[a] | groups[b]
        groups.update({n: both for n in both})
    return {frozenset(g) for g in groups.values()}


@given(st.lists(st.tuples(st.text("ABC", max_size=6), st.text("ABC", max_size=6)), max_size=12))
@settings(max_examples=60, deadline=None)
def test_levenshtein_of_many_pairs(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert distance.levenshtein_pairs(a, b, most=3).tolist() == [distance.levenshtein(x, y) for x, y in pairs]


def test_weights_move_an_average():
    d = np.array([[0, 0.1, 0.5], [0.1, 0, 0.1], [0.5, 0.1, 0]])
    assert len(set(average_clusters(d, 0.29).tolist())) == 2
    heavy = average_clusters(d, 0.29, np.array([1, 9, 1]))
    assert len(set(heavy.tolist())) == 1


def test_essences(spark):
    rows = spark.createDataFrame([("a", "V", "J", "CARA", ["M1", "M2"]), ("b", "V", "J", "CARA", ["M1"]), ("c", "V", "J", "CARA", ["M1", "M3"]), ("d", "V", "J", "CARB", ["M9"])], "id string, v string, j string, cdr3 string, muts array<string>")
    weights = essences(rows)
    assert {(r["cdr3"], r["weight"]) for r in weights.collect()} == {("CARA", 3), ("CARB", 1)}
    assert {(r["cdr3"], r["mutation"]) for r in canonical_mutations(rows).collect()} == {("CARA", "M1"), ("CARB", "M9")}
    assert {(r["cdr3"], r["center"], r["distance"]) for r in nearest_centers(weights).collect()} == {("CARA", "CARA", 0.0), ("CARB", "CARA", 0.25)}


def test_megaclusters_and_numbers(spark):
    heavy = ["CARAAAA", "CARAAAC", "CARZZZZ"]
    rows = [(f"{c}{k}", "V", "J", c, []) for c in heavy for k in range(3)] + [("x", "V", "J", "CARAACC", []), ("y", None, "J", "CARAAAA", [])]
    df = spark.createDataFrame(rows, "id string, v string, j string, cdr3 string, muts array<string>")
    got = {(r["v"], r["cdr3"]): (r["center"], r["megacluster"]) for r in megaclusters(essences(df)).collect()}
    names = {c: got["V", c][1] for c in heavy}
    assert names["CARAAAA"] == names["CARAAAC"] != names["CARZZZZ"]
    assert got["V", "CARAACC"] == ("CARAAAC", names["CARAAAA"]) and (None, "CARAAAA") not in got
    placed = spark.createDataFrame([("a", "k"), ("b", "m"), ("c", "k"), ("d", "z")], "id string, component string")
    assert {r["id"]: r["cluster_no"] for r in cluster_numbers(placed, 3).collect()} == {"a": 0, "b": 1, "c": 0, "d": 2}

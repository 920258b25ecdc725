"""Edges from blocks against all pairs, and what they keep in the shared folder."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_segment_index import SCHEMA, all_edges, sequences

from lineagrid.functions import distance
from lineagrid.operators import pair_blocks
from lineagrid.operators.essences import merged_centers, nearest_centers
from lineagrid.operators.segment_index import near_edges


@pytest.mark.parametrize("cutoff, bonus, multiplier", [(0.35, 0.35, 2.0), (0.35, 0.0, 0.0), (5.4, 0.35, 1.0), (0.3, -0.2, 0.5)])
@pytest.mark.parametrize("words", [32, 0])
def test_small_blocks_equal_all_pairs(spark, monkeypatch, cutoff, bonus, multiplier, words):
    for name, value in (("FEW", 3), ("MANY", 8), ("AT_ONCE", 5), ("MOST_WORDS", words)):
        monkeypatch.setattr(pair_blocks, name, value)
    rows = sequences(5, 80, genes="VW")
    rows += [(f"t{k:02}", *rows[k % 4][1:]) for k in range(12)] + [("l1", ["g"], "V", "J", "A" * 70 + "CAC", []), ("l2", ["g"], "V", "J", "CC" + "A" * 70 + "C", ["M1"]), ("l3", ["g"], "V", "J", "A" * 69 + "CAC", [])]
    expected = all_edges(rows, cutoff, bonus, multiplier)
    for block in (7, 1000):
        found = pair_blocks.edges_in_blocks(spark.createDataFrame(rows, SCHEMA), cutoff, bonus, multiplier, block=block).collect()
        got = {(r["id_a"], r["id_b"]): r["score"] for r in found}
        assert got.keys() == expected.keys() and len(found) == len(expected) > 5
        assert all(abs(got[k] - v) < 1e-12 for k, v in expected.items())


def test_edits(spark):
    dice = random.Random(3)
    for n, m in ((0, 3), (1, 1), (9, 11), (16, 16), (17, 20), (33, 40), (64, 66), (70, 71)):
        a, b = (["".join(dice.choice("AC") for _ in range(k)) for _ in range(20)] for k in (n, m))
        x, y = (distance.letters(t) if t[0] else distance.letters(t).reshape(20, 0) for t in (a, b))
        assert pair_blocks.edits(x, y).tolist() == [distance.levenshtein(p, q) for p, q in zip(a, b, strict=True)]


def test_rows_without_id_and_equal_ids_are_no_pairs(spark):
    rows = [(i, ["g"], "V", "J", t, []) for i, t in ((None, "CARA"), ("a", "CARA"), ("a", "CARC"), ("b", "CARC"))]
    assert sorted(tuple(r)[:2] for r in near_edges(spark.createDataFrame(rows, SCHEMA), 0.35, 0.35, 2.0).collect()) == [("a", "b"), ("a", "b")]


def test_edges_store_no_pairs(spark):
    """Candidates of these rows took 20 MB of tables before."""
    dice = random.Random(2)
    rows = [(f"s{k}", ["g"], "V", "J", "CAR" + "".join(dice.choice("ACDEFGHIKLMNPQRS") for _ in range(9)) + "DYW", ["M1", "M2"]) for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    found = near_edges(df, 0.35, 0.35, 2.0)
    assert found.agg(F.count("*")).collect()[0][0] > 10_000
    made = [os.path.join(at, f) for name in set(os.listdir(folder)) - before for at, _, files in os.walk(os.path.join(folder, name)) for f in files]
    assert sum(map(os.path.getsize, made)) < 100_000


@pytest.mark.parametrize("block", [5, 1000])
def test_nearest_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(pair_blocks, "FEW", 3)
    monkeypatch.setattr(pair_blocks, "MANY", 16)
    dice = random.Random(6)
    texts = lambda n, sizes: sorted({"C" + "".join(dice.choice("ACé") for _ in range(dice.choice(sizes))) + "W" for _ in range(n)})
    light, heavy = texts(40, (0, 4, 5, 7, 70)), texts(30, (0, 5, 6, 66))
    asked = [("g", t, at) for t in light for at in {len(h) for h in heavy}]
    found = pair_blocks.nearest_in_blocks(spark.createDataFrame(asked, "genes string, cdr3 string, at int"), spark.createDataFrame([(g, h) for g in "gx" for h in heavy], "genes string, center string"), block)
    best = {}
    for r in found.collect():
        key, told = (r["cdr3"], len(r["center"])), (r["edits"], r["center"])
        best[key] = min(best.get(key, told), told)
    assert best == {(t, at): min((distance.levenshtein(t, h), h) for h in heavy if len(h) == at) for _, t, at in asked}


def test_centers_are_compared_without_rows(spark):
    """25 million pairs of essences and centers in one group; each was a row of a join before."""
    dice = random.Random(7)
    text = lambda: "CAR" + "".join(dice.choice("ACDEFGHIKLMNPQRS") for _ in range(9)) + "DYW"
    weighted = spark.createDataFrame(sorted({("V", "J", text(), 1 + 4 * (k % 2)) for k in range(10_000)}), "v string, j string, cdr3 string, weight long").dropDuplicates(["cdr3"])
    plan = nearest_centers(weighted)
    assert "levenshtein" not in plan._jdf.queryExecution().toString()
    assert plan.count() == weighted.count()


def test_merged_centers_are_compared_without_rows(spark):
    dice = random.Random(9)
    made = sorted({(dice.choice((None, "V")), "J", "CAR" + "".join(dice.choice("ACDE") for _ in range(dice.choice((4, 5, 6)))) + "W", 5) for _ in range(60)}, key=str)
    found = merged_centers(spark.createDataFrame(made, "v string, j string, cdr3 string, weight long"), multiplier=0.5, closer_than=0.25)
    assert "levenshtein" not in found._jdf.queryExecution().toString()
    root = {m[:3]: m[:3] for m in made}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in root:
        for b in root:
            x, y = a[2], b[2]
            if a[0] == b[0] and x != y and (distance.levenshtein(x, y) + abs(len(x) - len(y)) * 0.5) / min(len(x), len(y)) < 0.25:
                root[find(a)] = find(b)
    expected, got = {}, {}
    for m in root:
        expected.setdefault(find(m), set()).add(m)
    for r in found.collect():
        got.setdefault(r["megacluster"], set()).add((r["v"], r["j"], r["center"]))
    assert sorted(map(sorted, map(lambda s: map(str, s), got.values()))) == sorted(map(sorted, map(lambda s: map(str, s), expected.values()))) and 3 < len(got) < len(root)

"""Edges found through the segment index against all pairs."""

import itertools
import random

import lineage_cases
import pytest

from lineagrid.operators import segment_index
from lineagrid.operators.segment_index import candidate_texts, hamming_keys, levels, near_edges

SCHEMA = "id string, grp array<string>, v string, j string, cdr3 string, muts array<string>"


def sequences(seed, n, letters="ACDE", lengths=(9, 10, 11, 12), mutations=4, genes="V"):
    dice = random.Random(seed)
    head, tail = "CAR", "DYW"
    pool = [f"M{k}" for k in range(6 if mutations < 8 else 40)]
    base = ["".join(dice.choice(letters) for _ in range(20)) for _ in range(4)]
    out = []
    for k in range(n):
        size = dice.choice(lengths)
        core = dice.choice(base)[:size] if dice.random() < 0.6 else "".join(dice.choice(letters) for _ in range(size))
        core = "".join(dice.choice(letters) if dice.random() < 0.15 else c for c in core)
        out.append((f"s{k:03}", ["g", None] if dice.random() < 0.8 else [None, "g"], dice.choice(genes), "J", head + core + tail, dice.sample(pool, dice.randint(0, mutations))))
    return out


def all_edges(rows, cutoff, bonus, multiplier):
    plain = [(r[0], r[2], r[3], r[4], "|".join(r[5])) for r in rows]
    score = lambda a, b: lineage_cases.pair_score(a, b, bonus, multiplier)
    return {(a[0], b[0]): score(a, b) for (a, x), (b, y) in itertools.combinations(zip(plain, rows, strict=True), 2) if x[1] == y[1] and a[3] and b[3] and score(a, b) <= cutoff}


CASES = [
    (1, dict(), 0.35, 0.35, 2.0),
    (2, dict(mutations=0), 0.35, 0.35, 2.0),
    (3, dict(mutations=25), 0.2, 0.35, 2.0),  # mutations alone can make a pair near
    (4, dict(lengths=(3, 4, 5, 6)), 0.5, 0.0, 0.5),
    (5, dict(genes="VW"), 10.4, 0.2, 1.0),  # wide enough for other genes: all pairs
    (6, dict(letters="AC"), 0.12, 0.9, 3.0),
    (7, dict(), 0.25, -0.2, 2.0),
    (8, dict(lengths=(1, 2, 3)), 0.6, 0.35, 0.1),
]


@pytest.mark.parametrize("seed, shape, cutoff, bonus, multiplier", CASES)
def test_edges_equal_all_pairs(spark, seed, shape, cutoff, bonus, multiplier):
    rows = sequences(seed, 90, **shape)
    rows += [("x1", ["g", None], "V", "J", "", []), ("x2", ["g", None], "V", "J", None, []), ("x3", ["g", None], None, "J", rows[0][4], ["M1"]), ("x4", ["g", None], None, "J", rows[0][4], [])]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = all_edges(rows, cutoff, bonus, multiplier)
    found = near_edges(df, cutoff, bonus, multiplier).collect()
    got = {(r["id_a"], r["id_b"]): r["score"] for r in found}
    assert got.keys() == expected.keys() and len(found) == len(expected) > 5
    assert all(abs(got[k] - v) < 1e-9 for k, v in expected.items())
    star = [(r["id_a"], r["id_b"]) for r in near_edges(df, cutoff, bonus, multiplier, spanning=True).collect()]
    assert set(star) <= set(expected) and lineage_cases.components(star) == lineage_cases.components(expected)


def test_no_edges(spark):
    df = spark.createDataFrame(sequences(1, 5), SCHEMA)
    assert near_edges(df, 0.0, 0.35, 2.0).count() == 0
    assert near_edges(df.where("id = ''"), 0.35, 0.35, 2.0).count() == 0
    assert near_edges(df.where("id = 's001'"), 0.35, 0.35, 2.0).count() == 0


def test_few_candidates(spark):
    """Sequences with a common beginning and end and random letters between: the index leaves few of all pairs."""
    dice = random.Random(11)
    rows = [(f"s{k}", ["g"], "V", "J", "CAR" + "".join(dice.choice("ACDEFGHIKLMNPQRS") for _ in range(10)) + "DYW", []) for k in range(1500)]
    met, _ = candidate_texts(spark.createDataFrame(rows, SCHEMA), 0.35, 0.35, 2.0)
    assert met.count() < 1500 * 1499 / 2 / 20


@pytest.mark.parametrize("k, varying", [(0, 3), (1, 2), (3, 7), (6, 9), (5, 30)])
def test_a_pair_of_k_differences_shares_a_key(k, varying):
    dice = random.Random(k)
    chances = [(at + 1, dice.choice((0.06, 0.3, 0.9))) for at in range(varying)]
    keys = hamming_keys(chances, k, 10_000)
    assert len(keys) <= max(segment_index.MOST_KEYS, k + 1)
    for _ in range(500):
        apart = set(dice.sample(range(1, varying + 1), k))
        assert any(not apart & set(key) for key in keys)


def test_levels_cover_all_mutation_counts():
    chances = [(at, 0.1) for at in range(1, 10)]
    for more in (0, 1, 2):
        told = [x for x in levels(9, more, 100, 30, chances, 0, 0, 0.35, 0.35, 2.0)]
        spans = sorted((x[2], x[3]) for x in told if x[0] in ("choices", "segments"))
        assert spans[-1][1] == segment_index.NO_END and all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
        assert [x[4] > 0 for x in told if x[0] == "mutations"] == [True]

"""Pairs compared as words against the plain column functions."""

import random

import pytest
from pyspark.sql import functions as F

from lineagrid.functions import distance, packed
from lineagrid.operators import candidates

SCHEMA = "id string, grp array<string>, v string, j string, cdr3 string, muts array<string>"


@pytest.mark.parametrize("words", [1, 4])
def test_words_give_the_plain_numbers(spark, words):
    dice = random.Random(words)
    letters = ["ACDE", "ACÿé日", "~ \x7f\x01"]
    pool = [f"M{k}" for k in range(150)]
    rows = [(f"s{k:03}", [dice.choice("gh"), None], "V", "J", "".join(dice.choice(dice.choice(letters)) for _ in range(dice.choice((0, 7, 8, 9, 30, 140)))), dice.sample(pool, dice.randint(0, 60))) for k in range(60)]
    rows.append(("n", ["g", None], None, None, None, []))
    made = packed.with_words(spark.createDataFrame(rows, SCHEMA), words)
    told = made.rows
    assert told.count() == len(rows) and made.letters == 16 and not made.all_letters and made.all_mutations == (words == 4)
    side = lambda c: told.select(F.col("grp").alias(f"g{c}"), *[F.col(x).alias(f"{x}_{c}") for x in ("id", "cdr3", "muts", "letters", "bits", "rest")])
    pairs = side("a").join(side("b"), F.col("ga").eqNullSafe(F.col("gb")))
    plain = (distance.edit_distance(F.col("cdr3_a"), F.col("cdr3_b")), distance.shared_mutations(F.col("muts_a"), F.col("muts_b")))
    got = pairs.select(made.distance().alias("d"), made.shared().alias("s"), plain[0].alias("pd"), plain[1].alias("ps")).collect()
    assert len(got) > 1500 and all((r["d"], r["s"]) == (r["pd"], r["ps"]) for r in got)


def test_packed_scores_equal_scored_pairs(spark):
    dice = random.Random(6)
    rows = [(f"s{k:03}", ["g"], "V", "J", "".join(dice.choice("ACD") for _ in range(dice.choice((7, 9)))), dice.sample(["M1", "M2", "M3"], dice.randint(0, 3))) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    columns = ("id_a", "id_b", "distance", "shared", "score")
    made = packed.with_words(df)
    assert made.letters == 2 and made.all_letters and made.all_mutations
    plain, fast = (sorted(tuple(r) for r in x.select(*columns).collect()) for x in (candidates.scored(candidates.candidate_pairs(df), 0.35, 2.0), candidates.packed_scores(df, 0.35, 2.0)))
    assert fast == plain and len(plain) > 500

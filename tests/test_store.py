"""The table kept by parts equals one assignment of all rows, whatever the batches are."""

import random

import pytest
from lineage_cases import SCHEMA, partition, table

from lineagrid.options import LineageOptions
from lineagrid.plans.lineages import assign_lineages
from lineagrid.streaming.store import Store, assign_batch, assign_into_store, read_store

OPTIONS = LineageOptions(distance_cutoff=0.3, mnemonic_names=False)


def arrivals(seed, n):
    dice = random.Random(seed)
    return [(f"s{k:03}", dice.choice(("IGHV1-2", "IGHV3/OR-7", None)), dice.choice(("J1", "J2")), "".join(dice.choice("AC") for _ in range(8)), "M1") for k in range(n)]


def told(df):
    return {(r["sequence_id"], r["lineage"], r["lineage_size"]) for r in df.collect()}


def test_any_split_into_batches_gives_the_same(spark, tmp_path):
    rows = arrivals(1, 60)
    store = str(tmp_path / "store")
    expected = told(assign_lineages(table(spark, rows), OPTIONS))
    for number, (a, b) in enumerate(((0, 25), (25, 25), (25, 40), (40, 60))):
        assign_batch(table(spark, rows[a:b]), store, number, OPTIONS, buckets=4)
    assert told(read_store(spark, store)) == expected
    assign_batch(table(spark, rows[40:]), store, 3, OPTIONS, buckets=4)  # replayed
    assert told(read_store(spark, store)) == expected
    Store(spark, store).forget(keep=1)
    assert told(read_store(spark, store)) == expected and Store(spark, store).batches() == [3]


def test_only_touched_parts_are_written(spark, tmp_path):
    store = str(tmp_path / "store")
    assign_batch(table(spark, [(f"s{k}", f"IGHV{k}-1", "J", "CARAAA", None) for k in range(8)]), store, 0, OPTIONS)
    assign_batch(table(spark, [("n", "IGHV3-1", "J", "CARAAA", None)]), store, 1, OPTIONS)
    parts = Store(spark, store).manifest()
    assert sorted(parts.values()) == [0] * 7 + [1] and [p for p, n in parts.items() if n == 1][0].startswith("part_family=IGHV3/")
    assert frozenset(("s3", "n")) in partition(read_store(spark, store))
    assert Store(spark, store).read({p: n for p, n in parts.items() if n == 1}).count() == 2
    with pytest.raises(ValueError, match="column names"):
        assign_batch(table(spark, [("x", "V", "J", "A", None, 1)], SCHEMA + ", part_bucket int"), store, 2, OPTIONS)


def test_a_stream_into_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = arrivals(2, 30)
    for k in range(2):
        table(spark, rows[15 * k : 15 * k + 15]).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        assign_into_store(stream, str(tmp_path / "store"), OPTIONS, buckets=2).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert told(read_store(spark, str(tmp_path / "store"))) == told(assign_lineages(table(spark, rows), OPTIONS))
    assert read_store(spark, str(tmp_path / "none")) is None

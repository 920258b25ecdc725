"""The SQL of the operators that compare rows, held against the plain versions on awkward rows."""

import brute
import numpy as np
import pyarrow as pa
import pytest

from lineagrid.llm.embeddings import unit
from lineagrid.llm.queries import oracle_sql

duckdb = pytest.importorskip("duckdb")


def answer(query, **tables):
    connection = duckdb.connect()
    for name, table in tables.items():
        connection.register(name, table)
    result = connection.sql(oracle_sql()[query])
    return [dict(zip(result.columns, row, strict=True)) for row in result.fetchall()]


def documents(rows):
    ids, texts = zip(*rows, strict=True)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})


@pytest.mark.parametrize("seed", [1, 5])
def test_repeated_strings(seed):
    rows = brute.odd_documents(seed) + [(500, "é" * 60), (501, "x" + "é" * 60), (502, "a" * 49), (503, "a" * 50), (504, "a" * 120)]
    got = answer("op2_repeated_strings", documents=documents(rows))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.repeats(rows)


def test_repeated_strings_of_repeated_and_null_ids():
    got = answer("op2_repeated_strings", documents=documents([(1, "q" * 80), (1, "q" * 80), (2, "q" * 80), (None, "q" * 80)]))
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 80)]


@pytest.mark.parametrize("seed", [1, 5])
def test_near_duplicates(seed):
    rows = brute.odd_documents(seed)
    got = answer("op4_hyperminhash_near_dups", documents=documents(rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near_duplicates(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_repeated_and_null_ids():
    got = answer("op4_hyperminhash_near_dups", documents=documents([(3, "a b c"), (3, "d e f"), (1, "A B  C"), (7, "d\te f"), (None, "a b c")]))
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, None, True), (1, 1, True), (3, 1, False), (3, 1, False), (7, 1, False)]


def test_near_vectors():
    dice = np.random.default_rng(6)
    v = (dice.normal(size=(30, 16))[dice.integers(0, 30, 240)] + 0.12 * dice.normal(size=(240, 16))).astype(np.float32)
    v[50] = v[10] * 3
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, v[0].tolist(), [float("inf")] * 16, [], [1.0, 2.0]]
    labels = [i % 2 for i in range(240)] + [None if i == 4 else 0 for i in range(8)]
    table = pa.table({"vec_id": list(range(248)), "embedding": pa.array([x.tolist() for x in v] + odd, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in answer("op5_small_world_near_dups", embeddings=table)}
    x = unit(v)
    near = (x @ x.T >= 0.93) & (np.arange(240)[:, None] % 2 == np.arange(240) % 2)
    np.fill_diagonal(near, False)
    found = brute.components(range(240), np.argwhere(near).tolist())
    assert near.sum() > 100
    assert got == {i: (int(near[i].sum()), found[i], found[i] == i) for i in range(240)} | {i: (0, i, True) for i in range(240, 248)}

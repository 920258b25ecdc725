"""Working memory of tasks over texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lineagrid.llm import near_dups, tokens, wordbytes
from lineagrid.llm.queries import vocabulary


class Kept:
    """Stands for a table: its map is the function itself."""

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function


def test_sketches_hold_little_beside_the_texts(spark):
    """Two-megabyte pieces took 80 MB of working arrays here, in each of an executor's workers."""
    dice = random.Random(1)
    words = ["".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(dice.choices(words, k=600)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    wordbytes._powers.clear()
    tracemalloc.start()
    made = sum(b.num_rows for b in near_dups.sketches(Kept(), 5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == len(texts) and peak < 48 << 20


def test_sets_in_parts_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(near_dups, "SMALL", 64)
    column = pa.array(["a b c d e f", None, "", "x" * 200, " ", "A b C d e f g h", "ä ö"])
    whole = wordbytes.shingle_sets(*wordbytes.column_bytes(column), 5)
    assert all(np.array_equal(a, b) for a, b in zip(near_dups.text_sets(column, 5), whole, strict=True))


def test_long_words_are_not_remembered():
    encoder = tokens.Encoder(vocabulary(), most=100)
    texts = ["x" * 3000 + str(k) for k in range(20)] + [f"{'ab' * 500}!" for _ in range(3)] + [" ".join(f"w{k}" for k in range(1000)), "", "a\nb"]
    assert encoder.encode(texts) == encoder.whole(texts)
    assert len(encoder.known) <= 300 and max(map(len, encoder.known)) <= 64

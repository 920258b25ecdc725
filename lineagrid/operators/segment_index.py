"""Pairs within a cutoff from an inverted index of segments, instead of all pairs of a group and length band.

A pair within the cutoff has distance <= cutoff * shorter + bonus * shared - multiplier * length difference = k at most.

* Equal lengths (Hamming): the positions that vary in a bucket are dealt into s > k segments. A pair agrees on s - k of them
  at least, so it shares the letters of one of all choices of s - k segments: each choice is a key.
* Different lengths (Levenshtein): the shorter one's letters between the group's common beginning and end are cut into k + 1
  segments. One is untouched, so the longer one holds it, shifted by t with |t| + |difference - t| <= k.

k grows with the mutations of a pair's poorer side, so a bucket has a level for each k, and a row takes part in the levels
that its own mutations reach. Where k is too large to be indexed, only pairs that share many mutations are left: those meet
by their rarest ones (a prefix filter). Where even no mutation is needed, every pair is near, and all are formed.

How segments are cut is planned for each bucket from the letters' counts over all its rows, so that index rows and expected
candidates together are fewest. Everything is an equi-join on (bucket, level, choice, letters).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance
from ..functions.distance import reach
from ..storage import staged
from .pair_blocks import edges_in_blocks

#: Keys that a row may have in one level of a bucket of equal lengths.
MOST_KEYS = 256
NO_END = 1 << 30
PLAN = "grp array<string>, shorter int, more int, kind string, k int, m_from int, m_until int, need int, starts array<array<int>>, first int, last int"


def dealt_positions(chances: list[tuple[int, float]], segments: int) -> list[tuple[list[int], float]]:
    """Positions dealt into segments of about equal chance that two rows agree: (positions, chance)."""
    out: list[tuple[list[int], float]] = [([], 1.0) for _ in range(segments)]
    for at, chance in sorted(chances, key=lambda x: (x[1], x[0])):
        k = max(range(segments), key=lambda s: (out[s][1], -s))
        out[k] = (out[k][0] + [at], out[k][1] * chance)
    return out


def hamming_keys(chances: list[tuple[int, float]], k: int, rows: int) -> list[list[int]]:
    """The position sets of which a pair of at most k differences agrees on one at least; k is below the positions' number."""
    best, best_cost = None, math.inf
    for s in range(k + 1, len(chances) + 1):
        keys = math.comb(s, k)
        if keys > MOST_KEYS and best is not None:
            break
        segments = dealt_positions(chances, s)
        agree = [0.0] * (s - k + 1)  # sums of products of s - k chances
        agree[0] = 1.0
        for _, chance in segments:
            for r in range(s - k, 0, -1):
                agree[r] += agree[r - 1] * chance
        cost = rows * keys + rows * rows / 2 * agree[s - k]
        if cost < best_cost:
            best, best_cost = segments, cost
    return [sorted(p for part in choice for p in part[0]) for choice in combinations(best, len(best) - k)]


def common_beginning(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def levels(shorter: int, more: int, rows: int, poorer: int, chances: list[tuple[int, float]], head: int, tail: int, cutoff: float, bonus: float, multiplier: float) -> Iterator[tuple]:
    """kind, k, m_from, m_until, need, starts, first, last: how the pairs of two lengths of a group meet.

    poorer: the most mutations that both sides can have. chances: for each position (from 1), that two rows agree there.
    """
    varying = [(at, chance) for at, chance in chances if chance < 1.0 - 1e-12]
    if not more and not varying:
        return  # a single sequence
    room = shorter - head - tail  # letters of the shorter one between what all have in common
    top = (len(varying) if not more else room) - 1  # the largest k that the index can take
    at = 0
    while at <= poorer:
        k = reach(shorter, more, at, cutoff, bonus, multiplier)
        if k >= max(top, 0) and k > top:
            break
        until = at + 1
        while until <= poorer and reach(shorter, more, until, cutoff, bonus, multiplier) == k:
            until += 1
        if k >= max(more, 0):
            yield from indexed(k, at, until if until <= poorer else NO_END, shorter, more, rows, varying, head, room)
        at = until
    if at > poorer:
        return
    if top >= more and top >= 0:
        yield from indexed(top, at, NO_END, shorter, more, rows, varying, head, room)
    least = max(top + 1, more)  # the distance of pairs that the index does not find
    need = math.ceil((least + multiplier * more - cutoff * shorter) / bonus - 1e-6) if bonus > 0 else 0
    yield ("mutations", 0, at, NO_END, need, [], 0, 0) if need > 0 else ("all", 0, at, NO_END, 0, [], 0, 0)


def indexed(k: int, at: int, until: int, shorter: int, more: int, rows: int, varying: list, head: int, room: int) -> Iterator[tuple]:
    if not more:
        yield "choices", k, at, until, 0, hamming_keys(varying, k, rows), 0, 0
    else:
        cuts = [head + room * i // (k + 1) for i in range(k + 2)]
        yield "segments", k, at, until, 0, [[a + 1, b - a] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], -((k - more) // 2), (k + more) // 2


def index_plan(texts: DataFrame, cutoff: float, bonus: float, multiplier: float, one_length: bool = False) -> DataFrame:
    """A row for each group, two lengths and level; some rows for each bucket, whatever the bucket's size."""
    letters = texts.select("grp", "n", F.posexplode(F.split("cdr3", "")).alias("at", "letter")).where("letter <> ''")
    counts = letters.groupBy("grp", "n", "at", "letter").agg(F.count("*").cast("double").alias("c"))
    chance = counts.groupBy("grp", "n", "at").agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("chance"))
    chances = chance.groupBy("grp", "n").agg(F.collect_list(F.struct(F.col("at") + 1, "chance")).alias("chances"))
    ends = texts.groupBy("grp").agg(F.min("cdr3").alias("low"), F.max("cdr3").alias("high"), F.min(F.reverse("cdr3")).alias("low_end"), F.max(F.reverse("cdr3")).alias("high_end"), F.min("n").alias("least_n"))
    sizes = texts.groupBy("grp", "n").agg(F.count("*").alias("rows"), F.max("m").alias("most"))
    own = staged(sizes.join(chances, ["grp", "n"]).join(ends, "grp"), "buckets")
    other = own.select("grp", F.col("n").alias("n_b"), F.col("most").alias("most_b"))
    widest = F.lit(0) if one_length else (F.lit(float(cutoff)) * F.col("n") + F.lit(max(0.0, float(bonus))) * F.least("most", "most_b")) / F.lit(1.0 + float(multiplier)) + 1e-6
    met = own.join(other, "grp").where((F.col("n_b") >= F.col("n")) & (F.col("n_b") - F.col("n") <= widest))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                head = min(common_beginning(r["low"], r["high"]), r["least_n"])
                tail = min(common_beginning(r["low_end"], r["high_end"]), r["least_n"] - head)
                chances = [tuple(x.values()) for x in r["chances"]]
                for told in levels(r["n"], r["n_b"] - r["n"], r["rows"], min(r["most"], r["most_b"]), chances, head, tail, cutoff, bonus, multiplier):
                    out.append((r["grp"], r["n"], r["n_b"] - r["n"], *told))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, KINDS.values(), strict=True)], names=list(KINDS))

    return met.mapInArrow(plan, PLAN)


KINDS = {"grp": pa.list_(pa.string()), "shorter": pa.int32(), "more": pa.int32(), "kind": pa.string(), "k": pa.int32(), "m_from": pa.int32(), "m_until": pa.int32(), "need": pa.int32(), "starts": pa.list_(pa.list_(pa.int32())), "first": pa.int32(), "last": pa.int32()}
BUCKET = ["grp", "shorter", "more", "kind", "m_from"]


def letters_at(text: Column, places: Column) -> Column:
    return F.array_join(F.transform(places, lambda p: F.substr(text, p, F.lit(1))), "")


def rare_first(kinds: DataFrame) -> DataFrame:
    """grp, cdr3, muts of each kind with its mutations ordered from the rarest on."""
    each = kinds.select("grp", "cdr3", "id", F.explode("muts").alias("mutation"))
    often = each.groupBy("mutation").agg(F.count("*").alias("often"))
    ranked = each.join(often, "mutation").groupBy("grp", "cdr3", "id").agg(F.sort_array(F.collect_list(F.struct("often", "mutation"))).alias("_r"))
    return ranked.select("grp", "cdr3", F.col("_r.mutation").alias("muts"))


def candidate_texts(kinds: DataFrame, cutoff: float, bonus: float, multiplier: float, one_length: bool = False) -> tuple[DataFrame, DataFrame]:
    """All candidates, repeats included, and the pairs (grp, cdr3_a, cdr3_b) of different CDR3s that pass their level's bound.

    Every pair of kinds with different CDR3s within the cutoff is among them. cdr3_a is not longer than cdr3_b.
    """
    texts = kinds.where("cdr3 <> ''").groupBy("grp", "cdr3").agg(F.max(F.size("muts")).alias("m")).withColumn("n", F.length("cdr3"))
    texts = staged(texts, "texts")
    plan = staged(index_plan(texts, cutoff, bonus, multiplier, one_length), "index-plan")
    level = ["kind", "k", "m_from", "m_until", "need", "shorter", "more", "starts", "first", "last"]
    joined = lambda rows, n: rows.join(plan.select(F.col("grp").alias("_grp"), *level), (F.col("grp") == F.col("_grp")) & (F.col("n") == n) & (F.col("m") >= F.col("m_from"))).drop("_grp")
    short, long = joined(texts, F.col("shorter")), joined(texts, F.col("shorter") + F.col("more"))
    text, at = F.col("cdr3"), F.col("place")
    own = [*BUCKET, "k", "m_until", "m", "cdr3"]

    choices = short.where("kind = 'choices'").select(*own, F.posexplode("starts").alias("number", "place")).select(*own, "number", letters_at(text, at).alias("letters"))
    pieces = short.where("kind = 'segments'").select(*own, F.posexplode("starts").alias("number", "place")).select(*own, "number", F.substr(text, at[0], at[1]).alias("letters"))
    shifts = long.where("kind = 'segments'").select(*own, "first", "last", F.posexplode("starts").alias("number", "place"))
    shifted = shifts.select(*own, "number", "place", F.explode(F.sequence("first", "last")).alias("shift")).withColumn("from", at[0] + F.col("shift"))
    held = shifted.where((F.col("from") >= 1) & (F.col("from") + at[1] - 1 <= F.length("cdr3"))).select(*own, "number", F.substr(text, F.col("from"), at[1]).alias("letters"))
    every = lambda rows: rows.where("kind = 'all'").select(*own, F.lit(0).alias("number"), F.lit("").alias("letters"))

    def rarest(rows: DataFrame) -> DataFrame:
        wanted = rows.where("kind = 'mutations'").select(*own, "need", F.col("grp").alias("_grp"), F.col("cdr3").alias("_cdr3")).drop("grp", "cdr3")
        kept = rare_first(kinds).join(wanted, (F.col("grp") == F.col("_grp")) & (F.col("cdr3") == F.col("_cdr3"))).where(F.size("muts") >= F.greatest("need", "m_from"))
        prefix = F.slice("muts", 1, F.greatest(F.size("muts") - F.col("need") + 1, F.lit(0)))
        return kept.select(*own, F.lit(0).alias("number"), F.explode(prefix).alias("letters")).distinct()

    key = [*BUCKET, "number", "letters"]
    by_mutations = not plan.where("kind = 'mutations'").isEmpty()
    left = choices.unionByName(pieces).unionByName(every(short))
    right = choices.unionByName(held).unionByName(every(long))
    if by_mutations:
        left, right = left.unionByName(rarest(short)), right.unionByName(rarest(long))
    a = left.select(*key, "k", "m_until", F.col("m").alias("m_a"), F.col("cdr3").alias("cdr3_a"))
    b = right.select(*key, F.col("m").alias("m_b"), F.col("cdr3").alias("cdr3_b"))
    met = a.join(b, key).where(((F.col("more") > 0) | (F.col("cdr3_a") < F.col("cdr3_b"))) & (F.least("m_a", "m_b") < F.col("m_until")))
    near = (~F.col("kind").isin("choices", "segments")) | (F.expr("levenshtein(cdr3_a, cdr3_b, k)") >= 0)
    return met, met.where(near).select("grp", "cdr3_a", "cdr3_b").distinct()


def near_edges(kinds: DataFrame, cutoff: float, bonus: float, multiplier: float, spanning: bool = False, one_length: bool = False) -> DataFrame:
    """id_a, id_b, score of the pairs of kinds (id, grp, v, j, cdr3, muts) within the cutoff, once each.

    spanning leaves out pairs of one group, genes and CDR3 that a star of the others joins: they score the least whatever
    they share, so components stay the same and a frequent sequence costs no square. one_length leaves out pairs of different
    lengths, which the default mode never links. Rows without CDR3 have no edges. Pairs are compared in blocks and not by the
    index: within such a cutoff an index of a large group moves more than the group itself, again and again.
    """
    none = kinds.sparkSession.createDataFrame([], "id_a string, id_b string, score double")
    if cutoff < distance.LEAST_SCORE:
        return none
    rows = kinds.where("cdr3 <> ''").select("id", "grp", "v", "j", "cdr3", "muts")
    star = spanning and bonus >= 0
    edges = edges_in_blocks(rows, cutoff, bonus, multiplier, star, one_length)
    if star:
        edges = edges.unionByName(rays(rows).withColumn("score", F.lit(distance.LEAST_SCORE)))
    return edges


def rays(rows: DataFrame) -> DataFrame:
    """id_a, id_b: each row of one group, genes and CDR3 with the least one."""
    essence = ["grp", "v", "j", "cdr3"]
    centers = rows.groupBy(*essence).agg(F.min("id").alias("center")).withColumnsRenamed({x: f"_{x}" for x in essence})
    match = F.lit(True)
    for x in essence:
        match &= F.col(x).eqNullSafe(F.col(f"_{x}"))
    return rows.join(centers, match).where("id <> center").select(F.col("center").alias("id_a"), F.col("id").alias("id_b"))

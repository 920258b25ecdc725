"""Sequences and mutation sets as 64-bit words, so that pairs are compared by a few instructions of generated code.

A CDR3's letters are bytes, eight to a word: differing bytes are folded into their lowest bit and counted. A group's
mutations have numbers, the commonest first; the first ones are bits of a fixed number of words, and the few rows with
rarer ones keep those as a list beside. Both give the numbers that the plain column functions give.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from . import distance

#: Words for letters at most (longer sequences are compared letter by letter), and words for a group's mutations.
MOST_LETTER_WORDS, MUTATION_WORDS = 16, 4
LOWEST_BITS = 0x0101010101010101


def letter_words(text: Column, words: int) -> Column:
    """The bytes of an ASCII text of at most 8 * words letters; null for another."""
    word = [F.coalesce(F.conv(F.hex(F.substring(text, 8 * k + 1, 8)), 16, 10).cast("long"), F.lit(0).cast("long")) for k in range(words)]
    return F.when((F.octet_length(text) == F.length(text)) & (F.length(text) <= 8 * words), F.array(*word))


def differing_letters(a: Column, b: Column, words: int) -> Column:
    """Differing bytes of two texts of one length, from their words."""

    def count(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(LOWEST_BITS)))

    return reduce(lambda x, y: x + y, [count(k) for k in range(words)])


def common_bits(a: Column, b: Column, words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(k)).bitwiseAND(F.get(b, F.lit(k)))) for k in range(words)])


@dataclass(frozen=True)
class Words:
    """Rows with `letters`, `bits` and `rest`, how many words those are, and whether each tells all that there is."""

    rows: DataFrame
    letters: int
    mutations: int
    all_letters: bool
    all_mutations: bool

    def distance(self) -> Column:
        """Hamming distance of the sides a and b for equal lengths, else Levenshtein.

        Functions of arrays stay out where no row needs them: they would keep the whole join from being compiled.
        """
        fast = differing_letters(F.col("letters_a"), F.col("letters_b"), self.letters)
        one_length = F.length("cdr3_a") == F.length("cdr3_b")
        if self.all_letters:
            return F.when(one_length, fast).otherwise(F.levenshtein("cdr3_a", "cdr3_b"))
        both = F.col("letters_a").isNotNull() & F.col("letters_b").isNotNull()
        return F.when(one_length & both, fast).otherwise(distance.edit_distance(F.col("cdr3_a"), F.col("cdr3_b")))

    def shared(self) -> Column:
        """Distinct mutations that the sides a and b share."""
        common = common_bits(F.col("bits_a"), F.col("bits_b"), self.mutations)
        if self.all_mutations:
            return common
        rare = (F.size("rest_a") > 0) & (F.size("rest_b") > 0)
        return common + F.when(rare, distance.shared_mutations(F.col("rest_a"), F.col("rest_b"))).otherwise(0)


def with_words(rows: DataFrame, words: int = MUTATION_WORDS) -> Words:
    """rows (grp, cdr3, muts ...) as words. A group's dictionary holds its 64 * words commonest mutations, the rest is `rest`."""
    longest = rows.agg(F.max(F.length("cdr3"))).first()[0] or 0
    letters = max(1, min(MOST_LETTER_WORDS, -(-longest // 8)))
    often = rows.select("grp", F.explode("muts").alias("mutation")).groupBy("grp", "mutation").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "mutation"))
    numbered = often.withColumn("place", place).where(F.col("place") <= 64 * words)
    listed = numbered.groupBy(F.col("grp").alias("_grp")).agg(F.sort_array(F.collect_list(F.struct("place", "mutation"))).alias("_m"))
    joined = rows.join(listed.select("_grp", F.col("_m.mutation").alias("_known")), F.col("grp").eqNullSafe(F.col("_grp")), "left")
    known = F.coalesce("_known", F.array().cast("array<string>"))
    at = F.transform(F.array_distinct("muts"), lambda m: F.array_position(known, m).cast("int") - 1)
    one = F.lit(1).cast("long")

    def word(k: int) -> Column:
        inside = F.filter("_at", lambda p: (p >= 64 * k) & (p < 64 * k + 64))
        return F.aggregate(inside, F.lit(0).cast("long"), lambda x, p: x.bitwiseOR(F.call_function("shiftleft", one, p % 64)))

    told = joined.withColumn("_at", at).select(*rows.columns, letter_words(F.col("cdr3"), letters).alias("letters"), F.array(*[word(k) for k in range(words)]).alias("bits"), F.array_except("muts", known).alias("rest"))
    told = staged(told, "words")
    odd = told.agg(F.max(F.col("letters").isNull() & F.col("cdr3").isNotNull()).alias("letters"), F.max(F.size("rest") > 0).alias("rest")).first()
    return Words(told, letters, words, not odd["letters"], not odd["rest"])

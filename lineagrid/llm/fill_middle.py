"""Fill-in-the-middle: texts are cut into units, and two cuts make a prefix, a middle and a suffix in another order.

A unit grammar says where units end; it is translated to a zero-width regex that looks at the two code points on either
side of a place, so that Spark's own split keeps every piece whole. All is DataFrame functions; nothing but the
documents themselves is read, and no rows move.

Empty texts have no units and stay as they are; so do null texts, which count as empty, and texts that hold one of the
marks, since they could not be told apart again. Very long texts are one array of pieces in their own row. The draws
depend on the seed and the doc_id alone, so repeated rows give the same; a null doc_id draws as an empty one. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need

ANY = r"[\s\S]"


@dataclass(frozen=True)
class Units:
    """A grammar of units that tile any text.

    pattern matches one unit. edges are pairs of character classes: a unit ends wherever a code point of the first stands
    before one of the second.
    """

    pattern: str
    edges: tuple[tuple[str, str], ...]

    @property
    def boundary(self) -> str:
        """The regex that matches the empty places between units."""
        return "|".join(f"(?<={before})(?={after})" for before, after in self.edges)

    @classmethod
    def ended_by(cls, members: str) -> Units:
        """Each unit runs to the next code point of the class, that one included: lines, sentences."""
        return cls(f"[^{members}]*[{members}]|[^{members}]+", ((f"[{members}]", ANY),))

    @classmethod
    def runs_of(cls, members: str) -> Units:
        """Runs inside the class and runs outside take turns: words and what stands between them."""
        return cls(f"[{members}]+|[^{members}]+", ((f"[{members}]", f"[^{members}]"), (f"[^{members}]", f"[{members}]")))

    @classmethod
    def closed_by(cls, members: str) -> Units:
        """A run outside the class and the run of the class behind it: words with the blanks that follow."""
        return cls(f"[^{members}]+[{members}]*|[{members}]+", ((f"[{members}]", f"[^{members}]"),))

    @classmethod
    def led_by(cls, members: str) -> Units:
        """A run of the class and the run outside it that follows: words with the blanks before them."""
        return cls(f"[{members}]*[^{members}]+|[{members}]+", ((f"[^{members}]", f"[{members}]"),))

    @classmethod
    def each(cls) -> Units:
        """Every code point."""
        return cls(ANY, ((ANY, ANY),))


LINES = Units.ended_by(r"\n")
UNITS = {"lines": LINES, "words": Units.led_by(r"\x20\x09-\x0D"), "sentences": Units.closed_by(r".!?\n\x20"), "code_points": Units.each()}


@dataclass(frozen=True)
class Marks:
    """What stands before each part. No mark may hold another, nor end as one begins."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        others = [(a, b) for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j]
        if "" in marks or any(b in a for a, b in others) or any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b))):
            raise ValueError("marks must not be empty, hold each other, or end as one begins")


def pieces(text: Column, units: Units) -> Column:
    """The units of a text as an array; none for an empty or null text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(text, units.boundary, -1))


def draws(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex SHA-256 of `seed:doc_id`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def joined(array: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(array, start, count), "")


def fill_in_middle(docs: DataFrame, units: Units = LINES, seed: int = 7, rate: int = 100, suffix_first: int = 50, marks: Marks | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document.

    rate is how many of a hundred documents are reordered, suffix_first how many of a hundred of those have the suffix in
    front (form spm, else psm). The others keep their text (form plain, no lengths).
    """
    need(docs, "doc_id", "text")
    m = marks or Marks()
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = cut.select("doc_id", "text", pieces(F.col("text"), units).alias("units"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    n = F.size("units").cast("long")
    drawn = cut.withColumns({"n": n, "first": F.least(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int"), "second": F.greatest(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int")})
    marked = F.col("text").contains(m.prefix) | F.col("text").contains(m.suffix) | F.col("text").contains(m.middle)
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= rate)
    parts = {
        "form": F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"),
        "prefix": joined(F.col("units"), F.lit(1), F.col("first")),
        "middle": joined(F.col("units"), F.col("first") + 1, F.col("second") - F.col("first")),
        "suffix": joined(F.col("units"), F.col("second") + 1, F.size("units") - F.col("second")),
    }
    told = drawn.withColumns(parts)
    psm = F.concat(F.lit(m.prefix), "prefix", F.lit(m.suffix), "suffix", F.lit(m.middle), "middle")
    spm = F.concat(F.lit(m.suffix), "suffix", F.lit(m.prefix), "prefix", F.lit(m.middle), "middle")
    moved = F.col("form") != "plain"
    return told.select(
        "doc_id",
        "n",
        "form",
        F.when(moved, F.length("prefix").cast("long")).alias("prefix_chars"),
        F.when(moved, F.length("middle").cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column, marks: Marks | None = None) -> Column:
    """The text before fill_in_middle, from its output and form alone; null for an unknown form."""
    m = marks or Marks()

    def between(opening: str, closing: str | None) -> Column:
        start = F.locate(opening, output) + len(opening)
        return F.substr(output, start, F.locate(closing, output) - start) if closing else F.substr(output, start)

    psm = F.concat(between(m.prefix, m.suffix), between(m.middle, None), between(m.suffix, m.middle))
    spm = F.concat(between(m.prefix, m.middle), between(m.middle, None), between(m.suffix, m.prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)

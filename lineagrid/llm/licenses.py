"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram hash of every document is joined to the positions at which the templates hold it; the words of
a hit are compared, so the hash decides nothing. A hit of document position i on template position t votes for the
diagonal i - t, on which a verbatim copy of the template puts all its votes; an inserted or lost word moves the votes to a
neighbouring diagonal. Neighbouring diagonals are merged in two staggered rows of tiles, each two shifts wide, so that all
diagonals of a copy that is shifted by at most one shift (a quarter of the template's words, more than `slack`) stand in
one tile, whatever stands around the copy. A tile's span is verified by the share of the template's voting positions it
holds word for word; at least `least_share` gives the template's label. The better of two overlapping tiles need not be
told apart: both spans are returned. A phrase is a template that must stand verbatim: one diagonal with all its positions.

Templates are a table (label, text, phrase); without one those below. It is broadcast while it has at most
`broadcast_positions` positions of k-grams, else joined by a shuffle. Templates of fewer than k words never vote.

Null and empty texts have no words and no labels; a text of any length is one row and is scanned whole. Rows equal in
doc_id and text are scanned as one (their votes are added before any shuffle) and returned as often as they came; a null
doc_id is an id like any other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need

#: Phrases, and paragraphs of well-known licenses in the words of the scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "boost"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Words so common that a k-gram of nothing else does not vote in a long template.
COMMON = frozenset("a and any are for in is it of or that the this to under use with you".split())
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a broadcast template table; a row is a k-gram's words and some numbers, about 200 bytes.
BROADCAST_POSITIONS = 100_000
#: Copies of one row that one task writes.
COPIES = 4096


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, t, True) for t, x in PHRASES] + [(x, t, False) for t, x in TEMPLATES], "label string, text string, phrase boolean")


def word_array(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_BREAK, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def grams(k: int, with_words: bool = True) -> Column:
    """gram (a hash) and said (the words), or the hash alone, of each k words of the column `_said`, in order."""

    def one(i: Column) -> Column:
        words = [F.get("_said", i + j) for j in range(k)]
        return F.struct(F.xxhash64(*words).alias("gram"), F.concat_ws(" ", *words).alias("said")) if with_words else F.xxhash64(*words)

    return F.when(F.size("_said") >= k, F.transform(F.sequence(F.lit(0), F.size("_said") - k), one))


def template_positions(templates: DataFrame, k: int, common: frozenset[str]) -> DataFrame:
    """gram and spots (tpl, label, phrase, words, voting, t, said) of every voting position."""
    common_words = F.array(*[F.lit(w) for w in sorted(common)]).cast("array<string>")
    phrase = F.coalesce("phrase", F.lit(False)) if "phrase" in templates.columns else F.lit(False)
    told = templates.select("label", phrase.alias("phrase"), word_array(F.col("text")).alias("_said")).where("label is not null").distinct()
    places = told.select(F.xxhash64("label", "phrase", "_said").alias("tpl"), "label", "phrase", F.size("_said").alias("words"), F.transform(grams(k), lambda g, t: F.struct(t.alias("t"), g["gram"].alias("gram"), g["said"].alias("said"))).alias("at"))
    votes = F.filter("at", lambda p: F.col("phrase") | (F.size(F.array_except(F.split(p["said"], " "), common_words)) > 0))
    places = places.select("tpl", "label", "phrase", "words", F.size(votes).alias("voting"), F.explode(votes).alias("p"))
    return places.groupBy("p.gram").agg(F.collect_list(F.struct("tpl", "label", "phrase", "words", "voting", F.col("p.t").alias("t"), F.col("p.said").alias("said"))).alias("spots"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, k: int = 2, slack: int = 3, least_share: float = 0.6, common: frozenset[str] = COMMON, broadcast_positions: int = BROADCAST_POSITIONS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (of words) of what is found."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates
    need(templates, "label", "text")
    spots = template_positions(templates, k, common)
    small = spots.agg(F.coalesce(F.sum(F.size("spots")), F.lit(0))).first()[0] <= broadcast_positions

    words = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_text"), word_array(F.col("text")).alias("_said"))
    words = words.select("doc_id", "_text", F.size("_said").cast("long").alias("n_words"), "_said", grams(k, with_words=not small).alias("_grams"))
    if small:  # the words of a hit are looked up where it is found, in the same pass over the row
        rolled = words.select("doc_id", "_text", "n_words", "_said", F.posexplode_outer("_grams").alias("i", "gram"))
        at = rolled.join(F.broadcast(spots), "gram", "left").withColumn("said", F.concat_ws(" ", *[F.get("_said", F.col("i") + j) for j in range(k)]))
    else:  # they travel with the hash
        rolled = words.select("doc_id", "_text", "n_words", F.posexplode_outer("_grams").alias("i", "g"))
        at = rolled.select("doc_id", "_text", "n_words", "i", F.col("g.gram").alias("gram"), F.col("g.said").alias("said")).join(spots, "gram", "left")
    # besides the hits each row keeps its first position, so that rows without a hit are counted too
    first = F.coalesce("i", F.lit(0)) == 0
    hits = at.where(F.col("spots").isNotNull() | first).select("doc_id", "_text", "n_words", "i", "said", first.alias("first"), F.posexplode_outer("spots").alias("nth", "spot"))
    hits = hits.withColumn("spot", F.when(F.col("spot.said") == F.col("said"), F.col("spot")))
    hits = hits.select("doc_id", "_text", "n_words", "i", "spot.*", (F.col("first") & (F.coalesce("nth", F.lit(0)) == 0)).cast("long").alias("copy"))

    doc, told = ["doc_id", "_text"], ["label", "phrase", "words", "voting"]
    same = [F.max("n_words").alias("n_words"), *[F.first(c).alias(c) for c in told]]
    diagonals = hits.groupBy(*doc, "tpl", (F.col("i") - F.col("t")).alias("diagonal"))
    diagonals = diagonals.agg(F.sum("copy").alias("copies"), *same, F.collect_set("t").alias("held"), F.min("i").alias("low"), F.max("i").alias("high"))
    # a phrase's diagonals stay apart
    shift = F.greatest(F.lit(slack + 1), F.floor(F.col("words") / 4))
    tile = lambda stagger: F.struct(F.lit(stagger).alias("stagger"), F.floor((F.col("diagonal") + stagger * shift) / (2 * shift)).alias("tile"))
    alone = F.array(F.struct(F.lit(0).alias("stagger"), F.col("diagonal").cast("long").alias("tile")))
    tiles = diagonals.withColumn("at", F.explode(F.when(F.col("phrase") | F.col("phrase").isNull(), alone).otherwise(F.array(tile(0), tile(1)))))
    tiles = tiles.withColumn("copies", F.when(F.col("at.stagger") == 0, F.col("copies")).otherwise(0)).groupBy(*doc, "tpl", "at")
    regions = tiles.agg(F.sum("copies").alias("copies"), *same, F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held"), F.min("low").alias("low"), (F.max("high") + k).alias("high"), F.min("diagonal").alias("diagonal"))
    regions = regions.withColumn("share", F.coalesce(F.col("held") / F.col("voting"), F.lit(0.0)))
    place = F.coalesce(F.col("phrase") & (F.col("held") == F.col("voting")), F.lit(False))
    region = F.coalesce(~F.col("phrase") & (F.col("share") >= least_share), F.lit(False))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    result = regions.groupBy(*doc).agg(
        F.max("n_words").alias("n_words"),
        F.sum("copies").alias("_copies"),
        F.count_if(place).alias("n_base"),
        F.min(F.when(place, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.when(place, F.col("label"))).alias("base_labels"),
        joined(F.when(place | region, F.col("label"))).alias("labels"),
        F.max(F.when(place, 1.0).when(F.col("phrase"), 0.0).otherwise(F.col("share"))).alias("score"),
        F.array_sort(F.collect_set(F.when(place | region, F.struct(F.col("low").alias("start"), F.col("high").alias("end"), "label")))).alias("spans"),
    )
    # a row that came very often is written by many tasks
    chunks = result.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES).cast("int"))).alias("_chunk"))
    dealt = chunks.repartition(*doc, "_chunk").select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("_copies") - F.col("_chunk") * COPIES).cast("int"))).alias("_copy"))
    return dealt.drop("_text", "_copies", "_chunk", "_copy")


def oracle_sql(k: int = 2, slack: int = 3, least_share: float = 0.6) -> str:
    """The digest's columns by DuckDB, from the default templates' plain words instead of hashes."""
    values = ",\n".join(f"('{label}', {str(phrase).lower()}, '{text}')" for texts, phrase in ((PHRASES, True), (TEMPLATES, False)) for text, label in texts)
    common = ", ".join(f"'{w}'" for w in sorted(COMMON))
    said = "array_to_string(list_slice({0}, {1} + 1, {1} + " + str(k) + "), ' ')"
    return rf"""
WITH texts(label, phrase, text) AS (VALUES
{values}),
split AS (SELECT row_number() OVER () AS tpl, label, phrase, string_split(text, ' ') AS w FROM texts),
placed AS (SELECT tpl, label, phrase, len(w) AS words, w, unnest(range(0, len(w) - {k} + 1)) AS t FROM split),
voters AS (SELECT tpl, label, phrase, words, t, {said.format("w", "t")} AS gram FROM placed WHERE phrase OR len(list_filter(list_slice(w, t + 1, t + {k}), lambda x: x NOT IN ({common}))) > 0),
templates AS (SELECT *, count(*) OVER (PARTITION BY tpl) AS voting FROM voters),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spread AS (SELECT doc_id, w, unnest(range(0, len(w) - {k} + 1)) AS i FROM docs WHERE len(w) >= {k}),
grams AS (SELECT doc_id, i, {said.format("w", "i")} AS gram FROM spread),
hits AS (SELECT doc_id, tpl, label, phrase, words, voting, i, t, i - t AS diagonal, greatest({slack + 1}, floor(words / 4)) AS shift FROM grams JOIN templates USING (gram)),
tiled AS (SELECT *, 0 AS stagger, CASE WHEN phrase THEN diagonal ELSE floor(diagonal / (2 * shift)) END AS tile FROM hits
          UNION ALL SELECT *, 1, floor((diagonal + shift) / (2 * shift)) FROM hits WHERE NOT phrase),
regions AS (SELECT doc_id, tpl, any_value(label) AS label, any_value(phrase) AS phrase, any_value(voting) AS voting, count(DISTINCT t) AS held, min(diagonal) AS diagonal
            FROM tiled GROUP BY doc_id, tpl, stagger, tile),
judged AS (SELECT *, phrase AND held = voting AS place, held::DOUBLE / voting AS share FROM regions),
found AS (SELECT doc_id, count(*) FILTER (WHERE place) AS n_base, min(diagonal) FILTER (WHERE place) AS first_word, max(diagonal) FILTER (WHERE place) AS last_word,
          string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place) AS base_labels,
          string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place OR (NOT phrase AND share >= {least_share})) AS labels,
          max(CASE WHEN place THEN 1 WHEN phrase THEN 0 ELSE share END) AS score FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(f.n_base, 0) AS n_base, f.first_word, f.last_word, coalesce(f.base_labels, '') AS base_labels, coalesce(f.labels, '') AS labels,
       coalesce(f.score, 0)::DOUBLE AS score
FROM docs d LEFT JOIN found f USING (doc_id)
""".strip()

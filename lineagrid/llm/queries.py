"""The registered queries of this subpackage: thin digests of what its operators return, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_ids, encode_texts
from .common import fresh_path, staged
from .decontamination import contaminated, scan_documents
from .embeddings import near_vectors
from .fill_middle import fill_in_middle, restored
from .html_text import extract_text
from .licenses import oracle_sql as license_sql
from .licenses import scan_licenses
from .lines import line_digest
from .near_dups import near_duplicates
from .packing import pack_documents
from .quality import quality_scores
from .repeats import digest, repeats
from .spelling import spelling_forms, word_counts
from .token_file import read_token_files, with_global_start, write_token_files


def vocabulary() -> str:
    """The public vocabulary that the contract names; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=50))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality_scores(table(spark, sf_dir, "documents"), labels, train_on=~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_hyperminhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


def op5_small_world_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=13), share=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(), end_id=1)
    read = staged(read_token_files(spark, path), "token-index")
    return with_global_start(read).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, suffix_first=50)
    exact = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), exact.alias("restored_sha256"))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_vocabulary())
    told = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return decode_ids(told, byte_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(table(spark, sf_dir, "documents"), every=97)
    return spelling_forms(counts, least_n=3, least_length=5, ratio=2).select("word", "form", "root", "n", "n_near", "form_n")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_repeated_strings": op2_repeated_strings,
        "op3_quality_discriminant": op3_quality_discriminant,
        "op4_hyperminhash_near_dups": op4_hyperminhash_near_dups,
        "op5_small_world_near_dups": op5_small_world_near_dups,
        "op6_decontamination": op6_decontamination,
        "op7_html_consensus": op7_html_consensus,
        "op8_license_diagonals": op8_license_diagonals,
        "op9_line_dedup": op9_line_dedup,
        "op10_token_files": op10_token_files,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_byte_pairs": op12_byte_pairs,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": pipeline,
    }


OP2 = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
spots AS (SELECT r, doc_id, x, unnest(generate_series(1, octet_length(x) - 49)) AS i FROM rows WHERE octet_length(x) >= 50),
windows AS (SELECT r, doc_id, i, x[i:i + 49] AS w FROM spots),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT a.r, a.i FROM windows a JOIN firsts f ON a.w = f.w WHERE f.least < a.doc_id),
steps AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, TRUE) AS opens FROM hits),
numbered AS (SELECT r, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS span FROM steps),
spans AS (SELECT r, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, span),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS since FROM spans),
kept AS (SELECT r, sum(c.b - c.a) AS n_removed, count(*) AS n_spans, max(c.b) AS last, string_agg(hex(x[c.since:c.a - 1]), '' ORDER BY c.a) AS k
         FROM cuts c JOIN rows USING (r) GROUP BY r)
SELECT doc_id, octet_length(x) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, '') || hex(x[coalesce(last, 1):]))) AS kept_sha256
FROM rows LEFT JOIN kept USING (r)
"""


OP4 = r"""
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM rows WHERE len(w) > 0),
shingles AS (SELECT DISTINCT r, list_slice(w, i, least(len(w), i + 4)) AS g FROM spots),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
near AS (SELECT p.doc_id AS a, q.doc_id AS b FROM common c JOIN sizes s ON c.a = s.r JOIN sizes t ON c.b = t.r JOIN rows p ON c.a = p.r JOIN rows q ON c.b = q.r
         WHERE 100 * c.n >= 85 * (s.n + t.n - c.n) AND p.doc_id <> q.doc_id),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(node, root) AS (SELECT doc_id, doc_id FROM rows WHERE doc_id IS NOT NULL
         UNION SELECT l.b, x.root FROM reach x JOIN links l ON x.node = l.a WHERE l.b > x.root),
found AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(s.n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, TRUE) AS kept
FROM rows LEFT JOIN sizes s USING (r) LEFT JOIN found ON doc_id = node
"""


OP5 = """
WITH RECURSIVE rows AS (SELECT vec_id, label, len(embedding) AS size, list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x)) AS e FROM embeddings),
squares AS (SELECT vec_id, label, size, e, list_dot_product(e, e) AS square FROM rows),
units AS (SELECT vec_id, label, size, list_transform(e, lambda x: x / sqrt(square)) AS u FROM squares WHERE label IS NOT NULL AND len(e) = size AND square > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.label = b.label AND a.size = b.size AND a.vec_id < b.vec_id
         WHERE list_dot_product(a.u, b.u) >= 0.93),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(node, root) AS (SELECT vec_id, vec_id FROM rows WHERE vec_id IS NOT NULL
         UNION SELECT l.b, x.root FROM reach x JOIN links l ON x.node = l.a WHERE l.b > x.root),
found AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, TRUE) AS kept
FROM rows LEFT JOIN counts ON vec_id = a LEFT JOIN found ON vec_id = node
"""


OP9 = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
keyed AS (SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= 10),
marked AS (SELECT k.doc_id, k.line, k.pos, o.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP6 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_at AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, list_slice(w, i, least(len(w), i + 12)) AS g FROM item_at),
sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
doc_at AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM doc_at d JOIN windows x ON list_slice(d.w, d.i, d.i + d.n - 1) = x.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.l, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


OP11 = r"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
drawn AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
          CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM rows),
cuts AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS x FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


OP13 = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT run, count(*) AS n, hex(encode(d || ':' || run)) AS x FROM runs GROUP BY d, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda k: CAST('0x' || x[2 * k + 1:2 * k + 2] AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM counted, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
cut AS (SELECT word, n, left(word, i) AS l, substr(word, i + 2) AS r FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words) s),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.l = b.l AND a.r = b.r WHERE a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON b.word = a.l || a.r
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.l || a.r),
best AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM near),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word AND b.place = 1),
reach(word, node) AS (SELECT word, word FROM forms UNION ALL SELECT r.word, f.form FROM reach r JOIN forms f ON r.node = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.node AS root, f.n, f.n_near, f.form_n FROM forms f JOIN reach r ON r.word = f.word JOIN forms e ON e.word = r.node AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_repeated_strings": OP2.strip(),
        "op4_hyperminhash_near_dups": OP4.strip(),
        "op5_small_world_near_dups": OP5.strip(),
        "op6_decontamination": OP6.strip(),
        "op8_license_diagonals": license_sql(),
        "op9_line_dedup": OP9.strip(),
        "op11_fill_in_middle": OP11.strip(),
        "op13_spelling_variants": OP13.strip(),
    }

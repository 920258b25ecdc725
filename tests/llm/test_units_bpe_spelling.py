"""Fill-in-the-middle, byte-pair encoding and spelling variants against plain versions."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_sql import answer
from test_sql import documents as as_table

from lineagrid.llm import bpe, fill_middle, queries, spelling
from lineagrid.llm.fill_middle import LINES, UNITS, Marks, fill_in_middle, pieces, restored

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ODD = ["\n", "\n\n\n", "a\n", "\na", "a\r\nb", "😀\n😀", "x <P> y\nz", "<S>", "q<M>\n\n", "<\n<P\n>S>\nM>", "<<P", "a b\tc d", "\x00\n\x00", "A. B! C?\n", "Ünïcode ñ\né", "z" * 3000 + "\n" + "y" * 3000, "l\n" * 5000]
ROWS = brute.odd_documents(3) + [(900 + k, t) for k, t in enumerate(ODD)]


def documents(spark, rows=ROWS):
    clash = ["'x' AS ids", "'y' AS form", "1L AS n", "2 AS output", "3 AS units", "4 AS h1", "5 AS word", "6 AS prefix", "7 AS `a.b`", "8 AS `Text `"]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", *clash)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut_and_moved(doc, text, pattern=LINES.pattern, rate=100, share=50):
    """A plain version of the contract."""
    text = text or ""
    units = [m[0] for m in re.finditer(pattern, text)]
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("kind", UNITS)
def test_boundaries_cut_as_the_grammar_matches(spark, kind):
    texts = [t for _, t in ROWS if t is not None and len(t) < 4000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", pieces(F.col("t"), UNITS[kind]).alias("u")).collect()}
    assert got == {t: [m[0] for m in re.finditer(UNITS[kind].pattern, t)] for t in texts}


@pytest.mark.parametrize("rate, share", [(100, 50), (60, 10), (0, 50)])
def test_fill_in_middle(spark, rate, share):
    rows = [*ROWS, (7, "one\ntwo\nthree"), (7, "one\ntwo\nthree"), (None, "a\nb\nc")]
    told = fill_in_middle(documents(spark, rows), rate=rate, suffix_first=share).withColumn("back", restored(F.col("output"), F.col("form")))
    got = Counter(tuple(r) for r in told.collect())
    assert got == Counter((i, *cut_and_moved(i, t, rate=rate, share=share), t or "") for i, t in rows)
    assert rate == 0 or {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(documents(spark, [])).count() == 0


def test_marks_that_could_be_misread():
    for bad in (("", "a", "b"), ("<P>", "x<P>", "m"), ("ab", "bc", "d"), ("aba", "c", "d"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            Marks(*bad)
    assert fill_middle.Marks("[p]", "[s]", "[m]").prefix == "[p]"


def test_fill_in_middle_sql(spark):
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in answer("op11_fill_in_middle", documents=as_table([r for r in ROWS if "\x00" not in (r[1] or "")]))}
    assert got == {i: (*cut_and_moved(i, t)[:4], sha(cut_and_moved(i, t)[4]), sha(t or "")) for i, t in ROWS if i in got} and len(got) >= len(ROWS) - 3


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(text):
    return memoryview(bpe.vocabulary(PATH).encode(text)).cast("i").tolist()


LETTERS = ["a", "b", "e", "th", "in", "'s", "'LL", " ", "  ", "\n", "\t", "\x1c", "\x85", "᠎", "0", "१", "²", "Ⅷ", "_", "__", "-", "é", "ß", "İ", "ſ", "日本", "😀", "՘", "\U00010940", "<|endoftext|>", "<|", "\x00"]


@given(st.lists(st.sampled_from(LETTERS), max_size=40).map("".join))
@settings(max_examples=600, deadline=None)
def test_encoding_equals_the_library(text):
    from tokenizers import Tokenizer

    library = test_encoding_equals_the_library.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoded(text) == ids
    assert bpe.vocabulary(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)


@given(st.lists(st.integers(-2, 50_300), max_size=8))
@settings(max_examples=500, deadline=None)
def test_decoding_equals_the_library(ids):
    from tokenizers import Tokenizer

    library = test_decoding_equals_the_library.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    assert bpe.vocabulary(PATH).decode(ids) == library.decode([i for i in ids if 0 <= i < 50_257], skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 40_000, " " * 60_000 + "b", "=-" * 30_000, "theinan" * 9000, "é" * 30_000])
def test_long_pieces_are_exact_and_linear(library, text):
    assert encoded(text) == library.encode(text, add_special_tokens=False).ids


def test_every_token_encodes_as_the_library_has_it(library):
    v = bpe.vocabulary(PATH)
    dice = random.Random(5)
    for _ in range(3000):  # two tokens side by side, compatible or not
        a, b = (v.bytes_of[dice.randrange(50_256)] for _ in range(2))
        text = (a + b).decode("utf-8", "replace")
        assert encoded(text) == library.encode(text, add_special_tokens=False).ids


def test_a_full_memory_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    text = " ".join(t or "" for _, t in ROWS if t and len(t) < 2000)
    assert encoded(text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_holds_no_automaton():
    light, whole = bpe.tokens(PATH), bpe.vocabulary(PATH)
    assert not {"automaton", "right_end", "left_end", "pieces", "exact"} & vars(light).keys()
    assert light.bytes_of == whole.bytes_of
    ids = [*range(-2, 300), 50_255, 50_256, 50_257, 1 << 30]
    assert light.decode(ids) == whole.decode(ids)


def test_byte_pairs_of_a_table(spark, library):
    rows = [*ROWS, (7, "one two"), (7, "one two"), (None, "x <|endoftext|>y")]
    coded = bpe.encode_texts(documents(spark, rows), PATH, output="ids")
    assert coded.columns == ["doc_id", "ids", "form", "n", "output", "units", "h1", "word", "prefix", "a.b", "Text "]
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in coded.collect())
    assert got == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    back = bpe.decode_ids(coded, PATH)
    assert Counter((r["doc_id"], r["text"], r["a.b"]) for r in back.collect()) == Counter((i, t or "", 7) for i, t in rows)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 64, 90_000, -4])], "k int, ids array<int>")
    assert {r["k"]: r["text"] for r in bpe.decode_ids(odd, PATH).collect()} == {1: "", 2: "", 3: "a"}
    assert bpe.encode_texts(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"truncation": {"max_length": 3}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"dropout": 0.1}}, {"model": {"merges": "backwards"}}])
def test_other_vocabularies_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        config = json.load(f)
    for k, v in change.items():
        config[k] = (config[k] or {}) | v if isinstance(v, dict) else v
    if config["model"]["merges"] == "backwards":
        config["model"]["merges"] = json.load(open(PATH, encoding="utf-8"))["model"]["merges"][::-1]
    path = tmp_path / "v.json"
    path.write_text(json.dumps(config))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(path))


def one_edit(a, b):
    """Exactly one edit, by trying all."""
    letters = set(a + b)
    tried = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in letters for k in (0, 1)}
    return a != b and b in tried


@given(st.lists(st.text("abé", max_size=6), max_size=40), st.text("abéx", max_size=6))
@settings(max_examples=300, deadline=None)
def test_trie_finds_all_words_one_edit_away(words, word):
    words = sorted(set(words))
    trie = spelling.Trie(words, [1] * len(words))
    for q in [word, *words[:10]]:
        assert sorted(trie.near(q)) == [k for k, w in enumerate(words) if one_edit(q, w)]
        assert [k for k, w in enumerate(words) if spelling.one_edit(q, w)] == sorted(trie.near(q))


def variants(rows, least_n=3, least_length=5):
    """A plain version of the contract."""
    counts = Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in words}
    best = {w: min(x, key=lambda o: (-words[o], o)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items()}


def misspelt(seed=4):
    dice = random.Random(seed)
    words = ["Lineage", "straße", "ñandúes", "ÉCLAIR", "àéîõü", "colour", "color", "colours", "x" * 300]
    def slip(w):
        at, c = dice.randrange(len(w)), dice.choice("abcéÿ×÷")
        return dice.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w.upper()])
    text = lambda: " ".join(slip(slip(dice.choice(words))) for _ in range(60))
    return [(i, text()) for i in range(60)] + [(5, "Lineage lineage colour"), (5, "Lineage lineage colour"), (None, "lineage colours"), (70, None), (71, ""), (72, "123 _ 日本"), (73, "lineagé " * 4000)]


@pytest.mark.parametrize("shard, at_once", [(32_768, 8), (7, 2), (1, 100)])
def test_spelling_variants(spark, shard, at_once):
    rows = misspelt()
    counts = spelling.word_counts(documents(spark, rows))
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_forms(counts, shard_words=shard, at_once=at_once).collect()}
    expected = variants(rows)
    assert got == expected
    assert len(got) > 40 and any(v[2] and v[2] != v[4] for v in got.values())
    assert spelling.spelling_forms(spelling.word_counts(documents(spark, []))).count() == 0


def test_spelling_counts_in_small_memory(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 1)
    assert {r["word"]: r["n"] for r in spelling.word_counts(documents(spark, [(1, "a b a"), (2, "B a")]), every=0).collect()} == {"a": 3, "b": 2}
    with pytest.raises(ValueError):
        spelling.spelling_forms(spelling.word_counts(documents(spark, [])), ratio=1)


def test_spelling_variants_sql():
    rows = [r for r in misspelt(8) if r[0] is not None]
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in answer("op13_spelling_variants", documents=as_table(rows))}
    assert got == variants(rows)


def test_queries_return_the_contract(spark, tmp_path):
    spark.createDataFrame(ROWS[:30], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, columns in {
        "op11_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op12_byte_pairs": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op13_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    }.items():
        assert queries.queries()[name](spark, str(tmp_path)).columns == columns
    told = {r["doc_id"]: r for r in queries.op12_byte_pairs(spark, str(tmp_path)).collect()}
    for i, t in ROWS[:30]:
        ids = encoded(t or "")
        assert (told[i]["n_tokens"], told[i]["ids_sha256"], told[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))

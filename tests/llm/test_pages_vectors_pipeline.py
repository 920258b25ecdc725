import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagrid.llm import html_text
from lineagrid.llm.embeddings import SmallWorld, audited_links, near_vectors, unit

TEXT = "The first sentence of the story, with commas, goes on for quite a while. " * 3
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- c > -->
<div class="ad">Buy, buy, buy.</div>{main}<aside>More</aside><div class="comments"><p>{text}{text}</p></div>
<form><p>Search</p></form><footer>&copy; x</footer>"""


def page(main):
    return PAGE.format(main=main, text=TEXT)


def test_article_only():
    html = page(f'<article><header><h1>A &amp;  B</h1><p>by X</p></header><p>{TEXT}<p><b>bold<br>x</p><div class="share">Tweet</div><ul><li>one<li>two &lt;3</ul></article>')
    assert html_text.page_text(html, []).split("\n") == ["A & B", TEXT.strip(), "bold x", "one", "two <3"]


def test_container_without_article():
    html = page(f'<div class="post-12"><p>{TEXT}</p><p>{TEXT}</p></div>')
    assert html_text.page_vote(html) == ">html>body>div.post-#"
    assert html_text.page_text(html, []) == "\n".join([TEXT.strip()] * 2)


@pytest.mark.parametrize("around", ['<div class="content-sidebar-wrap">', '<div class="has-sidebar">', '<div class="elementor-widget-container">', '<div class="sidebar">', '<div id="widget"><section class="masthead">', "<form>", '<div class="elementor-widget"><div class="header">'])
@pytest.mark.parametrize("story", ["<article><p>{}</p></article>", "<main><p>{}</p></main>", '<div class="story"><p>{}</p></div>'])
def test_wrapped_story(around, story):
    html = page(around + story.format(TEXT) + '<div class="site-footer"><p>Imprint</p></div>')
    assert html_text.page_text(html, [html_text.page_vote(html)]) == TEXT.strip()


@pytest.mark.parametrize("around", ['<div class="related-posts">', '<div class="main-sidebar">', '<div id="comments-area">', '<div class="x" hidden>', "<aside>"])
def test_teasers_do_not_hide_the_story(around):
    html = page(f'<div class="story"><p>{TEXT}</p></div>{around}<article><p>A teaser of another story, with a comma.</p></article></div>')
    assert html_text.page_text(html, []) == TEXT.strip()


def test_long_boilerplate_beside_a_short_article():
    assert html_text.page_text(f'<article><p>Short.</p></article><div class="cookie"><p>{TEXT}</p></div><footer>{TEXT}</footer>', []) == "Short."


@pytest.mark.parametrize("html", [None, "", "no tags at all", "<", "<p", "<p>x", "</div></div>", "<!-- open", "<script>never closed", "<table><tr><td>a<td>b</table>", "<a b=\"'>c</a>" * 3, "<p>" * 3000 + "x"])
def test_awkward_html(html):
    assert isinstance(html_text.page_text(html, [html_text.page_vote(html)]), str)


def test_host_consensus(spark):
    good = f'<div class="story"><p>{TEXT}</p></div>'
    # alone, this page's quotations would outweigh its story
    odd = f'<div class="story"><p>Short.</p></div><div class="quotes"><p>{TEXT}</p><p>{TEXT}</p></div>'
    rows = [(k, f"http://a.example/{k}", page(good)) for k in range(4)] + [(9, "http://A.example/9?x", page(odd)), (10, "http://b.example/", page(odd)), (11, None, None), (12, "", ""), (9, "http://A.example/9?x", page(odd))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS text", "1 AS _host", "2 AS _page_host", "3 AS _paths")
    for hosts in (50_000, 0):  # by broadcast, and by a salted join
        got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(df, broadcast_hosts=hosts).collect())
        texts = dict((p, t) for p, t, _ in got)
        assert len(got) == len(rows) and texts[9] == "Short." and texts[10] == "\n".join([TEXT.strip()] * 2)
        assert texts[0] == TEXT.strip() and texts[11] == texts[12] == "" and all(len(t) == n for _, t, n in got)
    assert html_text.extract_text(df.where("page_id = 99")).count() == 0


def test_consensus_of_every_template_of_a_host(spark):
    """The votes of the fifth template count too, by broadcast and by a join."""
    kinds = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(10 * k + n, f"http://a.example/{k}/{n}", page(f'<div class="{kind}"><p>{TEXT}</p></div>')) for k, kind in enumerate(kinds) for n in range(7 - k)]
    rows += [(90 + k, f"http://a.example/odd/{k}", page(f'<div class="{kind}"><p>Short.</p></div><div class="quotes-{kind}"><p>{TEXT}</p><p>{TEXT}</p></div>')) for k, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for hosts in (50_000, 0):
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(df, broadcast_hosts=hosts).collect()}
        assert len(got) == len(rows) and {got[90 + k] for k in range(5)} == {"Short."} and {got[i] for i in got if i < 90} == {TEXT.strip()}


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_against_a_plain_parser(spark, seed):
    """The story's text as the library's own HTML parser gives it, told which element is the story."""
    pages = brute.random_pages(seed)
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)
    expected = {p[0]: brute.page_text(p[2], p[3]) for p in pages}
    for hosts in (50_000, 0):
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(df, broadcast_hosts=hosts).collect()}
        assert got == expected


AWKWARD = {
    "nested": "<div>" * 200_000 + TEXT,
    "nested inline": "<b><i>" * 100_000 + TEXT + "</b>" * 1000,
    "open quotes": '<a b="x ' * 125_000 + TEXT,
    "open tags": "<p " * 300_000 + TEXT,
    "end inside quotes": '<a b=">"' * 120_000 + TEXT,
    "closing nothing": "<div>" * 16_000 + "</section>" * 60_000 + TEXT,
    "closing far above": "<b><div>" + "<i>" * 50_000 + "</b>" * 100_000 + TEXT,
    "scripts": "<script>" + "</script " * 100_000,
    "comments": "<!--" * 250_000,
    "open quotes of two kinds": "<a b='x\" c=\"y' <i d=\"z>" * 50_000 + TEXT,
    "quotes in vain": "<i x='>' " * 120_000 + "'" + TEXT,
    "classes": f'<div class="{" ".join(f"a{k}b" for k in range(100_000))}">{TEXT}',
}


@pytest.mark.parametrize("kind", AWKWARD)
def test_pages_of_a_megabyte_take_linear_time(kind):
    start = time.perf_counter()
    assert isinstance(html_text.page_text(AWKWARD[kind], []), str)
    assert time.perf_counter() - start < 10  # 0.1 to 4 seconds alone


def test_unclosed_quotes_cost_one_tag():
    assert html_text.page_text(f'<article><p>{TEXT}<a href="x>link</a></p><p class=\'y>two</p></article>', []).split("\n") == [TEXT + "link", "two"]


@pytest.mark.parametrize("opened", [1, 7, 8, 9, 400])
def test_tags_behind_unclosed_quotes_keep_their_own(opened):
    html = "<article><p>" + "<i x='>' " * opened + f'\' <b title="5 > 3" class="x">bold</b></p><p>{TEXT}</p></article>'
    assert html_text.page_text(html, []).split("\n") == [" ".join(["'"] * (opened + 1)) + " bold", TEXT.strip()]


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- x --!>", "<!-- > -->", "<!---->", "<!--x--->"])
def test_comments_end_as_in_html(comment):
    assert html_text.page_text(f"<article><p>one</p>{comment}<p>two</p></article>", []).split("\n") == ["one", "two"]
    assert html_text.page_text(f"<article><p>one{comment}</p><p>{TEXT}</p></article>", []).split("\n") == ["one", TEXT.strip()]


def clustered(seed, n, dims=16, spread=0.12):
    dice = np.random.default_rng(seed)
    centers = dice.normal(size=(n // 8, dims))
    return (centers[dice.integers(0, len(centers), n)] + spread * dice.normal(size=(n, dims))).astype(np.float32)


def test_small_world_finds_what_brute_force_finds():
    x = unit(clustered(1, 1500))
    index = SmallWorld.load(x, SmallWorld(x).dump())
    found, _ = audited_links(index, x, True, 0.93, 32, 48, 0.98)
    truth = [np.flatnonzero(x @ q >= 0.93) for q in x]
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(truth, found, strict=True)) >= 0.98 * sum(map(len, truth))
    assert all((x[f] @ q >= 0.93).all() for f, q in zip(found, x, strict=True))


@pytest.mark.parametrize("dims", [16, 64, 128])
def test_clustered_shards_end_far_below_their_size(dims):
    """The audit's own rounding must not widen a beam: it would end in brute force."""
    x = unit(clustered(3, 2000, dims, 0.02))
    found, beam = audited_links(SmallWorld(x), x, True, 0.93, 32, 48, 0.98)
    truth = [np.flatnonzero(x @ q >= 0.93) for q in x]
    assert beam <= 128 and sum(map(len, found)) >= 0.98 * sum(map(len, truth))


def test_audit_widens_a_narrow_beam():
    x = unit(np.random.default_rng(2).normal(size=(400, 64)))
    _, beam = audited_links(SmallWorld(x, degree=2, build_beam=2), unit(np.random.default_rng(3).normal(size=(60, 64))), False, 0.3, 1, 48, 0.98)
    assert beam > 1


def test_near_vectors(spark):
    v = clustered(4, 300)
    v[50] = v[10] * 3  # the same direction
    rows = [(i, x.tolist(), int(i % 2)) for i, x in enumerate(v)] + [(300 + i, v[20].tolist(), 0) for i in range(5)]
    odd = [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, [None] + [1.0] * 15, 0), (404, v[0].tolist(), None), (405, [float("inf")] * 16, 0), (406, [], 0), (407, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).repartition(3)
    for size in (4096, 60):  # one shard a label, and several
        got = {r["vec_id"]: r for r in near_vectors(df, shard_size=size, audit=1000, recall=1.0).collect()}
        ids = np.array([i for i, _, _ in rows])
        x, label = unit(np.array([e for _, e, _ in rows])), np.array([y for _, _, y in rows])
        near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
        np.fill_diagonal(near, False)
        found = brute.components(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(near)])
        assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in ids.tolist()} == {i: (int(n), found[i]) for i, n in zip(ids.tolist(), near.sum(axis=1), strict=True)}
        assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(400, 408))
    assert near_vectors(df.where("vec_id = -1")).count() == 0


def test_near_vectors_with_the_query_parameters(spark):
    """Defaults but for small shards: recall against brute force, no wrong link, and counts that agree from both sides."""
    v = clustered(9, 900)
    df = spark.createDataFrame([(i, x.tolist(), int(i % 2)) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, least=0.93, shard_size=100).collect()}
    x, label = unit(v), np.arange(900) % 2
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found, truth = np.array([got[i] for i in range(900)]), near.sum(axis=1)
    assert (found <= truth).all() and found.sum() >= 0.98 * truth.sum() and found.sum() % 2 == 0


def test_pipeline_stages_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    rows = brute.odd_documents(7, 60)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(t) and len(t) < 4000), 0) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = next(t for _, t in rows if t and 60 < len(t.split()) < 100)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "pack"]

    kept = corpus_pipeline.lines(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and all(r["n_chars"] == len(r["text"] or "") for r in kept.collect())
    expected = brute.near_duplicates(rows, 80)
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in left.collect()} == {i for i, v in expected.items() if v[1] == i}
    hit = brute.contamination(rows, [(0, item)])
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, v in hit.items() if not v[4]}
    assert any(v[4] for v in hit.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed and max(r["length"] for r in packed) <= 2048

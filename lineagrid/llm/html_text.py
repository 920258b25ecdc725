"""Main text of web pages by consensus of each host's pages.

Each page's containers are scored (long text and commas in paragraphs, few links, telling tags and classes), and the best
one votes for its generalised tag-class path, digits as #. Spark adds the votes up for each host; each page is then
extracted again from the nodes at the host's best-voted path that it has, or else from its own best container. All voted
paths count, however many a host has.

Hosts may hold any share of the pages: votes are added before the shuffle, and go to the pages by broadcast while they
are at most `broadcast_hosts` (host, path) rows and BROADCAST_BYTES. Else each page's own (host, path) pairs meet them in
a join whose hot pairs are split by salt; of html only a hash takes part until each page's path is found.

A page is read once, in time and memory linear in its length, however deep its elements nest and whatever its tags and
quotes leave open: a tag whose quotes never close ends at its next >, and a < without any > behind it is text.

Null html is empty; a page without article has empty text, not null. Pages without host (or url) vote together. Repeated
rows are returned each and vote each. Extra columns are kept, but for text and n_chars, which are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, slices, staged, unused

#: A tag, and one whose quotes never close: neither steps back, so a scan reads each character once.
TAG = re.compile(r"""<(/?+)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
OPEN_QUOTES = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAME_START = re.compile(r"</?[a-zA-Z]")
TAG_NAME = re.compile(r"</?+[a-zA-Z][^\s/>]*+")
QUOTE_OR_END = re.compile("[>\"']")
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Element names by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav footer aside form head script style noscript template iframe svg math button select input textarea menu dialog object embed canvas audio video map".split())
CLOSED_BY = {"p": BLOCK - {"option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
SCOPE = frozenset("table td th ul ol dl div section article main body html blockquote form".split())
BOILERPLATE = frozenset("ad ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
HEADERS = frozenset("header masthead".split())
#: Words that a boilerplate word may stand with in one class or id: `site-footer` is boilerplate, `content-sidebar-wrap` is not.
BESIDE = frozenset("area bar block bottom box btn button buttons desktop icons item items left link links list main mini mobile page post posts primary right secondary section site sticky top".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Elements that are dropped whatever they hold.
NEVER_TEXT = RAW | frozenset("nav footer svg math button select input object embed canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
GOOD = frozenset("article body content entry main page post story text".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
#: Bytes of hosts and voted paths that are sent to all workers at once.
BROADCAST_BYTES = 8 << 20


def marks(classes: str, name: str) -> frozenset[str]:
    """The boilerplate words that are a whole class or id, or stand in it with nothing but each other and BESIDE."""
    out: set[str] = set()
    for token in f"{classes} {name}".lower().split():
        words = {w for w in re.split(r"[^a-z]+", token) if w}
        if (found := words & (BOILERPLATE | HEADERS)) and words <= found | BESIDE:
            out |= found
    return frozenset(out)


LOOKED_AT = frozenset("class id role style hidden".split())
NO_WORDS: frozenset[str] = frozenset()


@lru_cache(maxsize=10_000)
def named_by(name: str, classes: str, identity: str) -> tuple[str, frozenset[str], frozenset[str]]:
    """An element's step in a path, the letter words of its class and id, and its boilerplate words."""
    step = ".".join([name, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})])
    words = frozenset(w for w in re.split(r"[^a-z]+", f"{classes} {identity}".lower()) if w)
    return step, words, NO_WORDS if name in ("html", "body", "article", "main") else marks(classes, identity)


def comment_end(html: str, start: int) -> int:
    """Where the comment that begins at `start` is over: behind -->, --!>, or at once for <!--> and <!--->."""
    for short in ("<!-->", "<!--->"):
        if html.startswith(short, start):
            return start + len(short)
    found = COMMENT_END.search(html, start + 4)
    return found.end() if found else len(html)


def tag_end(html: str, at: int, dead: set[int]) -> int:
    """Behind the first > outside quotes from `at` on, or -1.

    The opening quotes of a scan without end go to `dead`: a later scan that opens one of them has no end either, so each
    quote of a page is passed once by scans in vain, however many tags leave theirs open.
    """
    passed = []
    while (m := QUOTE_OR_END.search(html, at)) and m.start() not in dead:
        if m[0] == ">":
            return m.end()
        passed.append(m.start())
        at = html.find(m[0], m.end()) + 1
        if not at:
            break
    dead.update(passed)
    return -1


class Page:
    """Elements in document order and the page's texts and block edges between them.

    Paths are numbers: each stands for the parent's path and one step, so memory and time are linear in the page however
    deep its elements nest.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.names, self.drop, self.header = ["#"], [0], [0], [frozenset()], [False], [False]
        self.fixed, self.block = [False], [0]
        self.steps: list[tuple[int, str]] = [(0, "")]  # a path's parent path and its last step
        self.numbers: dict[tuple[int, str], int] = {}
        self.digests = [digest("")]
        self.open: dict[str, list[int]] = {}  # places on the stack of the open elements, by name
        self.scopes: list[int] = []  # places of those in SCOPE
        self.blocks: list[int] = []  # places of those in BLOCK
        self._free: list[bool] | None = None
        self.events: list[tuple[int, str | None]] = []  # (element, text) or (element, None) at a block's edge
        self._read(html)
        self._spare()

    def _read(self, html: str) -> None:
        stack, at, text_at = [0], 0, 0
        dead: set[int] | None = None  # quotes from which a scan met no end of its tag, once there is one
        last = html.rfind(">")

        def text(end: int) -> None:
            if end > text_at:
                self.events.append((stack[-1], html[text_at:end]))

        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                text(start)
                at = text_at = comment_end(html, start)
                continue
            if start > last:
                at = start + 1
                continue
            if not NAME_START.match(html, start):
                if html[start + 1] in "!?/":
                    text(start)
                    at = text_at = html.find(">", start) + 1
                else:
                    at = start + 1
                continue
            m = TAG.match(html, start) if dead is None else None
            if not m:
                dead = set() if dead is None else dead
                end = tag_end(html, TAG_NAME.match(html, start).end(), dead)
                m = TAG.match(html, start, end) if end >= 0 else OPEN_QUOTES.match(html, start)
            text(start)
            at, name = m.end(), m[2].lower()
            if m[1]:
                self._close(stack, name)
            else:
                while stack[-1] and name in CLOSED_BY.get(self.tag[stack[-1]], ()):
                    self._end(stack)
                if name in CLOSED_BY["p"] and name != "option":
                    self._close_inner(stack, "p")
                node = self._open(stack[-1], name, m[3])
                if name in BLOCK:
                    self.events.append((node, None))
                elif name == "br":
                    self.events.append((stack[-1], " "))
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(html, at, last + 1)
                    at = end.end() if end else len(html)
                elif name not in VOID and not m[3].endswith("/"):
                    self._push(stack, node, name)
            text_at = at
        text(len(html))

    def _push(self, stack: list[int], node: int, name: str) -> None:
        self.open.setdefault(name, []).append(len(stack))
        if name in SCOPE:
            self.scopes.append(len(stack))
        if name in BLOCK:
            self.blocks.append(len(stack))
        stack.append(node)

    def _open(self, parent: int, name: str, attributes: str) -> int:
        found = {low: entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes) if (low := k.lower()) in LOOKED_AT} if attributes.strip(" /") else {}
        node, last, words, whole = len(self.tag), name, NO_WORDS, NO_WORDS
        if "class" in found or "id" in found:
            classes, identity = found.get("class", ""), found.get("id", "")
            last, words, whole = (named_by if len(classes) + len(identity) < 200 else named_by.__wrapped__)(name, classes, identity)
        hidden = bool(found) and ("hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower())
        step = (self.path[parent], last)
        if (path := self.numbers.setdefault(step, len(self.steps))) == len(self.steps):
            self.steps.append(step)
            self.digests.append(digest(self.digests[step[0]].hex() + last))
        self.tag.append(name)
        self.parent.append(parent)
        self.path.append(path)
        self.block.append(node if name in BLOCK else self.block[parent])
        self.names.append(words)
        self.drop.append(name in DROPPED or hidden or (bool(found) and found.get("role", "").lower() in ROLES) or not whole.isdisjoint(BOILERPLATE))
        self.header.append(name == "header" or not whole.isdisjoint(HEADERS))
        self.fixed.append(name in NEVER_TEXT or hidden or not whole.isdisjoint(COMMENTS))
        return node

    def path_text(self, node: int) -> str:
        """The tag-class path of an element, from the outermost: >html>body>div.post-#; empty for the page itself."""
        steps, at = [], self.path[node]
        while at:
            at, step = self.steps[at]
            steps.append(step)
        return "".join(f">{x}" for x in reversed(steps))

    def _end(self, stack: list[int]) -> None:
        node = stack.pop()
        self.open[self.tag[node]].pop()
        for places in (self.scopes, self.blocks):
            if places and places[-1] == len(stack):
                places.pop()
        if self.tag[node] in BLOCK:
            self.events.append((stack[-1], None))

    def _close(self, stack: list[int], name: str) -> None:
        """Closes the innermost open `name` and all inside it; inline elements only up to the next element of SCOPE."""
        if (places := self.open.get(name)) and (name in SCOPE or not self.scopes or self.scopes[-1] < places[-1]):
            depth = places[-1]
            while len(stack) > depth:
                self._end(stack)

    def _close_inner(self, stack: list[int], name: str) -> None:
        """Closes an open `name` below which only inline elements are open."""
        if self.blocks and self.tag[stack[self.blocks[-1]]] == name:
            self._close(stack, name)

    def dropped(self, roots: frozenset[int] = frozenset()) -> list[bool]:
        """Whether each element is boilerplate or inside some; roots never are, whatever is around them.

        A header below a root keeps its headings only; any other header goes whole.
        """
        if not roots and self._free is not None:
            return self._free
        out, inside, in_header = [False] * len(self.tag), [False] * len(self.tag), [False] * len(self.tag)
        for n in range(1, len(self.tag)):
            up = self.parent[n]
            if n in roots:
                inside[n] = True
                continue
            inside[n] = inside[up]
            in_header[n] = in_header[up] or (self.header[n] and inside[n])
            out[n] = out[up] or self.drop[n] or (self.header[n] and not inside[n])
            if in_header[n] and self.tag[n] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                in_header[n] = False
        told = [o or h for o, h in zip(out, in_header, strict=True)]
        if not roots:
            self._free = told
        return told

    def _spare(self) -> None:
        """Dropped elements around the page's text stay: layout wrappers, forms around whole pages, a head never closed.

        Only where no article or main stands free: those that hold most of the text outside links, and those around the
        article or main with most text, if all text that stands free is no more. Hidden elements, nav, footer, comments
        and the like are not text and stay dropped.
        """
        if not any((d or h) and not f for d, h, f in zip(self.drop, self.header, self.fixed, strict=True)):
            return
        n, dropped = len(self.tag), self.dropped()
        size, out = [0] * n, [False] * n
        for k in range(1, n):
            out[k] = out[self.parent[k]] or self.fixed[k] or self.tag[k] == "a"
        for node, text in self.events:
            if text and not out[node]:
                size[node] += len(text.strip())
        alone = sum(s for s, d in zip(size, dropped, strict=True) if not d)
        for k in range(n - 1, 0, -1):
            size[self.parent[k]] += size[k]
        stories = [k for k in range(1, n) if self.tag[k] in ("article", "main") and not out[k] and size[k]]
        if any(not dropped[k] for k in stories):
            return
        spared = {k for k in range(1, n) if 2 * size[k] > size[0]}
        at = max(stories, key=lambda k: (size[k], -k), default=0)
        while at and size[at] >= alone:
            spared.add(at)
            at = self.parent[at]
        for k in spared:
            if not self.fixed[k]:
                self.drop[k] = self.header[k] = False
        self._free = None

    def best_container(self) -> int:
        """The best-scored container, 0 if none has text."""
        dropped, n = self.dropped(), len(self.tag)
        score, length, linked = [0.0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parent[k]] or self.tag[k] == "a"
        for node, text in self.events:
            if text and not dropped[node]:
                size = len(text.strip())
                length[node] += size
                linked[node] += size * in_link[node]
                block = self.block[node]
                if size and not in_link[node]:
                    points = min(1.0, size / 25) + min(text.count(","), size / 20) + min(size / 100, 3) + size / 500
                    holder = block if self.tag[block] in CONTAINERS else self.parent[block]
                    score[holder] += points
                    score[self.parent[holder]] += points / 2
        for k in range(n - 1, 0, -1):
            length[self.parent[k]] += length[k]
            linked[self.parent[k]] += linked[k]
        best, top = 0, 0.0
        for k in range(1, n):
            if length[k] and not dropped[k] and self.tag[k] in CONTAINERS:
                worth = score[k] * (1 - linked[k] / length[k])
                worth *= {"article": 3.0, "main": 2.0, "body": 0.5}.get(self.tag[k], 1.0) * (1.5 if self.names[k] & GOOD else 1.0)
                if worth > top:
                    best, top = k, worth
        return best

    def at(self, path: bytes) -> frozenset[int]:
        """The elements at a path, told by its digest, that are not boilerplate."""
        if path not in self.digests:
            return frozenset()
        number, dropped = self.digests.index(path), self.dropped()
        return frozenset(k for k, p in enumerate(self.path) if k and p == number and not dropped[k])

    def candidates(self) -> set[bytes]:
        """The paths (digests) of all containers that are not boilerplate: votes for others are of no use to this page."""
        dropped = self.dropped()
        return {self.digests[p] for k, p in enumerate(self.path) if self.tag[k] in CONTAINERS and not dropped[k]}

    def text(self, roots: frozenset[int]) -> str:
        """Blocks below roots, one a line: references decoded, white space turned into single blanks."""
        if not roots:
            return ""
        dropped, inside = self.dropped(roots), [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            inside[k] = k in roots or inside[self.parent[k]]
        blocks, open_text = [], []
        for node, text in [*self.events, (0, None)]:
            if text is None or not inside[node]:
                if open_text and text is None:
                    blocks.append("".join(open_text))
                    open_text = []
            elif not dropped[node]:
                open_text.append(text)
        lines = (" ".join((entities.unescape(b) if "&" in b else b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def path_digest(path: str) -> bytes:
    """The digest of a written path: each step is hashed behind its parent's digest."""
    told = digest("")
    for step in path.split(">")[1:]:
        told = digest(told.hex() + step)
    return told


def page_vote(html: str | None) -> str:
    """The path of the page's best container, "" if it has none."""
    page = Page(html or "")
    return page.path_text(page.best_container())


def page_text(html: str | None, paths: list[str]) -> str:
    """The text at the first of the host's paths that the page has, else in its own best container."""
    return text_at(Page(html or ""), [path_digest(p) for p in paths])


def text_at(page: Page, paths: list[bytes]) -> str:
    for path in paths:
        if roots := page.at(path):
            return page.text(roots)
    best = page.best_container()
    return page.text(frozenset([best])) if best else ""


def with_host(pages: DataFrame, name: str = "_host") -> DataFrame:
    return pages.withColumn(name, F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")))


def host_votes(pages: DataFrame) -> DataFrame:
    """_host, _path (its digest), path and n, its votes, for every path that is voted for."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            told = []
            for html in batch.column("html").to_pylist():
                page = Page(html or "")
                best = page.best_container()
                told.append((page.digests[page.path[best]], page.path_text(best)))
            digests, paths = zip(*told, strict=True) if told else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(digests, pa.binary()), pa.array(paths, pa.string())], names=["_host", "_path", "path"])

    counted = with_host(pages.select("url", "html")).select("_host", "html").mapInArrow(votes, "_host string, _path binary, path string")
    return counted.where("path <> ''").groupBy("_host", "_path", "path").agg(F.count("*").alias("n"))


def chosen_paths(pages: DataFrame, votes: DataFrame, salts: int) -> DataFrame:
    """_host, _page (the html's hash) and path (a digest): the best-voted path of each page that has one, by a join."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            for host, html in zip(batch.column("_host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = list(Page(html or "").candidates())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(found)), pa.array([digest(html)] * len(found), pa.binary()), pa.array(found, pa.binary())], names=["_host", "_page", "_path"])

    pairs = with_host(pages.select("url", "html")).select("_host", "html").mapInArrow(own, "_host string, _page binary, _path binary")
    pairs = pairs.withColumn("_salt", F.pmod(F.xxhash64("_page"), F.lit(salts)).cast("int"))
    voted = votes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pairs.join(voted, ["_host", "_path", "_salt"]).groupBy("_host", "_page").agg(F.min_by("_path", F.struct(-F.col("n"), "path")).alias("path"))


def extract_text(pages: DataFrame, broadcast_hosts: int = 50_000, salts: int = 16) -> DataFrame:
    """All columns of pages with text and n_chars (code points)."""
    need(pages, "url", "html")
    own = pages.drop("text", "n_chars")
    columns = own.columns
    host, found, salt, page = (unused(own, n) for n in ("_page_host", "_page_path", "_page_salt", "_page_hash"))
    votes = staged(host_votes(pages), "host-votes")
    size = votes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("_host") + F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    told, ranks = with_host(own, host), None
    if size["n"] <= broadcast_hosts and size["bytes"] <= BROADCAST_BYTES:
        told_votes: dict[str, dict[bytes, tuple[int, str]]] = {}
        for r in votes.toLocalIterator():
            told_votes.setdefault(r["_host"], {})[bytes(r["_path"])] = (-r["n"], r["path"])
        ranks = pages.sparkSession.sparkContext.broadcast(told_votes)
    else:
        best = staged(chosen_paths(pages, votes, salts), "page-paths").select(F.col("_host").alias(host), F.col("_page").alias(page), F.col("path").alias(found))
        with_page = T.StructType(list(told.schema.fields)).add(page, "binary")

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "html"):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(h or "") for h in batch.column("html").to_pylist()], pa.binary())], names=[*batch.schema.names, page])

        salted = best.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        told = told.mapInArrow(keyed, with_page).withColumn(salt, F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int")).join(salted, [host, page, salt], "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = []
            for k, html in enumerate(batch.column("html").to_pylist()):
                parsed = Page(html or "")
                if ranks is None:
                    path = batch.column(found)[k].as_py()
                else:
                    voted = ranks.value.get(batch.column(host)[k].as_py(), {})
                    path = min((p for p in parsed.candidates() if p in voted), key=voted.__getitem__, default=None)
                out.append(text_at(parsed, [path] if path else []))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*columns, "text", "n_chars"])

    schema = T.StructType(list(own.schema.fields)).add("text", "string").add("n_chars", "long")
    return told.mapInArrow(rows, schema)

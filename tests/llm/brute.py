"""Plain-Python versions of what the operators return, and small awkward corpora."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np


def odd_documents(seed=1, n=40):
    """Prose with copies, near copies, shared lines, long and awkward texts, nulls and empties."""
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(dice.choice(vocabulary) for _ in range(k))
    shared, passage = prose(8), prose(40)
    texts = [None, "", " \n\t ", "one", "one two three", "é ß 日本語 Ünï", "x" * 5000, "a b " * 3000, "A\x00b\x1cc"]
    for k in range(n):
        text = prose(dice.randint(20, 120))
        if k % 3 == 0:
            text += "\n" + shared
        if k % 5 == 0:
            text += f"\n{prose(3)} {passage} {prose(4)}"
        texts.append(text)
        if k % 4 == 0:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            texts += [text, " ".join(words)]
    order = list(range(len(texts)))
    dice.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def lower(data):
    return bytes(c + 32 if 65 <= c < 91 else c for c in data)


def shingles(text, words=5):
    w = re.findall(rb"[^\x20\x09-\x0d]+", lower((text or "").encode()))
    if len(w) >= words:
        return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def repeats(rows, length=50):
    return dict(repeats_of_rows(rows, length))


def repeats_of_rows(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        out.append((i, (len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())))
    return out


def frequent_lines(rows, min_docs):
    keys = defaultdict(set)
    for i, t in rows:
        for line in (t or "").encode().split(b"\n"):
            keys[lower(line.strip(b" \t\n\x0b\x0c\r"))].add(i)
    often = {k for k, d in keys.items() if k and len(d) >= min_docs}
    out = {}
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if lower(x.strip(b" \t\n\x0b\x0c\r")) not in often]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


def words(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower((text or "").encode()))


def contamination(rows, items, window=13):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(i))
    sizes = {len(g) for g in windows}
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def best_fit(sizes, capacity):
    """Bins of best-fit decreasing, one piece at a time."""
    bins = []
    for s in sorted(sizes, reverse=True):
        room = [(r, k) for k, r in enumerate(bins) if r >= s]
        if room:
            r, k = min(room)
            bins[k] = r - s
        else:
            bins.append(capacity - s)
    return sorted(bins)


class PlainPage(HTMLParser):
    """Text blocks below the first element that `is_story` picks, without elements that `is_gone` picks: no votes, no scores."""

    BLOCKS = {"p", "h2", "li", "ul", "div", "blockquote", "article", "main", "section"}

    def __init__(self, html, is_story, is_gone):
        super().__init__(convert_charrefs=True)
        self.is_story, self.is_gone = is_story, is_gone
        self.stack, self.lines, self.line = [], [], ""
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        classes = dict(attrs).get("class", "")
        if tag not in ("br", "input"):
            self.stack.append((tag, self.is_story(tag, classes), self.is_gone(tag, classes)))
        self.cut(tag)
        if tag == "br" and self.wanted():
            self.line += " "

    def handle_endtag(self, tag):
        self.cut(tag)
        self.stack.pop()

    def wanted(self):
        return any(story for _, story, _ in self.stack) and not any(gone for *_, gone in self.stack)

    def cut(self, tag):
        if tag in self.BLOCKS:
            if text := " ".join(self.line.split()):
                self.lines.append(text)
            self.line = ""

    def handle_data(self, data):
        if self.wanted():
            self.line += data


def random_pages(seed, hosts=6, pages=12):
    """(page_id, url, html, is_story) of hosts with two templates each: stories between menus, adverts, comments and forms."""
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + dice.choice([".", ", &amp; so on.", " &lt;3.", "&nbsp;!", " &#233;t&eacute;."])
    prose = lambda: " ".join(sentence(dice.randint(6, 14)) for _ in range(dice.randint(2, 5)))
    inline = lambda t: dice.choice([t, f"<b>{t}</b>", f"<em>{word()}</em> {t}", f'{t}<br>{word()} <a href="/{word()}">{word()}</a>'])
    block = lambda: dice.choice([lambda: f"<p>{inline(prose())}</p>", lambda: f"<h2>{sentence(4)}</h2><p>{prose()}</p>", lambda: f"<ul><li>{prose()}</li>\n<li>{inline(prose())}</li></ul>", lambda: f"<blockquote>\n  <p>{prose()}</p></blockquote>", lambda: f"<p>{prose()}</p><div class=\"ad\">{prose()}</div>", lambda: f"<script>if (a < b) {{ {word()}('</p>') }}</script><p>{prose()}</p>"])()
    noise = [lambda: f'<nav><ul><li><a href="/">{word()}</a></li></ul></nav>', lambda: f'<aside class="{word()}"><p>{sentence(5)}</p></aside>', lambda: f'<div class="cookie"><p>{sentence(9)}</p></div>', lambda: f'<div class="sidebar"><ul><li><a href="/x">{sentence(3)}</a></li></ul></div>', lambda: f'<form action="/s"><input name=q><p>{word()}</p></form>', lambda: f'<div class="comments"><p>{sentence(12)}</p></div>']
    out = []
    for h in range(hosts):
        kinds = [(t, dice.choice(["", f"{word()}-{h}"]) if t != "div" else f"{word()}-text") for t in dice.sample(["article", "main", "div", "section"], 2)]
        for n in range(pages):
            tag, name = kinds[n % 2]
            opened = f'<{tag} class="{name}">' if name else f"<{tag}>"
            around = [dice.choice(noise)() for _ in range(dice.randint(1, 5))]
            cut = dice.randint(0, len(around))
            html = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p {{}}</style></head><body><header><h1>{word()}</h1></header>{''.join(around[:cut])}<!-- {word()} > -->{opened}{''.join(block() for _ in range(dice.randint(2, 6)))}</{tag}>{''.join(around[cut:])}<footer><p>&copy; {word()}</p></footer></body></html>"
            out.append((len(out), f"https://h{h}.example/{word()}/{n}", html, (tag, name)))
    return out


def page_text(html, story):
    """The plain version's text of a page of random_pages."""
    gone = {"ad", "cookie", "sidebar", "comments"}
    plain = PlainPage(html, lambda t, c: (t, c) == story, lambda t, c: t in ("nav", "aside", "form", "footer", "header", "script", "style") or c in gone)
    return "\n".join(plain.lines)


def statistics(text):
    """The twenty statistics of one text, in plain Python."""
    data = (text or "").encode()
    kinds = {1: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2: b"0123456789", 3: b"#$%&*+<=>@\\^_`{|}~/", 4: b".,", 5: b"!\"'():;?[]-", 7: b" \t\n\x0b\x0c\r"}
    of = lambda b: 6 if b >= 128 else next((k for k, chars in kinds.items() if b in chars), 8 if 97 <= b < 123 else 0)
    usual = {1: 0.02, 2: 0.003, 3: 0.002, 4: 0.025, 5: 0.003, 6: 0.02, 7: 0.16}
    share = {k: (sum(of(b) == k for b in data) + u * 100) / (len(data) + 100) for k, u in usual.items()}
    raw = re.findall(rb"[^\x20\x09-\x0d]+", data)
    low = [lower(w) for w in raw]
    n = len(raw)
    blend = lambda total, u: (total + u * 15) / (n + 15)
    mean = blend(sum(map(len, raw)), 6.0)
    sd = math.sqrt(max(blend(sum(len(w) ** 2 for w in raw), 45.0) - mean**2, 0))
    counts = [low.count(w) for w in set(low)]
    entropy = -sum(c / n * math.log(c / n) for c in counts) if n else 0.0
    count = lambda w, ks: sum(of(b) in ks for b in w)
    pairs = set(zip(low[:-1], low[1:], strict=True))
    full = [lower(x) for x in data.split(b"\n") if x]
    r = math.sqrt
    return [
        math.log(len(data) + 100), math.log(n + 15), math.log(data.count(b"\n") + 3), math.log(mean), math.log1p(sd), r(share[1]), r(share[2]), r(share[3]), r(share[4]), r(share[5]), r(share[6]), r(share[7]),
        blend(len(counts), 0.9), r(blend(sum(a == b for a, b in zip(low[:-1], low[1:], strict=True)), 0.0)), blend(entropy / math.log(n + 2) * n, 0.95), blend(sum(count(w, (1, 6, 8)) >= len(w) for w in raw), 0.85),
        r(blend(sum(count(w, (1,)) >= max(count(w, (1, 6, 8)), 1) for w in raw), 0.01)), r(blend(sum(count(w, (3, 5)) >= 2 for w in raw), 0.01)), blend(len(pairs), 0.98), r((len(full) - len(set(full))) / (len(full) + 4)),
    ]


def discriminant(texts, labels, to_pooled, to_identity):
    """Scores of the texts by the plain formula: dense covariances, inverses and determinants, no sums."""
    x, y = np.array([statistics(t) for t in texts]), np.array(labels)
    z = (x - x.mean(axis=0)) / np.sqrt(np.maximum(x.var(axis=0), 1e-8))
    covariances = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * covariances[c] for c in (0, 1))
    log = []
    for c in (0, 1):
        s = (1 - to_pooled) * covariances[c] + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * np.trace(s) / len(s) * np.eye(len(s))
        d = z - z[y == c].mean(axis=0)
        log.append(math.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    return 1 / (1 + np.exp(log[0] - log[1]))

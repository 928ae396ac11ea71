"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut at block-level tags in leaf blocks of text. Each block has features of
its ancestors' tags and class names and of its text; a chain over the blocks of
a page decides by Viterbi which belong to the main text. The weights are fitted on labelled
pages, which are composed here from the parts that pages have, in many layouts.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_batches, slices

#: of a tag: a quote opens a value only after =, so that a stray one ends with the tag
_ATTRS = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    # read to their end, or to the page's
    rf"|<(?P<raw>script|style|textarea|title)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    # these only where they end, and not where they are empty
    rf"|<(?P<shut>noscript|template|svg|iframe|select)\b{_ATTRS}(?<!/)>.*?</(?P=shut)\s*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attr>{_ATTRS})>",
    re.S | re.I,
)
CUT = re.compile(r"\s*<[a-zA-Z/!?][^>]*\Z")  # a tag that the page's end cuts
ATTR = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: elements that do not part a line of text
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
EMPTY = frozenset(("svg", "path", "iframe", "template", "noscript", "select"))  # where they end in a slash
#: an opening tag ends these open elements
ENDS = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
} | {t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
#: they keep an opening tag inside from ending what is open outside
SCOPE = frozenset("ul ol dl table div section article aside main header footer nav form blockquote body td th".split())
SIZE = 1 << 12  # hashed features


class Block:
    __slots__ = ("path", "hints", "text", "linked", "main")

    def __init__(self, path, hints, text, linked, main):
        self.path, self.hints, self.text, self.linked, self.main = path, hints, text, linked, main


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order: character references decoded, white space to one space, trimmed, none empty."""
    out, stack, run, at = [], [], [], 0
    linked = anchors = 0

    def flush():
        nonlocal run, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append(Block([t for t, _, _ in stack if t not in INLINE], [h for _, hs, _ in stack for h in hs], text, min(1.0, linked / len(text)), any(m for _, _, m in stack)))
        run, linked = [], 0

    def text(s):
        nonlocal linked
        if s:
            run.append(s)
            if anchors:
                linked += len(s.strip())

    def close(k):
        nonlocal anchors
        anchors -= sum(t == "a" for t, _, _ in stack[k:])
        del stack[k:]

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            run.append("\n")
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ENDS.get(tag, ()):
                close(k)
            elif stack[k][0] in SCOPE:
                break
        if tag not in VOID and not (tag in EMPTY and m["attr"].endswith("/")):
            anchors += tag == "a"
            hints, main = [], False
            for name, a, b, c in ATTR.findall(m["attr"] or ""):
                value = a or b or c
                if name.lower() == "data-main":
                    main = True
                else:
                    hints += [w for w in re.split(r"[^a-z]+", value.lower()) if w]
            stack.append((tag, hints, main))
    if not CUT.match(page, at):
        text(page[at:])
    flush()
    return out


@lru_cache(100_000)
def _number(name: str) -> int:
    return crc32(name.encode()) % SIZE


def features(page: list[Block]) -> list[list[int]]:
    out = []
    n = len(page)
    prose = [b.text.count(" ") >= 8 and b.linked < 0.3 for b in page]
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        own = {f"in {t}" for t in b.path} | {f"hint {h}" for h in b.hints}
        own.add("leaf " + (b.path[-1] if b.path else "none"))
        own.add("parent " + (b.path[-2] if len(b.path) > 1 else "none"))
        own.add(f"words {min(words.bit_length(), 8)}")
        own.add(f"linked {int(b.linked * 3.999)}")
        own.add("stop" if b.text[-1] in ".!?…:;\"'»”" else "no stop")
        own.add(f"commas {min(b.text.count(','), 3)}")
        digits = sum(c.isdigit() for c in b.text[:200])
        own.add(f"digits {min(4, 10 * digits // min(len(b.text), 200))}")
        if "©" in b.text or "copyright" in b.text.lower():
            own.add("copyright")
        own.add("first" if not k else "last" if k == n - 1 else "inner")
        own.add(f"words {min(words.bit_length(), 8)} linked {int(b.linked * 3.999)}")
        for at, name in ((k - 1, "before"), (k, "here"), (k + 1, "after")):
            if 0 <= at < n and prose[at]:
                own.add(f"prose {name}")
        out.append([_number(f) for f in own])
    return out


class Chain:
    """A two-state linear chain: weights (features, 2), transitions (2, 2), starts (2)."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros((SIZE, 2)), np.zeros((2, 2)), np.zeros(2)

    def emissions(self, feats: list[list[int]]) -> np.ndarray:
        flat = np.concatenate([np.asarray(f) for f in feats])
        at = np.cumsum([0, *map(len, feats)])[:-1]
        return np.add.reduceat(self.w[flat], at, axis=0)

    def decode(self, feats: list[list[int]]) -> list[int]:
        """The most probable states of a page's blocks."""
        if not feats:
            return []
        e = self.emissions(feats).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = e[0][0] + self.s[0], e[0][1] + self.s[1]
        back = []
        for x, y in e[1:]:
            fa, fb = b + t10 > a + t00, b + t11 > a + t01
            back.append((fa, fb))
            a, b = (b + t10 if fa else a + t00) + x, (b + t11 if fb else a + t01) + y
        state = int(b > a)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]

    def gradient(self, feats, y):
        """Of the log-likelihood of one page, by forward and backward sums."""
        e = self.emissions(feats)
        n = len(e)
        f, g = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = e[0] + self.s
        for k in range(1, n):
            f[k] = e[k] + np.logaddexp(f[k - 1, 0] + self.t[0], f[k - 1, 1] + self.t[1])
        for k in range(n - 2, -1, -1):
            v = e[k + 1] + g[k + 1]
            g[k] = np.logaddexp(self.t[:, 0] + v[0], self.t[:, 1] + v[1])
        z = np.logaddexp(f[-1, 0], f[-1, 1])
        d = -np.exp(f + g - z)
        d[np.arange(n), y] += 1
        dt = np.zeros((2, 2))
        if n > 1:
            pair = f[:-1, :, None] + self.t + (e + g)[1:, None, :] - z
            dt = -np.exp(pair).sum(0)
            np.add.at(dt, (y[:-1], y[1:]), 1)
        return d, dt, d[0]

    def fit(self, pages, epochs: int = 8, rate: float = 0.2, decay: float = 1e-3) -> None:
        """AdaGrad ascent, a page at a time; pages: (features, states)."""
        r = np.random.default_rng(2)
        gw, gt, gs = np.full(self.w.shape, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)
        for _ in range(epochs):
            for i in r.permutation(len(pages)):
                feats, y = pages[i]
                d, dt, ds = self.gradient(feats, y)
                flat = np.concatenate([np.asarray(f) for f in feats])
                step = np.zeros_like(self.w)
                np.add.at(step, flat, np.repeat(d, [len(f) for f in feats], axis=0))
                own = np.unique(flat)
                s = step[own] - decay * self.w[own]
                gw[own] += s * s
                self.w[own] += rate * s / np.sqrt(gw[own])
                for p, q, g in ((self.t, gt, dt), (self.s, gs, ds)):
                    q += g * g
                    p += rate * g / np.sqrt(q)


def labelled_pages(n: int = 800, seed: int = 17) -> list[str]:
    """Pages whose main text stands in elements marked data-main; the mark is no feature."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[int(r.integers(len(x)))]
    some = lambda lo, hi: range(int(r.integers(lo, hi + 1)))
    letters = np.array(list("aeiounrstlmdpéäc"))
    word = lambda: "".join(r.choice(letters, int(r.integers(2, 9))))
    words = lambda lo, hi: " ".join(word() for _ in some(lo, hi))

    def sentences(lo, hi):
        return " ".join(", ".join(words(2, 8) for _ in some(1, 3)).capitalize() + pick(".", ".", ".", "!", "?") for _ in some(lo, hi))

    link = lambda lo=1, hi=3: f'<a href="/{word()}">{words(lo, hi)}</a>'
    cls = lambda *names: pick("", f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{pick(*names)}"')
    must = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"')

    def menu():
        return f"<ul>{''.join(f'<li>{link()}</li>' for _ in some(3, 9))}</ul>"

    parts = {
        "nav": lambda: f"<nav{cls('menu', 'navbar', 'nav')}>{menu()}</nav>" if r.random() < 0.7 else f"<div{must('menu', 'navigation', 'nav', 'breadcrumb')}>{menu()}</div>",
        "header": lambda: f"<header{cls('site-header', 'masthead', 'top')}>{pick('<h1>', '<div>', '<p>')}{words(1, 5)}{pick('', link())}</header>",
        "ad": lambda: f"<div{must('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{sentences(1, 3)}{pick('', link())}</div>",
        "notice": lambda: f"<div{must('cookie-notice', 'notice', 'consent', 'alert', 'popup', 'gdpr')}>{pick('', '<p>')}{sentences(1, 3)}<button>{words(1, 2)}</button></div>",
        "aside": lambda: f"<aside{cls('sidebar', 'related', 'widget')}><h3>{words(1, 4)}</h3>{pick(menu(), f'<p>{sentences(1, 4)}</p>')}</aside>" if r.random() < 0.7 else f"<div{must('sidebar', 'related', 'widget', 'share')}><h4>{words(1, 3)}</h4>{pick(menu(), f'<p>{sentences(1, 3)}</p>')}</div>",
        "form": lambda: f"<form{cls('search', 'subscribe', 'newsletter')}><p>{sentences(1, 2)}</p><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>",
        "comments": lambda: pick("<section", "<div") + must("comments", "comment-list", "discussion", "replies", "responses") + f"><h3>{words(1, 3)}</h3>" + "".join(f"<div{cls('comment', 'reply')}><b>{word()}</b> <p>{sentences(1, 5)}</p></div>" for _ in some(1, 5)) + "</div></section>",
        "footer": lambda: f"<footer{cls('footer', 'site-footer')}>{pick('&copy; ', '', '')}{words(1, 4)} {pick('&middot; ', '')}{sentences(1, 2)}{pick('', menu())}</footer>" if r.random() < 0.8 else f"<div{must('footer', 'bottom', 'copyright', 'legal')}>&copy; {words(1, 4)} {sentences(1, 1)}</div>",
    }

    def body(depth=0):
        out = ""
        for _ in some(1, pick(3, 14, 14)):
            k = r.random()
            if k < 0.68:
                out += f"<p>{pick('', '<b>', '<i>')}{sentences(1, 9)}{pick('</p>', '</p>', '</b></p>', '<br>')}"
            elif k < 0.76:
                out += f"<p>{words(1, 3).capitalize()}{pick('.', '')}</p>"
            elif k < 0.83:
                out += f"<h2>{words(1, 6)}</h2>"
            elif k < 0.89:
                out += "<ul>" + "".join(f"<li>{sentences(1, 2)}</li>" for _ in some(1, 4)) + "</ul>"
            elif k < 0.93:
                out += f"<blockquote>{sentences(1, 4)}</blockquote>"
            elif k < 0.96:
                out += f"<p>{sentences(1, 2)} {link()} {sentences(1, 2)}</p>"
            elif k < 0.98:
                out += "<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in some(1, 4)) + "</table>"
            elif not depth:  # an advert or a notice inside the article
                out += "</MARK>" + pick(parts["ad"], parts["notice"], parts["form"], parts["aside"])() + "<MARK>"
        return out

    def misled(inner):
        return f'<div{must("notice-board", "comments-policy", "sidebar-story", "ad-hoc", "related-work", "header-image", "footer-notes", "menu-guide", "share-market", "form-letter")}>{inner}</div>'

    pages = []
    for _ in range(n):
        k = r.random()
        if k < 0.45:
            tag, attr = "article", cls("post", "article", "entry")
        elif k < 0.6:
            tag, attr = "main", cls("content", "main")
        elif k < 0.72:
            tag, attr = "div", must("content", "article-body", "post-content", "entry-content", "story", "main")
        else:  # nothing tells but the text
            tag, attr = pick("div", "section", "td", "center", "div"), pick("", "", f' class="{word()}"', f' id="{word()}"')
        title = pick(f"<h1>{words(3, 10)}</h1>", f"<h1>{words(3, 10)}</h1>", "")
        inner = f"<MARK>{title}{body()}</MARK>".replace("<MARK>", "<section data-main=1>").replace("</MARK>", "</section>")
        inner = re.sub(r"<section data-main=1>\s*</section>", "", inner)
        k = r.random()
        if k < 0.3:  # paragraphs without an element of their own
            inner = re.sub("(?<=<)(/?)p(?=>)", r"\1div", inner)
        elif k < 0.4:
            inner = inner.replace("<p>", "").replace("</p>", "<br><br>")
        if r.random() < 0.25:  # names that mislead
            inner = misled(inner)
        before = [parts[x]() for x in ("header", "nav", "notice", "ad", "aside", "form") if r.random() < 0.45]
        after = [parts[x]() for x in ("comments", "aside", "ad", "form", "nav", "notice") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        foot = parts["footer"]() if r.random() < 0.85 else ""
        if r.random() < 0.25:  # the article and little or nothing else
            before, after, foot = before[: int(r.integers(0, 2))], [], pick("", "", foot)
        if r.random() < 0.3:  # blocks right under the body, or in plain divs: the article has no element of its own
            mine = [pick("p", "p", "div", "div", "section") for _ in range(3)]
            one = r.random() < 0.3
            own = [f"<h1>{words(3, 10)}</h1>"] if r.random() < 0.4 else []
            for _ in some(1, pick(2, 3, 9)):
                t, k = mine[0] if one else pick(*mine[:2]), r.random()
                own.append(f"<{t}>{sentences(1, 5)}{pick('', '', f'<br>{sentences(1, 3)}', f'<br/><br/>{sentences(1, 3)}')}</{t}>" if k < 0.9 else f"<h2>{words(2, 6)}</h2>")
            inner = "".join(f"<section data-main=1>{x}</section>" for x in own)
            if r.random() < 0.2:
                inner = misled(inner)
            if r.random() < 0.35:
                before, after, foot = [], [], ""
            wrap = pick("{}", "{}", "{}", '<div class="wrapper">{}</div>', f'<div class="{word()}">{{}}</div>')
            pages.append("<!DOCTYPE html><html><head><title>x</title></head><body>" + wrap.format("".join(before) + inner + "".join(after)) + foot + pick("</body></html>", ""))
            continue
        wrap = pick("{}", "{}", '<div class="wrapper">{}</div>', "<section>{}</section>", '<div id="page"><div class="container">{}</div></div>')
        pages.append("<!DOCTYPE html><html><head><title>x</title></head><body>" + wrap.format("".join(before) + (f"<table><tr>{pick(chr(0), f'<td>{link()} {link()}</td>')}<td{attr}>{inner}</td></tr></table>".replace(chr(0), "") if tag == "td" else f"<{tag}{attr}>{inner}</{tag}>") + "".join(after)) + foot + pick("</body></html>", ""))
    return pages


def _without_mark(page: list[Block]) -> list[Block]:
    """The marked section is no part of a real page."""
    for b in page:
        if b.main and "section" in b.path:
            k = len(b.path) - 1 - b.path[::-1].index("section")
            b.path = b.path[:k] + b.path[k + 1 :]
    return page


@lru_cache(1)
def trained() -> Chain:
    chain, pages = Chain(), []
    for p in labelled_pages():
        b = _without_mark(blocks(p))
        if b:
            pages.append((features(b), np.array([int(x.main) for x in b])))
    chain.fit(pages)
    return chain


def main_text(chain: Chain, page: str | None) -> str:
    own = blocks(page or "")
    return "\n\n".join(b.text for b, s in zip(own, chain.decode(features(own)), strict=True) if s)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text, blocks parted by an empty line) and n_chars of every row.

    Null or empty html, or a page without main text: the empty text. Repeated rows each give
    a row; null ids and addresses stay; no rows give no rows; other columns play no part. A page of any length
    is read whole, as one chain.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def scan(batches):
        chain = shared.value
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(chain, p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return in_batches(pages).select("page_id", "url", "html").mapInArrow(scan, schema)


def op1_html_extract(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

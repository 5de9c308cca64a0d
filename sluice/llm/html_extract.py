"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks, texts between block-level tags. Each block has features of its ancestors (tags, cue
words in class, id and role), of its text (length, links, punctuation). The field has two labels, article
and other, with weights for features by label and for label pairs. It is trained by gradient steps on the exact
conditional log-likelihood over labelled pages: ``labelled_pages(n, seed)`` writes pages of many layouts together with the label of each
block, ``TRAIN_PAGES`` of them by default. Pages are independent: one map pass, no shuffle.

Output text: article blocks in page order joined by two line feeds, character references decoded, white space inside a block
one space, trimmed. Scripts, styles, titles, form fields and comments never give blocks; formulas, drawings'
labels and fallback texts do.

Defined results: null or empty html gives an empty text; pages without article blocks give an empty text; repeated rows are
alike; broken markup (open tags, stray ends, unfinished comments) is read like browsers do in outline: an open paragraph ends
at the next block, a tag whose quotes never close ends at the next ``>``, and so do those behind it; a page is read once, in time linear
in its length; an empty table gives no rows; columns named as arguments are kept.
"""

from __future__ import annotations

import html as html_lib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 600
EPOCHS = 40
SEED = 7
#: Elements within a line of text (formulas, drawings' labels, and elements that only wrap others among them), elements
#: whose content is never shown as text (scripts, styles, what stands in the head, form fields), elements without content.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mspace mstyle mpadded mphantom semantics annotation mtable mtr mtd "
    "svg g path text tspan object noscript nobr ruby rt rp font picture audio video canvas".split()
)
RAW = frozenset("script style title textarea template iframe select noembed noframes head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_ITSELF = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: Cue words looked for at the start of words of class, id and role.
CUES = (
    "nav menu sidebar aside ad ads advert sponsor promo banner cookie consent gdpr notice alert warning popup modal overlay newsletter "
    "subscribe signup footer header masthead comment disqus reply respond discussion share social related recommend more breadcrumb crumb "
    "pagination pager form login search widget toolbar copyright legal contact tags "
    "article content post entry story main body text page prose"
).split()
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
#: The same without heed to quotes, for a page in which a tag's quotes never close.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*)>", re.DOTALL)
_START = re.compile(r"<[!?/A-Za-z]")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_CUE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _cues(attributes: str) -> tuple[str, ...]:
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _CUE_WORD.findall(m[1] or m[2] or m[3] or ""):
            w = w.lower()
            out.update(c for c in CUES if w == c or (len(c) > 3 and w.startswith(c)))
    return tuple(sorted(out))


class Block:
    __slots__ = ("above", "cues", "links", "tag", "text")

    def __init__(self, text: str, tag: str, above: tuple[str, ...], cues: tuple[str, ...], links: int) -> None:
        self.text, self.tag, self.above, self.cues, self.links = text, tag, above, cues, links


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    links = [0, 0]  # depth of open links, characters of linked text

    def close() -> None:
        text = " ".join(html_lib.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, stack[-1][0] if stack else "", tuple(t for t, _ in stack), tuple({c for _, cs in stack for c in cs}), min(links[1], len(text))))
        pieces.clear()
        links[1] = 0

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            if links[0]:
                links[1] += len(text)

    at, n, token, ended = 0, len(page), _TOKEN, page.rfind(">")
    unclosed: set[str] = set()  # elements whose end is nowhere behind
    while at < n:
        start = _START.search(page, at)
        if not start:
            add(page[at:])
            break
        add(page[at : start.start()])
        m = token.match(page, start.start())
        if not m and token is _TOKEN and start.start() < ended:
            # this tag ends nowhere outside quotes: from here on quotes don't count, so the page is read to its end only once
            token = _LOOSE
            m = token.match(page, start.start())
        if not m:
            if start.start() > ended:  # no tag ends any more: what is left is text, but for what begins as a tag
                add(page[start.start() :])
                break
            add(page[start.start() : start.start() + 1])
            at = start.start() + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        ends = bool(m[1])
        if name in RAW and not ends:
            closing = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            close_at = page.find(">", closing.end()) + 1 if closing else 0
            if not close_at:
                unclosed.add(name)
            if name == "head" and not close_at:  # an open head ends where the body starts
                closing = None if "body" in unclosed else re.compile(r"<body\b", re.IGNORECASE).search(page, at)
                at = closing.start() if closing else at
                if not closing:
                    unclosed.add("body")
            else:
                at = close_at or n
            continue
        if name == "br":
            add(" ")
            continue
        if name in INLINE:
            if name == "a":
                links[0] = 0 if ends else 1
            continue
        close()
        links[0] = 0
        if name in VOID:
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in ENDS_ITSELF:
            if stack and stack[-1][0] in ENDS_ITSELF[name]:
                stack.pop()
        elif stack and stack[-1][0] == "p":
            stack.pop()
        if len(stack) < 512:  # deeper levels keep their text and count for the level above
            stack.append((name, _cues(m[3] or "")))
    close()
    return out


_STRUCTURE = frozenset("article main section aside nav header footer form ul ol li table td blockquote pre figure figcaption h1 h2 h3 h4 p div body button fieldset dl".split())


#: Phrases that furniture uses, looked for in short blocks.
PHRASES = {
    "cookie": ("cookie", "privacy", "consent", "gdpr"),
    "subscribe": ("subscribe", "sign up", "newsletter", "log in", "sign in", "register"),
    "rights": ("©", "copyright", "all rights reserved", "terms of"),
    "advert": ("advert", "sponsored", "promot", "offers", "% off", "buy now"),
    "more": ("read more", "related", "see also", "share this", "follow us", "leave a comment", "reply", "posted by", "skip to"),
}
SHORT = 25


def _says(text: str) -> list[str]:
    low = text.lower()
    return [f"says={k}" for k, v in PHRASES.items() if any(x in low for x in v)]


def features(found: list[Block]) -> list[list[str]]:
    """Names of each block's features."""
    out = []
    for b in found:
        words = b.text.count(" ") + 1
        f = ["bias", f"tag={b.tag if b.tag in _STRUCTURE else '-'}", f"words={min(words.bit_length(), 7)}", f"linked={min(4 * b.links // max(len(b.text), 1), 3)}"]
        f += [f"in={t}" for t in set(b.above) if t in _STRUCTURE and t not in ("p", "div", "body")]
        f += [f"cue={c}" for c in b.cues]
        f.append("stop" if b.text[-1] in ".!?:;\"')…»" else "no stop")
        if not b.cues and not {"article", "main", "aside", "nav", "footer", "header", "form"} & set(b.above):
            f.append("bare")
            if words <= SHORT:  # where no tag or name tells, the words may
                f += _says(b.text)
        out.append(f)
    return out


class Field:
    """Weights: unary[feature, label], pair[label before, label]; label 1 is article."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pair: np.ndarray) -> None:
        self.index, self.unary, self.pair = index, unary, pair

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.unary[[k for x in f if (k := get(x)) is not None]].sum(axis=0) for f in rows])

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Most likely labels, by Viterbi."""
        if not rows:
            return []
        s, p = self.scores(rows).tolist(), self.pair.tolist()
        best, back = s[0], []
        for x in s[1:]:
            a = [best[0] + p[0][0], best[1] + p[1][0]]
            b = [best[0] + p[0][1], best[1] + p[1][1]]
            back.append((int(a[1] > a[0]), int(b[1] > b[0])))
            best = [x[0] + max(a), x[1] + max(b)]
        out = [int(best[1] > best[0])]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def trained(pages: list[tuple[str, list[int]]], epochs: int = EPOCHS, l2: float = 1e-3) -> Field:
    """Fit a field to pages given as (html, labels of blocks) by Adam on the regularised conditional log-likelihood."""
    data = [(features(blocks(h)), np.array(y)) for h, y in pages]
    data = [(f, y) for f, y in data if len(f)]
    for f, y in data:
        if len(f) != len(y):
            raise ValueError("a page's labels differ from its blocks in number")
    index: dict[str, int] = {}
    rows = [[[index.setdefault(x, len(index)) for x in f] for f in fs] for fs, _ in data]
    size = len(index)
    w = np.zeros(2 * size + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    flat = [(np.concatenate([np.full(len(f), i) for i, f in enumerate(fs)]), np.concatenate([np.array(f) for f in fs])) for fs in rows]
    for step in range(1, epochs + 1):
        unary, pair = w[: 2 * size].reshape(size, 2), w[2 * size :].reshape(2, 2)
        g_unary, g_pair = -l2 * unary * len(data), -l2 * pair * len(data)
        for (_, y), (at, k) in zip(data, flat, strict=True):
            n = len(y)
            s = np.zeros((n, 2))
            np.add.at(s, at, unary[k])
            # forward and backward in logarithms
            f, b = np.empty((n, 2)), np.zeros((n, 2))
            f[0] = s[0]
            for i in range(1, n):
                f[i] = s[i] + np.logaddexp(f[i - 1, 0] + pair[0], f[i - 1, 1] + pair[1])
            for i in range(n - 2, -1, -1):
                t = s[i + 1] + b[i + 1]
                b[i] = np.logaddexp(pair[:, 0] + t[0], pair[:, 1] + t[1])
            z = np.logaddexp(*f[-1])
            p = np.exp(f + b - z)
            d = -p
            d[np.arange(n), y] += 1
            np.add.at(g_unary, k, d[at])
            if n > 1:
                joint = np.exp(f[:-1, :, None] + pair + (s + b)[1:, None, :] - z)
                g_pair -= joint.sum(axis=0)
                np.add.at(g_pair, (y[:-1], y[1:]), 1)
        g = np.concatenate([g_unary.ravel(), g_pair.ravel()]) / len(data)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, w[: 2 * size].reshape(size, 2).copy(), w[2 * size :].reshape(2, 2).copy())


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with the label of each leaf block: what the field is trained and tested on."""
    r = random.Random(seed)
    return [_Writer(r).page() for _ in range(n)]


class _Writer:
    """Writes one page; every piece of markup comes with the labels of the blocks it makes."""

    def __init__(self, r: random.Random) -> None:
        self.r, self.close_p, self.br = r, r.random() < 0.8, r.random() < 0.3

    def words(self, a: int, b: int) -> str:
        w = ["".join(self.r.choice("ka ti ro mel san du vi or est an he ing".split()) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(a, b))]
        return " ".join(w)

    def prose(self, a: int = 1, b: int = 60) -> str:
        t = self.words(a, b).capitalize() + self.r.choice([".", ".", ".", "!", "?", "", ","])
        if self.r.random() < 0.2:
            t = f"<b>{t}"
        if self.br and self.r.random() < 0.4:
            t += "<br>"
        if self.r.random() < 0.15:
            t += f' <a href="/{self.r.randint(1, 99)}">{self.words(1, 4)}</a>.'
        return t

    def paragraphs(self, k: int, label: int) -> tuple[str, list[int]]:
        end = "</p>" if self.close_p else ""
        return "".join(f"<p>{self.prose()}{end}" for _ in range(k)), [label] * k

    def links(self, k: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(k))

    def other(self) -> tuple[str, list[int]]:
        """Something that is not the article."""
        r, k = self.r, self.r.randint(1, 6)
        kind = r.choice("nav menu header footer aside sidebar ad ad notice form comments related share crumbs".split())
        if r.random() < 0.15:  # furniture that no tag or class names, only what it says
            said = r.choice(["Sign up now for {}.", "Subscribe to our newsletter {}", "© {} All rights reserved", "Sponsored: {}", "Read more about {}", "We use cookies {}.", "Share this {}", "Log in to {}", "Special offers: {}", "Advertisement {}"])
            tag = r.choice(["div", "div", "p", "section", "div class=\"c1\"", "div id=\"x7\""])
            return f"<{tag}>{said.format(self.words(1, 6))}</{tag.split()[0]}>", [0]
        if kind == "nav":
            return f"<nav><ul>{self.links(k)}</ul></nav>", [0] * k
        if kind == "menu":
            return f'<div class="{r.choice(["menu", "main-menu", "topnav", "navbar"])}"><ul>{self.links(k)}</ul></div>', [0] * k
        if kind == "header":
            tag = r.choice(['header', 'div class="header"', 'div id="masthead"', 'div id="page-header"'])
            return f"<{tag}><h2>{self.words(1, 4)}</h2><p>{self.prose(2, 8)}</p></{tag.split()[0]}>", [0, 0]
        if kind == "footer":
            tag = r.choice(["footer", 'div class="footer"', 'div id="site-footer"'])
            return f"<{tag}>{r.choice(['&copy; ', '© ', ''])}{self.words(2, 12)}. {self.prose(1, 12)}</{tag.split()[0]}>", [0]
        if kind in ("aside", "sidebar"):
            tag = "aside" if kind == "aside" else r.choice(['div class="sidebar"', 'div id="sidebar-right"', 'section class="widget"'])
            body, y = self.paragraphs(r.randint(1, 2), 0)
            return f"<{tag}><h3>{self.words(1, 3)}</h3>{body}</{tag.split()[0]}>", [0, *y]
        if kind == "ad":
            body = r.choice([lambda: self.prose(2, 30), lambda: f"<p>{self.prose(2, 30)}</p>"])()
            return f'{r.choice(["", "<!-- banner " + self.words(1, 2) + " -->"])}<div {r.choice(["class", "id"])}="{r.choice(["ad", "ads", "advert", "ad-box", "advertisement", "sponsored", "promo", "banner"])}">{body}</div>', [0]
        if kind == "notice":
            tag = r.choice(['div class="cookie-notice"', 'div id="cookie-consent"', 'div class="notice"', 'div role="alert"', 'div class="popup"', 'section class="newsletter"'])
            return f"<{tag}><p>{self.prose(4, 30)}</p><button>{self.words(1, 2)}</button></{tag.split()[0]}>", [0, 0]
        if kind == "form":
            return f'<form action="/x"><p>{self.prose(1, 9)}</p><label>{self.words(1, 3)}</label><input name="q"><button>{self.words(1, 2)}</button></form>', [0, 0, 0]
        if kind == "comments":
            tag = r.choice(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div id="disqus_thread"', 'div class="discussion"'])
            if tag.startswith("ol"):
                return f"<{tag}>" + "".join(f"<li>{self.prose(3, 40)}</li>" for _ in range(k)) + "</ol>", [0] * k
            body, y = self.paragraphs(k, 0)
            return f"<{tag}><h3>{self.words(1, 2)}</h3>{body}</{tag.split()[0]}>", [0, *y]
        if kind == "related":
            return f'<div class="{r.choice(["related", "recommended", "read-more"])}"><ul>{self.links(k)}</ul></div>', [0] * k
        if kind == "share":
            return f'<div class="{r.choice(["share", "social-links", "tags"])}"><a href="/s">{self.words(1, 2)}</a> <a href="/t">{self.words(1, 2)}</a></div>', [0]
        return f'<div class="breadcrumb"><a href="/">{self.words(1, 1)}</a> &gt; <a href="/b">{self.words(1, 2)}</a></div>', [0]

    def article(self) -> tuple[str, list[int]]:
        r, out, y = self.r, [], []
        if r.random() < 0.1:  # an article may speak of such things at length
            out.append(f"<p>{self.prose(14, 40)} {r.choice(['cookies', 'the copyright', 'offers', 'a newsletter', 'to subscribe'])} {self.prose(14, 40)}</p>")
            y.append(1)
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(1, 12)}</h1>")
            y.append(1)
        for _ in range(r.randint(1, 6)):
            kind = r.random()
            if kind < 0.62:
                body, more = self.paragraphs(r.randint(1, 4), 1)
            elif kind < 0.72:
                body, more = f"<h{(k := r.randint(2, 4))}>{self.words(1, 8)}</h{k}>", [1]
            elif kind < 0.78:
                k = r.randint(1, 5)
                body, more = "<ul>" + "".join(f"<li>{self.prose(1, 15)}</li>" for _ in range(k)) + "</ul>", [1] * k
            elif kind < 0.82:
                body, more = f"<blockquote>{self.prose(3, 30)}</blockquote>", [1]
            elif kind < 0.86:
                body, more = f"<div>{self.prose(3, 50)}</div>", [1]
            elif kind < 0.89:
                body, more = f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>", [1, 1]
            elif kind < 0.91:
                body, more = f"<pre>{self.words(2, 20)}</pre>", [1]
            else:
                body, more = self.other()
            out.append(body)
            y += more
        tag = r.choice(["article", "article", "article", "main", "div", 'div class="col-8"', 'td', 'div class="content"', 'div class="post-body"', 'div id="main-content"', 'section class="story"', 'div class="entry"', ""])
        return (f"<{tag}>{''.join(out)}</{tag.split()[0]}>" if tag else "".join(out)), y

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        pieces = [self.other() for _ in range(r.randint(0, 4))] + [self.article()] * (r.random() < 0.97) + [self.other() for _ in range(r.randint(0, 4))]
        style = r.choice(["", f"<style>.{self.words(1, 1)}{{color:#{r.randint(100, 999)}}}</style>", '<link rel="stylesheet" href="/a.css"><meta name="d" content="x > y">'])
        head = f"{r.choice(['<!DOCTYPE html>', ''])}<html><head><title>{self.words(1, 8)}</title>{style}</head><body>"
        script = r.choice(["", "<script>if (a < b && c > d) document.write('<p>' + x + '</p>');</script>", f"<noscript></noscript><script type='text/javascript'>/* {self.words(2, 5)} */</script>"])
        return head + script + "".join(p for p, _ in pieces) + ("</body></html>" if r.random() < 0.7 else ""), [x for _, y in pieces for x in y]


def main_text(page: str, field: Field) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def extracted(pages: DataFrame, *keep: str, field: Field | None = None) -> DataFrame:
    """Kept columns, text and n_chars: one row per row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained(labelled_pages()))
    slim = pages.select(*keep, F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h, shared.value) for h in part.column("_html").to_pylist()]
                columns = {k: part.column(k) for k in keep} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_html"), "text string", "n_chars long"])
    return slim.mapInArrow(run, schema)

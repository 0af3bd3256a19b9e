"""Main text of web pages: a conditional random field over the leaf blocks of the document.

A page becomes a row of blocks, the stretches of text between block-level tags,
each with the tags, classes and ids it lies in. Features of ancestors and of the
text (length, share of links, ending) label each block as content or not; the model is
trained on labelled pages of many layouts, made by rule from a seed, and decoded
by Viterbi in NumPy batches of pages.

Scripts, styles, controls, embedded drawings, comments and the head never become blocks;
formulas and what stands in for scripts, media and objects do, as the text around them. A
head ends, as in browsers, at its end tag or before the first tag or text that cannot
stand in it. Character references are decoded once, in text.

Defined cases: a null or empty html has an empty text; malformed markup is read as
browsers do in the common cases (an open paragraph ends where another block begins,
unknown end tags are ignored). Repeated rows come back as often as they stand; empty
input gives empty output; pages of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from trovelight.llm import crf
from trovelight.llm.common import col

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template svg iframe head title textarea select button datalist".split())
#: What may stand in a head.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
KEEPS_P = BLOCKS - {"p"} | {"object"}
#: Start tags that end an open element of the same kind, up to the container that separates them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
AREAS = ("nav", "aside", "footer", "header", "form", "dialog", "menu", "article", "main", "section", "blockquote", "figure", "table")
FURNITURE = frozenset("nav aside footer form dialog menu".split())
#: Words in classes, ids and roles that tell what an element holds.
CUES = {
    "ad": "ad ads adv advert advertisement adverts banner promo promotion sponsor sponsored",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header masthead topbar logo branding toolbar",
    "side": "sidebar side aside widget rail complementary",
    "note": "cookie cookies consent notice gdpr popup modal alert overlay dialog warning",
    "talk": "comment comments reply replies respond discussion disqus feedback",
    "more": "related recommended share sharing social newsletter subscribe signup trending tags",
    "form": "form search login contact",
    "text": "article content post entry story body main text prose",
}
CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}
NAME = re.compile(r"[a-z]+")
SLOTS = 12


class Place(NamedTuple):
    """What the open elements say of a block inside them. Each element adds to the place of its parent, so a path costs the same at any depth."""

    block: str | None = None  # the innermost block tag
    area: str | None = None
    cue: str | None = None
    bad_cue: str | None = None
    bad_tag: str | None = None
    inner: bool = False  # inside an article, a main or what is named a text
    below_tag: str | None = None  # furniture inside the innermost of these
    below_cue: str | None = None

    def inside(self, tag: str, cues: frozenset[str]) -> Place:
        order = sorted(cues)
        bad = [c for c in order if c != "text"][-1:]
        inner = tag in ("article", "main") or "text" in cues
        return Place(
            tag if tag in BLOCKS else self.block,
            tag if tag in AREAS else self.area,
            order[-1] if order else self.cue,
            bad[0] if bad else self.bad_cue,
            tag if tag in FURNITURE or tag == "header" else self.bad_tag,
            inner or self.inner,
            None if inner else tag if tag in FURNITURE else self.below_tag,
            None if inner else bad[0] if bad else self.below_cue,
        )


@dataclass
class Block:
    place: Place
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Reader(HTMLParser):
    """Collects blocks; the stack holds open elements with the cues of their attributes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, Place]] = []
        self.held: Counter[str] = Counter()  # open elements by tag
        self.silent = self.links = 0
        self.blocks: list[Block] = []
        self.open: Block | None = None

    def _push(self, tag: str, attrs: list) -> None:
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label")).lower()
        above = self.stack[-1][1] if self.stack else Place()
        self.stack.append((tag, above.inside(tag, frozenset(CUE_OF[w] for w in NAME.findall(names) if w in CUE_OF))))
        self.held[tag] += 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def _pop(self, n: int) -> None:
        for tag, _ in self.stack[n:]:
            self.held[tag] -= 1
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.stack[n:]

    def _unwind(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        if not any(self.held[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in stop:
                return
            if self.stack[i][0] in tags:
                self._pop(i)
                return

    def _end_head(self) -> None:
        """Close an open head, unless an element inside it, other than noscript, holds what comes."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "head":
                self._pop(i)
                self.open = None
            elif self.stack[i][0] != "noscript":
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and tag not in HEAD:
            self._end_head()
        if tag == "head" and (self.held["head"] or self.held["body"]):
            return
        if tag == "body":
            self._unwind({"head"}, frozenset())
        if tag in BLOCKS:
            self.open = None
            # An object keeps the paragraph it stands in open.
            self._unwind({"p"}, KEEPS_P)
            if tag in CLOSES:
                self._unwind(*CLOSES[tag])
        elif tag == "br" and self.open:
            self.open.parts.append(" ")
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag and tag not in BLOCKS:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.open = None
        # An inline end tag does not reach beyond its block; the stack is searched from its top.
        self._unwind({tag}, frozenset() if tag in BLOCKS or tag in SILENT else BLOCKS)

    def handle_data(self, data: str) -> None:
        if self.silent and not data.isspace():
            self._end_head()
        if self.silent or not data:
            return
        if self.open is None:
            if data.isspace():
                return
            self.open = Block(self.stack[-1][1] if self.stack else Place())
            self.blocks.append(self.open)
        self.open.parts.append(data)
        self.open.linked += len(data) if self.links else 0


def blocks(page: str) -> list[Block]:
    reader = Reader()
    reader.feed(page)
    reader.close()
    return [b for b in reader.blocks if b.text()]


def _bucket(n: int, edges: tuple[int, ...]) -> str:
    return str(sum(n >= e for e in edges))


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        at, text = b.place, b.text()
        below = at.below_cue or at.below_tag
        bad = at.bad_tag or at.bad_cue
        n = len(text.split())
        out.append(
            [
                "tag:" + (at.block or "-"),
                "area:" + (at.area or "-"),
                "cue:" + (at.cue or "-"),
                "bad:" + (bad or "-"),
                f"within:{at.inner}:{bool(below)}",
                "below:" + (below or "-"),
                "words:" + _bucket(n, (2, 4, 8, 15, 30, 60)),
                "links:" + _bucket(int(10 * b.linked / max(1, len(text))), (1, 4, 8)),
                f"end:{text[-1] in '.!?:;'}",
                f"copy:{'©' in text or '(c)' in text.lower()}",
                f"bare:{at.inner}:{bool(bad)}:{at.block or '-'}:{_bucket(n, (4, 15))}",
                "first" if i == 0 else "last" if i == len(page) - 1 else "mid",
            ]
        )
    return out


def labelled(n: int = 260, seed: int = 3) -> Iterator[tuple[str, dict[str, bool]]]:
    """Training pages: html, and for each block's text whether it is content."""
    r = random.Random(seed)
    used: set[str] = set()

    def words(low: int, high: int, stop: str = ".") -> str:
        while True:
            text = " ".join("".join(r.choice("aeioubdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(low, high))).capitalize() + stop
            if text not in used:
                used.add(text)
                return text

    for _ in range(n):
        truth: dict[str, bool] = {}

        def say(good: bool, low: int = 1, high: int = 40, stop: str = ".", truth=truth) -> str:
            text = words(low, high, stop)
            truth[text] = good
            return html.escape(text)

        def body(inside: bool, say=say) -> str:
            good = [f"<h1>{say(True, 2, 10, '')}</h1>"]
            for _ in range(r.randint(1, 9)):
                good.append(
                    r.choice(
                        [
                            lambda: f"<p>{say(True, 1, 60)}</p>",
                            lambda: f"<p>{say(True, 1, 3)}</p>",
                            lambda: f"<p><b>{say(True, 3, 20)}<br><p>{say(True, 1, 30)}</p>",
                            lambda: f"<p>{say(True, 1, 60)}</p><p>{say(True, 8, 30)}</p>",
                            lambda: f"<h2>{say(True, 1, 6, '')}</h2><p>{say(True, 4, 50)}</p>",
                            lambda: f"<ul><li>{say(True, 2, 9)}</li><li>{say(True, 2, 9)}</li></ul>",
                            lambda: f"<blockquote><p>{say(True, 5, 30)}</p></blockquote>",
                            lambda: f"<div>{say(True, 10, 50)}</div>",
                            lambda: f"<p>{say(True, 5, 40)}</p>",
                        ]
                    )()
                )
                if inside and r.random() < 0.25:
                    good.append(
                        r.choice(
                            [
                                lambda: f'<div class="{r.choice(["ad", "ads", "advert", "promo banner"])}">{say(False, 2, 30)}</div>',
                                lambda: f"<aside><p>{say(False, 2, 30)}</p></aside>",
                                lambda: f'<div class="{r.choice(["share", "related", "newsletter", "social"])}"><p>{say(False, 2, 20)}</p></div>',
                                lambda: f'<form class="signup"><label>{say(False, 1, 8, "")}</label></form>',
                                lambda: f'<nav><a href="#">{say(False, 1, 3, "")}</a></nav>',
                                lambda: f'<div class="notice">{say(False, 3, 20)}</div>',
                            ]
                        )()
                    )
            if inside and r.random() < 0.3:
                good.append(f'<section class="comments"><h3>{say(False, 1, 3, "")}</h3>' + "".join(f'<div class="comment"><p>{say(False, 2, 40)}</p></div>' for _ in range(r.randint(1, 4))) + "</section>")
            return "".join(good)

        def menu(say=say) -> str:
            items = "".join(f'<li><a href="/">{say(False, 1, 2, "")}</a></li>' for _ in range(r.randint(2, 6)))
            return r.choice(["<nav><ul>{}</ul></nav>", '<ul class="menu">{}</ul>', '<div id="nav"><ul>{}</ul></div>', '<div role="navigation"><ul>{}</ul></div>']).format(items)

        before = [
            menu,
            lambda: f"<header><h2>{say(False, 1, 5, '')}</h2></header>",
            lambda: f'<div class="header"><div>{say(False, 1, 8, "")}</div></div>',
            lambda: f'<div class="{r.choice(["ad", "advertisement", "banner"])}">{say(False, 2, 40)}</div>',
            lambda: f'<div class="{r.choice(["cookie-notice", "consent", "alert"])}"><p>{say(False, 4, 30)}</p></div>',
            lambda: f'<form action="/s"><p>{say(False, 1, 6, "")}</p></form>',
        ]
        after = [
            menu,
            lambda: f'<aside><h3>{say(False, 1, 4, "")}</h3><p>{say(False, 4, 40)}</p></aside>',
            lambda: f'<div class="{r.choice(["sidebar", "widget"])}"><p>{say(False, 3, 40)}</p><p>{say(False, 3, 10)}</p></div>',
            lambda: f'<div class="{r.choice(["ad", "sponsored"])}">{say(False, 2, 40)}</div>',
            lambda: f'<section id="comments"><p>{say(False, 2, 40)}</p><p>{say(False, 1, 40)}</p></section>',
            lambda: f'<div class="related"><ul><li><a href="/r">{say(False, 3, 9, "")}</a></li></ul></div>',
        ]
        ends = [
            lambda: f"<footer>&copy; {say(False, 3, 30)}</footer>",
            lambda: f"<footer><p>{say(False, 3, 40)}</p></footer>",
            lambda: f'<div class="footer">{say(False, 2, 30)}</div>',
            lambda: "",
        ]
        shell = r.choice(["<article>{}</article>"] * 4 + ["<main><article>{}</article></main>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="article-body">{}</div>', '<div class="entry">{}</div>', "<div>{}</div>", "<div><div>{}</div></div>"])
        parts = [f() for f in r.sample(before, r.randint(0, 4))] + [shell.format(body(shell not in ("<div>{}</div>", "<div><div>{}</div></div>")))] + [f() for f in r.sample(after, r.randint(0, 3))] + [r.choice(ends)()]
        title = "<title>x</title><style>p{}</style><script>var a='</p>';</script>"
        yield f"<!DOCTYPE html><html><head>{title}</head><body>{''.join(parts)}</body></html>", truth


def labelled_blocks(n: int = 260, seed: int = 3) -> tuple[list[list[list[str]]], list[list[str]]]:
    rows, tags = [], []
    for page, truth in labelled(n, seed):
        found = blocks(page)
        # A footer's sign stands before the text that is known.
        rows.append(features(found))
        tags.append(["C" if truth.get(b.text().removeprefix("© "), False) else "O" for b in found])
    return rows, tags


@lru_cache(maxsize=1)
def model() -> crf.Model:
    """Trained once per process on pages made by rule; the same cost for any corpus."""
    rows, tags = labelled_blocks()
    return crf.train(rows, tags, ("O", "C"), rounds=120)


def main_texts(pages: list[str], trained: crf.Model) -> list[str]:
    parsed = [blocks(p) for p in pages]
    labels = crf.decode([features(p) for p in parsed], trained, SLOTS)
    return ["\n".join(b.text() for b, x in zip(p, row, strict=True) if x == "C") for p, row in zip(parsed, labels, strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    trained = model()
    slim = pages.select(*(col(pages, c).alias(c) for c in ("page_id", "url", "html")))
    kind = slim.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = main_texts([x or "" for x in part.column(2).to_pylist()], trained)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return slim.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

"""Main text of web pages: boosted trees over DOM nodes, decoded so that the tree agrees with itself.

Every element and every run of text is a node with features of its own (tag, attribute tokens,
depth), of its subtree (text, links and tags, their densities, paragraphs) and of its place among
its siblings. Boosted trees give each node log-odds of holding main text. Decoding maximises the sum
over all nodes under one rule, that nothing below a rejected node is kept: bottom-up, a node is
worth the better of "rejected, with all below it" and "kept, with each child at its best".

The trees are fitted here, on pages written by a small layout grammar whose words come from some
``TRAIN_PAGES`` of the pages at hand: the layouts carry the labels (article parts against menus,
headers, footers, sidebars, notices, adverts, forms, comments).

Defined results: null or empty html, and pages without main text, give the empty text; equal rows
get equal texts; an empty table gives an empty result; other columns are ignored. Pages are taken
one by one in the scan, whole: no shuffle, no group.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from caselake.llm import boosting
from caselake.llm.arrow import drawn, texts
from caselake.llm.dom import Node, attributes, parse

TRAIN_PAGES, TRAIN_CHARS, LAYOUTS = 200, 4000, 600
TAGS = ["#text", "article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "nav", "aside", "header", "footer", "form",
        "table", "blockquote", "body"]
# Attribute tokens by what they usually mark (fixed values).
TOKENS = {
    "body": ["article", "body", "content", "entry", "main", "page", "post", "story", "text"],
    "menu": ["breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "pagination", "tabs", "toc"],
    "edge": ["banner", "bottom", "copyright", "foot", "footer", "head", "header", "masthead", "top"],
    "side": ["aside", "rail", "recommended", "related", "sidebar", "widget"],
    "sale": ["ad", "ads", "advert", "advertisement", "promo", "promotion", "sponsor", "sponsored"],
    "note": ["alert", "consent", "cookie", "cookies", "gdpr", "modal", "newsletter", "notice", "popup", "subscribe"],
    "talk": ["comment", "comments", "discussion", "disqus", "replies", "reply", "respond", "thread"],
    "tool": ["form", "login", "search", "share", "sharing", "signup", "social", "toolbar"],
}
TAG = {t: i for i, t in enumerate(TAGS)}
KIND = {t: i for i, ts in enumerate(TOKENS.values()) for t in ts}
CHUNK_NODES = 50_000


@lru_cache(maxsize=20_000)
def marks(attrs: str) -> int:
    """The kinds of attribute tokens that a tag has, and whether it is hidden, as bits."""
    out = 0
    if attrs.strip():
        found = attributes(attrs)
        for name in ("class", "id", "role", "itemprop", "aria-label"):
            for word in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found.get(name, "")).lower()):
                if word in KIND:
                    out |= 1 << KIND[word]
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            out |= 1 << len(TOKENS)
    return out


def bits(masks: list[int], n: int) -> np.ndarray:
    return (np.array(masks, np.int64)[:, None] >> np.arange(n)) & 1


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    text, link, stops, paras, items, tags, deepest = ([0] * n for _ in range(7))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.text is not None:
            text[i], link[i] = len(node.text), node.linked
            stops[i] = node.text.count(".") + node.text.count(",")
        tags[i] += 1
        paras[i] += node.tag == "p"
        items[i] += node.tag == "li"
        p = node.parent
        if p >= 0:
            text[p] += text[i]
            link[p] += link[i]
            stops[p] += stops[i]
            paras[p] += paras[i]
            items[p] += items[i]
            tags[p] += tags[i]
            deepest[p] = max(deepest[p], deepest[i] + 1)
    own, tag = [marks(x.attrs) for x in nodes], [1 << TAG[x.tag] if x.tag in TAG else 0 for x in nodes]
    above, over, place, among, share = [0] * n, [0] * n, [0] * n, [1] * n, [1.0] * n
    for i, node in enumerate(nodes):
        p = node.parent
        if p >= 0:
            above[i], over[i] = above[p] | own[p], over[p] | tag[p]
        for k, child in enumerate(node.children):
            place[child], among[child], share[child] = k, len(node.children), text[child] / max(text[i], 1)
    said = np.array([len(x.text or "") for x in nodes])
    text, tags, paras, items = (np.array(a, float) for a in (text, tags, paras, items))
    some, whole = np.maximum(text, 1), max(text[0], 1)
    shape = np.stack([np.array([x.depth for x in nodes]), text, tags, text / tags, np.array(link) / some,
                      np.array(stops) / some * 100, paras, items, np.array(deepest), text / whole, (np.cumsum(said) - said) / whole,
                      text / np.maximum(paras + items, 1), np.array(place), np.array(among),
                      (np.array(place) + 1) / np.array(among), np.array(share)], axis=1)
    kinds = len(TOKENS) + 1
    return np.concatenate([shape, bits(tag, len(TAGS)), bits(over, len(TAGS)), bits(own, kinds), bits(above, kinds)], axis=1)


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """The labelling of highest total log-odds in which nothing below a rejected node is kept."""
    worth = score.copy()  # kept, with every child at its best; rejecting a whole subtree is worth 0
    for i in range(len(nodes) - 1, 0, -1):
        worth[nodes[i].parent] += max(worth[i], 0.0)
    kept = [False] * len(nodes)
    for i, node in enumerate(nodes):
        kept[i] = worth[i] > 0 and (node.parent < 0 or kept[node.parent])
    return kept


def main_text(nodes: list[Node], score: np.ndarray) -> str:
    return "\n".join(x.text for x, k in zip(nodes, decode(nodes, score)) if k and x.text is not None)


class _Layout:
    """One random page with labels: main text stands between two control characters."""

    def __init__(self, rng: random.Random, words: list[str]) -> None:
        self.rng, self.words = rng, words

    def said(self, low: int, high: int) -> str:
        n, at = self.rng.randint(low, high), self.rng.randrange(max(1, len(self.words) - high))
        return " ".join(self.words[at:at + n]) or "word"

    def one(self, *options: str) -> str:
        return self.rng.choice(options)

    def el(self, tag: str, inner: str, kind: str | None = None) -> str:
        names = TOKENS[kind] if kind else []
        attr = f' {self.one("class", "class", "id")}="{self.rng.choice(names)}"' if names and self.rng.random() < 0.85 else ""
        return f"<{tag}{attr}>{inner}" + ("" if tag in ("p", "li") and self.rng.random() < 0.1 else f"</{tag}>")

    def links(self, n: int) -> str:
        return self.el(self.one("ul", "ol", "div"), "".join(
            self.el("li", f'<a href="/x">{self.said(1, 3)}</a>') for _ in range(n)))

    def noise(self, place: str) -> str:
        r = self.rng
        if place == "menu":
            return self.el(self.one("nav", "nav", "div", "header"), self.links(r.randint(3, 12)), "menu")
        if place == "edge":
            return self.el(self.one("header", "div"), self.one("", self.el("h1", self.said(1, 4))) + self.el("p", self.said(2, 8)), "edge")
        if place == "foot":
            return self.el(self.one("footer", "footer", "div"), self.one(f"&copy; {self.said(3, 12)}.", self.el("p", self.said(4, 20)) + self.links(4)), "edge")
        if place == "side":
            return self.el(self.one("aside", "div", "section"), self.el("h3", self.said(1, 4)) + self.one(self.links(6), self.el("p", self.said(5, 30))), "side")
        if place == "sale":
            return self.el(self.one("div", "div", "aside", "section"), self.one(self.said(3, 25), self.el("p", self.said(3, 25))), "sale")
        if place == "note":
            return self.el(self.one("div", "section", "aside"), self.el("p", self.said(5, 30)), "note")
        if place == "tool":
            return self.el("form", self.el("p", self.said(1, 6)) + '<input name="q"><button>go</button>', self.one("tool", "note"))
        comments = "".join(self.el(self.one("div", "li", "p"), self.el("p", self.said(3, 50)), self.one("talk", "talk", "edge"))
                           for _ in range(r.randint(1, 6)))
        return self.el(self.one("div", "section", "ol", "ul"), self.one("", self.el("h3", self.said(1, 3))) + comments, "talk")

    def article(self) -> str:
        r, parts = self.rng, []
        title = self.el("h1", f"\x02{self.said(3, 12)}\x03")
        parts.append(self.one(title, title, f"<header>{title}</header>", ""))
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            text = f"\x02{self.said(*r.choice([(1, 6), (15, 90), (40, 250)]))}\x03"
            tag = r.choice(["p"] * 12 + ["h2", "blockquote", "li", "pre", "div"])
            parts.append(f"<ul><li>{text}</li></ul>" if tag == "li" else self.one(
                self.el(tag, text), self.el(tag, text), f"<{tag}><b>{text}<br>" if tag == "p" else self.el(tag, text)))
            if r.random() < 0.06:
                parts.append(self.noise(self.one("sale", "side", "tool")))
        inner = "".join(parts)
        shape = r.randrange(5)
        if shape == 0:
            return self.el("article", inner)
        if shape == 1:
            return self.el("main", self.el("article", inner, "body"))
        if shape == 2:
            return self.el("div", inner, "body")
        return self.el("div", self.el(self.one("div", "section", "article"), inner, "body"), self.one("body", "body", "edge") if shape == 3 else None)

    def page(self) -> str:
        r = self.rng
        before = [self.noise(p) for p in ("menu", "edge", "sale", "note", "tool", "side") if r.random() < 0.45]
        after = [self.noise(p) for p in ("talk", "side", "sale", "menu", "foot", "note", "tool") if r.random() < 0.45]
        r.shuffle(before)
        inner = "".join(before) + (self.article() if r.random() < 0.95 else "") + "".join(after)
        if r.random() < 0.3:
            inner = f'<div class="{self.one("page", "wrapper", "site", "container")}">{inner}</div>'
        return f"<html><head><title>{self.said(2, 6)}</title></head><body>{inner}</body></html>"


def fit(pages: DataFrame) -> boosting.Trees:
    """Trees fitted on LAYOUTS labelled pages; some TRAIN_PAGES rows of ``pages`` lend their words."""
    rows = sorted(drawn(pages.where("html IS NOT NULL"), TRAIN_PAGES, F.xxhash64("page_id", "html"))
                  .select(F.substring("html", 1, TRAIN_CHARS).alias("html")).collect())
    words = [w for r in rows for x in parse(r.html) if x.text for w in x.text.split() if "<" not in w and "&" not in w]
    layouts = _Layout(random.Random(7), words or ["word"] * 400)
    x, y = [], []
    for _ in range(LAYOUTS):
        nodes = parse(layouts.page())
        good = np.zeros(len(nodes), bool)
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].text and "\x02" in nodes[i].text:
                good[i] = True
                nodes[i].text = nodes[i].text.strip("\x02\x03")
            if nodes[i].parent >= 0:
                good[nodes[i].parent] |= good[i]
        x.append(features(nodes))
        y.append(good)
    return boosting.fit(np.concatenate(x), np.concatenate(y).astype(float))


def extract(pages: DataFrame, trees: boosting.Trees) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(trees)  # a fixed number of trees of a fixed depth
    out = StructType([pages.schema["page_id"], pages.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[str] = []
            held: list[list[Node]] = []

            def settle() -> None:
                if held:
                    score = sent.value.score(np.concatenate([features(x) for x in held]))
                    at = 0
                    for x in held:
                        done.append(main_text(x, score[at:at + len(x)]))
                        at += len(x)
                    held.clear()

            size = 0
            for page in texts(batch.column("html")):
                held.append(parse(page))
                size += len(held[-1])
                if size >= CHUNK_NODES:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(done, pa.string()),
                 pa.array([len(t) for t in done], pa.int64())], names=out.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, out)

"""A tolerant reading of HTML into a flat list of nodes: elements, and runs of text as leaves."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed values of the HTML standard, as far as they matter for blocks of text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe"}
# Not text of a page either, but they hold ordinary tags, and only what their own end tag closes is theirs.
ASIDE = {"noscript", "template", "svg", "select", "button"}
ASIDE_TAG = re.compile(rf"<(?:{'|'.join(sorted(ASIDE))})\b", re.IGNORECASE)
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in RAW}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
            "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
            "table", "ul"}
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
SCOPE = {"html", "body", "table", "td", "th", "article", "section", "div", "main", "aside", "nav", "header", "footer", "form"}


@dataclass(slots=True)
class Node:
    """``text`` is set on leaves only; ``end`` is one past the last descendant in the list."""

    tag: str
    parent: int
    depth: int
    attrs: str = ""
    text: str | None = None
    end: int = 0
    linked: int = 0
    children: list[int] = field(default_factory=list)


def tag_of(m: re.Match) -> tuple[str, bool, str]:
    """Name (empty for what isn't an element's tag), whether it closes, and attributes of a token."""
    return (m[2] or m[5] or "").lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""


def aside_ends(page: str) -> dict[int, int]:
    """Where each element of ASIDE that its own end tag closes begins and ends.

    One ends without it when an element around it ends, or a second button or select begins.
    """
    if not ASIDE_TAG.search(page):
        return {}
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}

    def cut(to: int) -> None:
        for name, _ in stack[to:]:
            open_[name] -= 1
        del stack[to:]

    def nearest(name: str) -> int:
        return next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)

    at, n = 0, len(page)
    while (begin := page.find("<", at)) >= 0:
        m = TOKEN.match(page, begin)
        if not m:
            at = begin + 1
            continue
        at = m.end()
        name, closing, attrs = tag_of(m)
        if not name or name in INLINE or name in VOID:
            continue
        if closing:
            if open_.get(name):
                i = nearest(name)
                if name in ASIDE:
                    ends[stack[i][1]] = at
                cut(i)
            continue
        if attrs.endswith("/") and (name == "svg" or open_.get("svg")):
            continue  # in a drawing, and for its own tag, this is the whole element
        if name in RAW:
            stop = RAW_END[name].search(page, at)
            at = stop.end() if stop else n
            continue
        if name in ("button", "select") and open_.get(name):
            cut(nearest(name))
        stack.append((name, begin))
        open_[name] = open_.get(name, 0) + 1
    return ends


def parse(page: str) -> list[Node]:
    """Nodes in page order; the first is the root. Inline elements leave no node, only their text."""
    nodes = [Node("#root", -1, 0)]
    stack, run, links, in_link = [0], [], 0, 0

    def flush() -> None:
        nonlocal links
        said = " ".join(html.unescape("".join(run)).split()) if run else ""
        run.clear()
        if said:
            top = stack[-1]
            nodes[top].children.append(len(nodes))
            nodes.append(Node("#text", top, nodes[top].depth + 1, text=said, linked=min(links, len(said))))
        links = 0

    def close(names: set[str], limits: set[str]) -> None:
        """Close the nearest open element of ``names``, with all inside it, unless a limit comes first."""
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in names:
                flush()
                del stack[i:]
                return
            if tag in limits:
                return

    def said(part: str) -> None:
        nonlocal links
        run.append(part)
        if in_link:
            links += len(part)

    ends = aside_ends(page)
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            said(page[at:])
            break
        if begin > at:
            said(page[at:begin])
        m = TOKEN.match(page, begin)
        if not m:
            said("<")
            at = begin + 1
            continue
        at = m.end()
        name, closing, attrs = tag_of(m)
        if not name:
            continue
        if at == n and page[-1] != ">":
            break  # the page ends inside a tag
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            elif name == "br":
                run.append(" ")
            continue
        if name in ASIDE:  # one that nothing closes leaves no node, only what follows it
            at = ends.get(begin, at)
            if name in ("button", "select"):
                flush()
            continue
        if closing:
            in_link = 0
            close({name}, set())
            continue
        if name in RAW:
            stop = RAW_END[name].search(page, at)
            at = stop.end() if stop else n
            if name == "textarea":
                flush()
            continue
        flush()
        in_link = 0
        if name in CLOSES_P:
            close({"p"}, SCOPE)
        if name in SIBLING:
            close(*SIBLING[name])
        if name in VOID:
            continue
        top = stack[-1]
        nodes[top].children.append(len(nodes))
        nodes.append(Node(name, top, nodes[top].depth + 1, attrs))
        stack.append(len(nodes) - 1)
    flush()
    for i in range(len(nodes) - 1, -1, -1):
        nodes[i].end = max(nodes[i].end, i + 1)
        if nodes[i].parent >= 0:
            nodes[nodes[i].parent].end = max(nodes[nodes[i].parent].end, nodes[i].end)
    return nodes


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}

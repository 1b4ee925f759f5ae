"""Elements of a web page as a tree with numbered text runs.

Lenient as browsers are with what occurs in the wild: tags left open, closed twice or in the wrong order, missing ``html`` or ``body``, raw
text in scripts and styles, comments that never end. Elements that change nothing about the page's layout (``b``, ``span`` without
attributes and so on) are no nodes; their text belongs to the node around them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names with a meaning of their own in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: Elements whose text is never shown as running text.
HIDDEN = RAW | frozenset("audio button canvas datalist head map math object optgroup option select svg template video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
#: A start tag closes open elements of these names, up to the nearest element that bounds it.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"),
    "tfoot": ("tr", "td", "th", "thead", "tbody", "tfoot"), "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",),
}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</[A-Za-z][^>]*(?:>|\Z)"
    # a quote counts after an equals sign only, and only if it is closed
    r"|<([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[^\s/>]*")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_NAMES = ("class", "id", "role", "itemprop", "data-label")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    block: bool
    hidden: bool
    words: list[str] = field(default_factory=list)
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass(slots=True)
class Page:
    """``nodes`` in page order, the root first; ``runs`` are (node, text, whether a link) and None where a block begins or ends."""

    nodes: list[Node]
    runs: list[tuple[int, str, bool] | None]


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(max(values, key=len)))
    return out


def name_words(attributes: dict[str, str]) -> list[str]:
    """Lower-case words of class, id and role, split where case changes: ``siteNav-left`` has site, nav and left."""
    text = " ".join(attributes.get(n, "") for n in _NAMES[:-1])
    return sorted({w.lower() for w in _WORD.findall(text)})


def parse(source: str) -> Page:
    nodes = [Node("#root", -1, 0, True, False)]
    runs: list[tuple[int, str, bool] | None] = []
    # open elements: (name, its node or that around it, whether it opened a node, links open)
    stack: list[tuple[str, int, bool, int]] = [("#root", 0, True, 0)]
    opened: Counter[str] = Counter()

    def close(to: int) -> None:
        while len(stack) > to:
            name, node, own, _ = stack.pop()
            opened[name] -= 1
            if own and nodes[node].block:
                runs.append(None)

    def close_open(names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Close the outermost open element of these names that no bounding element stands above."""
        to = len(stack)
        for i in range(len(stack) - 1 if any(opened[n] > 0 for n in names) else 0, 0, -1):
            if stack[i][0] in bounds:
                break
            if stack[i][0] in names:
                to = i
        close(to)

    def add_text(text: str) -> None:
        name, node, _, links = stack[-1]
        if text and not nodes[node].hidden:
            runs.append((node, html.unescape(text) if "&" in text else text, links > 0))

    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.search(source, at)
        if not found:
            add_text(source[at:])
            break
        if found.start() > at:
            add_text(source[at : found.start()])
        at = found.end()
        if found[1] is None:
            token = found[0]
            if token.startswith("</"):
                name = _NAME.match(token, 2)[0].lower()
                if name == "br":
                    add_text(" ")
                elif name == "p" and not opened["p"]:
                    runs.append(None)  # stands for an empty paragraph
                for i in range(len(stack) - 1 if opened[name] > 0 else 0, 0, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if name in INLINE and stack[i][0] not in INLINE:
                        break  # a block does not end with a stray inline tag
                    if name == "p" and stack[i][0] not in INLINE:
                        break
            continue
        name, rest = found[1].lower(), found[2]
        inline = name in INLINE or name in ("br", "wbr", "img", "input")
        if not inline and opened["p"] > 0 and name not in HIDDEN:
            close_open(("p",), ("table", "td", "th", "button", "caption", "object"))
        if name in CLOSES:
            close_open(CLOSES[name], BOUNDS.get(name, ("table",)))
        if name == "a" and opened["a"] > 0:
            close_open(("a",), ("table", "td", "th"))
        if name in VOID:
            if name in ("br", "hr"):
                add_text(" ")
            continue
        top, links = stack[-1][1], stack[-1][3] + (name == "a")
        attributes = _attributes(rest) if "=" in rest else {}
        words = name_words(attributes) if attributes else []
        hidden = name in HIDDEN or nodes[top].hidden or (bool(rest) and ("hidden" in rest.split() or _unseen(attributes)))
        own = not inline or hidden or bool(words)
        if own:
            block = name not in INLINE and name not in HIDDEN
            if block:
                runs.append(None)
            kept = {n: attributes[n] for n in _NAMES if n in attributes}
            nodes.append(Node(name, top, nodes[top].depth + 1, block, hidden, words, kept))
            top = len(nodes) - 1
        stack.append((name, top, own, links))
        opened[name] += 1
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else size
    close(1)
    return Page(nodes, runs)


def _unseen(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style or attributes.get("aria-hidden", "").lower() == "true"


def blocks(page: Page, kept: list[bool]) -> list[str]:
    """Texts of the kept nodes, block by block, white space made single."""
    out, now = [], []
    for run in [*page.runs, None]:
        if run is None:
            text = " ".join("".join(now).split())
            now = []
            if text:
                out.append(text)
        elif kept[run[0]]:
            now.append(run[1])
    return out

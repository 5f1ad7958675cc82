"""Blocks of a web page: leaf texts in page order with the tags around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Elements whose content is never text of the page, read up to their end tag; one that closes itself has none.
RAW = "script|style|noscript|template|iframe|textarea|title"
# Elements inside a block: what stands in them is a block of its own, and a paragraph around them goes on. Choices of a select are no text.
INSIDE = frozenset("svg object canvas audio video select".split())
CHOICES = frozenset("select option".split())
# Elements that begin and end a block (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that end where a sibling of the same kind begins.
LIKE = frozenset("p li dd dt td th tr option tbody thead tfoot".split())
SECTIONS = frozenset("article aside footer form header main nav section dialog menu".split())
VOID = frozenset("hr br img input meta link wbr".split())
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:/>|[^>]*+(?:(?<=[\"'\s]/)>|>.*?(?:</\1\s*+>|\Z)|\Z))|<(/?+)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?+)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
    return tuple(sorted({w.lower() for w in _WORD.findall(found)}))


def page_blocks(page: str) -> list[Block]:
    """Non-empty blocks, each with the distinct tags and names of all elements around it, outermost first. Only ``RAW`` elements without an end reach to the end of the page. Character references are decoded, white space is one space; inline tags leave no trace, a line break is white space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_tags: dict[str, int] = {}
    around: dict[str, int] = {}
    pieces: list[str] = []
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text and not (open_tags.get("select") and stack[-1][0] in CHOICES):
                out.append(Block(text, path(), min(linked, len(text))))
            pieces.clear()
        linked = 0

    def path() -> tuple[str, ...]:
        return (f"leaf:{stack[-1][0]}", *around) if stack else ()

    def push(tag: str, names: tuple[str, ...]) -> None:
        tokens = (tag, *(f".{n}" for n in names), *([f"in:{tag}"] if tag in SECTIONS else []))
        stack.append((tag, tokens))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        for t in tokens:
            around[t] = around.get(t, 0) + 1

    def pop() -> None:
        tag, tokens = stack.pop()
        open_tags[tag] -= 1
        for t in tokens:
            around[t] -= 1
            if not around[t]:
                del around[t]

    for m in _TAG.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            linked += (m.start() - at) if links else 0
        at = m.end()
        if m[3] or m[6]:
            closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
            tag = tag.lower()
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            elif tag in BLOCK or tag in INSIDE:
                if tag in INSIDE and not closing and attributes.endswith("/"):
                    pieces.append(" ")
                    continue
                flush()
                if tag in BLOCK:
                    links = 0
                if closing:
                    if open_tags.get(tag):
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                elif tag not in VOID and not attributes.endswith("/"):
                    if stack and ((stack[-1][0] == "p" and tag in BLOCK) or (stack[-1][0] == tag and tag in LIKE)):
                        pop()
                    push(tag, _names(attributes))
        elif m[1]:
            pieces.append(" ")
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out

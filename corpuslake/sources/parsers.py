"""Parsers of marked-up texts, for Arrow batches: XML to its texts, HTML to its segments."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa


def xml_text(content: bytes, tails: bool = False) -> str:
    """The non-blank texts at the beginning of the elements, in order, a line each, entities and CDATA read, comments left out; with tails, also the texts that follow an element within its parent. The XML itself if it
    has none; empty if it is not well-formed."""
    try:
        root = ElementTree.fromstring(content)
    except (ElementTree.ParseError, LookupError, ValueError):  # not well-formed, or an encoding that is not known
        return ""
    found: list[str] = []

    def walk(top: ElementTree.Element) -> None:
        todo: list[tuple[ElementTree.Element | None, str | None]] = [(top, None)]
        while todo:
            element, text = todo.pop()
            if element is not None:
                todo += [x for child in reversed(element) for x in ((None, child.tail if tails else None), (child, None))]
                text = element.text
            if text and text.strip():
                found.append(text.strip())

    walk(root)
    return "\n".join(found) or ElementTree.tostring(root, encoding="unicode")


#: HTML's raw-text elements, the parts of a page that are no content, elements that begin or end a block, and those whose text is a list item or heading.
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
DROPPED = {"script", "style", "nav", "footer", "xmp", "iframe", "noembed", "noframes"}
BLOCKS = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
_ATTRIBUTES = r"""(?>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)|(?!\s*+=)))*+)"""
TOKEN = re.compile(rf"(?s)(?P<text>[^<]++)|<!--(?:-?>|.*?(?:--!?>|\Z))|</(?P<end>[a-zA-Z][^\s/>]*+){_ATTRIBUTES}(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*+){_ATTRIBUTES}>|<[a-zA-Z].*\Z|<[!?/](?:[^>]*+>|.*\Z)|(?P<sign><)")
_RAW_END = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in RAW.split("|")}
SPACE = re.compile(r"\s+")


def html_blocks(page: str) -> list[tuple[str, int | None, str]]:
    """(kind, level, text) of the blocks of a page in order: headings with their level, list items, paragraphs.

    A scan over the page's tags: attribute values may hold ">", scripts, styles and the like end at their own end tag, text within navigation and footers (also nested ones) is left out, entities are decoded, and
    tags that are never closed end with the page. A tag that the page's end cuts off is no text."""
    out: list[tuple[str, int | None, str]] = []
    held: list[str] = []
    kinds: list[str] = []
    skipped: list[str] = []
    at = 0

    def close() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            kind = kinds[-1] if kinds else "p"
            out.append(("heading", HEADINGS[kind], text) if kind in HEADINGS else ("list" if kind == "li" else "paragraph", None, text))

    while (found := TOKEN.match(page, at)) is not None:
        at = found.end()
        if (text := found["text"] or found["sign"]) is not None:
            if not skipped:
                held.append(html.unescape(text))
            continue
        tag = (found["start"] or found["end"] or "").lower()
        if tag in BLOCKS and not skipped:
            close()
        if found["start"]:
            if tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                raw, at = page[at : end.start() if end else len(page)], end.start() if end else len(page)
                if tag not in DROPPED and not skipped:
                    held.append(html.unescape(raw))
            elif tag in DROPPED:
                skipped.append(tag)
            elif tag in HEADINGS or tag == "li":
                kinds.append(tag)
            elif tag == "p" and kinds and kinds[-1] in HEADINGS:
                kinds.pop()  # a heading that was not closed
        elif found["end"]:
            if tag in skipped:
                del skipped[len(skipped) - 1 - skipped[::-1].index(tag) :]
            elif tag in kinds and not skipped:
                del kinds[len(kinds) - 1 - kinds[::-1].index(tag) :]
            elif tag in ("ul", "ol", "menu") and "li" in kinds and not skipped:
                del kinds[kinds.index("li") :]
    close()
    return out


def mapped(names: list[str], column: int, read: Callable, kind: pa.DataType) -> Callable:
    """Record batches with a column more: read() of each value of a column; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [read(x if x is not None else "") for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=names)

    return run

"""The item that a card's HTML names in the attributes of its popovers; needs a parser, as elements nest."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes with popovers' texts, in the order in which they count.
POPOVERS = ("data-content", "data-original-title", "title")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Elements(HTMLParser):
    """Elements in document order: attributes, and the text within."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[dict[str, str], list[str]]] = []
        self.open: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        text: list[str] = []
        self.found.append(({k: v or "" for k, v in attrs}, text))
        if tag not in VOID:
            self.open.append((tag, text))

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        for _, text in self.open:
            text.append(data)


def plain(raw: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", raw)).split())


def popover_item(card: str | None) -> str | None:
    """The first popover of the first element whose text mentions items; else the first element with such an attribute, if
    that is longer than 15 characters; null without either."""
    if not card or "<" not in card:
        return None
    parser = Elements()
    parser.feed(card)
    parser.close()
    about = next((attrs for attrs, text in parser.found if "items:" in " ".join("".join(text).split()).lower()), {})
    for name in POPOVERS:
        if about.get(name, "").strip():
            if got := plain(about[name]):
                return re.sub(r"(?i)^\s*items?\s*:\s*", "", got)
            break
    for name in POPOVERS:
        first = next((attrs[name] for attrs, _ in parser.found if name in attrs), "")
        if len(first.strip()) > 15:
            return plain(first)
    return None


def popover(card: Column) -> Column:
    """popover_item of a card. One in which no such attribute is named has no item, and doesn't leave the JVM."""
    low = F.lower(card)
    named = F.when(F.contains(low, F.lit("title")) | F.contains(low, F.lit("data-content")), card)

    def run(cards: pa.Array) -> pa.Array:
        return pa.array([popover_item(c) for c in cards.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(named)

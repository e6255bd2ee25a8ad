"""Cells of the HTML tables in a document: the one step that needs a parser. All else is done on the cells."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Cells(HTMLParser):
    """Rows of tables with their cells. A nested table's rows count for the tables round it, too."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[dict]]] = []
        self.open: list[dict] = []

    def end_row(self, t: dict) -> None:
        t["cell"] = None
        t["row"] = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            rows: list[list[dict]] = []
            self.tables.append(rows)
            self.open.append({"rows": rows, "row": None, "cell": None})
        elif tag == "tr" and self.open:
            row: list[dict] = []
            self.end_row(self.open[-1])
            self.open[-1]["row"] = row
            for t in self.open:
                t["rows"].append(row)
        elif tag in ("td", "th") and self.open and self.open[-1]["row"] is not None:
            has = dict(attrs)
            span = lambda k: int(has[k]) if (has.get(k) or "").strip().isdigit() else 1
            cell = {"text": [], "is_th": tag == "th", "colspan": span("colspan"), "rowspan": span("rowspan")}
            self.open[-1]["cell"] = cell
            for t in self.open:
                if t["row"] is not None:
                    t["row"].append(cell)

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        if tag == "table":
            self.open.pop()
        elif tag == "tr":
            self.end_row(self.open[-1])
        elif tag in ("td", "th"):
            self.open[-1]["cell"] = None

    def handle_data(self, data: str) -> None:
        for t in self.open:
            if t["cell"] is not None:
                t["cell"]["text"].append(data)


def table_cells(md: str | None) -> list[tuple[int, int, int, bool, str, int, int]]:
    """(table_no, row_no, cell_no, is_th, text, colspan, rowspan) of a document."""
    if not md or "<" not in md:
        return []
    parser = Cells()
    parser.feed(md)
    parser.close()
    return [(t, r, c, cell["is_th"], "".join(cell["text"]), cell["colspan"], cell["rowspan"]) for t, rows in enumerate(parser.tables) for r, row in enumerate(rows) for c, cell in enumerate(row)]


#: Elements that only stand round text. Any other one leaves a document to the parser.
ROUND = ("thead", "tbody", "tfoot", "caption", "p", "div", "span", "b", "i", "u", "br", "hr", "a", "em", "strong", "ul", "li", "h1", "h2", "h3")
KINDS = {f"{slash}{name}{end}": "" for name in ROUND for slash, end in (("", ""), ("/", ""), ("", "/"), ("", " /"))}
KINDS |= {f"{slash}{name}": f"{slash}{'td' if name == 'th' else name}" for name in ("table", "tr", "td", "th") for slash in ("", "/")}
#: A cell of text alone, whose ends needn't be looked at; else a tag and the text after it.
TAG = re.compile(r"<t[dh]>([^<]*)</t[dh]>[^<]*|<([^<>]+)>([^<]*)")
#: A start tag whose attributes are numbers or quoted texts without characters that mean anything.
WITH_VALUES = re.compile(r"""([a-z][a-z0-9]*)((?: [a-z-]+=(?:[0-9]+|"[^"'<>&=/]*"))+)""")
ROWSPAN = re.compile(r""" rowspan=(?:"([^"]*)"|([0-9]+))""")


def plain_rows(md: str) -> list[tuple[int, int, list[str], int]] | None:
    """(table_no, row_no, texts, rowspan of the first cell) of the rows with cells, in one pass over a document of known tags alone;
    null for any other one, and for tables within tables."""
    tags = TAG.findall(md)
    if len(tags) + [tag for _, tag, _ in tags].count("") != md.count("<"):
        return None
    out: list[tuple[int, int, list[str], int]] = []
    table, inside, row_no, row, spans, cell = -1, False, -1, None, 1, False
    for alone, tag, text in tags:
        if not tag:
            cell = False
            if row is not None:
                if not row:
                    out.append((table, row_no, row, 1))
                row.append(alone if "&" not in alone else unescape(alone))
            continue
        kind, first = KINDS.get(tag), 1
        if kind is None:
            if not (has := WITH_VALUES.fullmatch(tag)) or (kind := KINDS.get(has[1])) is None:
                return None
            if kind == "td" and (given := ROWSPAN.findall(has[2])):
                value = given[-1][0] or given[-1][1]
                first = int(value) if value.strip().isdigit() else 1
        if kind == "td":
            if row is not None:
                if not row:
                    out.append((table, row_no, row, first))
                row.append(text if "&" not in text else unescape(text))
                cell = True
                continue
        elif kind == "/td":
            cell = False
        elif kind == "tr":
            if inside:
                row, cell = [], False
                row_no += 1
        elif kind == "/tr":
            row, cell = None, False
        elif kind == "table":
            if inside:
                return None
            table, inside, row_no, row, cell = table + 1, True, -1, None, False
        elif kind == "/table":
            inside, row, cell = False, None, False
        if cell and text:
            row[-1] += text if "&" not in text else unescape(text)
    return out


def parsed_rows(md: str) -> list[tuple[int, int, list[str], int]]:
    """The same of any document."""
    out: list[tuple[int, int, list[str], int]] = []
    before = (-1, -1)
    for table, row, _, _, text, _, rowspan in table_cells(md):
        if (table, row) != before:
            before = table, row
            out.append((table, row, [], rowspan))
        out[-1][2].append(text)
    return out


#: Documents whose tags are those of tables alone, with no attribute but a row span.
SIMPLE = re.compile(r"[^<]*+(?:<(?:/?(?:table|tr|t[dh])|t[dh] rowspan=[0-9]+)>[^<]*+)*+")


def wanted_rows(md: str, having: Sequence[Sequence[str]]) -> list[tuple[int, int, list[str], int]] | None:
    """The rows of those tables whose header may have one phrase of each group, as plain_rows has them; null for documents
    that aren't simple and for tables within tables. A table without a phrase's words isn't looked at further."""
    if not SIMPLE.fullmatch(md):
        return None
    before, *found = md.split("<table>")
    if "</table>" in before or any(t.count("</table>") != 1 for t in found):
        return None
    out: list[tuple[int, int, list[str], int]] = []
    for n, table in enumerate(found):
        table = table[: table.index("</table>")]
        low = table.lower()
        # Other references than &amp; may stand for letters.
        if low.count("&") != low.count("&amp;") or all(any(all(w in low for w in phrase.split()) for phrase in group) for group in having):
            out += [(n, *row) for _, *row in plain_rows(f"<table>{table}</table>") or []]
    return out


BREAK = re.compile(r"<br[ \t-\r]*/?>", re.IGNORECASE | re.ASCII)
#: White space as Unicode has it; the pattern leaves single blanks alone.
SPACE = " \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{SPACE[1:]}][{SPACE}]*| [{SPACE}]+")


def cleaned(texts: list[str], strip_br: bool) -> list[str]:
    """The texts as clean_text has them, all in one pass."""
    if not texts:
        return texts
    one = "\0".join(texts)
    if one.count("\0") != len(texts) - 1:  # texts that hold the mark themselves
        return [RUNS.sub(" ", BREAK.sub(" ", t) if strip_br else t).strip(" ") for t in texts]
    if strip_br and "<" in one:
        one = BREAK.sub(" ", one)
    return RUNS.sub(" ", one).replace(" \0", "\0").replace("\0 ", "\0").strip(" ").split("\0")


TABLES = "array<struct<table_no:int,rows:array<struct<row_no:int,cells:array<string>,first_rowspan:int>>>>"


def nested(counts: list[int], names: list[str], columns: list[pa.Array]) -> pa.ListArray:
    """So many structs a row, from flat columns."""
    ends = pa.array(np.cumsum([0, *counts]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names))


def tables_of(texts: pa.Array, strip_br: bool = True, having: Sequence[Sequence[str]] = ()) -> pa.Array:
    tables: list[int] = []
    rows: list[int] = []
    sizes: list[int] = []
    numbers, places, spans, cells = [], [], [], []
    for text in texts.to_pylist():
        first, before = len(numbers), -1
        mine: list[str] = []
        if text and "<" in text:
            found = wanted_rows(text, having) if having else None
            found = plain_rows(text) if found is None else found
            for table, row, of_row, rowspan in parsed_rows(text) if found is None else found:
                if table != before:
                    before = table
                    numbers.append(table)
                    rows.append(0)
                places.append(row)
                sizes.append(len(of_row))
                spans.append(rowspan)
                rows[-1] += 1
                mine += of_row
        cells += cleaned(mine, strip_br)
        tables.append(len(numbers) - first)
    texts_of_row = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(cells, pa.string()))
    of_table = nested(rows, ["row_no", "cells", "first_rowspan"], [pa.array(places, pa.int32()), texts_of_row, pa.array(spans, pa.int32())])
    return nested(tables, ["table_no", "rows"], [pa.array(numbers, pa.int32()), of_table])


def once(parse, kind: str):
    """A function that Spark calls once a row: for one that is called deterministic it infers a filter on the size of its
    result and parses every document twice."""
    return F.arrow_udf(parse, kind).asNondeterministic()


def html_tables(md: Column, strip_br: bool = True, having: Sequence[Sequence[str]] = ()) -> Column:
    """The tables of a document with the rows that have cells, their texts clean, in its own row: nothing is shuffled, whatever its
    key is. A document without a table has none, and doesn't leave the JVM. having: groups of lower-case phrases; tables whose header
    lacks all phrases of a group may be left out, the others keep their numbers."""
    # Lower case is sought only where it isn't there as it is: that of a long text takes longer than all else here.
    with_table = F.when(F.contains(md, F.lit("<table")) | F.contains(F.lower(md), F.lit("<table")), md)

    def parse(texts: pa.Array) -> pa.Array:
        return tables_of(texts, strip_br, having)

    return once(parse, TABLES)(with_table)

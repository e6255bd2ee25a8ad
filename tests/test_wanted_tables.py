"""Tables that an operator can't use aren't taken apart, and those that it can are the same."""

import random

import pyarrow as pa

from lexivec.functions import html_tables
from lexivec.operators import tables

PARTS = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "<td rowspan=2>", "Evaluation", "evaluation schedules", " Schedules ", "Evaluation&nbsp;Schedules", "&#69;valuation", "<b>", "</b>", "<br>", "&amp;", "Quantity", "Consignee", "x > y", "\n", " "]


def kept(found, having):
    header = lambda t: " ".join(t["rows"][0]["cells"]).lower()
    return [[t for t in doc if all(any(p in header(t) for p in group) for group in having)] for doc in found.to_pylist()]


def test_same_tables_as_without_it():
    r = random.Random(3)
    docs = ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(3000)]
    cell = lambda: r.choice(PARTS[9:])
    row = lambda: "<tr>" + "".join(f"<td>{cell()}</td>" for _ in range(r.randrange(4))) + "</tr>"
    docs += ["text".join("<table>" + "".join(row() for _ in range(r.randrange(4))) + "</table>" for _ in range(r.randrange(1, 4))) for _ in range(3000)]
    for having in (tables.SCHEDULES, tables.CONSIGNEES, tables.SUMS):
        few, every = (html_tables.tables_of(pa.array(docs), True, h) for h in (having, ()))
        assert kept(few, having) == kept(every, having)
        assert sum(map(len, kept(every, having))) > 50


def test_other_tables_are_left_out():
    other = "<table><tr><td>Evaluation Method</td><td>a &amp; b</td></tr></table>"
    doc = f"{other} <table><tr><th>Evaluation Schedules</th></tr><tr><td rowspan=2>1</td></tr></table>{other}"
    found = html_tables.tables_of(pa.array([doc, other]), True, tables.SCHEDULES).to_pylist()
    assert [[t["table_no"] for t in of] for of in found] == [[1], []]

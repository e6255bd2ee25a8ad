"""Operators on documents' tables, within the row of their document.

A document's tables are one column, array<table_no, header, header_text (lower case), rows (row_no, cells, first_rowspan)>; the header is the
first row. Everything below maps such a column to a list, so that no step moves rows between documents, and documents
with equal keys or none keep what is theirs. A document that is null or has no table has empty lists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.html_tables import html_tables
from lexivec.functions.text import to_int


def table_rows(docs: DataFrame, key: str = "doc", md: str = "md", strip_br: bool = True) -> DataFrame:
    """key, table_no, row_no, cells (array of cleaned texts), first_rowspan of all rows, each from its document's row."""
    found = docs.select(key, html_tables(F.col(md), strip_br).alias("tables")).select(key, F.inline("tables"))
    return found.select(key, "table_no", F.inline("rows"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_tables(docs: DataFrame, md: str = "md", strip_br: bool = True, name: str = "tables", having: Sequence[Sequence[str]] = ()) -> DataFrame:
    """The documents with their tables, cells cleaned. having: what an operator below asks of a header, if it is all that
    the tables are for; others may be left out."""
    parsed = docs.withColumn(name, html_tables(F.col(md), strip_br, having))
    header = lambda t: F.get(t["rows"], F.lit(0))["cells"]
    return parsed.withColumn(name, F.transform(name, lambda t: F.struct(t["table_no"].alias("table_no"), header(t).alias("header"), F.lower(F.array_join(header(t), " ")).alias("header_text"), t["rows"].alias("rows"))))


def body(table: Column) -> Column:
    return F.slice(table["rows"], 2, F.greatest(F.size(table["rows"]), F.lit(1)))


def pairs(tables: Column) -> Column:
    """key, low (the key in lower case), value of all rows of two cells or more, in order."""
    named = lambda t: F.filter(t["rows"], lambda r: (F.size(r["cells"]) >= 2) & (r["cells"][0] != ""))
    return F.flatten(F.transform(tables, lambda t: F.transform(named(t), lambda r: F.struct(r["cells"][0].alias("key"), F.lower(r["cells"][0]).alias("low"), r["cells"][1].alias("value")))))


def key_values(pairs: Column) -> Column:
    """The pairs with different keys: of an equal key the last value, at the first place."""
    last = lambda p, back: F.transform(F.array_distinct(F.reverse(back)), lambda k: F.get(p, (F.size(p) - F.array_position(back, k)).cast("int")))
    return let(pairs, lambda p: let(F.reverse(F.transform(p, lambda e: e["key"])), lambda back: last(p, back)))


def kv_get(pairs: Column, *patterns: str) -> Column:
    """Of the first key that contains one of the patterns, in any case, the last value; null without one."""
    hit = lambda e: _any([F.contains(e["low"], F.lit(p.lower())) for p in patterns])
    same = lambda hits: F.filter(hits, lambda e: e["key"] == F.get(hits, F.lit(0))["key"])
    return let(F.filter(pairs, hit), lambda hits: F.try_element_at(same(hits), F.lit(-1))["value"])


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def column_index(header: Column, *words: str, default: int | None = None) -> Column:
    """Place (from 0) of the first header cell that contains one of the words."""
    hits = F.transform(header, lambda h: _any([F.contains(F.lower(h), F.lit(w.lower())) for w in words]))
    return F.coalesce(F.nullif(F.array_position(hits, True), F.lit(0)) - 1, F.lit(default)).cast("int")


def cell_at(cells: Column, place: Column) -> Column:
    return F.when(place >= 0, F.coalesce(F.get(cells, place), F.lit(""))).otherwise(F.lit(""))


def group_key(name: Column) -> Column:
    """'Package n' for a bare number or 'Group Gn'."""
    name = F.trim(name)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("bigint").cast("string")
    return F.when(name.rlike(r"^\d+$"), F.concat(F.lit("Package "), number(r"^(\d+)$"))).when(name.rlike(r"(?i)^group\s+g0*\d+$"), F.concat(F.lit("Package "), number(r"(?i)^group\s+g0*(\d+)$"))).otherwise(name)


#: Fixed values here and below: words of tables' headers.
OFFICER = ("consignee", "reporting", "officer")
#: What headers have of the tables that schedules, consignees and their sums are read from.
SCHEDULES = (("evaluation schedules",),)
CONSIGNEES = (("consignee", "reporting", "परेषिती"), ("quantity", "मात्रा", "माना"))
SUMS = (("consignee", "परेषिती"), ("quantity", "मात्रा"))


def has_any(table: Column, words: Sequence[str]) -> Column:
    return _any([F.contains(table["header_text"], F.lit(w)) for w in words])


def first_with(tables: Column, *words: str) -> Column:
    """The first table whose header has all of the words; null without one."""
    return F.get(F.filter(tables, lambda t: ~_any([~F.contains(t["header_text"], F.lit(w)) for w in words])), F.lit(0))


def places(table: Column, **words: tuple) -> Column:
    """Struct of the columns' places in a table: name = (place by default, words of its header)."""
    return F.struct(*[column_index(table["header"], *w, default=default).alias(name) for name, (default, *w) in words.items()])


def named_item(x: Column) -> Column:
    return ~F.lower(x["item_category"]).isin("", "item", "item/category")


def or_empty(found: Column, kind: str) -> Column:
    return F.coalesce(found, F.array().cast(f"array<struct<{kind}>>"))


def group_schedules(tables: Column) -> Column:
    """group_key, item_no, item_category, officer, address, quantity: each row belongs to the last group begun."""

    def marked(r: Column, i: Column) -> Column:
        first = r["cells"][0]
        spans, named = r["first_rowspan"] > 1, first.rlike(r"(?i)^group\s+g\d+")
        starts = (spans & (first != "")) | (~spans & named)
        items = F.when(spans | named, F.slice(r["cells"], 2, F.greatest(F.size(r["cells"]), F.lit(1)))).otherwise(r["cells"])
        return F.struct(F.when(starts, i).alias("start"), F.when(starts, group_key(first)).alias("key"), items.alias("items"))

    def grouped(rows: Column, at: Column) -> Column:
        begun = F.filter(F.transform(rows, lambda m: m["start"]), lambda i: i.isNotNull())

        def one(starts: Column) -> Column:
            key = lambda i: F.get(rows, F.array_max(F.filter(starts, lambda s: s <= i)))["key"]
            cell = lambda m, name: cell_at(m["items"], at[name] - 1)
            return F.transform(rows, lambda m, i: F.struct(key(i).alias("group_key"), F.size(m["items"]).alias("n"), *[cell(m, c).alias(c) for c in ("item_category", "officer", "address", "quantity")]))

        return let(begun, one)

    def numbered(kept: Column) -> Column:
        number = lambda x, i: F.size(F.filter(F.slice(kept, 1, i + 1), lambda y: y["group_key"] == x["group_key"]))
        return F.transform(kept, lambda x, i: F.struct(x["group_key"].alias("group_key"), number(x, i).alias("item_no"), *[x[c].alias(c) for c in ("item_category", "officer", "address", "quantity")]))

    def of(t: Column) -> Column:
        at = places(t, item_category=(1, "item/category", "item"), officer=(2, "consignee/reporting", "reporting officer", "consignee"), address=(3, "address"), quantity=(4, "quantity"))
        rows = let(at, lambda a: let(F.transform(body(t), marked), lambda m: grouped(m, a)))
        kept = F.filter(rows, lambda x: x["group_key"].isNotNull() & (x["n"] > 0) & named_item(x))
        return F.when(has_any(t, OFFICER), let(kept, numbered))

    return or_empty(let(first_with(tables, *SCHEDULES[0]), of), "group_key:string,item_no:int,item_category:string,officer:string,address:string,quantity:string")


def item_schedules(tables: Column) -> Column:
    """key, item_category, estimated_value, quantity: by the label's number, else by the running count; of an equal key
    the last, at the first place."""

    def of(t: Column) -> Column:
        at = places(
            t, label=(0, "evaluation schedules", "मूल्यांकन अनुसूचियां"), item_category=(1, "item/category", "item", "वस्तु"),
            estimated_value=(2, "estimated value", "अनुमानित मूल्य"), quantity=(3, "quantity", "मात्रा"),
        )
        rows = let(at, lambda a: F.transform(body(t), lambda r: F.struct(*[cell_at(r["cells"], a[c]).alias(c) for c in ("label", "item_category", "estimated_value", "quantity")])))
        key = lambda x, i: F.coalesce(F.nullif(to_int(x["label"]), F.lit(0)), (i + 1).cast("bigint")).cast("string")
        keyed = F.transform(F.filter(rows, named_item), lambda x, i: F.struct(key(x, i).alias("key"), *[x[c].alias(c) for c in ("item_category", "estimated_value", "quantity")]))
        last = lambda all_of: F.transform(F.array_distinct(F.transform(all_of, lambda x: x["key"])), lambda k: F.element_at(F.filter(all_of, lambda x: x["key"] == k), -1))
        return F.when(~has_any(t, OFFICER) & has_any(t, ("estimated value", "अनुमानित मूल्य", "item", "वस्तु")), let(keyed, last))

    return or_empty(let(first_with(tables, *SCHEDULES[0]), of), "key:string,item_category:string,estimated_value:string,quantity:string")


def consignees(tables: Column) -> Column:
    """officer, address, quantity, delivery of all consignee tables, without repeats, in order."""

    def of(t: Column) -> Column:
        at = places(
            t, number=(None, "s.no", "क्र.सं"), officer=(1, "reporting", "consignee reporting", "परेषिती/रिपोर्टिंग"), address=(2, "address", "पता"),
            quantity=(3, "quantity", "मात्रा", "माना"), delivery=(4, "delivery", "डिलीवरी"),
        )
        fit = lambda r, a: (F.size(r["cells"]) >= 4) & (a["number"].isNull() | (a["number"] >= F.size(r["cells"])) | F.get(r["cells"], a["number"]).rlike(r"^\d+$"))
        return let(at, lambda a: F.transform(F.filter(body(t), lambda r: fit(r, a)), lambda r: F.struct(*[cell_at(r["cells"], a[c]).alias(c) for c in ("officer", "address", "quantity", "delivery")])))

    mine = F.filter(tables, lambda t: has_any(t, CONSIGNEES[0]) & has_any(t, CONSIGNEES[1]))
    person = lambda x: (x["officer"] != "") & ~_any([F.contains(F.lower(x["officer"]), F.lit(w)) for w in ("officer", "consignee", "reporting", "अधिकारी")])
    found = F.filter(F.flatten(F.transform(mine, of)), person)
    return or_empty(let(found, lambda all_of: F.filter(all_of, lambda x, i: F.array_position(all_of, x) == i + 1)), "officer:string,address:string,quantity:string,delivery:string")


def table_quantities(tables: Column) -> Column:
    """table_no, quantity: the sum of the quantities of each consignee table."""
    mine = F.filter(tables, lambda t: has_any(t, SUMS[0]) & has_any(t, SUMS[1]))
    zero = F.lit(0).cast("long")
    total = lambda t, at: F.aggregate(body(t), zero, lambda n, r: n + F.coalesce(to_int(cell_at(r["cells"], at)), zero))
    return or_empty(F.transform(mine, lambda t: F.struct(t["table_no"].alias("table_no"), let(column_index(t["header"], "quantity", "मात्रा", default=3), lambda at: total(t, at)).alias("quantity"))), "table_no:int,quantity:bigint")

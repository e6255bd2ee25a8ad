"""Operators on hand-written rows: the cases where a plausible other reading would give something else."""

import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.functions import cards, html_cards, html_tables
from lexivec.functions import text as T
from lexivec.operators import index, legacy, reports, retrieval, scratch, sections, store, tables
from lexivec.plans import config, document_queries, engine, queries
from lexivec.sources import landing
from lexivec.streaming import ingest
from tests.oracle import DATA, connect, rows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_numbers(spark):
    assert one(spark, "१२", T.to_int) == 12
    assert one(spark, "1,234.50", T.to_int) == 123450
    assert one(spark, "3.00 %", T.to_float) == 3.0
    assert one(spark, "Rs. 5", T.to_float) is None
    assert one(spark, None, T.to_int) is None
    assert one(spark, "N/A", T.yesno) is None
    assert one(spark, "A<br>B\t\n c ", T.clean_text) == "A B c"


def test_html_cells():
    cells = html_tables.table_cells("<table><tr><td>A<br>B<td rowspan=2>x</tr><tr><th>n<table><tr><td>in</td></tr></table></th></tr></table>|a|b|")
    outer = [(r, c, text) for t, r, c, _, text, _, _ in cells if t == 0]
    assert outer[:2] == [(0, 0, "AB"), (0, 1, "x")]
    assert [x[6] for x in cells if x[4] == "x"] == [2]
    assert [text for t, *_, text, _, _ in cells if t == 1] == ["in"]
    assert html_tables.table_cells(None) == []


def test_values_are_looked_up_once(spark):
    """However often a field's expressions name a value, one expression of the plan finds it among the pairs."""
    docs = spark.createDataFrame([(1, "", "Goods")], "doc int, md string, product_type string")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = sections.parse_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [plan.count(f", {label})") for label in ("evaluation method", "item category", "bid to ra enabled", "total quantity")] == [1] * 4


def test_cards_of_one_file_are_read_by_all_cores(spark):
    assert document_queries.card_rows(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_cards_without_popovers_need_no_parser(spark):
    """Only cards that name an attribute with popovers go to Python, in any case of letters."""
    cards_ = ["<b>Items: x</b>", "<p DATA-CONTENT='Items: Bolt'>Items: x</p>", "<i Title=Nut>items: y</i>", None, "title"]
    found = spark.createDataFrame([(i, c) for i, c in enumerate(cards_)], "i int, c string").select("i", html_cards.popover(F.col("c")).alias("p"))
    assert [r.p for r in found.orderBy("i").collect()] == [html_cards.popover_item(c) for c in cards_] == [None, "Bolt", "Nut", None, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "title" in plan and "data-content" in plan


ODD_TABLES = [
    "<table><tr><td>A &amp; B</td><th rowspan=2 colspan=\"3\">x</th></tr><tr><td>n<b>m</b></td>out<td></td></tr></table><td>no</td>", "<table><tr><td>1<td>2<tr><td>3</table>", "<TABLE><TR><TD>a</TD></TR></TABLE>",
    "<table><tr><td>n<table><tr><td>in</td></tr></table></td></tr></table>", "<table><tr><td>a < b</td><td><!-- <td> -->c</td></tr></table>", "<table><tr><td title='<td>'>a</td><td/>b</tr></table>", "<table><tr><td>a</td></tr>", "<table><tr></tr><tr><td>\0</td><td> \t</td></tr></table> &lt;td>",
    "<table><tr><td>a<script><td>x</td></script></td></tr></table>", "<tr><td>a</td></tr><table><td>b</td><tr><td>c &lt;br /&gt; \u3000d</td></tr></table>", "<table><tr><td rowspan=\" 2 \">a</td><></tr></table>",
]


def test_plain_tables_need_no_parser(monkeypatch):
    """Documents of known tags are read in one pass; all others as the parser reads them."""
    for md in ODD_TABLES:
        found = html_tables.plain_rows(md)
        assert found is None or found == html_tables.parsed_rows(md), md
    assert [html_tables.plain_rows(md) is None for md in ODD_TABLES[:4]] == [False, False, True, True]
    monkeypatch.setattr(html_tables, "table_cells", None)
    assert html_tables.tables_of(pa.array([ODD_TABLES[0], None])).to_pylist() == [[{"table_no": 0, "rows": [{"row_no": 0, "cells": ["A & B", "x"], "first_rowspan": 1}, {"row_no": 1, "cells": ["nm", ""], "first_rowspan": 1}]}], []]


def test_cut_off_entities_stay_text(spark):
    """A page may end a word in '&amp' without its semicolon."""
    assert one(spark, "a &amp<p>&amp; &eacute; &#8377; &#x20B9;&nope; &notit;", lambda x: T.strip_html(x, bare=False)) == "a &amp & é ₹ ₹&nope; &notit;"
    assert one(spark, "a &amp<p>&eacute;", T.strip_html) == "a & é"


def test_cells_are_cleaned_like_texts(spark):
    texts = [" a  b ", "", "\t", "x<br>y<BR />z", "\u3000é\xa0\x1c\x85e", "a\n b", " ", "<br\x0b/>"]
    for strip_br in (True, False):
        want = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.clean_text(F.col("t"), strip_br).alias("c")).collect()]
        assert html_tables.cleaned(texts, strip_br) == want
        assert html_tables.cleaned([*texts, "a \0  b"], strip_br) == [*want, "a \0 b"]


def test_sections(spark):
    md = """<table><tr><td>Item Category</td><td>Bolt,Nut</td></tr><tr><td>Total Quantity</td><td>11</td></tr><tr><td>EMD Amount</td><td>1,000</td></tr>
    <tr><td>EMD Amount 2</td><td>500</td></tr><tr><td>Advisory Bank</td><td>SBI</td></tr><tr><td>ePBG Percentage</td><td>3.00</td></tr><tr><td>Evaluation Method</td><td>Group wise evaluation</td></tr>
    <tr><td>Bid to RA enabled</td><td>Yes</td></tr><tr><td>RA Qualification Rule</td><td>H1</td></tr></table>
    <table><tr><th>S.No.</th><th>Consignee Reporting</th><th>Address</th><th>Quantity</th></tr><tr><td>1</td><td>A. Person</td><td>Pune</td><td>5</td></tr></table>
    <table><tr><th>S.No.</th><th>Consignee Reporting</th><th>Address</th><th>Quantity</th></tr><tr><td>1</td><td>B. Person</td><td>Goa</td><td>6</td></tr></table>
    Custom BOQ Buyer Added Bid Specific Terms and Conditions Pay. Disclaimer None. Thank you"""
    js = json.dumps({"pdf": {"departments": {"office_name": None, "department_name": "Works"}}})
    rows = spark.createDataFrame([(1, md, "Goods", js), (2, None, "Goods", None)], "doc int, md string, product_type string, js string")
    p = {r.doc: r.pdf for r in sections.parse_documents(rows, converter_json="js").collect()}
    a = p[1]
    assert (a.process_kind, a.base_type) == ("CUSTOM", "CUSTOM_GOODS")
    assert [(i["item_category"], i["quantity"]) for i in a["items"]["items"]] == [("Bolt", 5), ("Nut", 6)]
    assert a["items"]["quantity_match_flag"] == "Yes"
    assert a.financials.emd.amount_total == 1500 and a.financials.emd.required and a.financials.epbg.percent == 3.0
    assert a.departments.department_name == "Works" and a.departments.office_name is None
    assert a.ra.ra_qualification_rule == "H1" and len(a.consignees) == 2
    assert a.terms.buyer_atc.generic == "Buyer Added Bid Specific Terms and Conditions Pay." and a.terms.disclaimer == "None."
    b = p[2]
    assert b.process_kind == "CATALOGUE" and not b.financials.emd.required and b.consignees == [] and b.terms.disclaimer == ""


def test_sections_from_a_converter(spark):
    js = json.dumps({
        "items": {"total_quantity_extracted": 3, "item 1": {"item_category": "Bolt", "quantity": 1}, "item 2": {"item_category": "Nut", "quantity": 2}},
        "evaluation": {"evaluation_method": "Group wise", "schedules": {"Group G01": {"Item_1": {"Item/Ca tegory": "Bolt", "Qua ntity": "1"}}, "2": {"Item_1": {"Item/Category": "Nut"}}}},
        "documents": {"required_from_seller": ["Licence"], "attachments": ["a.pdf"]},
        "consignees": [{"consignee_reporting_officer": "A", "quantity": 5}],
    })
    p = sections.parse_documents(spark.createDataFrame([(1, "<p>no table</p>", "Goods", js)], "doc int, md string, product_type string, js string"), converter_json="js").first().pdf
    assert [(i["item_category"], i["quantity"]) for i in p["items"]["items"]] == [("Bolt", 1), ("Nut", 2)] and p["items"]["quantity_match_flag"] == "Yes"
    assert [(x.group_key, x.item_key, x.item_category, x.quantity) for x in p.evaluation.schedules] == [("Package 1", "Item_1", "Bolt", "1"), ("Package 2", "Item_1", "Nut", "")]
    assert p.documents.required_from_seller == ["Licence"] and p.documents.attachments == ["a.pdf"]
    assert [(c.consignee_reporting_officer, c.quantity) for c in p.consignees] == [("A", "5")]


def test_card_without_labels(spark):
    rows = spark.createDataFrame([("nothing here", '<a href="/showbidDocument/1">x</a><a href="//SHOWBIDDOCUMENT/2">y</a><a href="/showradocumentPdf/3">z</a><a href="/c">View <b>Corrigendum</b></a>', "Service Bid/RAs")], "t string, h string, k string")
    r = rows.select(cards.card_details(F.col("t"), F.col("h"), F.col("k")).alias("c"), cards.links(F.col("h"), "http://p").alias("l")).first()
    assert r.c.bid.product_type == "Service" and r.c.bid.bid_no == "" and r.c.card.departments == [] and r.c.card["items"][0].quantity == 0
    assert (r.l.document_url, r.l.ra_url, r.l.corrigendum_url) == ("http://p/SHOWBIDDOCUMENT/2", "http://p/showradocumentPdf/3", "http://p/c")


def test_windows(spark):
    sizes = [0, 9, 10, 20, 21, 700, 701, 750, 800, 801, 2400]
    rows = spark.createDataFrame([(n, "x" * n) for n in sizes] + [(-1, None), (-2, "   \n ")], "k int, body string")
    got = {r.k: r.n for r in index.windows(rows, "k", F.col("body")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    want = {n: sum(1 for s in range(0, n, 700) if min(800, n - s) > 20) for n in sizes if n >= 10}
    assert got == {k: v for k, v in want.items() if v}
    chunks = index.chunked(rows.where("k in (9, 801)"), "k", F.col("body"), T.metadata_card({"bid_no": F.col("k")}))
    assert sorted((r.k, r.chunk_index) for r in chunks.collect()) == [(9, 0), (801, 0), (801, 1), (801, 2)]


def test_upsert_is_stable(spark):
    log = spark.createDataFrame([("u", 1, "a", "r1"), ("u", 2, "b", None), ("v", 1, "c", "r2"), ("", 1, "d", "x"), (None, 1, "e", "x")], "document_url string, at int, name string, ra_no string")
    first = store.snapshot_of_log(log.where("at = 1"), "document_url", "at", ["name"], ["ra_no"])
    both = store.upsert(first, log.where("at = 2"), "document_url", "at", ["name"], ["ra_no"])
    got = {r.document_url: (r.name, r.ra_no, r.first_seen, r.last_seen, r.is_new) for r in both.collect()}
    assert got == {"u": ("a", "", 1, 2, 0), "v": ("c", "r2", 1, 1, 1)}
    assert store.stats(both).first().asDict() == {"total": 2, "new": 1}
    assert store.mark_seen(both).where("is_new = 1").isEmpty()


def test_post_cut_filter_and_no_back_fill(spark):
    chunks = spark.createDataFrame([(i, i // 2, "w", "a" if i % 2 else "b", [1.0, float(i)]) for i in range(60)], "chunk_id int, bid_no int, chunk string, kind string, embedding array<double>")
    scores = spark.createDataFrame([(i, float(60 - i)) for i in range(60)], "chunk_id int, score double")
    top = retrieval.bm25_topn(scores, chunks, 40, {"kind": "a"}).collect()
    assert len(top) == 20 and max(r.chunk_id for r in top) == 39
    rows = spark.createDataFrame([(1, 1, 0.9, 0.9, 0.0), (2, 2, 0.0, 0.0, 1.0), (3, 3, 0.8, 0.8, 0.0)], "bid_no int, final_rank int, rerank double, semantic double, bm25 double")
    assert [r.bid_no for r in retrieval.without_noise(rows, 2).collect()] == [1]
    cut = retrieval.relative_cut(spark.createDataFrame([(1, -0.5), (2, 0.9)], "final_rank int, score double"))
    assert sorted(r.final_rank for r in cut.collect()) == [1, 2]


def test_rerank_orders_by_logits(spark):
    rows = spark.createDataFrame([(1, 1, 0.2, 0.1, "a"), (2, 2, 0.3, 0.1, "bbb")], "bid_no int, pool_rank int, semantic double, bm25 double, chunk string")
    got = retrieval.reranked(rows, lambda q, c: F.length(c).cast("double")).orderBy("final_rank").collect()
    assert [r.bid_no for r in got] == [2, 1]
    assert [r.final_rank for r in retrieval.reranked(rows, None).orderBy("pool_rank").collect()] == [1, 2]


def test_legacy_scores(spark):
    rows = spark.createDataFrame([("steel pump", "x", "", "")], "full_item_name string, department string, bid_type string, product_type string")
    k = lambda q: rows.select(legacy.keyword_score(F.lit(q))).first()[0]
    assert round(k("pump"), 2) == 0.46 and k("the of") == 0.5 and k("valve") == 0
    h = lambda s, w: round(rows.select(legacy.hybrid(F.lit(s), F.lit(w))).first()[0], 3)
    assert (h(0.88, 0.46), h(0.65, 0.0), h(0.11, 0.0)) == (0.712, 0.39, 0.066)


def test_engine(spark):
    chunks = spark.createDataFrame([(1, 10, "steel pump", "en", [1.0, 0.0]), (2, 11, "brass valve", "en", [0.0, 1.0])], "chunk_id int, bid_no int, chunk string, product_type string, embedding array<double>")
    words = index.build(chunks, "chunk_id", F.col("chunk"))
    plain = engine.Engine(chunks, words, embed=lambda q: [1.0, 0.1])
    got = plain.ask("steel pump")
    assert got["chunk_count"] >= 1 and got["sources"][0]["bid_no"] == "10" and "Bid No    : 10" in got["answer"]
    models = {"short": lambda system, prompt, temperature: prompt[:22]}
    asked = engine.Engine(chunks, words, embed=lambda q: [1.0, 0.1], providers=models, provider="short").ask("steel pump")
    assert asked["answer"] == "RETRIEVED BID CONTEXT:"

    def fails(system, prompt, temperature):
        raise OSError

    assert engine.Engine(chunks, words, embed=lambda q: [1.0, 0.1], providers={"f": fails}, provider="f").ask("steel pump")["answer"].startswith("Retrieved bids:")
    met = []
    engine.Engine(chunks, words, embed=lambda q: met.append(q) or [1.0, 0.1], provider="unknown", model="BAAI/bge-base").ask("steel pump")
    assert met == [T.QUERY_PREFIX + "steel pump"]
    assert engine.Engine(chunks.where("false"), None, embed=lambda q: [1.0, 0.1]).ask("x")["answer"] == engine.NO_HITS
    assert engine.parse_chat("f:bid_type=Custom Bid show pumps") == ("show pumps", {"bid_type": "Custom Bid"})
    assert engine.parse_chat("f:bid_type=Custom") == ("f:bid_type=Custom", None)
    assert engine.parse_filter("a=b=c") == {"a": "b=c"} and engine.parse_filter("x") is None
    assert engine.is_exit(" Quit ") and engine.top_k_of("show me all GEM/2026", 5) == 15


def test_reports(spark):
    docs = spark.createDataFrame([(2, "b", "Item wise evaluation"), (1, "a", "item wise evaluation"), (3, "c", "")], "page int, name string, text string")
    got = [(r.eval_category, r.page, r.name) for r in reports.listing(docs, "text", "page", "name").collect()]
    assert got == [("Item_Wise", 1, "a"), ("Item_Wise", 2, "b"), ("Other", 3, "c")]
    pages = spark.createDataFrame([("d", 2, "y"), ("d", 1, "x")], "k string, no int, text string")
    assert reports.joined_pages(pages, "k", "no", "text").first().text == "x\n\n---PAGE BREAK---\n\ny"
    known = reports.with_pages(docs.select("name"), docs.where("page > 2").select("name", "page"), "name")
    assert {r.name: r.page for r in known.collect()} == {"a": "Unknown", "b": "Unknown", "c": "3"}


def test_files_of_rows(spark, tmp_path):
    rows = spark.range(50).select(F.concat_ws("/", F.lit("é x"), F.col("id").cast("string"), F.lit("t.md")).alias("path"), F.format_string("text %d\nü", "id").alias("content"))
    landing.write_files(rows, f"file://{tmp_path}/f")
    assert {r.id: r.md for r in landing.documents(spark, f"file://{tmp_path}/f").collect()} == {str(i): f"text {i}\nü" for i in range(50)}
    landing.write_files(rows.limit(0), f"file://{tmp_path}/none")
    assert list((tmp_path / "none").iterdir()) == []


def test_sources(spark, tmp_path):
    for k in ("a", "b"):
        (tmp_path / "md" / k).mkdir(parents=True)
        (tmp_path / "md" / k / "x.md").write_text(f"text {k}\nof two lines")
    (tmp_path / "js").mkdir()
    (tmp_path / "js" / "a_DOCLING_EXTRACTED.json").write_text("{}")
    got = {r.id: (r.md, r.converter_json) for r in landing.document_pairs(spark, f"file://{tmp_path}/md", f"file://{tmp_path}/js").collect()}
    assert got == {"a": ("text a\nof two lines", "{}"), "b": ("text b\nof two lines", None)}
    loose = spark.createDataFrame([('{"a": 1}, {"a": 2}',)], "t string")
    assert [r.a for r in landing.loose_objects(loose, "t", "struct<a:int>").collect()] == [1, 2]
    files = landing.binary_documents(spark, f"file://{tmp_path}/md", "*.md")
    assert {r.error for r in landing.converted(files, lambda b: b.decode()).collect()} == {None}
    assert {r.error for r in landing.converted(files, lambda b: 1 / 0).collect()} == {"division by zero"}


def test_stream_of_two_batches(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1, "a", "r")], "k string, at int, name string, ra string")
    src, root = f"file://{tmp_path}/in", f"file://{tmp_path}/store"
    alerts: list[int] = []
    for k in (1, 2):
        rows.withColumn("at", F.lit(k)).withColumn("name", F.lit(f"n{k}")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        q = ingest.stream_upserts(stream, root, f"file://{tmp_path}/progress", "k", "at", ["name"], ["ra"], on_new=lambda df: alerts.append(df.count()))
        q.awaitTermination()
    r = ingest.snapshot(spark, root).first()
    assert (r.name, r.first_seen, r.last_seen, r.is_new) == ("n1", 1, 2, 0) and alerts == [1, 0]


def test_stream_upsert_query_upserts(spark, tmp_path):
    """Later micro-batches meet an earlier snapshot, and rows without event_id take part."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    bare = F.col("user_id") % 5 == 0
    events.withColumn("event_id", F.when(~bare, F.col("event_id"))).coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    got = queries.QUERIES["stream_upsert"](spark, f"file://{tmp_path}")
    root = got.inputFiles()[0].rpartition("/version=")[0]
    assert ingest.versions(spark, root) == list(range(queries.SLICES))[-ingest.KEPT :]
    want = connect().execute(queries.ORACLE_SQL["stream_upsert"].replace("(ts, event_id)", "ts")).df()
    assert rows(got.toPandas()) == rows(want)


def test_tables_first_column_index(spark):
    rows = spark.createDataFrame([(["S.No.", "Item", "Quantity"],)], "h array<string>")
    got = rows.select(tables.column_index(F.col("h"), "quantity"), tables.column_index(F.col("h"), "none"), tables.column_index(F.col("h"), "none", default=4)).first()
    assert tuple(got) == (2, None, 4)


def test_end_of_text():
    """Against removing what stands at the end again and again."""
    import random
    import re

    def again(x):
        before = None
        while x != before:
            before = x
            for p in (r"#+\s*$", r"[^\s]{1,60}/\s*$", r"-{2,}\s*$"):
                x = re.sub(p, "", x)
            x = x.rstrip()
        return x.strip()

    r = random.Random(1)
    for _ in range(4000):
        x = "".join(r.choice(["#", "##", "-", "--", "/", " ", "a", "word", "अस्वीकरण", "\n", "x" * 70]) for _ in range(r.randint(0, 9)))
        assert x[: sections.end_of_text(x)].strip() == again(x), x
    assert sections.end_of_text("a/" * 50_000 + "b") == 100_001


def test_popovers():
    read = html_cards.popover_item
    assert read('<div><a data-content="Items: Long &amp; wide">x items: y</a></div>') == "Items: Long & wide"
    assert read('<b title="items: Gear">Items:</b>') == "Gear"
    assert read('<p title="short">x</p>') is None and read("text") is None and read(None) is None
    assert read('<img title="A title that is long"><p data-content="b">x</p>') == "A title that is long"


def test_link_forms(spark):
    rows = spark.createDataFrame([("<a href='/showbidDocument/1'>x</a><a class=k href=/showradocumentPdf/2>y</a><a data-href=\"/showbidDocument/9\">n</a>",)], "h string")
    r = rows.select(cards.links(F.col("h"), "http://p").alias("l")).first().l
    assert (r.document_url, r.ra_url, r.corrigendum_url) == ("http://p/showbidDocument/1", "http://p/showradocumentPdf/2", "")


def test_config():
    got = config.Config.from_env({"LEXIVEC_TOP_K": "7", "LEXIVEC_SEMANTIC": "0.25", "LEXIVEC_ONLY_OPEN": "off", "OTHER": "x"})
    assert (got.top_k, got.semantic, got.only_open, got.retries) == (7, 0.25, False, 3)
    assert all(config.Config.from_env({"LEXIVEC_ONLY_OPEN": v}).only_open for v in ("1", "TRUE", "yes", " on "))
    fast = got.preset("speed")
    assert (fast.chunk_size, fast.chunk_overlap, fast.top_k, fast.retries) == (1500, 50, 3, 3)


def test_index_updates(spark, tmp_path):
    """Segments: replaced, added and removed records; a broken segment isn't read."""
    root = f"file://{tmp_path}/index"
    rows = lambda *r: spark.createDataFrame(r, "bid_no string, full_pdf_text string")
    index.reindex(spark, rows(("a", "steel pump for clean water"), ("b", "brass valve for hot steam")), root)
    index.update(spark, rows(("b", "copper pipe for cold water"), ("c", "rubber seal for old valve")), root)
    index.remove(spark, rows(("c", "")).select("bid_no"), root)
    chunks, words = index.stored(spark, root)
    assert {r.bid_no for r in chunks.where("chunk like '%pipe%' or chunk like '%pump%'").collect()} == {"a", "b"} and chunks.where("bid_no = 'c'").isEmpty()
    df = {r.term: r.df for r in words.terms.collect()}
    assert df["water"] == 2 and "valve" not in df and "brass" not in df and words.corpus.first().n == 4
    plain = index.build(chunks, "chunk_id", index.rich(chunks))
    assert {tuple(r) for r in plain.terms.collect()} == {tuple(r) for r in words.terms.collect()}
    chunks.limit(1).write.parquet(f"{root}/chunks/segment=9")
    assert index.segments(spark, root) == [0, 1, 2]


def test_stored_index_is_pruned(spark, tmp_path):
    """A question's words reach the scan of the postings, and the found ids that of the chunks."""
    root = f"file://{tmp_path}/index"
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("bid_no"), F.col("text").alias("chunk"))
    index.add_segment(spark, root, docs, F.col("chunk"))
    chunks, words = index.stored(spark, root)
    plan = retrieval.bm25_scores(words, "the that")._jdf.queryExecution().toString()
    assert "In(term, [" in plan
    found = retrieval.search(chunks, words, "the that", None)
    assert "In(chunk_id, [" in found._jdf.queryExecution().toString()


class Session:
    """What shared_folder looks at."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.master, self.applicationId = master, master


def test_shared_folder():
    assert scratch.shared_folder(Session("spark://host", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session("spark://host"))
    assert scratch.shared_folder(Session("local[2]")) == scratch.shared_folder(Session("local[2]")) != scratch.shared_folder(Session("local[3]"))


def test_tables_are_tidied(spark):
    import os

    folder = scratch.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scratch.tidied(spark) as keep:
        scratch.written(spark.range(3), "gone")
        with scratch.tidied(spark) as inner:
            stays = keep(inner(scratch.written(spark.range(4), "kept")))
            scratch.written(spark.range(5), "gone")
    assert stays.count() == 4 and len(set(os.listdir(folder)) - before) == 1


def test_stop(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as string) k", "1 at", "'n' name", "'r' ra").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k string, at int, name string, ra string").parquet(f"file://{tmp_path}/in")
    q = ingest.stream_upserts(stream, f"file://{tmp_path}/store", f"file://{tmp_path}/progress", "k", "at", ["name"], ["ra"], interval="1 second")
    until = time.monotonic() + 60
    while not ingest.versions(spark, f"file://{tmp_path}/store") and time.monotonic() < until:
        time.sleep(0.5)
    ingest.stop(q)
    assert not q.isActive and ingest.snapshot(spark, f"file://{tmp_path}/store").count() == 3


def test_documents_keep_what_is_theirs(spark):
    """Documents whose keys are equal or null, and equal documents, are parsed each by itself; nothing is shuffled."""
    page = lambda dept, *more: f"<table><tr><td>Department Name</td><td>{dept}</td></tr>{''.join(more)}</table>"
    again = "<tr><td>Department Name</td><td>Z</td></tr><tr><td>Total Quantity</td><td>7</td></tr>"
    docs = spark.createDataFrame([(1, page("A"), "x"), (1, page("B"), "x"), (None, page("C"), "x"), (None, page("C"), "x"), (2, page("D", again), "x"), (3, None, "x"), (None, "", None)], "doc int, md string, product_type string")
    parsed = sections.parse_documents(docs)
    got = sorted(((r.doc, r.pdf.departments.department_name, r.pdf["items"].total_quantity_extracted) for r in parsed.collect()), key=str)
    assert got == sorted([(1, "A", None), (1, "B", None), (None, "C", None), (None, "C", None), (2, "Z", 7), (3, None, None), (None, None, None)], key=str)
    assert "Exchange" not in parsed._jdf.queryExecution().toString()


def test_line_breaks_stay_on_demand(spark):
    """strip_br=False keeps the tags that the parser passes on as text, and cells all the same."""
    docs = spark.createDataFrame([(1, "<table><tr><td>Ministry</td><td>a &lt;br&gt;  b</td></tr></table>", "x")], "doc int, md string, product_type string")
    names = [sections.parse_documents(docs, strip_br=b).first().pdf.departments.ministry_state_name for b in (True, False)]
    assert names == ["a b", "a <br> b"]


def test_pairs_of_equal_keys(spark):
    rows = "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in [("EMD Amount", "10"), ("b", "1"), ("EMD Amount", "25"), ("emd amount (x)", "5"), ("b", "2"), ("", "no key"), ("one cell only", "")])
    docs = tables.with_tables(spark.createDataFrame([(f"<table>{rows}<tr><td>alone</td></tr></table>",), (None,)], "md string"))
    kv = docs.select(tables.pairs(F.col("tables")).alias("kv"))
    got, none = kv.select(tables.key_values(F.col("kv")).alias("all"), tables.kv_get(F.col("kv"), "B").alias("b"), tables.kv_get(F.col("kv"), "emd").alias("emd"), sections.emd_total(F.col("kv")).alias("total")).collect()
    assert [(e.key, e.value) for e in got["all"]] == [("EMD Amount", "25"), ("b", "2"), ("emd amount (x)", "5"), ("one cell only", "")]
    assert (got.b, got.emd, got.total) == ("2", "25", 30)
    assert (none.b, none.total) == (None, None) and not none["all"]

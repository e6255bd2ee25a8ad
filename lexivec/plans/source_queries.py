"""Queries of sources, sinks, the index's upkeep and the stream: each writes with the library's own sinks into the shared
folder and reads back what came of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators import index, reports, sections, store
from lexivec.operators.scratch import delete, scratch
from lexivec.plans.document_queries import CATEGORY, METHOD, flat, from_orders
from lexivec.plans.document_queries import documents as order_documents
from lexivec.plans.document_queries import PARSED, evaluated
from lexivec.plans.registry import query
from lexivec.sources import landing, paged
from lexivec.streaming import ingest

# ---- sources


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '1996-06-30'")
def open_records(spark, d):
    """Captured listing pages, by their type, and of these the open ones."""
    path = scratch(spark, "listing")
    landing.read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderpriority").alias("bid_type"), F.col("o_orderdate").alias("end_ts")).write.parquet(path)
    rows = landing.open_records(landing.listing_pages(spark, path), "1-URGENT", now=F.lit("1996-06-30").cast("timestamp"))
    return rows.select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042'")
def one_record(spark, d):
    return landing.one_record(landing.read_table(spark, d, "customer"), "Customer#000000042", "c_name").select("c_custkey", "c_name")


NEW = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END"


@query(f"""WITH e AS (SELECT user_id, event_id, {NEW} AS fresh FROM events),
    s AS (SELECT *, CASE WHEN fresh IS NULL THEN 2 WHEN fresh = 0 THEN 1 ELSE 0 END AS step FROM e),
    g AS (SELECT *, sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s),
    k AS (SELECT *, sum(step) OVER (PARTITION BY user_id, run ORDER BY event_id) AS streak FROM g),
    b AS (SELECT *, max(streak) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
    SELECT user_id, event_id FROM b WHERE coalesce(before, 0) < 3""")
def until_empty(spark, d):
    pages = landing.read_table(spark, d, "events").select("user_id", "event_id", F.expr(NEW).alias("fresh"))
    return landing.until_empty(pages, "user_id", "event_id", "fresh").select("user_id", "event_id")


MONTH = "(year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1"
OF_PAGE = f"o_orderkey % 2 = 1 AND ({MONTH} + 4 * length(o_orderpriority)) % 67 NOT IN (64, 65, 66)"


@query(f"""WITH o AS (SELECT o_orderpriority AS listing, {MONTH} AS page, o_orderkey, {OF_PAGE} AS new FROM orders WHERE o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED', '5-LOW')),
    n AS (SELECT listing, page, count(o_orderkey) AS cards, count(*) FILTER (new) AS fresh FROM (SELECT DISTINCT listing FROM o) CROSS JOIN (SELECT unnest(generate_series(0, 100)) AS page) LEFT JOIN o USING (listing, page) GROUP BY ALL),
    s AS (SELECT *, CASE WHEN cards = 0 THEN 2 WHEN fresh = 0 THEN 1 ELSE 0 END AS step FROM n),
    g AS (SELECT *, sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY listing ORDER BY page) AS run FROM s),
    k AS (SELECT *, sum(step) OVER (PARTITION BY listing, run ORDER BY page) AS streak FROM g),
    b AS (SELECT *, max(streak) OVER (PARTITION BY listing ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
    SELECT listing, CAST(page AS INT) AS page, o_orderkey, new FROM o JOIN b USING (listing, page) WHERE coalesce(before, 0) < 3""")
def paged_listing(spark, d):
    """Captured pages, one a month of each priority, asked for in turn until three in a row have nothing new; of two
    priorities no page is asked for."""
    folder = scratch(spark, "pages")
    orders = landing.read_table(spark, d, "orders")
    cards = orders.select(F.col("o_orderpriority").alias("listing"), F.expr(MONTH).alias("page"), F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("card"), F.expr(OF_PAGE).alias("new"))).alias("value"))
    cards.repartition("listing", "page").write.partitionBy("listing", "page").text(folder)
    names = [r[0] for r in orders.select("o_orderpriority").distinct().collect()]
    rows = paged.paged_listing(spark, names, paged.captured_pages(folder)).where(F.col("listing").isin("1-URGENT", "4-NOT SPECIFIED", "5-LOW"))
    return rows.select("listing", "page", F.col("card").cast("long").alias("o_orderkey"), "new")


@query("SELECT s_name AS url, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'body of ' || s_name END AS body, CAST(CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 3 END AS INT) AS attempts, CASE WHEN s_suppkey % 4 = 3 THEN 'attempt 3 failed' END AS error FROM supplier")
def fetch_with_retries(spark, d):
    """Each fourth document needs one attempt, two, three, or never comes."""

    def fetch(url: str) -> bytes:
        if not hasattr(fetch, "tries"):
            fetch.tries = {}
        fetch.tries[url] = k = fetch.tries.get(url, 0) + 1
        if k <= int(url.rpartition("#")[2]) % 4:
            raise OSError(f"attempt {k} failed")
        return f"body of {url}".encode()

    got = landing.fetched(landing.read_table(spark, d, "supplier").select(F.col("s_name").alias("url")), fetch, delay=0.0)
    return got.select("url", F.col("content").cast("string").alias("body"), "attempts", "error")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE upper(p_name) END AS md, CASE WHEN p_partkey % 5 = 0 THEN 'no document ' || p_partkey END AS error FROM part")
def convert_documents(spark, d):
    """A converter that is given; its failures are rows."""

    def convert(content: bytes) -> str:
        key, _, name = content.decode().partition("|")
        if int(key) % 5 == 0:
            raise ValueError(f"no document {key}")
        return name.upper()

    files = landing.read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name").cast("binary").alias("content"))
    return landing.converted(files, convert).select(F.col("path").cast("long").alias("p_partkey"), "md", "error")


@query("SELECT s_name AS name, 'text of ' || s_name || chr(10) || s_suppkey AS md, CASE WHEN s_suppkey % 2 = 0 THEN '{\"k\": ' || s_suppkey || '}' END AS js FROM supplier")
def document_pairs(spark, d):
    """Documents in folders of their names, and converters' JSON beside them for every second one."""
    path = scratch(spark, "pairs")
    rows = landing.read_table(spark, d, "supplier").withColumn("name", F.concat(F.lit("name="), F.regexp_replace("s_name", "#", "-")))
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, "s_suppkey")
    text = F.concat(F.lit("text of "), "s_name", F.lit("\n"), F.col("s_suppkey").cast("string"), F.lit("\n"))
    landing.write_files(rows.select(F.concat("name", F.lit("/text.txt")).alias("path"), text.alias("content")), f"{path}/md")
    given = rows.where("s_suppkey % 2 = 0").select(F.concat("name", F.lit("_DOCLING_EXTRACTED.json")).alias("path"), F.format_string('{"k": %d}', "s_suppkey").alias("content"))
    landing.write_files(given, f"{path}/js")
    got = landing.document_pairs(spark, f"{path}/md", f"{path}/js", md_suffix=".txt")
    return got.select(F.regexp_replace(F.regexp_replace("id", "^name=", ""), "-", "#").alias("name"), F.regexp_replace("md", r"\n$", "").alias("md"), F.col("converter_json").alias("js"))


# ---- sinks


@query("SELECT r_name AS bid_type, CAST(r_regionkey AS INT) AS scraped, CAST(r_regionkey % 2 AS INT) AS new_bids, CAST(NULL AS INT) AS errors, r_regionkey / 2.0::DOUBLE AS duration_sec FROM region")
def run_log(spark, d):
    path = scratch(spark, "runs")
    for r in landing.read_table(spark, d, "region").collect():  # five runs
        store.log_run(spark, path, {"run_at": "now", "bid_type": r.r_name, "scraped": r.r_regionkey, "new_bids": r.r_regionkey % 2, "duration_sec": r.r_regionkey / 2})
    return spark.read.parquet(path).drop("run_at")


@query("SELECT doc_id AS document_url, lang, source, n_chars FROM documents")
def export_json(spark, d):
    path = scratch(spark, "export")
    rows = landing.read_table(spark, d, "documents").withColumn("first_seen", F.lit(1)).withColumnRenamed("doc_id", store.KEY)
    store.export_json(rows, path, ("text",))
    return spark.read.schema("document_url long, lang string, source string, n_chars long").json(path)


@query(f"SELECT {CATEGORY} AS eval_category, o_orderkey AS k, {METHOD} AS text FROM orders")
def routed_by_category(spark, d):
    """Documents in folders of their category, in files of at most 500."""
    path = scratch(spark, "categories")
    reports.write_by_category(evaluated(spark, d), "text", path, 500)
    return spark.read.schema("k long, text string, eval_category string").json(path).select("eval_category", "k", "text")


@query("SELECT CAST(0 AS BIGINT) AS files_beyond, count(*) AS n FROM orders")
def flushed_in_files(spark, d):
    """No file has more records than a writer holds."""
    path = scratch(spark, "flushed")
    reports.write_by_category(evaluated(spark, d), "text", path, 300)
    files = spark.read.schema("k long").json(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return files.agg(F.count_if(F.col("n") > 300).alias("files_beyond"), F.sum("n").alias("n"))


@query("SELECT n_regionkey || '_' || n_name AS folder, n_nationkey, n_name AS md FROM nation UNION ALL SELECT 'unknown_bid', -1, 'none'")
def artifact_files(spark, d):
    path = scratch(spark, "artifacts")
    rows = landing.read_table(spark, d, "nation").select(F.concat_ws("/", F.col("n_regionkey").cast("string"), "n_name").alias("bid_no"), "n_nationkey", F.col("n_name").alias("md"))
    rows = rows.union(spark.range(1).select(F.lit(""), F.lit(-1), F.lit("none")))
    reports.write_artifacts(rows, "bid_no", ["n_nationkey", "md"], path)
    return spark.read.schema("n_nationkey int, md string, safe_bid_no string").json(path).select(F.col("safe_bid_no").alias("folder"), "n_nationkey", "md")


@query(f"SELECT {CATEGORY} || ': ' || o_custkey || ': ' || o_orderkey AS line FROM orders")
def listing_file(spark, d):
    path = scratch(spark, "lines")
    reports.write_listing(evaluated(spark, d), "text", "o_custkey", "k", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT c_name, coalesce(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END, 'Unknown') AS page FROM customer")
def page_mapping(spark, d):
    path = scratch(spark, "mapping")
    rows = landing.read_table(spark, d, "customer")
    reports.write_mapping(rows.where("c_custkey % 3 = 0").select("c_name", F.col("c_nationkey").cast("string").alias("page")), "c_name", "page", path)
    return reports.with_pages(rows.select("c_name"), reports.read_mapping(spark, path, "c_name"), "c_name")


@query("SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after FROM region")
def reset_store(spark, d):
    path = scratch(spark, "store")
    landing.read_table(spark, d, "region").write.parquet(f"{path}/version=000000000000")
    before = ingest.snapshot(spark, path).count()
    store.reset(spark, path)
    after = ingest.snapshot(spark, path)
    return spark.createDataFrame([(before, 0 if after is None else after.count())], "n_before long, n_after long")


@query(from_orders(("doc", "o_orderkey"), *[(c, e) for c, e in PARSED if c in ("timing_bid_end_datetime", "departments_office_name", "people", "schedules", "emd_required", "disclaimer")]))
def parse_driver(spark, d):
    """Parsed documents written as JSON and read again."""
    path = scratch(spark, "parsed")
    parsed = sections.parse_documents(order_documents(spark, d))
    parsed.write.json(path)
    return flat(spark.read.schema(parsed.schema).json(path)).select("doc", "timing_bid_end_datetime", "departments_office_name", "people", "schedules", "emd_required", "disclaimer")


# ---- index

CARD_SQL = "'Bid Number: ' || doc_id || '. RA Number: . Bid Type: . Product Type: ' || coalesce(lang, '') || '. Item: . Items mentioned: . Quantity: ' || coalesce(CAST(n_chars AS VARCHAR), '') || '. Department: ' || coalesce(source, '') || '. Start Date: . End Date: . Estimated Value: . Bid Packet Type: .'"
PASSAGES_SQL = f"""
    b AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
    w AS (SELECT doc_id, unnest(range(0, length(t), 700)) AS start, t FROM b WHERE length(t) >= 10),
    c AS (SELECT doc_id, start, trim(substr(t, start + 1, 800)) AS chunk FROM w WHERE length(trim(substr(t, start + 1, 800))) > 20 UNION ALL SELECT doc_id, -1, {CARD_SQL} FROM documents),
    u AS (SELECT CAST(doc_id AS VARCHAR) AS bid_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS chunk_index, chunk, length(chunk) - length(replace(chunk, 'a', '')) AS a, length(chunk) - length(replace(chunk, 'e', '')) AS e FROM c)"""


def records(spark, d: str) -> DataFrame:
    return landing.read_table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("bid_no"), F.col("lang").alias("product_type"), F.col("source").alias("department"), F.col("n_chars").alias("quantity"), F.col("text").alias("full_pdf_text"))


def letters(texts: list[str]) -> list[list[float]]:
    """A model whose vectors SQL can compute."""
    return [[float(t.count("a")), float(t.count("e")), 1.0] for t in texts]


@query(f"WITH {PASSAGES_SQL} SELECT bid_no, chunk_index, md5(chunk) AS chunk_md5, round(a / sqrt(a * a + e * e + 1), 6) AS x, round(e / sqrt(a * a + e * e + 1), 6) AS y FROM u")
def index_build(spark, d):
    """Records to a stored index with cards, passages and vectors."""
    root = scratch(spark, "index-of-records")
    index.reindex(spark, records(spark, d), root, embed=letters)
    chunks, _ = index.stored(spark, root)
    return chunks.select("bid_no", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), F.round(F.col("embedding")[0], 6).alias("x"), F.round(F.col("embedding")[1], 6).alias("y"))


TWICE_SQL = """WITH r AS (SELECT doc_id, 'first text of ' || doc_id || ' that a later one replaces' AS t, 0 AS k FROM documents UNION ALL
        SELECT doc_id, 'text number ' || doc_id || ' of the record as it came last', 1 FROM documents WHERE doc_id % 3 = 0),
    b AS (SELECT arg_max(t, k) AS t, CASE WHEN doc_id % 4 = 0 THEN 'http://p/' || doc_id WHEN doc_id % 4 <> 1 THEN 'b' || doc_id END AS key FROM r WHERE doc_id % 4 <> 1 GROUP BY doc_id
          UNION ALL SELECT DISTINCT t, NULL FROM r WHERE doc_id % 4 = 1)"""


@query(f"{TWICE_SQL} SELECT CASE WHEN key IS NULL THEN 'unknown' ELSE key END AS record, CAST(count(*) AS BIGINT) AS n_records, min(t) AS least, max(t) AS most FROM b GROUP BY 1")
def record_once(spark, d):
    """Records of which a third comes twice, in one batch; some have a number, some only an address, some neither: each has its
    chunks once, from its last sighting, and those without a name are told apart by what they say."""
    docs = landing.read_table(spark, d, "documents").select("doc_id")
    name = lambda c, *kinds: F.when((F.col("doc_id") % 4).isin(*kinds), F.concat(F.lit(c), F.col("doc_id").cast("string"))).otherwise("")
    one = lambda text, seen: docs.select(name("b", 2, 3).alias("bid_no"), name("http://p/", 0, 2).alias("document_url"), F.format_string(text, "doc_id").alias("full_pdf_text"), F.lit(seen).alias("last_seen"), "doc_id")
    batch = one("text number %d of the record as it came last", 2).where("doc_id % 3 = 0").union(one("first text of %d that a later one replaces", 1))
    root = scratch(spark, "index-of-repeats")
    index.update(spark, batch.drop("doc_id"), root, size=5000)
    chunks, words = index.stored(spark, root)
    body = chunks.where("chunk_index = 1").withColumn("record", F.when(F.col("bid_no").startswith("unknown-"), "unknown").otherwise(F.col("bid_no")))
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select(F.col("chunk_id").alias("record"), F.col("count").alias("n_records"), F.lit("").alias("least"), F.lit("").alias("most"))
    return body.groupBy("record").agg(F.count("*").alias("n_records"), F.min("chunk").alias("least"), F.max("chunk").alias("most")).union(twice)


@query("SELECT CAST(doc_id AS VARCHAR) AS bid_no, coalesce(lang, '') AS product_type, coalesce(source, '') AS department, '' AS ra_no, '' AS corrigendum_url, coalesce(CAST(n_chars AS VARCHAR), '') AS quantity FROM documents")
def index_metadata(spark, d):
    """The metadata of each record's first chunk, '' where the record has none."""
    return index.record_chunks(records(spark, d)).where("chunk_index = 0").select("bid_no", "product_type", "department", "ra_no", "corrigendum_url", "quantity")


@query(f"WITH {PASSAGES_SQL} SELECT bid_no, chunk_index, 'no vowel allowed' AS embed_error FROM u WHERE contains(chunk, 'qu') AND chunk_index > 0")
def embed_errors(spark, d):
    """A model that fails for some passages: their batches are tried one by one, and these alone stay without a vector."""

    def model(texts: list[str]) -> list[list[float]]:
        if any("qu" in t and not t.startswith("Bid Number") for t in texts):
            raise ValueError("no vowel allowed")
        return letters(texts)

    chunks = index.embedded(index.record_chunks(records(spark, d)), model)
    ok = F.col("embedding").isNull() == F.col("embed_error").isNotNull()
    return chunks.where(F.col("embed_error").isNotNull() | ~ok).select("bid_no", "chunk_index", "embed_error")


CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN coalesce(text, '') || ' changed text' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2)"


@query(f"""WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM {CHANGED}),
    c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
    r AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM w) GROUP BY term),
    i AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw, n, avgdl FROM r, c)
    SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM i""")
def index_incremental(spark, d):
    """An index of most documents, to which new and changed ones come and from which some go: its word statistics are
    those of the documents that are left."""
    root = scratch(spark, "index-by-segments")
    docs = landing.read_table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("bid_no"), F.coalesce("text", F.lit("")).alias("chunk"))
    index.add_segment(spark, root, docs.where("bid_no % 10 <> 0"), F.col("chunk"))
    later = docs.where("bid_no % 10 < 2").withColumn("chunk", F.when(F.col("bid_no") % 10 == 1, F.concat("chunk", F.lit(" changed text"))).otherwise(F.col("chunk")))
    index.add_segment(spark, root, later, F.col("chunk"), gone=later.select("bid_no"))
    index.remove(spark, docs.where("bid_no % 10 = 2").select("bid_no"), root)
    _, words = index.stored(spark, root)
    return words.terms.crossJoin(F.broadcast(words.corpus)).select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT doc_id, md5(regexp_replace({CARD_SQL} || chr(10) || coalesce(text, ''), '\\s+$', '')) AS document_md5, md5(lower(' ' || coalesce(source, '') || '  ' || coalesce(lang, '') || ' ' || doc_id || ' ' || coalesce(text, ''))) AS rich_md5, substr(coalesce(text, ''), 1, 40) AS shown FROM documents")
def record_texts(spark, d):
    """A record as one text, as the text of its words, and as it is shown in lists."""
    rows = records(spark, d)
    card = T.metadata_card({c: F.col(c) for c in ("bid_no", "product_type", "department", "quantity")})
    rich = T.rich_text(F.lit(""), F.col("department"), F.lit(""), F.col("product_type"), F.col("bid_no"), F.col("full_pdf_text"))
    return rows.select(F.col("bid_no").cast("long").alias("doc_id"), F.md5(T.record_document(card, F.col("full_pdf_text")).cast("binary")).alias("document_md5"), F.md5(rich.cast("binary")).alias("rich_md5"), T.shortened(F.col("full_pdf_text"), 40).alias("shown"))


@query("SELECT count(DISTINCT user_id) AS total, count(DISTINCT user_id) FILTER (user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) = 1)) AS new, (SELECT count(*) FROM part) AS n_chunks, (SELECT count(DISTINCT p_brand) FROM part) AS n_records FROM events")
def combined_stats(spark, d):
    """Counts of the store and the index in one row."""
    log = landing.read_table(spark, d, "events")
    snapshot = store.snapshot_of_log(log, "user_id", "ts", ["event_type"], ["props"], "event_id")
    chunks = landing.read_table(spark, d, "part").select("p_brand")
    return store.stats(snapshot).crossJoin(index.health(chunks, "p_brand").select("n_chunks", "n_records"))


# ---- stream

TWO_DAYS = "(SELECT * FROM events WHERE user_id IS NOT NULL)"
HALF = "TIMESTAMP '2024-01-15'"


@query(f"SELECT batch, what, error, n_new, n_flagged FROM (SELECT CAST(1 AS BIGINT) AS batch, 'on_new' AS what, 'no index today' AS error, (SELECT count(DISTINCT user_id) FROM {TWO_DAYS} WHERE ts >= {HALF} AND user_id NOT IN (SELECT user_id FROM {TWO_DAYS} WHERE ts < {HALF})) AS n_new, CAST(0 AS BIGINT) AS n_flagged)")
def failing_consumer(spark, d):
    """The second of two batches has a consumer that fails: the stream ends well, the store is whole, the failure is a row.
    New records were alerted and their flags reset."""
    root = scratch(spark, "guarded")
    rows = landing.read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "props").where("user_id is not null")
    alerts: list[int] = []
    met: list[int] = []

    def on_new(new: DataFrame) -> None:
        met.append(new.count())
        if len(met) == 2:
            raise RuntimeError("no index today")

    for k, part in enumerate((rows.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp")), rows.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")))):
        part.write.parquet(f"{root}/in/part={k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        ingest.stream_upserts(stream, f"{root}/store", f"{root}/progress", "user_id", "ts", ["event_type"], ["props"], "event_id", on_new=on_new, alert=lambda new: alerts.append(new.count())).awaitTermination()
    flagged = ingest.snapshot(spark, f"{root}/store").where("is_new = 1").count()
    return ingest.errors(spark, f"{root}/store").select("batch", "what", "error", F.lit(met[-1]).cast("long").alias("n_new"), F.lit(flagged).cast("long").alias("n_flagged"))


@query(f"""WITH {PASSAGES_SQL}, t AS (SELECT u.bid_no, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', coalesce(source, ''), coalesce(lang, ''), u.bid_no, chunk)), '\\s+'), lambda x: x <> '')) AS term
    FROM u JOIN documents ON CAST(doc_id AS VARCHAR) = u.bid_no) SELECT term, count(DISTINCT bid_no) AS df FROM t GROUP BY term""")
def stream_index(spark, d):
    """All records arrive in two batches; the consumer of new ones keeps the index up to date."""
    root = scratch(spark, "stream-index")
    rows = records(spark, d).withColumns({"document_url": F.col("bid_no"), "ra_no": F.lit(""), "seen_at": F.lit(1)})
    for k in range(2):
        rows.where(F.col("bid_no").cast("long") % 2 == k).write.option("compression", "zstd").parquet(f"{root}/in/part={k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        ingest.stream_upserts(stream, f"{root}/store", f"{root}/progress", store.KEY, "seen_at", ["bid_no", "product_type", "department", "quantity", "full_pdf_text"], ["ra_no"], on_new=ingest.indexing(spark, f"{root}/index")).awaitTermination()
    _, words = index.stored(spark, f"{root}/index")
    of = index.records_by_term(words.postings)
    delete(spark, f"{root}/in")
    return of

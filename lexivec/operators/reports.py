"""Reports over parsed documents and runs: categories, timings, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.text import evaluation_method, safe_key


def wanted_files(names: Column) -> Column:
    """Documents by file name: .pdf in any case, but no revision (_RA.pdf as it stands)."""
    return F.lower(names).endswith(".pdf") & ~names.endswith("_RA.pdf")


def revision_of(base: DataFrame, revisions: DataFrame, name: str = "name") -> DataFrame:
    """Base documents with the revision of the same name, if there is one."""
    other = revisions.select(F.regexp_replace(name, r"_RA$", "").alias(name), F.col(name).alias("revision"))
    return base.join(other, name, "left")


def with_pages(rows: DataFrame, pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """Rows with the listing page of their key, 'Unknown' without one."""
    return rows.join(pages.select(key, F.col(page).cast("string").alias(page)), key, "left").withColumn(page, F.coalesce(page, F.lit("Unknown")))


def has_text_layer(first_page: Column, least: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(first_page, F.lit("")))) > least


def joined_pages(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Texts of pages in order, with break marks between them."""
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(number, text))).alias("p"))
    return rows.select(key, F.array_join(F.transform("p", lambda x: x[text]), "\n\n---PAGE BREAK---\n\n").alias("text"))


def categories(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("eval_category", evaluation_method(F.col(text)))


def category_counts(docs: DataFrame, text: str) -> DataFrame:
    return categories(docs, text).groupBy("eval_category").agg(F.count("*").alias("n"))


def listing(docs: DataFrame, text: str, page: str, name: str) -> DataFrame:
    """eval_category, page, name of each document, by category and page: sorted by ranges, so that no category meets
    in one task."""
    return categories(docs, text).select("eval_category", page, name).orderBy("eval_category", page, name)


def write_listing(docs: DataFrame, text: str, page: str, name: str, path: str) -> None:
    """The listing as lines of text, in order of the files' names."""
    rows = listing(docs, text, page, name)
    rows.select(F.concat_ws(": ", "eval_category", F.col(page).cast("string"), F.col(name).cast("string")).alias("value")).write.mode("overwrite").text(path)


def throughput(counts: DataFrame, seconds: float) -> DataFrame:
    """Category counts with their rate."""
    return counts.withColumn("per_second", F.col("n") / F.nullif(F.lit(float(seconds)), F.lit(0.0)))


def write_mapping(rows: DataFrame, key: str, page: str, path: str) -> None:
    """Which page each record was on, as JSON lines {key, page}."""
    rows.select(F.col(key).cast("string").alias("key"), F.col(page).alias("page")).write.mode("overwrite").json(path)


def read_mapping(spark, path: str, key: str) -> DataFrame:
    return spark.read.schema("key string, page string").json(path).select(F.col("key").alias(key), "page")


def timings(rows: DataFrame, stage: str, seconds: str) -> DataFrame:
    return rows.groupBy(stage).agg(F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.count("*").alias("n"))


#: Records of one file of a sink: what a writer holds before it begins the next.
FILE_ROWS = 2000


def write_by_category(docs: DataFrame, text: str, path: str, file_rows: int = FILE_ROWS) -> None:
    categories(docs, text).write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("eval_category").json(path)


def write_artifacts(docs: DataFrame, key: str, columns: Sequence[str], path: str, file_rows: int = FILE_ROWS) -> None:
    """Texts of documents in one folder a key."""
    docs.select(safe_key(F.col(key).cast("string")).alias("safe_bid_no"), *columns).write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("safe_bid_no").json(path)

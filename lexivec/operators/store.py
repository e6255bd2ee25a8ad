"""The record store: keyed upsert with first and last sighting, new-record flags, logs and exports.

Parquet has no row updates, so an upsert is a rewrite of the snapshot; a whole log of sightings gives the same
snapshot by one aggregation. First-seen columns never change; last-seen columns take the newest value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.operators.scratch import delete, written

KEY = "document_url"
#: Columns that keep their first value, and those that take the last.
FIXED = ("bid_no", "bid_type", "product_type", "full_item_name", "quantity", "department", "start_date", "end_date", "estimated_value", "bid_packet_type", "full_pdf_text")
FRESH = ("ra_no", "corrigendum_url")


def snapshot_of_log(sightings: DataFrame, key: str, at: str, fixed: Sequence[str], fresh: Sequence[str], tie: str | None = None) -> DataFrame:
    """One row a key from all sightings: first values, last values, first_seen, last_seen, is_new (seen once). tie
    orders sightings of one time."""
    order = F.struct(at, tie) if tie else F.col(at)
    aggs = [F.min_by(c, order).alias(c) for c in fixed] + [F.max_by(c, order).alias(c) for c in fresh]
    return named(sightings, key).groupBy(key).agg(*aggs, F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.when(F.count("*") == 1, 1).otherwise(0).alias("is_new"))


def named(sightings: DataFrame, key: str) -> DataFrame:
    return sightings.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def snapshot_of_batch(batch: DataFrame, key: str, at: str, fixed: Sequence[str], fresh: Sequence[str], tie: str | None = None) -> DataFrame:
    """snapshot_of_log of a batch, which is read once. Where most rows' keys come once, these rows stay where they are, and only
    keys that come again meet."""
    rows = written(named(batch, key).select(*dict.fromkeys([key, at, *([tie] if tie else []), *fixed, *fresh])), "sightings")
    twice = written(rows.groupBy(F.col(key).alias("_again")).count().where("count > 1"), "twice")
    met = twice.agg(F.sum("count")).first()[0] or 0
    if 2 * met > rows.count():
        return written(snapshot_of_log(rows, key, at, fixed, fresh, tie), "batch")
    same = F.col(key) == F.col("_again")
    # A sighting without time has no values, as in snapshot_of_log.
    value = lambda c: (F.col(c) if tie else F.when(F.col(at).isNotNull(), F.col(c))).alias(c)
    once = rows.join(twice, same, "left_anti") if met else rows
    once = once.select(key, *map(value, (*fixed, *fresh)), F.col(at).alias("first_seen"), F.col(at).alias("last_seen"), F.lit(1).alias("is_new"))
    return once.unionByName(written(snapshot_of_log(rows.join(twice, same, "left_semi"), key, at, fixed, fresh, tie), "batch")) if met else once


def upsert(snapshot: DataFrame, batch: DataFrame, key: str, at: str, fixed: Sequence[str], fresh: Sequence[str], tie: str | None = None) -> DataFrame:
    """The snapshot after a batch of sightings (key, at, values)."""
    return merged(snapshot, snapshot_of_log(batch, key, at, fixed, fresh, tie), key, fixed, fresh)


def merged(snapshot: DataFrame, later: DataFrame, key: str, fixed: Sequence[str], fresh: Sequence[str]) -> DataFrame:
    """A snapshot and that of a later batch as one."""
    new = later.select(key, *[F.col(c).alias(f"new_{c}") for c in (*fixed, *fresh, "first_seen", "last_seen", "is_new")])
    both = snapshot.join(new, key, "full_outer")
    known, again = F.col("first_seen").isNotNull(), F.col("new_first_seen").isNotNull()
    keep = [F.when(known, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in fixed]
    last = [F.when(again, F.coalesce(F.col(f"new_{c}").cast("string"), F.lit(""))).otherwise(F.col(c).cast("string")).cast(snapshot.schema[c].dataType).alias(c) for c in fresh]
    flag = F.when(known & ~again, F.col("is_new")).when(known, 0).otherwise(F.col("new_is_new")).cast("int").alias("is_new")
    return both.select(key, *keep, *last, F.coalesce("first_seen", "new_first_seen").alias("first_seen"), F.coalesce("new_last_seen", "last_seen").alias("last_seen"), flag)


def merged_where_met(snapshot: DataFrame, later: DataFrame, met: DataFrame, key: str, fixed: Sequence[str], fresh: Sequence[str]) -> DataFrame:
    """merged() of tables of which met has the keys that both have: where these are few, no other row is shuffled."""
    some = not met.isEmpty()
    apart = lambda rows: rows.join(met, key, "left_anti") if some else rows
    last = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast(snapshot.schema[c].dataType).alias(c) for c in fresh]
    first = apart(later).select(key, *fixed, *last, "first_seen", "last_seen", F.col("is_new").cast("int").alias("is_new"))
    out = apart(snapshot).select(*first.columns).unionByName(first)
    return out.unionByName(merged(*[x.join(met, key, "left_semi") for x in (snapshot, later)], key, fixed, fresh)) if some else out


def unseen(batch: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key the snapshot doesn't have."""
    return batch.join(snapshot.select(key), key, "left_anti")


def reseen(batch: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    return batch.join(snapshot.select(key), key, "left_semi")


def all_records(snapshot: DataFrame, key: str = KEY) -> DataFrame:
    return snapshot.orderBy(F.desc("first_seen"), key)


def new_records(snapshot: DataFrame, key: str = KEY) -> DataFrame:
    return all_records(snapshot.where("is_new = 1"), key)


def mark_seen(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("is_new", F.lit(0))


def once_per_key(rows: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """Rows with a key, the first of each by order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("_k", rank).where("_k = 1").drop("_k")


def limit_per_type(rows: DataFrame, kind: str, order: Sequence[str | Column], n: int = 10) -> DataFrame:
    """The first n rows of each kind."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def stats(snapshot: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """total, new and runs in one row."""
    out = snapshot.agg(F.count("*").alias("total"), F.count_if(F.col("is_new") == 1).alias("new"))
    return out.crossJoin(runs.agg(F.count("*").alias("runs"))) if runs is not None else out


def run_totals(runs: DataFrame, kind: str, sums: Sequence[str]) -> DataFrame:
    """Sums by kind and in all (kind null)."""
    return runs.rollup(kind).agg(*[F.sum(c).alias(c) for c in sums], F.grouping(kind).cast("int").alias("is_total"))


def log_run(spark, path: str, row: dict) -> None:
    """Append one row to a log of runs."""
    schema = "run_at string, bid_type string, scraped int, new_bids int, errors int, duration_sec double"
    spark.createDataFrame([tuple(row.get(x.split()[0]) for x in schema.split(", "))], schema).coalesce(1).write.mode("append").parquet(path)


def export_rows(snapshot: DataFrame, without: Sequence[str] = ("full_pdf_text",)) -> DataFrame:
    """JSON text of each record, without its long columns, newest first."""
    rows = snapshot.drop(*without)
    return all_records(rows).select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def export_json(snapshot: DataFrame, path: str, without: Sequence[str] = ("full_pdf_text",)) -> None:
    """The same as a folder of JSON lines."""
    export_rows(snapshot, without).write.mode("overwrite").text(path)


def reset(spark, *paths: str) -> None:
    """Delete the folders of a store."""
    delete(spark, *paths)


def flatten_record(card: Column, pdf: Column, links: Column, md: Column) -> list[Column]:
    """The flat record of a card, its document and links; missing values are ''."""
    from lexivec.functions.text import clean_text, text_or_empty

    first = F.get(card["card"]["items"], F.lit(0))
    dept = F.get(card["card"]["departments"], F.lit(0))
    name = {
        "document_url": links["document_url"], "bid_no": card["bid"]["bid_no"], "ra_no": card["bid"]["ra_no"], "bid_type": card["bid"]["bid_type"], "product_type": card["bid"]["product_type"],
        "full_item_name": first["name"], "quantity": first["quantity"].cast("string"), "department": dept["name"], "start_date": card["card"]["start_datetime"], "end_date": card["card"]["end_datetime"],
        "estimated_value": F.lit(""), "bid_packet_type": pdf["bid_type"]["type_of_bid"], "corrigendum_url": links["corrigendum_url"], "full_pdf_text": clean_text(md),
    }
    return [text_or_empty(v).alias(k) for k, v in name.items()]

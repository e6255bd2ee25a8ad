"""Command line: python -m lexivec --root FOLDER and one of --reset, --stats, --reindex, --number N, --ask Q, --chat, --once IN."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.vectors import hashed
from lexivec.operators import index, store
from lexivec.operators.legacy import PRESETS
from lexivec.plans.config import Config
from lexivec.plans.engine import Engine, is_exit, parse_chat, parse_filter
from lexivec.streaming import ingest


def arguments() -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lexivec")
    p.add_argument("--root", required=True, help="folder of the record store and the index")
    one = p.add_mutually_exclusive_group(required=True)
    for flag in ("--reset", "--stats", "--reindex", "--chat"):
        one.add_argument(flag, action="store_true")
    one.add_argument("--number", help="one record by its number")
    one.add_argument("--ask", metavar="QUESTION")
    one.add_argument("--once", metavar="FOLDER", help="take all new sightings (parquet) of a folder, with columns of the store and seen_at")
    p.add_argument("--filter", metavar="KEY=VALUE")
    p.add_argument("--top-k", type=int)
    p.add_argument("--preset", choices=sorted(PRESETS), help="a bundle of settings")
    return p.parse_args()


def stats(spark: SparkSession, snapshot: DataFrame, words: str) -> DataFrame:
    """One row: total, new, n_chunks, n_records, ratio, state; null for an index that isn't there yet."""
    one = store.stats(snapshot)
    if index.segments(spark, words):
        return one.crossJoin(index.health(index.stored(spark, words)[0], "bid_no"))
    none = F.lit(None)
    return one.select("*", none.cast("long").alias("n_chunks"), none.cast("long").alias("n_records"), none.cast("double").alias("ratio"), none.cast("string").alias("state"))


def main(spark: SparkSession, a: argparse.Namespace) -> None:
    config = Config.from_env().preset(a.preset) if a.preset else Config.from_env()
    records, words = f"{a.root}/records", f"{a.root}/index"
    if a.reset:
        store.reset(spark, records, words, f"{a.root}/progress")
    elif a.once:
        schema = spark.read.parquet(a.once).schema
        stream = spark.readStream.schema(schema).parquet(a.once)
        fixed = [c for c in store.FIXED if c in schema.names]
        ingest.stream_upserts(stream, records, f"{a.root}/progress", store.KEY, "seen_at", fixed, list(store.FRESH), on_new=ingest.indexing(spark, words, hashed) if index.segments(spark, words) else None, alert=lambda df: print("new records:", df.count())).awaitTermination()
    elif (snapshot := ingest.snapshot(spark, records)) is None:
        print("The store is empty.")
    elif a.stats:
        stats(spark, snapshot, words).show()
    elif a.reindex:
        index.reindex(spark, snapshot, words, size=config.chunk_size, overlap=config.chunk_overlap, embed=hashed)
    elif a.number:
        snapshot.where(F.col("bid_no") == a.number).drop("full_pdf_text").show(truncate=False, vertical=True)
    elif not index.segments(spark, words):
        print("There is no index yet: --reindex makes one.")
    else:
        engine = Engine(*index.stored(spark, words), embed=lambda q: hashed([q])[0], top_k=config.top_k)
        if a.ask:
            print(engine.ask(a.ask, parse_filter(a.filter) if a.filter else None, a.top_k)["answer"])
            return
        while (line := input("> ").strip()) and not is_exit(line):
            print(engine.ask(*parse_chat(line), a.top_k)["answer"])


if __name__ == "__main__":
    main(SparkSession.builder.appName("lexivec").config("spark.sql.session.timeZone", "UTC").getOrCreate(), arguments())

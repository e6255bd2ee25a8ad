"""Micro-batches into the record store: sightings in, snapshot out, new records to the index and to a sink.

Each batch rewrites the snapshot to a folder of its own, named by the batch's number, and then moves the pointer; a
batch that is replayed after a failure starts from the snapshot before it, so its effect is the same. Snapshots but the
last KEPT are deleted. What is done with new records may fail without harm to the store or the stream: the failure is a
row in the errors beside the store.
"""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexivec.operators import index, store
from lexivec.operators.scratch import delete, tidied, written


def version_path(root: str, batch: int) -> str:
    return f"{root}/version={batch:012d}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete snapshots of a store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    done = [p for p in found if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def snapshot(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest snapshot, or the newest before a batch."""
    found = [v for v in versions(spark, root) if before is None or v < before]
    return spark.read.parquet(version_path(root, found[-1])) if found else None


#: Snapshots that stay: the newest, and the one from which its batch is replayed.
KEPT = 2


def errors_path(root: str) -> str:
    return f"{root.rstrip('/')}-errors"


def guarded(spark: SparkSession, root: str, number: int, what: str, act: Callable[[DataFrame], None], rows: DataFrame) -> None:
    """Do something with rows; a failure becomes a row of the errors."""
    try:
        act(rows)
    except Exception as e:  # noqa: BLE001 - a consumer's failure must not end the stream
        row = spark.createDataFrame([(number, what, str(e))], "batch long, what string, error string")
        row.coalesce(1).write.mode("overwrite").json(f"{errors_path(root)}/batch_no={number:012d}/{what}")


def errors(spark: SparkSession, root: str) -> DataFrame:
    """batch, what, error of all failures of consumers."""
    return spark.read.option("recursiveFileLookup", "true").schema("batch long, what string, error string").json(errors_path(root))


def apply_batch(batch: DataFrame, number: int, root: str, key: str, at: str, fixed: Sequence[str], fresh: Sequence[str], tie: str | None = None, on_new: Callable[[DataFrame], None] | None = None, alert: Callable[[DataFrame], None] | None = None) -> None:
    """Upsert one batch. on_new gets the records that the store didn't have; alert those that are flagged as new, whose
    flags are reset then."""
    spark = batch.sparkSession
    old = snapshot(spark, root, before=number)
    with tidied(spark):
        new = store.snapshot_of_batch(batch, key, at, fixed, fresh, tie)
        met = written(store.reseen(new.select(key), old, key), "met") if old is not None else None
        out = store.merged_where_met(old, new, met, key, fixed, fresh) if met is not None else new
        if alert is not None:
            out = written(out, "flagged")
        (store.mark_seen(out) if alert is not None else out).write.mode("overwrite").option("compression", "zstd").parquet(version_path(root, number))
        if on_new is not None:
            guarded(spark, root, number, "on_new", on_new, store.unseen(new, met, key) if met is not None else new)
        if alert is not None:
            guarded(spark, root, number, "alert", alert, store.new_records(out, key))
    delete(spark, *[version_path(root, v) for v in versions(spark, root) if v <= number][:-KEPT])


def stream_upserts(sightings: DataFrame, root: str, checkpoint: str, key: str, at: str, fixed: Sequence[str], fresh: Sequence[str], tie: str | None = None, on_new: Callable[[DataFrame], None] | None = None, alert: Callable[[DataFrame], None] | None = None, interval: str | None = None) -> StreamingQuery:
    """Upsert a stream of sightings. interval: seconds between batches ('60 minutes'); without it all that is there is
    taken once. on_new and alert as in apply_batch."""
    writer = sightings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, n: apply_batch(b, n, root, key, at, fixed, fresh, tie, on_new, alert))
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def indexing(spark: SparkSession, index_root: str, embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> Callable[[DataFrame], None]:
    """What on_new needs to be to keep an index up to date: chunks, vectors and word tables of new records alone."""
    return lambda new: index.update(spark, new, index_root, embed=embed)


def stop(query: StreamingQuery, wait: float = 60.0) -> None:
    """Stop after the batch at work, for which so many seconds are waited."""
    until = time.monotonic() + wait
    while query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.2)
    query.stop()


def stop_on_signals(query: StreamingQuery, signals: Sequence[int] = (signal.SIGINT, signal.SIGTERM)) -> None:
    """Stop the query when the process gets one of the signals."""
    for s in signals:
        signal.signal(s, lambda *_: stop(query))

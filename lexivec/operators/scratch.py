"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Open(threading.local):
    """By open block of tidied() the tables written in it and their paths, for each thread: a stream's batches have their
    own."""

    def __init__(self) -> None:
        self.made: list[list[tuple[DataFrame, str]]] = []


_open = _Open()

#: By application in local mode the folder that stands for an unset spark.checkpoint.dir.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of this machine in local mode, whose driver and executor are
    one process; on a cluster an error, as a local folder would differ from executor to executor."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='lexivec-')}"
    return _local[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/lexivec-{uuid.uuid4().hex}-{name}"


#: Row groups, at least, to what a task reads at most: few bytes are dealt to all cores, too.
PIECES = 8


def reading(spark: SparkSession, split: int) -> SparkSession:
    """A session with the settings of another one, whose tasks read so many bytes of files at most."""
    out = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            out.conf.set(k, v)
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    out.conf.set("spark.sql.files.maxPartitionBytes", str(min(split, most)))
    out.conf.set("spark.sql.files.openCostInBytes", str(split // PIECES))
    return out


def written(df: DataFrame, name: str, split: int | None = None) -> DataFrame:
    """The table written once and read by all that need it: no lineage, and no executor whose loss matters. split: bytes
    that a task reads of it at most, where its rows become many."""
    path = scratch(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.size", split // PIECES) if split else out).parquet(path)
    out = (reading(df.sparkSession, split) if split else df.sparkSession).read.schema(df.schema).parquet(path)
    if _open.made:
        _open.made[-1].append((out, path))
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders with all that is in them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete, at the end of a block, all tables that written() made in it, but for those given to the function that
    the block gets; a block around it takes care of these."""
    kept: list[DataFrame] = []
    _open.made.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        made = _open.made.pop()
        stay = [(df, path) for df, path in made if any(df is k for k in kept)]
        delete(spark, *[path for df, path in made if not any(df is k for k in kept)])
        if _open.made:
            _open.made[-1] += stay

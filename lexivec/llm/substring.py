"""Substring dedup by level-wise doubling: word windows that repeat across documents.

Windows of about BASE words that are found in two documents are extended to twice that length, and those again, up to
``min_words`` or until none survive. At the first level not every window is looked at: of each run of windows that
one window of ``min_words`` words holds, the one with the least hash stands for it, so that every long window that
two documents share brings the same short window in both. This loses nothing and makes the first shuffle a
fraction of the words. At the later levels only windows that hold a surviving one are hashed, and at the last one only
those whose own least short window survived at every level: each part of a repeated window is repeated.

At each level a window's first document is an aggregation (partial sums before the shuffle), which is written and joined back on
the window's hash: a passage that a third of all documents share is one row on one side, and Spark splits the
other. Of documents whose words are all those of an earlier document (by SHA-256) only the first takes part in the later levels.
The lower levels compare 64-bit hashes, whose collisions only bring more candidates; the last one, which decides, compares 128 bits of two
independent hashes.

Defined results: words are [^\\x20\\x09-\\x0D]+; a null text has none; documents of fewer than min_words words are left
alone; a document without doc_id is left alone and no other is judged by it; rows of one doc_id are judged each by
itself, against smaller ids alone; an empty table gives no rows. Columns of any name stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import WordHashes, fresh, saved, tidied, window_hashes, words_of

#: Words of the first level's windows, at most.
BASE = 13
#: Rows of Arrow batches that leave a worker.
ROWS = 200_000


def tag() -> Column:
    """What tells apart different texts of one doc_id."""
    return F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(0x7FFFFFFF))


def sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The least (or greatest) of each run of so many consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :])


def least_of_runs(h: np.ndarray, run: int) -> np.ndarray:
    """Positions of hashes that are the least of a run of so many consecutive ones."""
    if len(h) < run:
        return np.zeros(0, np.int64)
    edge = np.zeros(run - 1, h.dtype)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([edge, sliding(np.minimum, h, run), edge]), run) == h)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def described(docs: DataFrame, min_words: int, base: int) -> DataFrame:
    """doc_id, tag, n_words, kept_sha256 (of all words) of every row, and its first-level windows: hashes, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            counts, shas, hashes, places = [], [], [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                h = window_hashes(cache.of(words), base) if len(words) >= min_words else np.zeros(0, np.uint64)
                at = least_of_runs(h, min_words - base + 1)
                hashes.append(h[at].view(np.int64))
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], pa.array(counts, pa.int64()), pa.array(shas, pa.string()), lists(hashes, pa.int64()), lists(places, pa.int32())], ["doc_id", "tag", "n_words", "all_sha256", "hashes", "places"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tag", tag())
    return rows.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, n_words long, all_sha256 string, hashes array<long>, places array<int>")


def repeated(windows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Of windows (keys, doc_id, place) those whose hash is found in two documents, with the first of them; and the
    number of such hashes."""
    firsts = windows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(*keys, "first")
    firsts = saved(firsts, "firsts")
    return windows.join(firsts, keys), firsts.count()


def by_text(found: DataFrame) -> DataFrame:
    """doc_id, tag, places (starts) of the windows of each text."""
    marks = found.select("doc_id", F.shiftright("place", 32).alias("tag"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("at"))
    return marks.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("places"))


def holding(n_words: int, longer: int, size: int, places: np.ndarray) -> np.ndarray:
    """By start of a window of ``longer`` words whether it holds one of ``size`` words that starts at one of places."""
    edge = np.zeros(n_words + 2, np.int64)
    np.add.at(edge, np.maximum(places - (longer - size), 0), 1)
    np.add.at(edge, places + 1, -1)
    return edge.cumsum()[: max(n_words - longer + 1, 0)] > 0


def to_look_at(h: np.ndarray, n_words: int, sizes: list[int], kept: list[np.ndarray], last: bool) -> np.ndarray:
    """Starts of windows of sizes[-1] words that may be repeated. h: hashes of all first-level windows; kept: starts of
    the repeated windows at each level before; last: whether this is the last level.

    Of a window that repeats, both places looked at the least of its first-level windows, and so at all longer ones that
    lie within it and hold that one: all of these are repeated, too."""
    longer, base = sizes[-1], sizes[0]
    start = np.flatnonzero(holding(n_words, longer, sizes[-2], kept[-1]))
    if not last or not len(start):
        return start
    runs = np.lib.stride_tricks.sliding_window_view(h, longer - base + 1)
    least = np.concatenate([s + runs[s].argmin(1) for s in np.array_split(start, -(-len(start) // 4096))])
    fit = np.ones(len(start), bool)
    for size, places in zip(sizes, kept):
        before = np.zeros(n_words + 2, np.int64)
        before[places + 1] = 1
        before = before.cumsum()
        low, high = np.maximum(start, least - (size - base)), np.minimum(start + longer - size, least)
        fit &= before[high + 1] - before[low] == high - low + 1
    return start[fit]


def extended(cand: DataFrame, min_words: int, sizes: list[int]) -> DataFrame:
    """Windows (h, g: hashes, doc_id, place: tag * 2**32 + start) of sizes[-1] words that may be repeated. cand: doc_id, tag, text
    and places0, places1, ... (starts of the repeated windows at each level before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = WordHashes(), WordHashes(1)
        names = ["h", "g", "doc_id", "place"]
        for batch in batches:
            held, n = [], 0
            for doc_id, mark, text, *kept in zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), batch["text"], *(batch[f"places{k}"] for k in range(len(sizes) - 1))):
                words = words_of(text.as_py())
                one = caches[0].of(words)
                kept = [k.values.to_numpy().astype(np.int64) for k in kept]
                start = to_look_at(window_hashes(one, sizes[0]), len(words), sizes, kept, sizes[-1] == min_words)
                if not len(start):
                    continue
                h, g = (window_hashes(x, sizes[-1])[start].view(np.int64) for x in (one, caches[1].of(words)))
                held.append((h, g, np.full(len(start), doc_id, np.int64), (mark << 32) + start))
                n += len(start)
                if n >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    return cand.select("doc_id", "tag", "text", *[f"places{k}" for k in range(len(sizes) - 1)]).mapInArrow(run, "h long, g long, doc_id long, place long")


@dataclass
class Repeats:
    """rows: doc_id, tag, n_words, all_sha256 of every document. candidates: doc_id, tag, text of those that may have
    repeats. spans: doc_id, tag, places (start of each window of min_words words to remove). copies: doc_id, tag of the
    documents that are removed as a whole. levels: words of a window, and how many different ones survived."""

    rows: DataFrame
    candidates: DataFrame
    spans: DataFrame
    copies: DataFrame
    min_words: int
    levels: list[tuple[int, int]]


def find_repeats(docs: DataFrame, min_words: int = 50, base: int = BASE) -> Repeats:
    """Windows of min_words words that also start in a document with a smaller doc_id."""
    with tidied(docs.sparkSession) as keep:
        found = searched(docs, min_words, base)
        for df in (found.rows, found.candidates, found.spans, found.copies):
            keep(df)
    return Repeats(found.rows.drop("hashes", "places"), found.candidates.select("doc_id", "tag", "text"), found.spans, found.copies, min_words, found.levels)


def searched(docs: DataFrame, min_words: int, base: int) -> Repeats:
    """The same, with all tables as they are written."""
    sizes = [min_words]
    while sizes[0] > base:
        sizes.insert(0, -(-sizes[0] // 2))
    rows = saved(described(docs, min_words, sizes[0]), "windows")
    long = rows.where(F.col("n_words") >= min_words).where("doc_id is not null")
    firsts = long.groupBy("all_sha256").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("all_sha256", "first")
    copies = long.select("doc_id", "tag", "all_sha256").join(saved(firsts, "first-copies"), "all_sha256").where("doc_id > first")
    copies = saved(copies.select("doc_id", "tag").distinct(), "copies")
    windows = long.select("doc_id", "tag", F.explode(F.arrays_zip("hashes", "places")).alias("w"))
    windows = windows.select(F.col("w.hashes").alias("h"), "doc_id", (F.shiftleft("tag", 32) + F.col("w.places")).alias("place"))
    found, n = repeated(windows, ["h"])
    levels = [(sizes[0], n)]
    places = by_text(found).withColumnRenamed("places", "places0").join(copies, ["doc_id", "tag"], "left_anti")
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tag", tag())
    cand = saved(text.join(places, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]), "candidates")
    for k, longer in enumerate(sizes[1:] or sizes):
        if not n:
            break
        if k:
            cand = saved(cand.join(by_text(found).withColumnRenamed("places", f"places{k}"), ["doc_id", "tag"]), "candidates")
        keys = ["h", "g"] if longer == min_words else ["h"]
        windows = extended(cand, min_words, [*sizes[: k + 1], longer]).select(*keys, "doc_id", "place")
        found, n = repeated(saved(windows, "windows"), keys)
        levels.append((longer, n))
    # Where a level leaves nothing, so would the last one.
    spans = saved(by_text(found.where("doc_id > first") if n else found.limit(0)), "spans")
    return Repeats(rows, cand, spans, copies, min_words, levels)


def without(text: str | None, starts: np.ndarray, n: int) -> tuple[str | None, int]:
    """A text's words without those of the windows of n words from starts, joined by blanks, and how many went; the
    text itself if none did."""
    if not len(starts):
        return text, 0
    words = words_of(text)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    gone = edge.cumsum()[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "surrogatepass"), int(gone.sum())


def removed(rows: DataFrame, n: int, places: str, counted: str) -> DataFrame:
    """Rows (any columns, with text and places: starts of windows of n words; -1: all of the text) with text replaced, and
    the number of words that went under ``counted`` in place of places."""
    names = [x for x in rows.columns if x != places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, marks in zip(batch["text"], batch[places]):
                at = np.array(marks.as_py() or [], np.int64)
                if len(at) and at[0] == -1:
                    kept, k = "", len(words_of(text.as_py()))
                else:
                    kept, k = without(text.as_py(), at, n)
                texts.append(kept)
                counts.append(k)
            fixed = {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([*(fixed.get(x, batch[x] if x != "text" else None) for x in names), pa.array(counts, pa.int64())], [*names, counted])

    kinds = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names]
    return rows.mapInArrow(run, ", ".join([*kinds, f"`{counted}` long"]))


def remove_repeats(docs: DataFrame, min_words: int = 50, counted: str = "n_removed") -> DataFrame:
    """The documents with the words of repeated windows removed; texts without repeats stay as they are. All columns
    stay; the number of words that went is added under ``counted``, with underscores after it where there is such a column."""
    found = find_repeats(docs, min_words)
    mark, places, own_id, own_tag = (fresh(x, docs.columns) for x in ("_tag", "_places", "_marked_id", "_marked_tag"))
    marks = found.spans.join(found.copies.withColumn("copy", F.lit(True)), ["doc_id", "tag"], "full")
    marks = marks.select(F.col("doc_id").alias(own_id), F.col("tag").alias(own_tag), F.when(F.col("copy"), F.array(F.lit(-1))).otherwise(F.col("places")).alias(places))
    rows = docs.withColumn(mark, tag())
    rows = rows.join(saved(marks, "marks"), (F.col("doc_id").cast("long") == F.col(own_id)) & (F.col(mark) == F.col(own_tag)), "left").drop(mark, own_id, own_tag)
    return removed(rows, min_words, places, fresh(counted, docs.columns))


def digests(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    found = find_repeats(docs, min_words)
    part = removed(found.candidates.join(found.spans, ["doc_id", "tag"]), min_words, "places", "n_removed")
    part = part.select("doc_id", "tag", "n_removed", F.sha2("text", 256).alias("part_sha256"))
    out = found.rows.join(part, ["doc_id", "tag"], "left").join(found.copies.withColumn("copy", F.lit(True)), ["doc_id", "tag"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("part_sha256", "all_sha256")).alias("kept_sha256"),
    )

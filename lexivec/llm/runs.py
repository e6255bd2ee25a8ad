"""Periodic runs of words: branching tandem repeats of a suffix tree, rotated and merged into maximal runs.

A run is a stretch of consecutive words with smallest period q whose length is at least max(24, 3 * q) and which no
neighbouring word extends. Every window of 9 words within such a run is found again in it (its length is at least
2 * q + 8), so only stretches of repeated windows enter a suffix tree, many of them together, each with an end mark of its own.

The tree is that of the longest common prefixes of neighbouring suffixes. The traversal of Stoye and Gusfield looks, at each
node of depth q, only at leaves i outside its largest child, and asks for the leaves i + q and i - q: a branching tandem
repeat ends where its run ends. All leaves climb at once, from the head of one heavy path to the next, so that the number
of steps is the logarithm of the leaves. A repeat is rotated left as far as its words allow; of those that become the same stretch
the smallest period counts.

Defined results: a null or empty text, or one of white space, has no words and no runs. A row without doc_id is taken as it is.
Rows are judged each by itself: repeated rows and ids alike. Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import WordHashes, window_hashes, words_of

LEAST, TIMES = 24, 3
#: The longest windows that are all repeated within every run of at least max(LEAST, TIMES * q) words.
WINDOW = 9
#: Words that one suffix tree takes, unless a single stretch is longer.
TREE_WORDS = 150_000

Run = tuple[int, int, int]


def periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, periodic from some word on for one id out of ten."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def repeated_stretches(h: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the stretches whose windows of WINDOW words are all found twice, LEAST words or more long."""
    t = window_hashes(h, WINDOW)
    if len(t) < 2:
        return []
    order = np.argsort(t)
    same = t[order[1:]] == t[order[:-1]]
    if not same.any():
        return []
    hit = np.zeros(len(t) + 2, np.int8)
    hit[order[1:][same] + 1] = hit[order[:-1][same] + 1] = 1
    edge = np.diff(hit)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + WINDOW - 1
    return [(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s >= LEAST]


def ranks(x: np.ndarray) -> list[np.ndarray]:
    """By k the rank, among all, of the 2**k numbers that start at each place, until no two are equal."""
    r = np.unique(x, return_inverse=True)[1].astype(np.int64)
    n, size, out = len(x), 1, [r.astype(np.int32)]
    while int(r.max()) + 1 < n:
        then = np.zeros(n, np.int64)
        if size < n:
            then[:-size] = r[size:] + 1
        r = np.unique(r * (n + 1) + then, return_inverse=True)[1]
        out.append(r.astype(np.int32))
        size *= 2
    return out


def common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers the suffixes at a and at b have in common."""
    a, b, n = a.copy(), b.copy(), len(levels[0])
    start = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero((a < n) & (b < n))
        same = at[levels[k][a[at]] == levels[k][b[at]]]
        a[same] += 1 << k
        b[same] += 1 << k
    return a - start


def back(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers before a equal those before b, a < b."""
    a, b = a.copy(), b.copy()
    start = a.copy()
    for k in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero(a >= 1 << k)
        same = at[levels[k][a[at] - (1 << k)] == levels[k][b[at] - (1 << k)]]
        a[same] -= 1 << k
        b[same] -= 1 << k
    return start - a


def smaller_before(x: list[int]) -> list[int]:
    """By place the last place before it with a smaller number, -1 without one."""
    out = [-1] * len(x)
    for i, v in enumerate(x):
        j = i - 1
        while j >= 0 and x[j] >= v:
            j = out[j]
        out[i] = j
    return out


class SuffixTree:
    """Internal nodes as intervals of the sorted suffixes; the children are nodes first, leaves after them."""

    def __init__(self, x: np.ndarray) -> None:
        """x: numbers of which the last one of each stretch is found nowhere else."""
        n = len(x)
        self.levels = ranks(x)
        self.rank = self.levels[-1].astype(np.int64)
        self.sorted = np.empty(n, np.int64)
        self.sorted[self.rank] = np.arange(n)
        lcp = np.full(n + 1, -1, np.int64)  # of the suffix and the one sorted before it; no suffix lies beyond the ends
        lcp[1:n] = common(self.levels, self.sorted[:-1], self.sorted[1:])
        low = np.array(smaller_before(lcp.tolist()))
        high = n - np.array(smaller_before(lcp[::-1].tolist()))[::-1]
        ends, node = np.unique(low[1:n] * (n + 1) + high[1:n], return_inverse=True)
        self.low, self.high = ends // (n + 1), ends % (n + 1)  # sorted suffixes low to high - 1
        m = len(ends)
        of = np.full(n + 1, -1, np.int64)
        of[1:n] = node
        self.depth = np.zeros(m, np.int64)
        self.depth[node] = lcp[1:n]
        left = np.concatenate([self.low, np.arange(n)])
        right = np.concatenate([self.high, np.arange(1, n + 1)])
        self.parent = np.where(lcp[left] >= lcp[right], of[left], of[right])  # -1: the root has none
        order = np.lexsort((right - left, self.parent))
        heavy = np.zeros(m + n, bool)
        heavy[order[np.flatnonzero(np.diff(self.parent[order], append=m) != 0)]] = True
        heavy &= self.parent >= 0
        self.head = np.where(heavy, self.parent, np.arange(m + n))
        while ((up := self.head[self.head]) != self.head).any():
            self.head = up
        self.leaves = m

    def tandem_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and period of every branching tandem repeat, some twice."""
        n = len(self.rank)
        place, at = np.arange(n), self.leaves + self.rank
        starts, periods = [], []
        while len(place):
            node = self.parent[self.head[at]]
            stay = node >= 0
            stay[stay] = self.depth[node[stay]] > 0
            place, at = place[stay], node[stay]
            q = self.depth[at]
            for first, other in ((place, place + q), (place - q, place - q)):
                ok = (first >= 0) & (first + q < n)
                i, v, p, j = first[ok], at[ok], q[ok], other[ok]
                r = self.rank[j]
                inside = (r >= self.low[v]) & (r < self.high[v])
                i, p = i[inside], p[inside]
                end = self.levels[0][np.minimum(i + 2 * p, n - 1)]
                branching = (i + 2 * p >= n) | (end != self.levels[0][i + p])
                starts.append(i[branching])
                periods.append(p[branching])
        return (np.concatenate(starts), np.concatenate(periods)) if starts else (place, place)

    def maximal(self) -> np.ndarray:
        """Start, length and smallest period of every run, one row each."""
        i, q = self.tandem_repeats()
        rotated = back(self.levels, i, i + q)
        start, length = i - rotated, rotated + 2 * q
        ok = length >= np.maximum(LEAST, TIMES * q)
        found = np.stack([start[ok], length[ok], q[ok]], 1)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        if len(found):
            found = found[np.r_[True, (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)]]
        return found


def runs_of(texts: list[list[bytes]], cache: WordHashes) -> list[list[Run]]:
    """Start, length and period of all runs of each list of words, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not waiting:
            return
        words = np.unique(np.concatenate([x for _, _, x in waiting]), return_inverse=True)[1]
        whole, at, begins = np.empty(len(words) + len(waiting), np.int64), 0, []
        for k, (_, _, x) in enumerate(waiting):
            begins.append(at + k)
            whole[at + k : at + k + len(x)] = words[at : at + len(x)]
            at += len(x)
            whole[at + k] = len(words) + k
        found = SuffixTree(whole).maximal()
        for (start, length, q), k in zip(found.tolist(), (np.searchsorted(begins, found[:, 0], "right") - 1).tolist(), strict=True):
            row, shift, _ = waiting[k]
            out[row].append((start - begins[k] + shift, length, q))
        waiting.clear()
        size = 0

    for row, words in enumerate(texts):
        if len(words) < LEAST:
            continue
        h = cache.of(words)
        for start, end in repeated_stretches(h):
            if size and size + end - start > TREE_WORDS:
                flush()
            waiting.append((row, start, h[start:end]))
            size += end - start
    flush()
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run repeats: of each run the first period stays."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        gone[start + q] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and collapsed (the words that no run
    repeats, joined by one space) of every row.

    planted: make one document out of ten periodic first, as a test with runs of long periods in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes(11)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = batch["doc_id"].to_pylist()
                texts = [words_of(t.as_py()) for t in batch["text"]]
                if planted:
                    texts = [periodic(w, k) for w, k in zip(texts, ids, strict=True)]
                found = runs_of(texts, cache)
                lists = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in one] for one in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                kept = pa.array([b" ".join(collapsed(w, one)).decode("utf-8", "surrogatepass") for w, one in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, kept], ["doc_id", "runs", "collapsed"])

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Of each row the number of runs, the one with the greatest exponent (ties: smallest start, then period), and two digests."""

    def best(lists: pa.Array) -> pa.Array:
        def one(runs: list[dict] | None) -> dict:
            runs = runs or []
            top = min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)
            text = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
            return {"top": top, "sha256": hashlib.sha256(text.encode()).hexdigest()}

        return pa.array([one(x.as_py()) for x in lists], kind)

    top = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct([("top", top), ("sha256", pa.string())])
    choose = F.arrow_udf(best, "top struct<start: long, length: long, period: long>, sha256 string")
    seen = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, choose("runs")).alias("d"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return seen.select(
        "doc_id",
        "n_runs",
        "d.top.start",
        "d.top.length",
        "d.top.period",
        F.expr("1000 * d.top.length div d.top.period").alias("exponent_milli"),
        F.coalesce("d.sha256", F.sha2(F.lit(""), 256)).alias("runs_sha256"),
        "collapsed_sha256",
    )

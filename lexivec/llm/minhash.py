"""Near-duplicates by HyperMinHash.

A document's set is that of its distinct word shingles. Its sketch has REGISTERS registers: a shingle's hash picks a
register, which keeps the least of the rest of the hashes as a count of leading zeros and MANTISSA bits after them,
two bytes in all. For banding, an empty register takes the value of the first full one in an order of its own, so
that short texts have selective bands, too. Documents that agree on all registers of a band are candidates. The
Jaccard estimate from equal registers, corrected for those that are equal by chance, drops candidates that
are far below the threshold (SIGMAS standard errors); the rest are verified on their full sets.

Bands have as many registers as leave a pair at the threshold a chance of less than one in 10**8 to agree on none:
five at 0.8, fewer below. Of 531,300 random pairs at exactly 0.8, of 5 to 3,000 shingles, none was missed.

Groups of copies don't make pairs of all with all:

1. Documents with equal sets (by a 128-bit hash of the set) are one node, whatever their number.
2. In each bucket of a band, every node is paired with one leader, the one with the most company in all its buckets:
   of texts that were edited from one original this is the original or near it.
3. Only nodes of a bucket that verified links of step 2 haven't brought together are paired with each other. In
   buckets of more than CROWD nodes the pairs come from an exact prefix filter: two sets with the asked similarity
   share one of their rarest shingles, so far ahead in the order of rarity that enough may follow in both. Shingles of
   the crowds are counted exactly. The size of a bucket decides only which pairs are looked at, never which are found.

Links form components by alternating large-star and small-star steps, each written to the shared folder.
Sets are 64-bit hashes of shingles; nothing of them goes to the driver. Rows are told apart by numbers of their own, so
that those without doc_id, or with one that others have, are linked like all.

Defined results: A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+; a text of fewer words than a shingle is one
shingle; a null text or one without words has an empty set and is linked with nothing; a null doc_id is no
smaller than any: a component's id is the smallest other one, and null if there is none; rows of one doc_id are nodes by
their own texts; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.shared import LOWER, WordHashes, mix, saved, tidied, window_hashes

BITS, MANTISSA = 8, 10
REGISTERS = 1 << BITS
#: Registers of a band at most, and the chance that is left to a pair at the threshold.
MOST_OF_BAND, MISSED = 5, 1e-8
EMPTY = np.uint16(65535)
SIGMAS = 6
CROWD = 8
SALT = np.uint64(0xA0761D6478BD642F)


def shingle_set(text: str | None, size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = cache.of(words)
    n = min(size, len(words))
    return np.unique(window_hashes(h, n) + np.uint64(size - n))


def registers(shingles: np.ndarray) -> np.ndarray:
    """A set's sketch."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(shingles):
        h = np.sort(mix(shingles ^ SALT))
        bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        v = (h[first] & np.uint64((1 << (64 - BITS)) - 1)) >> np.uint64(3)
        width = 64 - BITS - 3
        zeros = width - np.frexp(v.astype(np.float64))[1]
        rest = ((v << zeros.astype(np.uint64)) >> np.uint64(width - 1 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
        out[bucket[first]] = zeros * (1 << MANTISSA) + rest
    return out


def borrowing() -> np.ndarray:
    """For each register the order in which it looks at registers: itself, then a fixed permutation."""
    out = np.empty((REGISTERS, REGISTERS), np.int64)
    for i in range(REGISTERS):
        out[i] = np.argsort(mix(np.arange(REGISTERS, dtype=np.uint64) * np.uint64(REGISTERS) + np.uint64(i)), kind="stable")
    return np.column_stack([np.arange(REGISTERS), out])


ORDER = borrowing()


def rows_of_band(threshold: float) -> int:
    """So many registers that a pair at the threshold shares a band but for a chance of MISSED."""
    return max((r for r in range(1, MOST_OF_BAND + 1) if (1 - threshold**r) ** (REGISTERS // r) <= MISSED), default=1)


def band_keys(sketches: np.ndarray, size: int) -> np.ndarray:
    """Keys [n, bands] of sketches [n, REGISTERS] with a full register at least, for bands of so many registers."""
    full = sketches != EMPTY
    dense = sketches.copy()
    todo = np.argwhere(~full)
    for k in range(1, REGISTERS + 1):
        if not len(todo):
            break
        row, reg = todo.T
        source = ORDER[reg, k]
        good = full[row, source]
        dense[row[good], reg[good]] = sketches[row[good], source[good]]
        todo = todo[~good]
    bands = REGISTERS // size
    parts = dense[:, : bands * size].reshape(-1, bands, size).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for k in range(size):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[..., k] + np.uint64(1))
    return key


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of sketches, corrected for chance, and registers that any of both fills."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(1), 1)
    equal = ((a == b) & used).sum(1)
    # Chance that two unlike minima fall into one cell of relative width 2**-MANTISSA.
    chance = n_a * n_b / np.maximum(n_a + n_b, 1) ** 2 / (1 << MANTISSA) / np.log(2)
    return np.clip((equal / n - chance) / (1 - chance), 0, 1), n


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """rid (a number of its own), doc_id, text, row (all other columns), n_shingles, h1, h2 (128-bit hash of the set,
    null if it is empty) and sketch of every row."""

    def run(texts: pa.Array) -> pa.Array:
        cache = WordHashes()
        counts, hashes, sketches = [], [], []
        for text in texts:
            s = shingle_set(text.as_py(), size, cache)
            counts.append(len(s))
            hashes.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None))
            sketches.append(registers(s).tobytes() if len(s) else None)
        h1, h2 = zip(*hashes) if hashes else ((), ())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sketches, pa.binary())], ["n_shingles", "h1", "h2", "sketch"])

    others = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() != "text"]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("row"))
    sketch = F.arrow_udf(run, "n_shingles long, h1 long, h2 long, sketch binary")(F.col("text"))
    return rows.withColumn("s", sketch).select("rid", F.col("id").alias("doc_id"), "text", "row", "s.*")


def banded(nodes: DataFrame, threshold: float) -> DataFrame:
    """band (key) and node, a row for each band of each node."""
    size = rows_of_band(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys = band_keys(matrix(part["sketch"], np.uint16, REGISTERS), size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part["node"].to_numpy(), keys.shape[1]))], ["band", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "band long, node long")


def hopeful(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs a, b whose sizes and sketches allow the similarity."""
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a").where((F.col("n_a") >= threshold * F.col("n_b") - 1e-6) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                p = batch.slice(i, 4000)
                j, n = estimate(matrix(p["s_a"], np.uint16, REGISTERS), matrix(p["s_b"], np.uint16, REGISTERS), p["n_a"].to_numpy(), p["n_b"].to_numpy())
                good = pa.array(j >= threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / n))
                yield pa.RecordBatch.from_arrays([p["a"].filter(good), p["b"].filter(good)], ["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def full_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and its full set (little-endian 64-bit hashes) of wanted nodes, each of which is one of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets = [shingle_set(text.as_py(), size, cache).tobytes() for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], ["node", "shingles"])

    mine = rows.select(F.col("rid").alias("node"), "text").join(wanted.select("node"), "node", "left_semi")
    return mine.mapInArrow(run, "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b with 100 * intersection >= percent * union, by their full sets."""
    one = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["s_a"], batch["s_b"]):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(good), batch["b"].filter(good)], ["a", "b"])

    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """token, node, ahead (of how many shingles the token is the rarest, itself included), size: of each set its
    rarest shingles, so many that two similar sets have one in common; without those that no other set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = [np.frombuffer(s.as_py(), np.int64) for s in part["shingles"]]
                sizes = np.array([len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(part["node"].to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes))], ["token", "node", "size"])

    tokens = saved(sets.mapInArrow(run, "token long, node long, size long"), "crowd-shingles")
    counts = saved(tokens.groupBy("token").agg(F.count("*").alias("n")), "shingle-counts")
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "token"))
    ranked = tokens.join(counts, "token").withColumn("place", place).where(F.col("place") <= F.expr(f"size - (size * {percent} + 99) div 100 + 1"))
    return ranked.where("n > 1").select("token", "node", (F.col("size") - F.col("place") + 1).alias("ahead"), "size")


def by_prefix(tokens: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a, b with different labels that share a token from which on both sets are large enough for the
    similarity. a is the smaller set, so its token stands further ahead than the prefix asks of the larger."""
    need = lambda n: F.ceil(percent * n / (100 + percent) - 1e-9)
    one = lambda x: tokens.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "ahead", "size")])
    small = one("a").where(F.col("ahead_a") >= need(2 * F.col("size_a")))
    fit = (F.least("ahead_a", "ahead_b") >= need(F.col("size_a") + F.col("size_b"))) & (F.struct("size_a", "node_a") < F.struct("size_b", "node_b")) & (F.col("label_a") != F.col("label_b"))
    pairs = small.join(one("b"), "token").where(fit)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def across(rows: DataFrame, key: str) -> DataFrame:
    """Distinct pairs a < b of nodes with one key and different labels (rows: key, node, label)."""
    left = rows.select(key, F.col("node").alias("a"), F.col("label").alias("label_a"))
    right = rows.select(key, F.col("node").alias("b"), F.col("label").alias("label_b"))
    return left.join(right, key).where("a < b and label_a <> label_b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges a, b: the smallest node that is reachable."""
    with tidied(edges.sparkSession) as keep:
        return keep(rooted(edges)).select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(edges: DataFrame) -> DataFrame:
    """Edges u > v that lead every node to the smallest one that is reachable."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        now = saved(small, "edges")


@dataclass
class NearDuplicates:
    """rows: rid, doc_id, text, row (all other columns), n_shingles, node, component_id, first (rid of the row that
    stands for the component; null with an empty set) of every document. links: verified links a, b of nodes (rid of
    one of their rows)."""

    rows: DataFrame
    links: DataFrame


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> NearDuplicates:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union."""
    with tidied(docs.sparkSession) as keep:
        rows, of_set, links = (keep(df) for df in linked(docs, shingle, percent))
    out = rows.drop("sketch").join(of_set, ["h1", "h2"], "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return NearDuplicates(out.select("rid", "doc_id", "text", "row", "n_shingles", "node", alone.alias("component_id"), "first"), links)


def linked(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their sketches, node, component_id and first of each set, and the links; all written."""
    rows = saved(sketched(docs, shingle), "sketches")
    some = rows.where("h1 is not null")
    # The row that stands for a set: the smallest doc_id, then the first; null is no smaller than any.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = saved(some.groupBy("h1", "h2").agg(F.min(rank).alias("first")).select("h1", "h2", "first", F.col("first.rid").alias("node")), "groups")
    nodes = saved(some.select(F.col("rid").alias("node"), "n_shingles", "sketch").join(groups.select("node"), "node", "left_semi"), "node-sketches")
    bands = saved(banded(nodes, percent / 100), "bands")
    sizes = saved(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    crowded = saved(bands.join(sizes, "band"), "buckets")
    company = saved(crowded.groupBy("node").agg(F.sum("n").alias("w")), "company")
    leaders = saved(crowded.join(company, "node").groupBy("band").agg(F.max_by("node", F.struct("w", "node")).alias("a")), "leaders")
    pairs = crowded.join(leaders, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    pairs = saved(hopeful(pairs, nodes, percent / 100), "pairs")

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        return saved(full_sets(rows, saved(wanted, "wanted"), shingle), name)

    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
    sets = sets_of(ends(pairs), "sets")
    links = saved(verified(pairs, sets, percent), "links")
    # What verified links with leaders have brought together needs no more pairs.
    labels = links.join(company.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max_by("a", F.struct("w", "a")).alias("near"))
    marked = crowded.where("n > 2").select("band", "node").join(saved(labels, "labels"), "node", "left").select("band", "node", F.coalesce("near", "node").alias("label"))
    marked = saved(marked, "labelled")
    apart = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").select("band", "size")
    unsettled = saved(marked.join(saved(apart, "apart"), "band"), "unsettled")
    more = across(unsettled.where(F.col("size") <= CROWD), "band")
    crowds = saved(unsettled.where(F.col("size") > CROWD).select("node", "label").distinct(), "crowds")
    if not crowds.isEmpty():
        tokens = saved(prefixes(sets_of(crowds.select("node"), "crowd-sets"), percent).join(crowds, "node"), "prefixes")
        mixed = saved(tokens.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token"), "mixed")
        more = more.union(by_prefix(saved(tokens.join(mixed, "token", "left_semi"), "mixed-prefixes"), percent)).distinct()
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = saved(hopeful(more.join(done, ["a", "b"], "left_anti"), nodes, percent / 100), "more-pairs")
    if not more.isEmpty():
        links = saved(links.union(verified(more, sets_of(ends(more), "more-sets"), percent)), "all-links")
    roots = components(links)
    members = groups.join(roots, "node", "left").select("h1", "h2", "node", "first", F.coalesce("root", "node").alias("root"))
    least = members.groupBy("root").agg(F.min("first").alias("of_all"))
    of_set = saved(members.drop("first").join(least, "root").select("h1", "h2", "node", F.col("of_all.doc_id").alias("component_id"), F.col("of_all.rid").alias("first")), "components")
    return rows, of_set, links


def digest(found: NearDuplicates) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document. kept: doc_id is that of its component, or null."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component (with the smallest doc_id, of several such rows the first), and all whose set is
    empty, with their columns."""
    rows = near_duplicates(docs, shingle, percent).rows.where(F.coalesce(F.col("rid") == F.col("first"), F.lit(True)))
    text = next(c for c in docs.columns if c.lower() == "text")
    return rows.select(*[F.col("text").cast(docs.schema[text].dataType).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])

"""Hybrid retrieval as one plan: exact cosine and word scores, fused by reciprocal ranks, one passage a record,
blended, cut. A question is a literal of the plan; only its few terms are broadcast. Each ranking ends in a top-n of
fixed size, so that all later windows see at most some dozens of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.operators.index import WordIndex

FETCH, RRF_K, POOL = 40, 60, 3
WEIGHTS = (0.6, 0.25, 0.15)
NOISE, RELATIVE = 0.55, 0.70
K1, B = 1.5, 0.75


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine of a vector column and a fixed vector, in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / F.nullif(norm * float(sum(x * x for x in query)) ** 0.5, F.lit(0.0))


def equal_to(filters: dict[str, str] | None) -> Column:
    """All of key = value; a missing value counts as ''."""
    out = F.lit(True)
    for k, v in (filters or {}).items():
        out = out & (F.coalesce(F.col(k).cast("string"), F.lit("")) == v)
    return out


def ranked(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Few rows (a top-n) with their rank."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def dense_topn(chunks: DataFrame, query: Sequence[float], n: int = FETCH, filters: dict[str, str] | None = None, vector: str = "embedding") -> DataFrame:
    """chunk_id, semantic, dense_rank of the n nearest chunks; filters apply before."""
    rows = chunks.where(equal_to(filters) & F.col(vector).isNotNull()).select("chunk_id", cosine(F.col(vector), query).alias("cos")).where("cos is not null")
    best = rows.orderBy(F.desc("cos"), "chunk_id").limit(n)
    return ranked(best, [F.desc("cos"), F.col("chunk_id")], "dense_rank").select("chunk_id", F.round("cos", 4).alias("semantic"), "dense_rank")


def bm25_scores(index: WordIndex, question: str, k1: float = K1, b: float = B) -> DataFrame:
    """chunk_id, score of all chunks with a word of the question; a word repeated there counts repeatedly."""
    spark = index.postings.sparkSession
    words = Counter(question.lower().split())
    asked = F.broadcast(spark.createDataFrame(sorted(words.items()), "term string, times int"))
    # The words as literals reach the scans, whose row groups are sorted by them.
    mine = F.col("term").isin(list(words))
    terms = index.terms.where(mine).select("term", "idf").join(asked, "term")
    hits = index.postings.where(mine).join(F.broadcast(terms), "term").crossJoin(F.broadcast(index.corpus.select("avgdl")))
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # Sums of equal parts in another order must tie, so that ranks don't depend on the order of a shuffle.
    return hits.groupBy("chunk_id").agg(F.round(F.sum(part), 9).alias("score"))


def bm25_topn(scores: DataFrame, chunks: DataFrame, n: int = FETCH, filters: dict[str, str] | None = None) -> DataFrame:
    """chunk_id, bm25 (normalised), bm25_rank: the global top n, then positive ones, then filters, in this order."""
    best = ranked(scores.orderBy(F.desc("score"), "chunk_id").limit(n), [F.desc("score"), F.col("chunk_id")], "place").where("score > 0")
    if filters:
        best = best.join(chunks.where(equal_to(filters)).select("chunk_id"), "chunk_id", "left_semi")
    return ranked(best, [F.col("place")], "bm25_rank").select("chunk_id", F.least(F.lit(1.0), F.col("score") / 20).alias("bm25"), "bm25_rank")


def fused(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """chunk_id, semantic, bm25, rrf, ord: candidates of both lists; what one lacks is 0."""
    both = dense.join(sparse, "chunk_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    place = F.coalesce(F.col("dense_rank"), 10**6 + F.col("bm25_rank"))
    return both.select("chunk_id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), (part("dense_rank") + part("bm25_rank")).alias("rrf"), place.alias("ord"))


def best_of_record(candidates: DataFrame, key: str = "bid_no") -> DataFrame:
    """Of each record the passage with the highest fused score."""
    return candidates.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rrf"), "ord"))).where("_k = 1").drop("_k")


def pool(candidates: DataFrame, top_k: int, times: int = POOL) -> DataFrame:
    """The first times * top_k records by fused score, with pool_rank."""
    order = [F.desc("rrf"), F.col("ord")]
    return ranked(candidates.orderBy(*order).limit(times * top_k), order, "pool_rank")


def reranked(rows: DataFrame, rerank: Callable[[Column, Column], Column] | None, question: str = "", chunk: str = "chunk") -> DataFrame:
    """rerank and final_rank. rerank: from a question and a passage column to logits; without it the cosine stands for it and the
    order stays that of the pool."""
    if rerank is None:
        return rows.withColumn("rerank", F.col("semantic")).withColumn("final_rank", F.col("pool_rank"))
    scored = rows.withColumn("rerank", 1 / (1 + F.exp(-rerank(F.lit(question), F.col(chunk)))))
    return ranked(scored, [F.desc("rerank"), F.col("pool_rank")], "final_rank")


def blended(rows: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    a, b, c = weights
    return rows.withColumn("score", a * F.col("rerank") + b * F.col("semantic") + c * F.col("bm25"))


def without_noise(rows: DataFrame, top_k: int, least: float = NOISE) -> DataFrame:
    """The first top_k rows, less those found by words alone that the reranker doubts. None fill their places."""
    return rows.where(F.col("final_rank") <= top_k).where(~((F.col("semantic") == 0.0) & (F.col("rerank") < least)))


def relative_cut(rows: DataFrame, share: float = RELATIVE) -> DataFrame:
    """Rows that score at least a share of the first row's score; the first row always stays."""
    w = Window.orderBy("final_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("_first", F.first("score").over(w)).withColumn("_rank", F.min("final_rank").over(w))
    return out.where((F.col("score") >= share * F.col("_first")) | (F.col("final_rank") == F.col("_rank"))).drop("_first", "_rank")


def search(chunks: DataFrame, index: WordIndex | None, question: str, vector: Sequence[float] | None, top_k: int = 5, filters: dict[str, str] | None = None, rerank: Callable[[Column, Column], Column] | None = None, cut: bool = True, near: Callable[..., DataFrame] | None = None) -> DataFrame:
    """The rows that answer a question, best first by final_rank. chunks: chunk_id, bid_no, chunk, embedding and any
    metadata. Without an index or without a vector only the other list counts. near: the search of a stored dense index
    (topn), in place of a scan of all vectors."""
    spark = chunks.sparkSession
    dense = (near(vector, FETCH, filters) if near else dense_topn(chunks, vector, FETCH, filters)) if vector is not None else spark.createDataFrame([], "chunk_id " + chunks.schema["chunk_id"].dataType.simpleString() + ", semantic double, dense_rank int")
    if index is not None:
        sparse = bm25_topn(bm25_scores(index, question), chunks, FETCH, filters)
    else:
        sparse = spark.createDataFrame([], "chunk_id " + chunks.schema["chunk_id"].dataType.simpleString() + ", bm25 double, bm25_rank int")
    # At most FETCH rows of either list. As literals their ids reach the scan, which then reads few texts.
    both = fused(dense, sparse)
    hits = both.collect()
    found = chunks.drop("embedding").where(F.col("chunk_id").isin([r.chunk_id for r in hits])).join(F.broadcast(spark.createDataFrame(hits, both.schema)), "chunk_id")
    rows = without_noise(blended(reranked(pool(best_of_record(found), top_k), rerank, question)), top_k)
    rows = rows.select(*[c for c in chunks.columns if c != "embedding"], "final_rank", *[F.round(c, 4).alias(c) for c in ("score", "rerank", "semantic", "bm25")])
    return relative_cut(rows) if cut else rows

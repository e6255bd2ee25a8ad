"""Postings in blocks, so that the best by word scores are found without reading all postings of common words.

Chunks lie in ranges: those of about one length, dealt by hash into parts of some ROWS chunks. A block is what one word has
in one range: its postings, and above them the greatest tf and the least dl, which bound what any posting of the block can
score, whatever idf and mean length have become since. A word in very many chunks has many blocks, none of them large.

A question reads the heads of its words' blocks (columns of their own), sums the bounds by range, scores the most promising
ranges, and then only those whose bound reaches the n-th best score so far. What it returns is exactly the top n.

Defined results: as those of the word scores over all postings; ties go to the smaller chunk_id; without a known word none.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.operators.index import BLOCK, WordIndex
from lexivec.operators.retrieval import FETCH, K1, B
from lexivec.operators.scratch import tidied, written

#: Chunks of a range; ranges that are scored first.
ROWS, FIRST = 64, 16
#: Postings that one task makes blocks of, about.
TASK = 4_000_000
#: Scores are rounded to nine places; a bound that is as far below the n-th best can't reach it.
SLACK = 1e-6


def impact(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """What a word is worth in a chunk before its idf: grows with tf, falls with dl."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def blocks(postings: DataFrame, rows: int = ROWS) -> DataFrame:
    """term, range, max_tf, min_dl, n, hits (chunk_id, tf, dl) from postings (term, chunk_id, tf, dl)."""
    size = F.floor(8 * F.log2(F.greatest("dl", F.lit(1)))).cast("long")
    # As many rows as there are eighths of powers of two among the lengths.
    sizes = postings.select("chunk_id", "dl").distinct().groupBy(size.alias("size")).agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = postings.withColumn("size", size).join(F.broadcast(sizes), "size")
    range_ = F.shiftleft("size", 40) + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
    # The one exchange, by range: what a word has in a range lies in one task then, and no word has a task of its own.
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), postings.count() // TASK)
    grouped = dealt.select("term", range_.alias("range"), "chunk_id", "tf", "dl").repartition(parts, "range").groupBy("term", "range")
    return grouped.agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count("*").alias("n"), F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("hits"))


def write(words: WordIndex, root: str, rows: int = ROWS) -> None:
    """Write the blocks of an index, each file sorted by word."""
    made = blocks(words.postings, rows).sortWithinPartitions("term", "range")
    made.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", BLOCK).parquet(f"{root}/blocks")
    words.terms.write.mode("overwrite").parquet(f"{root}/terms")
    words.corpus.select("n", "total", "avgdl").write.mode("overwrite").parquet(f"{root}/corpus")


@dataclass
class Found:
    """scores: chunk_id, score of the top n. blocks, read: how many blocks the question's words have, and how many were scored."""

    scores: DataFrame
    blocks: int
    read: int


@dataclass
class WordBlocks:
    blocks: DataFrame
    terms: DataFrame
    avgdl: float | None

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> WordBlocks:
        return cls(spark.read.parquet(f"{root}/blocks"), spark.read.parquet(f"{root}/terms"), spark.read.parquet(f"{root}/corpus").first()["avgdl"])

    def topn(self, question: str, n: int = FETCH) -> Found:
        """The n chunks with the greatest scores."""
        spark = self.blocks.sparkSession
        times = Counter(question.lower().split())
        known = {r.term: times[r.term] * r.idf for r in self.terms.where(F.col("term").isin(list(times))).select("term", "idf").collect()}
        mine = self.blocks.where(F.col("term").isin(list(known)))
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map(F.lit(""), F.lit(0.0)), F.col("term"))
        avgdl = F.lit(self.avgdl or 1.0)
        bound = F.greatest(weight, F.lit(0.0)) * impact(F.col("max_tf"), F.col("min_dl"), avgdl)
        with tidied(spark) as keep:
            ranges = written(mine.groupBy("range").agg(F.sum(bound).alias("bound"), F.count("*").alias("blocks")), "bounds")

            def scored(some: DataFrame) -> DataFrame:
                hits = some.select("term", F.inline("hits"))
                return hits.groupBy("chunk_id").agg(F.round(F.sum(weight * impact(F.col("tf"), F.col("dl"), avgdl)), 9).alias("score"))

            first = [r.range for r in ranges.orderBy(F.desc("bound"), "range").limit(FIRST).collect()]
            best = scored(mine.where(F.col("range").isin(first))).orderBy(F.desc("score"), "chunk_id").limit(n).collect()
            reach = best[-1].score - SLACK if len(best) == n else float("-inf")
            more = ranges.where((F.col("bound") >= reach) & ~F.col("range").isin(first))
            every, read = ranges.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum(F.when((F.col("bound") >= reach) | F.col("range").isin(first), F.col("blocks"))), F.lit(0))).first()
            rest = scored(mine.join(more.select("range"), "range", "left_semi"))
            # The first ranges' best are at most n rows.
            top = rest.union(spark.createDataFrame(best, rest.schema)).orderBy(F.desc("score"), "chunk_id").limit(n)
            return Found(keep(written(top, "top")), every, read)

"""The older ranking: share of the question's words that metadata fields hold, blended with the cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions.text import tokens

#: Stop words of questions, and fields' weights.
STOP = ("for", "the", "a", "an", "and", "or", "in", "of", "is")
FIELDS = {"full_item_name": 3.0, "department": 1.5, "bid_type": 1.0, "product_type": 1.0}
#: Bundles of parameters: chunk size, overlap, top_k, weight of the cosine.
PRESETS = {
    "precision": {"chunk_size": 600, "overlap": 100, "top_k": 3, "semantic": 0.7},
    "recall": {"chunk_size": 1000, "overlap": 200, "top_k": 10, "semantic": 0.5},
    "balanced": {"chunk_size": 800, "overlap": 100, "top_k": 5, "semantic": 0.6},
    "speed": {"chunk_size": 1500, "overlap": 50, "top_k": 3, "semantic": 0.6},
}


def keyword_score(question: Column, fields: dict[str, float] | None = None) -> Column:
    """0 to 1: weighted shares of the question's words in the fields; 0.5 for a question of stop words."""
    fields = fields or FIELDS
    asked = F.array_except(F.array_distinct(tokens(question)), F.array(*[F.lit(w) for w in STOP]))
    total = F.lit(0.0)
    for name, weight in fields.items():
        total = total + weight * F.size(F.array_intersect(asked, tokens(F.col(name)))) / F.greatest(F.size(asked), F.lit(1))
    return F.when(F.size(asked) == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), total / sum(fields.values())))


def hybrid(semantic: Column, keyword: Column, share: float = 0.6) -> Column:
    return share * semantic + (1 - share) * keyword


def legacy_search(candidates: DataFrame, question: Column, top_k: int = 5, key: str = "bid_no", over: int = 4, share: float = 0.6) -> DataFrame:
    """Of the over * top_k nearest rows (semantic, bid_no, fields) the best of each record by the hybrid score, the
    first top_k of these."""
    near = candidates.orderBy(F.desc("semantic"), "chunk_id").limit(over * top_k)
    scored = near.withColumn("keyword", keyword_score(question)).withColumn("score", hybrid(F.col("semantic"), F.col("keyword"), share))
    best = scored.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "chunk_id"))).where("_k = 1").drop("_k")
    return best.orderBy(F.desc("score"), "chunk_id").limit(top_k)

"""A training corpus from documents: five stages, each of which applies one operator to all that its predecessor kept.

Defined results, for all stages: an empty table gives none; columns of any name stay as they are, and all stages but the
last return those of documents. A null or empty text, or one without letters, goes in the first stage, and so
does a text in no language that is learned. Rows without doc_id are judged, deduplicated and packed like others. Of
repeated rows near-dedup keeps one. Very long texts count like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import gam, langid, minhash, packing, substring
from lexivec.llm.shared import fresh, saved, tidied


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Texts that are null or without letters go; so do those whose score is
    below what nearly all rows of their language have. Equal texts are judged alike."""
    return langid.with_known_language(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model takes for good ones (0.5 or more); without labels all. Equal texts are judged
    alike; empty ones by statistics that are zero."""
    return gam.good_ones(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, null last, of several the
    first. Texts without words stay."""
    return minhash.one_of_each(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller doc_id has; those of which
    nothing is left go. n_chars, where there is one, is that of the text now. Documents without doc_id stay as they are."""
    counted = fresh("n_removed", docs.columns)
    out = substring.remove_repeats(docs, min_words=50).where((F.col(counted) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(counted) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; an empty text is its end mark."""
    return packing.pack(docs, capacity=1024)


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: No SQL: the first two stages are trained models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with tidied(spark) as keep:  # of what a stage writes only its result stays
            docs = keep(saved(stage(spark, docs, sf_dir), name))

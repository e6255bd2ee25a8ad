"""What a stream of records into the store and the index moves, and that it gives the same."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexivec.operators import index, store
from lexivec.streaming import ingest
from tests.test_index_moves import exchanges

FIXED, FRESH = ["name", "text"], ["ra"]


def sightings(spark, rows):
    return spark.createDataFrame(rows, "k string, at int, name string, text string, ra string")


def shuffled(spark):
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_of_new_records_are_not_shuffled(spark, tmp_path):
    """Two batches of new records go to the store and the index: less is shuffled than one batch's texts."""
    root, path = f"file://{tmp_path}/store", f"file://{tmp_path}/index"
    noise = F.concat_ws("", *[F.sha2(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(100)])
    rows = spark.range(60).select(F.concat(F.lit("u"), "id").alias("document_url"), F.concat(F.lit("b"), "id").alias("bid_no"), noise.alias("full_pdf_text"), F.lit("").alias("ra_no"), F.lit(1).alias("at"), "id")
    rows.write.parquet(f"file://{tmp_path}/in")
    rows, before = spark.read.parquet(f"file://{tmp_path}/in"), shuffled(spark)
    for k in (0, 1):
        ingest.apply_batch(rows.where(F.col("id") % 2 == k), k, root, "document_url", "at", ["bid_no", "full_pdf_text"], ["ra_no"], on_new=lambda new: index.update(spark, new.drop("full_pdf_text"), path))
    assert shuffled(spark) - before < 30 * 12_800 / 4
    assert ingest.snapshot(spark, root).agg(F.sum(F.length("full_pdf_text"))).first()[0] == 60 * 12_800
    assert index.stored(spark, path)[0].select("bid_no").distinct().count() == 60


@pytest.mark.parametrize("tie", [None, "name"])
def test_batches_with_keys_that_come_again(spark, tmp_path, tie):
    """As one aggregation and one outer join say: keys come once, again, in both batches, without key, time or values. A record
    without a time stays as it was, flag and all."""
    first = [("a", 1, "a1", "x", None), ("b", 2, "b2", "y", "r"), ("b", 1, "b1", None, "s"), (None, 1, "n", "n", "n"), ("", 1, "e", "e", "e"), *[(f"o{i}", i, f"o{i}", "t", "q") for i in range(5)]]
    later = [("b", 5, "b5", "z", None), ("o1", 7, "p", "p", "p"), ("n1", 3, "n1", "m", None), ("n2", 4, "n2", "m", "w"), ("n2", 6, "n6", "m", "v"), *[(f"l{i}", i, f"l{i}", "t", None) for i in range(5)]]
    if tie is None:
        first.append(("c", None, "c0", "w", "t"))
    alerts = []
    for k, rows in enumerate((first, later)):
        ingest.apply_batch(sightings(spark, rows), k, f"file://{tmp_path}/s", "k", "at", FIXED, FRESH, tie, on_new=lambda new: alerts.append(sorted(r.k for r in new.collect())))
    one, two = (store.snapshot_of_log(sightings(spark, rows), "k", "at", FIXED, FRESH, tie) for rows in (first, later))
    want = store.merged(one, two, "k", FIXED, FRESH)
    got = ingest.snapshot(spark, f"file://{tmp_path}/s")
    assert got.dtypes == want.dtypes
    want = want.withColumn("is_new", F.when(F.col("k") == "c", 1).otherwise(F.col("is_new")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert alerts == [sorted(r.k for r in one.collect()), sorted({r[0] for r in later} - {r[0] for r in first})]
    all_again = sightings(spark, 3 * later)
    assert sorted(map(repr, store.snapshot_of_batch(all_again, "k", "at", FIXED, FRESH, tie).select(*two.columns).drop("is_new").collect())) == sorted(map(repr, two.drop("is_new").collect()))


def records(spark, *rows):
    return spark.createDataFrame([(k, t, "Dept  of ΑΣ") for k, t in rows], "bid_no string, full_pdf_text string, department string")


def test_postings_of_records(spark):
    """The postings of chunks by themselves, and the first of each word in its record, without an exchange."""
    rows = records(spark, ("a", " ".join(f"w{i % 90} ΟΔΟΣ" for i in range(700))), ("b", "x y\x01 y  Straße STRASSE and so on"), ("c", None), ("d", ""), ("a__chunk_1", "x " * 900), ("e", "Z" * 3000), ("c", "a later text of c that counts"))
    kept = index.record_rows(rows, "full_pdf_text")
    made, chunks = index.record_postings(kept, 300, 50), index.chunks_of(kept, 300, 50)
    assert exchanges(made) == []
    key = lambda r: (r.term, r.bid_no, r.chunk_id, r.tf, r.dl)
    plain = index.postings(chunks, "chunk_id", index.rich(chunks), ["bid_no"])
    assert Counter(map(key, made.collect())) == Counter(map(key, plain.collect()))
    place = lambda r: int(r.chunk_id.rpartition("_")[2])
    least = {}
    for r in made.collect():
        least[r.term, r.bid_no] = min(place(r), least.get((r.term, r.bid_no), place(r)))
    assert Counter((r.term, r.bid_no, place(r)) for r in made.collect() if r.first) == Counter((*k, v) for k, v in least.items())


def test_records_by_term_after_updates(spark, tmp_path):
    """Replaced and removed records don't count; gone names those alone that had chunks before."""
    root = f"file://{tmp_path}/i"
    long = " ".join(f"w{i % 50} same" for i in range(400))
    index.update(spark, records(spark, ("a", long), ("b", "only in the second record"), ("c", long)), root, size=300)
    index.update(spark, records(spark, ("c", "a short text of the third record"), ("d", long)), root, size=300)
    index.remove(spark, records(spark, ("b", ""), ("none", "")).select("bid_no"), root)
    _, words = index.stored(spark, root)
    want = {r.term: r.df for r in words.postings.groupBy("term").agg(F.countDistinct("bid_no").alias("df")).collect()}
    got = {r.term: r.df for r in index.records_by_term(words.postings).collect()}
    assert got == want == {r.term: r.df for r in index.records_by_term(words.postings.drop("first")).collect()} and got["same"] == 2 and "second" not in got
    assert sorted((r.segment, r.bid_no) for r in spark.read.parquet(f"{root}/gone").collect()) == [(1, "c"), (2, "b")]

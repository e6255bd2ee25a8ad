"""What building an index moves: nothing that grows with the postings is shuffled."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexivec.operators import index, word_blocks


def exchanges(df):
    """Exchanges of a plan, without those of one row that is broadcast."""
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_postings_are_counted_without_a_shuffle(spark):
    rows = spark.range(0, 400, 1, 4).select("id", F.concat(F.lit("b a B "), F.col("id").cast("string"), F.lit(" a  b")).alias("t"))
    found = index.postings(rows, "id", F.col("t"))
    assert exchanges(found) == []
    got = Counter((r.term, r.tf, r.dl) for r in found.collect())
    assert got[("a", 2, 6)] == got[("b", 3, 6)] == 400 and sum(got.values()) == 1200


def test_rows_of_one_id_are_one(spark):
    """Repeated ids, and ids that are null, are counted together where their texts are of one length."""
    rows = [(1, "x y x"), (1, "x z z"), (2, "x y"), (None, "n"), (None, "n"), (3, ""), (4, None), (2, "x y z")]
    found = index.postings(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t"))
    got = sorted((r.term, r.chunk_id or 0, r.tf, r.dl) for r in found.collect())
    want = [("n", 0, 2, 1), ("x", 1, 3, 3), ("x", 2, 1, 2), ("x", 2, 1, 3), ("y", 1, 1, 3), ("y", 2, 1, 2), ("y", 2, 1, 3), ("z", 1, 2, 3), ("z", 2, 1, 3)]
    assert got == want


def test_blocks_are_dealt_once(spark):
    posts = spark.range(500).select(F.concat(F.lit("t"), F.col("id") % 7).alias("term"), F.col("id").alias("chunk_id"), F.lit(1).cast("long").alias("tf"), (F.col("id") % 3 + 1).cast("int").alias("dl"))
    made = word_blocks.blocks(posts, 16)
    by_range = [x for x in re.findall(r"(?<!Broadcast)Exchange hashpartitioning\((\w+)#", made._jdf.queryExecution().executedPlan().toString())]
    assert by_range.count("range") == 1 and "term" not in by_range
    assert made.agg(F.sum("n")).first()[0] == 500


@pytest.mark.parametrize("repeated", [False, True])
def test_statistics_of_a_segment(spark, tmp_path, repeated):
    """n, total and df of what is left after an update that replaces some records, and one that replaces none."""
    root = f"file://{tmp_path}/i"
    first = [(i, i // 2, f"w{i % 3} c c") for i in range(10)] + ([(3, 1, "w9 c c")] if repeated else [])
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id long, bid_no long, chunk string")
    index.add_segment(spark, root, frame(first), F.col("chunk"))
    later = [(0, 0, "new c"), (1, 0, "")]
    index.add_segment(spark, root, frame(later), F.col("chunk"))
    index.add_segment(spark, root, frame([(50, 50, "only")]), F.col("chunk"))
    left = [r for r in first if r[1] != 0] + later + [(50, 50, "only")]
    _, words = index.stored(spark, root)
    n, total = words.corpus.select("n", "total").first()
    assert (n, total) == (len(left), sum(len(t.split()) for *_, t in left))
    df = Counter(w for _, w in {(i, w) for i, _, t in left for w in t.split()})
    assert {r.term: r.df for r in words.terms.collect()} == dict(df)

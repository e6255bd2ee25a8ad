"""Best by words from blocks: the top n of all scores, with fewer blocks read."""

import random

import pytest
from pyspark.sql import functions as F

from lexivec.operators import index, retrieval, word_blocks

COMMON = [f"c{i}" for i in range(6)]


def texts(n, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(COMMON) if r.random() < 0.5 else f"w{int(r.random() ** 3 * 900)}" for _ in range(int(3 + r.random() ** 4 * 400)))) for i in range(n)]


@pytest.fixture(scope="module")
def words(spark):
    rows = texts(3000) + [(5000, ""), (5001, None), (5002, "c0 " * 90), (5003, "c0 " * 90)]
    return index.build(spark.createDataFrame(rows, "chunk_id long, text string"), "chunk_id", F.col("text"))


@pytest.fixture(scope="module")
def stored(spark, words, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('blocks')}/w"
    word_blocks.write(words, root, rows=32)
    return word_blocks.WordBlocks.opened(spark, root)


@pytest.mark.parametrize("question", ["c0", "c0 c1 c0", "C3 w1 w880", "w2 w3 w4 c5", "c0 c1 c2 c3 c4 c5", "unknown", "unknown c1", ""])
@pytest.mark.parametrize("n", [1, 40])
def test_top_of_all_scores(words, stored, question, n):
    every = retrieval.bm25_scores(words, question).orderBy(F.desc("score"), "chunk_id").limit(n).collect()
    found = stored.topn(question, n)
    assert [tuple(r) for r in found.scores.orderBy(F.desc("score"), "chunk_id").collect()] == [tuple(r) for r in every]
    assert found.read <= found.blocks


def test_common_words_skip_blocks(stored):
    found = stored.topn("c0 c1", 10)
    assert 0 < found.read < found.blocks


def test_no_block_is_large(stored):
    sizes = stored.blocks.agg(F.max(F.size("hits")), F.sum("n"), F.sum(F.size("hits"))).first()
    assert sizes[0] < 32 * 3 and sizes[1] == sizes[2]


def test_more_than_there_are(words, stored):
    assert stored.topn("c0", 10_000).scores.count() == retrieval.bm25_scores(words, "c0").count()


def test_empty_index(spark, tmp_path):
    none = index.build(spark.createDataFrame([], "chunk_id long, text string"), "chunk_id", F.col("text"))
    word_blocks.write(none, f"file://{tmp_path}/w")
    assert word_blocks.WordBlocks.opened(spark, f"file://{tmp_path}/w").topn("c0").scores.isEmpty()

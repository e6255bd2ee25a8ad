"""The stored dense index: exact mode, recall, pruning by cells, segments, edges."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.operators import dense_index, retrieval

SCHEMA = "chunk_id long, embedding array<double>, lang string"


def clustered(n, groups=30, d=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    return centres[np.arange(n) % groups] + 0.35 * rng.standard_normal((n, d))


def rows_of(x, first=0):
    return [(first + i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)]


def plain(rows, q, n=40):
    out = []
    for i, v, _ in rows:
        v = np.array(v)
        out.append((-(v @ q) / np.sqrt((v @ v) * (q @ q)), i))
    return [i for _, i in sorted(out)[:n]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = rows_of(clustered(3000))
    root = f"file://{tmp_path_factory.mktemp('dense')}/index"
    dense_index.add(spark, root, spark.createDataFrame(rows, SCHEMA), keep=["lang"])
    return dense_index.DenseIndex.opened(spark, root), rows, root


def test_exact_mode_is_the_scan(index, spark):
    found, rows, _ = index
    q = np.array(rows[5][1]) + 0.1
    want = plain(rows, q)
    got = found.topn(q.tolist(), exact=True).orderBy("dense_rank").collect()
    assert [r.chunk_id for r in got] == want
    scan = retrieval.dense_topn(spark.createDataFrame(rows, SCHEMA), q.tolist()).orderBy("dense_rank").collect()
    assert [(r.chunk_id, r.semantic) for r in got] == [(r.chunk_id, r.semantic) for r in scan]
    filtered = found.topn(q.tolist(), 10, filters={"lang": "b"}, exact=True).orderBy("dense_rank").collect()
    assert [r.chunk_id for r in filtered] == plain([r for r in rows if r[2] == "b"], q, 10)


def test_recall_with_few_cells(index):
    """Clusters let a question read a part of the cells and still find what is near."""
    found, rows, _ = index
    assert found.model.probes <= len(found.model.centres) / 3
    hits = 0
    for k in range(0, 3000, 300):
        q = np.array(rows[k][1])
        hits += len(set(plain(rows, q)) & {r.chunk_id for r in found.topn(q.tolist()).collect()})
    assert hits >= 0.9 * 400


def test_a_question_prunes_folders(index):
    found, rows, _ = index
    cells = found.model.probed(np.array(rows[0][1]), 2)
    few, every = found.rows(cells, None), found.rows(None, None)
    assert len(few.inputFiles()) == len(every.inputFiles()) or "PartitionFilters: [" in few._jdf.queryExecution().toString()
    assert few.select(F.input_file_name()).distinct().count() <= 2 < every.select(F.input_file_name()).distinct().count()
    assert every.count() == 3000


def test_many_questions_are_single_ones(index, spark):
    found, rows, _ = index
    asked = spark.createDataFrame([(i, rows[i][1]) for i in (1, 77, 500)], "query_id long, embedding array<double>")
    got = found.topn_of_all(asked, n=15, exact=True).collect()
    for i in (1, 77, 500):
        assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == plain(rows, np.array(rows[i][1]), 15)
    near = found.topn_of_all(asked, n=15).groupBy("query_id").count().collect()
    assert {r["count"] for r in near} == {15}


def test_later_segments_replace(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    a, b = rows_of(clustered(400)), rows_of(clustered(300, seed=2), first=300)
    dense_index.add(spark, root, spark.createDataFrame(a, SCHEMA), keep=["lang"])
    dense_index.add(spark, root, spark.createDataFrame(b, SCHEMA), keep=["lang"])
    found = dense_index.DenseIndex.opened(spark, root)
    now = a[:300] + b
    for k in (10, 350, 590):
        q = np.array(now[k][1])
        assert [r.chunk_id for r in found.topn(q.tolist(), exact=True).orderBy("dense_rank").collect()] == plain(now, q)
    assert found.rows(None, None).count() == 600


def test_edges(spark, tmp_path):
    nan = float("nan")
    root = f"file://{tmp_path}/index"
    rows = [(1, None, "a"), (2, [0.0, 0.0], "a"), (3, [nan, 1.0], "a"), (4, [None, 1.0], "a"), (5, [1e200, 1e200], "a"), (6, [1.0, 1.0], "a"), (7, [1e-200, 0.0], "a"), (8, [], "a")]
    dense_index.add(spark, root, spark.createDataFrame(rows, SCHEMA))
    found = dense_index.DenseIndex.opened(spark, root)
    assert [r.chunk_id for r in found.topn([2.0, 2.0]).orderBy("dense_rank").collect()] == [5, 6, 7]
    none = f"file://{tmp_path}/none"
    dense_index.add(spark, none, spark.createDataFrame([], SCHEMA))
    assert dense_index.DenseIndex.opened(spark, none).model is None


def test_a_large_cell_has_many_files(spark, monkeypatch):
    monkeypatch.setattr(dense_index, "FILE_ROWS", 100)
    x = clustered(500, groups=1)
    rows = dense_index.unit_rows(spark.createDataFrame(rows_of(x), SCHEMA).select("chunk_id", "embedding"))
    model = dense_index.Model(x.mean(0, keepdims=True), [np.zeros((1, 12))] * 2, np.array([0, 12, 24]))
    placed = dense_index.place(rows, model)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 500 and max(sizes) < 400


def test_a_crowd_aside_is_found():
    """Near copies at a cosine of 0.42 are a question's nearest, though their cell's centre lies further off than those of wide cells."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True))
    crowd = unit(rng.normal(size=64))
    x = np.concatenate([unit(rng.normal(size=(3000, 64))), unit(crowd + 0.02 * rng.normal(size=(150, 64)))])
    model = dense_index.Model.trained(x, len(x))
    aside = unit(rng.normal(size=(20, 64)))
    asked = unit(0.42 * crowd + 0.91 * unit(aside - np.outer(aside @ crowd, crowd)))
    cells = model.cells_of(x)
    for q in asked:
        best = np.argsort(-(x @ q))[:40]
        assert np.isin(cells[best], model.probed(q, len(model.centres) // 2)).mean() >= 0.7


def even(n, d=64, seed=3):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def test_codes_find_what_is_near_in_an_index_larger_than_its_sample(spark, tmp_path):
    """Vectors without clusters, ten times as many as trained on: single questions and many find their nearest."""
    x = even(12_000)
    vectors = spark.createDataFrame(pa.table({"chunk_id": np.arange(len(x)), "embedding": pa.array(list(x))}))
    root = f"file://{tmp_path}/index"
    dense_index.add(spark, root, vectors, sample=1_200)
    found = dense_index.DenseIndex.opened(spark, root)
    asked = vectors.where("chunk_id % 300 = 0").withColumnRenamed("chunk_id", "query_id")
    near = {}
    for r in found.topn_of_all(asked).collect():
        near.setdefault(r.query_id, set()).add(r.chunk_id)
    shares = [len(near[k] & set(np.argsort(-(x @ x[k]))[:40].tolist())) / 40 for k in range(0, 12_000, 300)]
    assert min(shares) >= 0.7 and np.mean(shares) >= 0.9
    one = {r.chunk_id for r in found.topn(x[300].tolist()).collect()}
    assert len(one & set(np.argsort(-(x @ x[300]))[:40].tolist())) >= 28


@pytest.mark.parametrize("exact", [True, False])
def test_rows_between_are_bounded_by_shards_not_by_cells(index, spark, monkeypatch, exact):
    """Groups of a thousand vectors and forty questions: three or so shards give n rows a question each, and copies go by chunk_id."""
    found, rows, _ = index
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 3000, 30)], "query_id long, embedding array<double>")
    want = {tuple(r) for r in found.topn_of_all(asked, n=15, exact=True).select("query_id", "chunk_id", "rank").collect()}
    monkeypatch.setattr(dense_index, "SHARD", 1000 * 8 * 24)
    monkeypatch.setattr(dense_index, "BLOCK", 40 * 8 * 24)
    assert found.candidates(asked, 15, exact=exact).count() <= 100 * 3 * 15
    got = {tuple(r) for r in found.topn_of_all(asked, n=15, exact=exact).select("query_id", "chunk_id", "rank").collect()}
    assert got == want if exact else len({r[:2] for r in got} & {r[:2] for r in want}) >= 0.9 * len(want)


def test_copies_go_by_chunk_id(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    copy = [0.3, 0.5, 0.7]
    dense_index.add(spark, root, spark.createDataFrame([(i, copy if i % 2 else [float(i), 1.0, -1.0], "a") for i in range(200, 0, -1)], SCHEMA))
    found = dense_index.DenseIndex.opened(spark, root)
    asked = spark.createDataFrame([(1, copy)], "query_id long, embedding array<double>")
    for exact in (True, False):
        assert [r.chunk_id for r in found.topn_of_all(asked, n=9, exact=exact).orderBy("rank").collect()] == list(range(1, 18, 2))

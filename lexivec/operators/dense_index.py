"""A stored approximate index of vectors: trained cells, short codes of what is left within a cell, exact scores for what they find.

Vectors have length one. Centres of cells and, for each of PARTS slices of a vector, up to CODES codewords of the
differences to the centres are trained by k-means on at most ``sample`` vectors. Every vector lies in the folder of its
nearest cell, with its code, in files of a bounded number of rows: a question reads the folders of the cells that promise most for it alone, scores
codes by sums from a table, and compares the best of them exactly. How many cells (probes) and how many codes a result (depth)
that takes is measured when the index is trained: the least of a few settings with which sampled vectors find their
nearest ones among the sample. Among more vectors more codes come before a near one's, so a search takes as many
for each sample's worth of vectors. All cells without codes are exact search.

Tables under a root: model (one row), vectors (cell=, chunk_id, embedding, code, and columns for filters) by segment; a segment is
there once its model row is. Later segments use the first one's training; an id that comes again is the later one's.

Defined results: null vectors, zero ones and those with null or non-finite components are not found; of equal cosines the
smaller chunk_id goes first; fewer than n vectors are all found; an empty index finds none.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from lexivec.operators.retrieval import FETCH, cosine, equal_to, ranked
from lexivec.operators.scratch import tidied, written

#: Bounds of the training: vectors, cells, slices of a vector, codewords of a slice, rounds of k-means.
SAMPLE, CELLS, PARTS, CODES, STEPS = 20_000, 4096, 16, 256, 12
#: Rows of a cell's file.
FILE_ROWS = 200_000
#: The share of their nearest that sampled vectors must find, together and each.
RECALL, LEAST = 0.95, 0.8
#: Bytes of the vectors and of the questions that meet in one group of a search for many, and questions scored at once.
SHARD, BLOCK, AT_ONCE = 32 << 20, 4 << 20, 64


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """By row the nearest centre, in blocks."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def leading(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest scores, and of those that differ from the last by rounding alone, in order."""
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n] - 1e-12) if len(scores) > n else np.arange(len(scores))


def matrix(vectors: pa.ChunkedArray, d: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy().reshape(-1, d)


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centres; one that loses all rows takes the row furthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(STEPS):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if len(lost := np.flatnonzero(n == 0)):
            centres[lost] = x[np.argsort(-((x - centres[own]) ** 2).sum(1))[: len(lost)]]
    return centres


@dataclass
class Model:
    """centres [cells, d]; books: codewords [codes, slice] of each slice; bounds: where slices begin and end; fitted: vectors
    among which depth was measured; total: those of the index."""

    centres: np.ndarray
    books: list[np.ndarray]
    bounds: np.ndarray
    probes: int = 1
    depth: int = 4
    fitted: int = 0
    total: int = 0

    @classmethod
    def trained(cls, x: np.ndarray, total: int, k: int = FETCH, recall: float = RECALL) -> Model:
        cells = int(max(1, min(CELLS, np.sqrt(total), len(x) // 8)))
        centres = kmeans(x, cells, 1)
        rest = x - centres[nearest(x, centres)]
        d = x.shape[1]
        bounds = np.linspace(0, d, min(PARTS, d) + 1).astype(int)
        books = [kmeans(rest[:, a:b], CODES, 2 + i) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
        out = cls(centres, books, bounds, fitted=len(x), total=total)
        out.calibrate(x, k, recall)
        return out

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centres)

    def promise(self, q: np.ndarray) -> np.ndarray:
        """By question (rows) and cell the cosine that the cell's better vectors may have: that of its centre and twice the spread round it.
        Vectors have length one, so the shorter a cell's centre, the wider it is; a dense crowd's cell is narrow, but its
        centre's cosine is that of all its vectors."""
        return q @ self.centres.T + 2 * np.sqrt(np.maximum(0.0, 1 - (self.centres**2).sum(1)) / self.centres.shape[1])

    def probed(self, q: np.ndarray, probes: int | None) -> list[int]:
        """The cells that promise most for a question."""
        return np.argsort(-self.promise(q))[: probes or self.probes].tolist()

    def opened(self, q: np.ndarray, probes: int) -> np.ndarray:
        """By question (rows) and cell whether it is one of those."""
        out = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(out, np.argsort(-self.promise(q), 1)[:, :probes], True, 1)
        return out

    def compared(self, n: int, rows: int) -> int:
        """How many of so many rows are compared exactly for n results."""
        return self.depth * n * max(1, -(-rows // self.fitted) if self.fitted else 1)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = x - self.centres[cells]
        return np.stack([nearest(rest[:, a:b], book) for book, a, b in zip(self.books, self.bounds, self.bounds[1:])], 1).astype(np.uint8)

    def scores(self, q: np.ndarray, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """About the cosines of a question and coded vectors: one sum from a table for each slice."""
        out = (self.centres @ q)[cells]
        for i, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            out = out + (self.books[i] @ q[a:b])[codes[:, i]]
        return out

    def calibrate(self, x: np.ndarray, k: int, recall: float) -> None:
        """probes and depth with which sampled vectors find their k nearest in the sample, to this share."""
        rng = np.random.default_rng(9)
        asked = x[rng.permutation(len(x))[:256]]
        k = min(k, len(x))
        cells = self.cells_of(x)
        codes = self.codes(x, cells)
        exact = asked @ x.T
        best = [set(np.argsort(-e)[:k].tolist()) for e in exact]
        near = np.argsort(-self.promise(asked), 1)
        coded = [self.scores(q, codes, cells) for q in asked]
        n = len(self.centres)
        enough = lambda shares: np.mean(shares) >= recall and min(shares) >= LEAST
        for self.probes in sorted({max(1, -(-n * share // 100)) for share in (1, 2, 5, 10, 20, 35, 50, 70, 85, 100)}):
            open_ = [np.isin(cells, row[: self.probes]) for row in near]
            if not enough([o[list(b)].mean() for o, b in zip(open_, best)]):
                continue
            for self.depth in (2, 4, 8, 16):
                found = [set(np.argsort(-np.where(o, s, -9))[: self.depth * k].tolist()) for o, s in zip(open_, coded)]
                if enough([len(f & b) / max(len(b), 1) for f, b in zip(found, best)]):
                    return


def unit_rows(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has a direction, with it as array<double> of length one."""
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(sound, F.lit(False)))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    scaled = F.transform(v, lambda x: x / F.array_max(F.transform(v, F.abs)))
    rows = rows.withColumn(vector, scaled)
    return rows.withColumn("_norm", norm(F.col(vector))).withColumn(vector, F.transform(vector, lambda x: x / F.col("_norm"))).drop("_norm")


def add(spark: SparkSession, root: str, vectors: DataFrame, keep: Sequence[str] = (), sample: int = SAMPLE) -> None:
    """Write vectors (chunk_id, embedding and the columns to keep) as a segment; the first one trains on a sample by hash."""
    known = models(spark, root)
    with tidied(spark):
        rows = written(unit_rows(vectors.select("chunk_id", "embedding", *keep)), "unit-vectors")
        if known:
            k, model = known[-1][0] + 1, known[-1][1] and replace(known[-1][1], total=known[-1][1].total + rows.count())
        else:
            total = rows.count()
            some = rows.select("embedding").orderBy(F.xxhash64("chunk_id")).limit(sample).toArrow()["embedding"]
            x = np.array(some.to_pylist(), np.float64)
            k, model = 0, Model.trained(x, total) if len(x) else None
        if model is not None:
            place(rows, model).write.mode("overwrite").partitionBy("cell").parquet(f"{root}/vectors/segment={k}")
        spark.createDataFrame([(k, pickle.dumps(model), rows.schema.json())], "segment int, model binary, columns string").coalesce(1).write.mode("overwrite").parquet(f"{root}/model/part={k}")


def place(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with code and cell, dealt so that a cell's files have at most about FILE_ROWS rows."""

    def code(vectors: pa.Array) -> pa.Array:
        x = np.stack(vectors.to_numpy(zero_copy_only=False)) if len(vectors) else np.zeros((0, model.centres.shape[1]))
        cells = model.cells_of(x)
        return pa.StructArray.from_arrays([pa.array([c.tobytes() for c in model.codes(x, cells)], pa.binary()), pa.array(cells, pa.int32())], ["code", "cell"])

    coded = written(rows.withColumn("_c", F.arrow_udf(code, "code binary, cell int")(F.col("embedding"))).select("*", "_c.*").drop("_c"), "coded")
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).alias("_files"))
    dealt = coded.join(sizes, "cell").withColumn("_deal", F.pmod(F.xxhash64("chunk_id"), F.col("_files")))
    return dealt.repartition("cell", "_deal").sortWithinPartitions("cell", "chunk_id").drop("_files", "_deal")


def models(spark: SparkSession, root: str) -> list[tuple[int, Model, str]]:
    """Segment, training and columns of the segments that are there; a few rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/model")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return [(r.segment, pickle.loads(r.model), r.columns) for r in spark.read.parquet(f"{root}/model").orderBy("segment").collect()]


@dataclass
class DenseIndex:
    """An index to search. model: None while it is empty."""

    vectors: DataFrame | None
    model: Model | None
    segments: int

    @classmethod
    def opened(cls, spark: SparkSession, root: str) -> DenseIndex:
        known = models(spark, root)
        if not known or known[0][1] is None:
            return cls(None, None, 0)
        columns = StructType.fromJson(json.loads(known[0][2]))
        schema = StructType([*columns, StructField("code", BinaryType()), StructField("segment", IntegerType()), StructField("cell", IntegerType())])
        return cls(spark.read.schema(schema).parquet(f"{root}/vectors").where(F.col("segment") <= known[-1][0]), known[-1][1], len(known))

    def rows(self, cells: Sequence[int] | None, filters: dict[str, str] | None) -> DataFrame:
        """What lies in some cells (None: in all). Of an id that later segments have too the last, if its cell is among them."""
        found = self.vectors if cells is None else self.vectors.where(F.col("cell").isin([int(c) for c in cells]))
        if self.segments > 1:
            last = self.vectors.groupBy(F.col("chunk_id").alias("_id")).agg(F.max("segment").alias("_last"))
            found = found.join(last, (F.col("chunk_id") == F.col("_id")) & (F.col("segment") < F.col("_last")), "left_anti")
        return found.where(equal_to(filters))

    def topn(self, query: Sequence[float], n: int = FETCH, filters: dict[str, str] | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """chunk_id, semantic, dense_rank of the n nearest found. exact: all cells, every vector compared."""
        q = np.asarray(query, np.float64)
        q = q / (np.sqrt(q @ q) or 1.0)
        if exact:
            near = self.rows(None, filters)
        else:
            cells = self.model.probed(q, probes)
            model, depth = self.model, self.model.compared(n, self.model.total)

            def score(codes: pa.Array, where: pa.Array) -> pa.Array:
                c = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
                return pa.array(model.scores(q, c, where.to_numpy(zero_copy_only=False)))

            by_code = self.rows(cells, filters).select("chunk_id", "cell", F.arrow_udf(score, "double")("code", "cell").alias("about"))
            # n * depth ids at most for each sample's worth of vectors; as literals they reach the scan of their cells.
            best = by_code.orderBy(F.desc("about")).limit(depth).collect()
            near = self.rows({r.cell for r in best}, filters).where(F.col("chunk_id").isin([r.chunk_id for r in best]))
        found = near.select("chunk_id", cosine(F.col("embedding"), q.tolist()).alias("cos")).orderBy(F.desc("cos"), "chunk_id").limit(n)
        return ranked(found, [F.desc("cos"), F.col("chunk_id")], "dense_rank").select("chunk_id", F.round("cos", 4).alias("semantic"), "dense_rank")

    def topn_of_all(self, queries: DataFrame, n: int = FETCH, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, chunk_id, cos, rank for many questions (query_id, embedding) at once. exact: all cells, no codes."""
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), F.col("chunk_id")))
        return self.candidates(queries, n, probes, exact).withColumn("rank", place).where(F.col("rank") <= n).select("query_id", "chunk_id", "cos", "rank")

    def candidates(self, queries: DataFrame, n: int = FETCH, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, chunk_id, cos of the n nearest found in each shard of the vectors, of equal cosines those with smaller
        chunk_id. A block of questions meets a shard as a group of bounded size, which looks into the cells that promise most
        for each question and compares the best by code there exactly; rows are as many as questions, shards and n tell, whatever the cells."""
        model, probes = self.model, probes or self.model.probes
        d = model.centres.shape[1]
        asked = unit_rows(queries.select("query_id", "embedding")).withColumnRenamed("embedding", "q")
        rows = self.rows(None, None).select("chunk_id", "cell", "code", "embedding")
        most = lambda size: max(1, size // (8 * d))
        of_asked, cores = asked.count(), rows.sparkSession.sparkContext.defaultParallelism
        shards = max(1, -(-rows.count() // most(SHARD)))
        blocks = max(1, -(-of_asked // most(BLOCK)), min(-(-2 * cores // shards), -(-of_asked // AT_ONCE)))
        mine = lambda key, of, name: F.pmod(F.xxhash64(key), F.lit(of)).cast("int").alias(name)
        each = lambda of, name: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(name)
        left = asked.select("query_id", "q", mine("query_id", blocks, "block"), each(shards, "shard"))
        right = rows.select("chunk_id", "cell", "code", "embedding", mine("chunk_id", shards, "shard"), each(blocks, "block"))
        kind = rows.schema["chunk_id"].dataType.simpleString()

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            counts, found, cosines = [0] * a.num_rows, [], []
            if a.num_rows and b.num_rows:
                b = b.take(pc.sort_indices(b["chunk_id"]))  # equal cosines are then in order
                x, asked_here = matrix(b["embedding"], d), matrix(a["q"], d)
                cells, few = b["cell"].to_numpy(), model.compared(n, b.num_rows)
                codes = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
                for i in range(0, a.num_rows, AT_ONCE):
                    some = asked_here[i : i + AT_ONCE]
                    what = some @ x.T if exact else model.opened(some, probes)
                    for j, q in enumerate(some):
                        if exact:
                            near = leading(what[j], n)
                        else:
                            inside = np.flatnonzero(what[j][cells])
                            near = inside[leading(model.scores(q, codes[inside], cells[inside]), few)]
                        cos = (x[near] * q).sum(1)
                        top = np.argsort(-cos, kind="stable")[:n]
                        counts[i + j] = len(top)
                        found.append(near[top])
                        cosines.append(cos[top])
            at = np.concatenate(found) if found else np.zeros(0, np.int64)
            ids = a["query_id"].take(pa.array(np.repeat(np.arange(a.num_rows), counts)))
            return pa.table({"query_id": ids, "chunk_id": b["chunk_id"].take(pa.array(at)), "cos": np.concatenate(cosines) if cosines else np.zeros(0)})

        return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(best, f"query_id long, chunk_id {kind}, cos double")

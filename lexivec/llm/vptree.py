"""Nearest neighbours by largest inner product: a vantage-point tree in every shard.

A vantage-point tree needs a metric, so vectors get one more component that brings all of them to one length, the
largest of the table, while queries get zero there: the nearest by distance are then those with the largest inner
product. A subtree is skipped if the triangle inequality, with a query's radius multiplied by ``factor``, leaves
nothing in it; factor 1 is exact search, less is faster.

Rows are dealt to shards of about ``shard_bytes`` by a hash of their place in the input, whatever their ids and vectors
are, so that copies spread over all shards. Queries come in blocks of the same size; each task has the tree of one
shard and one block of queries, both bounded, and gives each query's best of that shard. So trees are read once for
each block and queries once for each shard: at 64 dimensions a shard or block has some 65,000 rows, and of 5 million
vectors with 250,000 queries some 10 GB of either are moved. The bests meet in a ranking by
query, whose input is k rows for each query and shard. Trees are built once and written to the shared folder.

Trees and pruning use vectors scaled by powers of two, which neither overflow nor lose digits; scores are sums of products of the original
components in double precision in component order, so that ties are ties and go to the smaller id. Of equal vectors in a shard
only so many smallest ids are kept as can be among the k best, which loses nothing.

Defined results: vectors null, zero, or holding null or non-finite components take no part, neither as queries nor as
candidates, nor do rows without vec_id. Vectors of different lengths have no inner product: each length is searched by
itself. A query's own rows (by vec_id) are no candidates; of the query rows of one vec_id the one with the least vector
asks; candidate rows of one vec_id are candidates each by itself. A score that overflows is infinite, and one that is no number is the least.
Fewer than k candidates are all returned; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.shared import saved

LEAF = 512
#: Bytes of the vectors of a shard and of a block of queries; queries that go through a tree together.
SHARD_BYTES, STEP = 32_000_000, 2048
#: Rows that a shard has at least where there are enough of them for all cores.
LEAST_ROWS = 4096


def scaled(x: np.ndarray, power: int) -> np.ndarray:
    """Rows times a power of two; those that it would leave far from one get a power of their own instead."""
    own = np.frexp(np.abs(x).max(1, initial=0))[1]
    return np.ldexp(x, np.where(np.abs(own + power) < 100, power, -own)[:, None])


def useful(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those whose vector k + 1 smaller ids, or k rows of the same id, have too."""
    if not len(x):
        return np.zeros(0, np.int64)
    group = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]
    o = np.lexsort((ids, group))
    new_group = np.diff(group[o], prepend=-1) != 0
    new_id = new_group | (np.diff(ids[o], prepend=0) != 0)
    place = np.arange(len(o))
    nth_id = np.cumsum(new_id)
    nth_id -= nth_id[np.maximum.accumulate(np.where(new_group, place, 0))]
    nth_row = place - np.maximum.accumulate(np.where(new_id, place, 0))
    return o[(nth_id <= k) & (nth_row < k)]


class Tree:
    """Rows of a shard in the order of the tree's leaves. A node is (vantage row, radius, inside, outside) or
    (first row, last row). longest: no vector of the table is longer."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.power = -int(np.frexp(longest)[1])
        z = np.ldexp(x, self.power)
        self.longest = float(np.ldexp(longest, self.power))
        extra = np.sqrt(np.maximum(self.longest**2 - (z * z).sum(1), 0))
        y = np.column_stack([z, extra])
        order: list[np.ndarray] = []
        self.nodes: list[tuple] = []
        placed = 0

        def build(rows: np.ndarray) -> int:
            nonlocal placed
            me = len(self.nodes)
            self.nodes.append(())
            if len(rows) > LEAF:
                v = y[rows[rng.integers(len(rows))]]
                d = np.sqrt(((y[rows] - v) ** 2).sum(1))
                r = float(np.median(d))
                inside = d <= r
                if not inside.all():
                    a, b = d[inside].max(), d[~inside].min()
                    self.nodes[me] = (v, float(a), float(b), build(rows[inside]), build(rows[~inside]))
                    return me
            order.append(rows)
            self.nodes[me] = (placed, placed := placed + len(rows))
            return me

        build(np.arange(len(ids)))
        order_all = np.concatenate(order)
        self.ids, self.x = ids[order_all], x[order_all]

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, id, score) of each query's k best."""
        n = len(q)
        best, best_s = (np.full((n, k), -np.inf) for _ in range(2))
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        z = np.ldexp(self.x, self.power)
        qs = scaled(q, self.power)
        norms = (qs * qs).sum(1) + self.longest**2
        slack = 1e-9 * norms

        def radius(who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norms[who] - 2 * best_s[who].min(1) + slack[who], 0))

        def leaf(who: np.ndarray, a: int, b: int) -> None:
            s = qs[who] @ z[a:b].T
            hope = s >= best_s[who].min(1)[:, None] - slack[who, None]
            hope &= self.ids[None, a:b] != qid[who, None]
            some = hope.any(1)
            if not some.any():
                return
            who, s, hope = who[some], s[some], hope[some]
            if hope.shape[1] > k:  # the k-th best of a leaf bounds what may enter
                s = np.where(hope, s, -np.inf)
                bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                hope &= s >= bar[:, None] - slack[who, None]
            r, c = np.nonzero(hope)
            exact = products(q[who[r]], self.x[a + c])
            rows = np.concatenate([np.repeat(np.arange(len(who)), k), r])
            score, near = np.concatenate([best[who].ravel(), exact]), np.concatenate([best_s[who].ravel(), s[r, c]])
            ids = np.concatenate([best_id[who].ravel(), self.ids[a + c]])
            o = np.lexsort((np.isneginf(near), ids, -score, rows))
            rows, score, near, ids = rows[o], score[o], near[o], ids[o]
            take = np.searchsorted(rows, np.arange(len(who)))[:, None] + np.arange(k)
            best[who], best_s[who], best_id[who] = score[take], near[take], ids[take]

        def visit(node: int, who: np.ndarray) -> None:
            it = self.nodes[node]
            if len(it) == 2:
                leaf(who, *it)
                return
            v, a, b, inside, outside = it
            d = np.sqrt(np.maximum(((qs[who] - v[:-1]) ** 2).sum(1) + v[-1] ** 2, 0))
            near = d <= (a + b) / 2
            for first, second, side in ((inside, outside, near), (outside, inside, ~near)):
                mine, dist = who[side], d[side]
                if len(mine):
                    visit(first, mine)
                    gap = b - dist if second == outside else dist - a
                    go = gap <= factor * radius(mine)
                    if go.any():
                        visit(second, mine[go])

        visit(0, np.arange(n))
        rows, cols = np.nonzero(np.isfinite(best_s))
        return rows, best_id[rows, cols], best[rows, cols]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in component order; minus infinity for what is no number."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
    return np.where(np.isnan(total), -np.inf, total)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) and its length of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    return rows.where(fine).withColumn("length", F.size("embedding"))


def stack(lists: pa.ChunkedArray, length: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().reshape(-1, length)


def longest_of(largest: float, squares: float, length: int) -> float:
    """No less than the length of any vector, from the largest component and the largest sum of squares."""
    return float(np.sqrt(squares)) * (1 + 1e-9) if 1e-290 < squares < 1e290 else min(largest, 1e300) * float(np.sqrt(length))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_bytes: int = SHARD_BYTES, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors to each row of queries (both vec_id, embedding)."""
    base = usable(vectors)
    asked = usable(queries).groupBy("vec_id", "length").agg(F.min("embedding").alias("embedding")).groupBy("vec_id").agg(F.min_by(F.struct("embedding", "length"), "embedding").alias("q"))
    asked = asked.select("vec_id", "q.embedding", "q.length")
    # A row for each length that occurs, which the driver holds.
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    largest = F.array_max(F.transform("embedding", F.abs))
    found = base.groupBy("length").agg(F.count("*").alias("n"), F.max(largest).alias("largest"), F.max(squares).alias("squares")).collect()
    asked_of = {r.length: r["count"] for r in asked.groupBy("length").count().collect()}
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    longest = {r.length: longest_of(r.largest, r.squares, r.length) for r in found}
    parts = lambda n, length: max(1, -(-n * 8 * length // shard_bytes), min(cores, n // LEAST_ROWS))
    shards = {r.length: parts(r.n, r.length) for r in found if r.length in asked_of}
    blocks = {r.length: max(1, -(-asked_of[r.length] * 8 * r.length // shard_bytes)) for r in found if r.length in asked_of}
    of = lambda counts: F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]) if counts else F.create_map(F.lit(0), F.lit(1)), F.col("length"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        length, shard = key[0].as_py(), key[1].as_py()
        ids, x = rows["vec_id"].to_numpy(), stack(rows["embedding"], length)
        keep = useful(ids, x, k)
        return pa.table({"length": pa.array([length], pa.int32()), "shard": pa.array([shard], pa.int32()), "tree": pa.array([pickle.dumps(Tree(ids[keep], x[keep], longest[length]))], pa.binary())})

    dealt = base.withColumn("place", F.monotonically_increasing_id()).where(F.col("length").isin([*shards]))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("place"), of(shards)).cast("int")).drop("place")
    trees = saved(dealt.groupBy("length", "shard").applyInArrow(build, "length int, shard int, tree binary"), "trees")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), of(blocks)).cast("int"))
    to_all = asked.where(F.col("length").isin([*shards])).withColumn("shard", F.explode(F.sequence(F.lit(0), of(shards) - 1)))
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), of(blocks) - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        tree: Tree = pickle.loads(right["tree"][0].as_py())
        qid, q = left["vec_id"].to_numpy(), stack(left["embedding"], left["length"][0].as_py())
        parts = [(i, *tree.search(qid[i : i + step], q[i : i + step], k, factor)) for i in range(0, len(q), step)]
        return pa.table([np.concatenate([qid[i + r] for i, r, _, _ in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])], schema=out)

    keys = ["length", "shard", "block"]
    found = to_all.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

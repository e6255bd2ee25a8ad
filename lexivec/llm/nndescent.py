"""Near-duplicates of embeddings by NN-descent: a graph of neighbours refined through neighbours of neighbours.

Equal vectors of one label (by a 128-bit hash) are one node. What is denser still would fill lists of neighbours with its
own kind, so dense crowds become one site first: nodes within half the asked angle of a pivot are all linked with each
other, which no list has to say. Nodes without a crowd are sites of radius zero.

The graph starts from several orders of the sites by the signs of random projections, in each of which consecutive
sites are compared. A round joins every site with its neighbours, those that have it as one included, and compares pairs of
which one is new there; each keeps its ``k`` nearest and, beyond these, every one in range (the asked angle and both radii):
a list that its links saturate is enlarged by as many. Rounds end when they find no more in range and change little. Then
the audit compares some sites with all: if lists miss any of what is in range, the rounds go on with twice the places.

At the end edges in range become counts of links. By the triangle inequality an edge between sites links all members, or a
member of one all of the other, or nobody; what that leaves open is compared exactly, in blocks, and only counted. So
no step has all pairs of a group as rows. Vectors in lists are single precision with a margin; links are decided by the cosine in
double precision.

Defined results: vectors that are null, zero or hold null or non-finite components, and those without label, link with
nothing, nor do vectors of different lengths. Rows without vec_id are linked like others; null is no smaller than any, and a
component without ids has none. Rows of one vec_id are each a row. An empty table gives none. Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.minhash import components
from lexivec.llm.shared import saved, tidied

#: Places of a list beyond what is in range; orders that start the graph; sites of an order compared at once.
PLACES, ORDERS, CHUNK = 8, 4, 48
#: Members from which on nodes are a crowd; nodes of an order among which crowds are looked for; orders at most.
CROWD, CROWD_CHUNK, CROWD_ORDERS = 16, 256, 4
#: Neighbours compared at once; rows of a block; sites that the audit compares with all; rounds at most before and after one.
COMPANY, BLOCK, AUDITED, ROUNDS = 96, 512, 512, 10
#: Angles of single precision are as exact as this; those of double precision as that.
NEAR, EXACT = 2e-3, 1e-7
BITS = 48


def units(vectors: pa.Array) -> list[np.ndarray]:
    """Vectors of length one, of any magnitude."""
    out = []
    for v in vectors:
        x = np.asarray(v.as_py(), np.float64)
        x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
        out.append(x / np.sqrt(x @ x))
    return out


def stacked(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    """Vectors of one length, as bytes, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def codes_of(x: np.ndarray) -> np.ndarray:
    """For each order the signs of random projections of a vector, as one number."""
    return (planes(len(x)) @ x > 0).reshape(ORDERS + CROWD_ORDERS, BITS) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])


@lru_cache(8)
def planes(size: int) -> np.ndarray:
    return np.random.default_rng(size).standard_normal(((ORDERS + CROWD_ORDERS) * BITS, size))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def runs(keys: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of equal neighbouring keys, of at most so many rows and of about one size."""
    ends = np.flatnonzero(np.r_[keys[1:] != keys[:-1], True]) + 1 if len(keys) else []
    start = 0
    for end in map(int, ends):
        n = -(-(end - start) // most)
        cuts = [start + (end - start) * k // n for k in range(n + 1)]
        yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]))
        start = end


def in_order(sites: DataFrame, seed: int, each: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, most: int) -> DataFrame:
    """each(rows, vectors) of neighbouring sites of one part, in an order by the signs of random projections."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [each(pa.Table.from_batches([batch.slice(s.start, s.stop - s.start)]), stacked(batch["x"].slice(s.start, s.stop - s.start))) for s in runs(batch["part"].to_numpy(zero_copy_only=False), most)]
            if found:
                yield from pa.concat_tables(found).to_batches()

    coded = sites.select("site", "part", "x", "radius", F.col("codes")[seed].alias("code"))
    return coded.repartitionByRange("part", "code", "site").sortWithinPartitions("part", "code", "site").mapInArrow(compare, schema)


def crowds(half: float) -> Callable[[pa.Table, np.ndarray], pa.Table]:
    """site, pivot, far (no member is further from the pivot) of those that join a pivot; the pivot with most goes first."""

    def each(rows: pa.Table, x: np.ndarray) -> pa.Table:
        site, radius = rows["site"].to_numpy(), rows["radius"].to_numpy()
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        far = angles(x, x) + NEAR + radius
        np.fill_diagonal(far, radius)
        joins = far <= half
        weight = np.where(radius > 0, CROWD, 1)
        free = np.ones(len(site), bool)
        while True:
            count = joins[:, free] @ weight[free] * free
            if not len(count) or count.max() < CROWD:
                break
            p = int(np.argmax(count))
            who = np.flatnonzero(joins[p] & free)
            free[who] = False
            free[p] = False
            if len(who) > 1:
                out.append((site[who], int(site[p]), far[p, who]))
        cat = lambda k, kind: np.concatenate([o[k] for o in out]) if out else np.zeros(0, kind)
        return pa.table({"site": cat(0, np.int64), "pivot": np.concatenate([np.full(len(o[0]), o[1]) for o in out]) if out else np.zeros(0, np.int64), "far": cat(2, np.float64)})

    return each


EDGES = "u long, v long, d double, near boolean"


def edges(site: np.ndarray, radius: np.ndarray, x: np.ndarray, reach: float, k: int, bar: np.ndarray | None = None, new: np.ndarray | None = None) -> list[np.ndarray]:
    """u, v, d (angle), near (in range) of what each site gets from a comparison of all with all: what is in range,
    and of the rest its k nearest that lie before its bar."""
    d = angles(x, x).astype(np.float64)
    near = d <= reach + radius[:, None] + radius + NEAR
    want = near.copy()
    n = len(site)
    rest = np.where(near, np.inf, d)
    np.fill_diagonal(rest, np.inf)
    cut = np.partition(rest, k - 1, axis=1)[:, k - 1] if n > k else np.full(n, np.inf)
    want |= (rest <= cut[:, None]) & (rest < (np.inf if bar is None else bar[:, None]))
    if new is not None:
        want &= new[:, None] | new
    np.fill_diagonal(want, False)
    i, j = np.nonzero(want)
    return [site[i], site[j], d[i, j], near[i, j]]


def as_edges(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One batch of the edges of several comparisons, each u, v once."""
    if found:
        u, v, d, near = (np.concatenate(c) for c in zip(*found))
        o = np.lexsort((v, u))
        o = o[np.r_[True, (np.diff(u[o]) != 0) | (np.diff(v[o]) != 0)]] if len(o) else o
        yield pa.RecordBatch.from_arrays([pa.array(c[o]) for c in (u, v, d, near)], ["u", "v", "d", "near"])


def kept(candidates: DataFrame, k: int) -> DataFrame:
    """The lists (u, v, d, near, new) from candidates: all in range, and the k nearest of the others."""
    once = candidates.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.max("near").alias("near"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("u", "near").orderBy("d", "v"))
    return once.withColumn("place", place).where((F.col("place") <= k) | F.col("near")).drop("place")


def refined(lists: DataFrame, sites: DataFrame, reach: float, k: int) -> DataFrame:
    """Candidates (EDGES) from a join of all neighbours of each site with each other."""
    both = lists.select(F.col("u").alias("hub"), F.col("v").alias("site"), "new").union(lists.select("v", "u", "new"))
    company = saved(both.union(sites.select("site", "site", F.lit(False))).repartition("hub").groupBy("hub", "site").agg(F.max("new").alias("new")), "company")
    hubs = company.groupBy("hub").agg(F.count("*").alias("n"), F.max("new").alias("any")).where("any")
    # A site that very many have as neighbour deals them out, otherwise in each round.
    part = F.pmod(F.xxhash64("site", F.lit(k)), F.ceil(F.col("n") / COMPANY)).cast("int").alias("deal")
    bars = lists.where("not near").groupBy("u").agg(F.count("*").alias("m"), F.max("d").alias("d")).where(f"m >= {k}").select(F.col("u").alias("site"), F.col("d").alias("bar"))
    vectors = saved(sites.select("site", "x", "radius").join(bars, "site", "left"), "bars")
    rows = company.join(hubs, "hub").select("hub", "site", "new", part).join(vectors, "site").select("hub", "deal", "site", "new", "x", "radius", F.coalesce("bar", F.lit(9.0)).alias("bar"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub = batch["hub"].to_numpy() * 65536 + batch["deal"].to_numpy()
            site, radius, bar, new = (batch[c].to_numpy(zero_copy_only=False) for c in ("site", "radius", "bar", "new"))
            found = []
            for s in runs(hub, 2 * COMPANY):
                if s.stop - s.start > 1 and new[s].any():
                    found.append(edges(site[s], radius[s], stacked(batch["x"].slice(s.start, s.stop - s.start)), reach, k, bar[s], new[s]))
            yield from as_edges(found)

    return rows.repartition("hub", "deal").sortWithinPartitions("hub", "deal").mapInArrow(join, EDGES)


def missed(lists: DataFrame, sites: DataFrame, reach: float) -> tuple[DataFrame, int]:
    """What AUDITED sites have in range among all sites but not in their lists, and how many pairs they have in range."""
    # A bounded number of vectors, which every task gets.
    some = sites.orderBy(F.xxhash64("site", F.lit(5))).limit(AUDITED).select("site", "part", "x", "radius").toArrow()
    parts: dict[str, np.ndarray] = {p: np.flatnonzero(np.array(some["part"].to_pylist()) == p) for p in set(some["part"].to_pylist())}
    ids, radii, raw = some["site"].to_numpy(), some["radius"].to_numpy(), some["x"].to_pylist()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            of = np.array(batch["part"].to_pylist())
            for part, who in parts.items():
                at = np.flatnonzero(of == part)
                if len(at):
                    d = angles(stacked(pa.array([raw[i] for i in who])), stacked(batch["x"].take(pa.array(at)))).astype(np.float64)
                    near = d <= reach + radii[who][:, None] + batch["radius"].to_numpy()[at] + NEAR
                    i, j = np.nonzero(near & (ids[who][:, None] != batch["site"].to_numpy()[at]))
                    found.append([ids[who][i], batch["site"].to_numpy()[at][j], d[i, j], np.ones(len(i), bool)])
            yield from as_edges(found)

    there = saved(sites.select("site", "part", "x", "radius").mapInArrow(compare, EDGES), "audit")
    have = lists.select("u", "v").union(lists.select("v", "u")).distinct()
    return saved(there.join(have, ["u", "v"], "left_anti"), "missed"), there.count()


@dataclass
class Linked:
    """rows: rid, vec_id, n_links, component_id, kept of every vector. recall: of the pairs in range of the audited sites, the share
    that lists had when the rounds first ended; audited: how many pairs these are."""

    rows: DataFrame
    recall: float
    audited: int


def descended(sites: DataFrame, reach: float, places: int) -> tuple[DataFrame, float, int]:
    """Lists of neighbours that a last audit found complete, and recall and number of pairs of the first one."""

    def start(rows: pa.Table, x: np.ndarray) -> pa.Table:
        found = edges(rows["site"].to_numpy(), rows["radius"].to_numpy(), x, reach, places)
        return pa.table(found, names=["u", "v", "d", "near"])

    orders = [in_order(sites, seed, start, EDGES, CHUNK) for seed in range(ORDERS)]
    all_of = orders[0]
    for o in orders[1:]:
        all_of = all_of.union(o)
    lists = saved(kept(all_of.withColumn("new", F.lit(True)), places), "lists")
    n, first = sites.count(), None
    while True:
        for _ in range(ROUNDS):
            old = lists.withColumn("new", F.lit(False))
            lists = saved(kept(old.union(refined(lists, sites, reach, places).withColumn("new", F.lit(True))), places), "lists")
            changed, links = lists.where("new").agg(F.count("*"), F.count_if("near")).first()
            if not links and changed <= 0.1 * n * places:
                break
        more, there = missed(lists, sites, reach)
        lost = more.count()
        first = first or ((there - lost) / there if there else 1.0, there)
        if not lost:
            return lists, *first
        places *= 2
        back = more.select("u", "v", "d", "near").union(more.select("v", "u", "d", "near")).distinct().withColumn("new", F.lit(True))
        lists = saved(kept(lists.union(back), places), "lists")


def crowded(nodes: DataFrame, half: float) -> tuple[DataFrame, DataFrame]:
    """The sites (site, part, x, radius), and node and site of every node."""
    sites = nodes.select(F.col("node").alias("site"), "part", "x", "codes", F.lit(0.0).alias("radius"))
    n = nodes.count()
    of = nodes.select("node", F.col("node").alias("site"))
    for seed in range(CROWD_ORDERS):
        moves = saved(in_order(sites, ORDERS + seed, crowds(half), "site long, pivot long, far double", CROWD_CHUNK), "moves")
        moved = moves.count()
        if not moved:
            break
        radius = moves.groupBy(F.col("pivot").alias("site")).agg(F.max("far").alias("far"))
        gone = moves.where("site <> pivot").select("site")
        of = saved(of.join(moves.select("site", "pivot"), "site", "left").select("node", F.coalesce("pivot", "site").alias("site")), "site-of")
        sites = sites.join(gone, "site", "left_anti").join(radius, "site", "left").select("site", "part", "x", "codes", F.greatest("radius", F.coalesce("far", F.lit(0.0))).alias("radius"))
        sites = saved(sites, "sites")
        if 100 * moved < n:  # lists take what little is left of crowds
            break
    return sites, of


def decided(rows: DataFrame, cosine: float) -> DataFrame:
    """u, b, links (weight of those of b that u is linked with; null: to be compared one by one) from u, x_u, b, x_b, r_b, w_b."""
    reach = math.acos(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = np.array([np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64) for a, b in zip(batch["x_u"].to_pylist(), batch["x_b"].to_pylist())])
            d, r, w = np.arccos(np.clip(dots, -1, 1)), batch["r_b"].to_numpy(), batch["w_b"].to_numpy()
            links = np.where(r == 0, np.where(dots >= cosine, w, 0), np.where(d + r <= reach - EXACT, w, np.where(d - r > reach + EXACT, 0, -1)))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["b"], pa.array(links.astype(np.int64), mask=links < 0)], ["u", "b", "links"])

    return rows.select("u", "x_u", "b", "x_b", "r_b", "w_b").mapInArrow(run, "u long, b long, links long")


def counted(open_pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """u, b, links of pairs of a node and a site, by comparing blocks of nodes with blocks of the site's members."""
    asks = saved(open_pairs.join(members.select(F.col("node").alias("u"), F.col("y").alias("x")), "u").select("u", "b", "x"), "asks")
    blocks = lambda df, key, name: df.groupBy(F.col(key).alias("b")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counts = saved(blocks(asks, "b", "asking").join(blocks(members, "site", "asked"), "b"), "blocks")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(counts, "b").select("b", "u", "x", deal("u", "asking").alias("i"), all_of("asked").alias("j"))
    right = members.select(F.col("site").alias("b"), "node", F.col("y").alias("x"), "weight").join(counts, "b").select("b", "x", "weight", deal("node", "asked").alias("j"), all_of("asking").alias("i"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        links = (stacked(a["x"], np.float64) @ stacked(b["x"], np.float64).T >= cosine) @ b["weight"].to_numpy() if b.num_rows and a.num_rows else np.zeros(a.num_rows, np.int64)
        return pa.table({"u": a["u"], "b": a["b"], "links": pa.array(links, pa.int64())})

    found = left.groupBy("b", "i", "j").cogroup(right.groupBy("b", "i", "j")).applyInArrow(compare, "u long, b long, links long")
    return found.groupBy("u", "b").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, places: int = PLACES) -> Linked:
    """Links between vectors of one label whose cosine is at least so much, and their components."""
    reach = math.acos(cosine)
    with tidied(vectors.sparkSession) as keep:
        e = F.col("embedding").cast("array<double>")
        sound: Column = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
        usable = F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))
        part = F.concat_ws(":", F.size(e).cast("string"), F.col("label").cast("string"))
        rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, part).alias("part"), F.when(usable, e).alias("e"))
        alike = F.transform("e", lambda v: v + F.lit(0.0))  # zero has no sign
        rows = saved(rows.withColumns({"h1": F.when(F.col("part").isNotNull(), F.xxhash64("part", alike)), "h2": F.when(F.col("part").isNotNull(), F.xxhash64(F.lit(7), alike, "part"))}), "rows")
        some = rows.where("part is not null")
        groups = saved(some.groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.count("*").alias("weight")), "groups")

        def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = units(batch["e"])
                singles, doubles = (pa.array([x.astype(kind).tobytes() for x in u], pa.binary()) for kind in (np.float32, np.float64))
                codes = pa.array([codes_of(x) for x in u], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["node"], batch["part"], batch["weight"], singles, doubles, codes], ["node", "part", "weight", "x", "y", "codes"])

        first = some.select(F.col("rid").alias("node"), "part", "e").join(groups.select("node", "weight"), "node")
        nodes = saved(first.select("node", "part", "weight", "e").mapInArrow(scale, "node long, part string, weight long, x binary, y binary, codes array<long>"), "nodes")
        sites, of = crowded(nodes, reach / 2 - EXACT)
        members = saved(nodes.select("node", "weight", "y").join(of, "node"), "members")
        weights = saved(members.groupBy("site").agg(F.sum("weight").alias("w"), F.count("*").alias("m")), "weights")
        lists, recall, audited = descended(sites, reach, places)
        ends = lists.where("near").select(F.col("u").alias("a"), F.col("v").alias("b"), "d")
        ends = ends.union(ends.select("b", "a", "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
        side = lambda x: sites.join(weights, "site").select(F.col("site").alias(x), F.col("radius").alias(f"r_{x}"), F.col("w").alias(f"w_{x}"))
        ends = saved(ends.join(side("a"), "a").join(side("b"), "b"), "ends")
        whole = (F.col("d") + F.col("r_a") + F.col("r_b") <= reach - NEAR) & (F.greatest("r_a", "r_b") > 0)
        pivots = nodes.select(F.col("node").alias("b"), F.col("y").alias("x_b"))
        asked = ends.where(~whole).select(F.col("a").alias("site"), "b", "r_b", "w_b").join(members.select("site", F.col("node").alias("u"), F.col("y").alias("x_u")), "site").join(pivots, "b")
        looked = saved(decided(asked, cosine), "decided")
        undecided = looked.where("links is null").select("u", "b")
        exact = looked.where("links > 0")
        if not undecided.isEmpty():
            exact = saved(exact.union(counted(undecided, members, cosine).where("links > 0").select("u", "b", "links")), "counted")
        between = ends.where(whole).select("a", "b").union(exact.join(of.select(F.col("node").alias("u"), F.col("site").alias("a")), "u").select("a", "b"))
        roots = components(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        of_site = weights.join(ends.where(whole).groupBy(F.col("a").alias("site")).agg(F.sum("w_b").alias("sure")), "site", "left").join(roots.withColumnRenamed("node", "site"), "site", "left")
        of_site = saved(of_site.select("site", (F.col("w") - 1 + F.coalesce("sure", F.lit(0))).alias("links"), F.coalesce("root", "site").alias("root")), "of-site")
        own = exact.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("own"))
        of_node = of.join(of_site, "site").join(own, "node", "left").select("node", (F.col("links") + F.coalesce("own", F.lit(0))).alias("n_links"), "root")
        of_node = saved(of_node.join(groups, "node").select("h1", "h2", "n_links", "root"), "of-node")
        linked = saved(rows.select("rid", "vec_id", "h1", "h2").join(of_node, ["h1", "h2"], "left").drop("h1", "h2"), "linked")
        least = linked.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
        out = linked.join(least, "root", "left").select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
        kept_row = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
        return Linked(keep(saved(out.withColumn("kept", kept_row), "near-vectors")), recall, audited)

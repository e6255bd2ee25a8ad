"""Quality rules with an isolation forest on rule statistics.

Trees split random statistics (rules.RATIOS) at random values; documents whose statistics part early from the others
have short paths and high anomaly scores. A split between the least and the greatest value of a node's rows is the same whatever a statistic's
scale is, so they need none. Each tree has PSI rows of its own, drawn by its own hash from all documents that pass the base
rules, and how far each statistic reaches over all of them, so that one which is the same in a tree's rows and greater elsewhere is split there
too; every document is scored. The threshold comes from all labelled documents: a histogram of scores by label, whose
size is fixed, gives the one that removes the most of the bad ones while it keeps all but a stated share of the good
ones.

Defined results: null and empty texts fail the base rules; without labels of both kinds nothing is removed besides
the base rules; rows repeated are judged alike; very long texts are statistics like others; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm import rules
from lexivec.llm.shared import saved, tidied

#: Rows a tree; trees.
PSI, TREES = 64, 256
BINS = 2000


def usual_path(n: float) -> float:
    """Mean path length in a search tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays [tree, node]; a leaf leads to itself. depth holds a leaf's path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    psi: int

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 7) -> Forest:
        """A forest of rows that are at hand, each tree with psi of them."""
        rng = np.random.default_rng(seed)
        return cls.grow([x[rng.choice(len(x), min(psi, len(x)), replace=False)] for _ in range(trees)], seed=seed)

    @classmethod
    def grow(cls, samples: list[np.ndarray], reach: np.ndarray | None = None, seed: int = 7) -> Forest:
        """A tree of each sample. reach: the greatest values of all rows. A statistic that is one value in a tree's rows
        and greater elsewhere is open once on each path, between that value and its reach."""
        rng = np.random.default_rng(seed)
        trees, psi, width = len(samples), max(map(len, samples)), samples[0].shape[1]
        most = int(np.ceil(np.log2(max(psi, 2))))
        size = 2 ** (most + 1)
        feature, left, right = (np.zeros((trees, size), np.int32) for _ in range(3))
        split, depth = np.zeros((trees, size)), np.zeros((trees, size))
        for t, drawn in enumerate(samples):
            beyond = np.zeros(width, bool) if reach is None else (drawn.max(0) == drawn.min(0)) & (reach > drawn.max(0))
            todo, free = [(0, drawn, 0, beyond)], 1
            while todo:
                node, rows, d, beyond = todo.pop()
                low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(width),) * 2
                open_features = np.flatnonzero((high > low) | beyond)
                if d >= most or len(rows) <= 1 or not len(open_features):
                    left[t, node] = right[t, node] = node
                    depth[t, node] = d + usual_path(len(rows))
                    continue
                f = rng.choice(open_features)
                cut = reach[f] - rng.uniform(0, reach[f] - high[f]) if beyond[f] else rng.uniform(low[f], high[f])
                beyond = beyond & (np.arange(width) != f)
                feature[t, node], split[t, node], left[t, node], right[t, node] = f, cut, free, free + 1
                below = rows[:, f] < cut
                todo += [(free, rows[below], d + 1, beyond), (free + 1, rows[~below], d + 1, beyond)]
                free += 2
        return cls(feature, split, left, right, depth, psi)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores (0 to 1, higher: odder)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(self.feature.shape[1]))):
                node = np.where(x[rows, self.feature[t, node]] < self.split[t, node], self.left[t, node], self.right[t, node])
            total += self.depth[t, node]
        return 2.0 ** (-total / len(self.feature) / max(usual_path(self.psi), 1e-9))


def failed_base() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def threshold(counts: list[tuple[int, int, int]], lost: float) -> float:
    """From (bin, label, rows): of the bin edges above which at most the share lost of good rows lies, that which
    parts the labels best; the middle one of equals."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, label, n in counts:
        (good if label else bad)[b] += n
    if not good.sum() or not bad.sum():
        return 2.0
    above_good = good[::-1].cumsum()[::-1] / good.sum()
    above_bad = bad[::-1].cumsum()[::-1] / bad.sum()
    fit = np.flatnonzero(above_good <= lost)
    if not len(fit):
        return 2.0
    gain = above_bad[fit] - above_good[fit]
    best = fit[gain >= gain.max() - 1e-12]
    return float(best[len(best) // 2]) / BINS


def draw(rows: DataFrame, n: int, trees: int, psi: int) -> list[np.ndarray]:
    """For each tree psi of n rows (rid, ratios), or all if there are fewer: of those that its hash picks (some four times as many as
    it needs) the ones with the smallest hashes."""
    few = F.lit(int(min(1.0, 4 * psi / n) * (1 << 30)))
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("rid", t), F.lit(1 << 30)) < few)
    drawn = rows.select("rid", "ratios", F.explode(picked).alias("tree"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("rid", "tree"), "rid"))
    found = drawn.withColumn("place", place).where(F.col("place") <= psi).select("tree", "place", "ratios").toArrow().sort_by([("tree", "ascending"), ("place", "ascending")])
    x = rules.matrix(found["ratios"].combine_chunks(), len(rules.RATIOS))
    return [part for part in np.split(x, np.cumsum(np.bincount(found["tree"].to_numpy(), minlength=trees))[:-1]) if len(part)]


def fit(passed: DataFrame, trees: int = TREES, psi: int = PSI) -> Forest | None:
    """A forest of rows (rid, ratios); none of no rows."""
    n, *most = passed.agg(F.count("*"), *[F.max(F.col("ratios")[k]) for k in range(len(rules.RATIOS))]).first()
    return Forest.grow(draw(passed, n, trees, psi), np.array(most)) if n else None


def quality_rules(docs: DataFrame, labels: DataFrame, lost: float = 0.005, trees: int = TREES, psi: int = PSI) -> DataFrame:
    """Statistics, anomaly score and verdict of every document: doc_id, the counts of rules.COUNTS, base_failed,
    anomaly (double), kept. lost: the largest share of documents labelled good that the threshold may remove."""
    with tidied(docs.sparkSession) as keep:
        stats = rules.with_statistics(docs).withColumn("rid", F.monotonically_increasing_id()).withColumn("base_failed", failed_base())
        stats = saved(stats, "rule-statistics")
        forest = fit(stats.where("not base_failed").select("rid", "ratios"), trees, psi)

        def anomaly(ratios: pa.Array) -> pa.Array:
            x = rules.matrix(ratios, len(rules.RATIOS))
            return pa.array(forest.score(x) if forest else np.zeros(len(x)))

        scored = keep(saved(stats.withColumn("anomaly", F.arrow_udf(anomaly, "double")("ratios")).drop("ratios", "rid"), "anomalies"))
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality in (0, 1)")
    counts = scored.where("not base_failed").join(marks, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "quality").count().collect()
    limit = threshold([tuple(r) for r in counts], lost)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(limit)))

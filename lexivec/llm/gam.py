"""Quality classifier: a generalised additive model with pairwise interactions.

Each statistic of a text is cut into bins; cyclic boosting fits, statistic by statistic, shallow trees on the
bins' gradients, and adds them to one lookup table a statistic. Then the pairs of statistics that explain most of
what is left get tables of two dimensions, boosted in the same way. A score is a sum of table entries: all
documents of a batch are scored by vectorised additions.

The model is fitted on at most SAMPLE labelled rows, by the hash of doc_id; rows held out are never among them.
Inputs are statistics of the text alone.

Defined results: null and empty texts are scored as a text with zeros; without labelled rows every score is 0.5;
repeated rows get equal scores, and of labelled rows of one id each counts, within SAMPLE; very long texts are statistics
like others; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm import rules

#: The largest number of labelled rows that a model is fitted on.
SAMPLE = 20_000


def tree_of_line(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A tree with so many leaves on ordered bins: the Newton step of each bin's leaf."""
    cuts = [0, len(gradient)]
    g, w = np.append(0, gradient.cumsum()), np.append(0, weight.cumsum())
    power = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            at = np.arange(a + 1, b)
            if len(at):
                gain = power(a, at) + power(at, b) - power(a, b)
                best = max(best, (gain.max(), int(at[gain.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


def tree_of_table(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree of depth two on a table: a split of rows, then one of columns on either side. Its gain and steps."""
    g, w = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    top_g, top_w, all_g, all_w = g[1:-1], w[1:-1], g[-1], w[-1]
    gain, at = np.zeros(len(top_g)), []
    for sg, sw in ((top_g, top_w), (all_g - top_g, all_w - top_w)):
        each = sg**2 / (sw + 1) + (sg[:, -1:] - sg) ** 2 / (sw[:, -1:] - sw + 1)
        at.append(each.argmax(1))
        gain += each.max(1)
    out = np.zeros_like(gradient)
    if not len(gain):
        return 0.0, out
    r = int(gain.argmax())
    for rows, sg, sw, c in ((slice(0, r + 1), top_g[r], top_w[r], at[0][r]), (slice(r + 1, None), all_g - top_g[r], all_w - top_w[r], at[1][r])):
        out[rows, :c] = sg[c] / (sw[c] + 1)
        out[rows, c:] = (sg[-1] - sg[c]) / (sw[-1] - sw[c] + 1)
    return float(gain[r] - g[-1, -1] ** 2 / (w[-1, -1] + 1)), out


@dataclass
class Gam:
    edges: list[np.ndarray] = field(default_factory=list)
    lines: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    @staticmethod
    def cuts(x: np.ndarray, n: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.arange(1, n) / n)) if len(c) else np.zeros(0) for c in x.T]

    @staticmethod
    def bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, pairs: int = 8, bins: int = 32, coarse: int = 8) -> Gam:
        if not len(y):
            return cls()
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self = cls(cls.cuts(x, bins), [], cls.cuts(x, coarse), [], float(np.log(share / (1 - share))))
        fine, rough = cls.bins(x, self.edges), cls.bins(x, self.coarse)
        self.lines = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.base)

        def gradients() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for line, b in zip(self.lines, fine):
                g, w = gradients()
                step = rate * tree_of_line(np.bincount(b, g, len(line)), np.bincount(b, w, len(line)), 3)
                line += step
                f += step[b]
        shape = lambda i, j: (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)

        def table(i: int, j: int, v: np.ndarray) -> np.ndarray:
            r, c = shape(i, j)
            return np.bincount(rough[i] * c + rough[j], v, r * c).reshape(r, c)

        g, w = gradients()
        found = sorted(((tree_of_table(table(i, j, g), table(i, j, w))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
        self.pairs = [(i, j, np.zeros(shape(i, j))) for gain, i, j in found[:pairs] if gain > 0]
        for _ in range(rounds // 3):
            for i, j, t in self.pairs:
                g, w = gradients()
                step = rate * tree_of_table(table(i, j, g), table(i, j, w))[1]
                t += step
                f += step[rough[i], rough[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        f = np.full(len(x), self.base)
        for line, b in zip(self.lines, self.bins(x, self.edges)):
            f += line[b]
        rough = self.bins(x, self.coarse)
        for i, j, t in self.pairs:
            f += t[rough[i], rough[j]]
        return 1 / (1 + np.exp(-f))


def held_out() -> Column:
    """Whether a document's label is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Gam:
    """A model of the labelled rows that are not held out: at most SAMPLE, by the hash of doc_id. Their ids are few
    enough to be broadcast, so only they are looked at and nothing is shuffled."""
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality in (0, 1) and doc_id is not null").where(~held_out())
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    # An id may have many rows, so what reaches the driver is bounded again.
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), rules.ratios("text").alias("ratios"), "quality")
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "h").limit(SAMPLE).select("ratios", "quality").toArrow()
    x = rules.matrix(found["ratios"].combine_chunks(), len(rules.RATIOS))
    y = found["quality"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return Gam.fit(x[order], y[order])


def score(model: Gam, ratios: Column) -> Column:
    """Scores of statistics."""

    def run(ratios: pa.Array) -> pa.Array:
        return pa.array(model.score(rules.matrix(ratios, len(rules.RATIOS))))

    return F.arrow_udf(run, "double")(ratios)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = rows.select("doc_id", score(fit(rows, labels), rules.ratios("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_ones(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score at least so much, with all their columns."""
    return docs.where(score(fit(docs, labels), rules.ratios("text")) >= least)

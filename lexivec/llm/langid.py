"""Language identification: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes run through two gated recurrent layers, one from either side. A softmax over both layers' states
labels every position; the mean of a document's positions gives its probabilities. The network is trained in numpy by
backpropagation through time, on windows from anywhere in the whole texts of a bounded sample of rows (PER_LANGUAGE
rows a language by the hash of doc_id). A share of the windows is trained with its bytes in random order, labelled as
no language: so texts in languages that were not learned, or in none, get low scores.

Whole texts are labelled, in windows of WINDOW bytes, so that many advance in step and a very long text costs no more a
byte than a short one. Either layer starts MARGIN bytes before a window (at the text's end there is nothing before), and what it says of these is
dropped: by then its state is nearly that of a run over the whole text. README gives the measured difference.

Only the text decides: lang trains the network on rows that aren't held out, and is no input of a prediction.

Defined results: a text that is null or has no letter gets ``und`` and score 0; without rows to learn from, so does
every text. Scores are rounded to six places, which hides that sums depend on what a batch holds besides; repeated rows get equal results; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.shared import fresh, saved

#: Rows of the training sample, a language.
PER_LANGUAGE = 400
#: Hidden units of each direction; bytes of a window, and before it from which either layer starts.
HIDDEN, WINDOW, MARGIN = 16, 512, 32
#: Training: steps, windows a step, bytes of a window.
STEPS, BATCH, WIDTH = 400, 192, 96
#: The share of a step's windows that are scrambled.
SCRAMBLED = 0.25
#: Windows that advance in step, and floats of their labels at most.
STEP, FLOATS = 1024, 16_000_000
#: Stands for a byte where a text has none.
PAD = 256
LETTER = regex.compile(r"\p{L}").search
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class BiGru:
    """Weights of both directions, stacked: inputs by byte [2, 256, 3H], states [2, H, 3H] (update, reset, candidate),
    candidate's state bias [2, 1, H], output [2H, K] and its bias. K: langs, then no language."""

    langs: list[str]
    w: np.ndarray
    u: np.ndarray
    c: np.ndarray
    o: np.ndarray
    b: np.ndarray

    @classmethod
    def new(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> BiGru:
        r, k = np.random.default_rng(seed), len(langs) + 1
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        return cls(langs, f(2, 256, 3 * hidden, scale=0.3), f(2, hidden, 3 * hidden, scale=hidden**-0.5), np.zeros((2, 1, hidden), np.float32), f(2 * hidden, k, scale=0.3), np.zeros(k, np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.w, self.u, self.c, self.o, self.b]

    def label(self, x: np.ndarray, margin: int) -> np.ndarray:
        """Sums [windows, K] of the labels' probabilities over the bytes of windows. x [margin + time + margin, windows]:
        their bytes, and those around them from which either layer starts; PAD where the text has none.

        A window's state is a row, so that a byte's inputs are copied as rows of a table, and each gate of both layers is
        one block of memory. Gates are tanh(x / 2) / 2 + 1 / 2, halved in the weights. PAD's reset gate is 0, and so is its
        candidate: a layer that hasn't met its text stays at 0."""
        n, k, out = x.shape[1], self.u.shape[1], len(self.b)
        wide = len(x) - 2 * margin
        u, w = (np.ascontiguousarray(v.reshape(2, -1, 3, k).transpose(2, 0, 1, 3)) for v in (self.u, self.w))
        u *= 0.5
        w[:2] *= 0.5
        pad = np.zeros((3, 2, 1, k), np.float32)
        pad[1] = -100
        update, reset, candidate = np.concatenate([w, pad], 2).reshape(3, -1, k)
        c = np.ascontiguousarray(np.broadcast_to(self.c * np.float32(0.5), (2, n, k)))
        o = np.ascontiguousarray(self.o.reshape(2, k, out))
        h, s, g = np.zeros((2, n, k), np.float32), np.empty((3, 2, n, k), np.float32), np.empty((2, 2, n, k), np.float32)
        (z, r, m), zr, rows = s, s[:2], g.reshape(2, 2 * n, k)
        logits, at = np.empty((wide, 2, n, out), np.float32), np.empty((2, n), np.intp)
        for t in range(margin + wide):
            at[0] = x[t]
            at[1] = x[-1 - t]
            at[1] += PAD + 1
            np.matmul(h, u, out=s)
            update.take(at.ravel(), 0, out=rows[0], mode="clip")
            reset.take(at.ravel(), 0, out=rows[1], mode="clip")
            zr += g
            np.tanh(zr, out=zr)
            m += c
            r *= m
            m += r
            candidate.take(at.ravel(), 0, out=rows[0], mode="clip")
            m += g[0]
            np.tanh(m, out=m)
            z *= 0.5
            z += 0.5
            h -= m
            h *= z
            h += m
            if t >= margin:
                np.matmul(h, o, out=logits[t - margin])
        total = np.zeros((out, n))
        for i in range(0, wide, 16):  # few enough positions for the processor's cache
            j = min(i + 16, wide)
            ahead, back = logits[i:j, 0], logits[wide - j : wide - i, 1][::-1]
            p = np.empty((out, j - i, n), np.float32)
            for q in range(out):
                np.add(ahead[..., q], back[..., q], out=p[q])
            p += self.b[:, None, None]
            p -= p.max(0)
            np.exp(p, out=p)
            p *= (x[margin + i : margin + j] != PAD) / p.sum(0)
            total += p.sum(1)
        return total.T

    def train_step(self, x: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the real positions of windows x [windows, time] with labels y, and gradients by
        backpropagation through time."""
        n, steps = x.shape
        k = self.u.shape[1]
        xt, on = np.ascontiguousarray(x.T), np.ascontiguousarray(real.T).astype(np.float32)[..., None]
        h = np.zeros((2, n, k), np.float32)
        states, kept = np.empty((steps, 2, n, k), np.float32), []
        for t in range(steps):
            back = steps - 1 - t
            g = np.stack([self.w[0].take(xt[t], 0), self.w[1].take(xt[back], 0)])
            s = h @ self.u
            zr = sigmoid(g[..., : 2 * k] + s[..., : 2 * k])
            z, r = zr[..., :k], zr[..., k:]
            m = s[..., 2 * k :] + self.c
            cand = np.tanh(g[..., 2 * k :] + r * m)
            kept.append((h, z, r, m, cand))
            h = cand + z * (h - cand)
            h[1] *= on[back]
            states[t, 0], states[back, 1] = h[0], h[1]
        both = np.concatenate([states[:, 0], states[:, 1]], -1)
        logits = both @ self.o + self.b
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        count = max(int(real.sum()), 1)
        loss = -float((np.log(p[:, np.arange(n), y] + 1e-9) * on[..., 0]).sum()) / count
        d = p
        d[:, np.arange(n), y] -= 1
        d = (d * on / count).astype(np.float32)
        go = np.einsum("tnh,tnk->hk", both, d, optimize=True)
        gb = d.sum((0, 1))
        dh_all = d @ self.o.T
        gw, gu, gc = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.c)
        dh = np.zeros_like(kept[0][0])
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            dh = dh + np.stack([dh_all[t][:, :k], dh_all[back][:, k:]])
            dh[1] *= on[back]
            before, z, r, m, cand = kept[t]
            dcand = dh * (1 - z) * (1 - cand * cand)
            dz = dh * (before - cand) * z * (1 - z)
            dr = dcand * m * r * (1 - r)
            dm = dcand * r
            dg = np.concatenate([dz, dr, dcand], -1)
            ds = np.concatenate([dz, dr, dm], -1)
            gu += before.transpose(0, 2, 1) @ ds
            gc += dm.sum(1, keepdims=True)
            for side, at in ((0, t), (1, back)):
                order = np.argsort(xt[at], kind="stable")
                b = xt[at][order]
                starts = np.flatnonzero(np.diff(b.astype(np.int16), prepend=-1))
                gw[side, b[starts]] += np.add.reduceat(dg[side][order], starts, axis=0)
            dh = dh * z + ds @ self.u.transpose(0, 2, 1)
        return loss, [gw, gu, gc, go, gb]


def gathered(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows [n, time] of bytes between begin and stop, and which positions lie within."""
    at = begin[:, None] + np.arange(int((stop - begin).max(initial=0)))
    real = at < stop[:, None]
    return data[np.minimum(at, len(data) - 1)], real


def cut(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts that lie one behind another: their texts, and where they begin and stop."""
    n = -(-lengths // width)
    owner = np.repeat(np.arange(len(lengths)), n)
    first = (np.cumsum(lengths) - lengths)[owner]
    begin = first + (np.arange(len(owner)) - (np.cumsum(n) - n)[owner]) * width
    return owner, begin, np.minimum(begin + width, first + lengths[owner])


def train(texts: list[str], langs: list[str], steps: int = STEPS, rate: float = 0.02, batch: int = BATCH, seed: int = 3, width: int = WIDTH) -> BiGru | None:
    """A network of labelled texts, by Adam with a falling rate."""
    names = sorted(set(langs))
    if not names:
        return None
    net = BiGru.new(names)
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    owner, begin, stop = cut(np.array([len(r) for r in raws], np.int64), width)
    if not len(owner):
        return net
    y = np.array([names.index(v) for v in langs])[owner]
    rng = np.random.default_rng(seed)
    m, v = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(steps):
        pick = rng.integers(0, len(owner), batch)
        x, real = gathered(data, begin[pick], stop[pick])
        label = y[pick]
        for i in range(int(SCRAMBLED * batch)):
            x[i, real[i]] = rng.permutation(x[i, real[i]])
            label[i] = len(names)
        _, grads = net.train_step(x, real, label)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * (1 - step / steps)
        for w, g, a, q in zip(net.weights(), grads, m, v):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            q += 0.01 * (g * g - q)
            w -= lr * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(q / (1 - 0.99 ** (step + 1))) + 1e-6)
    return net


def predict(net: BiGru | None, texts: list[str | None], width: int = WINDOW, margin: int = MARGIN) -> list[tuple[str, float]]:
    """Label and mean probability of whole texts."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    known = [k for k, t in enumerate(texts) if t and LETTER(t)]
    if not known:
        return out
    raws = [texts[k].encode("utf-8", "surrogatepass") for k in known]
    lengths = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    owner, begin, stop = cut(lengths, width)
    last = np.cumsum(lengths)[owner]
    start, end = np.maximum(begin - margin, last - lengths[owner]), np.minimum(stop + margin, last)
    order = np.argsort(end - start, kind="stable")
    total = np.zeros((len(known), len(net.b)))
    size = max(1, min(STEP, FLOATS // (2 * len(net.b) * int((end - start).max()))))
    for o in np.array_split(order, -(-len(order) // size)):
        around = int(max((begin - start)[o].max(), (end - stop)[o].max()))
        at = begin[o] - around + np.arange(int((stop - begin)[o].max()) + 2 * around)[:, None]
        x = data.take(at, mode="clip").astype(np.int16)
        x[(at < start[o]) | (at >= end[o])] = PAD
        np.add.at(total, owner[o], net.label(x, around))
    p = (total / total.sum(1, keepdims=True))[:, : len(net.langs)]
    for k, best, score in zip(known, p.argmax(1).tolist(), p.max(1).tolist()):
        out[k] = (net.langs[best], round(min(1.0, score), 6))
    return out


def held_out() -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> BiGru | None:
    """A network of the rows that are not held out: of each language so many rows, whose whole texts the driver holds."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null").where(~held_out())
    short = rows.select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("h"), "text").where(F.col("text").rlike(r"\p{L}"))
    # Of a language with many rows only those with small hashes, some four times as many as are picked, go on. A row
    # for each language is few enough for Spark to broadcast by its size.
    share = saved(rows.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count("*")).alias("share")), "shares")
    small = F.pmod(F.xxhash64("h", F.lit(2)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    short = short.join(share, "lang").where((F.col("share") >= 1) | small)
    pick = short.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("k") <= per_language)
    found = sorted(pick.select("lang", "doc_id", "text").collect(), key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, r.text))
    return train([r.text for r in found], [r.lang for r in found])


#: Bytes of text that are labelled together.
BLOCK = 2_000_000


def predicted(net: BiGru | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Labels and scores of an Arrow column, by blocks of bounded size."""
    found: list[tuple[str, float]] = []
    held, size = [], 0
    for t in texts:
        held.append(text := t.as_py())
        if (size := size + len(text or "")) >= BLOCK:
            found += predict(net, held)
            held, size = [], 0
    found += predict(net, held)
    return [x for x, _ in found], [x for _, x in found]


def identify(docs: DataFrame, net: BiGru | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    return with_language(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), net, "found").select("doc_id", "found.lang_pred", "found.score")


def with_language(docs: DataFrame, net: BiGru | None, name: str = "language") -> DataFrame:
    """The table with a column struct<lang_pred, score>."""

    def run(texts: pa.Array) -> pa.Array:
        names, scores = predicted(net, texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(name, F.arrow_udf(run, "lang_pred string, score double")(F.col("text").cast("string")))


#: The least mean probability that is taken for a language is the one that this share of its correctly labelled rows
#: stays below; LEAST where a language has no such row.
LOST, LEAST = 0.005, 0.3


def with_known_language(docs: DataFrame, least: float = LEAST, lost: float = LOST) -> DataFrame:
    """The documents whose language is recognised, with all their columns: the score is no lower than all but the share
    lost of the rows of that language, over all rows whose lang says the same."""
    name = fresh("_language", docs.columns)
    marked = saved(with_language(docs, fit(docs), name), "languages")
    lang, score = F.col(name).getField("lang_pred"), F.col(name).getField("score")
    right = marked.where(F.col("lang").cast("string") == lang).where(lang != UNKNOWN)
    # A row for each language of the network, which the driver holds.
    limits = right.groupBy(lang.alias("of")).agg(F.percentile_approx(score, lost, 100_000).alias("limit")).collect()
    limit = F.coalesce(*[F.when(lang == r.of, F.lit(max(r.limit, least))) for r in limits], F.lit(least))
    return marked.where((lang != UNKNOWN) & (score >= limit)).select(*docs.columns)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

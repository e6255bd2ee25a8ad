"""Operators for training data: against brute force, libraries, exact round trips and held-out labels; and their edge
cases: nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexivec.llm import bpe, gam, iforest, langid, lm_score, minhash, packing, queries, rules, shared, substring, vptree, warc
from tests.oracle import check

DATA = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, lang string, score double, ids string, places string, tag string, rank int, node string"
WORDS = [f"w{i}" for i in range(400)]


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def edge_rows():
    long = " ".join(words(1, 30_000))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, long), (6, long), (6, long), (None, "no id at all"), (7, "İß 日本 \x85\x1c <|endoftext|>"), (8, "a " * 60)]
    return [(i, t, "en" if k % 2 else None, 0.5, "x", "y", "z", k, "n") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def get(name):
        if name not in done:
            done[name] = queries.QUERIES[name](spark, DATA).toPandas()
        return done[name]

    return get


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    check(spark, name, queries.QUERIES, queries.ORACLE_SQL)


# ---- BPE


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_is_the_library(docs):
    r = random.Random(2)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", " ", "　", "a", "b", "the", "é", "ß", "日本", "🙂", "'s", "'ll", "12", "٣", "!!", "<|endoftext|>", "\x1c", "\x85", "İ", "ing", "\r\n", "é"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(3000)] + ["", "a" * 5000, "ab" * 3000 + " ", "\n" * 50] + [d["text"] for d in docs]
    own, lib = bpe.load(bpe.default_path()), library()
    for text, ids in zip(texts, own.encode_batch(texts)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_and_learns_again(docs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5_000)
    monkeypatch.setattr(bpe, "SLICE", 7)
    monkeypatch.setattr(bpe, "BLOCK", 3_000)
    own = bpe.Bpe(bpe.default_path())
    texts = [d["text"] for d in docs[:30]]
    assert [own.encode_batch([t])[0] for t in texts] == bpe.load(bpe.default_path()).encode_batch(texts)
    assert own.words.full or own.chunks.full


def held_bytes(known):
    return sum(len(k) + len(v) for k, v in known.items())


def test_bpe_caches_are_bounded(monkeypatch):
    """A million distinct words in one text without blanks: the caches stay within their bytes, ids are the library's."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2_000_000)
    own = bpe.Bpe(bpe.default_path())
    text = ".".join(f"{k * 2654435761 % (1 << 40):x}" for k in range(1_000_000))
    got = own.encode(text)
    assert held_bytes(own.words) < 2_000_000 and held_bytes(own.chunks) < 2_000_000 and len(own.words) * bpe.Known.ENTRY < 2_000_000
    assert own.decode(got) == text
    short = text[:100_000]
    assert own.encode(short) == library().encode(short, add_special_tokens=False).ids
    assert own.encode("a b " * 30_000) == library().encode("a b " * 30_000, add_special_tokens=False).ids


def test_bpe_long_runs_of_blanks():
    own = bpe.load(bpe.default_path())
    for text in (" " * 1_000_000, "\n" * 300_000 + "x", "\u3000" * 5000, "x" + " " * 5000 + "y"):
        assert own.decode(own.encode(text)) == text


def test_bpe_ill_formed_and_unknown_ids():
    own = bpe.load(bpe.default_path())
    half = own.encode("é日")[:1]
    assert own.decode(half) == library().decode(half, skip_special_tokens=False)
    byte = int(own.byte_ids[0xC3])
    assert own.decode([byte, byte]) == library().decode([byte, byte], skip_special_tokens=False) == "\ufffd\ufffd"
    with pytest.raises((ValueError, IndexError)):
        own.decode([own.size])
    assert own.decode_array(bpe.pa.array([None, []], bpe.pa.list_(bpe.pa.int32()))).to_pylist() == [None, ""]


def test_bpe_speculation_is_verified():
    own = bpe.load(bpe.default_path())
    ws = [w.encode() for w in {x for d in pq.read_table(f"{DATA}/documents.parquet").to_pylist() for x in d["text"].split()}][:4000]
    flat, n = own.propose(ws)
    ends = np.cumsum(n)
    fails = 0
    for w, i, j in zip(ws, ends - n, ends):
        cut = flat[i:j].tolist()
        assert cut == own.longest_match(w)
        good = bool(own.compatible(flat[i : j - 1], flat[i + 1 : j]).all())
        assert good == (cut == own.merge(w)) and own.merge(w) == own.merge_long(w)
        fails += not good
    assert 0 < fails < len(ws)


def test_bpe_query(result, docs):
    lib, got = library(), result("op8_bpe").set_index("doc_id")
    for d in docs:
        ids = lib.encode(d["text"] or "", add_special_tokens=False).ids
        r = got.loc[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_edges(edge, none):
    got = {r.doc_id: r for r in bpe.round_trip(edge).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[None].n_tokens > 0
    assert bpe.round_trip(none).isEmpty()
    assert edge.select(bpe.encode(F.col("text")).alias("i")).select(bpe.decode(F.col("i")).alias("t")).count() == 10


# ---- packing


def whole(rows, capacity, ids):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces, total in [(v, len(ids[k])) for k, v in by_doc.items()] + [(v, None) for v in by_sequence.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == total if total is not None else at <= capacity
    return [sum(n for _, n in v) for v in by_sequence.values()]


def test_packing(result, docs):
    lib = library()
    ids = {d["doc_id"]: np.array([*lib.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4") for d in docs}
    got = result("op4_packing").to_dict("records")
    lengths = whole(got, 1024, ids)
    assert {r["doc_id"] for r in got} == set(ids)
    workers = len({r["sequence_id"] >> 32 for r in got})
    assert sum(n < 1024 for n in lengths) <= workers
    short = [i for i, x in ids.items() if len(x) <= 1024]
    assert sum(r["doc_tokens"] <= 1024 for r in got) < 1.5 * len(short)


def packed(capacity, lengths):
    bins = packing.Bins(capacity, 5)
    ids = {k: np.arange(n, dtype="<u4") for k, n in enumerate(lengths)}
    for k, x in ids.items():
        bins.add(k, x.tobytes())
        assert bins.spare_tokens <= packing.SPARE * capacity and len(bins.waiting) <= packing.WAITING + 1
    closed = bins.next_id
    bins.end()
    rows = [dict(zip(("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"), r)) for r in bins.rows]
    rows = [r | {"ids_crc32": zlib.crc32(r["ids"])} for r in rows]
    return rows, whole(rows, capacity, ids), closed


@pytest.mark.parametrize("capacity", [1, 2, 7, 10, 1000, 1024])
@pytest.mark.parametrize("lengths", [range(1, 50), [1] * 3000, [3000, 1, 5, 1023, 1024, 1025] * 30])
def test_packing_any_capacity(monkeypatch, capacity, lengths):
    monkeypatch.setattr(packing, "WAITING", 3)
    monkeypatch.setattr(packing, "SPARE", 2)
    _, totals, _ = packed(capacity, lengths)
    assert sum(n < capacity for n in totals) <= 1


def test_packing_classes():
    """A sequence holds k whole documents of the class (C / (k + 1), C / k], and then only pieces of cut ones."""
    r = random.Random(8)
    rows, totals, closed = packed(1024, [r.choice([r.randint(1, 40), r.randint(41, 400), r.randint(300, 1023), r.randint(1100, 4000)]) for _ in range(4000)])
    by_sequence = collections.defaultdict(list)
    for x in rows:
        by_sequence[x["sequence_id"]].append(x)
    counts = collections.Counter()
    for s, pieces in by_sequence.items():
        pieces.sort(key=lambda x: x["offset"])
        n = pieces[0]["length"]
        k = packing.class_of(n, 1024)
        if s >= closed or n == 1024:
            continue
        own = pieces[:k]
        assert len(own) == k and all(1024 < (k + 1) * x["length"] <= 1024 * (k + 1) / k for x in own)
        assert all(x["length"] == x["doc_tokens"] or x["doc_tokens"] > 1024 for x in own)
        assert all(x["doc_tokens"] > 1024 for x in pieces[k:])
        counts[k] += 1
    assert {1, 2, 3, 5, 6, 7} <= set(counts)
    short = [x for x in rows if x["doc_tokens"] <= 1024]
    assert len(short) < 1.1 * len({x["doc_id"] for x in short})
    assert [packing.class_of(n, 1024) for n in (1024, 513, 512, 342, 341, 257, 256, 1)] == [1, 1, 2, 2, 3, 3, 4, 1024]


def test_packing_long_runs_of_blanks(spark):
    text = " " * 1_000_000
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = packing.pack(docs).orderBy("doc_id", "start").collect()
    ids = np.frombuffer(b"".join(r.ids for r in got if r.doc_id == 1), "<u4")
    assert bpe.load(bpe.default_path()).decode(ids[:-1].tolist()) == text and ids[-1] == 0


def test_packing_edges(edge, none):
    got = packing.pack(edge).collect()
    assert {r.doc_id for r in got} == {r[0] for r in edge_rows()}
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id == 1] == [(1, 1)]
    assert packing.pack(none).isEmpty()


# ---- language identification


def test_language_gradients():
    net = langid.BiGru.new(["a", "b"], hidden=3)
    data = np.frombuffer(b"hello youabc", np.uint8)
    x, real = langid.gathered(data, np.array([0, 6, 9]), np.array([6, 9, 12]))
    y = np.array([0, 1, 2])
    _, grads = net.train_step(x, real, y)
    r = np.random.default_rng(0)
    for w, g in zip(net.weights(), grads):
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in w.shape)
            if w is net.w:
                at = (at[0], int(r.choice(list(b"helo yuabc"))), at[2])
            keep, e = w[at], 1e-2
            w[at] = keep + e
            up = net.train_step(x, real, y)[0]
            w[at] = keep - e
            down = net.train_step(x, real, y)[0]
            w[at] = keep
            assert abs((up - down) / (2 * e) - g[at]) < 2e-3


def brute_windows(net, before, behind, n):
    """Label probabilities of n bytes: the last ones of those the first layer goes through, the first ones of those the other does."""
    k, layers = net.u.shape[1], []
    for side, raw in ((0, before), (1, behind[::-1])):
        h, states = np.zeros(k), []
        for x in raw:
            g, s = net.w[side, x].astype(float), h @ net.u[side]
            z, r = (1 / (1 + np.exp(-(g[j * k : (j + 1) * k] + s[j * k : (j + 1) * k]))) for j in (0, 1))
            new = np.tanh(g[2 * k :] + r * (s[2 * k :] + net.c[side, 0]))
            h = z * h + (1 - z) * new
            states.append(h)
        layers.append(states[-n:])
    logits = np.hstack([layers[0], layers[1][::-1]]) @ net.o + net.b
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def brute_language(net, text):
    """Mean label probabilities of one unbroken run over a text, byte by byte."""
    raw, k = text.encode(), net.u.shape[1]
    layers = []
    for side, order in ((0, range(len(raw))), (1, range(len(raw) - 1, -1, -1))):
        h, states = np.zeros(k), {}
        for i in order:
            g, s = net.w[side, raw[i]].astype(float), h @ net.u[side]
            z, r = (1 / (1 + np.exp(-(g[j * k : (j + 1) * k] + s[j * k : (j + 1) * k]))) for j in (0, 1))
            new = np.tanh(g[2 * k :] + r * (s[2 * k :] + net.c[side, 0]))
            h = z * h + (1 - z) * new
            states[i] = h
        layers.append(states)
    logits = np.array([np.concatenate([layers[0][i], layers[1][i]]) @ net.o + net.b for i in range(len(raw))])
    p = np.exp(logits - logits.max(1, keepdims=True))
    return (p / p.sum(1, keepdims=True)).mean(0)


@pytest.fixture(scope="module")
def network(docs):
    pick = [d for d in docs if d["lang"] and d["text"] and langid.LETTER(d["text"])][:120]
    return langid.train([d["text"] for d in pick], [d["lang"] for d in pick], steps=120)


def test_language_is_an_unbroken_run(network, docs):
    """Against a run byte by byte: equal where a text is one window, and nearly so where windows start in its midst."""
    texts = [d["text"] for d in docs[:12]] + ["é", "日本 x", "a" * 700]
    want = [brute_language(network, t) for t in texts]
    for (lang, score), p in zip(langid.predict(network, texts, width=10**6), want):
        assert lang == network.langs[p[:-1].argmax()] and abs(score - p[:-1].max()) < 1e-4
    gaps = [abs(score - p[network.langs.index(lang)]) for (lang, score), p in zip(langid.predict(network, texts), want)]
    assert max(gaps) < 0.05 and np.mean(gaps) < 0.01
    for (a, x), (b, y) in zip(langid.predict(network, texts), [langid.predict(network, [t])[0] for t in texts]):
        assert a == b and abs(x - y) < 2e-6


def test_language_of_windows(network):
    """Windows of unequal texts in one batch, each layer from the margin before its window: against runs byte by byte."""
    texts = ["a", "ab cd " * 5, "x" * 40, "y" * 41, "the rest of it, und mehr davon " * 9]
    for text, (lang, score) in zip(texts, langid.predict(network, texts, width=40, margin=7)):
        total = np.zeros(len(network.b))
        for i in range(0, len(text), 40):
            j, first, last = min(i + 40, len(text)), max(i - 7, 0), min(i + 47, len(text))
            total += brute_windows(network, text[first:j].encode(), text[i:last].encode(), j - i).sum(0)
        p = total / len(text)
        assert lang == network.langs[p[:-1].argmax()] and abs(score - p[:-1].max()) < 1e-5


def test_language_takes_no_more_time_than_its_arithmetic(network):
    """A byte's price, next to that of the hyperbolic tangents which a byte needs: some 6 times as much, once 10."""
    texts, y = ["some words of a text that goes on and on. " * 480] * 25, np.random.default_rng(0).normal(size=(2, 1024, 3 * langid.HIDDEN)).astype(np.float32)
    size, out = sum(map(len, texts)), np.empty_like(y)

    def took(run):
        at = time.thread_time()
        run()
        return time.thread_time() - at

    def tangents():
        for _ in range(size // 1024):
            np.tanh(y, out=out)

    own, least = zip(*[(took(lambda: langid.predict(network, texts)), took(tangents)) for _ in range(5)])
    assert min(own) < 8 * min(least)


def test_language_of_extreme_weights(network):
    """Large logits don't overflow."""
    big = langid.BiGru(network.langs, network.w, network.u, network.c, network.o * 1e4, network.b)
    assert 0 <= langid.predict(big, ["some text here"])[0][1] <= 1


def test_language_column_names_clash(spark):
    docs = spark.createDataFrame([(1, "plain words", "en", 5, 6), (2, "1 2 3", "en", 7, 8)], "doc_id long, text string, lang string, `language of a row` int, _language int")
    got = langid.with_known_language(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "plain words", "en", 5, 6)]


def test_language_held_out(result, docs):
    got = result("op2_langid").set_index("doc_id")
    assert len(got) == len(docs)
    assert all(got.held_out[d["doc_id"]] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) for d in docs)
    right = [got.lang_pred[d["doc_id"]] == d["lang"] for d in docs if got.held_out[d["doc_id"]]]
    assert np.mean(right) > 0.97


def test_language_edges(edge, none):
    got = {r.doc_id: r for r in langid.language_id(edge).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0 and got[4].lang_pred == "en"
    assert langid.language_id(none).isEmpty()
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}
    kept = langid.with_known_language(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 8, None}  # 7 is in no language that was learned


def test_unlearned_language_goes(spark):
    """Documents in a language without a label to learn from go, the others stay."""
    docs = spark.read.parquet(f"{DATA[:-5]}0.01/documents.parquet").withColumn("was", F.col("lang")).withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.with_known_language(lettered)
    kept = shared.saved(kept, "kept")
    share = lambda of: kept.where(of).count() / lettered.where(of).count()
    assert share(F.col("was") == "de") < 0.5 and share(F.col("was") != "de") > 0.97


# ---- rules and classifier


def test_rule_counts(result, docs):
    got = result("op5_rules").set_index("doc_id")
    for d in docs:
        t = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k : k + 3])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got.loc[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_rule_verdicts(spark):
    """The threshold is calibrated on some labels and measured on the others; the forest's scores tell both kinds apart."""
    data = DATA[:-5] + "0.1"
    table = spark.read.parquet(f"{data}/labels.parquet").where("quality is not null")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = iforest.quality_rules(spark.read.parquet(f"{data}/documents.parquet"), table.where(~out)).where("not base_failed")
    got = got.join(table.where(out).select("doc_id", "quality"), "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.15
    assert np.mean(good.anomaly.to_numpy()[:, None] < bad.anomaly.to_numpy()) > 0.97


def brute_path(forest, t, row):
    node, d = 0, 0
    while forest.left[t, node] != node:
        node = forest.left[t, node] if row[forest.feature[t, node]] < forest.split[t, node] else forest.right[t, node]
        d += 1
    return node, d


def test_forest_scores_are_mean_paths():
    """Scores against a walk down each tree with the rows counted at its leaf."""
    x = np.random.default_rng(1).normal(0, 1, (40, 3)).round(1)
    samples = [x[k : k + 20] for k in range(10)]
    forest = iforest.Forest.grow(samples, x.max(0))
    want = []
    for row in x:
        depths = []
        for t, sample in enumerate(samples):
            node, d = brute_path(forest, t, row)
            depths.append(d + iforest.usual_path(sum(brute_path(forest, t, r)[0] == node for r in sample)))
        want.append(2 ** (-np.mean(depths) / iforest.usual_path(20)))
    assert np.allclose(forest.score(x), want)


def test_every_tree_draws_from_all_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("rid"), F.array(*[F.col("id").cast("double")] * len(rules.RATIOS)).alias("ratios"))
    samples = iforest.draw(rows, 5000, 40, 32)
    ids = [x[:, 0].tolist() for x in samples]
    assert len(ids) == 40 and all(len(set(x)) == 32 for x in ids) and len({tuple(x) for x in ids}) == 40
    assert 600 < len({v for x in ids for v in x}) and 2200 < np.mean(ids) < 2800
    assert [len(x) for x in iforest.draw(rows.where("rid < 9"), 9, 5, 32)] == [9] * 5


def test_forest_finds_the_odd_one():
    x = np.random.default_rng(0).normal(0, 1, (500, 3))
    x[0] = 9
    s = iforest.Forest.fit(x).score(x)
    assert s.argmax() == 0 and s[0] > 0.6
    assert iforest.Forest.fit(x[:1]).score(x).shape == (500,)
    assert iforest.threshold([(10, 1, 100), (900, 0, 5)], 0.01) > 10 / iforest.BINS and iforest.threshold([(1, 1, 3)], 0.01) == 2.0


def test_forest_splits_what_its_samples_lack(spark):
    """Junk that exceeds a statistic which no tree's rows exceed goes, where labels call its like bad."""
    plain = [(i, " ".join("plain" + chr(97 + int(w[1:]) // 26) + chr(97 + int(w[1:]) % 26) for w in words(i, 80))) for i in range(700)]
    junk = {5, 77, 300, 612}
    docs = spark.createDataFrame([(i, t.replace(" ", " | ") if i in junk else t) for i, t in plain], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 0 if i in junk else 1) for i in [*range(200), 300]], "doc_id long, quality int")
    got = iforest.quality_rules(docs, marks, psi=16).where("not base_failed").collect()
    assert len(got) == 700 and junk <= {r.doc_id for r in got if not r.kept} and sum(not r.kept for r in got) < 15


def test_gam_learns_interactions():
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] + 0.1 * x[:, 2] > 0).astype(float)
    m = gam.Gam.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    f = m.base + sum(t[b] for t, b in zip(m.lines, m.bins(x[:5], m.edges))) + sum(t[m.bins(x[:5], m.coarse)[i], m.bins(x[:5], m.coarse)[j]] for i, j, t in m.pairs)
    assert np.allclose(m.score(x[:5]), 1 / (1 + np.exp(-f)))


def test_gam_trees_are_the_best_ones():
    """Trees on lines and tables against a search over all cuts."""
    r = np.random.default_rng(4)
    power = lambda g, w: g.sum() ** 2 / (w.sum() + 1)
    for _ in range(20):
        g, w = r.normal(0, 1, 6), r.uniform(0.1, 1, 6)
        k = max(range(1, 6), key=lambda k: power(g[:k], w[:k]) + power(g[k:], w[k:]))
        k = k if power(g[:k], w[:k]) + power(g[k:], w[k:]) > power(g, w) + 1e-9 else 6
        want = np.concatenate([np.full(k, g[:k].sum() / (w[:k].sum() + 1)), np.full(6 - k, g[k:].sum() / (w[k:].sum() + 1))])
        assert np.allclose(gam.tree_of_line(g, w, 2), want)
        g, w = r.normal(0, 1, (4, 3)), r.uniform(0.1, 1, (4, 3))
        best = max(((power(g[:a, :b], w[:a, :b]) + power(g[:a, b:], w[:a, b:]) + power(g[a:, :c], w[a:, :c]) + power(g[a:, c:], w[a:, c:]), a, b, c) for a in range(1, 4) for b in range(3) for c in range(3)))
        gain, out = gam.tree_of_table(g, w)
        assert abs(gain - (best[0] - power(g, w))) < 1e-9
        a, b, c = best[1:]
        for rows, cols in ((slice(0, a), slice(0, b)), (slice(0, a), slice(b, 3)), (slice(a, 4), slice(0, c)), (slice(a, 4), slice(c, 3))):
            assert np.allclose(out[rows, cols], g[rows, cols].sum() / (w[rows, cols].sum() + 1) if g[rows, cols].size else 0)


def test_classifier_query_is_the_model_row_by_row(result, docs):
    """op6 against a model fitted on the same rows and summed entry by entry."""
    marks = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DATA}/labels.parquet").to_pylist()}
    cache = shared.WordHashes()
    x = {d["doc_id"]: np.array(rules.statistics(d["text"], cache)[1]) for d in docs}
    learned = [i for i in x if marks.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    rows, y = np.array([x[i] for i in learned]), np.array([float(marks[i]) for i in learned])
    order = np.lexsort((*rows.T, y))
    m = gam.Gam.fit(rows[order], y[order])
    got = result("op6_classifier").set_index("doc_id")
    for i, v in x.items():
        place = lambda edges, k: sum(e < v[k] for e in edges[k])  # noqa: B023, E731
        f = m.base + sum(line[place(m.edges, k)] for k, line in enumerate(m.lines)) + sum(t[place(m.coarse, a), place(m.coarse, b)] for a, b, t in m.pairs)
        assert abs(got.score[i] - 1 / (1 + np.exp(-f))) < 1e-9 and got.predicted[i] == (got.score[i] >= 0.5)


def test_classifier_bounds_rows(spark, monkeypatch):
    """Repeated rows of one labelled id don't bring more rows than the bound."""
    monkeypatch.setattr(gam, "SAMPLE", 20)
    seen = []
    monkeypatch.setattr(gam.Gam, "fit", classmethod(lambda cls, x, y: seen.append(len(y)) or cls()))
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(200)], "doc_id long, text string")
    gam.fit(docs, spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int"))
    assert seen == [20]


def test_classifier_held_out(result):
    marks = pq.read_table(f"{DATA}/labels.parquet").to_pandas().set_index("doc_id").quality
    got = result("op6_classifier").set_index("doc_id").join(marks, how="inner")
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.9


def test_quality_edges(edge, none, labels):
    assert iforest.quality_rules(edge, labels).count() == 10 and iforest.quality_rules(none, labels).isEmpty()
    assert gam.classify(edge, labels).count() == 10 and gam.classify(none, labels).isEmpty()
    assert {r.score for r in gam.classify(edge, labels.limit(0)).collect()} == {0.5}
    assert gam.good_ones(edge, labels).columns == edge.columns
    assert not iforest.quality_rules(edge, labels.limit(0)).where("not base_failed and not kept").count()


# ---- near-duplicates


def shingles(text, n):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent=80):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def clustered(n_groups=12, copies=6):
    r = random.Random(4)
    rows, passage = [], words(99, 60)
    for g in range(n_groups):
        base = words(g, r.choice([3, 6, 12, 40, 200, 900]))
        if g % 3 == 0:
            base = passage + base
        for _ in range(copies):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08]))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((len(rows), " ".join(w).title() if r.random() < 0.3 else " ".join(w)))
    return rows


@pytest.mark.parametrize("crowd", [64, 8, 2])
def test_near_duplicates(spark, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rows = clustered() + [(1000, "same here"), (1001, "SAME here"), (1002, ""), (1003, "")]
    got = minhash.digest(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)).collect()
    want = brute_components(rows, 4)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id], 4)) for r in got)


def test_bands_lose_no_pair():
    """Random pairs at exactly the threshold, of few and of many shingles, have a band in common."""
    rng = np.random.default_rng(7)
    for percent, cases in ((80, ((4, 5), (8, 10), (20, 25), (80, 100), (400, 500))), (50, ((5, 10), (50, 100)))):
        size = minhash.rows_of_band(percent / 100)
        for common, union in cases:
            sketches = []
            for _ in range(1500):
                h = rng.integers(0, 2**63, union, dtype=np.uint64) * np.uint64(2)
                k = (union - common) // 2
                sketches += [minhash.registers(h[: common + k]), minhash.registers(np.concatenate([h[:common], h[common + k :]]))]
            keys = minhash.band_keys(np.array(sketches), size).reshape(1500, 2, -1)
            assert (keys[:, 0] == keys[:, 1]).any(1).all()
    assert minhash.rows_of_band(0.8) == 5 and minhash.rows_of_band(0.5) == 2


def test_sketch_estimates():
    cache = shared.WordHashes()
    a = minhash.shingle_set(" ".join(f"a{i}" for i in range(2000)), 1, cache)
    b = np.union1d(a[:1800], minhash.shingle_set(" ".join(f"b{i}" for i in range(200)), 1, cache))
    sk = [minhash.registers(x)[None] for x in (a, b)]
    j, n = minhash.estimate(*sk, np.array([len(a)]), np.array([len(b)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(j[0] - true) < 5 * np.sqrt(true * (1 - true) / n[0])
    zeros = minhash.registers(a) >> minhash.MANTISSA
    assert zeros.max() < 60 and (minhash.registers(a[:0]) == minhash.EMPTY).all()


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_near_duplicate_edges(edge, none):
    got = minhash.digest(minhash.near_duplicates(edge, 4)).collect()
    assert len(got) == 10
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, None: None, 7: 7, 8: 8}
    assert minhash.digest(minhash.near_duplicates(none, 4)).isEmpty()
    kept = minhash.one_of_each(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 6").isEmpty() and kept.where("doc_id is null").count() == 1
    assert kept.schema == edge.schema and minhash.one_of_each(none).isEmpty()


def test_near_duplicates_without_ids(spark):
    """Rows without doc_id are linked like others; of repeated rows one stays; rows of one id are judged by their texts."""
    a, b, c = words(1, 300), words(2, 300), words(3, 300)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(None, " ".join(a)), (None, near(a)), (9, " ".join(b)), (None, near(b)), (7, " ".join(c)), (7, " ".join(c)), (7, near(b)), (8, "alone"), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.digest(minhash.near_duplicates(docs, 4)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in got) == sorted([("None", "None", 297), ("None", "None", 297), ("9", "7", 297), ("None", "7", 297), ("7", "7", 297), ("7", "7", 297), ("7", "7", 297), ("8", "8", 1), ("None", "None", 0), ("None", "None", 0)])
    kept = collections.Counter((r.doc_id, r.text) for r in minhash.one_of_each(docs, 4).collect())
    assert sum(kept.values()) == 6 and kept[7, " ".join(c)] == 1 and kept[7, near(b)] == 1 and kept[8, "alone"] == 1 and kept[None, ""] == 2


def test_crowds_are_paired_by_exact_prefixes(spark):
    """prefixes() orders shingles by their exact counts over the crowd's sets."""
    r = random.Random(12)
    sets = {k: sorted({r.randrange(60) ** 2 for _ in range(r.randint(1, 40))}) for k in range(50)}
    table = spark.createDataFrame([(k, np.array(v, "<i8").tobytes()) for k, v in sets.items()], "node long, shingles binary")
    n = collections.Counter(t for v in sets.values() for t in v)
    want = set()
    for k, v in sets.items():
        first = sorted(v, key=lambda t: (n[t], t))[: len(v) - -(-80 * len(v) // 100) + 1]
        want |= {(t, k, len(v) - i, len(v)) for i, t in enumerate(first) if n[t] > 1}
    assert {tuple(x) for x in minhash.prefixes(table, 80).select("token", "node", "ahead", "size").collect()} == want


# ---- nearest neighbours


def found_neighbours(vectors, **how):
    got = collections.defaultdict(list)
    for g in vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, **how).orderBy("query_id", "rank").collect():
        assert g.rank == len(got[g.query_id]) + 1
        got[g.query_id].append((g.vec_id, g.score))
    return got


def brute_neighbours(rows, q, own, k=20):
    s = [(-sum(float(a) * float(b) for a, b in zip(q, v)), i) for i, v in rows if i != own and len(v) == len(q)]
    return [(i, -d) for d, i in sorted(s)][:k]


@pytest.mark.parametrize("shard_bytes", [2_000, 10_000_000])
def test_neighbours(spark, shard_bytes):
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (300, 6)).astype(np.float32)
    x[50:90] = x[50]
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    rows = good + [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [1.0]), (305, [float("inf")] * 6), (None, [1.0] * 6)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("length", F.lit(1))
    got = found_neighbours(t, shard_bytes=shard_bytes, step=7)
    assert set(got) == {i for i in range(300) if i % 20 == 0}
    for q, found in got.items():
        want = brute_neighbours(good, x[q], q)
        assert [i for i, _ in found] == [i for i, _ in want] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(found, want))


def test_neighbours_of_each_length(spark):
    """An odd length first doesn't send the others away; each length is searched by itself."""
    r = np.random.default_rng(4)
    rows = [(0, [2.0])] + [(i, r.normal(0, 1, 5).tolist()) for i in range(1, 101)] + [(i, r.normal(0, 1, 2).tolist()) for i in range(101, 131)]
    got = found_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert set(got) == {20, 40, 60, 80, 100, 120}
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, _ in brute_neighbours(rows, dict(rows)[q], q)]


def test_neighbours_of_repeated_rows(spark):
    """A query id that occurs twice has one whole ranking; copies of a vector beyond k leave the smaller ids."""
    r = np.random.default_rng(6)
    rows = [(i, r.normal(0, 1, 4).tolist()) for i in range(60)]
    rows += [rows[20], rows[20], (40, [9.0, 0.0, 0.0, 0.0]), rows[7]] + [(i, [3.0, 3.0, 3.0, 3.0]) for i in range(1001, 1500)]
    got = found_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    least = {q: min(v for i, v in rows if i == q) for q in (0, 20, 40)}
    for q, v in least.items():
        assert [i for i, _ in got[q]] == [i for i, _ in brute_neighbours(rows, v, q)] and len(got[q]) == 20


def test_neighbours_of_any_magnitude(spark):
    r = np.random.default_rng(7)
    for scale in (1e200, 1e-200, 1e150):
        rows = [(i, (r.normal(0, 1, 3) * scale).tolist()) for i in range(50)] + [(50, [1.0, 2.0, 3.0])]
        got = found_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert {q: len(v) for q, v in got.items()} == {0: 20, 20: 20, 40: 20}
        if scale == 1e150:
            assert all([i for i, _ in got[q]] == [i for i, _ in brute_neighbours(rows, dict(rows)[q], q)] for q in got)


def test_neighbours_factor_and_empty(spark):
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(0, 1, (40, 4)), 50, 0) + r.normal(0, 0.05, (2000, 4))
    tree = vptree.Tree(np.arange(2000), x, float(np.sqrt((x * x).sum(1).max())))
    exact = tree.search(np.arange(0, 2000, 20), x[::20], 10, 1.0)
    fast = tree.search(np.arange(0, 2000, 20), x[::20], 10, 0.5)
    shared_pairs = set(zip(exact[0], exact[1])) & set(zip(fast[0], fast[1]))
    assert len(shared_pairs) >= 0.9 * len(exact[0])
    t = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(t, t).isEmpty()


# ---- substrings


def brute_removal(rows, n):
    first, out = {}, {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - n + 1):
            first.setdefault(tuple(split[i][k : k + n]), i)
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("n", "base"), [(50, 13), (50, 25), (10, 5), (9, 3), (4, 13)])
def test_substrings(spark, n, base):
    passages = [words(k, 3 * n + 7 * k) for k in range(5)]
    r = random.Random(9)
    rows = []
    for i in range(40):
        w = []
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            w += p[a : a + r.randrange(1, len(p))] + words(r.random(), r.randrange(30))
        rows.append((i, " ".join(w)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, " ".join(["x"] * (n + 3))), (54, " ".join(["x"] * n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.find_repeats(docs, n, base)
    assert found.min_words == n and found.levels[-1][0] == n and all(k > 0 for _, k in found.levels)
    assert [size for size, _ in found.levels] == {(50, 13): [13, 25, 50], (50, 25): [25, 50], (10, 5): [5, 10], (9, 3): [3, 5, 9], (4, 13): [4, 4]}[n, base]
    want = brute_removal(rows, n)
    if base == 13:
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs, n).collect()} == want
    texts = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs, n).collect()}
    assert texts == {i: v[1] for i, v in want.items()}


def test_substring_levels_end_early(spark):
    """Windows that repeat at a lower level alone are never hashed at the longer ones."""
    docs = spark.createDataFrame([(i, " ".join([*words(i % 12, 20), *words(i + 50, 100)])) for i in range(240)], "doc_id long, text string")
    assert [size for size, _ in substring.find_repeats(docs, 50, 7).levels] == [7, 13, 25]
    assert not substring.find_repeats(docs, 50, 7).levels[-1][1]
    apart = spark.createDataFrame([(i, " ".join(f"{i}x{k}" for k in range(80))) for i in range(4)], "doc_id long, text string")
    assert substring.find_repeats(apart).levels == [(13, 0)] and substring.digests(apart).where("n_removed > 0").isEmpty()


def test_least_of_runs():
    r = np.random.default_rng(2)
    for n, run in ((50, 7), (7, 7), (3, 7), (40, 1), (64, 8)):
        h = r.integers(0, 12, n).astype(np.uint64)
        got = substring.least_of_runs(h, run).tolist()
        assert got == sorted({i + k for i in range(n - run + 1) for k in range(run) if h[i + k] == h[i : i + run].min()})


def test_substrings_beside_clashing_columns(spark):
    a = " ".join(words(1, 80))
    rows = spark.createDataFrame([(1, a, 7, "p", 5, "t"), (2, a, 8, "q", 6, "u")], "doc_id int, text string, n_removed int, `_places` string, `_TAG` int, `tag of a text` string")
    got = substring.remove_repeats(rows)
    assert got.columns == [*rows.columns, "n_removed_"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, a, 7, "p", 5, "t", 0), (2, "", 8, "q", 6, "u", 80)]


def test_substring_edges(edge, none):
    got = [(r.doc_id, r.n_removed) for r in substring.digests(edge).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 30_000), (6, 30_000), (None, 0), (7, 0), (8, 0)], key=str)
    assert substring.digests(none).isEmpty()
    out = substring.remove_repeats(edge)
    assert sorted(out.columns) == sorted([*edge.columns, "n_removed"]) and {r.text for r in out.where("doc_id = 6").collect()} == {""}


def test_rows_of_one_id_are_judged_each_by_itself(spark):
    a, b = " ".join(words(1, 80)), " ".join(words(2, 80))
    rows = spark.createDataFrame([(1, a), (2, a + " end"), (2, b), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.digests(rows).collect()) == [(1, 80, 0), (2, 0, 0), (2, 80, 0), (2, 81, 80)]


# ---- WARC


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n", "x" * 200_000, "<p>a</p>"]
    rows = [(k, f"http://h/{k}", h) for k, h in enumerate(html)] + [(6, "http://h/6", "<p>a</p>"), (None, None, "lonely"), (9, "http://h/\r\nEvil: 1", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("key", F.lit(2))
    got = warc.archive_captures(pages)
    assert got.count() == len(rows)
    texts = {r.i: r.p for r in got.where("response.record_type = 'response'").select(F.regexp_extract("metadata.head", r"page-id: (\d+)", 1).alias("i"), F.col("response.payload").cast("string").alias("p")).collect()}
    assert texts["4"] == html[4] and texts["5"] == html[5] and texts["3"] == ""
    assert got.where("request is null or metadata is null").isEmpty()
    out = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(got).collect()}
    d = lambda t: warc.sha1_base32(t.encode())
    a = "<p>a</p>"
    assert {(0, 8, d(a), "revisit", 6), (1, 8, d(a), "revisit", 6), (6, 8, d(a), "response", None), (2, 0, d(""), "revisit", 3), (3, 0, d(""), "response", None), (None, 6, d("lonely"), "response", None)} <= out


def test_warc_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.digest(warc.archive_captures(pages, min_bytes=3)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.digest(warc.archive_captures(pages.limit(0))).isEmpty()


def test_warc_identifiers_either_way(spark):
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("m1", "metadata", "q1"), ("q2", "request", None), ("r2", "response", "q2"), ("m2", "metadata", "r2"), ("x", "request", "nowhere"), ("r3", "response", None)]
    records = spark.createDataFrame([(i, k, None, c, None, None, None, f"head {i}", 1, "s", None, None) for i, k, c in rows], warc.RECORD)
    got = {r.capture_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.transactions(records).collect()}
    assert got == {"r1": ("q1", "m1"), "r2": ("q2", "m2"), "r3": (None, None)}


def archive(n, size=900):
    r = random.Random(11)
    body = "".join(r.choice("abcdef <>") for _ in range(size))
    return [x.encode() + b"\r\n\r\n" for k in range(n) for x in warc.capture_records(k, f"k{k}", 1, f"http://h/{k}", f"{body}{k}", None, "1970-01-01T00:00:00Z")]


def test_warc_reader_is_linear():
    """16,000 gzip members within seconds, and twice as many in about twice the time."""
    import gzip
    import time

    def seconds(n):
        data = b"".join(gzip.compress(x, 1) for x in archive(n // 3 + 1, 2000))
        t = time.perf_counter()
        assert sum(1 for _ in warc.parse(data)) == 3 * (n // 3 + 1)
        return time.perf_counter() - t

    seconds(1000)
    small, large = seconds(8000), seconds(16_000)
    assert large < 4 and large < 3.5 * small


def test_warc_faults(spark, tmp_path):
    """Of truncated or malformed archives the whole records come, and one row with the error."""
    import gzip

    records = archive(4)
    joined, zipped = b"".join(records), [gzip.compress(x) for x in records]
    bad_length = joined + b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\n"
    files = {
        "whole": (joined, 12, 0), "members": (b"".join(zipped), 12, 0), "padded": (b"\0\0".join(zipped), 12, 0), "one": (gzip.compress(joined), 12, 0), "empty": (b"", 0, 0), "short": (joined[:-30], 11, 1),
        "cut": (b"".join(zipped)[:-40], 11, 1), "junk": (b"".join(zipped[:5]) + b"\x1f\x8bnonsense", 5, 1), "length": (bad_length, 12, 1), "head": (joined + b"WARC/1.1\r\nWARC-Type: resp", 12, 1), "text": (b"no archive at all\r\n\r\n", 0, 1),
    }
    for name, (data, _, _) in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    rows = warc.read_archives(spark, f"file://{tmp_path}")
    got = rows.collect()
    errors = collections.Counter(r.error.split(":", 2)[1].rsplit("/", 1)[1].removesuffix(".warc") for r in got if r.error)
    assert errors == {k: 1 for k, (_, _, e) in files.items() if e}
    assert sum(r.error is None for r in got) == sum(n for _, n, _ in files.values())
    assert warc.transactions(rows.dropDuplicates(["record_id"])).count() == 4


# ---- language models


END = ("end",)


class BruteModel:
    """Unhashed counts of texts (lists of words), less those of one of them."""

    def __init__(self, texts, vocabulary, less=None):
        tokens = [[*t, END] for t in texts if t]
        self.one = collections.Counter(w for t in tokens for w in t)
        self.two = collections.Counter(p for t in tokens for p in zip(t, t[1:]))
        if less:
            self.one.subtract([*less, END])
            self.two.subtract(zip([*less, END], [*less[1:], END]))
        self.total, self.vocabulary = sum(self.one.values()), vocabulary

    def p(self, word, before=None):
        alone = (self.one[word] + lm_score.ADDED) / (self.total + lm_score.ADDED * self.vocabulary)
        if before is None or not self.one[before]:
            return alone
        return lm_score.WEIGHT * self.two[before, word] / self.one[before] + (1 - lm_score.WEIGHT) * alone

    def loss(self, text):
        tokens = [*text, END]
        return np.mean([-np.log(self.p(w, b)) for w, b in zip(tokens, [None, *tokens])])


def test_lm_score(spark):
    rows = [(1, "the cat sat"), (2, "The dog sat down"), (3, None), (4, ""), (5, "stock prices fell"), (6, "stock prices rose"), (6, "stock prices rose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mine", F.lit(0)).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in lm_score.score(docs, docs.where("doc_id < 3")).collect()}
    split = [(i, (t or "").lower().split()) for i, t in rows]
    vocabulary = len({w for _, x in split for w in x}) + 1
    for i, w in split:
        if not w:
            assert got[i].n_words == 0 and got[i].score is None and got[i].loss_target is None
            continue
        target = BruteModel([x for k, x in split if k < 3], vocabulary, w if i < 3 else None).loss(w)
        background = BruteModel([x for _, x in split], vocabulary, w).loss(w)
        assert got[i].n_words == len(w) and np.allclose([got[i].loss_target, got[i].loss_background, got[i].score], [target, background, target - background], rtol=1e-9)
    assert got[1].score < got[6].score and got[6].loss_background < got[5].loss_background


def test_lm_probabilities_sum_to_one():
    """Over all words that a model has seen, the end and as many others as the vocabulary allows for."""
    r = random.Random(3)
    texts = [[r.choice("abcdefg") for _ in range(r.randint(1, 9))] for _ in range(12)]
    for less in (None, texts[4]):
        model = BruteModel(texts, 50, less)
        words_of_it = [*"abcdefg", END]
        for before in [None, *"abcdefg", "unseen"]:
            assert abs(sum(model.p(w, before) for w in words_of_it) + (50 - len(words_of_it)) * model.p("unseen", before) - 1) < 1e-12


def test_lm_scores_repeated_documents_apart(spark):
    """A document that occurs twice is well known to a model of the corpus without one of them, one that occurs once isn't."""
    rows = [(i, " ".join(f"z{random.Random(i).random()}"[:9] if k % 3 else w for k, w in enumerate(words(i, 60)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.loss_background for r in lm_score.score(docs, docs.where("doc_id between 20 and 40")).collect()}
    twice = [*range(10), *range(100, 110)]
    assert max(got[i] for i in twice) < min(v for i, v in got.items() if i not in twice)


def test_lm_edges(edge, none):
    got = lm_score.score(edge, edge.limit(0)).collect()
    assert len(got) == 10 and lm_score.score(none, edge).isEmpty()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert all(r.n_words == 0 and r.score is None for i in (1, 2, 3) for r in by_id[i]) and by_id[None][0].n_words == 4
    assert len(by_id[6]) == 2 and by_id[6][0] == by_id[6][1] and by_id[5][0].n_words == 30_000 and abs(by_id[5][0].score - by_id[6][0].score) < 1e-12
    uniform = np.log(len({w for r in edge.collect() for w in (r.text or "").encode().lower().split()}) + 1)
    assert all(abs(r.loss_target - uniform) < 1e-9 for i, rs in by_id.items() for r in rs if r.score is not None)


def test_lm_counts_are_exact(spark, monkeypatch):
    """More distinct words and pairs than any fixed number of slots keeps apart, in many blocks: equal to unhashed counts."""
    monkeypatch.setattr(lm_score, "BLOCK", 100_000)
    r = random.Random(5)
    rows = [(i, " ".join(f"x{int(r.random() ** 2 * 600_000)}" for _ in range(r.randint(0, 6000)))) for i in range(150)]
    docs = spark.createDataFrame([*rows, (None, "x1 x2 x1 x2")], "doc_id long, text string")
    got = {x.doc_id: x for x in lm_score.score(docs, docs.where("doc_id % 3 = 0")).collect()}
    low = {i: t.split() for i, t in [*rows, (None, "x1 x2 x1 x2")]}
    vocabulary = len({w for x in low.values() for w in x})
    assert vocabulary > 100_000 and len(got) == 151
    texts = {"target": [x for i, x in low.items() if i is not None and i % 3 == 0], "all": list(low.values())}
    models = {k: BruteModel(v, vocabulary + 1) for k, v in texts.items()}
    for i, x in low.items():
        assert got[i].n_words == len(x)
        if x:
            want = []
            for name, member in (("target", i is not None and i % 3 == 0), ("all", True)):
                m = models[name]
                own = [*x, END] if member else []
                m.one.subtract(own)
                m.two.subtract(zip(own, own[1:]))
                m.total -= len(own)
                want.append(m.loss(x))
                m.one.update(own)
                m.two.update(zip(own, own[1:]))
                m.total += len(own)
            assert np.allclose([got[i].loss_target, got[i].loss_background, got[i].score], [*want, want[0] - want[1]], rtol=1e-9)


def test_lm_blocks_send_what_they_have(spark, monkeypatch):
    """Rows of counts are at most the blocks' distinct words and pairs, and one a prefix, whatever the number of blocks; a third of all rows with one
    id, and as many without any, are spread over blocks, and scores don't depend on how rows are cut or added up."""
    rows = [(i, " ".join(words(i, 40))) for i in range(300)] + [(7, "one text in many rows")] * 200 + [(None, "no id in many rows")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = docs.where("doc_id < 50")
    marked = shared.saved(docs.withColumn("member", F.lit(False)), "marked")
    got = {}
    for size, at_once in ((300, 50), (3_000, 10**9), (10**9, 1)):
        monkeypatch.setattr(lm_score, "BLOCK", size)
        monkeypatch.setattr(lm_score, "AT_ONCE", at_once)
        told = lm_score.blocks(marked, lm_score.messages, lm_score.MESSAGE)
        assert told.count() == told.dropDuplicates(["block", "prefix"]).count()
        got[size] = told.select("block").distinct().count(), sorted((str(r.doc_id), r.n_words, round(r.loss_target, 12), round(r.loss_background, 12)) for r in lm_score.score(docs, target).collect())
    assert got[300][0] > 5 * got[3_000][0] and got[10**9][0] <= marked.rdd.getNumPartitions()
    assert got[300][1] == got[3_000][1] == got[10**9][1] and len(got[300][1]) == len(rows)


# ---- pipeline


def test_pipeline_stages(spark, docs):
    now = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = now.columns, [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = shared.saved(stage(spark, now, DATA), name)
        if name != "packing":
            assert now.columns == columns
            seen.append(now.count())
            if name == "near_dedup":
                before = {r.doc_id: r.text for r in shared_before.collect()}
                want = brute_components(sorted(before.items()), 5)
                assert {r.doc_id for r in now.collect()} == {i for i, c in want.items() if i == c}
            if name == "substring_dedup":
                want = brute_removal([(r.doc_id, r.text) for r in shared_before.collect()], 50)
                assert {r.doc_id: len((r.text or "").split()) for r in now.collect()} == {i: n - gone for i, (n, gone, _) in want.items() if n > gone or not n}
                assert now.where("n_chars <> length(text)").isEmpty()
        shared_before = now
    assert len(corpus_pipeline.STAGES) == 5 and seen == sorted(seen, reverse=True) and seen[-1] > 0.6 * seen[0]
    assert now.select("doc_id").distinct().count() == seen[-1]


PIPED = "doc_id long, text string, lang string, n_removed int, _places string, rid int, `row` string, _language int, h1 int"


def test_pipeline_edges(spark):
    """Nulls, repeated rows, clashing columns and a table without n_chars, through every stage but the trained ones' choice."""
    head, other = words(1, 90), words(2, 90)
    rows = [(1, " ".join(head)), (1, " ".join(head)), (None, " ".join(head)), (None, " ".join(other)), (2, " ".join([*words(3, 300), *head])), (3, " ".join(head[5:65])), (4, None), (5, ""), (6, "12 34")]
    docs = spark.createDataFrame([(i, t, "en", k, "p", k, "r", k, k) for k, (i, t) in enumerate(rows)], PIPED)
    known = shared.saved(corpus_pipeline.language_id(spark, docs, DATA), "known")
    assert known.columns == docs.columns and known.where("doc_id in (4, 5, 6)").isEmpty()
    assert corpus_pipeline.quality(spark, known, DATA).columns == docs.columns
    apart = shared.saved(corpus_pipeline.near_dedup(spark, docs, DATA), "apart")
    assert apart.schema == docs.schema
    assert sorted(str(r.doc_id) for r in apart.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    left = shared.saved(corpus_pipeline.substring_dedup(spark, apart, DATA), "left")
    texts = {r.doc_id: r.text for r in left.collect()}
    assert left.columns == docs.columns and 3 not in texts and texts[2] == " ".join(words(3, 300)) and texts[1] == " ".join(head) and texts[4] is None and texts[5] == ""
    assert {r.n_removed for r in left.collect()} <= set(range(9))
    pieces = corpus_pipeline.pack(spark, left, DATA).collect()
    assert {r.doc_id for r in pieces} == set(texts)


def test_pipeline_of_an_empty_table(spark):
    now = spark.createDataFrame([], PIPED)
    for name, stage in corpus_pipeline.STAGES:
        now = shared.saved(stage(spark, now, DATA), name)
        assert now.isEmpty()


def test_intermediate_tables_go(spark, docs):
    """Of what operators write only what their results read stays."""
    import os

    folder = shared.scratch(spark, "").rpartition("/")[0].removeprefix("file://")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    before = set(os.listdir(folder))
    near = minhash.near_duplicates(table)
    assert len(set(os.listdir(folder)) - before) == 3 and near.rows.count() == len(docs) and near.links.count() > 0
    before = set(os.listdir(folder))
    found = substring.find_repeats(table)
    assert len(set(os.listdir(folder)) - before) == 4 and found.spans.count() > 0

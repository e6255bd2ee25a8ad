"""Periodic runs and the Merkle manifest: against loops that follow the definitions word by word and node by node."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lexivec.llm import merkle, nndescent, queries, runs
from lexivec.llm.shared import WordHashes
from tests.oracle import check

DATA = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, lang string, source string, n_chars long, runs string, h string, part string, pos int, start int"


def edge_rows():
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(60)}" for _ in range(30_000)) + " a b c" * 4_000
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, long), (6, long), (6, long), (None, "no id at all"), (None, "no id at all"), (7, "İß 日本 \x85\x1c Ä"), (8, "a " * 60), (9, "AbC " * 30)]
    return [(i, t, "en" if k % 2 else None, ["s", None][k % 3 == 0], k if k % 4 else None, "x", "y", "z", k, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EDGE)


@pytest.mark.parametrize("name", ["op11_runs", "op12_manifest"])
def test_same_as_sql(spark, name):
    check(spark, name, queries.QUERIES, queries.ORACLE_SQL)


def plain_runs(w):
    """Every period from 1 on; a stretch that a smaller period has already isn't one of its multiples."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in found.items()], key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("tree_words", [1, 500, 150_000])
def test_runs_are_those_of_every_period(monkeypatch, tree_words):
    monkeypatch.setattr(runs, "TREE_WORDS", tree_words)
    r, texts = random.Random(tree_words), []
    for _ in range(150):
        words, most = [], r.randint(0, 350)
        while len(words) < most:
            part = [b"%d" % r.randrange(r.choice([1, 2, 3, 40])) for _ in range(r.randint(1, 30))]
            words += (part * r.randint(1, 9))[: r.randint(1, 200)]
        texts.append(words)
    want = [plain_runs(w) for w in texts]
    assert sum(map(len, want)) > 200
    assert runs.runs_of(texts, WordHashes(11)) == want


def test_branching_repeats_of_a_string():
    """All branching tandem repeats of a short string, by looking at each place and period."""
    text = [0, 1, 0, 0, 1, 0, 0, 1, 1, 0, 1, 0, 1, 9]
    want = {(i, q) for q in range(1, 7) for i in range(len(text) - 2 * q + 1) if text[i : i + q] == text[i + q : i + 2 * q] and (i + 2 * q == len(text) or text[i + 2 * q] != text[i + q])}
    import numpy as np

    i, q = runs.SuffixTree(np.array(text)).tandem_repeats()
    assert set(zip(i.tolist(), q.tolist(), strict=True)) == want


def test_the_longest_stretch_costs_little():
    words = [b"x"] * 200_000
    assert runs.runs_of([words], WordHashes(11)) == [[(0, 200_000, 1)]]


def test_run_edges(edge, none):
    got = runs.digest(runs.periodic_runs(edge, planted=True)).collect()
    assert len(got) == len(edge_rows())
    empty = hashlib.sha256(b"").hexdigest()
    for row, (doc_id, text, *_) in zip(got, edge_rows(), strict=True):
        w = runs.periodic([x.encode() for x in (text or "").split(" ") if x.strip()] if doc_id != 7 else text.encode().split(), doc_id)
        found = plain_runs(w) if len(w) < 1000 else runs.runs_of([w], WordHashes(11))[0]
        assert row.n_runs == len(found)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        if found:
            s, n, q = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (row.start, row.length, row.period, row.exponent_milli, row.runs_sha256) == (None, None, None, None, empty)
    long = [r for r in got if r.doc_id in (5, 6)]
    assert all(any(q == 3 for _, _, q in runs.runs_of([edge_rows()[4][1].encode().split()], WordHashes(11))[0]) for _ in long)
    assert runs.digest(runs.periodic_runs(none)).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """All levels as lists, a proof by walking up."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def around(tree, i):
        for nodes in tree[:-1]:
            first = i // 8 * 8
            yield nodes[first:i], nodes[i + 1 : first + 8]
            i //= 8

    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) if text is not None else None
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        first = [field(doc_id), field(source), field(lang), field(n_chars)]
        groups.setdefault(lang, []).append((doc_id, H(*first, field(text)), H(*first, field(low if hit else text))))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = levels([h for _, h, _ in groups[name]])
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (doc_id, h, t) in enumerate(groups[name]):
            path = [*around(trees[name], i), *around(top, k)]
            proof, folded = H(*[x for a, b in path for x in (*a, *b)]), t
            for a, b in path:
                folded = H(*a, folded, *b)
            out.append((doc_id, h, trees[name][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(docs, levels=merkle.LEVELS):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r[n] for n in names) for r in merkle.manifest(docs, levels).collect()], key=str)


def test_manifest_edges(edge, none):
    rows = [r[:5] for r in edge_rows()]
    got = found(edge)
    assert got == plain_manifest(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    assert found(none) == []


@pytest.mark.parametrize(("levels", "rows", "langs"), [(1, 300, 12), (2, 1500, 3), (4, 64, 1), (4, 1, 1), (1, 9, 9)])
def test_manifest_of_any_blocks(spark, levels, rows, langs):
    """Blocks of one, two and four levels: the same tree, over several rounds of blocks; one group holds most rows."""
    r = random.Random(rows)
    docs = [(i, f"Text {i} {r.random()}", f"l{max(0, r.randrange(3 * langs) - 2 * langs)}", "s", i) for i in r.sample(range(10 * rows), rows)]
    one = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(one, levels) == plain_manifest(docs)


def test_manifest_orders_groups_by_bytes(spark):
    docs = [(i, "t", lang, None, None) for i, lang in enumerate(["b", "é", "Z", "a", "\U0001f600", "￮", "", None])]
    one = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(one) == plain_manifest(docs)


def test_numbers_of_a_large_group(spark):
    """Places are gapless over partitions, repeated rows included."""
    rows = spark.range(2000).select(F.lit("x").alias("part"), (F.col("id") % 7).alias("v"), F.col("id").alias("row"))
    got = merkle.numbered(rows, ["v", "row"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(2000)) and {r.n for r in got} == {2000}
    assert [(r.v, r.row) for r in got] == sorted((r.v, r.row) for r in got)


VECTORS = "vec_id long, embedding array<double>, label string, d double, site long, n_links int"


def plain_links(rows, cosine=0.93):
    """n_links and component_id of each row, by comparing all with all."""
    import numpy as np

    def unit(e):
        if e is None or any(v is None or v != v or abs(v) == float("inf") for v in e) or not any(e):
            return None
        x = np.array(e) / max(map(abs, e))
        return x / np.sqrt(x @ x)

    u = [unit(r[1]) for r in rows]
    linked = [[j for j in range(len(rows)) if i != j and u[i] is not None and u[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine] for i in range(len(rows))]
    root = [-1] * len(rows)
    for i in range(len(rows)):
        todo = [i] if root[i] < 0 else []
        while todo:
            k = todo.pop()
            root[k] = i
            todo += [j for j in linked[k] if root[j] < 0]
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min([x for x in (least.get(root[i]), r[0]) if x is not None], default=None)
    out = [(r[0], len(linked[i]), least[root[i]], r[0] is None or least[root[i]] is None or r[0] == least[root[i]]) for i, r in enumerate(rows)]
    return sorted(out, key=str)


def links_of(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in nndescent.near_vectors(df, 0.93).rows.collect()], key=str)


def test_near_vectors_are_those_of_sql(spark):
    check(spark, "op13_near_vectors", queries.QUERIES, queries.ORACLE_SQL)


def test_near_vectors_in_crowds_chains_and_pairs(spark):
    """Dense crowds of hundreds, two crowds at a distance where only some members link, loose groups whose lists must
    grow, chains, pairs and single vectors, copies of some."""
    import numpy as np

    rng = np.random.default_rng(4)
    normal = lambda n, around=0.0, spread=1.0: around + spread * rng.standard_normal((n, 16))
    centre = normal(1)[0] * 2
    beside = centre + 0.45 * np.linalg.norm(centre) / 4 * normal(1)[0]
    loose = normal(1)[0] * 2
    chain = [np.cos(t) * np.eye(16)[0] + np.sin(t) * np.eye(16)[1] for t in np.arange(30) * 0.3]
    groups = [normal(300, centre, 0.12), normal(200, beside, 0.12), normal(60, loose, 0.75), np.array(chain), normal(300)]
    groups.append(groups[-1][:60] + 0.05 * rng.standard_normal((60, 16)))
    x = np.concatenate(groups)
    x = np.concatenate([x, x[::9]])
    rows = [(int(i), (v * 10.0 ** rng.integers(-3, 4)).tolist() if k % 5 else v.tolist(), "ab"[k % 7 == 0], 0.0, 1, 2) for k, (i, v) in enumerate(zip(rng.permutation(len(x)) * 3, x))]
    want = plain_links(rows)
    assert 0 < sum(n for _, n, _, _ in want) and len({c for _, _, c, _ in want}) > 100
    assert links_of(spark.createDataFrame(rows, VECTORS).repartition(3)) == want


def test_near_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, nan], [inf, 1.0], [1.0, 0.0], [1.0, 0.0], [2e300, 0.0], [1e-300, 0.0], [1.0, 0.0, 0.0], [-1.0, 0.0], [1.0, -0.0]]
    rows = [(k, v, "x", 0.0, 1, 2) for k, v in enumerate(vectors)] + [(None, [1.0, 0.01], "x", 0.0, 1, 2), (None, [5.0, 5.0], "y", 0.0, 1, 2), (6, [1.0, 0.0], "x", 0.0, 1, 2), (20, [1.0, 0.0], None, 0.0, 1, 2), (21, [1.0, 0.0], None, 0.0, 1, 2)]
    assert links_of(spark.createDataFrame(rows, VECTORS)) == plain_links(rows)
    assert links_of(spark.createDataFrame([], VECTORS)) == []


def test_many_equal_vectors_are_one_node(spark):
    rows = [(k, [3.0, 4.0], "x", 0.0, 1, 2) for k in range(500)]
    assert links_of(spark.createDataFrame(rows, VECTORS)) == plain_links(rows)


def test_rounds_refine_a_poor_graph(spark, monkeypatch):
    """From one order with small chunks the lists miss links; rounds and audit find them."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 32))
    x = np.concatenate([x, x + 0.1 * rng.standard_normal(x.shape)])
    rows = [(k, v.tolist(), "x", 0.0, 1, 2) for k, v in enumerate(x)]
    monkeypatch.setattr(nndescent, "ORDERS", 1)
    assert links_of(spark.createDataFrame(rows, VECTORS)) == plain_links(rows)

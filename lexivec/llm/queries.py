"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import bpe, gam, iforest, langid, lm_score, merkle, minhash, nndescent, packing, rules, runs, substring, vptree, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score(table(spark, sf_dir, "documents"), good)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), capacity=1024))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iforest.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *rules.COUNTS, "base_failed", "kept", "anomaly")


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, factor=1.0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"), min_words=50)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.archive_captures(table(spark, sf_dir, "pages"), min_bytes=0))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(table(spark, sf_dir, "documents"), planted=True))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93).rows.drop("rid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_langid": op2_langid,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_packing": op4_packing,
    "op5_rules": op5_rules,
    "op6_classifier": op6_classifier,
    "op7_neighbours": op7_neighbours,
    "op8_bpe": op8_bpe,
    "op9_substrings": op9_substrings,
    "op10_warc": op10_warc,
    "op11_runs": op11_runs,
    "op12_manifest": op12_manifest,
    "op13_near_vectors": op13_near_vectors,
}

#: The unsigned crc32 of a number's decimal digits, byte by byte and bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": """
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
             least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN n USING (doc_id)""",
    "op7_neighbours": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_substrings": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS i FROM d)),
             f AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
             hit AS (SELECT doc_id, i FROM win JOIN f USING (h) WHERE doc_id > first),
             gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(0, 50) t(k)),
             one AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
             kept AS (SELECT o.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN x END, ' ' ORDER BY o.i), '') AS t FROM one o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.i = g.i GROUP BY o.doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
               CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN holder <> page_id THEN holder END AS refers_to
        FROM m""",
    "op11_runs": f"""
        WITH d AS (SELECT doc_id, {CRC32.format("doc_id")} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             a AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM d),
             o AS (SELECT doc_id, unnest(range(0, n)) AS i, a, 1 + (n - a) // k AS p, w FROM a),
             x AS (SELECT doc_id, i, w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS t FROM o),
             e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.t = r.t AND r.i > l.i),
             g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
             s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM g GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(24, 3 * q)),
             r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
             best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (length * 1000000007) // period DESC, start, period) AS rank FROM r),
             gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
             kept AS (SELECT x.doc_id, string_agg(t, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id),
             listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY doc_id)
        SELECT a.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM a LEFT JOIN best ON best.doc_id = a.doc_id AND rank = 1 LEFT JOIN kept ON kept.doc_id = a.doc_id LEFT JOIN listed ON listed.doc_id = a.doc_id""",
    "op12_manifest": f"""
        WITH RECURSIVE v AS (SELECT *, coalesce('=' || lang, '') AS part, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, {CRC32.format("doc_id")} % 3 = 0 AS hit,
                    concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                           coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS fields FROM documents),
             h AS (SELECT doc_id, part, sha256(concat(fields, coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS leaf,
                          sha256(concat(fields, coalesce(octet_length(encode(CASE WHEN hit THEN low ELSE text END)) || ':' || CASE WHEN hit THEN low ELSE text END, '-'))) AS folded FROM v),
             l AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS pos FROM h),
             tree AS (SELECT part, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY part) AS n FROM l
                      UNION ALL SELECT part, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY part, level, pos // 8, n),
             sub AS (SELECT part, h, row_number() OVER (ORDER BY part) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
             top AS (SELECT 0 AS level, pos, h, n FROM sub UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
             steps AS (SELECT l.part, l.pos, t.level AS k, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < l.pos // CAST(pow(8, t.level) AS BIGINT)), '') AS a,
                              coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > l.pos // CAST(pow(8, t.level) AS BIGINT)), '') AS b
                       FROM l JOIN tree t ON t.part = l.part AND t.n > 1 AND t.pos // 8 = l.pos // CAST(pow(8, t.level + 1) AS BIGINT) GROUP BY l.part, l.pos, t.level
                       UNION ALL SELECT l.part, l.pos, 100 + t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // CAST(pow(8, t.level) AS BIGINT)), ''),
                              coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // CAST(pow(8, t.level) AS BIGINT)), '')
                       FROM l JOIN sub s ON s.part = l.part JOIN top t ON t.n > 1 AND t.pos // 8 = s.pos // CAST(pow(8, t.level + 1) AS BIGINT) GROUP BY l.part, l.pos, t.level),
             path AS (SELECT part, pos, sha256(string_agg(a || b, '' ORDER BY k)) AS proof, list(a ORDER BY k) AS a, list(b ORDER BY k) AS b FROM steps GROUP BY part, pos),
             climb AS (SELECT l.part, l.pos, folded AS f, coalesce(path.a, []) AS a, coalesce(path.b, []) AS b FROM l LEFT JOIN path ON path.part = l.part AND path.pos = l.pos
                       UNION ALL SELECT part, pos, sha256(a[1] || f || b[1]), a[2:], b[2:] FROM climb WHERE len(a) > 0),
             root AS (SELECT h FROM top WHERE n = 1)
        SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f AS folded_root, f = root.h AS verified
        FROM l JOIN sub ON sub.part = l.part JOIN climb ON climb.part = l.part AND climb.pos = l.pos AND len(climb.a) = 0 LEFT JOIN path ON path.part = l.part AND path.pos = l.pos CROSS JOIN root""",
    "op13_near_vectors": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
             reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
             least_of AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
             n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least_of LEFT JOIN n USING (vec_id)""",
}

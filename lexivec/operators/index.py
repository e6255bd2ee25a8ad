"""The search index: passages in overlapping windows, their vectors, word statistics, and their upkeep by record.

Tables: chunks (chunk_id, bid_no, chunk_index, chunk, metadata, embedding), postings (term, bid_no, chunk_id, tf, dl, and from records
first: no earlier chunk of the record has the word), terms (term, df, idf) and corpus (one row: n, total, avgdl and the other tables' columns). A stored index grows by segments: an update adds the chunks and postings of its
records, names the records whose earlier ones no longer count (gone), and writes the terms and the corpus anew from
those before and the difference, so that it reads postings of its own records alone. Postings are counted where their chunks lie, and
never shuffled: each file has the postings of some chunks sorted by term, so that a question reads the pages of its words in each
file. Chunks lie sorted by chunk_id in each file, terms by term. The corpus is written last: a segment without it isn't there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexivec.functions.text import metadata_card, rich_text, text_or_empty, tokens
from lexivec.operators.scratch import delete, tidied, written

SIZE, OVERLAP, LEAST, BODY = 800, 100, 20, 10
#: Bytes of a row group of a stored index, before compression: so much, and more, is read by one task and skipped as one.
BLOCK = 8 << 20
#: Bytes of written records that one task cuts and counts, so that it sorts their postings in its memory: some fifty times as many.
SPLIT = 8 << 20
#: The metadata of a chunk, '' where a record lacks it.
META = (
    "bid_no", "bid_type", "product_type", "full_item_name", "quantity", "department", "start_date", "end_date", "estimated_value", "bid_packet_type", "ra_no",
    "document_url", "corrigendum_url",
)


def windows(docs: DataFrame, key: str, body: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, start, chunk: slices of a body with white space collapsed; those of LEAST characters or fewer go. The
    last may lie within the one before."""
    flat = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s+", " "))
    raw = F.length(F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    rows = docs.select(key, flat.alias("flat"), raw.alias("raw")).where((F.col("raw") >= BODY) & (F.length("flat") > 0))
    starts = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("flat") - 1, F.lit(max(1, size - overlap)))))
    return starts.select(key, "start", F.trim(F.substr("flat", F.col("start") + 1, F.lit(size))).alias("chunk")).where(F.length("chunk") > LEAST)


def passages(flat: Column, raw: Column, card: Column | None = None, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<string>: the metadata card first, then the windows of a body, without those of LEAST characters or fewer.
    flat: the body with white space collapsed, a column of its own, as every window is cut from it; raw: the body's length as it was."""
    starts = F.sequence(F.lit(0), F.length(flat) - 1, F.lit(max(1, size - overlap)))
    cut = F.when((raw >= BODY) & (F.length(flat) > 0), F.transform(starts, lambda s: F.trim(F.substr(flat, s + 1, F.lit(size))))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(F.array(F.trim(card)), cut) if card is not None else cut, lambda c: F.length(c) > LEAST)


def chunked(docs: DataFrame, key: str, body: Column, card: Column | None = None, size: int = SIZE, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """chunk_id, key, chunk_index, chunk and kept columns: the passages of each row, numbered after short ones went. All of
    it happens within the row: nothing is shuffled."""
    rows, cut = with_passages(docs, key, body, card, size, overlap, keep)
    out = rows.select(key, *keep, F.posexplode(cut).alias("chunk_index", "chunk"))
    return out.select(chunk_name(key, F.col("chunk_index")).alias("chunk_id"), "*")


def chunk_name(key: str, place: Column) -> Column:
    return F.concat(F.col(key).cast("string"), F.lit("__chunk_"), place.cast("string"))


def with_passages(docs: DataFrame, key: str, body: Column, card: Column | None, size: int, overlap: int, keep: Sequence[str]) -> tuple[DataFrame, Column]:
    """Rows with key and kept columns, and their passages: an expression, as a filter on a column of them would cut them twice."""
    text = F.coalesce(body, F.lit(""))
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    raw = F.length(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    rows = docs.select(key, *keep, *([card.alias("_card")] if card is not None else []), flat.alias("_flat"), raw.alias("_raw"))
    cut = passages(F.col("_flat"), F.col("_raw"), F.col("_card") if card is not None else None, size, overlap)
    return rows, cut


def last_of_record(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of rows with an equal key the greatest by order, whose last column tells all rows apart. Only keys that come twice meet,
    and only their order does."""
    twice = rows.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.struct(*order)).alias("_last")).where("_n > 1")
    # Written, so that its size is known: where few keys come twice, the rows themselves aren't shuffled.
    last = written(twice.select(key, F.col(f"_last.{order[-1]}").alias("_place")), "twice")
    return rows.join(last, key, "left").where(F.col("_place").isNull() | (F.col("_place") == F.col(order[-1]))).drop("_place")


def record_chunks(records: DataFrame, body: str = "full_pdf_text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of records with META."""
    return chunks_of(record_rows(records, body), size, overlap)


def chunks_of(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    return chunked(rows, "bid_no", F.col("_body"), metadata_card({c: F.col(c) for c in META}), size, overlap, META[1:])


def record_rows(records: DataFrame, body: str) -> DataFrame:
    """META and _body of records, keyed by bid_no, else document_url, else 'unknown-' and a hash of all that is indexed.

    A record that comes more than once counts once, as it came last: by last_seen, where there is one, then by place."""
    have = lambda c: text_or_empty(F.col(c)) if c in records.columns else F.lit("")
    seen = F.col("last_seen") if "last_seen" in records.columns else F.lit(0)
    rows = records.select(have("bid_no").alias("bid_no"), *[have(c).alias(c) for c in META[1:]], have(body).alias("_body"), seen.alias("_seen"), F.monotonically_increasing_id().alias("_row"))
    content = F.md5(F.concat_ws("\x1f", *META[1:], "_body").cast("binary"))
    named = F.coalesce(F.nullif("bid_no", F.lit("")), F.nullif("document_url", F.lit("")), F.concat(F.lit("unknown-"), content))
    return last_of_record(written(rows.withColumn("bid_no", named), "records", SPLIT), "bid_no", ["_seen", "_row"])


def embedded(chunks: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], text: str = "chunk", batch: int = 32) -> DataFrame:
    """The chunks with embedding (array<double> of length one) and embed_error, by a model that is given and gets so many
    passages at a time. A batch that fails is tried one by one; what fails then has its error and no vector."""

    def one(x: str) -> tuple[Sequence[float] | None, str | None]:
        try:
            return embed([x])[0], None
        except Exception as e:  # noqa: BLE001 - one passage's failure is its row's
            return None, str(e)

    def run(texts: pa.Array) -> pa.Array:
        done: list[tuple[Sequence[float] | None, str | None]] = []
        for i in range(0, len(texts), batch):
            part = [t or "" for t in texts[i : i + batch].to_pylist()]
            try:
                done += [(v, None) for v in embed(part)]
            except Exception:  # noqa: BLE001
                done += map(one, part)
        unit = lambda v: (v / (np.sqrt((v * v).sum()) or 1.0)).tolist()
        vectors = [None if v is None else unit(np.asarray(v, np.float64)) for v, _ in done]
        return pa.StructArray.from_arrays([pa.array(vectors, pa.list_(pa.float64())), pa.array([e for _, e in done], pa.string())], ["embedding", "embed_error"])

    return chunks.withColumn("_v", F.arrow_udf(run, "embedding array<double>, embed_error string")(F.col(text))).select("*", "_v.*").drop("_v")


def replace_chunks(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The index with all chunks of the new ones' records replaced; records without new chunks keep theirs."""
    return existing.join(new.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))


def delete_chunks(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key), key, "left_anti")


def counted(chunks: DataFrame, chunk_id: str, text: Column, keep: Sequence[str] = ()) -> DataFrame:
    """term, kept columns, chunk_id, tf, dl of each row by itself: in a sorted list of words equal ones are neighbours. Nothing
    is shuffled."""
    words = chunks.select(F.col(chunk_id).alias("chunk_id"), *keep, F.sort_array(tokens(text)).alias("w"))
    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    begun = words.withColumn("begin", F.filter(places, lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1))))
    run = lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("begin", k + 1), F.size("w")) - i).cast("long").alias("tf"))
    each = begun.select("chunk_id", *keep, F.size("w").alias("dl"), F.inline(F.transform("begin", run)))
    return each.select("term", *keep, "chunk_id", "tf", "dl")


def postings(chunks: DataFrame, chunk_id: str, text: Column, keep: Sequence[str] = ()) -> DataFrame:
    """term, chunk_id, tf, dl and kept columns, one row a word and chunk. Only rows whose id comes again meet."""
    again = written(chunks.groupBy(F.col(chunk_id).alias("_id")).count().where("count > 1").select("_id"), "again")
    if again.isEmpty():
        return counted(chunks, chunk_id, text, keep)
    same = F.col(chunk_id).eqNullSafe(F.col("_id"))
    one = counted(chunks.join(again, same, "left_anti"), chunk_id, text, keep)
    met = counted(chunks.join(again, same, "left_semi"), chunk_id, text, keep)
    return one.unionByName(met.groupBy("term", *keep, "chunk_id", "dl").agg(F.sum("tf").alias("tf")))


def record_postings(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """term, bid_no, chunk_id, tf, dl, first of the chunks that chunks_of() cuts from each record, counted within the record's
    row: in a sorted list of its words and their chunks equal ones are neighbours, and a word's first chunk comes first."""
    rows, cut = with_passages(rows, "bid_no", F.col("_body"), metadata_card({c: F.col(c) for c in META}), size, overlap, META[1:])
    words = rows.select("bid_no", F.transform(cut, lambda c: tokens(rich_text(*map(F.col, HEAD), c))).alias("w"))
    placed = F.transform("w", lambda ws, i: F.transform(ws, lambda t: F.struct(t.alias("term"), i.alias("place"))))
    every = words.select("bid_no", F.transform("w", F.size).alias("dl"), F.sort_array(F.flatten(placed)).alias("w"))
    at = lambda i: F.get("w", i)
    begun = every.withColumn("begin", F.filter(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)), lambda i: (i == 0) | (at(i) != at(i - 1))))
    run = lambda i, k: F.struct(
        at(i)["term"].alias("term"), chunk_name("bid_no", at(i)["place"]).alias("chunk_id"), (F.coalesce(F.get("begin", k + 1), F.size("w")) - i).cast("long").alias("tf"),
        F.get("dl", at(i)["place"]).alias("dl"), ((i == 0) | (at(i)["term"] != at(i - 1)["term"])).alias("first"),
    )
    return begun.select("bid_no", F.inline(F.transform("begin", run))).select("term", "bid_no", "chunk_id", "tf", "dl", "first")


def records_by_term(posts: DataFrame) -> DataFrame:
    """term, df: the number of records that have the word. Postings that tell a word's first chunk in its record are counted where
    they lie; others meet by word and record. All chunks of a record are of one kind."""
    each = lambda df: df.groupBy("term").agg(F.countDistinct("bid_no").alias("df"))
    if "first" not in posts.columns:
        return each(posts)
    told = posts.where(F.col("first")).select("term", F.lit(1).cast("long").alias("df"))
    return told.union(each(posts.where(F.col("first").isNull()))).groupBy("term").agg(F.sum("df").alias("df"))


def corpus_stats(chunks: DataFrame, text: Column) -> DataFrame:
    """n, total and avgdl in one row."""
    return chunks.select(F.size(tokens(text)).alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame, corpus: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """term, df, idf; a negative idf becomes epsilon times the mean idf of all terms."""
    return with_idf(posts.groupBy("term").agg(F.count("*").alias("df")), corpus, epsilon)


def with_idf(counted: DataFrame, corpus: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """term, df, idf of terms with their df. One row (n, the mean) is all that is broadcast."""
    counted = counted.crossJoin(F.broadcast(corpus.select("n")))
    raw = counted.select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


@dataclass
class WordIndex:
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def build(chunks: DataFrame, chunk_id: str, text: Column, epsilon: float = 0.25) -> WordIndex:
    """The word tables of all chunks, each written once."""
    posts = written(postings(chunks, chunk_id, text), "postings")
    corpus = written(corpus_stats(chunks, text), "corpus")
    return WordIndex(posts, written(term_stats(posts, corpus, epsilon), "terms"), corpus)


#: Metadata that is indexed by words.
HEAD = ("full_item_name", "department", "bid_type", "product_type", "bid_no")


def rich(chunks: DataFrame) -> Column:
    """The text that is indexed by words: metadata, then the passage."""
    head = [F.col(c) for c in HEAD if c in chunks.columns]
    return rich_text(*head, F.col("chunk"))


def segments(spark, root: str) -> list[int]:
    """Numbers of the complete segments of a stored index."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/corpus")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [s.getPath() for s in fs.listStatus(where)]
    return sorted(int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("segment=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def both(old: StructType | None, new: StructType) -> StructType:
    """The new fields, then those that only the old ones have."""
    names = set(new.names)
    return StructType([*new, *[f for f in old or [] if f.name not in names]])


def add_segment(spark, root: str, chunks: DataFrame, text: Column | None = None, gone: DataFrame | None = None, epsilon: float = 0.25, posts: DataFrame | None = None) -> None:
    """Write chunks (chunk_id, bid_no, chunk, ...) as a segment. gone: bid_no of the records whose earlier chunks end; those of
    the chunks, if it isn't given. posts: the chunks' postings, where they are counted by records."""
    done = segments(spark, root)
    k = done[-1] + 1 if done else 0

    def put(df: DataFrame, name: str) -> DataFrame:
        path = f"{root}/{name}/segment={k}"
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", BLOCK).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    with tidied(spark):
        new = put(chunks.sortWithinPartitions("chunk_id"), "chunks")
        if posts is None:
            posts = postings(new, "chunk_id", rich(new) if text is None else text, ["bid_no"])
        posts = put(posts.sortWithinPartitions("term", "chunk_id"), "postings")
        columns = {"chunks": new.schema, "postings": posts.schema}
        one = lambda df, sign: df.select("term", F.lit(sign).cast("long").alias("df"), (sign * F.col("tf")).alias("words"))
        change, corpus = [one(posts, 1)], new.agg(F.count("*").alias("n"))
        if done:
            before, words = stored(spark, root)
            columns = {"chunks": both(before.schema, new.schema), "postings": both(words.postings.schema, posts.schema)}
            # The records that really end: if few do, or none, earlier postings aren't shuffled, now or by readers.
            found = written(before.groupBy("bid_no").agg(F.count("*").alias("n")).join((new if gone is None else gone).select("bid_no"), "bid_no", "left_semi"), "ended")
            put(found.select("bid_no"), "gone")
            change.append(words.terms.select("term", "df", F.lit(0).cast("long").alias("words")))
            if not found.isEmpty():
                change.append(one(words.postings.join(found, "bid_no", "left_semi"), -1))
            corpus = corpus.union(words.corpus.select("n")).union(found.agg(-F.coalesce(F.sum("n"), F.lit(0)))).agg(F.sum("n").alias("n"))
        count = written(reduce(DataFrame.union, change).groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "terms")
        total = count.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("total"))
        if done:
            total = total.union(words.corpus.select("total")).agg(F.sum("total").alias("total"))
        # What columns all segments have, so that no reader looks for them in every file.
        listed = json.dumps({name: of.jsonValue() for name, of in columns.items()})
        corpus = written(corpus.crossJoin(total).withColumn("avgdl", F.col("total") / F.nullif(F.col("n"), F.lit(0))).withColumn("columns", F.lit(listed)), "corpus")
        put(with_idf(count.where("df > 0"), corpus, epsilon).sortWithinPartitions("term"), "terms")
        put(corpus, "corpus")


def reindex(spark, snapshot: DataFrame, root: str, body: str = "full_pdf_text", size: int = SIZE, overlap: int = OVERLAP, embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> None:
    """Rebuild an index from a snapshot of records, with vectors where a model is given."""
    with tidied(spark):
        rows = record_rows(snapshot, body)
        chunks = chunks_of(rows, size, overlap)
        delete(spark, *[f"{root}/{name}" for name in ("corpus", "chunks", "postings", "terms", "gone")])
        add_segment(spark, root, embedded(chunks, embed) if embed else chunks, posts=record_postings(rows, size, overlap))


def update(spark, records: DataFrame, root: str, body: str = "full_pdf_text", size: int = SIZE, overlap: int = OVERLAP, embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None) -> None:
    """Replace the chunks of records, or add them; records without chunks keep theirs. Without an index this builds one."""
    with tidied(spark):
        rows = record_rows(records, body)
        chunks = chunks_of(rows, size, overlap)
        add_segment(spark, root, embedded(chunks, embed) if embed else chunks, posts=record_postings(rows, size, overlap))


def remove(spark, keys: DataFrame, root: str) -> None:
    """Take the chunks of records (bid_no) out of an index."""
    chunks, _ = stored(spark, root)
    add_segment(spark, root, chunks.limit(0), gone=keys)


def stored(spark, root: str) -> tuple[DataFrame, WordIndex]:
    """chunks and word tables of an index."""
    last = segments(spark, root)[-1]
    terms, corpus = (spark.read.parquet(f"{root}/{name}/segment={last}") for name in ("terms", "corpus"))
    columns = json.loads(corpus.first()["columns"])
    segment = StructField("segment", IntegerType())
    read = lambda name: spark.read.schema(StructType([*StructType.fromJson(columns[name]), segment])).parquet(f"{root}/{name}").where(F.col("segment") <= last)
    chunks, posts = read("chunks"), read("postings")
    if last:
        gone = spark.read.parquet(f"{root}/gone").where(F.col("segment") <= last).groupBy(F.col("bid_no").alias("_key")).agg(F.max("segment").alias("_end"))
        live = lambda df: df.join(gone, (F.col("bid_no") == F.col("_key")) & (F.col("segment") < F.col("_end")), "left_anti")
        chunks, posts = live(chunks), live(posts)
    return chunks.drop("segment"), WordIndex(posts.drop("segment"), terms, corpus)


def failed(chunks: DataFrame) -> DataFrame:
    """The chunks that have no vector because the model failed, with its error."""
    return chunks.where(F.col("embed_error").isNotNull()).select("chunk_id", "bid_no", "embed_error")


def health(chunks: DataFrame, key: str) -> DataFrame:
    """chunks, records, ratio and whether that is as it should be (3 to 5 a record)."""
    out = chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct(key).alias("n_records"))
    ratio = F.col("n_chunks") / F.nullif(F.col("n_records"), F.lit(0))
    return out.withColumn("ratio", F.round(ratio, 4)).withColumn("state", F.when(ratio < 3, "few").when(ratio <= 5, "healthy").otherwise("many"))

"""Merkle manifest of a dataset: a leaf for each row, a tree of fan-out 8 for each group, and one tree over the groups' roots.

H is the lowercase hex sha256 of its inputs one after another. Leaves are hashed where their rows are read, by Spark's own
functions; after that only digests move. They are numbered within their group by a range partitioning and the counts of
its partitions, so that no group meets in one task. Aligned blocks of 8**LEVELS nodes then go, as Arrow tables, to DuckDB
on the executors: each level of a block is one query of ordered string_agg and sha256. The roots of blocks are the nodes of
the next round of blocks, until each group has one; the groups' roots take the same way once more. Back down, each
block meets the proof of its root (for each level what stands left and right of the node) in a cogroup, and DuckDB extends
it to the proofs of the block's nodes.

Defined results: an empty table gives no rows. Leaves ascend by doc_id, null first; of equal ids by their leaf, and equal
leaves are interchangeable. A null text stays null when it is tampered with; a row without doc_id is never tampered with. A
group of one has its leaf as root and no siblings of its own. Extra columns of any name are not read.
"""

from __future__ import annotations

from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.shared import saved, tidied

FAN = 8
#: Levels that DuckDB takes in one block, which holds FAN**LEVELS nodes.
LEVELS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
SIDES = "array<struct<left: string, right: string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(values: list[Column]) -> Column:
    """H of each value: its length in bytes, a colon and itself, or a dash if it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, part (the group: '=' and lang, '' if that is null), h (the leaf) and t (the leaf of the tampered row)."""
    text = F.col("text").cast("string")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    first = [F.col(c) for c in FIELDS[:-1]]
    h = leaf([*first, text])
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("part"),
        h.alias("h"),
        F.when(tampered, leaf([*first, F.translate(text, UPPER, LOWER)])).otherwise(h).alias("t"),
    )


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The nodes with pos, their place within part by the given columns, and n, the size of part.

    A range partitioning puts them in order; a partition's rows of a part follow those of the partitions before. Of a part
    only the counts by partition meet."""
    ordered = nodes.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    placed = saved(ordered.withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("block", F.shiftright("at", 33))
    counts = placed.groupBy("part", "block").agg(F.count("*").alias("m"), F.min("at").alias("first"))
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("part").agg(F.sum("m").alias("n"))
    shift = F.coalesce(F.sum("m").over(earlier), F.lit(0)) - F.col("first")
    starts = saved(counts.withColumn("shift", shift).join(totals, "part").select("part", "block", "n", "shift"), "starts")
    return placed.join(starts, ["part", "block"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "block", "shift")


@cache
def _duckdb() -> duckdb.DuckDBPyConnection:
    """One connection for each worker: a block is a few MB."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def height(n: int) -> int:
    """Levels from n nodes to one."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def raised(block: pa.Table, most: int) -> tuple[duckdb.DuckDBPyConnection, int]:
    """Tables l0, l1, ... of the nodes (i, h) of an aligned block of FAN**most: each level hashes runs of FAN nodes of the one
    below. How many levels there are."""
    levels = min(most, height(block["n"][0].as_py()))
    db = _duckdb()
    db.register("block", block)
    db.execute(f"CREATE OR REPLACE TEMP TABLE l0 AS SELECT pos % {FAN**most} AS i, h FROM block")
    for k in range(levels):
        db.execute(f"CREATE OR REPLACE TEMP TABLE l{k + 1} AS SELECT i // {FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l{k} GROUP BY 1")
    return db, levels


def block_root(block: pa.Table, most: int) -> pa.Table:
    """part, pos (the number of the block), n (blocks of the part) and h of the root of a block."""
    db, levels = raised(block, most)
    size = FAN**most
    return db.sql(f"SELECT part, pos // {size} AS pos, (n + {size - 1}) // {size} AS n, l{levels}.h AS h FROM (SELECT part, pos, n FROM block LIMIT 1), l{levels}").to_arrow_table()


def with_sides(levels: int, most: int) -> str:
    """SQL: the block's rows with what stands left and right of their node at each level, as columns a0, b0, a1, ..."""
    joins = []
    for k in range(levels):
        run = f"(PARTITION BY i // {FAN} ORDER BY i ROWS BETWEEN"
        left = f"coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a{k}"
        right = f"coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b{k}"
        joins.append(f"JOIN (SELECT i AS i{k}, {left}, {right} FROM l{k}) ON i{k} = pos % {FAN**most} // {FAN**k}")
    return f"SELECT * FROM block {' '.join(joins)}"


def block_sides(block: pa.Table, above: pa.Table, most: int) -> pa.Table:
    """part, pos, sides (by level what stands left and right) and tops of a block's nodes, from those of its root."""
    db, levels = raised(block, most)
    db.register("above", above.select(["sides", "tops"]))
    own = ", ".join(f"{{'left': a{k}, 'right': b{k}}}" for k in range(levels))
    return db.sql(f"SELECT part, pos, list_concat([{own}], sides) AS sides, tops FROM ({with_sides(levels, most)}), above").to_arrow_table()


def block_proofs(block: pa.Table, above: pa.Table, most: int) -> pa.Table:
    """PROOFS of a block's leaves. Folding starts from t and meets the siblings of all levels, inside the block and above."""
    db, levels = raised(block, most)
    outer = above["sides"][0].as_py()
    subroot, root = above["tops"][0].as_py()
    inner = "".join(f", a{k}, b{k}" for k in range(levels))
    rest = "".join(s["left"] + s["right"] for s in outer)
    db.execute(f"CREATE OR REPLACE TEMP TABLE folds AS SELECT doc_id, h AS leaf, sha256(concat(''{inner}, ?::VARCHAR)) AS proof_sha256, t AS f{inner} FROM ({with_sides(levels, most)})", [rest])
    for k in range(levels):
        db.execute(f"CREATE OR REPLACE TEMP TABLE folds AS SELECT * REPLACE (sha256(concat(a{k}, f, b{k})) AS f) FROM folds")
    for s in outer:
        db.execute("CREATE OR REPLACE TEMP TABLE folds AS SELECT * REPLACE (sha256(concat(?::VARCHAR, f, ?::VARCHAR)) AS f) FROM folds", [s["left"], s["right"]])
    return db.sql("SELECT doc_id, leaf, $1::VARCHAR AS subroot, $2::VARCHAR AS root, proof_sha256, f AS folded_root, f = $2::VARCHAR AS verified FROM folds", params=[subroot, root]).to_arrow_table()


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot (of its lang), root, proof_sha256 (siblings, level by level), folded_root (from the tampered
    leaf and the original siblings) and verified, of every row. levels: of a block."""
    size = FAN**levels
    bucket = F.expr(f"pos div {size}").alias("bucket")

    def up(nodes: DataFrame, name: str) -> list[DataFrame]:
        """The nodes, the roots of their blocks, and so on to one root a part."""
        rounds = [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            most = -(-most // size)
            rounds.append(saved(rounds[-1].groupBy("part", bucket).applyInArrow(lambda block: block_root(block, levels), "part string, pos long, n long, h string"), f"{name}-up"))
        return rounds

    def down(rounds: list[DataFrame], above: DataFrame, last: int, name: str) -> DataFrame:
        """part, pos, sides and tops of the nodes of rounds[last], from those of the roots."""
        for nodes in rounds[last:-1][::-1]:
            met = nodes.groupBy("part", bucket).cogroup(above.groupBy("part", "pos"))
            above = saved(met.applyInArrow(lambda block, above: block_sides(block, above, levels), f"part string, pos long, sides {SIDES}, tops array<string>"), f"{name}-down")
        return above

    with tidied(docs.sparkSession) as keep:
        made = saved(leaves(docs).withColumn("row", F.monotonically_increasing_id()), "leaves")
        rounds = up(saved(numbered(made, ["doc_id", "h", "t", "row"]), "nodes"), "leaves")
        subroots = rounds[-1].select(F.lit("").alias("part"), F.col("part").alias("name"), "h")
        groups = up(saved(numbered(subroots, ["name"]), "groups"), "groups")
        none = groups[-1].select("part", "pos", F.array().cast(SIDES).alias("sides"), F.array().cast("array<string>").alias("tops"))
        placed = down(groups, none, 0, "groups").select("pos", "sides").join(groups[0].select("pos", "name", F.col("h").alias("subroot")), "pos")
        root = groups[-1].select(F.col("h").alias("root"))  # one row
        above = placed.crossJoin(root).select(F.col("name").alias("part"), F.lit(0).cast("long").alias("pos"), "sides", F.array("subroot", "root").alias("tops"))
        above = down(rounds, saved(above, "roots"), 1, "leaves")
        return keep(saved(rounds[0].groupBy("part", bucket).cogroup(above.groupBy("part", "pos")).applyInArrow(lambda block, above: block_proofs(block, above, levels), PROOFS), "manifest"))

"""The command line from sightings to an answer."""

import argparse

from pyspark.sql import functions as F

from lexivec.__main__ import main
from lexivec.operators import store


def run(spark, root, **what):
    main(spark, argparse.Namespace(**({"root": root, "reset": False, "stats": False, "reindex": False, "chat": False, "number": None, "ask": None, "once": None, "filter": None, "top_k": None, "preset": None} | what)))


def test_from_sightings_to_answer(spark, tmp_path, capsys):
    root, src = f"file://{tmp_path}/root", f"file://{tmp_path}/in"
    rows = spark.createDataFrame([("u1", "GEM/2031/B/1", "steel pump for water", 1), ("u2", "GEM/2031/B/2", "brass valve for steam", 1)], "document_url string, bid_no string, full_pdf_text string, seen_at int")
    rest = [c for c in (*store.FIXED, *store.FRESH) if c not in rows.columns]
    rows.select("*", *[F.lit(f"{c} value").alias(c) for c in rest]).coalesce(1).write.parquet(src)
    run(spark, root, stats=True)
    assert "empty" in capsys.readouterr().out
    run(spark, root, once=src)
    assert "new records: 2" in capsys.readouterr().out
    run(spark, root, stats=True)
    out = capsys.readouterr().out
    assert "total" in out and "NULL" in out  # no index yet
    run(spark, root, ask="brass valve")
    assert "no index yet" in capsys.readouterr().out
    run(spark, root, reindex=True, preset="precision")
    run(spark, root, stats=True)
    run(spark, root, number="GEM/2031/B/2")
    assert "brass" not in capsys.readouterr().out
    # Of three records the words of one are rare enough to count; filters apply after the ranking.
    more = rows.where("bid_no like '%/2'").select(F.lit("u3").alias("document_url"), F.lit("GEM/2031/B/3").alias("bid_no"), F.lit("copper pipe for cold air").alias("full_pdf_text"), F.lit(2).alias("seen_at"), *[F.lit(f"{c} value").alias(c) for c in rest])
    more.select("document_url", "bid_no", "full_pdf_text", "seen_at", *rest).coalesce(1).write.mode("append").parquet(src)
    run(spark, root, once=src)
    assert "new records: 1" in capsys.readouterr().out
    run(spark, root, ask="copper pipe", top_k=3)  # indexed by the stream's consumer
    assert "Bid No    : GEM/2031/B/3" in capsys.readouterr().out
    run(spark, root, ask="copper pipe", filter="bid_no=GEM/2031/B/2", top_k=3)
    assert "No matching bids" in capsys.readouterr().out
    run(spark, root, reset=True)
    run(spark, root, stats=True)
    assert "empty" in capsys.readouterr().out

"""Rows keep numbers of their own, whatever a table was made of."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from windrose.llm.common import numbered
from windrose.llm.decontamination import contamination, without_contaminated, without_spans
from windrose.llm.line_dedup import line_dedup
from windrose.llm.near_copies import one_of_each

CLEAN = " ".join(f"clean{k}" for k in range(30))
OTHER = " ".join(f"other{k}" for k in range(30))
BAD = " ".join(f"bad{k}" for k in range(30))
LINES = "one\ntwo\nthree\nfour"


def made(spark, folder, how):
    """Documents 10, 11, 20, 21 of two rows of a file."""
    rows = [(1, [CLEAN, BAD, LINES]), (2, [OTHER, OTHER + " x", LINES])]
    path = f"{folder}/rows"
    spark.createDataFrame(rows, "n long, texts array<string>").coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    at = lambda i: (F.col("n") * 10 + i).alias("doc_id")
    if how == "explode":
        return table.select("n", F.posexplode("texts").alias("i", "text")).select(at(F.col("i")), "text")
    if how == "join":
        places = spark.createDataFrame([(0,), (1,), (2,)], "i int")
        return table.join(F.broadcast(places), F.lit(True)).select(at(F.col("i")), F.get("texts", F.col("i")).alias("text"))
    if how == "self-join":
        flat = table.select("n", F.posexplode("texts").alias("i", "text"))
        return flat.join(table.select(F.col("n").alias("m")).distinct(), F.col("n") == F.col("m")).select(at(F.col("i")), "text")
    if how == "twice":
        flat = f"{folder}/flat"
        table.select("n", F.posexplode("texts").alias("i", "text")).select(at(F.col("i")), "text").write.parquet(flat)
        return spark.read.parquet(flat, flat).distinct().repartition(5)
    return table.select("n", F.posexplode("texts").alias("i", "text")).select(at(F.col("i")), "text").repartition(3)


HOW = ["explode", "join", "self-join", "twice", "repartition"]


@pytest.mark.parametrize("how", HOW)
def test_numbers_are_distinct(spark, tmp_path, how):
    docs = made(spark, tmp_path, how)
    assert numbered(docs, "row").select("row").distinct().count() == 6
    assert numbered(docs.unionByName(docs), "row").select("row").distinct().count() == 12


def test_a_file_named_twice(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    assert numbered(spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/t"), "row").select("row").distinct().count() == spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/t").count()


def test_rows_of_a_scan_are_not_written(spark, tmp_path):
    spark.createDataFrame([(k, "a") for k in range(9)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t").filter("doc_id > 1").select("doc_id", "text")
    found = numbered(scan, "row")
    assert found.select("row").distinct().count() == 7
    assert f"{tmp_path}/t" in found.inputFiles()[0]
    clash = numbered(scan.withColumn("_metadata", F.lit(1)), "row")
    assert clash.select("row").distinct().count() == 7 and clash.columns == ["doc_id", "text", "_metadata", "row"]


@pytest.mark.parametrize("how", HOW)
def test_operators_on_tables_of_repeated_file_rows(spark, tmp_path, how):
    docs = made(spark, tmp_path, how)
    lines = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    assert lines == {10: CLEAN, 11: BAD, 12: LINES, 20: OTHER, 21: OTHER + " x", 22: ""}
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [10, 11, 12, 20]
    bench = spark.createDataFrame([(1, BAD)], "item_id long, text string")
    assert sorted(r.doc_id for r in without_contaminated(docs, bench).collect()) == [10, 12, 20, 21, 22]
    assert {r.doc_id: r.n_hit for r in contamination(docs, bench).collect()} == {10: 0, 11: 30, 12: 0, 20: 0, 21: 0, 22: 0}
    cut = {r.doc_id: r.text for r in without_spans(docs, bench).collect()}
    assert cut == {10: CLEAN, 11: "", 12: LINES, 20: OTHER, 21: OTHER + " x", 22: LINES}

"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations.

Every partition of the input is a run of (digest, best row) pairs, which is sorted by
digest and counted together.  In each round the runs whose numbers agree but for the
lowest digit (base ``fan_in``; 2, the default, gives binomial rounds) exchange their
pairs and are merged in sorted order: of equal digests the best row and the summed
count are retained.  Rounds go on until one run is left, spread over the cluster by
digest, never in one task.  A larger ``fan_in`` merges more runs in fewer rounds, each
of which moves the distinct texts' pairs once.  Equality is that of SHA-256 and of the
length of the normalised text.

Of equal texts the row with the most code points stays, then the smallest id (a
null id comes last), then the earliest row, so that exactly one of repeated rows
stays.  A null text counts as empty; all texts without a visible character are
equal.  An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, two_columns


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: its run and number, id, digest and sizes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = two_columns(docs, id_col, text_col).select(
        "doc_id", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), F.char_length(text).alias("n_chars"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("bare")
    )
    return bare.select("doc_id", "run", "row", "n_chars", F.unhex(F.sha2("bare", 256)).alias("digest"), F.octet_length("bare").alias("n_bytes"))


def merged_runs(rows: DataFrame, n_runs: int, fan_in: int = 2) -> DataFrame:
    """``digest, n_bytes, best, n``: one row for each distinct text."""
    best = F.struct((-F.col("n_chars")).alias("least"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    runs = rows.select("run", "digest", "n_bytes", best.alias("best"), F.lit(1).cast("long").alias("n"))
    while True:
        n_runs = -(-n_runs // fan_in)
        last = n_runs <= 1
        keys = ["digest", "n_bytes"] if last else ["run", "digest", "n_bytes"]
        runs = runs.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy(*keys).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        if last:
            return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of docs."""
    rows = saved(digests(docs, id_col, text_col))
    # saved, so that both sides of the join are dealt anew and a hot digest can be split
    groups = saved(merged_runs(rows, rows.rdd.getNumPartitions(), fan_in).select("digest", "n_bytes", "best", "n"))
    return rows.join(groups, ["digest", "n_bytes"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )

"""Bounded samples of labelled texts, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, written

#: Steps in which the order of a label's rows is cut.
BINS = 4096


def _place(*columns: str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def class_sample(docs: DataFrame, labelled: DataFrame, per_class: int, total: int, folds: int, fold: int = 2, max_bytes: int = 64 << 20, longest: int = 1 << 20) -> list[tuple[str, object]]:
    """(text, label) of distinct rows of ``docs`` (doc_id, text) whose ids ``labelled``
    (doc_id, label) gives a label, outside the fold, in the order of ids and texts.

    There are at most per_class rows and an even share of ``total`` and of max_bytes of
    text for each label; texts over ``longest`` bytes aren't taken, nor rows without an
    id or a label; if there are more than ``total`` labels, the most frequent count.
    Labels' ids are counted first; only ids whose hash falls into a share that gives each
    label somewhat more than it needs meet the texts; from counts and bytes by steps of
    a second hash follows where each label is cut.  So no task ranks a label's rows, and
    a repeated id takes no more room than others."""
    spark = docs.sparkSession
    able = labelled.select("doc_id", "label").filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    counts = able.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.desc("n"), "label").limit(total)
    known = counts.collect()
    if not known:
        return []
    rows, size = max(1, min(per_class, total // len(known))), max_bytes // len(known)
    shares = F.broadcast(spark.createDataFrame(known, counts.schema).withColumn("share", F.lit(1.5 * (rows + 20)) / F.col("n")))
    near = able.join(shares, "label").filter(_place("doc_id") <= F.col("share")).select("doc_id", "label").distinct()  # some 1.5 x total
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    met = written(texts.join(F.broadcast(near), "doc_id").distinct().withColumn("bin", F.floor(_place("text", "doc_id") * BINS).cast("int")))
    steps = met.groupBy("label", "bin").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    cut, sums = {}, {}
    for r in sorted(steps.collect(), key=lambda r: r.bin):
        n, b = sums.get(r.label, (0, 0))
        sums[r.label] = n, b = n + r.n, b + r.bytes
        if n <= rows and b <= size and cut.get(r.label, BINS) == BINS:
            continue
        cut[r.label] = min(cut.get(r.label, BINS), r.bin)
    cuts = spark.createDataFrame([(r.label, cut.get(r.label, BINS)) for r in known], f"label {counts.schema['label'].dataType.simpleString()}, cut int")
    found = met.join(F.broadcast(cuts), "label").filter("bin < cut").select("doc_id", "text", "label").collect()
    return [(r.text, r.label) for r in sorted(found, key=lambda r: (r.doc_id, r.text))]

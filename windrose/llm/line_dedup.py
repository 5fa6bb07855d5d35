"""Line deduplication over overlapping windows of three lines.

Lines are what line feeds part.  A window is three consecutive lines of a text.
Of windows with the same three lines, the first in the order of ids (a null id
comes last), rows and positions stays; every line that a later one covers is
removed, whatever else covers it.  Windows are compared by 128 bits of hash;
only hashes that occur more than once are kept, with their first place, and
meet the windows in a join that can be split where a hash is hot.

Equal ids are ordered by row: file and place in it, or place in the table.  Texts of
fewer than three lines have no window and stay as they are; a null text
stays null.  Repeated rows count as copies.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, saved

#: Columns that are added for a while; names that no table should have.
_ROW, _LATER = "__line_dedup_row", "__line_dedup_later"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``at`` (place in the order), ``h1, h2`` of each window."""
    base = docs.select(F.col(_ROW), F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(_ROW).alias("row")).alias("doc"), _lines(F.col(text_col)).alias("lines")).filter(F.size("lines") >= 3)
    hashed = base.select("doc", F.size("lines").alias("n"), F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit(3), x)).alias("b"))
    at = hashed.select("doc", "a", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 3)).alias("i"))
    three = lambda c: [F.get(c, F.col("i") + k) for k in range(3)]
    return at.select(F.struct("doc.no_id", "doc.id", "doc.row", "i").alias("at"), F.xxhash64(*three("a")).alias("h1"), F.xxhash64(*three("b")).alias("h2"))


def later_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row and the first lines of its later windows, as an array."""
    windows = _windows(docs, id_col, text_col)
    first = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    later = windows.join(saved(first), ["h1", "h2"]).filter(F.col("at") != F.col("first"))
    return later.groupBy(F.col("at.row").alias(_ROW)).agg(F.collect_list("at.i").alias(_LATER))


def _kept(text_col: str):
    """The lines that stay; null where no window of the text goes.  Removed ranges of
    lines, in order, leave slices between them, so that every line is handled once."""
    lines = _lines(F.col(text_col))
    starts = F.array_sort(F.array_distinct(_LATER))
    after = lambda i: F.get(starts, i)
    slices = F.transform(starts, lambda g, i: F.slice(lines, g + 4, F.greatest(F.coalesce(after(i + 1), F.size(lines)) - g - 3, F.lit(0))))
    return F.concat(F.slice(lines, 1, F.get(starts, F.lit(0))), F.flatten(slices))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts that stay, all columns in place."""
    rows = numbered(docs, _ROW)
    met = rows.join(later_windows(rows, id_col, text_col), _ROW, "left")
    text = F.when(F.col(_LATER).isNull(), F.col(text_col)).otherwise(F.array_join(_kept(text_col), "\n"))
    return met.withColumn(text_col, text).select(*docs.columns)


def line_dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` for each row of docs."""
    size = lambda c: F.size(_lines(c))
    rows = numbered(docs, _ROW).select(_ROW, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), size(F.col(text_col)).alias("n_lines"))
    met = rows.join(later_windows(rows, "doc_id", "text"), _ROW, "left")
    kept = met.select("doc_id", "n_lines", F.when(F.col(_LATER).isNull(), _lines(F.col("text"))).otherwise(_kept("text")).alias("kept"))
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))

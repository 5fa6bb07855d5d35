"""Benchmark decontamination with a broadcast hash set, in DataFrame operations.

Words are what ``WORD`` matches after lower-casing A-Z.  A window is ``n``
consecutive words of an item, or a shorter item as a whole.  The hash set holds
4-gram hashes taken from every item at a stride such that each window has one
(shorter windows: the hash of all their words).  It is broadcast as the hash table of a
join, which every gram of every document is looked up in as it is scanned; grams that
aren't in it go no further.  Where one is, the windows around it are compared with the
benchmark's as strings, so a hash collision never counts.

The set's size is counted: up to ``max_set`` entries of 16 bytes or so are broadcast, and
a larger set goes in as many parts, each a scan of the documents whose hits are written
before the next part is sent.  Nothing of the set passes through the driver but what
Spark broadcasts, and nothing of the documents is shuffled but hits and candidate windows.
Windows are broadcast while they are at most ``max_windows`` and ``max_bytes`` of text,
and otherwise join the candidates.

Null and empty texts have no words, are never contaminated and are kept; items
without words have no windows; repeated documents or items count as such.
Either table may be empty.  Other columns than the ids and texts aren't read.  The scans
run while the result is being built.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, spread, written

#: Between words: any ASCII character that is neither a digit nor a small letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a hashed gram.
GRAM = 4


def words(text: Column) -> Column:
    """The words of a text as an array."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.split(F.coalesce(low, F.lit("")), SEPARATORS)


def _trimmed(parts: Column) -> Column:
    """The array without an empty first or last string."""
    first = (F.get(parts, F.lit(0)) == "").cast("int")
    last = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def _paired(left: Column, right: Column, shift: int, width: Column) -> Column:
    """Hashes of left[i] and right[i + shift], ``width`` of them."""
    n = F.greatest(width, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, 1 + shift, n), lambda a, b: F.xxhash64(a, b))


def gram_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (which has ``words``) with the arrays h1 .. h4 that the lengths need: in
    hk, at i, the hash of the k words from i on."""
    df = df.withColumn("n_words", F.size("words")).withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.col("n_words")
    if max(lengths) >= 2:
        df = df.withColumn("h2", _paired(F.col("h1"), F.col("h1"), 1, n - 1))
    if 3 in lengths:
        df = df.withColumn("h3", _paired(F.col("h2"), F.col("h1"), 2, n - 2))
    if 4 in lengths:
        df = df.withColumn("h4", _paired(F.col("h2"), F.col("h2"), 2, n - 3))
    return df


def _windows(items: DataFrame, n: int) -> DataFrame:
    """``item, at, len, window`` for each window of each item."""
    size = F.least(F.col("n_words"), F.lit(n))
    starts = F.sequence(F.lit(0), F.col("n_words") - size)
    return items.filter("n_words > 0").select("item", "words", size.alias("len"), F.explode(starts).alias("at")).select("item", "at", "len", F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " ").alias("window"))


def _grams(hashed: DataFrame, sizes: list[int]) -> DataFrame:
    """``row, k, i, x``: the hash of the k words from i on, for each size k."""
    each = lambda k: F.transform(f"h{k}", lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("i"), x.alias("x")))
    every = F.concat(*map(each, sizes)) if len(sizes) > 1 else each(sizes[0])
    return hashed.select("row", F.explode(every).alias("g")).select("row", "g.k", "g.i", "g.x")


def _around(spans: dict[int, list[tuple[int, int]]]) -> Column:
    """Of a hit ``k, i``: starts and lengths of the windows that may hold it."""
    steps = lambda size, back: F.transform(F.sequence(F.lit(0), F.lit(back)), lambda s: F.struct((F.col("i") - s).alias("at"), F.lit(size).alias("len")))
    found = F.lit(None).cast("array<struct<at:int,len:int>>")
    for k, own in spans.items():
        found = F.when(F.col("k") == k, F.concat(*(steps(*span) for span in own))).otherwise(found)
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, max_set: int = 2_000_000, max_windows: int = 200_000, max_bytes: int = 64 << 20, row_col: str | None = None, hit_only: bool = False) -> DataFrame:
    """``doc_id, row, n_words, n_hit, items, spans`` for each row of docs, or for those
    with an occurring window only; items: sorted ids, as strings, of the items with one;
    spans: structs of ``at`` and ``len``, in words; row: row_col, else a number."""
    if n < GRAM:
        raise ValueError(f"n must be {GRAM} at least")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("parts")).select("item", _trimmed(F.col("parts")).alias("words"))
    items = gram_hashes(items, [1, 2, 3, 4]).filter("n_words > 0")
    stride = n - GRAM + 1
    picks = F.filter(F.transform("h4", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s.i % stride == 0)
    short = F.when(F.col("n_words") >= GRAM, F.slice("h4", 1, 1)).when(F.col("n_words") == 3, F.col("h3")).when(F.col("n_words") == 2, F.col("h2")).otherwise(F.col("h1"))
    len_ = F.least(F.col("n_words"), F.lit(n))
    marks = written(items.select(len_.alias("len"), F.explode(F.when(F.col("n_words") >= n, F.transform(picks, lambda s: s.x)).otherwise(short)).alias("x")).distinct())
    lengths = {r.len: r.n for r in marks.groupBy("len").agg(F.count("*").alias("n")).collect()}  # n of them at most
    spans: dict[int, list[tuple[int, int]]] = {}
    for size in sorted(lengths):
        spans.setdefault(min(size, GRAM), []).append((size, stride - 1 if size == n else 0))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    source = spread(picked if row_col else numbered(picked, "row"))
    split = lambda df, *columns: df.select(*columns, words(F.col("text")).alias("parts")).select(*columns, _trimmed(F.col("parts")).alias("words"))
    base = split(source, "doc_id", "row")
    counted = base.select("doc_id", "row", F.size("words").alias("n_words"))
    hits = None
    n_parts = -(-sum(lengths.values()) // max_set)
    for part in range(n_parts):
        own = marks.filter(F.pmod(F.xxhash64("x"), F.lit(n_parts)) == part).select(F.least("len", F.lit(GRAM)).alias("k"), "x").distinct()  # some max_set rows
        met = _grams(gram_hashes(base, sorted(spans)), sorted(spans)).join(F.broadcast(own), ["x", "k"], "left_semi")
        here = written(met.select("row", "k", "i"))
        hits = here if hits is None else hits.unionByName(here)
    if hits is None:
        none = F.lit(None)
        counted = counted.limit(0) if hit_only else counted
        return counted.select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.coalesce(none.cast("array<string>"), F.array()).alias("items"), F.coalesce(none.cast("array<struct<at:int,len:int>>"), F.array()).alias("spans"))
    tried = written(hits.select("row", F.explode(_around(spans)).alias("c")).filter("c.at >= 0").groupBy("row").agg(F.collect_set("c").alias("found")))
    window = lambda c: F.struct(c.at.alias("at"), c.len.alias("len"), F.array_join(F.slice("words", c.at + 1, c.len), " ").alias("window"))
    few = lambda df, array: (lambda r: r.n <= max_windows and r.size <= max_bytes // 16)(df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(array)), F.lit(0)).alias("size")).first())
    if few(tried, "found"):
        tried = F.broadcast(tried)
    fits = F.filter("found", lambda c: c.at + c.len <= F.size("words"))
    texts = split(source.join(tried, "row"), "row", "found").select("row", F.explode(F.transform(fits, window)).alias("c")).select("row", "c.*")
    windows = written(_windows(items, n).select("item", F.col("len").alias("w_len"), F.col("window").alias("w")).distinct())
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("w")), F.lit(0)).alias("bytes")).first()
    if size.n <= max_windows and size.bytes <= max_bytes:
        windows = F.broadcast(windows)
    same = texts.join(windows, (F.col("window") == F.col("w")) & (F.col("len") == F.col("w_len")))
    found = written(same.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct(F.greatest(a.end, s.at + s.len).alias("end"), (a.n + F.greatest(s.at + s.len - F.greatest(a.end, s.at), F.lit(0))).alias("n")), lambda a: a.n)
    if few(found, "spans"):
        found = F.broadcast(found)
    if hit_only:
        out = split(source.join(found, "row"), "doc_id", "row", "items", "spans").withColumn("n_words", F.size("words"))
    else:
        out = counted.join(found, "row", "left").withColumns({"items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast("array<struct<at:int,len:int>>"))})
    return out.select("doc_id", "row", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), "items", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **kw) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, row``;
    contaminated: at least one word in ``share`` is hit."""
    found = find_contamination(docs, benchmark, **kw)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "row",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    name = "__contaminated_row"
    rows = numbered(docs, name)
    # written, so that its size is known: a small one is broadcast and texts stay where they are
    bad = written(contamination(rows, benchmark, id_col=id_col, row_col=name, hit_only=True, **kw).filter("contaminated").select(F.col("row").alias(name)))
    return rows.join(bad, name, "left_anti").select(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs, all columns and rows, with the hit words and what lies between them cut
    from the texts; the rest of a text stays as it is, and a null text null."""
    name, spans = "__contaminated_row", "__contaminated_spans"
    rows = numbered(docs, name)
    found = find_contamination(rows, benchmark, text_col=text_col, row_col=name, hit_only=True, **kw).filter("n_hit > 0").select(F.col("row").alias(name), F.col("spans").alias(spans))
    # words and what is between them in turn; A-Z are word characters here
    between = SEPARATORS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"{between}|{between.replace('[', '[^', 1)}"), F.lit(0))
    lead = F.col(text_col).rlike("^" + between).cast("int")
    kept = F.filter(parts, lambda p, i: ~F.exists(spans, lambda s: (i >= 2 * s.at + lead) & (i <= 2 * (s.at + s.len - 1) + lead)))
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    return rows.join(found, name, "left").withColumn(text_col, text).select(*docs.columns)

"""Token counts by a two-tier, map-side lookup of pre-token lengths.

Tier one is a table of the corpus's most frequent pre-tokens with their lengths
in tokens.  It is found by one pass over all documents: each task keeps bounded
lossy counts and reports its few thousand heaviest entries as one row; these summaries
are merged in a tree, ``fan_in`` at a time, and cut after each merge to what the table
holds.  It has at most ``frequent`` entries of at most ``KEPT`` characters, so its broadcast is
bounded whatever the corpus.  Tier two is a cache in each worker, bounded in bytes, that
holds what the first tier misses, encoded by the tokenizer library in batches.  Longer
chunks, as in scripts without spaces, are encoded and not kept.  Which entries a tier
holds changes the speed and never a count, so nothing is lost by the bounds, and no
pre-token is shuffled; only the summaries are.

Texts are cut where the byte-level pattern must start a new pre-token: before a
space or a line feed that a visible character of any script follows.  Anywhere else, as
in runs of white space, the text stays whole and the library cuts it.

Null and empty texts have no tokens; every row is kept, repeated rows too; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, two_columns

#: What surely is a visible character, whatever a pattern takes for white space.
_VISIBLE = "[^\\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
_UNSURE = re.compile(f"[ \n](?!{_VISIBLE})")
_SURE = re.compile(f" (?={_VISIBLE})")
#: Characters of the longest chunk that is kept.
KEPT = 64
#: Bytes that a cache entry takes beside its characters.
_ENTRY = 180


def chunks(text: str) -> list[str]:
    """Parts of a text that the pattern never joins.  A part that starts with a
    line feed has one too many (the first) or its own; others follow a space."""
    if _UNSURE.search(text):
        first, *rest = _SURE.split(text)
        return ["\n" + first, *(x if x[0] != "\n" else " " + x for x in rest)]
    return ("\n" + text).replace("\n", " \n").split(" ")[1:]


def _source(chunk: str) -> str:
    return chunk[1:] if chunk[0] == "\n" else " " + chunk


class PreTokenLengths:
    """Lengths by chunk: the frequent ones for good, others until they take ``room`` bytes."""

    def __init__(self, tokenizer_path: str, frequent: dict[str, int], room: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.frequent, self.room, self.known, self.held = frequent, room, dict(frequent), 0

    def encoded(self, parts: list[str]) -> list[int]:
        """Each chunk's length; a chunk's own line feed counts as one token."""
        out = self.tokenizer.encode_batch_fast([_source(x) for x in parts], add_special_tokens=False)
        return [len(e.ids) + (x[0] == "\n") for x, e in zip(parts, out, strict=True)]

    def count(self, texts: list[str | None]) -> list[int]:
        split = [chunks(t) if t else [] for t in texts]
        if self.held > self.room:
            self.known, self.held = dict(self.frequent), 0
        parts = list(set().union(*split).difference(self.known))
        self.known.update(zip(parts, self.encoded(parts), strict=True))
        look = self.known.__getitem__
        out = [sum(map(look, x)) - 1 if x else 0 for x in split]
        for part in parts:
            if len(part) > KEPT:
                del self.known[part]
            else:
                self.held += _ENTRY + 2 * len(part)
        return out


_SUMMARY = "part long, chunks array<string>, counts array<long>"


def _summary(part: int, counts: Counter, report: int) -> pa.RecordBatch:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:report]
    return pa.record_batch(
        {"part": pa.array([part], pa.int64()), "chunks": pa.array([[k for k, _ in top]], pa.list_(pa.string())), "counts": pa.array([[v for _, v in top]], pa.list_(pa.int64()))}
    )


def _heavy(capacity: int, report: int):
    """Each task's most frequent chunks, by lossy counts in bounded memory."""

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                if text := t.as_py():
                    own = chunks(text)
                    counts.update(own if max(map(len, own)) <= KEPT else [x for x in own if len(x) <= KEPT])
                if len(counts) > capacity:
                    least = 1
                    while len(counts) > capacity // 2:
                        counts = Counter({k: v for k, v in counts.items() if v > least})
                        least *= 2
        yield _summary(TaskContext.get().partitionId(), counts, report)

    return run


def _merged(report: int):
    """One summary of those with the same part, which come one after another."""

    def run(batches):
        part, counts = None, Counter()
        for batch in batches:
            for p, keys, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is not None and p != part:
                    yield _summary(part, counts, report)
                    counts = Counter()
                part = p
                for k, v in zip(keys, values, strict=True):
                    counts[k] += v
        if part is not None:
            yield _summary(part, counts, report)

    return run


def frequent_chunks(docs: DataFrame, text_col: str = "text", frequent: int = 32_768, capacity: int = 200_000, fan_in: int = 16, report: int = 4096) -> list[str]:
    """The chunks that tasks report most often over all documents, at most ``frequent``;
    each task reports its ``report`` heaviest."""
    texts = docs.select(F.col(text_col).alias("text"))
    found, parts = texts.mapInArrow(_heavy(capacity, min(report, frequent)), _SUMMARY), texts.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        found = found.withColumn("part", F.floor(F.col("part") / fan_in)).repartition("part").sortWithinPartitions("part").mapInArrow(_merged(frequent), _SUMMARY)
    return sorted({x for r in found.select("chunks").collect() for x in r.chunks})


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, frequent: int = 32_768, room: int = 96 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of docs.

    limit: n_tokens above it are over; frequent: entries of the broadcast table;
    room: bytes of a worker's cache."""
    spark = docs.sparkSession
    top = frequent_chunks(docs, text_col, frequent)
    lengths = dict(zip(top, PreTokenLengths(tokenizer_path, {}, 0).encoded(top), strict=True))
    table = spark.sparkContext.broadcast(lengths)

    def make():
        counter = PreTokenLengths(tokenizer_path, table.value, room)

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            n = counter.count(texts)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            return pa.record_batch({"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

        return count

    picked = two_columns(docs, id_col, text_col)
    return picked.mapInArrow(by_slice(make), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")

"""Substring deduplication: words in windows that occur more than once are removed.

The documents are stored once as compressed slices.  Then:

1. Count-min prefilter.  Each slice sketches its windows in two rows of counters by
   independent hashes: the sorted counter positions and which of them it counts twice
   itself.  Slices' sketches are merged by ranges of counters, where each counter adds
   up what the slices have, and each slice gets back, as bits, which of its counters
   reach two.  A window's estimate is the minimum of its two counters, which can only
   overestimate, so no repeated window is lost.  There are ``spare`` counters to a
   window in each row, whatever the number of windows, in ranges of a fixed size, so
   neither a task nor a broadcast grows with them.
2. Exact groups.  Only windows estimated repeated are compared, by 128 bits of BLAKE2b
   of their words, one row for each distinct window of a slice; a slice gets back
   which of them occur elsewhere or, as it knows itself, twice in the slice.  A window
   in a third of all documents is one row for each slice at most.
3. Each slice removes the words that its repeated windows cover.

Null and empty texts have no words.  A text of fewer words than a window keeps
them all.  Repeated rows repeat each other's windows.  An empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, two_columns
from .windows import Words, buffers

#: Rows of counters.
ROWS = 2


class Size(NamedTuple):
    """Words in a window; counters in a row and in a range of it, as powers of two.
    Where sketches are merged, a range takes a byte for each of its counters."""

    n: int
    counter_bits: int
    range_bits: int


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def sliced(docs: DataFrame, n: int, size: int) -> DataFrame:
    """``blob, n_windows``: docs (doc_id, text) in compressed slices."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", size):
                if part.num_rows:
                    counts = Words(*buffers(part.column(1))).counts
                    yield pa.record_batch({"blob": pa.array([_packed(part)], pa.binary()), "n_windows": pa.array([int(np.maximum(counts - n + 1, 0).sum())], pa.int64())})

    return docs.mapInArrow(run, "blob binary, n_windows long")


def gaps(sorted_values: np.ndarray) -> bytes:
    """Ascending distinct numbers from 0 as steps of seven bits a byte, lowest first;
    all bytes of a step but the last have their high bit set."""
    step = np.diff(sorted_values.astype(np.int64), prepend=-1) - 1
    size = np.ones(len(step), np.int64)
    for k in range(1, 9):
        size += step >= 1 << 7 * k
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[at[own] + k] = (step[own] >> 7 * k & 127) | (size[own] > k + 1) * 128
    return out.tobytes()


def from_gaps(blob: bytes) -> np.ndarray:
    data = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    step = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)
    return np.cumsum(step + 1) - 1


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class Sketch:
    """A slice's windows and their counters."""

    def __init__(self, blob: bytes, size: Size):
        self.batch, self.size = _unpacked(blob), size
        self.words = Words(*buffers(self.batch.column(1)))
        self.first, hashes = self.words.windows(size.n, ROWS)
        #: Of each row: its counters in order, which count twice, and each window's counter.
        self.rows = []
        for h in hashes:
            counters, of, times = np.unique(h >> np.uint64(64 - size.counter_bits), return_inverse=True, return_counts=True)
            self.rows.append((counters.astype(np.int64), times > 1, of))

    def parts(self):
        """Row, number and bounds of each range of counters that the slice has."""
        ranges = 1 << max(0, self.size.counter_bits - self.size.range_bits)
        for k, (counters, _, _) in enumerate(self.rows):
            part = counters >> self.size.range_bits
            edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(part)], strict=False):
                yield k, k * ranges + int(part[a]), a, b

    def likely(self, answers: list[dict]) -> np.ndarray:
        """First words of the windows of which both counters reach two."""
        by = {x["part"]: x["answer"] for x in answers or ()}
        high = [np.zeros(len(counters), bool) for counters, _, _ in self.rows]
        for k, part, a, b in self.parts():
            high[k][a:b] = from_bits(by[part], b - a)
        return self.first[np.logical_and.reduce([high[k][of] for k, (_, _, of) in enumerate(self.rows)])]

    def distinct(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct windows among those at the given words, as sorted digests, how
        often each occurs here, and which each of the given is."""
        return in_groups(self.words.digests(first, self.size.n))


def in_groups(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, their counts, and the number of each row among them."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    own = digests[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]).any(1)
    group = np.empty(len(own), np.int64)
    group[order] = np.cumsum(new) - 1
    return own[new], np.bincount(group, minlength=int(new.sum())), group


def _ask(size: Size):
    def run(batches):
        for batch in batches:
            for sid, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Sketch(blob.as_py(), size)
                rows = [(sid, part, gaps(s.rows[k][0][a:b] & (1 << size.range_bits) - 1), bits(s.rows[k][1][a:b])) for k, part, a, b in s.parts()]
                if rows:
                    yield _rows(rows, ("sid", pa.int64()), ("part", pa.int64()), ("counters", pa.binary()), ("twice", pa.binary()))

    return run


def _rows(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[k for k, _ in fields])


def _by_key(batches, key: int):
    """For rows sorted by a key column: the rows of each key."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _merge_sketches(size: Size):
    """Adds up the counters of each range; answers which reach two."""

    def run(batches):
        for rows in _by_key(batches, 1):
            total = np.zeros(1 << min(size.range_bits, size.counter_bits), np.uint8)
            for _, _, counters, twice in rows:
                at = from_gaps(counters)
                total[at] = np.minimum(total[at] + 1 + from_bits(twice, len(at)), 2)
            yield _rows([(sid, part, bits(total[from_gaps(counters)] > 1)) for sid, part, counters, _ in rows], ("sid", pa.int64()), ("part", pa.int64()), ("answer", pa.binary()))

    return run


def _offer(size: Size, buckets: int):
    """The windows that are estimated repeated, by ranges of their digests."""

    def run(batches):
        for batch in batches:
            for sid, blob, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = Sketch(blob.as_py(), size)
                own, times, _ = s.distinct(s.likely(answers))
                bucket = ((own[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                rows = [(sid, int(bucket[a]), own[a:b].tobytes(), bits(times[a:b] > 1)) for a, b in zip(edges, [*edges[1:], len(bucket)], strict=False)]
                if rows:
                    yield _rows(rows, ("sid", pa.int64()), ("bucket", pa.int64()), ("digests", pa.binary()), ("twice", pa.binary()))

    return run


def _group(batches):
    """Of the windows of a bucket: which occur twice in a slice or in two slices."""
    for rows in _by_key(batches, 1):
        sizes = [len(r[2]) // 16 for r in rows]
        twice = np.concatenate([from_bits(r[3], k) for r, k in zip(rows, sizes, strict=True)])
        _, times, group = in_groups(np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(-1, 2))
        repeated = (times > 1) | (np.bincount(group, weights=twice) > 0)
        found = repeated[group]
        at = np.cumsum([0, *sizes])
        yield _rows([(r[0], r[1], bits(found[a:b]), int(b - a)) for r, a, b in zip(rows, at[:-1], at[1:], strict=True)], ("sid", pa.int64()), ("bucket", pa.int64()), ("found", pa.binary()), ("n", pa.int64()))


def _remove(size: Size, keep_text: bool):
    def run(batches):
        for batch in batches:
            for blob, answers, found in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = Sketch(blob.as_py(), size)
                first = s.likely(answers)
                if found:
                    repeated = np.concatenate([from_bits(x["found"], x["n"]) for x in sorted(found, key=lambda x: x["bucket"])])
                    first = first[repeated[s.distinct(first)[2]]]
                gone = s.words.covered(first, size.n)
                data, at = s.words.kept_texts(gone)
                view, ends = memoryview(data), at.tolist()
                out = {
                    "doc_id": s.batch.column(0),
                    "n_words": pa.array(s.words.counts, pa.int64()),
                    "n_removed": pa.array(np.bincount(s.words.doc, weights=gone, minlength=len(at) - 1).astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string()),
                }
                if keep_text:
                    out["kept"] = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(data.tobytes()))
                yield pa.record_batch(out)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 35, spare: int = 8, keep_text: bool = True, slice_bytes: int = 4 << 20, range_bits: int = 25, bucket: int = 2_000_000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of docs, and with
    keep_text ``kept``, the words that stay joined by a space.

    spare: counters to a window in each row; slice_bytes: of text in a slice; bucket:
    windows that are grouped at a time."""
    picked = two_columns(docs, id_col, text_col)
    parts = saved(sliced(picked, n, slice_bytes).withColumn("sid", F.monotonically_increasing_id()))
    windows = parts.agg(F.coalesce(F.sum("n_windows"), F.lit(0))).first()[0]
    counter_bits = min(62, max(16, int(spare * windows).bit_length()))
    size = Size(n, counter_bits, range_bits)
    buckets = max(64, windows // bucket)
    parts = parts.select("sid", "blob")
    asked = parts.mapInArrow(_ask(size), "sid long, part long, counters binary, twice binary")
    answered = saved(asked.repartition("part").sortWithinPartitions("part").mapInArrow(_merge_sketches(size), "sid long, part long, answer binary"))
    by_slice = answered.groupBy("sid").agg(F.collect_list(F.struct("part", "answer")).alias("answers"))
    likely = parts.join(by_slice, "sid", "left").select("sid", "blob", "answers")
    rows = likely.mapInArrow(_offer(size, buckets), "sid long, bucket long, digests binary, twice binary")
    found = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_group, "sid long, bucket long, found binary, n long")
    found = found.groupBy("sid").agg(F.collect_list(F.struct("bucket", "found", "n")).alias("found"))
    done = likely.join(found, "sid", "left").select("blob", "answers", "found")
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return done.mapInArrow(_remove(size, keep_text), schema + ", kept string" * keep_text)

"""Language-model scores from a hidden Markov model trained on the corpus.

Tokens are words (A-Z lower-cased) and one end a document.  Their counts over
all training documents give the base score, an add-one unigram model.  The
hidden Markov model emits symbols: a frequent word, or one of a fixed number of
word shapes (length, final mark, first letter beyond ASCII), after which the
word follows in proportion to its base probability within the shape, one unseen
word of each shape included.  So both are distributions over the same texts.

Baum-Welch runs over all training documents as whole texts: partitions sum expected
counts, the sums meet by block of symbols in a tree of ``fan_in`` at a time, and the
driver reads one row of each block.  Rounds go on until the likelihood of a token
gains less than ``least``, which it must, since it has an upper bound.  A few documents
give only the starting point.  A text's score is the exact log10
likelihood by the scaled forward recursion over the whole text, plus its words'
shares in their shapes.

Counts of the ``known`` most frequent words are broadcast; those of other words
meet the documents' words in a join, which no frequent word enters.

Null and empty texts consist of their end.  Repeated rows repeat in the counts;
a null id is never held out.  Without training documents every token is unknown
and the score is the base score.  An empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections import Counter
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, held_out, slices, two_columns, written
from .hmm import Counts, Hmm, first_model

#: Word shapes: 4 lengths x 2 final marks x (1 + 16) first letters beyond ASCII.
SHAPES = 4 * 2 * 17
#: Symbols in a row of expected counts.
BLOCK = 1024


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; bytes, so that only A-Z are lower-cased and only ASCII
    blanks part words."""
    return text.encode().lower().split() if text else []


def shape(word: bytes) -> int:
    size = min(3, (len(word) - 1) // 4)
    last = word[-1]
    mark = last < 0x80 and not (0x30 <= last <= 0x39 or 0x61 <= last <= 0x7A)
    high = 0
    if not word.isascii():
        at = next(i for i, b in enumerate(word) if b >= 0x80)
        high = 1 + sum(word[at : at + 2]) % 16
    return (size * 2 + mark) * 17 + high


def word_counts(train: DataFrame, room: int = 300_000) -> DataFrame:
    """``word, n`` over the texts, added up in each task before they are dealt."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def rows():
            return pa.record_batch({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in batches:
            for t in batch.column(0):
                counts.update(tokens(t.as_py()))
                if len(counts) > room:
                    yield rows()
                    counts.clear()
        yield rows()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words with their counts, the first ``symbols`` of them
    with symbols of their own; shapes and the end follow."""

    def __init__(self, words: list[bytes], counts: list[int], symbols: int):
        self.at = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        self.symbols = min(symbols, len(words))
        self.end = self.symbols + SHAPES
        self.size = self.end + 1
        # of words that are counted here and emitted by shape
        self.shape = np.array([i if i < self.symbols else self.symbols + shape(w) for i, w in enumerate(words)], np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols with the end, the places of the known words, and the other words."""
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        out = np.empty(len(words) + 1, np.uint16)
        out[-1] = self.end
        known = at >= 0
        out[:-1][known] = self.shape[at[known]]
        other = [words[i] for i in np.flatnonzero(~known).tolist()]
        if other:
            out[:-1][~known] = [self.symbols + shape(w) for w in other]
        return out, at[known], other


def encoded(docs: DataFrame, vocabulary, total: float, ends: int) -> DataFrame:
    """``row, doc_id, held_out, symbols, n_known, base, part, other`` of docs: base
    sums the known tokens' log10(c + 1), part the known but not emitted words'
    log10((c + 1) / total), other holds the rest of the words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v = vocabulary.value
        log = np.log10(v.counts + 1.0)
        part_of = np.where(np.arange(len(v.counts)) < v.symbols, 0.0, log - np.log10(total))
        for batch in batches:
            for piece in slices(batch, "text"):
                symbols, n_known, base, part, others = [], [], [], [], []
                for t in piece.column(piece.schema.get_field_index("text")):
                    s, at, other = v.encode(tokens(t.as_py()))
                    symbols.append(s.tobytes())
                    n_known.append(len(at) + (ends > 0))
                    base.append(float(log[at].sum() + np.log10(ends + 1)))
                    part.append(float(part_of[at].sum()))
                    others.append(other)
                yield pa.record_batch(
                    {
                        "row": piece.column("row"), "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "symbols": pa.array(symbols, pa.binary()),
                        "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base, pa.float64()), "part": pa.array(part, pa.float64()), "other": pa.array(others, pa.list_(pa.binary())),
                    }
                )

    return docs.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, symbols binary, n_known long, base double, part double, other array<binary>")


def _symbols(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b.as_buffer(), np.uint16) for b in batch.column("symbols")]


def expected_counts(train: DataFrame, model: Hmm, fan_in: int = 64) -> Counts:
    """The expected counts of all training documents (column ``symbols``) under the model."""
    n_symbols, n_states = model.emit.shape
    shared = train.sparkSession.sparkContext.broadcast(model)  # BLOCK-wise tables of a fixed size
    fields = [("part", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())]
    schema = "part long, block int, counts binary"

    def row_batch(rows):
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    def expect(batches):
        counts = Counts(n_states, n_symbols)
        some = False
        for batch in batches:
            for piece in slices(batch, "symbols", 4 << 20):
                counts.add(shared.value, _symbols(piece))
                some = True
        if some:
            part = TaskContext.get().partitionId()
            head = np.concatenate([[counts.log], counts.start, counts.move.ravel()])
            yield row_batch([(part, -1, head.tobytes())] + [(part, k // BLOCK, counts.emit[k : k + BLOCK].astype(np.float32).tobytes()) for k in range(0, n_symbols, BLOCK)])

    def add(batches):
        held, total = None, None
        for batch in batches:
            for part, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = np.frombuffer(blob.as_buffer(), np.float64 if block < 0 else np.float32).astype(np.float64)
                if (part, block) != held:
                    if held is not None:
                        yield row_batch([(*held, total.astype(np.float64 if held[1] < 0 else np.float32).tobytes())])
                    held, total = (part, block), values
                else:
                    total = total + values
        if held is not None:
            yield row_batch([(*held, total.astype(np.float64 if held[1] < 0 else np.float32).tobytes())])

    sums = train.select("symbols").mapInArrow(expect, schema)
    n_parts = train.rdd.getNumPartitions()
    while True:  # of each block, at most fan_in parts meet in a task
        n_parts = -(-n_parts // fan_in)
        sums = sums.withColumn("part", F.floor(F.col("part") / fan_in)).repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(add, schema)
        if n_parts <= 1:
            break
    counts = Counts(n_states, n_symbols)
    for r in sums.collect():
        values = np.frombuffer(r.counts, np.float64 if r.block < 0 else np.float32)
        if r.block < 0:
            counts.log, counts.start, counts.move = values[0], values[1 : n_states + 1], values[n_states + 1 :].reshape(n_states, n_states)
        else:
            counts.emit[r.block * BLOCK : (r.block + 1) * BLOCK] = values.reshape(-1, n_states)
    shared.unpersist()
    return counts


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, states: int = 8, symbols: int = 16_384, known: int = 131_072, rounds: int | None = None, least: float = 0.002, starters: int = 200) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for
    each row of docs.

    symbols, known: frequent words that are emitted, and that are broadcast with
    their counts; rounds: of Baum-Welch at most, where that is wanted; least: gain in log10 of a token's
    likelihood that is worth another round; starters: documents for its start."""
    if not 0 < symbols + SHAPES < 1 << 16:
        raise ValueError(f"symbols must be from 1 to {(1 << 16) - SHAPES - 1}")
    spark = docs.sparkSession
    picked = two_columns(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", folds))
    train = picked.filter(~F.col("held_out"))
    counts = written(word_counts(train))
    n_words, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n_all, total = n_words + ends, float(n_words + ends + n_types + (ends > 0) + 1)
    often = frequent(counts, known)
    top = counts.filter(often).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    vocabulary = Vocabulary(top["word"].to_pylist(), top["n"].to_pylist(), symbols)
    del top
    shared = spark.sparkContext.broadcast(vocabulary)  # at most ``known`` words

    # mass of each shape: its words' base probabilities and that of an unseen one
    def masses(batches):
        v = shared.value
        sums = np.zeros(SHAPES)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v.at.get(w, v.symbols) >= v.symbols:
                    sums[shape(w)] += n + 1
        yield pa.record_batch({"shape": pa.array(np.arange(SHAPES), pa.int32()), "mass": pa.array(sums)})

    mass = np.ones(SHAPES)
    for r in counts.mapInArrow(masses, "shape int, mass double").groupBy("shape").agg(F.sum("mass").alias("mass")).collect():
        mass[r["shape"]] += r.mass
    prior = np.concatenate([vocabulary.counts[: vocabulary.symbols] + 1.0, mass, [ends + 1.0]])
    prior /= prior.sum()
    numbered = picked.withColumn("row", F.monotonically_increasing_id())
    seqs = written(encoded(numbered, shared, total, ends))
    learned = seqs.filter(~F.col("held_out"))
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)  # some more than are needed are sorted, not all
    starter = [np.frombuffer(x, np.uint16) for x in sorted(bytes(r.symbols) for r in learned.filter(share <= 3.0 * starters / max(1, ends)).select("row", "symbols").orderBy(share, "row").limit(starters).collect())]
    model = None
    if starter:
        model = first_model(starter, states, prior)
        for _ in range(6):
            begin = Counts(states, vocabulary.size)
            begin.add(model, starter)
            model = begin.model(prior)
        before = -np.inf
        for _ in count() if rounds is None else range(rounds):
            expected = expected_counts(learned, model)
            model = expected.model(prior)
            now = expected.log / n_all
            if now - before < least:
                break
            before = now
    shares = np.zeros(vocabulary.size)  # log10 of a shape's mass, to be taken off
    shares[vocabulary.symbols : vocabulary.end] = np.log10(mass / total)
    fitted = spark.sparkContext.broadcast((model, shares))
    kind = picked.schema["doc_id"].dataType.simpleString()

    def score(batches):
        m, share = fitted.value
        for batch in batches:
            for piece in slices(batch, "symbols", 4 << 20):
                own = _symbols(piece)
                log = m.log10(own) if m else np.zeros(len(own))
                log = log - np.array([share[s].sum() for s in own])
                yield pa.record_batch({"row": piece.column("row"), "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "n_tokens": pa.array([len(s) for s in own], pa.int64()), "n_known": piece.column("n_known"), "base": piece.column("base"), "part": piece.column("part"), "log": pa.array(log)})

    scored = seqs.select("row", "doc_id", "held_out", "symbols", "n_known", "base", "part").mapInArrow(score, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, part double, log double")
    # words beyond the broadcast table meet their counts
    rare = counts.filter(~often)
    others = seqs.select("row", F.explode("other").alias("word"))
    met = others.join(rare, "word", "left").groupBy("row").agg(
        F.count("n").alias("more_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more_base"), F.count("*").alias("n_other")
    )
    whole = scored.join(met, "row", "left")
    more = F.coalesce("more_base", F.lit(0.0))
    base = F.col("base") + more
    base_score = base - F.col("n_tokens") * F.lit(float(np.log10(total)))
    part = F.col("part") + more - F.coalesce("n_other", F.lit(0)) * F.lit(float(np.log10(total)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        base_score.alias("base_score"), (F.col("log") + part if model else base_score).alias("score"),
    )

"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of its letter n-grams (one to three letters, runs of
anything else counting as one blank), hashed into ``WIDTH`` places and
normalised.  Each learned language has a few centroids from spherical k-means;
the most similar centroid by cosine gives the language and the score.  A text
farther from its centroid than nearly all of that language's own training texts
is marked as rejected.

Fitting uses a bounded sample of labelled rows (``per_class`` a language and
``total`` in all).  Null texts and texts without a letter are ``und`` with score
0; so is every text if there is nothing to learn from.  Repeated rows stay; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, held_out, two_columns
from .samples import class_sample

#: Places that n-grams are hashed into.
WIDTH = 4096
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Counts of hashed letter n-grams, a row for each text."""

    def __init__(self):
        self.letter = _letters()

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts, and which texts have a letter."""
        low = [" " + t.lower() + " " for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(low), dtype=np.int64), [len(t) for t in low])
        solid = self.letter[codes]
        has = np.bincount(doc, weights=solid, minlength=len(low)) > 0
        keep = solid.copy()
        keep[1:] |= solid[:-1]  # the first blank after a letter
        keep[np.diff(doc, prepend=-1) > 0] = True  # and the one before each text
        c = np.where(solid, codes, 0)[keep].astype(np.uint32)
        doc = doc[keep]
        out = np.zeros(len(low) * WIDTH, np.float32)
        h = np.zeros(len(c), np.uint32)
        for k in range(3):
            n = len(c) - k
            if n <= 0:
                break
            h = (h[:n] + c[k:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            same = (doc[:n] == doc[k:]) & (c[:n] > 0 if k == 0 else True)
            place = (h ^ np.uint32(0x85EBCA6B * (k + 1) & 0xFFFFFFFF)) % np.uint32(WIDTH)
            out += np.bincount((doc[:n] * WIDTH + place)[same], minlength=len(out)).astype(np.float32)
        return out.reshape(len(low), WIDTH), has


class Centroids:
    """The fitted classifier."""

    def __init__(self, langs: list[str], of: np.ndarray, vectors: np.ndarray, idf: np.ndarray, limit: np.ndarray):
        self.langs, self.of, self.vectors, self.idf, self.limit = langs, of, vectors, idf, limit

    @staticmethod
    def vectors_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and rejection of each row."""
        near = self.vectors_of(counts, self.idf) @ self.vectors.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(near)), best], 0, 1)
        return self.of[best], score, score < self.limit[best]


def fit(rows: list[tuple[str, str]], clusters: int = 4, rounds: int = 8, strict: float = 4.0) -> Centroids | None:
    """The classifier of (text, language) rows; strict: deviations below the mean
    similarity of a centroid's own texts from which on a text is rejected."""
    grams, counts, langs = Grams(), [], []
    for k in range(0, len(rows), 64):
        got, has = grams.counts([t for t, _ in rows[k : k + 64]])
        counts.append(got[has])
        langs += [lang for (_, lang), h in zip(rows[k : k + 64], has, strict=True) if h]
    if not langs:
        return None
    counts = np.concatenate(counts)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = Centroids.vectors_of(counts, idf)
    names, number = sorted(set(langs)), np.array(langs)
    of, vectors, limit = [], [], []
    for k, lang in enumerate(names):
        own = x[number == lang]
        # far apart ones first: each next seed is the text least like those before
        seeds = [0]
        while len(seeds) < min(clusters, len(own)):
            seeds.append(int((own @ own[seeds].T).max(1).argmin()))
        c = own[seeds]
        for _ in range(rounds):
            at = (own @ c.T).argmax(1)
            c = np.stack([own[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = own @ c.T
        at, sim = near.argmax(1), near.max(1)
        for j in range(len(c)):
            s = sim[at == j] if (at == j).any() else sim
            of.append(k)
            vectors.append(c[j])
            limit.append(s.mean() - strict * s.std())
    return Centroids(names, np.array(of), np.stack(vectors), idf, np.array(limit))


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some centroids of WIDTH numbers each

    def make():
        grams, fitted = Grams(), shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lang, score, far = [], [], []
            for k in range(0, len(texts), 64):
                counts, has = grams.counts(texts[k : k + 64])
                if fitted is None:
                    has[:] = False
                    at, s, f = np.zeros(len(has), int), np.zeros(len(has)), np.ones(len(has), bool)
                else:
                    at, s, f = fitted.predict(counts)
                lang += [fitted.langs[i] if h else UNKNOWN for i, h in zip(at.tolist(), has.tolist(), strict=True)]
                score += np.where(has, s, 0.0).tolist()
                far += (f | ~has).tolist()
            return pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(far, pa.bool_())})

        return run

    picked = two_columns(docs, id_col, text_col)
    return picked.mapInArrow(by_slice(make, size=1 << 20), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, per_class: int = 400, total: int = 4000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected``, learned from the rows of
    docs outside the held-out fold."""
    known = two_columns(docs, id_col, text_col)
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("label"))
    model = fit(class_sample(known, labelled, per_class, total, folds))
    return identify(known, model).withColumn("held_out", held_out("doc_id", folds)).select("doc_id", "held_out", "lang_pred", "score", "rejected")

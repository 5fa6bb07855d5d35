"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

A text is cut into words (a run of spaces with what follows it; a line feed on
its own where the vocabulary has no piece with one).  No piece has a space after
another character, so merges never cross these cuts.  The distinct new words of
a slice are merged together: one flat numpy array of symbols, the minimum pair
rank of each word by a segmented reduction, all leftmost occurrences of that
rank merged at once, and compaction, until no pair is left.  Where a merge would
make a pair of the same or a better rank, only the leftmost one is done in that
round, so the result equals that of merging one pair at a time, best first,
leftmost among equals.  Words of at most ``KEPT`` characters keep their ids in a worker
cache that is bounded in bytes; longer ones, as in scripts without spaces, don't.

Null texts encode as empty ones.  Every row is kept, repeated ones too; an empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_slice, two_columns

SPACE = "▁"
_NONE = np.int32(1 << 30)
#: Characters of the longest word that is cached.
KEPT = 64
#: Bytes that an entry takes beside its characters and ids.
_ENTRY = 200
_WORDS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_WORDS_JOINED = re.compile(r" +[^ ]*|[^ ]+")


class PieceTable:
    """The vocabulary of a byte-pair model with byte fallback as numpy tables."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p, s in zip(self.pieces, special, strict=True) if not s):
            raise ValueError("a piece has a space after another character; words can't be cut apart")
        self.words = _WORDS_JOINED if any("\n" in p and len(p) > 1 for p, s in zip(self.pieces, special, strict=True) if not s) else _WORDS
        ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.bytes = np.full(256, self.unk, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        #: Symbol of each code point: its piece, or -1 - code point.
        self.chars = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.chars[ord(" ")] = self.chars[ord(SPACE)]
        scores = {i: sp.get_score(i) for i in ids.values()}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[scores[i]], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.decoded = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in range(n):
            if sp.is_control(i):
                self.decoded[i] = b""
            elif sp.is_byte(i):
                self.decoded[i] = bytes([int(self.pieces[i][3:5], 16)])
            elif sp.is_unknown(i):
                self.decoded[i] = " ⁇ ".encode()
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.is_control = [sp.is_control(i) for i in range(n)]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; rank _NONE where there is none."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32), np.zeros(len(left), np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], _NONE), self.merged[at]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each non-empty word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        if not words:
            return out
        sym = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        lens = np.array([len(w) for w in words])
        who = np.arange(len(words))  # the word of each segment
        seg = np.repeat(who, lens)
        rank, to = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        rank[:-1], to[:-1] = self.pair(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = _NONE
        while len(lens):
            starts = np.cumsum(lens) - lens
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    a = starts[k]
                    out[who[k]] = self._ids(sym[a : a + lens[k]])
                left = ~done
                keep = left[seg]
                sym, rank, to = sym[keep], rank[keep], to[keep]
                lens, who, best = lens[left], who[left], best[left]
                seg = np.repeat(np.arange(len(lens)), lens)
                if not len(lens):
                    break
                starts = np.cumsum(lens) - lens
            at = np.flatnonzero(rank == best[seg])
            # of overlapping occurrences, every other one from the left
            near = np.zeros(len(at), bool)
            near[1:] = at[1:] == at[:-1] + 1
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(near, 0, order))) % 2 == 0]
            own = seg[at]
            first = np.ones(len(at), bool)
            first[1:] = own[1:] != own[:-1]
            if not first.all():
                at = at[first | ~self._early(sym, seg, rank, to, at, best)[own]]
                own = seg[at]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            lens = lens - np.bincount(own, minlength=len(lens))
            sym, seg, rank, to = sym[keep], seg[keep], rank[keep], to[keep]
            at = at - np.arange(len(at))
            again = np.concatenate([at, at[at > 0] - 1])
            ends = again + 1 >= len(sym)
            follow = np.where(ends, again, again + 1)
            r, t = self.pair(sym[again], sym[follow])
            r[ends | (seg[again] != seg[follow])] = _NONE
            rank[again], to[again] = r, t
        return out

    def _early(self, sym, seg, rank, to, at, best) -> np.ndarray:
        """The segments where merging all at once could differ from one at a time:
        a pair with a new symbol ranks as well as the merged pair, or better."""
        early = np.zeros(len(best), bool)
        new, own = to[at], seg[at]
        behind = np.maximum(at - 1, 0)
        left = sym[behind].copy()
        joined = np.zeros(len(at), bool)
        joined[1:] = at[1:] == at[:-1] + 2
        left[joined] = new[np.flatnonzero(joined) - 1]
        r, _ = self.pair(left, new)
        early[own[(at > 0) & (seg[behind] == own) & (r <= best[own])]] = True
        ahead = np.minimum(at + 2, len(sym) - 1)
        r, _ = self.pair(new, sym[ahead])
        early[own[(at + 2 < len(sym)) & (seg[ahead] == own) & (r <= best[own])]] = True
        return early

    def _ids(self, sym: np.ndarray) -> bytes:
        if (sym >= 0).all():
            return sym.astype("<u4").tobytes()
        ids: list[int] = []
        for s in sym.tolist():
            if s >= 0:
                ids.append(s)
            else:
                ids.extend(self.bytes[list(chr(-1 - s).encode())].tolist())
        return np.array(ids, "<u4").tobytes()


class Codec:
    """Encodes and decodes whole texts; ``room`` bounds the bytes of the words kept."""

    def __init__(self, model_path: str, room: int = 96 << 20):
        self.table, self.room = PieceTable(model_path), room
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.begin, self.end = (np.array([x], "<u4").tobytes() for x in (self.table.bos, self.table.eos))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text with begin and end, as little-endian 32-bit integers."""
        find = self.table.words.findall
        split = [find(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if self.held > self.room:
            self.known, self.held = {}, 0
        words = list(set().union(*split).difference(self.known))
        found = dict(zip(words, self.table.merge(words), strict=True))
        self.known.update(found)
        look = self.known.__getitem__
        out = [b"".join([self.begin, *map(look, words), self.end]) for words in split]
        for w, ids in found.items():
            if len(w) > KEPT:
                del self.known[w]
            else:
                self.held += _ENTRY + 2 * len(w) + len(ids)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: controls are dropped, one leading space goes, and bytes
        that aren't UTF-8 become replacement characters, one each."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        joined = b"".join(map(self.table.decoded.__getitem__, numbers))
        if joined[:1] == b" " and not self._starts_unknown(numbers):
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return self._decode_broken(joined)

    def _starts_unknown(self, numbers: list[int]) -> bool:
        first = next((x for x in numbers if not self.table.is_control[x]), -1)
        return first == self.table.unk

    @staticmethod
    def _decode_broken(joined: bytes) -> str:
        out, at = [], 0
        while at < len(joined):
            try:
                out.append(joined[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [joined[at : at + e.start].decode(), "�"]
                at += e.start + 1
        return "".join(out)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, room: int = 96 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of docs, and
    with keep_ids ``ids`` (an array) and ``decoded``, the text decoded from them."""

    def make():
        codec = Codec(model_path, room)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = codec.encode(batch.column(1).to_pylist())
            texts = [codec.decode(x) for x in ids]
            digest = lambda x: hashlib.sha256(x).hexdigest()
            out = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array(map(digest, ids), pa.string()),
                "decoded_sha256": pa.array([digest(t.encode()) for t in texts], pa.string()),
            }
            if keep_ids:
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
                out |= {"ids": pa.ListArray.from_arrays(offsets, values), "decoded": pa.array(texts, pa.string())}
            return pa.record_batch(out)

        return run

    picked = two_columns(docs, id_col, text_col)
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return picked.mapInArrow(by_slice(make, size=2 << 20), schema + ", ids array<int>, decoded string" * keep_ids)

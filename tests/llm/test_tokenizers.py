"""Encoding, decoding and counting against the libraries."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from windrose.llm.queries import tokenizer
from windrose.llm.sentencepiece_codec import Codec, encode_decode
from windrose.llm.token_counts import PreTokenLengths, chunks, frequent_chunks, token_counts

from .conftest import ODD

MODEL, COUNTER = tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_50k.json")
CODEC = Codec(MODEL, room=20_000)
LENGTHS = PreTokenLengths(COUNTER, {}, 20_000)


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(COUNTER)


PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "漢", "　", " ", "\x85", "\x1c", "\u2003", "\ufeff", "д", "ด้", "क्", "—", "🙂", "'s", "1", "½", "<|endoftext|>", "<s>", ".", "\r\n", "aaaa", "=-"]
texts = st.one_of(st.text(max_size=60).filter(lambda t: "\x00" not in t), st.lists(st.sampled_from(PARTS), max_size=40).map("".join))


@settings(max_examples=300, deadline=None)
@given(t=texts)
def test_ids_and_text_equal_the_library(t, sp):
    (got,) = CODEC.encode([t])
    want = sp.encode(t, add_bos=True, add_eos=True)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert CODEC.decode(got) == sp.decode(want)


@settings(max_examples=300, deadline=None)
@given(t=texts)
def test_counts_equal_the_library(t, counter):
    assert LENGTHS.count([t]) == [len(counter.encode(t, add_special_tokens=False).ids)]


@pytest.mark.parametrize("t", ["a" * 4000, " " * 3000, "ab" * 3000, "\n" * 500, "=-" * 2000, "aab" * 1000])
def test_long_words(t, sp, counter):
    assert np.frombuffer(CODEC.encode([t])[0], "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True)
    assert LENGTHS.count([t]) == [len(counter.encode(t, add_special_tokens=False).ids)]


def test_decoding_bytes_that_are_not_utf8(sp):
    ids = [1, 3 + 0xE4, 3 + 0xB8, 3 + 0x41, 264, 2]
    assert CODEC.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)


SCRIPTS = {"ru": "Быстрая рыжая лиса прыгает, через ленивую собаку. ", "zh": "敏捷的棕色狐狸跳过了懒狗。今天天气很好，我们去公园吧！", "th": "สุนัขจิ้งจอกสีน้ำตาลกระโดดข้ามสุนัขขี้เกียจ ", "el": "Η γρήγορη αλεπού πηδά — και φεύγει ", "hi": "तेज़ भूरी लोमड़ी आलसी कुत्ते के ऊपर कूदती है। ", "ar": "الثعلب البني السريع يقفز فوق الكلب الكسول، "}


@pytest.mark.parametrize("lang", SCRIPTS)
def test_scripts_stay_exact_in_caches_bounded_by_bytes(lang, sp, counter):
    """Documents that differ, far more of them than the caches have room for."""
    codec, lengths, room = Codec(MODEL, room=30_000), PreTokenLengths(COUNTER, {}, 30_000), 0
    for i in range(40):
        own = [SCRIPTS[lang] * (1 + i % 5) + chr(0x4E00 + i) * (i % 3) + f"x{i} {SCRIPTS[lang][i % 9 :]}" + "\n" + SCRIPTS[lang] for _ in range(2)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(own)] == [sp.encode(t, add_bos=True, add_eos=True) for t in own]
        assert lengths.count(own) == [len(counter.encode(t, add_special_tokens=False).ids) for t in own]
        room = max(room, *(sum(len(w) for w in known) for known in (codec.known, lengths.known)))
    assert room < 30_000 and codec.held < 60_000 and lengths.held < 60_000
    assert lang in ("zh", "th") or max(map(len, chunks(SCRIPTS[lang] * 9))) < 20


def test_frequent_chunks_are_found_in_a_tree(docs):
    rows = [(i, "common " * 5 + f"often{i % 3} rare{i} " + "漢" * 100) for i in range(60)]
    for parts in (1, 3, 20):
        got = frequent_chunks(docs(rows).repartition(parts), frequent=4, capacity=50, fan_in=2)
        assert len(got) <= 4 and {"common"} <= set(got) and not any("漢" in x for x in got)


def test_chunks_join_to_the_text():
    for t in ["", "a b", " a", "a ", "a\n\nb", "a \n b", "x  y"]:
        parts = [c[1:] if c[0] == "\n" and i == 0 else c for i, c in enumerate(chunks(t))]
        joined = "".join(c if i == 0 or c.startswith("\n") else " " + c for i, c in enumerate(parts))
        assert joined.replace(" \n", "\n") == t.replace(" \n", "\n")


def test_encode_decode_of_odd_rows(odd, sp):
    rows = encode_decode(odd, MODEL).collect()
    assert len(rows) == len(ODD)
    want = sorted(((i, t or "") for i, t in ODD), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    got = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.decoded))
    for r, (i, t) in zip(got, want, strict=True):
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert (r.doc_id, r.ids, r.n_tokens, r.decoded) == (i, ids, len(ids), sp.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_token_counts_of_odd_rows(odd, counter):
    rows = token_counts(odd, COUNTER, limit=3, frequent=5, room=10).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    want = sorted(((i, len((t or "").encode()), len(counter.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD), key=key)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=key) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in rows)


def test_empty_and_clashing(empty, clashing):
    assert encode_decode(empty, MODEL).count() == 0 and token_counts(empty, COUNTER).count() == 0
    df = clashing([(1, "a b")])
    assert encode_decode(df, MODEL).first().n_tokens == 4 and token_counts(df, COUNTER).first().n_tokens == 2

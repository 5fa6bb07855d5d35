"""Toxicity, language identification and language-model scores."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrose.llm import toxicity as tox
from windrose.llm.hmm import Counts, Hmm, first_model
from windrose.llm.language_id import WIDTH, fit, identify, language_id
from windrose.llm.lm_scoring import SHAPES, lm_scores, shape
from windrose.llm.samples import class_sample

from .conftest import ODD

SF = "/root/testdata/sf0.1"


def held(i, folds):
    return i is not None and zlib.crc32(str(i).encode()) % folds == 2


# ── toxicity ──


def test_the_machine_marks_what_it_should():
    table, kinds = tox.clause_machine()

    def run(*symbols):
        state, out = 0, []
        for s in symbols:
            kind, state = table[state][s]
            out.append(kind)
        return out

    assert run("insult") == ["insult"]
    assert run("target", "insult")[-1] == "insultT"
    assert run("negation", "other", "insult")[-1] == "insultN"
    assert run("negation", "other", "other", "other", "insult")[-1] == "insult"
    assert run("report", "other", "insult")[-1] == "insultR"
    assert run("report", "target", "negation", "threat")[-1] == "threatRNT"
    assert run("intent", "other", "threat")[-1] == "threatI" and run("threat", "intent")[0] == "threat"
    assert run("report", "intent", "target", "negation", "threat")[-1] == "threatIRNT"
    assert run("intent", "insult")[-1] == "insult"
    assert set(kinds) == {k + m for k in ("insult", "threat", "threatI") for m in ("", "R", "N", "RN", "T", "RT", "NT", "RNT")}


def toxic_rows(n, seed):
    random.seed(seed)
    plain = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(n):
        y = i % 3 == 0
        w = random.choices(plain, k=random.randint(5, 60))
        if y:
            for _ in range(random.randint(1, 3)):
                w.insert(random.randrange(len(w)), random.choice(["dolt", "grumpf" + random.choice(["a", "en", "ix"])]))
        rows.append((" ".join(w) + ".", int(y)))
    return rows


def test_learning_words_and_stems():
    model = tox.fit(toxic_rows(600, 1), 1 / 3)
    assert "dolt" in model.lexicon.words and any(s.startswith("grum") for s in model.lexicon.stems)
    score = model.scorer()
    found = [(score(t)[0] >= 0.3) == bool(y) for t, y in toxic_rows(300, 2)]
    assert np.mean(found) > 0.97
    assert score("")[0] < 0.3 and score("grumpfix, unseen ending")[0] >= 0.3
    aimed, plain, negated, reported = (score(t)[0] for t in ("you dolt", "a dolt", "not a dolt", "he said a dolt"))
    assert aimed > plain > reported > negated


def test_marks_are_learned():
    """Where reported insults don't make a text toxic, they come to weigh less; marks
    without evidence keep their values."""
    random.seed(4)
    rows = [(f"w{i} " + random.choice(["", "well "]) + (f"he said a dolt x{i}" if i % 2 else f"a dolt y{i}"), (i + 1) % 2) for i in range(300)]
    lexicon = tox.Lexicon({"dolt": 2.0}, {})
    marks = tox.learn_marks(tox.Grammar(lexicon), [t for t, _ in rows], np.array([y for _, y in rows]))
    assert marks["R"] < tox.MARKS["R"] and {m: marks[m] for m in "IN"} == {m: tox.MARKS[m] for m in "IN"}
    assert tox.learn_marks(tox.Grammar(lexicon), ["", "none here"], np.array([0, 1])) == tox.MARKS


def test_toxicity_on_odd_rows(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(2, 1), (5, 0), (None, 1), (99, 1), (6, None)], "doc_id long, toxic int")
    got = tox.toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, 4) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tox.toxicity(odd, none).collect()} == {0.0}
    assert tox.toxicity(empty, labels).count() == 0
    assert tox.toxicity(clashing([(1, "x")]), labels).count() == 1


def test_labels_are_no_input(spark, docs):
    """The held-out rows' labels don't change a score."""
    rows = [(i, t) for i, (t, _) in enumerate(toxic_rows(200, 3))]
    y = [(i, y) for i, (_, y) in enumerate(toxic_rows(200, 3))]
    flipped = [(i, 1 - v if held(i, 4) else v) for i, v in y]
    a, b = (sorted(map(tuple, tox.toxicity(docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (y, flipped))
    assert a == b


def test_filter_keeps_columns(docs):
    model = tox.fit(toxic_rows(600, 1), 1 / 3)
    df = docs([(1, "you dolt"), (2, "a fine day"), (3, None)])
    out = tox.without_toxic(df, model)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.88 and hit / max(1, sum(r.predicted for r in rows)) > 0.88


def score_by_hand(model, text):
    """Clauses, marks and weights over plain words."""
    lex, kinds = model.lexicon, sorted(k + m for k in ("insult", "threat", "threatI") for m in ("", "R", "N", "RN", "T", "RT", "NT", "RNT"))
    sums, best, hits = dict.fromkeys(kinds, 0.0), 0.0, 0
    fixed = {*tox.TARGETS, *tox.NEGATIONS, *tox.REPORTS, *tox.THREATS, *tox.INTENTS}
    for clause in re.split(r"[.!?;\n]", text.lower()):
        reported = aimed = intended = False
        since = 99
        for w in re.findall(r"[^\W\d_]+|:", clause):
            own = 0.0 if w in fixed else max([lex.words.get(w, 0.0), *(v for s, v in lex.stems.items() if w.startswith(s) and w != s)])
            since += 1
            if own > 0 or w in tox.THREATS:
                kind = "insult" if own > 0 else "threatI" if intended else "threat"
                weight = lex.top * (min(63, int(64 * own / lex.top)) + 1) / 64 if own > 0 else 1.0
                mark = "R" * reported + "N" * (since <= tox.REACH) + "T" * aimed
                r, n, t, i = (model.marks[m] for m in "RNTI")
                weight *= r**reported * n ** (since <= tox.REACH) * t**aimed * i ** (kind == "threatI")
                sums[kind + mark] += weight
                hits += 1
                best = max(best, weight if own > 0 else 0.0)
            elif w in tox.INTENTS:
                intended = True
            elif w in tox.REPORTS:
                reported = True
            elif w in tox.NEGATIONS:
                since = 0
            elif w in tox.TARGETS:
                aimed = True
    x = [math.log1p(sums[k]) for k in kinds] + [math.log1p(text.count(" ") if hits else 0), math.log1p(sum(v for k, v in sums.items() if k[0] == "i")), best]
    return 1 / (1 + math.exp(-model.weights[0] - np.dot(x, model.weights[1:])))


def test_symbols_do_not_depend_on_the_cache():
    lex = tox.Lexicon({"dolt": 2.0, "hurt": 1.5}, {"dol": 1.0})
    words = ["dolt", "dolts", "hurt", "you", "dol", "do", "", "plain", "!"] * 2
    wide, narrow = tox.Symbols(lex), tox.Symbols(lex, room=2)
    assert [wide[w] for w in words] == [narrow[w] for w in words] == [lex.symbol(w) for w in words]
    assert [lex.symbol(w) >= tox.INSULT for w in words[:5]] == [True, True, False, False, False] and lex.symbol("hurt") == tox.THREAT


def test_toxicity_scores_by_hand(docs):
    """Every text's score from end to end, over random clauses in all marks."""
    random.seed(8)
    model = tox.Model(tox.Lexicon({"dolt": 2.0, "hurt": 1.5}, {"grum": 3.0, "grumpf": 3.5, "ot": 0.4}), np.random.default_rng(3).normal(size=28), {"I": 1.4, "R": 0.6, "N": 0.5, "T": 1.2})
    words = ["dolt", "hurt", "will", "werde", "grum", "grumps", "grumpfen", "other", "ot", "You", "nie", "not", "said", "ÉCRIT", "kill", "tuer", "plain", "word", "x9", ".", "!", ";", "\n", ":", "'"]
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 25)))) for i in range(400)] + [(400, None), (401, ""), (402, "dolt " * 30000)]
    got = {r.doc_id: r.score for r in tox.score_toxicity(docs(rows), model).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(score_by_hand(model, t or ""), rel=1e-9), (i, t)


# ── language ──


def nearest_by_hand(model, text):
    """Language and cosine from the text's own n-grams, one at a time."""
    runs = [0]
    for c in text.lower() + " ":
        if c.isalpha():
            runs.append(ord(c))
        elif runs[-1]:
            runs.append(0)
    counts = Counter()
    for n in (1, 2, 3):
        for k in range(len(runs) - n + 1):
            if n == 1 and not runs[k]:
                continue
            h = 0
            for c in runs[k : k + n]:
                h = (h + c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            counts[(h ^ 0x85EBCA6B * n & 0xFFFFFFFF) % WIDTH] += 1
    size = math.sqrt(sum((math.log1p(c) * model.idf[at]) ** 2 for at, c in counts.items())) or 1.0
    near = [sum(math.log1p(c) * model.idf[at] * v[at] for at, c in counts.items()) / size for v in model.vectors]
    best = max(range(len(near)), key=near.__getitem__)
    return model.langs[model.of[best]], near[best]


def test_nearest_centroid_by_hand(docs):
    """Every text against every centroid, wherever in a batch it stands; copies get one score."""
    random.seed(9)
    word = lambda a: "".join(random.choices(a, k=random.randint(1, 7)))
    alphabets = {"x": "abcdeé", "y": "mnopß", "z": "абвгд"}
    model = fit([(" ".join(word(a) for _ in range(20)), lang) for lang, a in alphabets.items() for _ in range(30)], clusters=3)
    texts = [" ".join(random.choice([word(random.choice(list(alphabets.values()))), "12,", "--", ""]) for _ in range(random.randint(1, 12))) for _ in range(150)] + ["ab", "12 ab", "ab 12", "日本"]
    rows = list(enumerate(texts * 2))
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs(rows), model).collect()}
    for i, t in rows:
        lang, score = nearest_by_hand(model, t)
        if not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
        else:
            assert got[i][1] == pytest.approx(score, abs=1e-5), (i, t)
            assert got[i][0] == lang or score == pytest.approx(0, abs=1e-6)
    assert all(got[i][0] == got[i + len(texts)][0] and got[i][1] == pytest.approx(got[i + len(texts)][1], abs=1e-6) for i in range(len(texts)))


def test_language_on_odd_rows(odd, empty, docs, clashing):
    got = language_id(odd).collect()
    assert len(got) == len(ODD)
    for r, has in ((r, any(c.isalpha() for c in t or "")) for r in got for i, t in ODD if i == r.doc_id and i is not None):
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
    assert language_id(empty).count() == 0
    assert {r.lang_pred for r in identify(docs([(1, "abc")]), None).collect()} == {"und"}
    assert identify(clashing([(1, "abc")]), fit([("abc", "x")])).first().lang_pred == "x"


def test_rejection_and_several_centroids():
    random.seed(1)
    word = lambda letters: "".join(random.choices(letters, k=5))
    rows = [(" ".join(word(a) for _ in range(40)), lang) for lang, a in (("x", "abcd"), ("y", "mnop")) for _ in range(40)]
    model = fit(rows, clusters=3)
    assert Counter(model.of.tolist()) == {0: 3, 1: 3}
    from windrose.llm.language_id import Grams

    counts, has = Grams().counts(["abcd dcba bacd", "qrst rstq", "12 34"])
    at, score, far = model.predict(counts)
    assert model.langs[at[0]] == "x" and far[1] and has.tolist() == [True, True, False]


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert rows.a > 0.97


def test_class_sample_is_bounded_and_leaves_the_fold_out(spark):
    rows = [(i, f"text {i}", "big" if i % 10 else f"l{i % 50}") for i in range(5000)] + [(None, "x", "big"), (1, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = class_sample(df, df, 50, 240, 4)
    by = Counter(label for _, label in got)
    assert len(by) == 6 and max(by.values()) <= 40 and min(by.values()) >= 25
    assert not any(held(int(t.split()[1]), 4) for t, _ in got)
    assert len(class_sample(df, df, 5, 1000, 4)) <= 30
    assert class_sample(df, df.filter("label is null"), 5, 10, 4) == []


def test_class_sample_of_repeated_ids_and_long_texts(spark):
    """A third of the rows repeat one row, another id has many texts, some are long."""
    free = [i for i in range(2000) if not held(i, 4)][:300]
    rows = [(free[0], "same", "a")] * 400 + [(free[1], f"other {k}", "a") for k in range(400)]
    rows += [(i, f"t{i}" + " long" * (i % 7 == 0) * 400, "b" if i % 2 else "a") for i in free[2:]]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = class_sample(df, df, 100, 200, 4, max_bytes=6000, longest=1500)
    by = Counter(label for _, label in got)
    assert by["a"] <= 100 and by["b"] <= 100 and min(by.values()) > 20
    assert Counter(t for t, _ in got).most_common(1)[0][1] == 1
    assert all(sum(len(t) for t, x in got if x == y) <= 3000 for y in "ab") and not any("long" in t for t, _ in got)


# ── language model ──


def tiny():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((4, 3)), 0))


def test_forward_is_exact():
    m = tiny()
    for s in ([2], [0, 1], [3, 3, 0, 1, 2]):
        want = sum(
            m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.move[a, b] * m.emit[o, b] for a, b, o in zip(p, p[1:], s[1:], strict=False)) for p in itertools.product(range(3), repeat=len(s))
        )
        assert m.log10([np.array(s)])[0] == pytest.approx(math.log10(want), abs=1e-12)
    many = [np.array([1, 2, 3]), np.array([], int), np.array([0]), np.array([3] * 50)]
    assert m.log10(many) == pytest.approx([m.log10([s])[0] for s in many])


def test_all_texts_of_a_length_sum_to_one():
    m = tiny()
    total = sum(10 ** m.log10([np.array(s)])[0] for s in itertools.product(range(4), repeat=4))
    assert total == pytest.approx(1)


def test_baum_welch_counts_and_gain():
    m, rng = tiny(), np.random.default_rng(2)
    data = [rng.integers(0, 4, n) for n in (5, 1, 40, 12)]
    one = Counts(3, 4)
    one.add(m, data)
    assert one.emit.sum() == pytest.approx(sum(map(len, data)), rel=1e-5) and one.start.sum() == pytest.approx(4, rel=1e-5)
    assert one.log == pytest.approx(m.log10(data).sum(), rel=1e-5)
    parts = [Counts(3, 4), Counts(3, 4)]
    parts[0].add(m, data[:2])
    parts[1].add(m, data[2:])
    assert parts[0].emit + parts[1].emit == pytest.approx(one.emit, rel=1e-4)
    prior = np.full(4, 0.25)
    before = first_model(data, 3, prior)
    now, seen = before, []
    for _ in range(5):
        c = Counts(3, 4)
        c.add(now, data)
        seen.append(c.log)
        now = c.model(prior, 1e-6)
    assert seen[-1] > seen[0]


def counts_by_hand(m, data):
    """Expected counts by plain forward and backward sums."""
    out = Counts(*m.emit.shape[::-1])
    for s in data:
        f, b = [m.start * m.emit[s[0]]], [np.ones(len(m.start))]
        for x in s[1:]:
            f.append(f[-1] @ m.move * m.emit[x])
        for x in s[:0:-1]:
            b.insert(0, m.move @ (m.emit[x] * b[0]))
        p = f[-1].sum()
        out.start += f[0] * b[0] / p
        for t, x in enumerate(s):
            out.emit[x] += f[t] * b[t] / p
            if t:
                out.move += np.outer(f[t - 1], m.emit[x] * b[t]) * m.move / p
        out.log += math.log10(p)
    return out


@pytest.mark.parametrize("room", [1, 20, 100, 1000])
def test_counts_of_long_texts(room):
    """Block by block or at once: the counts of plain forward and backward sums."""
    m, rng = tiny(), np.random.default_rng(4)
    data = [rng.integers(0, 4, n) for n in (100, 16, 17, 1, 33, 14)]
    got, want = Counts(3, 4), counts_by_hand(m, data)
    got.add(m, data, room=room)
    for name in ("start", "move", "emit", "log"):
        assert getattr(got, name) == pytest.approx(getattr(want, name), rel=1e-4), name
    assert got.move.sum() == pytest.approx(sum(len(d) - 1 for d in data), rel=1e-5)


def test_scores_by_hand(docs):
    """score from end to end: the vocabulary, starting model, Baum-Welch and shapes are
    worked out again over plain lists."""
    random.seed(6)
    rows = [(i, " ".join(random.choices(["a", "b", "C", "dd", "e,", "é", f"r{i % 9}", f"s{i}"], [6, 5, 4, 3, 2, 1, 1, 1], k=random.randint(0, 12)))) for i in range(70)] + [(900, None)]
    got = {r.doc_id: r.score for r in lm_scores(docs(rows), states=2, symbols=3, known=5, rounds=2, least=-9, starters=100).collect()}
    split = {i: (t or "").lower().encode().split() for i, t in rows}
    train = [i for i in split if not held(i, 7)]
    c = Counter(w for i in train for w in split[i])
    total = sum(c.values()) + len(train) + len(c) + 2
    words = sorted(c, key=lambda w: (-c[w], w))[:3]
    mass = np.ones(SHAPES)
    for w in c:
        if w not in words:
            mass[shape(w)] += c[w] + 1
    prior = np.array([*(c[w] + 1 for w in words), *mass, len(train) + 1.0])
    assert prior.sum() == pytest.approx(total - 1 + SHAPES)
    prior /= prior.sum()
    symbol = lambda w: words.index(w) if w in words else 3 + shape(w)
    seqs = {i: np.array([*map(symbol, split[i]), 3 + SHAPES]) for i in split}
    start = sorted((seqs[i].astype(np.uint16) for i in train), key=bytes)
    best = first_model(start, 2, prior)
    for _ in range(8):  # six for the start, two over all documents
        best = counts_by_hand(best, start).model(prior)
    for i, s in seqs.items():
        share = sum(math.log10((c[w] + 1) / total) - math.log10(mass[shape(w)] / total) for w in split[i] if w not in words)
        assert got[i] == pytest.approx(best.log10([s])[0] + share, abs=1e-3), i


def test_base_scores_by_hand(docs):
    random.seed(5)
    rows = [(i, " ".join(random.choices(["A", "b", "c,", "é", "d" * 9, f"r{i}"], k=random.randint(0, 20)))) for i in range(80)] + ODD
    got = lm_scores(docs(rows), states=2, symbols=3, known=5, rounds=1, starters=5).collect()
    split = [(t or "").encode().lower().split() for _, t in rows]
    train = [t for (i, _), t in zip(rows, split, strict=True) if not held(i, 7)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = [(i, held(i, 7), len(t) + 1, sum(c[w] > 0 for w in t) + 1, round(sum(math.log10(c[w] + 1) for w in t) + math.log10(len(train) + 1) - (len(t) + 1) * math.log10(n + v + 1), 6)) for (i, _), t in zip(rows, split, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[2:])
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got), key=key) == sorted(want, key=key)
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)


def test_scores_without_training_and_clashes(docs, empty, clashing):
    out = next(i for i in range(100) if held(i, 7))
    (r,) = lm_scores(docs([(out, "a b")])).collect()
    assert r.train_tokens == 0 and r.score == r.base_score == 0 and r.n_known == 0
    assert lm_scores(empty).count() == 0
    assert lm_scores(clashing([(1, "a")]), states=2).count() == 1


def test_shapes_are_few():
    assert {shape(w.encode()) for w in ("a", "a.", "é", "abcdefghi,", "x" * 99)} <= set(range(4 * 2 * 17))

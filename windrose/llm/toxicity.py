"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols through lexicon transducers: insults (learned from labelled
texts as words and stems with weights, the accepting states of a prefix
automaton), words of harm and of intent, targets, negations and reporting verbs
(small fixed lists in the four languages of the corpus).  Over the symbols of a
clause runs the composition of four transducers: threat, which marks harm that
follows a word of intent; reported speech, which marks what follows a reporting
word; negation, which marks what follows within a few words; and target, which
marks what is aimed at someone.  The composed machine is built once as a table
of states and symbols.  Each insult or threat comes out as a kind (intended,
reported, negated, aimed or not) with its weight times its marks' factors, which
are learned around the values of MARKS; a logistic model over the sums by kind
turns a text's matched clauses into a probability.

Fitting uses a bounded sample of labelled rows (``per_class`` of each label);
the score is that of the text alone.  Null and empty texts match nothing and get
the score of such texts.  With nothing to learn from, every score is 0.  Rows
may repeat; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, held_out, ship, two_columns
from .samples import class_sample

# Fixed word lists, by symbol.
TARGETS = "you your yours yourself he she they them him her his their du dich dir dein deine ihr euch sie tu te toi ton ta vous votre vos ils elle tú ti tus usted ustedes vosotros ellos ella".split()
NEGATIONS = "not no never none neither nor nobody without nicht kein keine keinen nie niemals ohne pas ne jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco".split()
REPORTS = "said says say told tells wrote writes called calls claimed claims reported reports quoted allegedly sagte sagt schrieb nannte behauptete dit disait écrit appelé affirme dijo dice escribió llamó afirmó".split()
THREATS = "kill killed hurt destroy attack beat shoot stab burn hang murder töten umbringen sterben schlagen vernichten tuer mourir frapper détruire brûler matar morir golpear destruir quemar".split()

INTENTS = "will shall gonna going should werde wirst wird soll sollst vais vas va allons voy vamos".split()

#: Symbols: other words, the end of a clause, function classes, harm, intent, then
#: insults in LEVELS steps of weight.
OTHER, END, TARGET, NEGATION, REPORT, THREAT, INTENT = range(7)
INSULT = 16
LEVELS = 64
#: Words that a negation reaches.
REACH = 3
#: What a mark makes of a hit's weight, before learning: reported or negated hits count
#: for less, those intended or aimed at someone for more.
MARKS = {"I": 1.1, "R": 0.8, "N": 0.7, "T": 1.1}

_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_ENDS = frozenset(".!?;\n")
_MATCH = re.compile(b"[\x05\x10-\xff]")
_CLAUSE = re.compile(b"[^\x01]+")


class Transducer:
    """A deterministic weighted transducer with an identity arc for any symbol
    without an arc of its own: arcs[state][symbol] = (output, next state)."""

    def __init__(self, states: int, arcs: dict[int, dict[str, tuple[str, int]]], default: dict[int, int] | None = None):
        self.states, self.arcs, self.default = states, arcs, default or {}

    def step(self, state: int, symbol: str) -> tuple[str, int]:
        own = self.arcs.get(state, {})
        return own.get(symbol) or (symbol, self.default.get(state, state))


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> dict[tuple[int, int], dict[str, tuple[str, tuple[int, int]]]]:
    """The product machine over the given input symbols."""
    table = {}
    for p, q in itertools.product(range(first.states), range(second.states)):
        table[p, q] = {}
        for s in symbols:
            mid, p2 = first.step(p, s)
            out, q2 = second.step(q, mid)
            table[p, q][s] = (out, (p2, q2))
    return table


def _chain(machines: list[Transducer], symbols: list[str]) -> list[dict[str, tuple[str, int]]]:
    """The machines one after another, as a table with numbered states; 0 is the start."""
    table: list[dict[str, tuple[str, int]]] = [{x: (x, 0) for x in symbols}]
    for machine in machines:
        product = compose(Transducer(len(table), dict(enumerate(table))), machine, symbols)
        number = {state: i for i, state in enumerate(sorted(product))}
        table = [{x: (out, number[to]) for x, (out, to) in product[state].items()} for state in sorted(product)]
    return table


def clause_machine() -> tuple[list[dict[str, tuple[str, int]]], list[str]]:
    """The composition as a table, and the kinds that it puts out."""
    plain = ["other", "target", "negation", "report", "intent", "insult", "threat"]
    after = lambda mark: [k + "".join(m) for k in ("insult", "threat", "threatI") for n in range(3) for m in itertools.combinations("RN", n) if mark not in m]
    marked = lambda mark, state: {s: (s + mark, state) for s in after(mark)}
    intended = Transducer(2, {0: {"intent": ("intent", 1)}, 1: {"threat": ("threatI", 1)}})
    reported = Transducer(2, {0: {"report": ("report", 1)}, 1: marked("R", 1)})
    reach = {k: marked("N", k - 1) if k else {} for k in range(REACH + 1)}
    for arcs in reach.values():
        arcs["negation"] = ("negation", REACH)
    negated = Transducer(REACH + 1, reach, {k: k - 1 for k in range(1, REACH + 1)})
    aimed = Transducer(2, {0: {"target": ("target", 1)}, 1: marked("T", 1)})
    table = _chain([intended, reported, negated, aimed], plain)
    return table, sorted({o for arcs in table for o, _ in arcs.values() if o.startswith(("insult", "threat"))})


class Lexicon:
    """Symbols of words: the fixed lists first, then learned insults, as a weighted
    automaton over letters.  A state stands for a prefix; it has the weight of the stem
    that it completes, for words that go on from there, and that of the word that ends
    in it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.top = max([1e-9, *words.values(), *stems.values()])
        self.arcs: list[dict[str, int]] = [{}]
        self.going = self._accept(stems)
        self.ending = self._accept(words)
        self.fixed = {w: s for s, group in ((INTENT, INTENTS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in group}
        self.fixed |= dict.fromkeys(_ENDS, END)
        self.fixed[":"] = OTHER

    def _accept(self, marks: dict[str, float]) -> dict[int, float]:
        """The states that the marks end in, with their weights; arcs are added."""
        out = {}
        for mark, weight in marks.items():
            state = 0
            for letter in mark:
                if letter not in self.arcs[state]:
                    self.arcs.append({})
                    self.arcs[state][letter] = len(self.arcs) - 1
                state = self.arcs[state][letter]
            out[state] = weight
        return out

    def symbol(self, word: str) -> int:
        if word in self.fixed:
            return self.fixed[word]
        state, weight = 0, 0.0
        for letter in word:
            weight = max(weight, self.going.get(state, 0.0))
            state = self.arcs[state].get(letter)
            if state is None:
                break
        else:
            weight = max(weight, self.ending.get(state, 0.0))
        return INSULT + min(LEVELS - 1, int(LEVELS * weight / self.top)) if weight > 0 else OTHER

    def weight(self, symbol: int) -> float:
        return 1.0 if symbol == THREAT else self.top * (symbol - INSULT + 1) / LEVELS


class Symbols(dict):
    """A bounded cache of words' symbols."""

    def __init__(self, lexicon: Lexicon, room: int = 500_000):
        super().__init__()
        self.lexicon, self.room = lexicon, room

    def __missing__(self, word: str) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = found = self.lexicon.symbol(word)
        return found


class Grammar:
    """Sums of weights by kind for a text with hits, its length, the insults' total and
    the strongest hit's weight."""

    def __init__(self, lexicon: Lexicon, marks: dict[str, float] | None = None):
        self.lexicon, self.symbols = lexicon, Symbols(lexicon)
        self.table, self.kinds = clause_machine()
        self.place = {k: i for i, k in enumerate(self.kinds)}
        self.insult = np.array([k.startswith("insult") for k in self.kinds])
        self.factor = self.factors(marks or MARKS)
        self.names = {OTHER: "other", TARGET: "target", NEGATION: "negation", REPORT: "report", THREAT: "threat", INTENT: "intent"}

    def factors(self, marks: dict[str, float]) -> np.ndarray:
        """Each kind's factor: the product of its marks'."""
        return np.array([math.prod(marks.get(m, 1.0) for m in k) for k in self.kinds])

    def clauses(self, text: str) -> list[bytes]:
        """The symbols of each clause with an insult or a threat."""
        codes = bytes(map(self.symbols.__getitem__, _TOKENS.findall(text.lower())))
        if not _MATCH.search(codes):
            return []
        return [c for c in _CLAUSE.findall(codes) if _MATCH.search(c)]

    def hits(self, clauses: list[bytes]) -> list[tuple[int, float]]:
        """Kind and weight of each insult and threat, before its marks count."""
        out = []
        for clause in clauses:
            state = 0
            for code in clause:
                kind, state = self.table[state][self.names.get(code, "insult")]
                at = self.place.get(kind)
                if at is not None:
                    out.append((at, self.lexicon.weight(code)))
        return out

    def features(self, text: str, clauses: list[bytes] | None = None) -> np.ndarray:
        out = np.zeros(len(self.kinds) + 3)
        found = self.clauses(text) if clauses is None else clauses
        best = 0.0
        for at, weight in self.hits(found):
            weight *= self.factor[at]
            out[at] += weight
            if self.insult[at]:
                best = max(best, weight)
        out[-3], out[-2] = text.count(" ") if found else 0, out[:-3][self.insult].sum()
        out = np.log1p(out)
        out[-1] = best
        return out


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, marks: dict[str, float] | None = None):
        self.lexicon, self.weights, self.marks = lexicon, weights, marks or MARKS

    def scorer(self):
        grammar = Grammar(self.lexicon, self.marks)
        none = self._score(np.zeros(len(grammar.kinds) + 3))

        def score(text: str) -> tuple[float, int]:
            found = grammar.clauses(text) if text else []
            return (self._score(grammar.features(text, found)), len(found)) if found else (none, 0)

        return score

    def _score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -40, 40))))


def learn_lexicon(texts: list[str], toxic: np.ndarray, stems: tuple[int, ...] = (4, 5, 6, 7, 8, 9), clear: float = 0.42, margin: float = 2.0, most: int = 5000) -> Lexicon:
    """Words and stems that tell toxic texts from others, with log odds as weights.

    clear: least log odds as a share of the strongest mark's; margin: how far a mark's likelihood ratio statistic must
    lie above what the largest of so many marks reaches by chance; a mark is left out
    where a stem of about the same odds covers it."""
    count = (Counter(), Counter())
    for text, y in zip(texts, toxic.tolist(), strict=True):
        own = {w for w in _TOKENS.findall(text.lower()) if len(w) > 2}
        count[bool(y)].update(own)
        count[bool(y)].update({w[:n] + "*" for w in own for n in stems if len(w) > n})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    base = np.log([n1 / (n1 + n0), n0 / (n1 + n0)])
    sure = margin + 2 * np.log(max(2, sum(a >= 3 for a in count[1].values())))
    found = []
    for mark, a in count[1].items():
        b = count[0][mark]
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        surprise = 2 * (a * (np.log(a / (a + b)) - base[0]) + (b * (np.log(b / (a + b)) - base[1]) if b else 0.0))
        if odds > 0 and surprise >= sure:
            found.append((float(odds), float(surprise), mark))
    least = clear * max((f[0] for f in found), default=0.0)
    found = [f for f in found if f[0] >= least]
    longer: Counter[str] = Counter()  # of a stem: the most toxic texts that one longer mark has
    for mark, a in count[1].items():
        word = mark.rstrip("*")
        for n in stems:
            if n < len(word):
                longer[word[:n]] = max(longer[word[:n]], a)
    found = [(o, g, m) for o, g, m in found if m[-1] != "*" or longer[m[:-1]] < 0.9 * count[1][m]]
    words, prefixes = {}, {}
    # short stems first, so that they can cover what they explain
    for odds, _, mark in sorted(sorted(found, key=lambda f: (-f[1], f[2]))[:most], key=lambda f: (f[2][-1] != "*", len(f[2]), f[2])):
        word = mark.rstrip("*")
        if max((prefixes.get(word[:n], 0.0) for n in stems if n < len(word)), default=0.0) < odds - 0.25:
            (prefixes if mark[-1] == "*" else words)[word] = odds
    return Lexicon(words, prefixes)


def unlike(rows: list[tuple[str, int]], hashes: int = 4, same: int = 2) -> list[tuple[str, int]]:
    """One text of each group of copies, so that a mark's counts are of texts that
    were written apart: a later text goes if ``same`` of its minimum hashes of three
    words are those of one earlier text."""
    owner: dict[tuple[int, int], int] = {}
    out = []
    for k, (text, y) in enumerate(rows):
        words = text.lower().split()
        own = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint64)
        marks = [(i, int(((own * np.uint64(2654435761 + 2 * i) + np.uint64(97 * i)) % np.uint64((1 << 31) - 1)).min())) for i in range(hashes)]
        seen = Counter(owner[m] for m in marks if m in owner)
        if seen and seen.most_common(1)[0][1] >= same:
            continue
        out.append((text, y))
        for m in marks:
            owner.setdefault(m, k)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, keep: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of a ridge logistic model by Newton's steps, and its penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
    z = np.clip(x @ w, -30, 30)
    return w, float((y * z - np.logaddexp(0, z)).sum() - 0.5 * (keep * w * w).sum())


def learn_marks(grammar: Grammar, texts: list[str], toxic: np.ndarray, steps: tuple[float, ...] = (0.0, 0.15, 0.3, 0.45, 0.6, 0.8), spread: float = 0.3) -> dict[str, float]:
    """The marks' factors, those that make the labels likeliest from the sum of hits,
    the strongest one and the length.

    One mark at a time, over ``steps`` of the factor's logarithm, down for reported and
    negated hits and up for others; spread: how far from MARKS is one standard deviation
    beforehand, so that marks without evidence keep those values."""
    hits = [grammar.hits(grammar.clauses(t)) for t in texts]
    who = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    kind = np.array([k for h in hits for k, _ in h], int)
    weight = np.array([w for h in hits for _, w in h], float)
    size = np.log1p([t.count(" ") if h else 0 for t, h in zip(texts, hits, strict=True)])

    def likelihood(marks: dict[str, float]) -> float:
        own = weight * grammar.factors(marks)[kind]
        best = np.zeros(len(hits))
        np.maximum.at(best, who, own)
        x = np.column_stack([np.ones(len(hits)), size, np.log1p(np.bincount(who, own, len(hits))), best])
        far = sum((math.log(marks[m] / MARKS[m]) / spread) ** 2 for m in marks)
        return _logistic(x, toxic, np.array([1e-3, 1.0, 1.0, 1.0]), 12)[1] - 0.5 * far

    marks = dict(MARKS)
    if len(weight):
        for mark in marks:
            sign = 1 if MARKS[mark] > 1 else -1
            tried = [marks | {mark: f} for f in dict.fromkeys([MARKS[mark], *(math.exp(sign * s) for s in steps)])]
            marks = max(tried, key=likelihood)
    return marks


def fit(rows: list[tuple[str, int]], share: float | None = None, ridge: float = 1.0, rounds: int = 25) -> Model | None:
    """The model of (text, label) rows; share: that of label 1 among all labelled
    rows, where the sample isn't drawn in proportion."""
    rows = unlike(rows)
    if not rows:
        return None
    texts, toxic = [t for t, _ in rows], np.array([int(y) for _, y in rows])
    # the lexicon comes from one half, marks and weights from the other, then the lexicon from all
    half = np.arange(len(rows)) % 2 == 0
    lexicon = learn_lexicon([t for t, h in zip(texts, half, strict=True) if h], toxic[half])
    others, y = [t for t, h in zip(texts, half, strict=True) if not h] or [""], toxic[~half] if (~half).any() else toxic[:1]
    marks = learn_marks(Grammar(lexicon), others, y)
    grammar = Grammar(lexicon, marks)
    x = np.stack([grammar.features(t) for t in others])
    x = np.hstack([np.ones((len(x), 1)), x])
    keep = np.full(x.shape[1], ridge)
    keep[0], keep[1:-3] = 1e-3, 10 * ridge  # the marks' factors rule; kinds only adjust
    w, _ = _logistic(x, y, keep, rounds)
    if share is not None and 0 < share < 1 and 0 < y.mean() < 1:
        w[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(learn_lexicon(texts, toxic), w, marks)


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, n_clauses`` for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most some thousand words

    def make():
        score = shared.value.scorer() if shared.value else lambda text: (0.0, 0)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [score(t or "") for t in batch.column(1).to_pylist()]
            return pa.record_batch({"doc_id": batch.column(0), "score": pa.array([s for s, _ in found], pa.float64()), "predicted": pa.array([int(s >= threshold) for s, _ in found], pa.int32()), "n_clauses": pa.array([n for _, n in found], pa.int32())})

        return run

    picked = two_columns(docs, id_col, text_col)
    return picked.mapInArrow(by_slice(make), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_clauses int")


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with their columns."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.scorer() if shared.value else lambda text: (0.0, 0)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            return batch.filter(pa.array([score(t or "")[0] < threshold for t in texts], pa.bool_()))

        return run

    return docs.mapInArrow(by_slice(make, text_col), docs.schema)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, per_class: int = 3000) -> Model | None:
    """The model of the labelled documents outside the held-out fold."""
    labelled = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).filter("label in (0, 1)")
    able = labelled.filter(~held_out("doc_id", folds))
    n, ones = able.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rows = class_sample(two_columns(docs, id_col, text_col), labelled, per_class, 2 * per_class, folds)
    return fit(rows, ones / n if n else None)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, threshold: float = 0.3, **kw) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_clauses`` for each row of docs."""
    scored = score_toxicity(docs, learn(docs, labels, folds=folds, **kw), threshold=threshold)
    return scored.withColumn("held_out", held_out("doc_id", folds)).select("doc_id", "held_out", "score", "predicted", "n_clauses")

"""Toxicity by a weighted finite-state pattern grammar.

The lexicon turns every word of a clause into symbols: an insult with its weight (words and word starts learned from labels),
a threat, a target, a negation, a reporting verb (short fixed lists), and the end of the word. Three transducers rewrite that
string. The *report* transducer renames insults that follow a reporting verb, the *negation* transducer those within reach of
a negation, and the *target* transducer the remaining ones by whether the clause names a target, before or after them: it
guesses at the start and accepts only where the guess was right, so one path of each clause is accepted. They are composed
once into one machine, which passes over a clause and adds up the weights that leave it by class: plain, targeted, negated or
reported insults, and threats to a target. A document's score is a logistic function of what its clauses sum up to in each
class and of its strongest clause; the weights of the classes are learned too, so negation or reporting lower a score only as
far as the labels say so.

Learning uses labelled rows alone, at most ``LABELLED`` of them, chosen by hash. Terms for the fit of the class weights
are learned on the other half of the rows, so that chance terms are not mistaken for good ones. Only plain and targeted
uses decide whether a term is an insult, so one that clean rows negate or report stays in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import release

#: Bound of the fitted model: labelled rows it learns from. It keeps every insult term that these show.
LABELLED = 8000
#: A term needs so many toxic documents and so large a likelihood ratio.
LEAST, RATIO = 4, 15.0
STARTS = (3, 4, 5, 6)

TARGETS = frozenset("you your yours yourself u ur they them their he she him her tu toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes tú tus ti te vosotros".split())
NEGATIONS = frozenset("not no never none neither nor isn't aren't ne pas jamais nicht kein keine nie nunca ni jamás".split())
REPORTS = frozenset("said says say told tells quoted wrote reported claimed dit disait écrit sagte sagt schrieb dijo dice escribió".split())
THREATS = frozenset("kill murder strangle stab tuer tuerai töten umbringen matar mataré".split())
#: Words that a negation reaches.
REACH = 2
FEATURES = ("plain", "targeted", "negated", "reported", "threat", "strongest")

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]+")


@dataclass
class Model:
    """Insult terms with weights (word starts end in ``*``), class weights and bias; ``bias`` None is the constant ``base``."""

    terms: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float | None = None
    base: float = 0.0


def terms_of(text: str) -> set[str]:
    """Words of a text and their starts, in uses that are neither negated nor reported."""
    words = set()
    for c in _CLAUSE.split(text.lower()):
        negated = 0
        for w in _WORD.findall(c):
            if w in REPORTS:
                break
            if w in NEGATIONS:
                negated = REACH + 1
            if negated <= 0:
                words.add(w)
            negated -= 1
    return words | {w[:n] + "*" for w in words for n in STARTS if len(w) >= n}


#: Symbols of a clause: reporting verb, negation, insult, threat, target, end of a word; and what the transducers make of
#: insults and threats: reported, negated, targeted and plain insults, threats to a target. ``_`` is nothing.
REPORT, NEGATION, INSULT, THREAT, TARGET, END = "RNITY."
REPORTED, NEGATED, TARGETED, PLAIN, THREATENED, NOTHING = "rnypt_"
#: Classes in the order of ``FEATURES``.
CLASSES = (PLAIN, TARGETED, NEGATED, REPORTED, THREATENED)


@dataclass(frozen=True)
class Transducer:
    """States with arcs (state, symbol) -> (next state, symbol put out); without an arc a path ends."""

    start: object
    finals: frozenset
    arcs: dict[tuple[object, str], tuple[tuple[object, str], ...]]

    def paths(self, symbols: str) -> list[str]:
        """What every accepted path puts out."""
        active = [(self.start, "")]
        for s in symbols:
            active = [(to, out + y) for state, out in active for to, y in self.arcs.get((state, s), ())]
        return [out for state, out in active if state in self.finals]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that does what ``second`` does to the output of ``first``; only states that can be reached."""
    start = (first.start, second.start)
    arcs: dict[tuple[object, str], tuple[tuple[object, str], ...]] = {}
    todo, seen = [start], {start}
    symbols = sorted({s for _, s in first.arcs})
    while todo:
        a, b = state = todo.pop()
        for s in symbols:
            out = tuple(((to, then), z) for to, y in first.arcs.get((a, s), ()) for then, z in second.arcs.get((b, y), ()))
            if out:
                arcs[state, s] = out
            for to, _ in out:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    return Transducer(start, frozenset(s for s in seen if s[0] in first.finals and s[1] in second.finals), arcs)


def _same(state: object, symbols: str) -> dict:
    return {(state, s): ((state, s),) for s in symbols}


def report_transducer() -> Transducer:
    """An insult after a reporting verb is reported, to the end of the clause."""
    arcs = _same(0, NEGATION + INSULT + THREAT + TARGET + END) | _same(1, REPORT + NEGATION + THREAT + TARGET + END)
    return Transducer(0, frozenset((0, 1)), arcs | {(0, REPORT): ((1, REPORT),), (1, INSULT): ((1, REPORTED),)})


def negation_transducer(reach: int = REACH) -> Transducer:
    """An insult is negated in the word of a negation and in the ``reach`` words behind it; the state counts them down."""
    arcs: dict = {}
    for left in range(reach + 2):
        arcs |= _same(left, REPORT + THREAT + TARGET + REPORTED)
        arcs[left, NEGATION] = ((reach + 1, NEGATION),)
        arcs[left, INSULT] = ((left, NEGATED if left else INSULT),)
        arcs[left, END] = ((max(left - 1, 0), END),)
    return Transducer(0, frozenset(range(reach + 2)), arcs)


def target_transducer() -> Transducer:
    """Insults and threats by whether the clause names a target anywhere: one branch says no, the other waits for it."""
    arcs: dict = {}
    for state in ("none", "waits", "named"):
        arcs |= {(state, s): ((state, NOTHING),) for s in REPORT + NEGATION + END} | _same(state, REPORTED + NEGATED)
        arcs[state, INSULT] = ((state, PLAIN if state == "none" else TARGETED),)
        arcs[state, THREAT] = ((state, NOTHING if state == "none" else THREATENED),)
    arcs |= {("waits", TARGET): (("named", NOTHING),), ("named", TARGET): (("named", NOTHING),)}
    # The guess is made with the first symbol.
    arcs |= {("start", s): arcs.get(("none", s), ()) + arcs[("waits", s)] for s in REPORT + NEGATION + END + REPORTED + NEGATED + INSULT + THREAT + TARGET}
    return Transducer("start", frozenset(("start", "none", "named")), arcs)


class Machine:
    """The composed transducers with numbered states, run over weighted symbols."""

    def __init__(self) -> None:
        whole = compose(compose(report_transducer(), negation_transducer()), target_transducer())
        names = {whole.start: 0}
        for _, out in whole.arcs.items():
            for to, _ in out:
                names.setdefault(to, len(names))
        place = {c: k for k, c in enumerate(CLASSES)}
        self.finals = {names[s] for s in whole.finals if s in names}
        self.arcs: list[dict[str, list[tuple[int, int]]]] = [{} for _ in names]
        for (state, s), out in whole.arcs.items():
            self.arcs[names[state]][s] = [(names[to], place.get(y, -1)) for to, y in out]

    def run(self, symbols: list[tuple[str, float]]) -> list[float]:
        """Weights that the accepted path puts out, by class."""
        active: list[tuple[int, list[float]]] = [(0, [0.0] * len(CLASSES))]
        for s, weight in symbols:
            following = []
            for state, total in active:
                ways = self.arcs[state].get(s, ())
                for to, kind in ways:
                    after = list(total) if len(ways) > 1 else total
                    if kind >= 0:
                        after[kind] += weight
                    following.append((to, after))
            active = following
        return next(total for state, total in active if state in self.finals)


class Grammar:
    """The lexicon for one set of insult terms in front of the composed machine."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.terms = terms
        self.known: dict[str, list[tuple[str, float]]] = {}
        self.machine = Machine()
        self.filter = ahocorasick.Automaton()
        for t in {t.rstrip("*") for t in terms} | THREATS:
            self.filter.add_word(t, True)
        self.filter.make_automaton()

    def insult(self, word: str) -> float:
        return max([self.terms.get(word, 0.0), *(self.terms.get(word[:n] + "*", 0.0) for n in STARTS if len(word) >= n)])

    def symbols(self, word: str) -> list[tuple[str, float]]:
        """Symbols of a word, the ones that change a state before those that put something out."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 1 << 17:
                self.known.clear()
            weight = self.insult(word)
            lists = ((REPORT, REPORTS), (NEGATION, NEGATIONS - REPORTS), (TARGET, TARGETS), (THREAT, THREATS))
            found = [(s, 1.0) for s, words in lists if word in words] + [(INSULT, weight)] * (weight > 0) + [(END, 0.0)]
            self.known[word] = found
        return found

    def clause(self, words: list[str]) -> list[float]:
        """What one pass over a clause puts out, by class."""
        string = [x for w in words for x in self.symbols(w)]
        if not any(s in (INSULT, THREAT) for s, _ in string):
            return [0.0] * len(CLASSES)
        return self.machine.run(string)

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        total = [0.0] * len(FEATURES)
        if next(self.filter.iter(low), None) is None:
            return total
        for c in _CLAUSE.split(low):
            out = self.clause(_WORD.findall(c))
            for k, v in enumerate(out):
                total[k] += v
            total[5] = max(total[5], sum(out))
        return [math.log1p(v) for v in total]


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int) -> DataFrame:
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.max(label) > 0).cast("int").alias("__y"))
    rows = rows.orderBy(F.xxhash64("__key"), "__key").limit(limit)
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("__key")), F.lit(2)).cast("int")
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(rows), "__key").select("text", F.col("__y").alias("y"), half.alias("half"))


def _choose(pos: np.ndarray, neg: np.ndarray, terms: np.ndarray, toxic: int, clean: int) -> dict[str, float]:
    """Terms that occur in toxic documents far more often than chance allows, with their log odds."""
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)
    n = pos + neg
    rate = pos / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(pos > 0, pos * np.log(rate / share), 0) + np.where(neg > 0, neg * np.log((1 - rate) / (1 - share)), 0))
    good = np.flatnonzero((pos >= LEAST) & (rate >= 0.85) & (ratio >= RATIO))
    good = good[np.argsort(-ratio[good], kind="stable")]
    odds = np.log((pos[good] + 0.5) / (toxic + 1)) - np.log((neg[good] + 0.5) / (clean + 1))
    return dict(zip(terms[good].tolist(), odds.tolist()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton steps; the bias is last."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = LABELLED) -> Model:
    """Model from the labelled rows given; rows without label or document are skipped, of several labels the largest counts.

    Without toxic or without clean rows the score is the constant share of toxic rows (0 for none at all).
    """
    rows = _labelled(docs, labels, key, text, label, limit)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        seen: Counter = Counter()
        for b in batches:
            for t, y, h in zip(b["text"], b["y"], b["half"]):
                seen.update((w, 2 * h + y) for w in terms_of(t or ""))
                seen["", 2 * h + y] += 1
        flat = list(seen.items())
        for at in range(0, len(flat), 100_000):
            part = flat[at : at + 100_000]
            terms = pd.Series([t for (t, _), _ in part], dtype=object)
            yield pd.DataFrame({"term": terms, "side": np.array([s for (_, s), _ in part], np.int32), "n": np.array([n for _, n in part], np.int64)})

    sides = [F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(4)]
    # At most the terms of ``limit`` rows; those that too few toxic rows have stay behind.
    counts = rows.mapInPandas(count, "term string, side int, n bigint").groupBy("term").agg(*sides)
    counts = counts.filter(f"term = '' or (s1 + s3 >= {LEAST} and s1 + s3 > s0 + s2)").toPandas()
    total = counts[counts["term"] == ""][["s0", "s1", "s2", "s3"]].sum().to_numpy()
    counts = counts[counts["term"] != ""].sort_values("term")
    names, s = counts["term"].to_numpy(), counts[["s0", "s1", "s2", "s3"]].to_numpy()
    clean, toxic = int(total[0] + total[2]), int(total[1] + total[3])
    if not clean or not toxic:
        return Model(base=toxic / max(1, clean + toxic))
    whole = _choose(s[:, 1] + s[:, 3], s[:, 0] + s[:, 2], names, toxic, clean)
    halves = [_choose(s[:, 2 * h + 1], s[:, 2 * h], names, int(total[2 * h + 1]), int(total[2 * h])) for h in (0, 1)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        other = [Grammar(halves[1]), Grammar(halves[0])]
        for b in batches:
            f = np.array([other[h].features(t) for t, h in zip(b["text"], b["half"])]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({n: f[:, k] for k, n in enumerate(FEATURES)} | {"y": b["y"].to_numpy()})

    seen = rows.mapInPandas(measure, ", ".join(f"{n} double" for n in FEATURES) + ", y int").toPandas().sort_values([*FEATURES, "y"])
    w = _logistic(seen[list(FEATURES)].to_numpy(), seen["y"].to_numpy().astype(float))
    return Model(whole, w[:-1].tolist(), float(w[-1]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1. Null and empty texts match nothing and get the model's bias alone."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        grammar, weights = Grammar(model.terms), np.array(model.weights)
        for texts in batches:
            if model.bias is None:
                yield pd.Series(np.full(len(texts), model.base))
                continue
            x = np.array([grammar.features(t) for t in texts]).reshape(-1, len(FEATURES)) @ weights + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(x, -700, 700))))

    return docs.withColumn(name, scores(F.col(text)))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept out of learning: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, label: str = "toxic") -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; learned from labelled rows that are not held out."""
    model = fit(docs, labels.filter(~held_out(key)), key, text, label)
    return score(docs, model, text, "__score").filter(F.col("__score") < threshold).drop("__score")

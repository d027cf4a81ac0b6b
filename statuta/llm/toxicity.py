"""Toxicity scores from a weighted finite-state grammar over clauses.

A lexical transducer turns the words of a clause into tags: insult, threat, target, negation, reported
speech, other.  Small transducers rewrite the tags in turn (negated, reported, directed at someone) and are
composed into one machine.  What it emits for a clause carries a weight; the score of a text sums its
matched clauses.  Insults that labels show beyond the fixed list, as words or word beginnings, enter the
lexicon with the strength that the labels give them; the weights of the machine's outputs are fitted
around the grammar's own values.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import pretokens as P
from .columns import keyed, rekeyed

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# The grammar's own words.
LEXICON = {
    INSULT: "idiot idiots moron morons scum trash clown loser losers stupid pathetic worthless disgusting imbecile dumb "
            "idiotisch trottel dummkopf abschaum idiote imbécile crétin connard imbécil estúpido estúpida basura",
    THREAT: "kill murder strangle stab shoot hurt töten umbringen erschießen tuer frapper matar golpear",
    TARGET: "you your yours he she they them him her du dich dir ihr euch sie er tu toi te vous il elle ils usted ustedes tú ti él ella ellos",
    NEGATION: "not no never neither nor isn aren wasn don nicht kein keine nie niemals pas jamais aucun nunca jamás tampoco ningún",
    REPORT: "said says wrote called quoted claimed reported sagte sagt schrieb behauptete dit disait écrit dijo dice escribió",
}
#: Words after a negation that it still reaches.
NEGATION_REACH = 2
#: Grammar's weight of an output, before the fit.
PRIOR = {"insult": 2.0, "threat": 1.0}
DIRECTED, NEGATED, REPORTED = 1.5, 0.25, 0.5
#: Bounds of the fit: labelled rows it may read, terms it may add, share of the toxic rows a term must be in, and least odds.
SAMPLE_ROWS, LEARNED_TERMS, TERM_SHARE, TERM_ODDS = 20_000, 4_000, 0.004, 15.0
PREFIXES = range(4, 8)


@dataclass
class Transducer:
    """Deterministic: arcs[(state, symbol)] = (state, output); a symbol without an arc passes as it is."""

    arcs: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (self.fall(state), symbol))

    def fall(self, state):
        return self.arcs.get((state, None), (state, None))[0]

    def then(self, other: Transducer, symbols: list) -> Transducer:
        """Composition: the outputs of this machine are read by the other."""
        out, todo = Transducer(start=(self.start, other.start)), [(self.start, other.start)]
        seen = set(todo)
        while todo:
            a, b = todo.pop()
            for s in symbols:
                a2, mid = self.step(a, s)
                b2, end = other.step(b, mid)
                out.arcs[((a, b), s)] = ((a2, b2), end)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out


def _hits() -> list[str]:
    return [a + b + c for a in ("insult", "threat") for b in ("", "+neg") for c in ("", "+rep")]


def grammar() -> Transducer:
    """Negation, then reported speech, composed over the tags."""
    words = {OTHER: "w", INSULT: "insult", THREAT: "threat", TARGET: "target", NEGATION: "neg", REPORT: "rep"}
    lexical = Transducer({(0, t): (0, w) for t, w in words.items()})
    negation = Transducer()
    for left in range(NEGATION_REACH + 2):
        negation.arcs[(left, None)] = (max(0, left - 1), None)
        negation.arcs[(left, "neg")] = (NEGATION_REACH + 1, "neg")
        for hit in ("insult", "threat"):
            negation.arcs[(left, hit)] = (0, hit + "+neg" if left else hit)
    reported = Transducer({(0, "rep"): (1, "rep")})
    for hit in ("insult", "threat", "insult+neg", "threat+neg"):
        reported.arcs[(1, hit)] = (1, hit + "+rep")
    return lexical.then(negation, list(words)).then(reported, list(words))


OUTPUTS = [h + d for h in _hits() for d in ("", "+dir")]


def prior_weights() -> np.ndarray:
    return np.array([PRIOR[o.split("+")[0]] * (NEGATED if "+neg" in o else 1) * (REPORTED if "+rep" in o else 1) * (DIRECTED if "+dir" in o else 1)
                     for o in OUTPUTS])


@functools.cache
def _machine() -> Transducer:
    return grammar()


def clause_outputs(tags: list[int]) -> list[tuple[int, str]]:
    """(place, output) of the insults and threats of one clause; a target anywhere in it directs them."""
    machine = _machine()
    state, out, directed = machine.start, [], False
    for k, tag in enumerate(tags):
        state, symbol = machine.step(state, tag)
        if symbol == "target":
            directed = True
        elif tag in (INSULT, THREAT):
            out.append((k, symbol))
    return [(k, s + "+dir" if directed else s) for k, s in out]


class _Tagger:
    """Tag and strength of distinct words under a set of learned terms."""

    def __init__(self, terms: dict[str, float]):
        self.fixed = {w: t for t, words in LEXICON.items() for w in words.split()}
        self.terms = terms
        self.table = P.WordTable(self.encode, {}, self._forget)

    def _forget(self):
        self.tags, self.strength = np.zeros(0, np.int8), np.zeros(0)

    def encode(self, words):
        tags, strength = np.zeros(len(words), np.int8), np.zeros(len(words))
        for k, word in enumerate(words):
            tag = self.fixed.get(word, OTHER)
            weight = max([self.terms.get("=" + word, 0.0), *(self.terms.get(word[:n], 0.0) for n in PREFIXES if n <= len(word))])
            if tag == OTHER and weight > 0:
                tag = INSULT
            tags[k], strength[k] = tag, max(1.0, weight) if tag in (INSULT, THREAT) else 0.0
        self.tags, self.strength = np.concatenate([self.tags, tags]), np.concatenate([self.strength, strength])
        return np.ones(len(words), np.int64), np.zeros(len(words), np.int32)


def _letter_words(cp, bounds):
    """Starts and ends of the runs of letters, and single clause marks, which are pieces as well."""
    kind = P.char_classes()[cp]
    n = len(cp)
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    letter = kind == P.LETTER
    start, end = letter.copy(), letter.copy()
    if n:
        start[1:] &= ~letter[:-1] | fresh[1:n]
        end[:-1] &= ~letter[1:] | fresh[1:n]
    mark = np.isin(cp, [ord(c) for c in ".!?;:\n"])
    return np.flatnonzero(start | mark), np.flatnonzero(end | mark) + 1


_TAGGERS: dict[int, tuple] = {}


def _tagger(terms: dict[str, float]) -> _Tagger:
    key = hash(tuple(sorted(terms.items())))
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = _Tagger(terms)
    return _TAGGERS[key]


def features(texts: list[str], terms: dict[str, float]) -> np.ndarray:
    """(texts, outputs): the strengths of the matched clauses' outputs, damped by a logarithm."""
    tagger = _tagger(terms)
    tagger.table.renew()
    codes, n = P.pieces(tagger.table, texts, _letter_words, normal=str.lower)
    tagger.table.fill()
    out = np.zeros((len(texts), len(OUTPUTS)))
    number = {o: k for k, o in enumerate(OUTPUTS)}
    ends = np.cumsum(n)
    marks = [tagger.table.number[c] for c in ".!?;:\n" if c in tagger.table.number]
    tags = tagger.tags[codes]
    breaks = np.flatnonzero(np.isin(codes, marks))
    owner = np.searchsorted(ends, np.flatnonzero((tags == INSULT) | (tags == THREAT)), side="right")
    seen = -1
    for at, text in zip(np.flatnonzero((tags == INSULT) | (tags == THREAT)).tolist(), owner.tolist(), strict=True):
        if at < seen:
            continue  # of a clause that is done
        k = int(np.searchsorted(breaks, at))
        lo = max(int(ends[text] - n[text]), int(breaks[k - 1]) + 1 if k else 0)
        hi = min(int(ends[text]), int(breaks[k]) if k < len(breaks) else len(codes))
        for place, symbol in clause_outputs(tags[lo:hi].tolist()):
            out[text, number[symbol]] += tagger.strength[codes[lo + place]]
        seen = hi
    return np.log1p(out)


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features(texts, self.terms) @ self.weights + self.bias, -40, 40)))


def _term_counts(batches):
    """Documents with each word and word beginning, toxic and not, pre-summed per task."""
    toxic, clean = Counter(), Counter()
    for pdf in batches:
        for text, label in zip(pdf["text"].tolist(), pdf["toxic"].tolist(), strict=True):
            low = "".join(c if c.isalpha() else " " for c in text.lower()) if text else ""
            words = set(low.split())
            (toxic if label else clean).update({"=" + w for w in words if len(w) > 2} | {w[:n] for w in words for n in PREFIXES if n <= len(w)})
    keys = [*toxic, *(k for k in clean if k not in toxic)]
    for b in range(0, len(keys), 50_000):
        own = keys[b:b + 50_000]
        yield pd.DataFrame({"term": own, "toxic": [toxic[k] for k in own], "clean": [clean[k] for k in own]})


def _copy_mark(batches):
    """Adds a mark that copies and near copies mostly share: the least hash of five words in a row."""
    from .ngram_join import gram_sets

    for pdf in batches:
        texts = ["" if t is None else t for t in pdf["text"].tolist()]
        marks = np.zeros(len(texts), np.int64)
        for b, e, grams, per in gram_sets(texts, 5):
            at = np.cumsum(per) - per
            full = np.flatnonzero(per)
            if len(full):
                marks[b + full] = np.minimum.reduceat(grams, at[full]).view(np.int64)
        yield pdf.assign(mark=marks)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from at most ``sample_rows`` labelled rows, the first by hash of their key.

    Several labels of one key count as the largest; copies among the rows count once.  Without rows of both
    kinds the grammar's own values stand.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # bounded by sample_rows, hence fit to broadcast
    rows = texts.join(F.broadcast(chosen), "key")
    kind = docs.schema[key].dataType.simpleString()
    marked = rows.select("key", "text", "toxic").mapInPandas(_copy_mark, f"key {kind}, text string, toxic int, mark long")
    first = Window.partitionBy("mark", "toxic").orderBy("key")
    sample = cut_lineage(marked.withColumn("nth", F.row_number().over(first)).filter("nth = 1 or mark = 0").select("text", "toxic"))
    totals = sample.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    p, n = int(totals["p"] or 0), int(totals["n"] or 0)
    base = prior_weights()
    if not p or not n:
        return Model({}, base, -2.0)
    counts = sample.mapInPandas(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = ((F.col("a") + 0.5) / (p + 1)) / ((F.col("b") + 0.5) / (n + 1))
    kept = counts.filter(F.col("a") >= max(4.0, TERM_SHARE * p)).withColumn("odds", odds).filter(F.col("odds") >= TERM_ODDS)
    terms = {r["term"]: math.log(r["odds"]) for r in kept.orderBy(F.desc("a"), "term").limit(LEARNED_TERMS).collect()}

    def vectors(batches):
        for pdf in batches:
            own = features(["" if t is None else t for t in pdf["text"].tolist()], terms)
            yield pd.DataFrame({"x": own.tolist(), "toxic": pdf["toxic"]})

    # as many rows as the sample, of len(OUTPUTS) numbers each
    got = sample.mapInPandas(vectors, "x array<double>, toxic int").toPandas()
    weights, bias = _fitted(np.array(got["x"].tolist()), got["toxic"].to_numpy(), base)
    return Model(terms, weights, bias)


def _fitted(x: np.ndarray, y: np.ndarray, base: np.ndarray, pull: float = 2.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic fit by Newton steps; weights are drawn to the grammar's values and never fall below zero."""
    z = np.column_stack([x, np.ones(len(x))])
    goal = np.append(base, -2.0)
    w, ridge = goal.copy(), np.append(np.full(len(base), pull), 0.05)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * (w - goal))
        w = w - np.clip(step, -2, 2)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row by its whole text.

    A null or empty text scores as a text without matched clauses.  Rows with equal or null keys stay rows
    of their own; other columns are not read.
    """
    def run(batches):
        for whole in batches:
            texts = ["" if t is None else t for t in whole["text"].tolist()]
            for b, e in P.chunks(texts, P.SLAB_CHARS):
                own = model.scores(texts[b:e])
                yield pd.DataFrame({"key": whole["key"].iloc[b:e].tolist(), "score": own, "predicted": (own >= 0.5).astype(np.int32)})

    return rekeyed(keyed(docs, key, text).mapInPandas(run, "key string, score double, predicted int"), docs, key)


def held_out(key: str = "doc_id"):
    """Rows that no label is learned from; a null key is none of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned_and_scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted): labels of rows that are not held out teach, all rows are scored."""
    model = fit(docs, labels.filter(~held_out(key)), key, text)
    return score(docs, model, key, text).select(key, held_out(key).alias("held_out"), "score", "predicted")

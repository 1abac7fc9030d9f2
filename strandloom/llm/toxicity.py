"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns the words of a text into symbols: insult, threat, target, negation, reported speech, quote, end of clause.
Small transducers rewrite them in turn and are composed into one table: negation marks insults and threats in its reach, then
reported speech marks those told of others or quoted, then a clause transducer takes a clause's end to its kind: an insult
with a target or without one, a threat with a target, or one that is negated or reported. A clause is read whole, from mark to
mark, however long. A document's features are how many clauses of each kind it has, the heaviest word of the clauses that no
modifier takes back, and the weight of all their words, as a sum and against the text's length. A logistic model weighs them
under the grammar's own order: an insult, its target and a threat never lower a score, a negated or reported one never raises
it. Where the labels tell nothing of a kind, its weight is the one that PRIOR gives.

Insults are learned too: words, and beginnings of words, that are far more frequent in toxic documents than in clean ones, with
their log odds as weights; all that suffice are kept, but those that a shorter beginning tells as well. Both fits use at most TRAIN_ROWS labelled documents, those with the
smallest hash of doc_id and text, and never the fold that is held out. Rows alike in both count once. labels, lang, source and
doc_id are no inputs of a score.

Defined cases: null, empty and blank texts have no clauses and get the score of a text without matches; a null doc_id counts as
held out, as its text for the fold is empty; a document with several labels is toxic if any says so, null labels are ignored;
repeated rows get equal scores; without labelled rows, or with one class only, every score is that class's share (0 if there
is none); an empty table gives an empty result; only doc_id and text are read, and other columns pass through, whatever their
names (the added one gets more underscores if it is taken).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, materialize, read_table

TRAIN_ROWS = 20_000
MIN_TOXIC = 5  # toxic documents that an insult must be in
MIN_ODDS = 2.0  # its least log odds against the training rows' own
PREFIXES = (4, 5, 6, 7)
FOLDS = 5

#: Words of the closed classes, in English, German, French and Spanish.
TARGET = "you your yours yourself u ur he she they him her them his their this that these those du dich dir dein deine ihr euch euer sie er tu toi te ton ta vous votre vos il elle ils elles tú ti usted ustedes tus él ella ellos ellas".split()
NEGATION = "not no never none nobody neither nor without isn't aren't wasn't don't doesn't didn't won't can't cannot nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split()
REPORTED = "said says say saying told tells called calls calling reported reports wrote writes quoted quote claimed claims according sagte sagt nannte nennt laut zitiert dit disait appelle selon écrit dijo dice llamó llama según escribió".split()
THREAT = "kill kills killing murder hurt beat shoot stab destroy burn hang töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()

WORD = re.compile(r"\w+(?:'\w+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
QUOTES = frozenset("\"“”„«»")
REACH = 3  # words that a negation reaches
#: What the logistic model weighs: name, weight without evidence, least and greatest weight.
PRIOR = (("insults", 0.5, 0.0, np.inf), ("targeted", 0.5, 0.0, np.inf), ("threats", 3.0, 0.0, np.inf), ("negated", -0.1, -np.inf, 0.0), ("reported", -0.1, -np.inf, 0.0), ("heaviest", 0.3, 0.0, np.inf), ("meant", 0.3, 0.0, np.inf), ("dense", 0.0, 0.0, np.inf))
THREAT_WEIGHT = 2.0  # of a threat's verb among the words that are meant
SHORT = 20  # words of a text under which its length tells nothing
BETTER = 0.25  # by which a longer term's log odds must exceed those of its beginnings


class Transducer:
    """A deterministic finite-state transducer: step(state, symbol) gives (state, output symbol)."""

    def __init__(self, start, step):
        self.start, self.step = start, lru_cache(None)(step)

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: what this one writes, the other reads. Its states are pairs, tabulated as they are met."""

        def step(state, symbol):
            a, mid = self.step(state[0], symbol)
            b, out = other.step(state[1], mid)
            return (a, b), out

        return Transducer((self.start, other.start), step)


def _negation(left, s):
    if s == "negation":
        return REACH, s
    if s == "end":
        return 0, s
    if left and s in ("insult", "threat"):
        return left, s + "-negated"
    return max(0, left - 1) if s != "quote" else left, s


def _reported(state, s):
    told, quoted = state
    if s == "reported":
        return (True, quoted), s
    if s == "quote":
        return (told, not quoted), s
    if s == "end":
        return (False, False), s
    if (told or quoted) and s in ("insult", "threat"):
        return state, s + "-reported"
    return state, s


def _clause(state, s):
    """The clause's target and its strongest part so far; a kind at its end."""
    target, part = state
    if s == "end":
        kind = {"insult": "targeted" if target else "plain", "threat": "threat" if target else None, "negated": "negated", "reported": "reported"}.get(part)
        return (False, None), kind or "none"
    if s == "target":
        return (True, part), ""
    rank = ("insult", "threat", "reported", "negated", None)
    new = s if s in ("insult", "threat") else "negated" if s.endswith("-negated") else "reported" if s.endswith("-reported") else None
    return (target, min(part, new, key=rank.index)), ""


GRAMMAR = Transducer(0, _negation).then(Transducer((False, False), _reported)).then(Transducer((False, None), _clause))
_CLASSES = {w: c for c, ws in (("target", TARGET), ("negation", NEGATION), ("reported", REPORTED), ("threat", THREAT)) for w in ws}


@dataclass
class Model:
    """insults: words, and beginnings of words with a * at the end, with their weights. weights: bias first, then as in PRIOR."""

    insults: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.0


class Scorer:
    def __init__(self, insults: dict[str, float]):
        import ahocorasick

        self.words = {w: x for w, x in insults.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in insults.items() if w.endswith("*")}
        self.lengths = sorted({len(w) for w in self.stems})
        self.auto = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREAT}:
            self.auto.add_word(w, len(w))
        self.auto.make_automaton()

    def insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if n <= len(word):
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def clauses(self, text: str | None) -> list[tuple[str, float]]:
        """(kind, weight of the heaviest insult) of the clauses that match."""
        return [x[:2] for x in self.matched(text)]

    def matched(self, text: str | None) -> list[tuple[str, float, float]]:
        """(kind, weight of the heaviest insult, weight of all of them) of the clauses that match."""
        low = (text or "").lower()
        hits = sorted({end - n + 1 for end, n in self.auto.iter(low) if end - n < 0 or not low[end - n].isalnum()})
        out, done = [], -1
        marks = [m.span() for m in CLAUSE.finditer(low)] if hits else []
        for at in hits:
            if at < done:
                continue
            i = bisect_left(marks, (at,))  # marks before the hit
            begin = marks[i - 1][1] if i else 0
            done = marks[i][0] if i < len(marks) else len(low)
            found = self.clause(low[begin:done])
            if found[0] != "none":
                out.append(found)
        return out

    def clause(self, clause: str) -> tuple[str, float, float]:
        """Its kind, the weight of its heaviest word, and that of all of them."""
        state, weight, total, at = GRAMMAR.start, 0.0, 0.0, 0
        for m in WORD.finditer(clause):
            for ch in clause[at : m.start()]:
                if ch in QUOTES:
                    state, _ = GRAMMAR.step(state, "quote")
            at, word = m.end(), m.group()
            x = self.insult(word)
            symbol = "insult" if x else _CLASSES.get(word, "other")
            x = THREAT_WEIGHT if symbol == "threat" else x
            weight, total = max(weight, x), total + x
            state, _ = GRAMMAR.step(state, symbol)
        return GRAMMAR.step(state, "end")[1], weight, total

    def features(self, text: str | None) -> list[float]:
        """As PRIOR names them."""
        found = self.matched(text)
        n = {k: sum(kind == k for kind, *_ in found) for k in ("targeted", "plain", "threat", "negated", "reported")}
        meant = [x for x in found if x[0] in ("targeted", "plain", "threat")]
        total = sum(x[2] for x in meant)
        counts = [np.log1p(x) for x in (n["targeted"] + n["plain"], n["targeted"], n["threat"], n["negated"], n["reported"])]
        return [*counts, max((x[1] for x in meant), default=0.0), np.log1p(total), total / np.sqrt(max(SHORT, len(text.split()))) if meant else 0.0]


def _terms(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def _toxic_terms(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            found = [t for x in batch.column("text").slice(at, 64).to_pylist() for t in _terms(x)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["term"])


def _counter(terms: frozenset[str]):
    def run(batches):
        count: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for x in batch.column("text").slice(at, 64).to_pylist():
                    for t in _terms(x) & terms:
                        count[t] = count.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "clean"])

    return run


def _featurer(insults: dict[str, float]):
    def run(batches):
        scorer = Scorer(insults)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [scorer.features(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Bias and weights, one after the other by Newton's steps within their bounds, with a ridge about PRIOR's weights."""
    _, centre, low, high = zip(*PRIOR)
    x = np.column_stack([np.ones(len(x)), x])
    w, low, high, pen = np.array([0.0, *centre]), np.array([-np.inf, *low]), np.array([np.inf, *high]), np.array([1e-6] + [ridge] * len(centre))
    centre, z = w.copy(), x @ w
    for _ in range(500):
        most = 0.0
        for k in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = x[:, k] @ (y - p) - pen[k] * (w[k] - centre[k])
            new = np.clip(w[k] + np.clip(slope / ((x[:, k] ** 2) @ (p * (1 - p)) + pen[k]), -1, 1), low[k], high[k])
            z, most, w[k] = z + (new - w[k]) * x[:, k], max(most, abs(new - w[k])), new
        if most < 1e-7:
            break
    return w


def lexicon(odds: dict[str, float]) -> dict[str, float]:
    """The terms of at least MIN_ODDS, without those that a shorter beginning of theirs tells about as well."""
    kept: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        above = max((kept.get(t[:n] + "*", 0.0) for n in PREFIXES if n <= len(t.rstrip("*"))), default=0.0)
        if odds[t] >= MIN_ODDS and odds[t] > above + (BETTER if above else 0.0):
            kept[t] = odds[t]
    return kept


def fold(doc_id) -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    keep: list[str] = []
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    keyed = docs.select("doc_id", "text", F.md5("text").alias("sum"))
    chosen = keyed.select("doc_id", "sum").join(marked, "doc_id").distinct()
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id", "sum"), "doc_id", "sum").limit(rows), "chosen", keep)
    own = F.broadcast(chosen.withColumnRenamed("doc_id", "_id").withColumnRenamed("sum", "_sum"))  # of at most rows rows
    train = keyed.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("sum").eqNullSafe(F.col("_sum")))
    train = materialize(train.dropDuplicates(["doc_id", "sum"]).repartition(32, "doc_id", "sum").select("text", "toxic"), "train", keep)
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    model = Model(prior=bad / max(1, bad + good))
    if bad and good:
        toxic = train.where("toxic = 1").select("text").mapInArrow(_toxic_terms, "term string").groupBy("term").agg(F.count("*").alias("bad")).where(F.col("bad") >= MIN_TOXIC)
        toxic = {r["term"]: r["bad"] for r in toxic.collect()}  # a vocabulary of at most rows documents
        clean = train.where("toxic = 0").select("text").mapInArrow(_counter(frozenset(toxic)), "term string, clean bigint").groupBy("term").agg(F.sum("clean").alias("clean"))
        clean = {r["term"]: r["clean"] for r in clean.collect()}
        odds = {t: float(np.log((b + 0.5) / (bad + 1)) - np.log((clean.get(t, 0) + 0.5) / (good + 1))) for t, b in toxic.items()}
        model.insults = lexicon(odds)
        rows_ = train.mapInArrow(_featurer(model.insults), "toxic int, x array<double>").collect()
        model.weights = _logistic(np.array([r["x"] for r in rows_]), np.array([r["toxic"] for r in rows_], float)).tolist()
    discard(docs.sparkSession, keep)
    return model


def _scores(model: Model, name: str):
    def run(batches):
        scorer = Scorer(model.insults)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if model.weights:
                    x = np.array([scorer.features(t) for t in part.column("text").to_pylist()])
                    score = 1 / (1 + np.exp(-np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -30, 30)))
                else:
                    score = np.full(part.num_rows, model.prior)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column _score. Columns other than text pass through."""
    (name,) = fresh(docs.columns, "_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_scores(model, name), schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, with the columns of docs."""
    (name,) = fresh(docs.columns, "_score")
    return score(docs, fit(docs, labels)).where(F.col(name) < 0.5).drop(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))

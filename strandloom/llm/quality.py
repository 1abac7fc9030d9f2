"""Quality rules as learned decision lists.

measure() counts words, characters, symbols, lines and repeats of whole texts, and takes shares of them; these statistics alone
are what rules speak of. learn() covers the rarer verdict by rules, one after the other (sequential covering): a rule is grown
on two thirds of the labelled rows that are left, condition by condition, each a statistic against a threshold, taking that
with the most information gained; on the other third its last conditions are pruned as long as that makes it more precise. It
is accepted if it is right often enough there, and what it covers is set aside. The other verdict is the default. A list is
plain data, and column() writes it as one Spark expression, CASE WHEN rule THEN verdict ... ELSE default END, whose order is the
list's.

The base rules come first and are fixed: fewer than MIN_WORDS words, or more than REPEATED of the words in 8-word windows that
the text repeats. Lists are learned on documents that pass them. TRAIN_ROWS bounds the labelled documents that fit() takes:
those of the smallest hashes of doc_id, never of the held-out fold; rows alike in id and statistics count once.

Defined cases: null, empty and blank texts have no words, so they fail the base rules; texts of any length are read whole; a
share of nothing is 0; a document with several labels is bad if any says so, null labels are ignored; without labels, or with
labels of one kind, there are no rules and the default is that kind (kept, if there is none); repeated rows get equal results;
an empty table gives an empty result; only doc_id and text are read, and other columns pass through, whatever their names (the
added one gets more underscores if it is taken).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, chunks, discard, fresh, gram_hash, materialize, mix64, read_table, rolling, words
from .toxicity import fold

TRAIN_ROWS = 20_000
WINDOW, MIN_WORDS, REPEATED = 8, 20, 30  # words of a window, words of a text, percent
NEAR = 16  # words over which a word that comes again counts as near
MIN_PRECISION, MIN_COVER = 0.8, 5  # of a rule: on the rows held back for pruning, and rows of its verdict that it must cover
MAX_CONDITIONS = 6

#: Counts of a text, and shares (numerator, denominator) of two of them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_near_words", "n_top_word", "n_upper", "n_digits", "n_stops")
SHARES = {
    "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeat_words": ("n_repeat_words", "n_words"), "line_words": ("n_words", "n_lines"),
    "near_words": ("n_near_words", "n_words"), "top_word": ("n_top_word", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "stops": ("n_stops", "n_words"),
}
STATISTICS = ("n_words", *SHARES)

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _STOP, _UPPER, _DIGIT = _of("#*$%&|<>"), _of(".!?"), _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("0123456789")


# ---------------------------------------------------------------- statistics of texts


def _keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a text."""
    return mix64(h + (doc.astype(np.uint64) + np.uint64(1)) * _GOLD)


def count(flat: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for each text of a chunk."""
    n = len(offs) - 1

    def within(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offs])

    def per_text(doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=n)

    out = {k: within(t[flat]) for k, t in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_stops", _STOP))}
    inked = ~SPACE[flat] & ((flat & 0xC0) != 0x80)  # first bytes of code points in words
    out["word_chars"] = within(inked)
    starts, ends, first = words(flat, offs)
    own = np.diff(first)
    out["n_words"] = own
    prefix = rolling(flat, False)
    h = gram_hash(prefix, starts, ends)
    doc = np.repeat(np.arange(n), own)
    key = _keyed(doc, h)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (order[1:] - order[:-1] <= NEAR))
    out["n_near_words"] = per_text(doc[order[again + 1]])  # a share of them tells repetition whatever the length
    runs = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]]))) if len(key) else np.zeros(0, np.int64)
    out["n_top_word"] = np.zeros(n, np.int64)
    np.maximum.at(out["n_top_word"], doc[order[runs]], np.diff(np.concatenate((runs, [len(key)]))))
    # words covered by windows that come again in their text
    begin = np.flatnonzero(first[1:][doc] - np.arange(len(h)) >= WINDOW)
    acc = np.zeros(len(begin), np.uint64)
    for j in range(WINDOW):
        acc = mix64(acc * _GOLD + h[begin + j] + np.uint64(j))
    _, which, times = np.unique(_keyed(doc[begin], acc), return_inverse=True, return_counts=True)
    begin = begin[times[which] > 1]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + WINDOW, -1)
    out["n_repeat_words"] = per_text(doc[np.cumsum(cover[:-1]) > 0])
    # lines with a word
    breaks = np.flatnonzero(flat == 10)
    lo = np.unique(np.concatenate((offs[:-1][np.diff(offs) > 0], breaks + 1)))
    lo = lo[lo < len(flat)]
    hi = np.minimum(offs[np.searchsorted(offs, lo, "right")], np.concatenate((breaks, [len(flat)]))[np.searchsorted(breaks, lo)])
    inked = np.concatenate(([0], np.cumsum(inked)))
    full = inked[hi] > inked[lo]
    lo, hi = lo[full], hi[full]
    doc = np.searchsorted(offs, lo, "right") - 1
    _, at = np.unique(_keyed(doc, gram_hash(prefix, lo, hi)), return_index=True)
    out["n_lines"] = per_text(doc)
    out["n_dup_lines"] = out["n_lines"] - per_text(doc[at])
    return out


def _measurer(fields: list[str], kind: pa.StructType, name: str):
    def run(batches):
        for batch in batches:
            parts = [count(flat, offs) for _, flat, offs in chunks(batch.column("text"))]
            counts = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COUNTS}
            cols = [pa.array(counts[k].astype(np.int64)) for k in COUNTS] + [pa.array(counts[a] / np.maximum(1, counts[b])) for a, b in SHARES.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.StructArray.from_arrays(cols, fields=list(kind))], [*fields, name])

    return run


def measure(docs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs with a struct of all counts and shares, and that column's name; of docs' columns only those in keep, if given."""
    (name,) = fresh(docs.columns, "_statistics")
    fields = docs.columns if keep is None else keep
    stats = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in SHARES]
    kind = pa.struct([(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in SHARES])
    return docs.mapInArrow(_measurer(fields, kind, name), T.StructType([*(docs.schema[c] for c in fields), T.StructField(name, T.StructType(stats))])), name


def base_failed(of: str) -> Column:
    return (F.col(f"{of}.n_words") < MIN_WORDS) | (100 * F.col(f"{of}.n_repeat_words") > REPEATED * F.col(f"{of}.n_words"))


# ---------------------------------------------------------------- decision lists


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # at least the threshold, else at most
    threshold: float

    def column(self, of: str) -> Column:
        c = F.col(f"{of}.{self.statistic}")
        return c >= self.threshold if self.above else c <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] >= self.threshold if self.above else x[self.statistic] <= self.threshold

    def __str__(self):
        return f"{self.statistic} {'>=' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    verdict: bool

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, (c.holds(x) for c in self.conditions))

    def column(self, of: str) -> Column:
        return reduce(lambda a, b: a & b, (c.column(of) for c in self.conditions))

    def __str__(self):
        return f"{'keep' if self.verdict else 'drop'} if " + " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = ()
    default: bool = True

    def column(self, of: str) -> Column:
        """The verdict of the first rule that holds, as one CASE over the struct of statistics."""
        return self._case(of, [F.lit(r.verdict) for r in self.rules], F.lit(self.default))

    def reason(self, of: str) -> Column:
        """The rule that decides, in words; null where none does."""
        return self._case(of, [F.lit(str(r)) for r in self.rules], F.lit(None).cast("string"))

    def _case(self, of: str, values: list[Column], default: Column) -> Column:
        out = F
        for r, v in zip(self.rules, values):
            out = out.when(r.column(of), v)
        return default if out is F else out.otherwise(default)

    def decide(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(x["n_words"]), self.default)
        left = np.ones(len(out), bool)
        for r in self.rules:
            hit = left & r.holds(x)
            out[hit] = r.verdict
            left &= ~hit
        return out


def _grow(x: dict[str, np.ndarray], yes: np.ndarray) -> list[Condition]:
    """Conditions that take away what is not yes, each the one with the most information gained times rows of yes kept."""
    rule, on = [], np.ones(len(yes), bool)
    while len(rule) < MAX_CONDITIONS and 0 < yes[on].sum() < on.sum():
        p, t = yes[on].sum(), on.sum()
        best = (1e-9, None)
        for name, values in x.items():
            v = values[on]
            order = np.argsort(v, kind="stable")
            v, hit = v[order], np.cumsum(yes[on][order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            low_p, low_t = hit[cut], cut + 1
            for above, pos, all_ in ((False, low_p, low_t), (True, p - low_p, t - low_t)):
                gain = pos * (np.log2(np.maximum(pos, 1e-9) / all_) - np.log2(p / t))
                if len(gain) and gain[k := int(np.argmax(gain))] > best[0]:
                    best = (gain[k], Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].holds(x)
    return rule


def _worth(rule: list[Condition], x: dict[str, np.ndarray], yes: np.ndarray) -> float:
    on = reduce(np.logical_and, (c.holds(x) for c in rule))
    p, n = (on & yes).sum(), (on & ~yes).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], kept: np.ndarray) -> DecisionList:
    """A decision list from statistics and verdicts of labelled rows. Deterministic: every third row of each verdict is held back for pruning."""
    if not len(kept) or kept.all() or not kept.any():
        return DecisionList((), bool(kept.all()))
    verdict = bool(kept.mean() < 0.5)  # the rarer one
    left = np.ones(len(kept), bool)
    rules = []
    while (target := (kept == verdict) & left).any():
        place = np.where(kept == verdict, np.cumsum(target), np.cumsum(left & ~target))
        held = left & (place % 3 == len(rules) % 3)
        grow = left & ~held
        part = lambda on: ({k: v[on] for k, v in x.items()}, kept[on] == verdict)
        rule = _grow(*part(grow))
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, *part(held)))
        made = Rule(tuple(rule), verdict)
        on = made.holds(x) & left
        if (_worth(rule, *part(held)) + 1) / 2 < MIN_PRECISION or (on & target).sum() < MIN_COVER:
            break
        rules.append(made)
        left &= ~on
    return DecisionList(tuple(rules), not verdict)


def fit(measured: DataFrame, of: str, labels: DataFrame, rows: int = TRAIN_ROWS) -> DecisionList:
    """The list learned from labels (doc_id, quality 0 or 1) of documents that pass the base rules and are not held out.

    measured: doc_id and the struct of statistics; its texts are not needed any more."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("_kept")).where(fold(F.col("doc_id")) != 0)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "_labelled")  # at most rows rows, so it is broadcast
    found = measured.where(~base_failed(of)).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).select("doc_id", "_kept", *[F.col(f"{of}.{s}").alias(s) for s in STATISTICS]).distinct()
    got = found.orderBy(F.xxhash64("doc_id"), *found.columns).limit(rows).collect()
    return learn({s: np.array([r[s] for r in got], float) for s in STATISTICS}, np.array([r["_kept"] for r in got], bool))


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str, DecisionList]:
    """doc_id and the struct of statistics of each row of docs, that struct's name, and the list learned. Texts are read once."""
    measured, of = measure(docs.select("doc_id", "text"), ["doc_id"])
    measured = materialize(measured, "statistics")
    return measured, of, fit(measured, of, labels)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the base rules and the learned list, with the columns of docs."""
    keep: list[str] = []
    slim, of = measure(docs.select("doc_id", "text"), ["doc_id"])
    rules = fit(materialize(slim, "statistics", keep), of, labels)
    discard(docs.sparkSession, keep)
    all_, of = measure(docs)
    return all_.where(~base_failed(of) & rules.column(of)).drop(of)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured, of, rules = judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    failed = base_failed(of)
    base = [F.col(f"{of}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return measured.select("doc_id", *base, failed.alias("base_failed"), (~failed & rules.column(of)).alias("kept"), F.when(~failed, rules.reason(of)).alias("rule"))

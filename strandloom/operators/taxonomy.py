"""Word-presence naive Bayes, its bootstrap, reference building, and summaries of assignments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators.sampling import kfold


def fit(train: DataFrame, words: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """(word model, classes). The word model has word, log_prior = ln P_w, and gains, a map from the classes that have the word to
    ln((m + P_w) / P_w); a class without it adds only -ln(n + 1), so nothing is stored for it. classes has label, n and log_size."""
    classes = train.groupBy(label).agg(F.count("*").alias("n")).select(F.col(label).alias("label"), "n", F.ln(F.col("n") + 1).alias("log_size"))
    total = train.agg(F.count("*").alias("total"))
    m = train.select(F.col(label).alias("label"), F.explode(F.array_distinct(words)).alias("word")).groupBy("word", "label").agg(F.count("*").alias("m"))
    n = m.groupBy("word").agg(F.sum("m").alias("nw"), F.collect_list(F.struct("label", "m")).alias("by"))  # one entry a class at most
    prior = (F.col("nw") + 0.5) / (F.col("total") + 1)
    model = n.crossJoin(F.broadcast(total)).withColumn("prior", prior)
    gains = F.map_from_entries(F.transform("by", lambda x: F.struct(x["label"], F.ln((x["m"] + F.col("prior")) / F.col("prior")))))
    return model.select("word", F.ln("prior").alias("log_prior"), gains.alias("gains")), classes


# ---- scoring: counts by word, class and fold; everything else happens within the row


#: Counts (word, class, fold) that are broadcast, at some 100 bytes each at most: those of the words with most rows. The other
#: words, which are rare, meet their counts in a join.
TABLE = 1_000_000


@dataclass
class Counts:
    """cells (word, at, m): m training rows of class and fold number at = fold * classes + class have the word. sizes: fold x class."""

    cells: DataFrame
    names: list
    sizes: np.ndarray


def count_words(train: DataFrame, words: Column, label: str, fold: Column | None = None, k: int = 1) -> Counts:
    """One pass over the training rows, whatever the number of folds."""
    x = train.select(F.col(label).alias("label"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"), F.array_distinct(words).alias("words"))
    found = x.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()  # classes x folds
    names = sorted({r["label"] for r in found}, key=lambda v: (v is not None, v.encode() if isinstance(v, str) else v))
    sizes = np.zeros((k, len(names)))
    for r in found:
        sizes[r["fold"], names.index(r["label"])] = r["n"]
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")) - 1 if None not in names else F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names[1:]]), F.col("label")), F.lit(0))
    at = (F.col("fold") * len(names) + code).cast("int")
    return Counts(x.select(F.explode("words").alias("word"), at.alias("at")).groupBy("word", "at").agg(F.count("*").alias("m")), names, sizes)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e9 + 0.5) / 1e9


# ---- draws: MD5 of many short texts at once

_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
PLACES, HASHED = 64, 16_384  # draws of a row, and of all rows together, that are hashed at once
_TAIL = 5  # words that the end of a text may touch


def _digests(words: np.ndarray) -> np.ndarray:
    """The first 8 bytes, as a number, of MD5 of texts of one block each. words: 16 x texts, padded."""
    used = words.any(1)
    a, b, c, d = (np.full(words.shape[1], x) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        np.add(a, f, a), np.add(a, _ADDED[i], a)
        if used[_WORD[i]]:
            np.add(a, words[_WORD[i]], a)
        np.left_shift(a, _TURNS[i], g), np.right_shift(a, np.uint32(32) - _TURNS[i], a), np.bitwise_or(a, g, a), np.add(a, b, a)
        a, b, c, d = d, a, b, c
    first, second = ((x + y).byteswap().astype(np.uint64) for x, y in ((a, _START[0]), (b, _START[1])))
    return first << np.uint64(32) | second


@lru_cache(maxsize=256)
def _ends(draws: int, start: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends "b:j" of texts, b under draws, j in PLACES places from start: words (_TAIL x draws x PLACES) when they begin at byte `shift` of a word, and lengths."""
    texts = [f"{b}:{j}".encode() for b in range(draws) for j in range(start, start + PLACES)]
    words = np.frombuffer(b"".join((bytes(shift) + t + b"\x80").ljust(4 * _TAIL, b"\0") for t in texts), "<u4").reshape(draws, PLACES, _TAIL)
    return np.ascontiguousarray(words.transpose(2, 0, 1)), np.array([len(t) for t in texts], np.uint32).reshape(draws, PLACES)


def drawn(heads: list[bytes], sizes: list[int], draws: int) -> Iterator[np.ndarray]:
    """For each row of n words, with its head: draws x k places in it, k = max(1, n // 8). A place is the upper 60 bits of
    MD5 of head + "b:j", modulo n. Rows are hashed together, PLACES places and about HASHED texts at a time."""
    whole, held, texts = [], [], 0

    def hash_held():
        words, at = np.zeros((16, texts), np.uint32), 0
        for row, start, n_places in held:
            head, (ends, lengths), to = heads[row], _ends(draws, start, len(heads[row]) % 4), at + draws * n_places
            first, part = len(head) // 4, words[:, at:to]
            part[:first] = np.frombuffer(head[: 4 * first], "<u4")[:, None]
            part[first : first + _TAIL] = ends[:, :, :n_places].reshape(_TAIL, -1)
            part[first] |= np.uint32(int.from_bytes(head[4 * first :], "little"))
            part[14] = ((lengths[:, :n_places] + np.uint32(len(head))) * np.uint32(8)).ravel()
            at = to
        found, at = _digests(words) >> np.uint64(4), 0
        for row, start, n_places in held:
            to = at + draws * n_places
            whole[row][:, start : start + n_places] = (found[at:to] % np.uint64(sizes[row])).reshape(draws, n_places)
            at = to

    done = 0
    for row, (head, n) in enumerate(zip(heads, sizes)):
        k = max(1, n // 8) if n else 0
        whole.append(np.empty((draws, k), np.int32))
        if len(head) // 4 + _TAIL > 14 or len(f"{draws}:{k}") > 4 * _TAIL - 4:  # more than one block
            for b in range(draws):
                whole[row][b] = [(int.from_bytes(md5(head + f"{b}:{j}".encode()).digest()[:8]) >> 4) % n for j in range(k)]
            continue
        for start in range(0, k, PLACES):
            held.append((row, start, min(PLACES, k - start)))
            texts += draws * held[-1][2]
            if texts >= HASHED:
                hash_held()
                held, texts = [], 0
                ready = row if start + PLACES < k else row + 1
                for done in range(done, ready):
                    yield whole[done]
                    whole[done] = None
                done = ready
    if held:
        hash_held()
    yield from whole[done:]


class _Scorer:
    def __init__(self, sizes: np.ndarray, n_bootstrap: int, seed: int):
        self.sizes, self.n_bootstrap, self.seed = sizes, n_bootstrap, seed

    def draws(self, keys: list, sizes: list[int]) -> Iterator[np.ndarray]:
        """Of each row, by its key and number of words."""
        return drawn([f"{self.seed}:{k}:".encode() for k in keys], sizes, self.n_bootstrap)

    def best(self, n: int, draws: np.ndarray, fold: int | None, word: np.ndarray, at: np.ndarray, m: np.ndarray) -> tuple[int | None, int]:
        """The best class of a row of n words and how many draws of an eighth of them agree. word, at, m: the counts that they have.

        The counts of the row's own fold are taken away first. On a tie the first class wins."""
        size = self.sizes.sum(0)
        if fold is not None:
            size = size - self.sizes[fold]
            m = np.where(at // len(size) == fold, 0, m)
        count = np.bincount(word * len(size) + at % len(size), m, n * len(size)).reshape(n, len(size))
        open_ = size > 0
        if not n or not open_.any():
            return None, 0
        prior = (count.sum(1, keepdims=True) + 0.5) / (size.sum() + 1)
        gain, log_size = np.log((count + prior) / prior) * (count > 0), np.log(size + 1)
        choose = lambda s: np.where(open_, _rounded(s), -np.inf).argmax(-1)
        best = int(choose(gain.sum(0) - n * log_size))
        if not self.n_bootstrap:
            return best, 0
        scores = np.stack([g[draws].sum(1) for g in np.ascontiguousarray(gain.T)], 1) - draws.shape[1] * log_size
        return best, int((choose(scores) == best).sum())


CARRIED = ["key", "fold", "truth", "weight"]


def _result(parts: list, names: list, batch: pa.RecordBatch) -> pa.RecordBatch:
    text = pa.array([None if b is None or names[b] is None else str(names[b]) for b, _ in parts], pa.string()).fill_null("")
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in CARRIED), text, pa.array([v for _, v in parts], pa.int64())], [*CARRIED, "predicted", "votes"])


def _looked_up(lists: pa.ListArray, place: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(ends of the rows, starting with 0; of each word its place, -1 if it has none; its number in the batch; the batch's distinct words).
    A word is looked up once a batch."""
    coded = lists.flatten().dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    places = np.array([place.get(w, -1) for w in distinct], np.int64)
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), places[code], code, distinct


def _scored(shared, names: list, scorer: _Scorer, folded: bool):
    """Scores rows (key, fold, words, rare) by a broadcast table, the places of words and, one after the other, their counts; and by
    rare, the counts (word, cells) of words that are not in it, null if there are none."""

    def run(batches):
        place, start, at, m = shared.value
        for batch in batches:
            out, folds = [], batch.column("fold").to_pylist()
            ends, every, code, distinct = _looked_up(batch.column("words"), place)
            draws = scorer.draws(batch.column("key").to_pylist(), np.diff(ends).tolist())
            for fold, lo, hi, rare, places in zip(folds, ends, ends[1:], batch.column("rare").to_pylist(), draws):
                p = every[lo:hi]
                hit = np.flatnonzero(p >= 0)
                size = start[p[hit] + 1] - start[p[hit]]
                cell = np.repeat(start[p[hit]] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(hit) else np.zeros(0, np.int64)
                found = (np.repeat(hit, size) if len(hit) else hit, at[cell], m[cell])
                if rare:
                    more = {r["word"]: r["cells"] for r in rare}
                    more = [(i, c["at"], c["m"]) for i in np.flatnonzero(p < 0).tolist() for c in more.get(distinct[code[lo + i]], ())]
                    found = tuple(np.concatenate([x, np.array(y, np.int64)]) for x, y in zip(found, zip(*more))) if more else found
                out.append(scorer.best(len(p), places, fold if folded else None, *found))
            yield _result(out, names, batch)

    return run


def _unknown(shared):
    """(row, word) for the words of rows (row, words) that are not in the broadcast table."""

    def run(batches):
        place = shared.value[0]
        for batch in batches:
            ends, every, code, distinct = _looked_up(batch.column("words"), place)
            new = np.flatnonzero(every < 0)
            at = np.repeat(np.arange(batch.num_rows), np.diff(ends))[new]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), pa.array(distinct, pa.string()).take(pa.array(code[new]))], ["row", "word"])

    return run


def evaluate(query: DataFrame, key: str, words: Column, counts: Counts, n_bootstrap: int = 0, seed: int = 42, fold: Column | None = None, truth: Column | None = None, weight: Column | None = None) -> DataFrame:
    """key, fold, truth (as text), weight, predicted, votes, a row for each row of query; predicted is empty for rows without words.

    With fold, a row is scored by the counts of all other folds. Up to TABLE counts, of the words with most rows, are broadcast and
    cover nearly all of a row's words where it lies. Words beyond them are rare: only these are joined to their counts, which then
    meet their rows again."""
    spark, folded = query.sparkSession, fold is not None
    own = F.coalesce(F.array_sort(F.array_distinct(words)), F.array().cast("array<string>"))
    q = query.select(F.col(key).alias("key"), (fold if folded else F.lit(0)).cast("int").alias("fold"), (F.lit(None) if truth is None else truth).cast("string").alias("truth"), (F.lit(None) if weight is None else weight).cast("long").alias("weight"), own.alias("words"))
    kind = dict(q.dtypes)["key"]
    schema, scorer = f"key {kind}, fold int, truth string, weight long, predicted string, votes long", _Scorer(counts.sizes, n_bootstrap, seed)
    by = counts.cells.groupBy("word").agg(F.floor(F.log2(F.sum("m")) * 4).cast("int").alias("level"), F.collect_list(F.struct("at", F.col("m").cast("int").alias("m"))).alias("cells"))  # classes x folds at most
    by = by.persist(StorageLevel.MEMORY_AND_DISK)  # read up to three times; lost blocks are computed again
    levels = by.groupBy("level").agg(F.sum(F.size("cells")).alias("n")).orderBy(F.desc("level")).collect()  # 4 for each doubling of a word's rows
    least, total = None, 0
    for r in levels:
        total += r["n"]
        if total > TABLE:
            break
        least = r["level"]
    common = by.where(F.lit(False) if least is None else F.col("level") >= least).select("word", F.explode("cells").alias("c")).select("word", "c.at", "c.m").toArrow().sort_by("word")
    place, start = {}, []
    for i, w in enumerate(common.column("word").to_pylist()):
        if w not in place:
            place[w] = len(place)
            start.append(i)
    start = np.array([*start, common.num_rows])
    shared = spark.sparkContext.broadcast((place, start, common.column("at").to_numpy(), common.column("m").to_numpy()))
    rare = F.lit(None).cast("array<struct<word:string,cells:array<struct<at:int,m:int>>>>").alias("rare")
    if total <= TABLE:
        by.unpersist()
        x = q.select(*CARRIED, "words", rare)
    else:
        q = q.withColumn("row", F.unhex(F.md5(F.to_json(F.struct(*CARRIED, "words"), {"ignoreNullFields": "false"}))))
        asked = q.select("row", "words").mapInArrow(_unknown(shared), "row binary, word string")
        left = by if least is None else by.where(F.col("level") < least)
        found = asked.join(left.select("word", "cells"), "word").groupBy("row").agg(F.collect_set(F.struct("word", "cells")).alias("rare"))  # a set, as rows that are alike in all have one digest
        x = q.join(found, "row", "left").select(*CARRIED, "words", "rare")
    return x.mapInArrow(_scored(shared, counts.names, scorer, folded), schema).withColumnRenamed("key", key)


def classify(query: DataFrame, key: str, words: Column, counts: Counts) -> DataFrame:
    """key, predicted: the best class, the first by name on a tie; empty for rows without words."""
    return evaluate(query, key, words, counts).select(key, "predicted")


def bootstrap(query: DataFrame, key: str, words: Column, counts: Counts, n_bootstrap: int = 100, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """key, predicted, votes, confidence: how many of n_bootstrap draws of an eighth of the words agree. Draws are by hash.

    A weight (reads, say) is passed on."""
    x = evaluate(query, key, words, counts, n_bootstrap, seed, weight=weight)
    return x.select(key, "predicted", "votes", (F.col("votes") / n_bootstrap).alias("confidence"), *([] if weight is None else ["weight"]))


def assigned(df: DataFrame, threshold: float = 0.7, n_bootstrap: int = 100) -> DataFrame:
    """df with assigned; votes are compared, as a confidence of exactly the threshold counts."""
    return df.withColumn("assigned", F.col("votes") >= F.lit(round(threshold * n_bootstrap, 9)))


def assignment_summary(df: DataFrame, count: str | None = None) -> DataFrame:
    """Totals, rate, classes, confidence with deciles, and the read-weighted rate if a count is named."""
    r = S.round_to
    rate = F.avg(F.col("assigned").cast("double"))
    deciles = F.percentile("confidence", F.array(*[F.lit(i / 10) for i in range(11)]))
    extra = [] if count is None else [r(F.sum(F.when(F.col("assigned"), F.col(count)).otherwise(0)) / F.sum(count)).alias("read_assignment_rate")]
    return df.agg(
        F.count("*").alias("n_queries"), F.count(F.when(F.col("assigned"), 1)).alias("n_assigned"), F.count(F.when(~F.col("assigned"), 1)).alias("n_unassigned"), r(rate).alias("assignment_rate"),
        F.countDistinct(F.when(F.col("assigned"), F.col("predicted"))).alias("n_distinct_classes"), r(F.avg("confidence")).alias("mean_confidence"), r(F.percentile("confidence", F.lit(0.5))).alias("median_confidence"),
        F.transform(deciles, lambda x: r(x, 4)).alias("confidence_deciles"), *extra,
    )


def top_classes(df: DataFrame, n: int = 15) -> DataFrame:
    return df.where("assigned").groupBy("predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicted").limit(n)


def class_sizes(classes: DataFrame) -> DataFrame:
    return classes.agg(F.count("*").alias("n_classes"), F.sum("n").alias("n_reference"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.percentile("n", F.lit(0.5)).alias("median"), F.count(F.when(F.col("n") == 1, 1)).alias("classes_with_one_reference"))


def build_reference(sequences: DataFrame, taxonomy: DataFrame, core: str = S.CORE_PRIMER, region: int = 151, least: int = 100) -> DataFrame:
    """Windows of in-silico PCR with their lineages: accession, sequence, taxonomy and nine ranks. The primer must be present, the
    window long enough and the lineage known."""
    x = sequences.withColumn("sequence", S.pcr_window(F.col("sequence"), core, region)).where(F.length("sequence") >= least)
    x = x.join(taxonomy.where("taxonomy != ''"), "accession")
    return x.select("accession", "sequence", "taxonomy", *[c.alias(rank) for rank, c in S.lineage(F.col("taxonomy")).items()])


def rank_counts(reference: DataFrame) -> DataFrame:
    """rank and how many distinct names it has."""
    one = reference.agg(*[F.countDistinct(F.when(F.col(r) != "", F.col(r))).alias(r) for r in S.RANKS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).alias("n")) for r in S.RANKS])).alias("x")).select("x.rank", "x.n")


def cross_validate(df: DataFrame, key: str, words: Column, label: str, k: int = 5, n_bootstrap: int = 50, seed: int = 42) -> DataFrame:
    """fold, n, accuracy, mean confidence when right and when wrong. Folds are equal, by ranks of draws.

    All folds share one count of words: a row is scored by it less what its own fold has, so no model is fitted anew."""
    folds = kfold(df.select(F.col(key).alias("_key"), F.col(label).alias("_truth"), F.array_sort(F.array_distinct(words)).alias("_words")), F.col("_key"), k, seed)  # each word once, as these are shuffled
    counts = count_words(folds, F.col("_words"), "_truth", F.col("fold"), k)
    x = evaluate(folds, "_key", F.col("_words"), counts, n_bootstrap, seed, F.col("fold"), F.col("_truth"))
    x = x.select("fold", (F.col("predicted") == F.col("truth")).alias("correct"), (F.col("votes") / n_bootstrap).alias("confidence"))
    mean = lambda c: S.round_to(F.avg(c))
    return x.groupBy("fold").agg(F.count("*").alias("n"), mean(F.col("correct").cast("double")).alias("accuracy"), mean(F.when(F.col("correct"), F.col("confidence"))).alias("confidence_correct"), mean(F.when(~F.col("correct"), F.col("confidence"))).alias("confidence_wrong"))

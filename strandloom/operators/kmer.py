"""k-mer features: the vocabulary, a relational form, and an Arrow encoder that gives the same vectors faster."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import sequences as S


@lru_cache(None)
def vocabulary(k: int, canonical: bool = True) -> tuple[str, ...]:
    if not 1 <= k <= 8:
        raise ValueError("k must be from 1 to 8")
    words = ("".join(w) for w in product(S.BASES, repeat=k))
    flip = str.maketrans(S.BASES, S.COMPLEMENT)
    return tuple(sorted({min(w, w.translate(flip)[::-1]) if canonical else w for w in words}))


def vocabulary_table(spark: SparkSession, k: int, canonical: bool = True) -> DataFrame:
    """idx and kmer, by joins of the four bases."""
    base = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in S.BASES])).alias("b"))
    words = base.select(F.col("b").alias("kmer"))
    for _ in range(k - 1):
        words = words.crossJoin(base).select(F.concat("kmer", "b").alias("kmer"))
    if canonical:
        words = words.select(S.canonical(F.col("kmer")).alias("kmer")).distinct()
    every = F.array_sort(F.collect_list("kmer"))
    return words.agg(every.alias("all")).select(F.posexplode("all").alias("idx", "kmer")).select(F.col("idx").cast("bigint").alias("idx"), "kmer")


def vocabulary_counts(reads: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """idx, kmer and n: how often the reads have each k-mer of the vocabulary, 0 included. Tasks count in Arrow batches; what is
    shuffled is as large as the vocabulary."""

    def count(batches):
        total = np.zeros(len(vocabulary(k, canonical)), np.int64)
        for batch in batches:
            _, code = _codes([s or "" for s in batch.column(0).to_pylist()], k)
            total += np.bincount(_slots(k, canonical)[code], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["idx", "n"])

    found = reads.select("sequence").mapInArrow(count, "idx bigint, n bigint").groupBy("idx").agg(F.sum("n").alias("n"))
    every = vocabulary_table(reads.sparkSession, k, canonical)
    return every.join(found, "idx", "left").select("idx", "kmer", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def frequencies(reads: DataFrame, key: str, k: int, canonical: bool = True) -> DataFrame:
    """key, kmer, frequency in long form: what of a read's valid k-mers each one is. k-mers with other characters are skipped.

    Each row is a read of its own and is counted where it lies, in Arrow batches, without a shuffle. k is 31 at most."""
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31")

    def count(batches):
        for batch in batches:
            row, code = _codes([s or "" for s in batch.column(1).to_pylist()], k)
            code = np.minimum(code, _flipped(code, k)) if canonical else code
            codes, slot = np.unique(code, return_inverse=True)
            pair, n = np.unique(row * max(len(codes), 1) + slot, return_counts=True)
            at, word = np.divmod(pair, max(len(codes), 1))
            total = np.bincount(row, minlength=batch.num_rows)
            columns = [batch.column(0).take(pa.array(at)), pa.array(_spelled(codes, k), pa.string()).take(pa.array(word)), pa.array(n / total[at])]
            yield pa.RecordBatch.from_arrays(columns, [key, "kmer", "frequency"])

    x = reads.select(key, "sequence")
    return x.mapInArrow(count, T.StructType([x.schema[key], T.StructField("kmer", T.StringType()), T.StructField("frequency", T.DoubleType())]))


def _codes(sequences: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every k-mer of ACGT alone, the number of its sequence and its bases as digits of a number to base 4."""
    digit = np.full(256, -1, np.int64)
    digit[[ord(b) for b in S.BASES]] = range(4)
    raw = [s.encode("latin-1", "replace") for s in sequences]
    flat = digit[np.frombuffer(b"".join(raw), np.uint8)]
    n = max(len(flat) - k + 1, 0)
    code, good = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k if n else 0):
        part = flat[j : j + n]
        code = code * 4 + np.maximum(part, 0)
        good &= part >= 0
    row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    good &= row[:n] == row[len(row) - n :]
    return row[:n][good], code[good]


def _flipped(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    out, rest = np.zeros_like(code), code.copy()
    for _ in range(k):
        out = out * 4 + 3 - rest % 4
        rest //= 4
    return out


def _spelled(code: np.ndarray, k: int) -> list[str]:
    return ["".join(S.BASES[(c >> 2 * i) & 3] for i in range(k - 1, -1, -1)) for c in code.tolist()]


class Encoder(Protocol):
    """What turns sequences into vectors: a name, a width, and a function on a batch that runs on the workers."""

    name: str
    dim: int

    def encode_batch(self, sequences: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class KmerEncoder:
    k: int = 4
    canonical: bool = True
    include_gc: bool = False
    include_length: bool = False

    @property
    def name(self) -> str:
        return f"kmer{self.k}"

    @property
    def dim(self) -> int:
        return len(vocabulary(self.k, self.canonical)) + self.include_gc + self.include_length

    def feature_names(self) -> list[str]:
        return [*vocabulary(self.k, self.canonical), *["gc_content"] * self.include_gc, *["length"] * self.include_length]

    def encode_batch(self, sequences: list[str]) -> np.ndarray:
        words = vocabulary(self.k, self.canonical)
        slot = _slots(self.k, self.canonical)
        row, code = _codes(sequences, self.k)
        counts = np.bincount(row * len(words) + slot[code], minlength=len(sequences) * len(words)).reshape(len(sequences), -1)
        out = np.zeros((len(sequences), self.dim), np.float32)
        out[:, : len(words)] = counts / np.maximum(counts.sum(1), 1)[:, None]
        if self.include_gc:
            gc = np.array([s.count("G") + s.count("C") for s in sequences])
            at = np.array([s.count("A") + s.count("T") for s in sequences])
            out[:, len(words)] = gc / np.maximum(gc + at, 1)
        if self.include_length:
            out[:, -1] = [len(s) for s in sequences]
        return out


@lru_cache(None)
def _slots(k: int, canonical: bool) -> np.ndarray:
    at = {w: i for i, w in enumerate(vocabulary(k, canonical))}
    flip = str.maketrans(S.BASES, S.COMPLEMENT)
    every = ("".join(w) for w in product(S.BASES, repeat=k))
    return np.array([at[min(w, w.translate(flip)[::-1]) if canonical else w] for w in every])


def encode(sequence: Column, encoder: Encoder) -> Column:
    """The encoder as an Arrow-batched column function."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode_batch(batch.fillna("").tolist())))

    return run(sequence)


def token_fit(reads: DataFrame, tokenize, limit: int, unknown: int | None = None) -> dict:
    """What a tokenizer makes of every read, and a ValueError if one has more than limit tokens, since nothing may be cut off.

    tokenize turns a list of sequences into lists of ids and runs on the workers; ids equal to unknown are counted. A null sequence
    is empty; without reads or without tokens the figures that need them are None."""

    @F.pandas_udf("struct<n:bigint, unknown:bigint>")
    def measure(batch: pd.Series) -> pd.DataFrame:
        ids = [list(x) for x in tokenize(batch.tolist())]
        return pd.DataFrame({"n": [len(x) for x in ids], "unknown": [0 if unknown is None else x.count(unknown) for x in ids]}, dtype="int64")

    x = reads.select(F.coalesce("sequence", F.lit("")).alias("sequence")).select(F.length("sequence").alias("bp"), measure("sequence").alias("t"))
    bp, n = F.col("bp"), F.col("t.n")
    row = x.agg(
        F.count("*").alias("reads"), F.min(bp).alias("bp_min"), F.max(bp).alias("bp_max"), F.min(n).alias("tokens_min"), F.max(n).alias("tokens_max"), F.round(F.avg(n), 3).alias("tokens_mean"),
        F.round(F.try_divide(F.sum(bp), F.sum(n)), 3).alias("bp_per_token"), F.coalesce(F.sum("t.unknown"), F.lit(0)).alias("unknown_tokens"),
    ).first().asDict()
    longest = row["tokens_max"] or 0
    if longest > limit:
        raise ValueError(f"a read has {longest} tokens, the encoder takes {limit}")
    return row | {"token_limit": limit, "limit_used": round(longest / limit, 5)}


def build_encoder(name: str, **options) -> Encoder:
    """kmer is built in. Encoders from foundation models follow the same protocol; their weights are not part of this library."""
    if name != "kmer":
        raise ValueError(f"unknown encoder {name!r}")
    return KmerEncoder(**options)


def largest_difference(a: Column, b: Column) -> Column:
    """The greatest absolute difference of two vectors' components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, x: F.greatest(m, x.cast("double")))

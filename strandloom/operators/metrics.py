"""Metrics of classifications and partitions, from contingency tables: one shuffle of few rows each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators.sampling import running_total


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_normalised(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return confusion(df, truth, predicted).withColumn("share", S.round_to(F.col("n") / F.sum("n").over(W.partitionBy("truth"))))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support; 0 where undefined."""
    c = confusion(df, truth, predicted)
    x = c.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")),
                                   F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")))).alias("x"))
    by = x.groupBy("x.class").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum("x.h").alias("h"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    by = by.withColumn("_p", ratio("h", "p")).withColumn("_r", ratio("h", "t"))
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("h") / (F.col("t") + F.col("p"))).otherwise(0.0)
    return by.select("class", F.col("_p").alias("precision"), F.col("_r").alias("recall"), f1.alias("f1"), F.col("t").alias("support"), F.col("h").alias("hits"))


def summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    r = S.round_to
    return per_class(df, truth, predicted).agg(
        r(F.sum("hits") / F.sum("support")).alias("accuracy"), r(F.avg("precision")).alias("macro_precision"), r(F.avg("recall")).alias("macro_recall"), r(F.avg("f1")).alias("macro_f1"),
        r(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n_test"), F.count("*").alias("n_classes"),
    )


def calibration_bins(df: DataFrame, confidence: str, correct: str, n_bins: int = 15) -> DataFrame:
    """Reliability bins (lower, upper], with the empty ones; a confidence of 0 is in none."""
    b = F.ceil(F.col(confidence) * n_bins)
    by = df.where(F.col(confidence) > 0).groupBy(b.cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    every = df.sparkSession.range(1, n_bins + 1).withColumnRenamed("id", "bin")
    return every.join(by, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"), S.round_to(F.col("c")).alias("mean_confidence"), S.round_to(F.col("a")).alias("accuracy"))


def median(df: DataFrame, column: str) -> DataFrame:
    """One row with the exact median of the numbers of a column, null without any. Values are counted and summed up by ranges, so that
    no task holds all distinct ones."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    x = running_total(counts, "v", "k").crossJoin(F.broadcast(counts.agg(F.sum("k").alias("n"))))
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("k")), F.col("v")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return x.agg(((at(low) + at(high)) / 2).alias("median"))


def calibration_summary(df: DataFrame, confidence: str, correct: str, brier: Column, n_bins: int = 15) -> DataFrame:
    """Mean and median confidence, Brier score, expected calibration error, confidence categories."""
    x = df.select(F.col(confidence).alias("c"), F.col(correct).cast("double").alias("h"), brier.alias("b"))
    by = x.where("c > 0").groupBy(F.ceil(F.col("c") * n_bins).alias("bin")).agg(F.sum("c").alias("sc"), F.sum("h").alias("sh"))
    ece = by.agg(F.coalesce(F.sum(F.abs(F.col("sc") - F.col("sh"))), F.lit(0.0)).alias("gap"))
    r = S.round_to
    one = x.agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.avg("b").alias("brier"), F.count(F.when(F.col("c") >= 0.9, 1)).alias("high"),
                F.count(F.when((F.col("c") >= 0.7) & (F.col("c") < 0.9), 1)).alias("medium"), F.count(F.when(F.col("c") < 0.7, 1)).alias("low"))
    return one.crossJoin(ece).crossJoin(median(x, "c")).select("n", r(F.col("mean")).alias("mean_confidence"), r(F.col("median")).alias("median_confidence"), r(F.col("brier")).alias("brier_score"), r(F.col("gap") / F.col("n")).alias("expected_calibration_error"), "high", "medium", "low")


# ---- partitions


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and Fowlkes-Mallows index, in closed form."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    cells = c.agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    rows = c.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("sa"))
    cols = c.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("sb"))
    expected = F.col("sa") * F.col("sb") / _pairs(F.col("n"))
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected))
    fm = F.when(F.col("sa") * F.col("sb") == 0, 0.0).otherwise(F.col("s") / F.sqrt(F.col("sa") * F.col("sb")))
    return cells.crossJoin(rows).crossJoin(cols).select(F.col("n").cast("bigint").alias("n"), S.round_to(ari).alias("adjusted_rand"), S.round_to(fm).alias("fowlkes_mallows"))


def _expected_information(x: int, y: int, n: int, block: int = 4096) -> float:
    """What a class of x and one of y of n rows share by chance: hypergeometric terms outwards from the likeliest overlap, in blocks,
    until they are 0 in double precision."""
    low, high = max(1, x + y - n), min(x, y)
    top = min(max((x + 1) * (y + 1) // (n + 2), low), high)
    g = lambda *v: sum(math.lgamma(i + 1) for i in v)
    start = g(x, y, n - x, n - y) - g(n, top, x - top, y - top, n - x - y + top)
    term = lambda k, logp: float((k / n * np.log(n * k / (x * y)) * np.exp(logp)).sum())
    total = term(np.array([float(top)]), np.array([start]))
    at, logp = top, start
    while at < high and logp > -745:
        k = np.arange(at, min(at + block, high), dtype=float)  # from k to k + 1
        steps = logp + np.cumsum(np.log((x - k) * (y - k)) - np.log((k + 1) * (n - x - y + k + 1)))
        total += term(k + 1, steps)
        at, logp = int(k[-1]) + 1, steps[-1]
    at, logp = top, start
    while at > low and logp > -745:
        k = np.arange(at, max(at - block, low), -1, dtype=float)  # from k to k - 1
        steps = logp + np.cumsum(np.log(k * (n - x - y + k)) - np.log((x - k + 1) * (y - k + 1)))
        total += term(k - 1, steps)
        at, logp = int(k[-1]) - 1, steps[-1]
    return total


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> float:
    """AMI with arithmetic mean. Only sums come to the driver; chance is computed for each pair of class sizes that occur."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    plogp = lambda c: F.sum(F.col(c) * F.ln(c))
    sizes = [cells.groupBy(side).agg(F.sum("n").alias("n")).groupBy("n").agg(F.count("*").alias("m")) for side in "ab"]
    n, joint = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), plogp("n")).first()
    (ka, sa), (kb, sb) = (x.agg(F.coalesce(F.sum("m"), F.lit(0)), F.sum(F.col("m") * F.col("n") * F.ln("n"))).first() for x in sizes)
    if ka == kb and ka in (1, n):
        return 1.0

    @F.pandas_udf("double")
    def chance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_expected_information(int(i), int(j), n) for i, j in zip(x, y)], dtype="float64")

    left, right = sizes[0].select(F.col("n").alias("x"), F.col("m").alias("mx")), sizes[1].select(F.col("n").alias("y"), F.col("m").alias("my"))
    expected = left.crossJoin(right).agg(F.sum(F.col("mx") * F.col("my") * chance("x", "y"))).first()[0]
    ha, hb = math.log(n) - sa / n, math.log(n) - sb / n
    mi, mean = ha + hb - (math.log(n) - joint / n), (ha + hb) / 2
    return (mi - expected) / (mean - expected) if mean != expected else 1.0


def variance_explained(df: DataFrame, group: str, value: str) -> DataFrame:
    """1 - within / total population variance; 0 without variance."""
    by = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = by.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n")).alias("q"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    total = F.col("within") + F.col("q") - F.col("mean") * F.col("mean")
    return t.select(S.round_to(F.when(total <= 1e-15, 0.0).otherwise(1 - F.col("within") / total)).alias("variance_explained"))


def cluster_profile(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: variants, reads and shares, GC, top variant, dominant end and purity. df has count, gc_content, end."""
    by = df.groupBy(cluster).agg(F.count("*").alias("n_variants"), F.sum("count").alias("n_reads"), S.round_to(F.avg("gc_content") * 100, 3).alias("mean_gc"), S.round_to(F.stddev_pop("gc_content") * 100, 3).alias("sd_gc"), F.max("count").alias("top_variant_reads"))
    ends = df.where("end >= 0").groupBy(cluster, "end").agg(F.count("*").alias("n")).groupBy(cluster).agg(F.max_by("end", F.struct("n", -F.col("end"))).alias("dominant_end"), S.round_to(F.max("n") / F.sum("n"), 4).alias("end_purity"))
    every = W.partitionBy(F.lit(0))
    return by.join(ends, cluster, "left").withColumn("variant_share", S.round_to(F.col("n_variants") / F.sum("n_variants").over(every))).withColumn("read_share", S.round_to(F.col("n_reads") / F.sum("n_reads").over(every)))

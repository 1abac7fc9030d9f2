"""Dereplication, diversity and rarefaction. Statistics come from the frequency spectrum, never from the variants."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import sequences as S


#: Records of a block, within which one task ranks the variants of a count.
BLOCK = 1 << 18
#: Ranks of equal abundance that are made from one row.
RUN = 1 << 14


def count_variants(reads: DataFrame, canonical: bool = False) -> DataFrame:
    """sequence, count and first_index: one shuffle of distinct sequences, counted before it."""
    seq = S.canonical(F.col("sequence")) if canonical else F.col("sequence")
    return reads.groupBy(seq.alias("sequence")).agg(F.count("*").alias("count"), F.min("record_index").alias("first_index"))


def variant_table(counts: DataFrame, top: int | None = None, min_count: int = 1) -> DataFrame:
    """The ranked table: the top variants first, then those of enough reads. Ties go to the first record.

    With a bound the rank is of top-n rows only; without one, ranks come from counts of the rows of greater count and, within a
    count, of those of earlier blocks of records, so that no task ranks all variants or all those seen once."""
    if top is not None:
        ranked = counts.orderBy(F.desc("count"), "first_index").limit(top)
        rank = F.row_number().over(W.orderBy(F.desc("count"), "first_index"))
        ranked = ranked.withColumn("rank", rank)
    else:
        below = frequency_spectrum(counts).withColumn("before", F.coalesce(F.sum("f").over(W.orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        at = counts.withColumn("_block", F.floor(F.col("first_index") / BLOCK).cast("bigint"))
        own = at.groupBy("count", "_block").agg(F.count("*").alias("_n"))
        own = own.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy("count").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        starts = own.join(below.select(F.col("k").alias("count"), "before"), "count")
        within = F.row_number().over(W.partitionBy("count", "_block").orderBy("first_index"))
        ranked = at.join(starts, ["count", "_block"]).withColumn("rank", F.col("before") + F.col("_start") + within).drop("before", "_start", "_block")
    ranked = ranked.where(F.col("count") >= min_count)
    return ranked.select(
        (F.col("rank") - 1).cast("bigint").alias("variant_id"), "sequence", "count", F.length("sequence").cast("bigint").alias("length"),
        S.gc_content(F.col("sequence")).alias("gc_content"), F.col("rank").cast("bigint").alias("rank"),
    )


def with_counts(df: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """df with count, the reads of each row's variant; 1 where counts (key, count) does not have it."""
    return df.drop("count").join(counts.select(key, "count"), key, "left").withColumn("count", F.coalesce("count", F.lit(1)).cast("bigint"))


def frequency_spectrum(counts: DataFrame) -> DataFrame:
    """k, f: how many variants are seen k times."""
    return counts.groupBy(F.col("count").alias("k")).agg(F.count("*").alias("f"))


def dereplication_summary(counts: DataFrame) -> DataFrame:
    n = F.count("*")
    x = counts.agg(F.sum("count").alias("reads"), n.alias("unique_variants"), F.count(F.when(F.col("count") == 1, 1)).alias("singletons"), F.count(F.when(F.col("count") == 2, 1)).alias("doubletons"), F.max("count").alias("most_abundant"))
    return x.withColumn("digest_collision_probability", F.col("unique_variants") * F.col("unique_variants") / F.lit(2.0**65))


def diversity(spectrum: DataFrame) -> DataFrame:
    """All indices of a spectrum, one row; none without reads."""
    t = spectrum.agg(F.sum(F.col("k") * F.col("f")).alias("n"), F.sum("f").alias("s"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("f"))), F.lit(0)).alias("f1"),
                     F.coalesce(F.sum(F.when(F.col("k") == 2, F.col("f"))), F.lit(0)).alias("f2"), F.max("k").alias("top")).where("n > 0")
    p = F.col("k") / F.col("n")
    x = spectrum.crossJoin(F.broadcast(t)).groupBy("n", "s", "f1", "f2", "top").agg((-F.sum(F.col("f") * p * F.ln(p))).alias("h"), F.sum(F.col("f") * p * p).alias("d"))
    n, s, f1, f2, h, d = (F.col(c) for c in ("n", "s", "f1", "f2", "h", "d"))
    chao = s + f1 * (f1 - 1) / (2 * (f2 + 1))
    r = S.round_to
    return x.select(
        n.alias("reads"), s.alias("observed_richness_variants"), f1.alias("singletons"), f2.alias("doubletons"), r(f1 / s).alias("singleton_fraction_of_variants"), r(f1 / n, 8).alias("singleton_fraction_of_reads"),
        r(h).alias("shannon_h"), r(d, 8).alias("simpson_d"), r(1 / d, 4).alias("inverse_simpson"), r(1 - d, 8).alias("gini_simpson"), r(F.when(s > 1, h / F.ln(s)).otherwise(0.0)).alias("pielou_evenness_j"),
        r(F.exp(h), 4).alias("hill_q1_exp_shannon"), r(chao, 2).alias("chao1_estimated_richness"), r(chao / s, 4).alias("chao1_over_observed"), r(1 - f1 / n, 8).alias("goods_coverage"),
        F.col("top").alias("most_abundant_variant_reads"), r(F.col("top") / n, 8).alias("most_abundant_variant_share"),
    )


def chao1_interval(spectrum: DataFrame, z: float = 1.96) -> DataFrame:
    """The bias-corrected estimate's variance and its log-normal interval, which collapses where nothing is unseen."""
    t = spectrum.agg(F.sum("f").cast("double").alias("s"), F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("f"))), F.lit(0)).cast("double").alias("f1"), F.coalesce(F.sum(F.when(F.col("k") == 2, F.col("f"))), F.lit(0)).cast("double").alias("f2"))
    f1, f2, s = F.col("f1"), F.col("f2"), F.col("s")
    d = f2 + 1
    t = t.withColumn("t", f1 * (f1 - 1) / (2 * d))
    t = t.withColumn("v", F.col("t") + f1 * (2 * f1 - 1) * (2 * f1 - 1) / (4 * d * d) + f1 * f1 * f2 * (f1 - 1) * (f1 - 1) / (4 * d * d * d * d))
    c = F.exp(F.lit(z) * F.sqrt(F.log1p(F.col("v") / (F.col("t") * F.col("t")))))
    open_ = (F.col("t") > 0) & (F.col("v") > 0)
    r = S.round_to
    return t.select(
        r(s + F.col("t"), 2).alias("chao1"), r(F.col("v")).alias("chao1_variance"), r(F.when(open_, s + F.col("t") / c).otherwise(s + F.col("t")), 2).alias("chao1_ci95_lower"),
        r(F.when(open_, s + F.col("t") * c).otherwise(s + F.col("t")), 2).alias("chao1_ci95_upper"),
    )


def rank_blocks(spectrum: DataFrame) -> DataFrame:
    """The rank-abundance curve by blocks of equal abundance: k, f, first and last rank, reads before the block, all reads."""
    w = W.orderBy(F.desc("k"))
    before = w.rowsBetween(W.unboundedPreceding, -1)
    x = spectrum.withColumn("first_rank", F.coalesce(F.sum("f").over(before), F.lit(0)) + 1).withColumn("last_rank", F.sum("f").over(w))
    x = x.withColumn("reads_before", F.coalesce(F.sum(F.col("k") * F.col("f")).over(before), F.lit(0)))
    return x.withColumn("n_reads", F.sum(F.col("k") * F.col("f")).over(W.partitionBy(F.lit(0))))


def rank_abundance(spectrum: DataFrame, max_points: int | None = 5000) -> DataFrame:
    """rank, abundance, relative_abundance and cumulative_read_fraction at up to max_points ranks, log-spaced beyond that; at all
    ranks without a bound. Ranks are made in runs of RUN, which are dealt out, so that no row or task holds a whole block."""
    b = rank_blocks(spectrum)
    total = None if max_points is None else b.agg(F.max("last_rank")).first()[0] or 0
    if total is None or total <= max_points:
        runs = b.select("*", F.explode(F.sequence("first_rank", "last_rank", F.lit(RUN))).alias("_run"))
        runs = runs if total is not None else runs.repartition("k", "_run")
        ranks = runs.select("*", F.explode(F.sequence("_run", F.least(F.col("_run") + RUN - 1, F.col("last_rank")))).alias("rank"))
    else:
        wanted = sorted({int(total ** (i / (max_points - 1))) for i in range(max_points)})
        points = b.sparkSession.createDataFrame([(int(r),) for r in wanted], "rank bigint")
        ranks = b.join(F.broadcast(points), (F.col("rank") >= F.col("first_rank")) & (F.col("rank") <= F.col("last_rank")))
    cum = (F.col("reads_before") + F.col("k") * (F.col("rank") - F.col("first_rank") + 1)) / F.col("n_reads")
    return ranks.select("rank", F.col("k").alias("abundance"), S.round_to(F.col("k") / F.col("n_reads"), 8).alias("relative_abundance"), S.round_to(cum, 8).alias("cumulative_read_fraction"))


def coverage_thresholds(spectrum: DataFrame) -> DataFrame:
    """How many variants hold 50, 90 and 99% of reads, and the share of the top 10, 100 and 1000; solved within blocks."""
    b = rank_blocks(spectrum)
    end = F.col("reads_before") + F.col("k") * F.col("f")

    def until(share: float):
        need = F.ceil((F.lit(share) * F.col("n_reads") - F.col("reads_before")) / F.col("k"))
        return F.min(F.when(end / F.col("n_reads") >= share, F.col("first_rank") - 1 + F.greatest(need, F.lit(1)))).cast("bigint")

    def top(m: int):
        inside = F.least(F.col("last_rank"), F.lit(m)) - F.col("first_rank") + 1
        return S.round_to(F.sum(F.when(F.col("first_rank") <= m, inside * F.col("k"))) / F.max("n_reads"))

    return b.agg(F.sum("f").alias("n_variants"), F.max("n_reads").alias("n_reads"), *[until(s).alias(f"variants_for_{round(100 * s)}pct_reads") for s in (0.5, 0.9, 0.99)], *[top(m).alias(f"top{m}_read_share") for m in (10, 100, 1000)])


@F.pandas_udf(T.DoubleType())
def _log_gamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)


def rarefaction(spectrum: DataFrame, n_points: int = 40) -> DataFrame:
    """depth and expected_richness by Hurlbert's expectation; the spectrum is small, so log-gamma in Arrow batches costs nothing."""
    t = spectrum.agg(F.sum(F.col("k") * F.col("f")).alias("n"), F.sum("f").alias("s")).where("n > 0")
    i = F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i")
    step = (F.col("n") - F.col("n") / n_points) / max(1, n_points - 1)
    at = F.when(F.col("i") == n_points - 1, F.col("n").cast("double")).otherwise(F.col("n") / n_points + F.col("i") * step)
    depths = t.select("n", "s", i).select("n", "s", F.floor(at).cast("bigint").alias("depth")).distinct()
    x = spectrum.crossJoin(F.broadcast(depths))
    n, k, m = F.col("n"), F.col("k"), F.col("depth")
    rest = F.greatest(n - k - m, F.lit(0))
    log = _log_gamma((n - k + 1).cast("double")) - _log_gamma((rest + 1).cast("double")) - _log_gamma((n + 1).cast("double")) + _log_gamma((n - m + 1).cast("double"))
    missed = F.when(n - k - m < 0, 0.0).otherwise(F.exp(log))
    return x.groupBy("depth", "s").agg(F.sum(F.col("f") * missed).alias("u")).select("depth", S.round_to(F.col("s") - F.col("u"), 2).alias("expected_richness"))


def saturation(curve: DataFrame) -> DataFrame:
    """The curve's last slope."""
    w = W.orderBy("depth")
    x = curve.withColumn("slope", (F.col("expected_richness") - F.lag("expected_richness").over(w)) / (F.col("depth") - F.lag("depth").over(w)))
    return x.agg(F.max("depth").alias("depth"), F.max_by("expected_richness", "depth").alias("expected_richness"), S.round_to(F.coalesce(F.max_by("slope", "depth"), F.lit(0.0)), 8).alias("slope"))

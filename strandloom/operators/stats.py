"""Dataset statistics. Each is one aggregation with partial sums, or works on a histogram of distinct lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import sequences as S

MAX_POSITIONS = 512


def dataset_summary(q: DataFrame) -> DataFrame:
    """One row of totals of QC results (needs declared_length)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    n = F.count("*")
    return q.agg(
        n.alias("total_sequence_records"),
        total("raw_length").alias("total_base_pairs"),
        total(F.when(F.col("qc_pass"), F.col("effective_length"))).alias("total_base_pairs_after_qc"),
        total(F.when(F.col("qc_pass"), 1)).alias("reads_passing_qc"),
        (n - total(F.when(F.col("qc_pass"), 1))).alias("reads_removed_by_qc"),
        F.when(n > 0, S.round_to(total(F.when(F.col("qc_pass"), 1)) / n)).otherwise(F.lit(0.0)).alias("qc_pass_rate"),
        total(F.when(F.col("n_ambiguous") > 0, 1)).alias("reads_with_ambiguous_bases"),
        total("n_ambiguous").alias("total_ambiguous_bases"),
        total(F.when(F.col("n_invalid") > 0, 1)).alias("reads_with_invalid_characters"),
        total("n_invalid").alias("total_invalid_characters"),
        total(F.when(F.col("declared_length").isNotNull() & (F.col("declared_length") != F.col("raw_length")), 1)).alias("headers_with_declared_length_mismatch"),
    )


def nucleotide_counts(reads: DataFrame) -> DataFrame:
    """base, n and fraction of every character of the upper-cased reads."""
    chars = reads.select(F.explode(F.split(F.upper("sequence"), "")).alias("base")).where("base != ''")
    by = chars.groupBy("base").agg(F.count("*").alias("n"))
    return by.withColumn("fraction", S.round_to(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 8))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count("*").alias("n"))


def histogram_stats(hist: DataFrame) -> DataFrame:
    """Exact mean, population deviation and discrete percentiles of a histogram (value, n), which has few rows."""
    run = hist.withColumn("cum", F.sum("n").over(W.orderBy("value"))).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))
    mean = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("value") * F.col("value") * F.col("n")) / F.sum("n")
    at = lambda p: F.min(F.when(F.col("cum") >= F.lit(p) * F.col("total"), F.col("value")))
    return run.agg(
        F.min("value").alias("min"), F.max("value").alias("max"), S.round_to(mean, 4).alias("mean"), at(0.5).alias("median"),
        S.round_to(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), 4).alias("std"), at(0.01).alias("p01"), at(0.25).alias("p25"), at(0.75).alias("p75"), at(0.99).alias("p99"),
        F.count("*").alias("distinct_values"), F.sum("n").alias("n"),
    )


def array_stats(df: DataFrame, column: str) -> DataFrame:
    """Exact descriptive statistics with interpolated percentiles."""
    p = F.percentile(column, F.array(*[F.lit(x) for x in (0.5, 0.05, 0.25, 0.75, 0.95)]))
    x = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), p.alias("p"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    r = lambda c: S.round_to(F.col(c) if isinstance(c, str) else c)
    return x.select("n", r("mean").alias("mean"), *[r(F.col("p")[i]).alias(a) for i, a in enumerate(("median", "p05", "p25", "p75", "p95"))], r("std").alias("std"), r("min").alias("min"), r("max").alias("max"))


def position_profile(q: DataFrame) -> DataFrame:
    """position, coverage and ambiguous, from the length histogram and the positions of ambiguity codes."""
    lengths = q.groupBy("raw_length").agg(F.count("*").alias("n")).where("raw_length > 0")
    covered = lengths.select(F.explode(F.sequence(F.lit(0), F.least(F.col("raw_length"), F.lit(MAX_POSITIONS)) - 1)).alias("position"), "n").groupBy("position").agg(F.sum("n").alias("coverage"))
    odd = q.select(F.explode("ambiguous_positions").alias("position")).where(F.col("position") < MAX_POSITIONS).groupBy("position").agg(F.count("*").alias("ambiguous"))
    return covered.join(odd, "position", "left").select(F.col("position").cast("bigint").alias("position"), "coverage", F.coalesce("ambiguous", F.lit(0)).cast("bigint").alias("ambiguous"))


def _per_id(meta: DataFrame) -> DataFrame:
    """n, whether adjacent, and the first two occurrences of every id: one aggregation that keeps two structs per group."""
    first = F.min(F.struct("record_index", "gc_content", "tile"))
    by = meta.groupBy("seq_id").agg(F.count("*").alias("n"), (F.max("record_index") - F.min("record_index") + 1 == F.count("*")).alias("adjacent"), first.alias("a"))
    second = meta.join(by.where("n > 1").select("seq_id", F.col("a.record_index").alias("first_index")), "seq_id").where(F.col("record_index") > F.col("first_index"))
    second = second.groupBy("seq_id").agg(F.min(F.struct("record_index", "gc_content", "tile")).alias("b"))
    return by.join(second, "seq_id", "left")


def read_id_analysis(meta: DataFrame) -> DataFrame:
    """Why ids repeat: how often, whether side by side, with one GC content, on one tile."""
    x = _per_id(meta)
    many = F.col("n") > 1
    share = lambda c: S.round_to(F.avg(F.when(many, c)))
    both = F.col("a.tile").isNotNull() | F.col("b.tile").isNotNull()
    return x.agg(
        F.sum("n").alias("total_records"), F.count("*").alias("unique_sequence_ids"), F.count(F.when(~many, 1)).alias("ids_occurring_once"), F.count(F.when(many, 1)).alias("ids_occurring_more_than_once"),
        F.max("n").alias("max_multiplicity"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("records_in_duplicated_ids"),
        share(F.col("adjacent").cast("double")).alias("fraction_of_repeats_adjacent_in_file"),
        share((F.col("a.gc_content") == F.col("b.gc_content")).cast("double")).alias("fraction_of_repeats_with_identical_gc"),
        share(F.when(both, F.coalesce((F.col("a.tile") == F.col("b.tile")).cast("double"), F.lit(0.0)))).alias("fraction_of_repeats_on_same_tile"),
    )


def id_multiplicity(meta: DataFrame, key: str = "seq_id") -> DataFrame:
    by = meta.groupBy(key).agg(F.count("*").alias("occurrences"))
    return by.groupBy("occurrences").agg(F.count("*").alias("n_ids"))

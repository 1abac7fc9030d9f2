"""Systematic and mate-pair samples, stratified splits, and draws by hash."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import sequences as S


#: hash_draw gives 60 bits; the upper 20 of them name a range of draws.
SPLIT_SHIFT = 40


def running_index(df: DataFrame, key: str, rows_per_block: int = 1 << 20, by: tuple[str, ...] = ()) -> DataFrame:
    """df with idx, the 0-based place of each row in the order of an integer key, within the columns `by` (not null) if there are
    any, without a task that holds all rows.

    Keys fall into ranges of rows_per_block; counts of the ranges, few rows, give where each one starts."""
    block = F.floor(F.col(key) / rows_per_block).cast("bigint")
    starts = df.groupBy(*by, block.alias("_block")).agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    x = df.withColumn("_block", block).join(starts, [*by, "_block"])
    return x.withColumn("idx", F.col("_start") + F.row_number().over(W.partitionBy(*by, "_block").orderBy(key)) - 1).drop("_block", "_start")


def value_range(key: Column, ranges: int = 1 << 16) -> Column:
    """The number of a range of numbers, rising with them; ranges are finest about 0, a hundredth of the number itself far from it,
    and need no look at the data."""
    return (F.floor(F.atan(key) * (ranges / math.pi)) + F.floor(F.signum(key) * F.asinh(F.least(F.lit(1e150), F.abs(key))) * 100)).cast("int")


def running_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with before, the sum of an integer value over all rows of lower key; keys are distinct numbers.

    The sums of the ranges, few rows, say where each one starts."""
    x = df.withColumn("_range", value_range(F.col(key)))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = x.groupBy("_range").agg(F.sum(value).alias("_v")).withColumn("_start", earlier("_v", W.orderBy("_range"))).drop("_v")
    x = x.join(F.broadcast(starts), "_range")
    return x.withColumn("before", F.col("_start") + earlier(value, W.partitionBy("_range").orderBy(key))).drop("_range", "_start")


def systematic_sample(passed: DataFrame, size: int) -> DataFrame:
    """Every stride-th passed read in file order, the first `size` of these; row_pos is its place."""
    index = passed.select("record_index").persist(StorageLevel.MEMORY_AND_DISK)  # lost blocks are computed again
    n = index.count()
    stride = max(1, n // size) if size else 1
    taken = running_index(index, "record_index").where((F.col("idx") % stride == 0) & (F.col("idx") < stride * size))
    return passed.join(taken.select("record_index", (F.col("idx") / stride).cast("bigint").alias("row_pos")), "record_index")


def mate_pairs(passed: DataFrame) -> DataFrame:
    """Complete pairs: neighbours in the file with one id, both passed, taken greedily; pair_key is the left record, mate 1 or 2."""
    by = W.partitionBy("seq_id").orderBy("record_index")
    x = passed.withColumn("_island", F.col("record_index") - F.row_number().over(by))
    inside = W.partitionBy("seq_id", "_island").orderBy("record_index")
    x = x.withColumn("_rn", F.row_number().over(inside) - 1).withColumn("_n", F.count("*").over(W.partitionBy("seq_id", "_island")))
    x = x.where(F.col("_rn") < F.col("_n") - F.col("_n") % 2)
    return x.withColumn("mate", (F.col("_rn") % 2 + 1).cast("int")).withColumn("pair_key", F.col("record_index") - F.col("_rn") % 2).drop("_island", "_rn", "_n")


def sample_pairs(passed: DataFrame, unique_ids: int, n_pairs: int) -> DataFrame:
    """Every stride-th complete pair in file order, the first n_pairs of these; the stride comes from all ids of the file."""
    stride = max(1, unique_ids // n_pairs) if n_pairs else 1
    pairs = mate_pairs(passed)
    lefts = running_index(pairs.where("mate = 1").select("pair_key"), "pair_key").where((F.col("idx") % stride == 0) & (F.col("idx") < stride * n_pairs))
    lefts = lefts.select("pair_key", (F.col("idx") / stride).cast("bigint").alias("pair_id"))
    return pairs.join(lefts, "pair_key").drop("pair_key").withColumn("row_pos", F.col("pair_id") * 2 + F.col("mate") - 1)


def reverse_second_mates(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("sequence", F.when(F.col("mate") == 2, S.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))


def stratified_split(df: DataFrame, label: str, key: Column, fractions: tuple[float, float] = (0.7, 0.15), seed: int = 42) -> DataFrame:
    """df with split (train, val, test); within each label rows stand in the order of a draw by key.

    Draws fall into ranges, whose counts say where each one starts, so that no task ranks a whole label."""
    draw = S.hash_draw(F.concat(F.lit(f"split:{seed}:"), key.cast("string")))
    x = df.withColumn("_draw", draw).withColumn("_range", F.pmod(F.shiftright("_draw", SPLIT_SHIFT), F.lit(1 << 20)))
    ranges = x.groupBy(F.col(label).alias("_label"), F.col("_range").alias("_r")).agg(F.count("*").alias("_k"))
    by = W.partitionBy("_label")
    ranges = ranges.withColumn("_n", F.sum("_k").over(by)).withColumn("_before", F.coalesce(F.sum("_k").over(by.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    x = x.join(ranges, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    rank = F.col("_before") + F.row_number().over(W.partitionBy(label, "_range").orderBy("_draw", key))
    train, val = (F.bround(F.lit(f) * F.col("_n")).cast("bigint") for f in fractions)
    split = F.when(rank <= train, "train").when(rank <= train + val, "val").otherwise("test")
    return x.withColumn("split", split).drop("_draw", "_range", "_label", "_r", "_n", "_before")


def min_class_size(df: DataFrame, label: str, least: int) -> DataFrame:
    big = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label)
    return df.join(big, label, "left_semi")


def kfold(df: DataFrame, key: Column, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold: rows in the order of a draw by key, dealt out in turn, so that folds differ by one row at most.

    Draws fall into ranges, whose counts say where each one starts, so that no task ranks all rows. Rows of one key have one draw,
    and the order of these is not defined."""
    x = df.withColumn("_draw", S.hash_draw(F.concat(F.lit(f"fold:{seed}:"), F.coalesce(key.cast("string"), F.lit("")))))
    x = x.withColumn("_range", F.shiftright("_draw", SPLIT_SHIFT))
    starts = x.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_k"))  # 2**20 rows at most
    starts = starts.select("_r", F.coalesce(F.sum("_k").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    x = x.join(starts, F.col("_range") == F.col("_r"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy("_draw")) - 1
    return x.withColumn("fold", (place % k).cast("int")).drop("_draw", "_range", "_r", "_before")

"""Amplicon structure: end groups, conservation, consensus, the change point, and the variable region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import sequences as S


def anchors(reads: DataFrame, prefix_len: int = 18, n_groups: int = 2) -> DataFrame:
    """end, anchor and n: the most frequent prefixes, ties to the first seen. At most n_groups rows."""
    p = reads.where(F.length("sequence") >= prefix_len).groupBy(F.substring("sequence", 1, prefix_len).alias("anchor")).agg(F.count("*").alias("n"), F.min("record_index").alias("first"))
    top = p.orderBy(F.desc("n"), "first").limit(n_groups)
    return top.select((F.row_number().over(W.orderBy(F.desc("n"), "first")) - 1).cast("int").alias("end"), "anchor", "n")


def end_groups(reads: DataFrame, prefix_len: int = 18, n_groups: int = 2, max_mismatch: int = 4) -> DataFrame:
    """reads with end: the nearest anchor within max_mismatch, the lower on a tie; -1 if none is, or the read is too short.

    The anchors are n_groups rows, read once and put into the plan as constants, so reads are neither joined nor expanded."""
    found = [(r["end"], r["anchor"]) for r in anchors(reads, prefix_len, n_groups).collect()]
    prefix = F.substring("sequence", 1, prefix_len)
    options = [F.struct(S.hamming(prefix, F.lit(a)).alias("d"), F.lit(e).alias("e")) for e, a in found]
    if not options:
        return reads.withColumn("end", F.lit(-1))
    best = F.array_min(F.array(*options))
    return reads.withColumn("end", F.when((F.length("sequence") >= prefix_len) & (best["d"] <= max_mismatch), best["e"]).otherwise(F.lit(-1)))


def modal_length(variants: DataFrame) -> int | None:
    """The most common length of the variants, ties to the first seen."""
    row = variants.groupBy("length").agg(F.count("*").alias("n"), F.min("variant_id").alias("first")).orderBy(F.desc("n"), "first").first()
    return row["length"] if row else None


def usable(variants: DataFrame, length: int, max_variants: int = 5000) -> DataFrame:
    """Each end's max_variants most abundant variants of one length."""
    x = variants.where((F.col("end") >= 0) & (F.col("length") == length))
    w = W.partitionBy("end").orderBy(F.desc("count"), "variant_id")
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_variants).drop("_r")


def profile(used: DataFrame, length: int) -> DataFrame:
    """end, pos (0-based), base, conservation: the heaviest base of each position and its share; A and 0 without cover."""
    x = used.select("end", F.posexplode(F.split("sequence", "")).alias("pos", "base"), "count").where(F.col("base").isin(*S.BASES))
    by = x.groupBy("end", "pos").agg(*[F.sum(F.when(F.col("base") == b, F.col("count")).otherwise(0)).alias(b) for b in S.BASES])
    every = used.select("end").distinct().select("end", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))
    by = every.join(by, ["end", "pos"], "left").fillna(0, list(S.BASES))
    top, total = F.greatest(*S.BASES), sum((F.col(b) for b in S.BASES[1:]), F.col("A"))
    base = F.when(top == F.col("A"), "A").when(top == F.col("C"), "C").when(top == F.col("G"), "G").otherwise("T")
    return by.select("end", F.col("pos").cast("bigint").alias("pos"), base.alias("base"), F.when(total > 0, top / total).otherwise(0.0).alias("conservation"))


def consensus(prof: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"])
    return prof.groupBy("end").agg(F.array_join(ordered, "").alias("consensus"))


def changepoint(prof: DataFrame, min_block: int = 15) -> DataFrame:
    """end, position, before, after, delta: the cut of the greatest fall in mean conservation, the earliest on a tie."""
    w = W.partitionBy("end").orderBy("pos")
    x = prof.withColumn("before", F.avg("conservation").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.avg("conservation").over(w.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("_n", F.count("*").over(W.partitionBy("end"))).where((F.col("pos") >= min_block) & (F.col("pos") < F.col("_n") - min_block))
    delta = S.round_to(F.col("before") - F.col("after"), 9)
    best = x.groupBy("end").agg(F.max_by(F.struct("pos", "before", "after"), F.struct(delta, -F.col("pos"))).alias("b"))
    r = lambda c: S.round_to(F.col(c), 5)
    return best.select("end", F.col("b.pos").alias("position"), r("b.before").alias("before"), r("b.after").alias("after"), S.round_to(F.col("b.before") - F.col("b.after"), 5).alias("delta"))


def summary(used: DataFrame, prof: DataFrame, length: int) -> DataFrame:
    """Per end: variants, reads, mean conservation, invariant and variable positions, informative share."""
    a = used.groupBy("end").agg(F.count("*").alias("variants_used"), F.sum("count").alias("reads_represented"))
    b = prof.groupBy("end").agg(S.round_to(F.avg("conservation"), 5).alias("mean_conservation"), F.count(F.when(F.col("conservation") > 0.99, 1)).alias("positions_invariant"), F.count(F.when(F.col("conservation") < 0.70, 1)).alias("positions_variable"))
    return a.join(b, "end").withColumn("informative_fraction", S.round_to(F.col("positions_variable") / length, 5))


def weighted_summary(per_end: DataFrame) -> DataFrame:
    mean = lambda c: S.round_to(F.sum(F.col(c) * F.col("reads_represented")) / F.sum("reads_represented"), 5)
    return per_end.agg(mean("mean_conservation").alias("weighted_mean_conservation"), mean("informative_fraction").alias("weighted_informative_fraction"))


def variable_region(pairs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Reads (with end and mate) trimmed to what follows their end's conserved block, where that leaves something; second mates
    are reversed after the trim. cuts has a row per end."""
    x = pairs.join(F.broadcast(cuts.select("end", F.col("position").cast("int").alias("_cut"))), "end", "left")
    n = F.length("sequence")
    seq = F.when(F.col("_cut") < n, F.substring("sequence", F.col("_cut") + 1, n)).otherwise(F.col("sequence"))
    x = x.withColumn("retained_fraction", F.when(n > 0, F.length(seq) / n).otherwise(F.lit(0.0))).withColumn("sequence", seq).drop("_cut")
    return x.withColumn("sequence", F.when(F.col("mate") == 2, S.reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))

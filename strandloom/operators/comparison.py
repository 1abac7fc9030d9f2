"""Two encoders on the same pairs of reads, metric by metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import vectors

#: Metrics of a retrieval and whether more is better; a width is compared, but has no winner.
METRICS = {
    "top1_accuracy": True, "top5_accuracy": True, "top10_accuracy": True, "mean_reciprocal_rank": True, "median_rank": False, "lift_over_chance": True, "mean_cosine_true_mates": None,
    "mean_cosine_random_pairs": None, "cohens_d": True, "auroc": True, "dimension": None, "bytes_per_vector": None,
}


def figures(pairs: DataFrame, n_distractors: int = 99, controlled: bool = True) -> DataFrame:
    """One row of METRICS. pairs: pair_id, left_vec, right_vec and, if controlled, right_end."""
    r = vectors.retrieval(pairs, n_distractors, controlled=controlled)
    scores = r.select(F.col("mate_similarity").alias("score"), F.lit(1).alias("positive")).union(r.select(F.explode("distractors"), F.lit(0)))
    width = pairs.agg(F.max(F.size("left_vec")).cast("double").alias("dimension")).withColumn("bytes_per_vector", F.col("dimension") * 4)
    return vectors.retrieval_summary(r, n_distractors).crossJoin(vectors.auroc(scores).select("auroc")).crossJoin(width)  # one row each


def _long(row: DataFrame, name: str) -> DataFrame:
    every = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    return row.select(F.explode(every).alias("x")).select("x.metric", F.col("x.value").alias(name))


def head_to_head(baseline: DataFrame, other: DataFrame, n_distractors: int = 99, tolerance: float = 1e-6) -> DataFrame:
    """protocol, metric, baseline, foundation, difference, winner; with distractors of the true mate's end, and of any."""
    out = None
    for protocol, controlled in (("same_end", True), ("any_end", False)):
        a, b = (_long(figures(p, n_distractors, controlled), n) for p, n in ((baseline, "baseline"), (other, "foundation")))
        x = a.join(b, "metric").withColumn("protocol", F.lit(protocol))
        out = x if out is None else out.unionByName(x)
    gap = F.col("foundation") - F.col("baseline")
    up = F.create_map(*[v for m, more in METRICS.items() for v in (F.lit(m), F.lit(more).cast("boolean"))])[F.col("metric")]
    winner = F.when(up.isNull(), None).when(F.abs(gap) <= tolerance, "tie").when((gap > 0) == up, "foundation").otherwise("baseline")
    return out.select("protocol", "metric", "baseline", "foundation", S.round_to(gap).alias("difference"), winner.alias("winner"))

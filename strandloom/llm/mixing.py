"""Mixing sources to target weights, with DataFrame functions only.

The size of a document is its number of words `[^\\x20\\x09-\\x0D]+`. Sources in code point order, null last, weigh 5, 2, 1,
repeating, and share 150% of all sizes; a target stops at twice its source's size and the excess goes to the others by
weight until none is above. A source's repetition rate is target / size. Each document is emitted floor(rate) times, and
once more where a draw seeded by its doc_id and text falls under the fraction.

Defined cases: a null or empty text has size 0 and is emitted like any other document of its source; a null source is a
source of its own; rows alike in both doc_id and text share a draw, all others have their own, also those of a null doc_id; a
source of size 0 has target 0; an empty table gives an empty result; other columns pass through, whatever their names, since
the plan holds a document as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
SEED = "mix-2"
#: The per-source plan is broadcast up to so many sources; beyond that the join is salted.
BROADCAST_SOURCES = 100_000
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of a table with source and size. One row per source passes a single task."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    x = by.withColumn("weight", weight).withColumn("cap", F.lit(CAP) * F.col("source_size"))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    x = x.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.lit(SHARE) * F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    x = x.withColumn("capped", F.col("ratio") < level)  # true for the first sources and no later one
    x = x.withColumn("cap_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0)))
    x = x.withColumn("weight_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0.0)))
    share = F.col("weight") * ((F.lit(SHARE) * F.col("all_size") - F.col("cap_sum")) / (F.col("all_weight") - F.col("weight_sum")))
    target = F.when(F.col("capped") | (F.col("source_size") == 0), F.col("cap")).otherwise(F.least(F.col("cap"), share))
    return x.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame) -> DataFrame:
    """doc (a struct of the columns of docs), size, source_size, target, copies and taken (size * copies)."""
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"))
    plan = materialize(source_targets(sized.select("source", "size")), "mix").withColumnRenamed("source", "of")
    if plan.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of")))
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("own", F.pmod(F.xxhash64("doc.doc_id", "doc.text"), F.lit(SALTS)).cast("int"))
        joined = joined.join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(CAP), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(unit_draw(F.col("doc.doc_id"), F.col("doc.text"), SEED) < rate - whole, 1).otherwise(0)).cast("long")
    return joined.select("doc", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with the columns of docs."""
    taken = plan_mix(docs).where("copies > 0")
    return taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = plan_mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return x.select("doc.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS sum5, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
        CAST(2.0 AS DOUBLE) * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS all_size, sum(weight) OVER () AS all_weight FROM w),
b AS (SELECT *, coalesce(sum(cap) OVER o, CAST(0 AS DOUBLE)) AS cap_before, coalesce(sum(weight) OVER o, CAST(0 AS DOUBLE)) AS weight_before FROM r
        WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, ratio < (CAST(1.5 AS DOUBLE) * all_size - cap_before) / (all_weight - weight_before) AS capped FROM b),
e AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), CAST(0 AS DOUBLE)) AS cap_sum,
        coalesce(sum(CASE WHEN capped THEN weight END) OVER (), CAST(0 AS DOUBLE)) AS weight_sum FROM c),
t AS (SELECT source, source_size, CASE WHEN capped OR source_size = 0 THEN cap
        ELSE least(cap, weight * ((CAST(1.5 AS DOUBLE) * all_size - cap_sum) / (all_weight - weight_sum))) END AS target FROM e),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least(CAST(2.0 AS DOUBLE), t.target / t.source_size) ELSE CAST(0 AS DOUBLE) END AS rate,
        CAST(CAST(concat('0x', substring(md5(concat('mix-2:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', sum5)), 1, 13)) AS BIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE) AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""

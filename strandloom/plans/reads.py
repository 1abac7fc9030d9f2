"""Input views that the queries share: synthetic reads, pairs of vectors, references and scored labels, derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequences as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Reads that a task derives at most, where files give fewer tasks than that takes.
READS = 100_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df in as many partitions as there are cores, and with rows in as many as have no more each, where its files give fewer;
    larger tables stay as they are."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    parts = parts if rows is None else max(parts, -(-df.count() // rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_index, seq_id, mate (0 or 1), header, sequence: two mates of a fragment that is drawn from event_id by MD5.

    A few records are empty, short, of one base, or hold ambiguous, invalid or lower-case characters."""
    e = F.col("event_id")
    p = F.floor(e / 2).cast("bigint")
    x = spread(table(spark, sf_dir, "events").select("event_id"), READS).withColumn("p", p).withColumn("mate", (e % 2).cast("int"))
    pp = F.col("p")
    key = F.when(pp % 10 < 5, pp % 7).when(pp % 10 < 9, 1000 + pp % 150).when(pp % 40 < 20, 100000 + pp).otherwise(200000 + F.floor(pp / 20).cast("bigint"))
    x = S.computed(x, {"vkey": key})
    digest = F.concat(*[F.md5(F.concat(F.lit(c), F.col("vkey").cast("string"))) for c in "abcde"])
    frag = F.translate(digest, "0123456789abcdef", "ACGT" * 4)
    x = S.computed(x, {"frag": frag})
    frag = F.col("frag")
    clean = F.when(F.col("mate") == 0, F.concat(F.lit("AAGGGCACCACAAGAACG"), F.substring(frag, 1, 133))).otherwise(F.concat(F.lit("CGGTCACGTTCGTTGCCT"), S.reverse_complement(F.substring(frag, 28, 133))))
    x = S.computed(x, {"clean": clean})
    c = F.col("clean")
    sub = lambda a, n: F.substring(c, a, n)
    seq = (
        F.when(e % 997 == 5, F.lit("")).when(e % 499 == 7, sub(1, 80)).when(e % 601 == 11, F.concat(sub(1, 60), F.lit("X"), sub(62, 90))).when(e % 389 == 13, F.lit("A" * 151))
        .when(e % 211 == 17, F.concat(F.lit("N" * 20), sub(21, 131))).when(e % 307 == 19, F.concat(sub(1, 75), F.lit("N"), sub(77, 75))).when(e % 97 == 23, F.concat(sub(1, 1), F.lit("N"), sub(3, 149)))
        .when(e % 53 == 29, F.lower(c)).otherwise(c)
    )
    x = S.computed(x, {"sequence": seq}).withColumn("seq_id", F.concat(F.lit("SYN."), pp.cast("string")))
    s = lambda v: v.cast("string")
    name = F.concat(F.col("seq_id"), F.lit(" LH:11:FC:5:"), s(1101 + pp % 4), F.lit(":"), s(pp), F.lit(":"), s(pp % 97), F.lit(" length="), s(F.length("sequence")))
    header = F.when(e % 50 == 49, F.concat(F.col("seq_id"), F.lit(" contig len=500"))).otherwise(name)
    return x.select(e.alias("record_index"), "seq_id", "mate", header.alias("header"), "sequence")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, left_vec, right_vec, right_end: vectors 2i and 2i + 1, with the right one's label by 2 as its end."""
    v = table(spark, sf_dir, "embeddings").withColumn("pair_id", F.floor(F.col("vec_id") / 2).cast("bigint"))
    left = v.where("vec_id % 2 = 0").select("pair_id", F.col("embedding").alias("left_vec"))
    right = v.where("vec_id % 2 = 1").select("pair_id", F.col("embedding").alias("right_vec"), (F.col("label") % 2).alias("right_end"))
    return left.join(right, "pair_id")


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, predicted, confidence, correct, p: a pseudo-classifier of toxic whose probability is drawn by hash."""
    x = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("truth"))
    p = F.pmod(S.hash_draw(F.concat(F.lit("score:"), F.col("doc_id").cast("string"))), F.lit(10001)) / F.lit(10000.0)
    x = x.withColumn("u", p)
    x = x.withColumn("p", F.when(F.col("truth") == 1, 1 - F.col("u") * F.col("u")).otherwise(F.col("u") * F.col("u")))
    x = x.withColumn("predicted", F.when(F.col("p") >= 0.5, 1).otherwise(0).cast("bigint")).withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p")))
    return x.withColumn("correct", F.col("truth") == F.col("predicted"))


def references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(accession, sequence) with the primer's core at a varying place or not at all, and (accession, taxonomy)."""
    k = F.col("p_partkey")
    digest = F.concat(*[F.md5(F.concat(F.lit(c), k.cast("string"))) for c in "pqrstu"])
    body = F.translate(digest, "0123456789abcdef", "ACGU" * 4)
    core = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(S.CORE_PRIMER))
    at = (k % 60).cast("int")
    seq = F.concat(F.substring(body, F.lit(1), at), core, F.substring(body, at + 1, F.lit(192)))
    name = F.concat(F.lit("P"), k.cast("string"))
    part = table(spark, sf_dir, "part")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    tax = part.select(name.alias("accession"), (k % 25).cast("int").alias("n_nationkey"), "p_brand", "p_type", "p_partkey").join(F.broadcast(where), "n_nationkey")
    path = F.when(F.col("p_partkey") % 17 == 0, F.lit("")).otherwise(F.concat_ws(";", "r_name", "n_name", "p_brand", "p_type"))
    return part.select(name.alias("accession"), seq.alias("sequence")), tax.select("accession", path.alias("taxonomy"))


def words(text) -> "F.Column":
    """Lower-cased words of letters, for word-presence models of texts."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")

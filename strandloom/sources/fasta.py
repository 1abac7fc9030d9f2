"""FASTA scans. Records are split by the text reader at "\\n>", so files are cut at record bounds and read in parallel."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import sequences as S


def _parts(value: Column) -> tuple[Column, Column]:
    """Header and joined sequence of a record without its leading >."""
    lines = F.split(F.regexp_replace(value, "\r", ""), "\n")
    body = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.trim)
    return F.trim(lines[0]), F.array_join(body, "")


def scan(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """record_index, seq_id, header, sequence in file order. Wrapped lines are joined, blank ones and what stands before the
    first header are left out, a header alone is a record with an empty sequence. .gz files are read by one task each.

    Records are numbered where they are read: a pass over the headers' places counts those of each file split, few rows, and a
    record's place within its split comes from the order in which the split is read. Sequences are not shuffled."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    x = raw.mapInArrow(_numbered, raw.schema.simpleString()[7:-1] + ",_n:bigint,_lead:boolean")
    # only a file's first record keeps its >; text without one stands before the first header, and is not counted
    counts = x.where("_n >= 0").groupBy("_file", "_start").agg(F.count("*").alias("_c"))
    order = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0))).drop("_c")
    x = x.where("_n >= 0").join(F.broadcast(counts), ["_file", "_start"])  # a row a file split
    body = F.when(F.col("_lead"), F.regexp_replace("value", r"^\s*>", "")).otherwise(F.col("value"))
    header, sequence = _parts(body)
    out = x.select((F.col("_before") + F.col("_n")).alias("record_index"), S.seq_id(header).alias("seq_id"), header.alias("header"), sequence.alias("sequence"))
    return out if max_records is None else out.where(F.col("record_index") < max_records)


def _numbered(batches):
    """_n, the place of each record within its file split (-1 for text before a file's first header), and whether it is a file's first."""
    now, n = None, 0
    for batch in batches:
        places, leads = [], []
        for value, file, start in zip(*(batch.column(c) for c in ("value", "_file", "_start"))):
            at = (file.as_py(), start.as_py())
            lead = at != now and at[1] == 0
            if at != now:
                now, n = at, 0
            skip = lead and not pc.starts_with(pc.utf8_ltrim_whitespace(value), ">").as_py()
            places.append(-1 if skip else n)
            leads.append(lead)
            n += not skip
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(leads)], [*batch.schema.names, "_n", "_lead"])


def peek_headers(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The first n headers, from the first n records alone."""
    return scan(spark, path, n).select("record_index", "header").orderBy("record_index")


def batches(df: DataFrame, size: int) -> DataFrame:
    """df with batch, the running number of its batch of `size` records; the last one may be short."""
    return df.withColumn("batch", F.floor(F.col("record_index") / size).cast("bigint"))


def write(df: DataFrame, path: str, width: int = 70) -> None:
    """header and sequence as FASTA text, wrapped at width."""
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), "header", F.lit("\n"), wrapped).alias("value")).write.text(path)

"""Incremental forms: FASTA files that arrive in a folder become metadata, and counts of variants that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.functions import sequences as S
from strandloom.operators import qc

LINE = "value string"


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, header, sequence of the records in files as they arrive."""
    raw = spark.readStream.schema(LINE).option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), "\r", ""), "\n")
    header = F.trim(lines[0])
    seq = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.trim), "")
    return raw.select(S.seq_id(header).alias("seq_id"), header.alias("header"), seq.alias("sequence")).where("header <> ''")


def metadata_sink(reads: DataFrame, path: str, checkpoint: str, cfg: qc.QCConfig = qc.QCConfig()) -> StreamingQuery:
    """Appends QC results; a batch that runs again replaces its own folder, so each read is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    x = qc.evaluate(reads, cfg)
    return x.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def variant_counts(reads: DataFrame, cfg: qc.QCConfig = qc.QCConfig()) -> DataFrame:
    """Counts of variants over all that has arrived, for the update or complete mode; state grows with distinct sequences."""
    return qc.passed(reads, cfg).groupBy("sequence").agg(F.count("*").alias("count"))

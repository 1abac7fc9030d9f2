"""Other scans and the sinks: taxonomies, label files, metadata, variants, JSON and CSV results."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """accession, taxonomy of a two-column TSV, plain or gzip; trailing ; are dropped, the last of repeated accessions counts."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "\t", 2)
    x = raw.select(F.trim(parts[0]).alias("accession"), F.regexp_replace(F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))), ";+$", "").alias("taxonomy"), "_metadata")
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return x.select("accession", "taxonomy", order.alias("_o")).groupBy("accession").agg(F.max_by("taxonomy", "_o").alias("taxonomy"))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """read_id, taxon of a JSON object or a file of two columns, separated by commas in a .csv and by tabs in any other, so that a
    taxon may hold commas. Blank lines, comments and a header line are skipped; the last of repeated ids counts."""
    if path.lower().endswith(".json"):
        text = spark.read.option("wholetext", True).text(path)
        pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("read_id", "taxon"))
        return pairs
    raw = spark.read.text(path).select(F.trim("value").alias("value"), "_metadata", F.monotonically_increasing_id().alias("_at"))
    parts = F.split("value", "," if path.lower().endswith(".csv") else "\t")
    x = raw.where((F.col("value") != "") & ~F.col("value").startswith("#") & (F.size(parts) >= 2))
    x = x.select(F.trim(parts[0]).alias("read_id"), F.trim(parts[1]).alias("taxon"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), "_at").alias("_o"))
    first = x.groupBy().agg(F.min("_o").alias("_first"))
    x = x.crossJoin(F.broadcast(first)).where(~((F.col("_o") == F.col("_first")) & F.lower("taxon").isin("label", "taxon", "taxonomy")))
    return x.groupBy("read_id").agg(F.max_by("taxon", "_o").alias("taxon"))


def write_parquet(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Writes df once: an existing result is read again unless force is set."""
    spark = df.sparkSession
    if force or not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def siblings(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Names of the files with these suffixes in the folder of path and in the one above it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: set[str] = set()
    for _ in range(2):
        at = files.makeQualified(at).getParent()
        if at is None:
            break
        found |= {s.getPath().getName() for s in files.listStatus(at) if s.isFile()}
    return sorted(name for name in found if name.lower().endswith(suffixes))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_json(value: Any, path: str) -> None:
    """A metrics document; sets become lists, and NumPy values and paths plain ones."""

    def plain(x):
        if hasattr(x, "tolist"):
            return x.tolist()
        if isinstance(x, (set, frozenset)):
            return sorted(x)
        if hasattr(x, "asDict"):
            return x.asDict(recursive=True)
        return str(x)

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, default=plain))


def read_json(path: str) -> Any | None:
    return json.loads(Path(path).read_text()) if Path(path).exists() else None

"""The embedding store: vectors in Parquet by id, resumed by what is missing, with what failed beside them and a manifest."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.encoding import OUTCOME, run_encoder
from strandloom.operators.kmer import Encoder

from .tables import exists


@dataclass(frozen=True)
class EmbeddingStore:
    """Rows of OUTCOME, in a folder each for vectors and failed batches. A write is one commit, so a run that fails leaves nothing."""

    spark: SparkSession
    path: str
    dim: int

    def _rows(self, outcome: str) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/_SUCCESS"):
            return None
        return self.spark.read.schema(OUTCOME).parquet(self.path).where(F.col("outcome") == outcome)

    def committed(self) -> DataFrame | None:
        """sequence_id and embedding of what was written, or None."""
        x = self._rows("vector")
        return None if x is None else x.select("sequence_id", "embedding")

    def failures(self) -> DataFrame | None:
        """first_id, batch_rows and error of the batches that failed, or None before the first write."""
        x = self._rows("failed")
        return None if x is None else x.select(F.col("sequence_id").alias("first_id"), "batch_rows", "error")

    def n_committed(self) -> int:
        done = self.committed()
        return 0 if done is None else done.count()

    def append(self, rows: DataFrame) -> None:
        """Adds rows (sequence_id, embedding). Vectors of another width or with repeated ids are an error, before anything is written."""
        bad = rows.agg(F.count(F.when(F.size("embedding") != self.dim, 1)), F.count("*"), F.countDistinct("sequence_id")).first()
        if bad[0]:
            raise ValueError(f"{bad[0]} vectors do not have {self.dim} dimensions")
        if bad[1] != bad[2]:
            raise ValueError("a vector needs one id, and an id one vector")
        none = {"row_pos": "long", "tokens": "long", "batch_rows": "long", "error": "string"}
        x = rows.select(F.lit("vector").alias("outcome"), "sequence_id", F.col("embedding").cast("array<float>").alias("embedding"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
        self.write(x)

    def write(self, outcomes: DataFrame, mode: str = "append") -> None:
        outcomes.write.mode(mode).partitionBy("outcome").option("compression", "zstd").parquet(self.path)

    def missing(self, subset: DataFrame) -> DataFrame:
        """The rows of subset (seq_id, sequence) whose vectors are not there yet."""
        done = self.committed()
        return subset if done is None else subset.join(done.select(F.col("sequence_id").alias("seq_id")), "seq_id", "left_anti")

    def manifest(self) -> dict | None:
        path = f"{self.path}_manifest"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0]) if exists(self.spark, f"{path}/_SUCCESS") else None

    def describe(self, about: dict) -> None:
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}_manifest")


def load(spark: SparkSession, path: str, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """sequence_id and embedding; of those with ids only, or the first `limit` by the place that the subset gave them."""
    x = spark.read.schema(OUTCOME).parquet(path).where("outcome = 'vector'")
    if limit is not None:
        x = x.orderBy(F.asc_nulls_last("row_pos"), "sequence_id").limit(limit)
    x = x.select("sequence_id", "embedding")
    return x if ids is None else x.join(ids, "sequence_id", "left_semi")


def extract(subset: DataFrame, encoder: Encoder, store: EmbeddingStore, batch_size: int = 1024) -> dict:
    """Encodes what the store lacks, in one pass: vectors go to the store, failed batches to its failures, where the next run tries
    them again. A store of another encoder or width is written anew. Also writes, and returns, the manifest."""
    was = store.manifest()
    anew = was is not None and (was["dim"], was["encoder"]) != (encoder.dim, encoder.name)
    todo = subset if anew else store.missing(subset)
    if todo.groupBy("seq_id").count().where("count > 1").limit(1).count():
        raise ValueError("a vector needs one id, and an id one vector")
    began, before = time.time(), 0 if anew else store.n_committed()
    store.write(run_encoder(todo, encoder, batch_size), "overwrite" if anew else "append")
    took = time.time() - began
    now = store._rows("vector").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest")).first()
    lost = store._rows("failed").join(store.committed(), "sequence_id", "left_anti").agg(F.count("*").alias("batches"), F.coalesce(F.sum("batch_rows"), F.lit(0)).alias("rows")).first()
    out = {
        "encoder": encoder.name, "dim": encoder.dim, "rows": now["rows"], "failed": lost["rows"], "failed_batches": lost["batches"], "tokens": now["tokens"], "longest": now["longest"],
        "written": now["rows"] - before, "seconds": round(took, 3), "rows_a_second": round((now["rows"] - before) / max(took, 1e-9), 3), "restarted": anew,
    }
    store.describe(out)
    return out

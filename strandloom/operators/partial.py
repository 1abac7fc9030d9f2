"""Sums of arrays over all rows: each task adds up its own, the parts meet in a tree of small tasks, the driver gets the
total alone: one array of each name, whatever the number of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32  # parts that meet in one task
_PART = "name int, sums binary"


def _written(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["name", "sums"])


def _added(rows) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for name, sums in rows:
        x = np.frombuffer(sums)
        total[name] = total[name] + x if name in total else x
    return total


def array_sums(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], parts: int | None = None) -> dict[int, np.ndarray]:
    """The sums, by name, of the arrays (float64, flat) that work returns for each task's rows. parts: how many tasks df has, if known."""

    def first(batches):
        yield _written(work(batches))

    def more(batches):
        yield _written(_added((r["name"], r["sums"]) for b in batches for r in b.to_pylist()))

    parts, out = parts or df.rdd.getNumPartitions(), df.mapInArrow(first, _PART)
    while parts > 1:
        parts = -(-parts // FAN)
        out = out.repartition(parts, F.spark_partition_id() % parts).mapInArrow(more, _PART)
    return _added(out.collect())


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of vectors of one length, without nulls."""
    c = batch.column(name)
    return np.asarray(c.flatten(), float).reshape(len(c), -1) if len(c) else np.zeros((0, 0))

"""Shared pieces of the corpus operators: tables, durable intermediate results, hashing of whole texts, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_ROOTS: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """These names, with more underscores in front where a column has them in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder in spark.checkpoint.dir; a temporary one only for a single-process master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub("^file:/(?!/)", "file:///", full).rstrip("/")
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    return _LOCAL_ROOTS[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and outlives executors.

    The path is appended to keep, so that the caller can remove the table with discard() once it is consumed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        path = hadoop(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


# ---------------------------------------------------------------- places in order


def _count_within(group: str):
    """_pos: the place of each row among its task's rows of the same group; a group's rows come together."""

    def run(batches):
        last, n = None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column(group))
            ends = runs.run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            pos = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
            if len(ends):
                names = runs.values
                if names[0].as_py() == last:
                    pos[: ends[0]] += n
                last, n = names[-1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos)], [*batch.schema.names, "_pos"])

    return run


def ranked(df: DataFrame, group: str, order: list[str], name: str, keep: list[str]) -> DataFrame:
    """df, written, with _pos: each row's place from 0 among the rows of its group (a string, never null) by order, nulls first.

    Rows are dealt out by ranges of group and order, so that a group that holds most rows spreads over all tasks, as do rows
    alike in both, by the tasks that they come from. Places are counted within a task; where a group goes on in a later task,
    what the earlier ones hold of it is added, for which the driver takes one row a task."""
    spark, by = df.sparkSession, [group, *order]
    dealt = df.withColumn("_from", F.spark_partition_id()).repartitionByRange(*by, "_from").sortWithinPartitions(*by, "_from").drop("_from").withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("_pos", T.LongType())])
    out = materialize(dealt.mapInArrow(_count_within(group), schema), name, keep)
    ends = out.groupBy("_part").agg(F.min(group).alias("low"), F.max(F.struct(group, "_pos")).alias("high")).collect()
    goes_on, held, before = None, 0, []
    for r in sorted(ends, key=lambda r: r["_part"]):
        start = held if r["low"] == goes_on else 0
        if start:
            before.append((r["_part"], r["low"], start))
        held = r["high"]["_pos"] + 1 + (start if r["high"][group] == r["low"] else 0)
        goes_on = r["high"][group]
    if before:
        more = F.broadcast(spark.createDataFrame(before, f"_part int, {group} string, _before long"))  # a row a task at most
        out = out.join(more, ["_part", group], "left").withColumn("_pos", F.col("_pos") + F.coalesce("_before", F.lit(0))).drop("_before")
    return out.drop("_part")


# ---------------------------------------------------------------- hashing of texts

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93 | 1
_PINV = pow(_P, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, a bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, 1 << 20)
        made = []
        for base in (_P, _PINV):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def rolling(flat: np.ndarray, lower: bool) -> np.ndarray:
    """Prefix sums of a polynomial hash; see gram_hash."""
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[flat] * powers(len(flat))[0], out=out[1:])
    return out


def gram_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of flat[start:end], the same wherever the bytes stand."""
    inv = powers(len(prefix))[1]
    return mix64((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def chunks(texts: pa.Array, limit: int = 1 << 19):
    """Splits an Arrow string array into (first row, flat bytes, offsets) of about limit bytes; a longer text comes alone.

    Nulls come as empty texts."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int32, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(flat: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are not in space), and for each text the index of its first word.

    The last of these indices is the number of words."""
    inside = ~space[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1])) if len(flat) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1 if len(flat) else starts
    return starts, ends, np.searchsorted(starts, offs)


def shingles(flat: np.ndarray, offs: np.ndarray, k: int, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, lower-cased in A-Z; of a text with fewer words, one of the whole sequence.

    Also each text's first shingle (one more at the end) and the word index at which each shingle starts."""
    starts, ends, first = words(flat, offs, space)
    h = gram_hash(rolling(flat, True), starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    left = first[1:][doc] - np.arange(len(h))  # words from here to the text's end
    out = np.zeros(len(h), np.uint64)
    take = np.zeros(len(h), bool)
    for size in range(1, k + 1):
        at = np.flatnonzero(left >= k) if size == k else np.flatnonzero((left == size) & (n[doc] == size))
        acc = np.full(len(at), size if size < k else 0, np.uint64)
        for j in range(size):
            acc = mix64(acc * _M2 + h[at + j] + _GOLD)
        out[at], take[at] = acc, True
    at = np.flatnonzero(take)
    return out[at], np.searchsorted(at, first), at


# ---------------------------------------------------------------- components


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


#: Rows of an edge table that one task takes; fewer, larger partitions where edges are few.
EDGE_ROWS = 250_000


def connected_components(edges: DataFrame, keep: list[str]) -> DataFrame:
    """(node, root) for the nodes of edges (a, b); root is the smallest node of the component.

    Alternates large-star and small-star until nothing changes. Nothing is collected and no neighbour list is built: a hot
    node costs one partial minimum and a join that adaptive execution can split. Partitions follow the number of edges."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges", keep)
    was = _fingerprint(e)
    while was[0]:
        n = -(-2 * was[0] // EDGE_ROWS)
        e = e.coalesce(n)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(n)
        low = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(n).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").coalesce(n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(n)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(n)
        small = large.join(low, "u").coalesce(n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).coalesce(n).distinct().coalesce(n)
        e = materialize(small, "edges", keep)
        now = _fingerprint(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

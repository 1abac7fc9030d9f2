"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards, and each shard has a weight; racks and regions weigh what is below
them. A document descends the tree: at each level every child gets a draw seeded by doc_id and by the child's name, divided
by its weight as in weighted rendezvous hashing, and the smallest wins. A draw depends on nothing but doc_id, the child's
name and its weight, so a change of weights moves documents only into or out of the subtrees whose weights change. A new
shard joins as a region of its own, by which no other weight changes: documents move only into it.

Defined cases: a null text has size 8 and the CRC-32 of an empty text; all rows with a null doc_id, as rows with equal
doc_id, go to one shard; rows that are alike in doc_id, size and checksum get adjacent slots and are alike in the result; an
empty table gives an empty result; place() passes other columns through, whose names must not be its own, and assign() reads
doc_id and text alone and returns places only, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, read_table

#: The base tree of the production layout: regions x racks x shards.
REGIONS, RACKS, SHARDS = 3, 2, 4
BASE = REGIONS * RACKS * SHARDS
SEED = "shard-1"
#: Rows that one task numbers; buckets are as many as keep to it on average.
SLOT_ROWS = 100_000

#: {region: {rack: {shard number: weight}}}
Tree = dict[str, dict[str, dict[int, float]]]


def default_tree(n: int) -> Tree:
    """The base tree, and for each shard number from BASE on a region with that shard alone."""
    if n < BASE:
        raise ValueError(f"the base tree has {BASE} shards")
    tree: Tree = {f"r{r}": {f"k{k}": {(r * RACKS + k) * SHARDS + s: 1.0 for s in range(SHARDS)} for k in range(RACKS)} for r in range(REGIONS)}
    for s in range(BASE, n):
        tree[f"x{s}"] = {"k0": {s: 1.0}}
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw with rate weight, from 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:{name}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(16**13))
    return -F.ln(unit) / F.lit(weight)


def _least(options: list[tuple[Column, Column]]) -> Column:
    """The value of the smallest draw; the first on a tie."""
    if len(options) == 1:
        return options[0][1]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(options)]))["v"]


def locate(key: Column, tree: Tree) -> Column:
    """The shard to which the tree takes a key. Below the root only the chosen region's and rack's draws are made."""
    weight = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    region = _least([(_draw(key, r, sum(weight[r].values())), F.lit(r)) for r in tree])

    def within_rack(r: str, k: str) -> Column:
        return _least([(_draw(key, f"{r}/{k}/{s}", w), F.lit(s)) for s, w in tree[r][k].items()])

    def within_region(r: str) -> Column:
        racks = tree[r]
        if len(racks) == 1:
            return within_rack(r, next(iter(racks)))
        rack = _least([(_draw(key, f"{r}/{k}", weight[r][k]), F.lit(k)) for k in racks])
        out = None
        for k in racks:
            out = (F.when if out is None else out.when)(rack == k, within_rack(r, k))
        return out

    out = None
    for r in tree:
        out = (F.when if out is None else out.when)(region == r, within_region(r))
    return out.cast("int")


def place(docs: DataFrame, n: int = BASE) -> DataFrame:
    """docs with size, text_crc32, law, shard and grown_shard. No shuffle."""
    out = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(8))
    out = out.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")).withColumn("law", F.lit("key"))
    return out.withColumn("shard", locate(F.col("doc_id"), default_tree(n))).withColumn("grown_shard", locate(F.col("doc_id"), default_tree(n + 1)))


def number(placed: DataFrame, keys: list[str]) -> DataFrame:
    """placed with slot, gapless from 0 within each shard, in the order of hash buckets and then of keys.

    Rows alike are counted first, so that a row that repeats without end is one row for every window, and come back as many
    at the end. The distinct rows of a shard are dealt to buckets by hash; a bucket starts where the earlier ones end, so
    that no task numbers a whole shard."""
    alike = materialize(placed.groupBy(*placed.columns).agg(F.count("*").alias("_n")), "alike")
    total = alike.count()
    dealt = alike.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(max(1, round(total / BASE / SLOT_ROWS)))).cast("int"))
    counts = dealt.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_m"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(counts.withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m"), "slots")
    w = W.partitionBy("shard", "_bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(W.unboundedPreceding, -1)
    first = dealt.join(starts, ["shard", "_bucket"]).withColumn("_first", F.col("_start") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    once = first.where("_n = 1").withColumn("slot", F.col("_first").cast("long"))
    # of rows that repeat, pieces of bounded length are dealt out before they become rows
    pieces = first.where("_n > 1").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / SLOT_ROWS))))
    pieces = pieces.repartition("shard", *keys, "_piece")
    at = F.explode(F.sequence(F.col("_piece") * SLOT_ROWS, F.least(F.col("_n"), (F.col("_piece") + 1) * SLOT_ROWS) - 1))
    often = pieces.withColumn("_at", at).withColumn("slot", (F.col("_first") + F.col("_at")).cast("long"))
    return once.select(*placed.columns, "slot").union(often.select(*placed.columns, "slot"))


def assign(docs: DataFrame, n: int = BASE) -> DataFrame:
    """doc_id of each row of docs with its size, checksum, law, shard, slot in the shard, and shard of a tree with one more.

    The slots are numbered on slim rows; texts are never shuffled for them."""
    return number(place(docs.select("doc_id", "text"), n).drop("text"), ["doc_id", "text_crc32", "size"])


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

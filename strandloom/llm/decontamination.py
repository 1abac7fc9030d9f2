"""Benchmark decontamination by SimHash over windows of the items' sizes.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z; shingles are k words (of a shorter text,
the whole sequence). For each size that an item has, a window of as many shingles slides over the document. A window's
SimHash sums the signs of its shingles' hash bits, by differences of running sums. Items are indexed by the eight bytes of
their SimHash: two fingerprints within RADIUS = 23 bits agree in some byte to 2 bits (8 * 3 > 23), so looking up each byte with
all bytes within 2 bits of it finds every item in the radius. What is found is held to the radius, then verified by the exact
similarity of the two bags of shingles, sum of the lesser counts / sum of the greater counts. A document of fewer shingles than
an item is one window as a whole, if it has at least 0.8 times the item's shingles; with fewer, no similarity of 0.8 is possible.

At a similarity of 0.8 the fingerprints' 64 bits differ in 10 on average with a deviation of 3. A window that shares no shingle
with any item has similarity 0, so only windows around shared shingles are fingerprinted, which loses nothing.

The items are the query set: their distinct texts are read in blocks of about ITEMS texts and BYTES bytes, a block at a time,
and the documents pass by each block once, without a shuffle. Where there are several blocks, what one has found is written
before the next is read, so that driver and executors hold one block.

Defined cases: null and empty texts match nothing, nor do null and empty items; an item of fewer than k words matches a document
only if their whole sequences agree; repeated items are each reported; a null doc_id passes through; repeated rows get equal
results; an empty table gives an empty result, and an empty benchmark finds nothing; other columns pass through, whatever their
names (the added ones get more underscores if they are taken).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, materialize, mix64, read_table, shingles

K, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
ITEMS, BYTES = 20_000, 32 << 20
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BITS = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)


def _signs(h: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each hash."""
    bits = np.unpackbits(mix64(h).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def window_prints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash bytes (windows x 8) of all windows of size shingles."""
    run = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(_signs(h), axis=0, out=run[1:])
    return np.packbits(run[size:] - run[:-size] > 0, axis=1)


def whole_print(h: np.ndarray) -> np.ndarray:
    """SimHash bytes (1 x 8) of all shingles as one window, summed in pieces."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        total += _signs(h[at : at + (1 << 14)]).sum(0)
    return np.packbits(total > 0)[None]


def bag_similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class Index:
    """Fingerprints of texts by size, their bags, all their shingles, and the ids of the items that have each text."""

    def __init__(self, items: list[tuple]):
        self.ids, self.bags = [], []
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes: dict[int, list] = {}
        for item_ids, text in items:
            for _, flat, offs in chunks(pa.array([text], pa.string())):
                h, _, _ = shingles(flat, offs, K, _SEPARATOR)
                if len(h):
                    sizes.setdefault(len(h), []).append((len(self.ids), window_prints(h, len(h))[0]))
                    self.ids.append(item_ids)
                    self.bags.append(Counter(h.tolist()))
        for n, rows in sizes.items():
            self.by_size[n] = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint8))
        self.vocabulary = np.unique(np.array([x for b in self.bags for x in b], np.uint64))

    def look_up(self, prints: np.ndarray, size: int):
        """(window, item) pairs within the radius, by the bytes that agree to RADIUS // BLOCKS bits."""
        rows, own = self.by_size[size]
        for at in range(0, len(rows), 1024):
            part = own[at : at + 1024]
            near = np.zeros((len(prints), len(part)), bool)
            for b in range(BLOCKS):
                table = _BITS[:, part[:, b]] <= RADIUS // BLOCKS  # byte value x item
                near |= table[prints[:, b]]
            w, i = np.nonzero(near)
            close = _BITS[prints[w], part[i]].sum(1, dtype=np.int32) <= RADIUS
            for x, y in zip(w[close].tolist(), rows[at + i[close]].tolist()):
                yield x, y

    def matches(self, h: np.ndarray) -> dict[int, float]:
        """Best similarity of each item to a window of the document with these shingles, where it suffices."""
        if not len(self.vocabulary):  # no item has a word
            return {}
        hit = np.flatnonzero(self.vocabulary[np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)] == h)
        best: dict[int, float] = {}
        if not len(hit):
            return best
        whole = None
        for size in self.by_size:
            if size > len(h):
                if len(h) / size < SIMILARITY:
                    continue
                if whole is None:
                    whole = whole_print(h), Counter(h.tolist())
                for _, i in self.look_up(whole[0], size):
                    s = bag_similarity(whole[1], self.bags[i])
                    if s >= SIMILARITY:
                        best[i] = s
                continue
            cuts = np.flatnonzero(np.diff(hit) > 2 * size) + 1
            for group in np.split(hit, cuts):
                lo, hi = max(0, group[0] - size + 1), min(len(h), group[-1] + size)
                for base in range(lo, hi - size + 1, 1 << 14):  # in pieces, so that running sums stay small
                    part = h[base : min(hi, base + (1 << 14) + size - 1)]
                    if len(part) < size:
                        break
                    bags: dict[int, Counter] = {}
                    for w, i in self.look_up(window_prints(part, size), size):
                        if best.get(i) == 1.0:
                            continue
                        if w not in bags:
                            bags[w] = Counter(part[w : w + size].tolist())
                        s = bag_similarity(bags[w], self.bags[i])
                        if s >= SIMILARITY and s > best.get(i, 0.0):
                            best[i] = s
        return best


def _finder(index_of, fields: list[str], added: list[str]):
    def run(batches):
        index: Index = index_of()
        for batch in batches:
            ids, best = (batch.column(c).to_pylist() for c in added)
            for first, flat, offs in chunks(batch.column("text")):
                h, starts, _ = shingles(flat, offs, K, _SEPARATOR)
                for i in range(len(offs) - 1):
                    own = h[starts[i] : starts[i + 1]]
                    found = index.matches(own) if len(own) else {}
                    if found:
                        ids[first + i] = sorted([*ids[first + i], *(y for x in found for y in index.ids[x])], key=lambda x: (x is None, x))
                        best[first + i] = max(best[first + i], *found.values())
            cols = [batch.column(c) for c in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, batch.schema.field(added[0]).type), pa.array(best, pa.float64())], [*fields, *added])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with _item_ids, those of the items that a window of the text resembles, and _similarity, the greatest (0 if none)."""
    spark = docs.sparkSession
    kind = dict(benchmark.dtypes)["item_id"]
    items = materialize(benchmark.where("text is not null").groupBy("text").agg(F.collect_list(F.struct("item_id")).alias("ids")), "items")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(1, math.ceil(n / ITEMS), math.ceil(size / BYTES))
    fields, added = docs.columns, fresh(docs.columns, "_item_ids", "_similarity")
    out = docs.withColumn(added[0], F.array().cast(f"array<{kind}>")).withColumn(added[1], F.lit(0.0))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields])
    for p in range(parts if n else 0):
        rows = [([x[0] for x in r["ids"]], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).collect()]
        shared = spark.sparkContext.broadcast(rows)
        out = out.mapInArrow(_finder(lambda shared=shared: Index(shared.value), fields, added), schema)
        if p < parts - 1:
            out = materialize(out, "leaks")
            shared.destroy()
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which nothing is found, with the columns of docs."""
    ids, similarity = fresh(docs.columns, "_item_ids", "_similarity")
    return find_leaks(docs, benchmark).where(F.size(ids) == 0).drop(ids, similarity)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the items found in it, the greatest similarity, and whether it is kept (nothing found)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", F.col("_item_ids").alias("item_ids"), F.col("_similarity").alias("similarity"), (F.size("_item_ids") == 0).alias("kept"))

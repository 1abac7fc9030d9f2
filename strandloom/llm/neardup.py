"""Near-duplicate documents by HyperMinHash.

Words are `[^\\x20\\x09-\\x0D]+` of the text lower-cased in A-Z; a document's set holds its distinct k-word shingles (with fewer
words, the whole sequence as one). Rows with equal sets form a class; classes are linked when 100 * |A & B| >= percent * |A | B|.

A sketch has 128 registers. A shingle's hash names a register and leaves 57 bits; the smallest of these is kept as its count
of leading zeros (6 bits) and the 10 bits after the first one. Four registers make a band, and the band's eight bytes are the
bucket key. At a similarity of 0.8 a pair shares no band with a probability of 5e-8; bands without any shingle are no evidence
and are left out.

Pairs are never expanded into rows. First each class is held against the smallest class of each of its buckets, by sketch, and
the best one is confirmed on the full sets; that joins most of a group of copies with one confirmation each. What may still be
missing are links between components. Buckets that hold several of them are read in tiles of bounded size. A first pass
returns for each class its most similar partner in another component, to be confirmed; a second returns the members that still
have a partner in another component, and reads these tiles again with the full sets, which gives a spanning forest of the
links between components. Pairs within one component change nothing and are left out, and a pair is looked at only in the
first band in which it agrees. Sketches rule out a pair only if the collision-corrected estimate is six standard deviations
below the threshold.

Defined cases: a null or empty text, or one without words, has an empty set, links with nothing and is its own component; a null
doc_id never becomes a component's id unless the component has no other (then it is null), and is kept if its component's id is
null as well; rows with equal doc_id are judged each by its own text; repeated rows are one class and are all kept if the class
holds the smallest id (unique() keeps one row of a group); an empty table gives an empty result; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, connected_components, discard, materialize, mix64, read_table, shingles

REGISTERS, BAND, MANTISSA = 128, 4, 10
_REST = 57  # bits below the register's number
TILE_ROWS, SET_BYTES = 2048, 8 << 20  # bounds of a tile's side


def sketch(mixed: np.ndarray) -> np.ndarray:
    """Registers of a sorted array of distinct mixed hashes: leading zeros + 1 above the mantissa; 0 if empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(mixed):
        return out
    bucket = (mixed >> np.uint64(_REST)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = mixed[at] & np.uint64(2**_REST - 1)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bit length
    zeros = np.minimum(_REST - bits, 61)
    shift = bits - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64(2**MANTISSA - 1)
    out[bucket[at]] = ((zeros + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and how many registers either fills."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    ratio = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    chance = 0.1699 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    raw = same / np.maximum(used, 1)
    return (raw - chance) / (1 - chance), used


def _sets(texts: pa.Array, k: int):
    for _, flat, offs in chunks(texts):
        h, first, _ = shingles(flat, offs, k)
        h = mix64(h)
        for i in range(len(offs) - 1):
            yield np.unique(h[first[i] : first[i + 1]])


def _signer(k: int):
    def run(batches):
        for batch in batches:
            fps, ns, regs, rest = [], [], [], [c for c in batch.schema.names if c != "text"]
            for s in _sets(batch.column("text"), k):
                ns.append(len(s))
                fps.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.array(regs, pa.binary())], [*rest, "fp", "n_shingles", "regs"])

    return run


def _setter(k: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(_sets(part.column("text"), k))
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                offs = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                fps = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["fp", "grams"])

    return run


def _allowed(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and where they do not rule out a similarity of least."""
    est, used = estimate(a, b, na, nb)
    return est, est >= least - 6 * np.sqrt(least * (1 - least) / np.maximum(used, 1))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _estimator(least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            est, keep = _allowed(_registers(batch.column("regs_a")), _registers(batch.column("regs_b")), na, nb, least)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], ["a", "b", "est"])
            yield out.filter(pa.array(keep))

    return run


def _tables(batches, names: list[str], rows: int = 4096):
    """Whole tiles, many at once: batches sorted by names are cut only where these change."""
    held: list[pa.RecordBatch] = []
    size, least = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(_starts(table, names)[-1])
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), size - cut
        least = max(rows, 2 * size)
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where tiles begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in names:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class _Tiles:
    """Rows of whole tiles as arrays; pairs() are those that may be links between components."""

    def __init__(self, table: pa.Table, names: list[str], percent: int):
        at = _starts(table, names)
        self.percent = percent
        self.fps = table.column("fp").to_pylist()
        codes: dict[bytes, int] = {}
        self.root = np.array([codes.setdefault(r, len(codes)) for r in table.column("root").to_pylist()])
        self.end = np.repeat(np.append(at[1:], len(self.fps)), np.diff(np.append(at, len(self.fps))))
        self.n, self.band = table.column("n_shingles").to_numpy(), table.column("band").to_numpy()
        self.x, self.y = (table.column(c).to_numpy() for c in ("x", "y"))
        self.block = table.column("block").to_numpy() if "block" in table.column_names else None
        self.regs = _registers(table.column("regs"))

    def pairs(self):
        """(u, v, estimate) in pieces. A pair counts in the first band in which it agrees and in no other bucket."""
        alive, d, us, vs, held = np.arange(len(self.fps)), 1, [], [], 0
        while True:
            alive = alive[alive + d < self.end[alive]]
            if len(alive):
                v = alive + d
                ok = self.root[alive] != self.root[v]
                ok &= (self.x[alive] & self.y[v]) | (self.y[alive] & self.x[v])
                ok &= np.minimum(self.n[alive], self.n[v]) * 100 >= np.maximum(self.n[alive], self.n[v]) * self.percent
                if self.block is not None:  # of a tile of two blocks only pairs across
                    ok &= (self.block[alive] != self.block[v]) | (self.block[alive] < 0)
                us.append(alive[ok])
                vs.append(v[ok])
                held += len(us[-1])
                d += 1
            if held >= 1 << 14 or not len(alive):
                u, v = np.concatenate([*us, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*vs, np.zeros(0, np.int64)]).astype(np.int64)
                for k in range(0, len(u), 1 << 14):
                    yield from self._near(u[k : k + (1 << 14)], v[k : k + (1 << 14)])
                us, vs, held = [], [], 0
            if not len(alive):
                return

    def _near(self, u: np.ndarray, v: np.ndarray):
        wide = self.regs.view(np.uint64)
        a = wide[u]
        own = ((a == wide[v]) & (a != 0)).argmax(1) == self.band[u]
        u, v = u[own], v[own]
        if len(u):
            est, ok = _allowed(self.regs[u], self.regs[v], self.n[u], self.n[v], self.percent / 100)
            yield u[ok], v[ok], est[ok]


_TILE = ["key", "i", "j"]


def _best_partners(percent: int):
    """For each class of a tile its most similar partner in another component: (b, a, est)."""

    def run(batches):
        for table in _tables(batches, _TILE):
            t = _Tiles(table, _TILE, percent)
            top, of = np.full(len(t.fps), -1.0), np.full(len(t.fps), -1)
            for u, v, est in t.pairs():
                for x, y in ((u, v), (v, u)):
                    order = np.argsort(est, kind="stable")
                    order = order[est[order] > top[x[order]]]
                    top[x[order]], of[x[order]] = est[order], y[order]  # the last, and so the greatest, stays
            hit = np.flatnonzero(of >= 0)
            yield pa.RecordBatch.from_arrays([pa.array([t.fps[i] for i in hit], pa.binary()), pa.array([t.fps[i] for i in of[hit]], pa.binary()), pa.array(top[hit])], ["b", "a", "est"])

    return run


def _open_rows(percent: int):
    """The rows of tiles that have some partner in another component."""

    def run(batches):
        for table in _tables(batches, _TILE):
            t = _Tiles(table, _TILE, percent)
            hit = np.zeros(len(t.fps), bool)
            for u, v, _ in t.pairs():
                hit[u] = hit[v] = True
            yield from table.select([*_TILE, "band", "x", "y", "fp", "root", "n_shingles"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _linked(percent: int):
    """Links between components that the full sets confirm: a spanning forest of each tile's, as (a, b)."""
    names = [*_TILE, "p", "q"]

    def run(batches):
        for table in _tables(batches, names, 1024):
            t = _Tiles(table, names, percent)
            column = table.column("grams").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            offs, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)  # they are sorted as unsigned
            grams = [flat[a:b] for a, b in zip(offs[:-1], offs[1:])]
            parent = list(range(int(t.root.max()) + 1))
            out = []

            def find(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for u, v, _ in t.pairs():
                order = np.argsort(u, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(u[order])) + 1) if len(order) else ():
                    a = int(u[part[0]])
                    others = [int(b) for b in v[part] if find(t.root[b]) != find(t.root[a])]
                    if not others:
                        continue
                    own, size = grams[a], np.array([len(grams[b]) for b in others])
                    every = np.concatenate([grams[b] for b in others])
                    same = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                    run_ = np.concatenate(([0], np.cumsum(same)))
                    ends = np.cumsum(size)
                    both = run_[ends] - run_[ends - size]
                    for k in np.flatnonzero(both * 100 >= (size + len(own) - both) * percent).tolist():
                        x, y = find(t.root[a]), find(t.root[others[k]])
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            out.append((t.fps[a], t.fps[others[k]]))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


class _Linker:
    """Confirms links between classes. nodes: fp, rep, n_shingles, regs."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, percent: int, keep: list[str]):
        self.docs, self.nodes, self.k, self.percent, self.keep = docs, nodes, k, percent, keep

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and sketches allow, with est."""
        n = self.nodes.select("fp", "n_shingles", "regs")
        x = pairs.join(n.toDF("a", "n_a", "regs_a"), "a").join(n.toDF("b", "n_b", "regs_b"), "b")
        x = x.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        return x.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_estimator(self.percent / 100), "a binary, b binary, est double")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """fp and grams, the sorted hashes, of the classes in wanted (fp)."""
        reps = self.nodes.join(wanted.distinct(), "fp", "left_semi").select(F.col("rep").alias("doc_id"))
        texts = self.docs.join(reps, self.docs["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi").select("text")
        return materialize(texts.mapInArrow(_setter(self.k), "fp binary, grams array<bigint>").dropDuplicates(["fp"]), "sets", self.keep)

    def tiles(self, every: DataFrame) -> DataFrame:
        """Rows of buckets (key, band, fp, root) that hold several components, dealt to tiles (key, i, j) and sorted by these.

        The members of a bucket's most frequent component are held only against the others: there is a tile for each block i
        of all members (x) and each block j of those others (y), so that a bucket costs a row for each member as long as the
        others fit one block."""
        of = every.groupBy("key", "root").agg(F.count("*").alias("n"))
        mixed = of.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
        mixed = mixed.select("key", F.ceil(F.col("m") / TILE_ROWS).cast("int").alias("all"), F.ceil((F.col("m") - F.col("top.n")) / TILE_ROWS).cast("int").alias("few"), F.col("top.root").alias("top"))
        deal = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
        at = lambda i, j, x, y: F.struct(i.alias("i"), j.alias("j"), F.lit(x).alias("x"), F.lit(y).alias("y"))
        first = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda j: at(deal("all"), j, True, False))
        second = F.when(F.col("root") != F.col("top"), F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda i: at(i, deal("few"), False, True))).otherwise(F.slice(first, 1, 0))
        places = F.when(F.col("all") == 1, F.array(at(F.lit(0), F.lit(0), True, True))).otherwise(F.concat(first, second))
        rows = every.join(mixed, "key").select("key", "band", "fp", "root", F.explode(places).alias("at")).select("key", "at.i", "at.j", "at.x", "at.y", "band", "fp", "root")
        rows = rows.join(self.nodes.select("fp", "n_shingles", "regs"), "fp")
        return rows.repartition(*_TILE).sortWithinPartitions(*_TILE, "fp")

    def nearest(self, every: DataFrame) -> DataFrame:
        """Confirmed links of classes to the most similar partner that a bucket shows in another component."""
        found = self.tiles(every).mapInArrow(_best_partners(self.percent), "b binary, a binary, est double")
        return materialize(self.confirm(found.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a"))), "links", self.keep)

    def across(self, every: DataFrame) -> DataFrame:
        """Links (a, b) that join all components between which there is any link."""
        kinds = {f.name: f.dataType.simpleString() for f in every.schema.fields}
        schema = f"key bigint, i int, j int, band int, x boolean, y boolean, fp binary, root {kinds['root']}, n_shingles bigint"
        rows = materialize(self.tiles(every).mapInArrow(_open_rows(self.percent), schema), "open", self.keep)
        size = rows.groupBy(*_TILE).agg(F.ceil(F.sum("n_shingles") * 8 / SET_BYTES).cast("int").alias("parts"))
        rows = rows.join(size, _TILE).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).withColumn("block", F.when(F.col("p") == F.col("q"), -1).otherwise(F.col("own")))
        sets = self.sets(rows.select("fp")).join(self.nodes.select("fp", "regs"), "fp")
        names = [*_TILE, "p", "q"]
        full = rows.select(*names, "block", "band", "x", "y", "fp", "root", "n_shingles").join(sets, "fp").repartition(*names).sortWithinPartitions(*names, "fp")
        return materialize(full.mapInArrow(_linked(self.percent), "a binary, b binary"), "links", self.keep)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that the full sets confirm."""
        pairs = materialize(pairs.select("a", "b"), "pairs", self.keep)
        sets = self.sets(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")))
        x = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")
        both = F.size(F.array_intersect("grams_a", "grams_b"))
        return x.where(both * 100 >= (F.size("grams_a") + F.size("grams_b") - both) * self.percent).select("a", "b")


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): the rows of docs (doc_id, text and others) with fp and n_shingles instead of text; fp, root and component_id."""
    spark = docs.sparkSession
    keep: list[str] = []
    rest = "".join(f"{c} {t}, " for c, t in docs.dtypes if c != "text")
    signed = materialize(docs.mapInArrow(_signer(k), f"{rest}fp binary, n_shingles bigint, regs binary"), "signed")
    nodes = signed.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    nodes = materialize(nodes, "nodes", keep)

    width = 2 * BAND
    bytes_ = F.substring("regs", F.col("band") * width + 1, F.lit(width))
    banded = nodes.select("fp", "regs", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))).alias("band")).where(bytes_ != F.lit(bytes(width))).select(F.xxhash64("band", bytes_).alias("key"), "band", "fp")
    leaders = banded.groupBy("key").agg(F.min("fp").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(banded.join(leaders, "key"), "members", keep)  # key, band, fp, leader

    linker = _Linker(docs, nodes, k, percent, keep)
    stars = linker.possible(members.where("fp != leader").select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct())
    links = materialize(linker.confirm(stars.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a"))), "links", keep)
    roots = materialize(connected_components(links, keep), "roots", keep)
    for more in (linker.nearest, linker.across):  # most components meet in the first, so that few sets are read for the second
        every = members.join(roots, members["fp"] == roots["node"], "left").select("key", "band", "fp", F.coalesce("root", "fp").alias("root"))
        found = more(materialize(every, "every", keep))
        if not found.isEmpty():
            links = links.union(found)
            roots = materialize(connected_components(links, keep), "roots", keep)

    of = nodes.select("fp", "rep").join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialize(of.join(ids, "root").select("fp", "root", "component_id"), "classes")
    discard(spark, keep)
    return signed.drop("regs"), classes


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs (doc_id, text)."""
    slim, classes = _classes(docs.select("doc_id", "text"), k, percent)
    out = slim.where(F.col("fp").isNotNull()).join(classes, "fp").select("doc_id", "n_shingles", "component_id")
    out = out.union(slim.where(F.col("fp").isNull()).select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def unique(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, with the columns of docs: the one of the smallest doc_id, nulls last, and
    of these the one of the smallest MD5 of its text.

    A text without words is a group of its own; of rows that agree in doc_id and text one stays."""
    rows, classes = _classes(docs.select("doc_id", "text", F.md5("text").alias("key")), k, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    firsts = rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(first)
    firsts = firsts.join(classes, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.key")
    kept = firsts.union(rows.where(F.col("fp").isNull()).select("doc_id", "key")).toDF("_kept_id", "_kept_key")
    same = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & F.md5(docs["text"]).eqNullSafe(kept["_kept_key"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)

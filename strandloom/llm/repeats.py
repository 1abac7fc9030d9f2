"""Removal of byte strings that repeat, by enhanced suffix arrays and their common-prefix interval trees.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else, in any text. One suffix array of a whole
corpus fits no machine, so suffixes are dealt by content. Every string of that length holds an anchor: the leftmost smallest
hash among the GRAM-byte strings in it, which is the same wherever the string stands. Anchors with equal hashes form a group,
and any repeat puts two of its starts into one group at the same alignment. A member's right context is its suffix, and the
left context says how far matches extend to the left; both are cut to what a string around the anchor can cover.

Within a group, suffixes stand in order (Spark's sort) with their common prefixes; a stack scan yields the intervals of the
common-prefix tree. For each interval with prefix r, the members' left contexts in order give each member's longest left
extension l shared with any other member, not just a neighbour; where extensions differ among the members, the interval is a
maximal repeat and l varies by member. If l + r reaches the length, the member's bytes from -l to r go. As all such pieces
hold the anchor, a member's union is one piece.

Texts with an exact copy go whole, so one text stands for all its copies, and equal contexts of different texts are one member
with a count. A group with more than GROUP distinct contexts is not gathered but cut into the subtrees that can hold a match. For
a range of prefixes from R to R + STEP, two members that match have the first R bytes of the right context and the first
length - R - STEP + 1 of the left one in common; members alike in these form a subtree, which is scanned as a group is. Ranges
are tried one by one, so each match lies in a subtree. In a subtree of still more than GROUP members, which then share nearly
`length` bytes, each prefix and extension that sum to the length name one node, whose members are all alike in one window. Such
nodes are counted by 128 bits of their content and scan nothing.

Defined cases: a null text is empty; empty and short texts keep all bytes; rows with equal texts get equal results, and a null
or repeated doc_id changes nothing; an empty table gives an empty result; only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, gram_hash, materialize, mix64, read_table, rolling

LENGTH, GRAM, GROUP, STEP = 400, 128, 16_384, 17
_POS = np.uint64(2**34 - 1)  # low bits hold a position, so that the leftmost wins among equal hashes


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w, from minima of blocks read forwards and backwards."""
    n = len(x)
    pad = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(flat: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, position in flat and hash of every anchor."""
    none = np.zeros(0, np.int64)
    if len(flat) < length:
        return none, none, none.astype(np.uint64)
    at = np.arange(len(flat) - gram + 1)
    g = gram_hash(rolling(flat, False), at, at + gram)
    low = _window_min((g & ~_POS) | at.astype(np.uint64), length - gram + 1)
    size = np.diff(offs)
    starts = np.zeros(len(low) + 1, np.int64)  # +1 where windows of a text begin, -1 where they end
    ok = size >= length
    np.add.at(starts, offs[:-1][ok], 1)
    np.add.at(starts, offs[1:][ok] - length + 1, -1)
    pos = np.unique((low[np.cumsum(starts[:-1]) > 0] & _POS).astype(np.int64))
    return np.searchsorted(offs, pos, "right") - 1, pos, g[pos]


def _anchor_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            shas = batch.column("sha")
            for first, flat, offs in chunks(batch.column("text")):
                doc, pos, key = anchors(flat, offs, length, gram)
                yield pa.RecordBatch.from_arrays([shas.take(pa.array(doc + first)), pa.array((pos - offs[doc]).astype(np.int32)), pa.array(key.view(np.int64))], ["sha", "pos", "key"])

    return run


def _rows(batch: pa.RecordBatch, *names: str, size: int = 64):
    """Rows as tuples, a few at a time as Python objects."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield from zip(*[part.column(c).to_pylist() for c in names])


def _context_rows(length: int, gram: int):
    reach = length - gram

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("ctx", "key", "left", "right", "sha", "pos")}
            held = 0
            for sha, text, marks in _rows(batch, "sha", "text", "marks"):
                raw = text.encode()
                for m in marks:
                    p = m["pos"]
                    left, right = raw[max(0, p - reach) : p][::-1], raw[p : p + length]
                    held += len(left) + len(right)
                    for c, v in zip(out, (hashlib.md5(len(left).to_bytes(2, "big") + left + right).digest(), m["key"], left, right, sha, p)):
                        out[c].append(v)
                if held > 1 << 22:
                    yield _contexts(out)
                    held = 0
            if out["ctx"]:
                yield _contexts(out)

    return run


def _contexts(out: dict[str, list]) -> pa.RecordBatch:
    types = {"ctx": pa.binary(), "key": pa.int64(), "left": pa.binary(), "right": pa.binary(), "sha": pa.binary(), "pos": pa.int32()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in out.items()], list(out))
    for v in out.values():
        v.clear()
    return batch


def _common(rows: list[bytes]) -> np.ndarray:
    """Lengths of the common prefixes of neighbours."""
    size = np.array([len(r) for r in rows])
    wide = int(size.max()) if len(size) else 0
    if len(rows) < 2 or not wide:
        return np.zeros(max(0, len(rows) - 1), np.int64)
    table = np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in rows), np.uint8).reshape(len(rows), wide)
    differ = table[1:] != table[:-1]
    first = np.where(differ.any(1), differ.argmax(1), wide)
    return np.minimum(first, np.minimum(size[1:], size[:-1]))


def intervals(common: list[int]):
    """(prefix, first, last) of every interval of the common-prefix tree, by a scan with a stack; children before parents."""
    stack = [(0, 0)]
    for i, c in enumerate([*common, -1], 1):
        low = i - 1
        while stack and stack[-1][0] > c:
            p, low = stack.pop()
            if i - 1 > low:
                yield p, low, i - 1
        if c >= 0 and (not stack or stack[-1][0] < c):
            stack.append((c, low))


def covers(left: list[bytes], right: list[bytes], count: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and after the anchor go, for each member of a group in the order of right."""
    m = len(right)
    ls, rs = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i, n in enumerate(count):
        if n > 1 and len(left[i]) + len(right[i]) >= length:
            ls[i], rs[i] = len(left[i]), len(right[i])
    if m == 1:
        return ls, rs
    by_left = sorted(range(m), key=lambda i: (left[i], len(left[i])))
    shared = _common([left[i] for i in by_left])
    top = int(shared.max())
    rank = np.empty(m, np.int64)
    rank[by_left] = np.arange(m)
    suffix = np.array(by_left)
    for prefix, a, b in intervals(_common(right).tolist()):
        if prefix + top < length:
            continue
        ranks = np.sort(rank[a : b + 1])
        # the extension that two members share is the least one between them; reduceat's last piece has no end of its own
        between = np.minimum.reduceat(shared[: ranks[-1]], ranks[:-1])
        best = np.maximum(np.concatenate((between, [0])), np.concatenate(([0], between)))
        at = best + prefix >= length
        who = suffix[ranks[at]]
        ls[who] = np.maximum(ls[who], best[at])
        rs[who] = np.maximum(rs[who], prefix)
    return ls, rs


def _scan_groups(length: int):
    def done(key_rows, out):
        ls, rs = covers([r[1] for r in key_rows], [r[2] for r in key_rows], [r[3] for r in key_rows], length)
        for r, a, b in zip(key_rows, ls.tolist(), rs.tolist()):
            if b:
                out.append((r[0], a, b))

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for k, *row in _rows(batch, "key", "ctx", "left", "right", "n"):
                if k != key:
                    if rows:
                        done(rows, out)
                    key, rows = k, []
                rows.append(row)
            if out:
                yield _cover_batch(out)
                out = []
        if rows:
            done(rows, out)
        yield _cover_batch(out)

    return run


def _cover_batch(out: list[tuple]) -> pa.RecordBatch:
    c, a, b = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["ctx", "l", "r"])


def _ranges(length: int, gram: int) -> list[tuple[int, int]]:
    """(first, end) of each range of prefixes; the last one ends beyond the length."""
    firsts = list(range(gram, length + 1, STEP))
    return list(zip(firsts, [*firsts[1:], length + 1]))


def _subtree_rows(length: int, gram: int):
    """A row for each range that a context is long enough for: the range and a digest of what its subtree has in common."""

    def run(batches):
        for batch in batches:
            out = []
            for ctx, key, left, right in _rows(batch, "ctx", "key", "left", "right"):
                for at, (first, end) in enumerate(_ranges(length, gram)):
                    ext = length - end + 1
                    if len(left) >= ext and len(right) >= first:
                        out.append((ctx, at, hashlib.md5(key.to_bytes(8, "big", signed=True) + bytes([at]) + left[:ext] + right[:first]).digest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.binary()))], ["ctx", "range", "sub"])

    return run


def _node_rows(length: int, gram: int):
    """A row for each node that a context has within the range of a subtree: its content's hashes and extension."""

    def run(batches):
        for batch in batches:
            for ctx, left, right, at in _rows(batch, "ctx", "left", "right", "range"):
                first, end = _ranges(length, gram)[at]
                r = np.arange(first, min(end, len(right) + 1))
                ext = length - r
                r, ext = r[ext <= len(left)], ext[ext <= len(left)]
                if not len(r):
                    continue
                p = rolling(np.frombuffer(left[::-1] + right, np.uint8), False)
                a, b, half = len(left) - ext, len(left) + r, len(left) - ext + length // 2
                h1, h2 = gram_hash(p, a, b), mix64(gram_hash(p, a, half) * np.uint64(3) + gram_hash(p, half, b))
                cols = [h1.view(np.int64), h2.view(np.int64), ext.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([ctx] * len(r), pa.binary())], ["h1", "h2", "l", "ctx"])

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for sha, text, marks in _rows(batch, "sha", "text", "marks"):
                raw = text.encode()
                spans: list[list[int]] = []
                for a, b in sorted((m["a"], m["b"]) for m in marks):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((sha, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
            if out:
                cols = list(zip(*out))
                spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string(), spans_type))], ["sha", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def shared_rows(df: DataFrame, by: list[str], group: int) -> DataFrame:
    """The rows of df that another row equals in the columns `by`.

    Only values of at most `group` rows are dealt by them. The others, at most one for each `group` rows of df, are broadcast,
    and their rows stay where they are: those of a very common passage never meet in one task."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    often = F.broadcast(n.where(F.col("n") > group).select(*by))
    few = n.where((F.col("n") > 1) & (F.col("n") <= group)).select(*by)
    return df.join(often, by, "left_semi").select(df.columns).union(df.join(often, by, "left_anti").join(few, by).select(df.columns))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets), one row for each row of docs."""
    spark = docs.sparkSession
    keep: list[str] = []
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    raw = raw.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"))
    slim = raw.select("doc_id", "n_bytes", "sha")
    texts = materialize(raw.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts", keep)

    found = materialize(texts.select("sha", "text").mapInArrow(_anchor_rows(length, gram), "sha binary, pos int, key bigint"), "anchors", keep)
    marks = shared_rows(found, ["key"], group).groupBy("sha").agg(F.collect_list(F.struct("pos", "key")).alias("marks"))
    marked = materialize(texts.select("sha", "text").join(marks, "sha"), "marked", keep)

    schema = "ctx binary, key bigint, left binary, right binary, sha binary, pos int"
    members = materialize(marked.mapInArrow(_context_rows(length, gram), schema), "contexts", keep)
    distinct = members.groupBy("ctx").agg(F.first("key").alias("key"), F.first("left").alias("left"), F.first("right").alias("right"), F.count("*").alias("n"))
    distinct = materialize(distinct, "distinct", keep)
    large = materialize(distinct.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > group).select("key"), "large", keep)

    def scanned(groups: DataFrame) -> DataFrame:
        ordered = groups.repartition("key").sortWithinPartitions("key", "right", F.octet_length("right"))
        return ordered.mapInArrow(_scan_groups(length), "ctx binary, l int, r int")

    cover = scanned(distinct.select("key", "ctx", "left", "right", "n").join(large, "key", "left_anti"))
    if not large.isEmpty():
        hot = materialize(distinct.join(large, "key", "left_semi"), "hot", keep)
        subs = materialize(hot.mapInArrow(_subtree_rows(length, gram), "ctx binary, range int, sub binary"), "subtrees", keep)
        sizes = materialize(subs.groupBy("sub").agg(F.count("*").alias("m")).where("m > 1"), "sizes", keep)
        members_of = hot.select("ctx", "left", "right", "n")
        few = subs.join(sizes.where(F.col("m") <= group), "sub", "left_semi").join(members_of, "ctx").withColumnRenamed("sub", "key")
        parts = scanned(few.select("key", "ctx", "left", "right", "n"))
        nodes = subs.join(sizes.where(F.col("m") > group), "sub", "left_semi").join(members_of, "ctx")
        nodes = materialize(nodes.select("ctx", "left", "right", "range").mapInArrow(_node_rows(length, gram), "h1 bigint, h2 bigint, l int, ctx binary"), "nodes", keep)
        hit = shared_rows(nodes, ["h1", "h2", "l"], group).select("ctx", "l", (F.lit(length) - F.col("l")).alias("r"))
        own = hot.where((F.col("n") > 1) & (F.octet_length("left") + F.octet_length("right") >= length)).select("ctx", F.octet_length("left").alias("l"), F.octet_length("right").alias("r"))
        cover = cover.union(parts.union(hit).union(own).groupBy("ctx").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    cover = materialize(cover, "covers", keep)
    gone = members.select("ctx", "sha", "pos").join(cover, "ctx").groupBy("sha").agg(F.collect_set(F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))).alias("marks"))
    cut = marked.select("sha", "text").join(gone, "sha").mapInArrow(_cut(length), "sha binary, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:int,b:int>>")
    whole = texts.where("copies > 1").select("sha", F.octet_length("text").alias("n"))
    whole = whole.select("sha", F.col("n").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("spans"))
    cut = materialize(cut.join(texts.where("copies > 1").select("sha"), "sha", "left_anti").union(whole), "cut")
    discard(spark, keep)
    out = slim.join(cut, "sha", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"), "spans",
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents")).drop("spans")

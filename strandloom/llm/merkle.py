"""A Merkle manifest of a dataset, by contiguous digest matrices.

Each row is a leaf, the hash of its fields. Within each group (a language, say) leaves stand in order; while a group has several
nodes, every FANOUT consecutive ones become one. The groups' subroots, in order, give the root in the same way. Digests are hex
text, and a node is the SHA-256 of its children's texts, one after the other.

A group's nodes are dealt out in aligned blocks of BLOCK = FANOUT ** LEVELS. A block is one matrix of 64-byte rows: reshaped by
FANOUT, each row of it is hashed, level by level. Blocks' roots are nodes of the next storey, until each group has one. The way
down goes by the same blocks: a node's siblings in every level are read off by index arithmetic and put before the path of its
block's root. So a task holds one block, whatever a group's share, and a storey has 4,096 times fewer nodes than the one below.

prove() returns each row with its leaf, the roots and its path: for each level the digests to the left and to the right of its
own. fold() recomputes a root from a leaf and a path with SQL functions alone; manifest() has a row for each group.

Defined cases: a null field is hashed as "-"; a null group is one of its own and stands first; null order keys stand first, and
rows of equal keys are ordered by their leaves; repeated rows are leaves of their own, alike in everything but their paths; very
long texts are hashed whole; a lone leaf is its group's subroot and a lone subroot is the root, without siblings; an empty table
gives an empty result; only the named fields are read, so other columns cannot clash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, ranked, read_table

FANOUT, LEVELS = 8, 4
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf_of(fields: dict[str, Column]) -> Column:
    """Hex SHA-256 of the fields in turn, each as its length in UTF-8, a colon and its value, or "-" if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*parts), 256)


# ---------------------------------------------------------------- one block


def matrix(digests: pa.Array) -> np.ndarray:
    """A row of 64 bytes for each hex digest."""
    if isinstance(digests, pa.ChunkedArray):
        digests = digests.combine_chunks()
    return np.frombuffer(digests.cast(pa.binary(64)).buffers()[1], np.uint8, 64 * len(digests), 64 * digests.offset).reshape(-1, 64)


def parents(m: np.ndarray, fanout: int) -> np.ndarray:
    full = len(m) // fanout
    runs = list(m[: full * fanout].reshape(full, fanout * 64)) + ([m[full * fanout :].reshape(-1)] if full * fanout < len(m) else [])
    return np.frombuffer("".join([sha256(r).hexdigest() for r in runs]).encode(), np.uint8).reshape(-1, 64)


def climb(m: np.ndarray, fanout: int, levels: int | None) -> list[np.ndarray]:
    """The matrices of all levels: so many above the lowest, or until one node is left."""
    out = [m]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append(parents(out[-1], fanout))
    return out


def sides(m: np.ndarray, fanout: int) -> tuple[pa.Array, pa.Array]:
    """For each node of a level, the digests to its left and to its right in its run, joined."""
    i = np.arange(len(m))
    first = i - i % fanout

    def joined(start: np.ndarray, end: np.ndarray) -> pa.Array:
        size = end - start
        upto = np.cumsum(size)
        at = np.repeat(start - (upto - size), size) + np.arange(int(size.sum()))
        offsets = np.concatenate(([0], upto * 64)).astype(np.int32)
        return pa.StringArray.from_buffers(len(m), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(m[at])))

    return joined(first, i), joined(i + 1, np.minimum(first + fanout, len(m)))


def _ordered(block: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's nodes in order, and their digests. A group that is all of one node takes it as it stood when it became one."""
    block = block.sort_by("_pos")
    one = block.num_rows == 1 and block.column("_pos")[0].as_py() == 0
    return block, matrix(block.column("alone" if one else "node"))


def _block_root(fanout: int, levels: int):
    def run(block: pa.Table) -> pa.Table:
        block, m = _ordered(block)
        all_ = climb(m, fanout, levels)
        alone = next(x for x in all_ if len(x) == 1)
        text = lambda x: x.tobytes().decode()
        at = block.column("_pos")[0].as_py() // fanout**levels
        return pa.table({"g": block.column("g")[:1], "_pos": pa.array([at], pa.int64()), "node": [text(all_[-1])], "alone": [text(alone)]})

    return run


def _block_paths(fanout: int, levels: int, own: list[str], passed: list[str]):
    """own: columns of the nodes; passed: columns of the block's root, which all of them get."""

    def run(block: pa.Table, root: pa.Table) -> pa.Table:
        block, m = _ordered(block)
        top = root.column("top")[0].as_py()
        all_ = climb(m, fanout, None if top else levels)[:-1]
        above = root.column("path").combine_chunks()[0].values
        lefts, rights = zip(*(sides(x, fanout) for x in all_)) if all_ else ((), ())
        n, i = len(m), np.arange(len(m))
        bases = np.cumsum([0, *(len(x) for x in all_)])
        at = np.stack([*(bases[k] + i // fanout**k for k in range(len(all_))), *(np.full(n, bases[-1] + k) for k in range(len(above)))], 1) if len(all_) + len(above) else np.zeros((n, 0), np.int64)
        taken = [pa.concat_arrays([*side, above.field(f).cast(pa.string())]).take(pa.array(at.reshape(-1))) for side, f in ((lefts, "left"), (rights, "right"))]
        path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * at.shape[1]), pa.StructArray.from_arrays(taken, ["left", "right"]))
        rest = {c: pa.array([root.column(c)[0].as_py()] * n, root.schema.field(c).type) for c in passed}
        return pa.table({**{c: block.column(c) for c in own}, "path": path, "top": pa.array([top and n == 1] * n), **rest})

    return run


# ---------------------------------------------------------------- all blocks


def _blocks(nodes: DataFrame, size: int):
    return nodes.withColumn("_block", F.floor(F.col("_pos") / size).cast("long"))


def storeys(nodes: DataFrame, fanout: int, levels: int, keep: list[str]) -> list[DataFrame]:
    """nodes (g, _pos, node, alone), then their blocks' roots, then those of these, until each g has one row, whose alone is its root."""
    out = [nodes]
    while len(out) < 2 or out[-1].where("_pos > 0").limit(1).count():
        up = _blocks(out[-1].select("g", "_pos", "node", "alone"), fanout**levels).groupBy("g", "_block").applyInArrow(_block_root(fanout, levels), "g string, _pos long, node string, alone string")
        out.append(materialize(up, "storey", keep))
    return out


def descend(levels_: list[DataFrame], tops: DataFrame, fanout: int, levels: int, keep: list[str]) -> DataFrame:
    """The lowest storey's rows with path and the passed columns. tops: g, _pos 0, path, top, and what is passed down.

    The result reads the lowest storey and the one above it, whose table is not put into keep."""
    passed = [c for c in tops.columns if c not in ("g", "_pos", "path", "top")]
    types = dict(tops.dtypes)
    for k in range(len(levels_) - 2, -1, -1):
        nodes = levels_[k]
        own = nodes.columns if k == 0 else ["g", "_pos"]
        of = dict(nodes.dtypes)
        schema = ", ".join([*(f"{c} {of[c]}" for c in own), f"path {PATH}", "top boolean", *(f"{c} {types[c]}" for c in passed)])
        tops = tops.withColumnRenamed("_pos", "_block")
        down = _blocks(nodes, fanout**levels).groupBy("g", "_block").cogroup(tops.groupBy("g", "_block")).applyInArrow(_block_paths(fanout, levels, own, passed), schema)
        tops = materialize(down, "paths", keep if k > 1 else None) if k else down
    return tops


def prove(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields=FIELDS, extra: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """order, leaf, subroot, root and path of each row of docs, and the extra columns, which are made of docs."""
    keep: list[str] = []
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).alias("_key"), leaf_of({c: F.col(c) for c in fields}).alias("node"), *[c.alias(n) for n, c in (extra or {}).items()]
    )
    leaves = ranked(rows, "g", ["_key", "node"], "leaves", []).withColumn("alone", F.col("node"))
    up = storeys(leaves, fanout, levels, keep)
    subroots = up[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("alone").alias("node"))
    over = storeys(ranked(subroots, "g", ["of"], "subroots", keep).withColumn("alone", F.col("node")), fanout, levels, keep)
    start = over[-1].select("g", "_pos", F.array().cast(PATH).alias("path"), F.lit(True).alias("top"), F.col("alone").alias("root"))
    groups = descend(over, start, fanout, levels, keep)
    tops = groups.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("_pos"), "path", F.lit(True).alias("top"), F.col("node").alias("subroot"), "root")
    tops = materialize(tops, "tops")
    out = descend(up, tops, fanout, levels, keep)
    discard(docs.sparkSession, keep)  # the result reads leaves and the paths of their blocks' roots only
    return out.select(F.col("_key").alias(order), F.col("node").alias("leaf"), "subroot", "root", "path", *(extra or {}))


def manifest(docs: DataFrame, **how) -> DataFrame:
    """group, rows, subroot and root of each group of docs."""
    group = how.get("group", "lang")
    return prove(docs, extra={"_of": F.col(group)}, **how).groupBy(F.col("_of").alias(group), "subroot", "root").agg(F.count("*").alias("rows"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = {c: F.col(c) for c in FIELDS} | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = prove(docs, extra={"tampered": F.when(chosen, leaf_of(tampered))})
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 goes bit by bit; nodes, sub and over climb from all leaves, f and h fold each row's leaf up to the root.
SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, text, concat(coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
    coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-')) AS head FROM documents),
c AS (SELECT rid, doc_id, coalesce('=' || lang, '') AS g, sha256(concat(head, coalesce(octet_length(encode(text)) || ':' || text, '-'))) AS leaf,
    sha256(concat(head, coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))) AS bad,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda a, b: list_reduce(range(8), lambda e, i: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END, xor(a, b)), 4294967295), 4294967295) AS crc FROM d),
leaves AS (SELECT rid, doc_id, g, leaf, CASE WHEN crc % 3 = 0 THEN bad ELSE leaf END AS used, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM c),
nodes AS (SELECT g, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL SELECT g, lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY g, lvl, pos // 8, n),
sub AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM nodes WHERE n = 1),
over_ AS (SELECT 0 AS lvl, pos, subroot AS node, count(*) OVER () AS n FROM sub
  UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM over_ WHERE n > 1 GROUP BY lvl, pos // 8, n),
s AS (SELECT g, lvl, pos, coalesce(string_agg(node, '') OVER (PARTITION BY g, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (PARTITION BY g, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE n > 1),
t AS (SELECT lvl, pos, coalesce(string_agg(node, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM over_ WHERE n > 1),
f AS (SELECT rid, g, 0 AS lvl, pos, used AS node, '' AS proof FROM leaves
  UNION ALL SELECT f.rid, f.g, f.lvl + 1, f.pos // 8, sha256(concat(s.l, f.node, s.r)), concat(f.proof, s.l, s.r) FROM f JOIN s ON f.g = s.g AND f.lvl = s.lvl AND f.pos = s.pos),
h AS (SELECT f.rid, 0 AS lvl, sub.pos, sub.subroot, f.node, f.proof FROM f JOIN nodes ON f.g = nodes.g AND f.lvl = nodes.lvl AND f.pos = nodes.pos AND nodes.n = 1 JOIN sub ON sub.g = f.g
  UNION ALL SELECT h.rid, h.lvl + 1, h.pos // 8, h.subroot, sha256(concat(t.l, h.node, t.r)), concat(h.proof, t.l, t.r) FROM h JOIN t ON h.lvl = t.lvl AND h.pos = t.pos)
SELECT doc_id, leaf, subroot, o.node AS root, sha256(proof) AS proof_sha256, h.node AS folded_root, h.node = o.node AS verified
FROM leaves JOIN h USING (rid) JOIN over_ o ON o.n = 1 AND o.lvl = h.lvl AND o.pos = h.pos
"""

"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors are compared within a label (and a dimension). Equal vectors form a class first, so copies cost one comparison. The
classes of a label are dealt to blocks by hash, and each pair of blocks is a tile: a group of bounded size whatever the
label's share. In a tile, unit vectors are rounded to int8 with a scale of their own; with x = s*q + e, the true cosine lies
within |e_x| * (1 + |e_y|) + |e_y| of s_x * s_y * <q_x, q_y>. Only pairs that can reach the threshold are computed again, in
double precision. A tile returns counts of links and the edges of a spanning forest, never its pairs.

Every pair of a label is compared, so the work grows with the square of a label's classes; it is spread over all tiles.

Defined cases: a vector that is null, empty, zero or holds null, NaN or infinite components, or whose label is null, links with
nothing and is its own component; vectors of other lengths never link; a null vec_id counts as a vector but never becomes an id
(a component of such ones has a null id); repeated rows are links of each other; an empty table gives an empty result; only
vec_id, embedding and label are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, read_table

THRESHOLD = 0.93
BLOCK = 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the exact lengths of what rounding took away."""
    scale = np.abs(unit).max(1) / 127
    scale[scale == 0] = 1
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-12


def candidates(qa, sa, ea, qb, sb, eb, threshold: float) -> np.ndarray:
    """Where the cosine can be at least threshold. Products of int8 values are exact in float32 up to 1,040 dimensions."""
    wide = np.float32 if qa.shape[1] <= 1040 else np.float64
    approx = (qa.astype(wide) @ qb.astype(wide).T).astype(np.float64) * sa[:, None] * sb[None, :]
    return np.argwhere(approx + ea[:, None] * (1 + eb[None, :]) + eb[None, :] >= threshold)


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """A spanning forest's edges of the graph with these pairs."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in pairs.tolist():
        a, b = find(x), find(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((x, y))
    return np.array(kept, np.int64).reshape(-1, 2)


def _tile(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        own = pdf["block"].to_numpy()
        x = np.array(pdf["embedding"].tolist(), np.float64)
        # lengths are taken of scaled vectors, so that squares neither overflow nor vanish
        x /= np.abs(x).max(1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        q, s, e = quantise(x)
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        n, m = pdf["id"].to_numpy(), pdf["n"].to_numpy()
        count = np.zeros(len(x), np.int64)
        edges = []
        for at in range(0, len(a), 512):
            r = a[at : at + 512]
            c = candidates(q[r], s[r], e[r], q[b], s[b], e[b], threshold)
            u, v = r[c[:, 0]], b[c[:, 1]]
            if i == j:
                ordered = u < v
                u, v = u[ordered], v[ordered]
            for k in range(0, len(u), 1 << 16):
                p, t = u[k : k + (1 << 16)], v[k : k + (1 << 16)]
                ok = np.einsum("ij,ij->i", x[p], x[t]) >= threshold
                p, t = p[ok], t[ok]
                np.add.at(count, p, m[t])
                np.add.at(count, t, m[p])
                edges.append(_forest(len(x), np.stack([p, t], 1)))
        forest = _forest(len(x), np.concatenate(edges)) if edges else np.zeros((0, 2), np.int64)
        hit = np.flatnonzero(count)
        return pd.DataFrame({"a": np.concatenate([n[hit], n[forest[:, 0]]]), "b": np.concatenate([n[hit], n[forest[:, 1]]]), "links": np.concatenate([count[hit], np.zeros(len(forest), np.int64)])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row for each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    keep: list[str] = []
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(F.col("label").isNotNull() & ~bad & ~zero, F.lit(False)))
    v = v.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # no negative zeros
    name = F.col("label").cast("string")  # its length comes first, so that no label and vector read as another label and vector
    v = v.withColumn("id", F.when(F.col("ok"), F.md5(F.concat_ws(":", F.length(name), name, F.size("embedding"), F.array_join(F.col("embedding").cast("array<string>"), ",")))))
    slim = materialize(v.select("vec_id", "id"), "vectors")
    classes = v.where("ok").groupBy("id").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")), "classes", keep)
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "embedding")
    tiles = materialize(dealt.groupBy("label", "dim", "i", "j").applyInPandas(_tile(threshold), "a string, b string, links bigint"), "tiles", keep)
    counts = tiles.where("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = materialize(connected_components(tiles.where("links = 0").select("a", "b"), keep), "roots", keep)
    of = classes.select("id", "rep", "n").join(roots, F.col("id") == F.col("node"), "left").select("id", "rep", "n", F.coalesce("root", "id").alias("root"))
    ids = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    done = of.join(ids, "root").join(counts, "id", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = materialize(done, "linked")
    discard(spark, keep)
    out = slim.where("id is not null").join(done, "id").select("vec_id", "n_links", "component_id")
    out = out.union(slim.where("id is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= CAST(0.93 AS DOUBLE)),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT c.a AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.a = c.component_id AS kept FROM c LEFT JOIN n ON c.a = n.a
"""

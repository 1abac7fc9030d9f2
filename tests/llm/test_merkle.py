"""The Merkle manifest against a plain one that holds all leaves in a list."""

import random
import zlib
from hashlib import sha256

import pytest

from strandloom.llm import common, merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string, _pos long"


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n, *_ = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(nodes, fanout):
    """The root, and for each node its (left, right) siblings by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % fanout
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
            at[k] = i // fanout
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in groups[g]], fanout) for g in names}
    root, over = tree([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, over):
        for r, own in zip(groups[g], trees[g][1]):
            out.append((r, leaf(r), trees[g][0], root, own + up))
    return out


def tampered(r):
    if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 or r[1] is None:
        return r
    return (r[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]), *r[2:])


def fold(node, path):
    for left, right in path:
        node = h(left + node + right)
    return node


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(rng.randrange(10**6), rng.choice(["Some Text", "plain", "ÄÖ Ünder", ""]) * rng.randint(0, 4), rng.choice(["en", "en", "en", "de", "é", "z"]), "s", i, "x", "y", 7) for i in range(700)]
    out += [(5, "same", "en", None, 1, None, None, None)] * 90 + [(None, None, None, None, None, None, None, None), (None, "A", None, "s", 3, "x", "y", 7), (8, "Lone", "only", "s", 3, "x", "y", 7), (9, "Long " * 200_000, "de", "s", 3, "x", "y", 7)]
    out += [(i, "T", f"l{i}", "s", 1, "x", "y", 7) for i in range(70)]
    return out


@pytest.mark.parametrize("fanout,levels", [(8, 4), (8, 1), (3, 2)])
def test_proofs_equal_a_plain_tree(spark, rows, fanout, levels):
    got = merkle.prove(spark.createDataFrame(rows, COLUMNS).repartition(5), extra={"n_chars": merkle.F.col("n_chars")}, fanout=fanout, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "path", "n_chars"]
    got = [(r["doc_id"], r["n_chars"], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in got.collect()]
    want = [(r[0], r[4], *x) for r, *x in brute(rows, fanout)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_query_digests_and_tampering(spark, rows, tmp_path):
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    want = []
    for r, own, sub, root, path in brute(rows, 8):
        folded = fold(leaf(tampered(r)), path)
        want.append((r[0], own, sub, root, h("".join(x + y for x, y in path)), folded, folded == root))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {x[-1] for x in got} == {True, False}


def test_manifest_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r["lang"], r["subroot"], r["root"], r["rows"]) for r in merkle.manifest(df).collect()}
    plain = brute(rows, 8)
    assert got == {(r[2], sub, root, sum(x[2] == r[2] for x in rows)) for r, _, sub, root, _ in plain}
    assert merkle.prove(df.limit(0)).count() == 0 and merkle.manifest(df.limit(0)).count() == 0


def test_places_in_order(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.7 else f"g{rng.randint(0, 50)}", rng.randint(0, 9), i) for i in range(3000)] + [("hot", None, 1)] * 2000
    df = spark.createDataFrame(rows, "g string, k int, v long").repartition(6)
    got = common.ranked(df, "g", ["k", "v"], "places", [])
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["_pos"], r["k"], r["v"]))
    assert sum(map(len, by.values())) == len(rows)
    for g, got in by.items():
        want = sorted(((k, v) for x, k, v in rows if x == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert [x[1:] for x in sorted(got, key=lambda x: x[0])] == want and sorted(x[0] for x in got) == list(range(len(want)))

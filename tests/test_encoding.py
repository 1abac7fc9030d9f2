"""Encoders over tables with a small NumPy model: pooling, batches by length, failures set aside, the store's order and manifest."""

import numpy as np
import pytest

from strandloom.operators import encoding, kmer
from strandloom.sources import store

TABLE = np.random.default_rng(1).normal(size=(5, 6))


class Tiny:
    """A token for each base; hidden states are running means, so that a state tells what stands before it."""

    loads = 0

    def __init__(self):
        Tiny.loads += 1

    def tokenize(self, sequences):
        return [["ACGTN".index(b) for b in s] for s in sequences]

    def forward(self, ids, mask):
        if (ids == 4).any():
            raise RuntimeError("N is not known")
        return np.cumsum(TABLE[ids], 1) / np.arange(1, ids.shape[1] + 1)[None, :, None]


def states(s):
    x = TABLE[["ACGT".index(b) for b in s]]
    return np.cumsum(x, 0) / np.arange(1, len(x) + 1)[:, None]


@pytest.mark.parametrize("pooling,want", [("mean", lambda h: h.mean(0)), ("max", lambda h: h.max(0)), ("last", lambda h: h[-1])])
def test_pooling_ignores_padding(pooling, want):
    e = encoding.PooledEncoder("tiny", 6, Tiny, pooling)
    seqs = ["ACGT", "A", "GGTTAACC", ""]
    got = e.encode_batch(seqs)
    assert np.allclose(got[:3], [want(states(s)) for s in seqs[:3]]) and (got[3] == 0).all()
    assert np.allclose(np.linalg.norm(encoding.PooledEncoder("tiny", 6, Tiny, pooling, True).encode_batch(seqs[:3]), axis=1), 1)


def test_models_load_once_and_limits_hold():
    encoding._LOADED.clear()
    before = Tiny.loads
    e = encoding.PooledEncoder("once", 6, Tiny, max_tokens=5)
    for s in (["AC"], ["GT", "A"]):
        e.encode_batch(s)
    assert Tiny.loads == before + 1 and e.lengths(["ACG", ""]) == [3, 0]
    with pytest.raises(ValueError, match="6 tokens"):
        e.encode_batch(["ACGTAC"])
    with pytest.raises(ValueError, match="pooling"):
        encoding.PooledEncoder("bad", 6, Tiny, "sum").encode_batch(["A"])


@pytest.fixture
def subset(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i:03d}", "".join(rng.choice(list("ACGT"), rng.integers(1, 40))), 199 - i) for i in range(200)]
    rows[17] = ("s017", "ACNT", 182)
    rows += [("s200", None, 500)]
    return spark.createDataFrame(rows, "seq_id string, sequence string, row_pos long").coalesce(1)


def test_a_failing_batch_loses_only_itself(spark, subset, tmp_path):
    e = encoding.PooledEncoder("tiny", 6, Tiny)
    s = store.EmbeddingStore(spark, str(tmp_path / "v"), 6)
    got = store.extract(subset, e, s, batch_size=16)
    assert (got["failed_batches"], got["failed"], got["rows"]) == (1, 16, 185) and got["tokens"] > 1000 and got["longest"] <= 39
    bad = s.failures().collect()
    assert len(bad) == 1 and bad[0]["batch_rows"] == 16 and "N is not known" in bad[0]["error"]
    assert s.manifest() == got
    seqs = {r["seq_id"]: r["sequence"] or "" for r in subset.collect()}
    for r in s.committed().collect():
        want = states(seqs[r["sequence_id"]]).mean(0) if seqs[r["sequence_id"]] else np.zeros(6)
        assert np.allclose(r["embedding"], want, atol=1e-6)
    mended = subset.withColumn("sequence", encoding.F.regexp_replace("sequence", "N", "A"))
    again = store.extract(mended, e, s, batch_size=16)
    assert again["written"] == 16 and again["rows"] == 201 and again["failed"] == 0 and len(s.failures().collect()) == 1
    first = store.load(spark, s.path, limit=3).collect()
    assert {r["sequence_id"] for r in first} == {"s199", "s198", "s197"}


def test_another_width_starts_anew_and_bad_shapes_are_failures(spark, subset, tmp_path):
    s = store.EmbeddingStore(spark, str(tmp_path / "v"), 10)
    assert store.extract(subset, kmer.KmerEncoder(2), s)["rows"] == 201
    wide = kmer.KmerEncoder(2, include_gc=True)
    got = store.extract(subset, wide, store.EmbeddingStore(spark, s.path, wide.dim))
    assert got["restarted"] and got["dim"] == 11 and got["rows"] == 201

    class Odd:
        name, dim = "odd", 3

        def encode_batch(self, sequences):
            return np.full((len(sequences), 3 if len(sequences) == 50 else 2), np.nan if "s" in sequences else 1.0)

    out = encoding.run_encoder(subset, Odd(), 50).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in out} == {"vector": 200, "failed": 1}
    with pytest.raises(ValueError, match="one id"):
        store.extract(subset.union(subset), kmer.KmerEncoder(3), store.EmbeddingStore(spark, str(tmp_path / "w"), 32))

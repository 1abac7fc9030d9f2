"""Running an encoder over a table: models are loaded once a worker, sequences go in batches of like length, and a batch that fails
is set aside instead of ending the job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kmer import Encoder


class Model(Protocol):
    """What a loader returns: token ids of sequences, and hidden states (rows x tokens x dim) of padded ids; mask is 1 at tokens."""

    def tokenize(self, sequences: list[str]) -> list[list[int]]: ...

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


_LOADED: dict = {}


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """One vector a row: the mean or the greatest of its tokens' states, or the last token's. A row without tokens is zero."""
    n = mask.sum(1).astype(int)
    if how == "mean":
        out = (hidden * mask[:, :, None]).sum(1) / np.maximum(n, 1)[:, None]
    elif how == "max":
        out = np.where(mask[:, :, None] > 0, hidden, -np.inf).max(1) if hidden.shape[1] else np.zeros((len(hidden), hidden.shape[2]))
    elif how == "last":
        out = hidden[np.arange(len(hidden)), np.maximum(n - 1, 0)] if hidden.shape[1] else np.zeros((len(hidden), hidden.shape[2]))
    else:
        raise ValueError(f"pooling is mean, max or last, not {how!r}")
    return np.where(n[:, None] > 0, out, 0.0)


@dataclass(frozen=True)
class PooledEncoder:
    """An encoder of hidden states. load runs on the workers, once in each of them for all batches that it gets."""

    name: str
    dim: int
    load: Callable[[], Model]
    pooling: str = "mean"
    normalize: bool = False
    max_tokens: int = 1024

    def model(self) -> Model:
        key = (self.name, self.load)
        if key not in _LOADED:
            _LOADED[key] = self.load()
        return _LOADED[key]

    def lengths(self, sequences: list[str]) -> list[int]:
        return [len(x) for x in self.model().tokenize(sequences)]

    def encode_batch(self, sequences: list[str]) -> np.ndarray:
        ids = self.model().tokenize(sequences)
        longest = max(map(len, ids), default=0)
        if longest > self.max_tokens:
            raise ValueError(f"{longest} tokens, the encoder takes {self.max_tokens}")
        padded, mask = np.zeros((len(ids), longest), np.int64), np.zeros((len(ids), longest))
        for i, x in enumerate(ids):
            padded[i, : len(x)], mask[i, : len(x)] = x, 1
        out = pooled(np.asarray(self.model().forward(padded, mask), float), mask, self.pooling)
        if self.normalize:
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = out / np.where(norm == 0, 1, norm)
        return out


#: What became of a batch: its vectors, with the tokens that went in, or the error, with the batch's first id and size.
OUTCOME = "outcome string, sequence_id string, row_pos long, embedding array<float>, tokens long, batch_rows long, error string"


def _checked(encoder: Encoder, sequences: list[str]) -> np.ndarray:
    v = np.asarray(encoder.encode_batch(sequences), np.float32)
    if v.shape != (len(sequences), encoder.dim):
        raise ValueError(f"the encoder gave {v.shape}, not {(len(sequences), encoder.dim)}")
    if not np.isfinite(v).all():
        raise ValueError(f"{int((~np.isfinite(v).all(1)).sum())} vectors are not finite")
    return v


def run_encoder(subset: DataFrame, encoder: Encoder, batch_size: int = 64) -> DataFrame:
    """OUTCOME for the rows of subset (seq_id, sequence, and row_pos if there is one): a row a vector, and a row a failed batch.

    Within an Arrow batch sequences are ordered by their length in tokens (in bases, if the encoder has none), so that little is
    padded. A null sequence is empty."""
    x = subset.select(F.col("seq_id").cast("string").alias("id"), F.coalesce("sequence", F.lit("")).alias("sequence"), (F.col("row_pos") if "row_pos" in subset.columns else F.lit(None)).cast("long").alias("row_pos"))
    names = [c.split()[0] for c in OUTCOME.split(", ")]

    def run(batches):
        for batch in batches:
            ids, seqs, place = (batch.column(c).to_pylist() for c in ("id", "sequence", "row_pos"))
            rows = []
            try:
                size = encoder.lengths(seqs) if hasattr(encoder, "lengths") else None
            except Exception as e:  # whatever a tokenizer throws; its batches may still pass
                size = None
                rows.append(("warning", ids[0] if ids else None, None, None, None, len(ids), f"lengths: {type(e).__name__}: {e}"))
            order = np.argsort(size if size is not None else [len(s) for s in seqs], kind="stable").tolist()
            for at in range(0, len(order), batch_size):
                own = order[at : at + batch_size]
                try:
                    v = _checked(encoder, [seqs[i] for i in own])
                    rows += [("vector", ids[i], place[i], x, size[i] if size is not None else None, None, None) for i, x in zip(own, v)]
                except Exception as e:  # whatever a model throws is recorded with its batch
                    rows.append(("failed", ids[own[0]], place[own[0]], None, None, len(own), f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.float32()), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    return x.mapInArrow(run, OUTCOME)

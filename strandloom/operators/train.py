"""Probes and distillation on frozen vectors, trained data-parallel.

An epoch is a pass over the rows: every task adds up the gradients of its rows for all models at once (a sweep's grid points, a
teacher and its students), the sums meet in a tree of small tasks, and the driver takes one AdamW step for each model. What
moves is as large as the models, whatever the number of rows, and no task holds more than a batch of them. Dropout and
mini-batches are drawn by hash of row and epoch, so a run does not depend on how rows are dealt out.

An epoch has `batches` mini-batches, each a pass; one, unless more are asked for. lr and batch_size are those of training by many
small steps. A step here stands for as many of them as fit into its rows, so lr grows in proportion, WIDEST times at most."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators.vectors import standardize

FAN = 32  # partial sums that meet in one task
WIDEST = 16
ROWS = 1024  # of a batch that are taken at once, so that what they read stays in the cache

# ---------------------------------------------------------------- models


@dataclass(frozen=True)
class Head:
    """A linear classifier, or one hidden layer with dropout; with parents, a second head on what the first one reads."""

    dim: int
    classes: int
    hidden: int = 0
    parents: int = 0
    dropout: float = 0.2

    def shapes(self) -> list[tuple[int, ...]]:
        layers = [(self.dim, self.hidden), (self.hidden, self.classes)] if self.hidden else [(self.dim, self.classes)]
        layers += [(layers[-1][0], self.parents)] if self.parents else []
        return [s for a, b in layers for s in ((a, b), (b,))]

    def start(self, seed: int) -> np.ndarray:
        """All parameters in one vector; weights and biases uniform within 1 / sqrt(inputs). Equal heads start equal, with or without parents."""
        rng, out, width = np.random.default_rng(seed), [], 1
        for s in self.shapes():
            width = s[0] if len(s) == 2 else width
            out.append(rng.uniform(-1, 1, s).ravel() / math.sqrt(width))
        return np.concatenate(out)

    def split(self, params: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shapes():
            out.append(params[at : at + math.prod(s)].reshape(s))
            at += math.prod(s)
        return out

    def parameter_counts(self) -> dict[str, int]:
        return {"trainable": sum(math.prod(s) for s in self.shapes()), "backbone": 0}

    def read(self, params: np.ndarray, x: np.ndarray) -> np.ndarray:
        """What the last layer reads, before dropout."""
        w = self.split(params)
        return np.maximum(x @ w[0] + w[1], 0) if self.hidden else x

    def logits(self, params: np.ndarray, x: np.ndarray, read: np.ndarray | None = None) -> np.ndarray:
        w, k = self.split(params), 2 if self.hidden else 0
        return (self.read(params, x) if read is None else read) @ w[k] + w[k + 1]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cross_entropy(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return np.log(np.exp(z - top[:, None]).sum(1)) + top - z[np.arange(len(z)), y]


def gradient(head: Head, params: np.ndarray, x, y, mask=None, soft=None, alpha: float = 0.0, temperature: float = 1.0, parents=None, weight: float = 0.0, read=None) -> tuple[float, np.ndarray]:
    """Loss and gradient, summed over rows: (1 - alpha) * cross entropy + alpha * T^2 * KL(teacher || student), where soft has a
    teacher's logits, + weight * cross entropy of the parents. read: what Head.read() gives for x, if known."""
    w, rows = head.split(params), np.arange(len(x))
    h, on = x, None
    if head.hidden:
        h = head.read(params, x) if read is None else read
        on = h > 0 if mask is None else (h > 0) * mask
        h = h if mask is None else h * mask
    k = 2 if head.hidden else 0
    z = h @ w[k] + w[k + 1]
    hard = 1.0 if soft is None else 1 - alpha
    loss = hard * cross_entropy(z, y).sum()
    g = softmax(z)
    g[rows, y] -= 1
    g *= hard
    if soft is not None and alpha:
        p, q = softmax(soft / temperature), softmax(z / temperature)
        loss += alpha * temperature**2 * (p * (np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(q, 1e-300)))).sum()
        g += alpha * temperature * (q - p)
    own = [h.T @ g, g.sum(0)]
    back = g @ w[k].T
    if head.parents:
        zp = h @ w[k + 2] + w[k + 3]
        loss += weight * cross_entropy(zp, parents).sum()
        gp = softmax(zp)
        gp[rows, parents] -= 1
        gp *= weight
        own += [h.T @ gp, gp.sum(0)]
        back = back + gp @ w[k + 2].T
    back = back * on if head.hidden else back
    first = [x.T @ back, back.sum(0)] if head.hidden else []
    return float(loss), np.concatenate([a.ravel() for a in (*first, *own)])


def dropped(ids: np.ndarray, head: Head, epoch: int, seed: int) -> np.ndarray | None:
    """The dropout mask of rows with these ids, drawn by hash (splitmix64's finalizer, with its fixed values)."""
    if not head.hidden or not head.dropout:
        return None
    z = ids.astype(np.uint64)[:, None] + np.arange(1, head.hidden + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + epoch) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)) * 2.0**-53 >= head.dropout) / (1 - head.dropout)


@dataclass
class AdamW:
    lr: float = 1e-3
    decay: float = 1e-4
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    t: int = 0

    def step(self, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.m, self.v = (np.zeros_like(params), np.zeros_like(params)) if self.m is None else (self.m, self.v)
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad * grad
        return params * (1 - self.lr * self.decay) - self.lr * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


# ---------------------------------------------------------------- training


@dataclass
class Model:
    """A head in training. reads names the column of its vectors; a student names its teacher among the models before it."""

    name: str
    head: Head
    reads: str
    seed: int
    teacher: int | None = None
    alpha: float = 0.0
    temperature: float = 1.0
    weight: float = 0.0
    params: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    c = batch.column(name)
    return np.asarray(c.flatten(), float).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


_SUMS = "model int, n long, loss double, correct long, n_val long, loss_val double, correct_val long, grad binary"


def _rows_of(sums: list[list]) -> pa.RecordBatch:
    cols = list(zip(*([*r[:-1], r[-1].tobytes()] for r in sums)))  # gradients as bytes: they are only added up
    types = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [x.split()[0] for x in _SUMS.split(", ")])


def _take(models: list[Model], sums: list[list], name: str, epoch: int, at: np.ndarray, ids: np.ndarray, y: np.ndarray, parents: np.ndarray, x: dict[str, np.ndarray]) -> None:
    """Adds the rows at to the sums of all models. Teachers' logits and dropout masks are made once, however many models use them."""
    own, masks, taught = {c: v[at] for c, v in x.items()}, {}, {}
    teachers = {m.teacher for m in models}
    for i, m in enumerate(models):
        v, s, k = own[m.reads], sums[i], 1 if name == "train" else 4
        read = m.head.read(m.params, v)
        z = m.head.logits(m.params, v, read)
        if i in teachers:
            taught[i] = z  # a teacher stands before its students
        s[k], s[k + 1], s[k + 2] = s[k] + len(at), s[k + 1] + float(cross_entropy(z, y[at]).sum()), s[k + 2] + int((z.argmax(1) == y[at]).sum())
        if name == "train":
            drawn = (m.head.hidden, m.head.dropout, m.seed)
            if drawn not in masks:
                masks[drawn] = dropped(ids[at], m.head, epoch, m.seed)
            soft = taught[m.teacher] if m.teacher is not None else None
            s[7] += gradient(m.head, m.params, v, y[at], masks[drawn], soft, m.alpha, m.temperature, parents[at], m.weight, read)[1]


def _pass(shared, epoch: int, batch: int, batches: int):
    def run(parts):
        models: list[Model] = shared.value
        sums = [[i, 0, 0.0, 0, 0, 0.0, 0, np.zeros(len(m.params))] for i, m in enumerate(models)]
        for part in parts:
            ids, y, split = part.column("_id").to_numpy().view(np.uint64), part.column("_y").to_numpy(), np.array(part.column("split").to_pylist())
            parents = part.column("_p").to_numpy()
            x = {c: _vectors(part, c) for c in {m.reads for m in models}}
            turn = (ids // np.uint64(7) + np.uint64(epoch * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(17)
            for name, on in (("train", (split == "train") & (turn % np.uint64(batches) == batch)), ("val", (split == "val") & (batch == 0))):
                at = np.flatnonzero(on)
                if not len(at):
                    continue
                for lo in range(0, len(at), ROWS):
                    _take(models, sums, name, epoch, at[lo : lo + ROWS], ids, y, parents, x)
        yield _rows_of(sums)

    return run


def _added(rows) -> list[list]:
    """Sums by model of rows as in _SUMS."""
    total: dict[int, list] = {}
    for model, *counts, grad in rows:
        own = [*counts, np.frombuffer(grad)]
        total[model] = [a + b for a, b in zip(total[model], own)] if model in total else own
    return [[m, *x] for m, x in total.items()]


def _add(parts):
    found = _added(r.values() for part in parts for r in part.to_pylist())
    if found:
        yield _rows_of(found)


def gathered(sums: DataFrame, parts: int) -> list[list]:
    """One row a model: partial sums of FAN tasks meet in one task, those in turn, until one is left for the driver."""
    while parts > 1:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts, F.spark_partition_id() % parts).mapInArrow(_add, _SUMS)
    return _added(sums.collect())


def descend(rows: DataFrame, models: list[Model], epochs: int, lr: float = 1e-3, decay: float = 1e-4, batches: int = 1) -> list[Model]:
    """Trains all models, in place. rows: _id, _y, _p, split and the models' vectors; better persisted or written by the caller."""
    sc, parts = rows.sparkSession.sparkContext, rows.rdd.getNumPartitions()
    optimisers = [AdamW(lr, decay) for _ in models]
    for m in models:
        m.params = m.head.start(m.seed)
    for epoch in range(epochs):
        for b in range(batches):
            shared = sc.broadcast([Model(m.name, m.head, m.reads, m.seed, m.teacher, m.alpha, m.temperature, m.weight, m.params) for m in models])
            for i, n, loss, correct, n_val, loss_val, correct_val, grad in gathered(rows.mapInArrow(_pass(shared, epoch, b, batches), _SUMS), parts):
                if n:
                    models[i].params = optimisers[i].step(models[i].params, grad / n)
                if b == 0:
                    share = lambda x, k: x / k if k else None
                    models[i].history.append({"epoch": epoch, "train_loss": share(loss, n), "train_accuracy": share(correct, n), "val_loss": share(loss_val, n_val), "val_accuracy": share(correct_val, n_val)})
            shared.destroy()
    return models


def _numbered(label: str | Column, names: list) -> Column:
    return (F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label) if isinstance(label, str) else label) - 1).cast("int")


def prepared(df: DataFrame, key: str, columns: dict[str, str], parent: str | None = None) -> tuple[DataFrame, list, list]:
    """(rows for descend(), classes, parents). columns: the name that models read -> the column of df; by the training rows' moments."""
    names, above = (sorted(r[0] for r in df.select(c).distinct().collect()) if c else [] for c in ("label", parent))  # as many as there are classes
    x = df.select(key, "label", "split", F.xxhash64(F.col(key)).alias("_id"), _numbered("label", names).alias("_y"), (_numbered(parent, above) if parent else F.lit(0)).alias("_p"), *[S.as_double(F.col(c)).alias(n) for n, c in columns.items()])
    for n in columns:
        x = standardize(x, n, fit_on=x.where("split = 'train'"))
    return x, names, above


def predictions(rows: DataFrame, key: str, models: list[Model], names: list) -> DataFrame:
    """model, key, truth, predicted, confidence of the test rows; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast([(m.head, m.params, m.reads) for m in models])
    kind, label = dict(rows.dtypes)[key], dict(rows.dtypes)["label"]

    def run(parts):
        for part in parts:
            for i, (head, params, reads) in enumerate(shared.value):
                if part.num_rows:
                    p = softmax(head.logits(params, _vectors(part, reads)))
                    best = pa.array(names, part.schema.field("label").type).take(pa.array(p.argmax(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), i, np.int32)), part.column(key), part.column("label"), best, pa.array(p.max(1))], ["model", key, "truth", "predicted", "confidence"])

    return rows.where("split = 'test'").mapInArrow(run, f"model int, {key} {kind}, truth {label}, predicted {label}, confidence double")


def _trained(rows: DataFrame, models: list[Model], epochs: int, lr: float, decay: float, batch_size: int, batches: int) -> list[Model]:
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)  # lost blocks are computed again
    try:
        n = held.where("split = 'train'").count() / batches
        return descend(held, models, epochs, lr * min(WIDEST, max(1.0, n / batch_size)), decay, batches)
    finally:
        held.unpersist()


def probes(df: DataFrame, key: str, column: str = "embedding", hidden: tuple[int, ...] = (0,), epochs: int = 60, seed: int = 42, lr: float = 1e-3, decay: float = 1e-4, batch_size: int = 256, batches: int = 1) -> tuple[DataFrame, list[Model]]:
    """(hidden, key, truth, predicted, confidence of the test rows; the models) of df (key, column, label, split), one model for
    each entry of hidden, all in the same passes."""
    rows, names, _ = prepared(df, key, {"_x": column})
    dim = df.select(F.size(column)).first()[0]
    models = _trained(rows, [Model(f"hidden {h}", Head(dim, len(names), h), "_x", seed) for h in hidden], epochs, lr, decay, batch_size, batches)
    widths = F.array(*[F.lit(h) for h in hidden])
    out = predictions(rows, key, models, names)
    return out.select(F.get(widths, F.col("model")).alias("hidden"), key, "truth", "predicted", "confidence"), models


def train_probe(df: DataFrame, key: str, column: str = "embedding", **how) -> DataFrame:
    return probes(df, key, column, **how)[0]


def student_features(df: DataFrame, kmers, include_abundance: bool = True) -> DataFrame:
    """df (with count) and student: k-mer frequencies, and with them the log10 of the reads plus one."""
    x = S.as_double(kmers)
    return df.withColumn("student", F.concat(x, F.array(F.log10(F.col("count") + 1))) if include_abundance else x)


def distillation(
    df: DataFrame, key: str, teacher: str, student: str, grid: tuple[tuple[float, float], ...] = ((0.4, 4.0),), epochs: int = 60, seed: int = 42, hidden: int = 256, teacher_head: str = "mlp", parent: str | None = None,
    hierarchical_weight: float = 0.0, lr: float = 1e-3, decay: float = 1e-4, batch_size: int = 256, batches: int = 1,
) -> tuple[DataFrame, list[Model]]:
    """(branch, alpha, temperature, key, truth, predicted, confidence of the test rows; the models).

    The teacher learns from labels and teaches as it learns; alone is the student without it, from the same start and with the
    same dropout; a taught student for each (alpha, temperature) of grid, with a head for the parent rank if it has a weight. The
    teacher's head is the student's, so that they differ in what they read, or linear. All learn in the same passes."""
    if teacher_head not in ("mlp", "linear"):
        raise ValueError("teacher_head must be mlp or linear")
    parent = parent if hierarchical_weight else None
    rows, names, above = prepared(df, key, {"_t": teacher, "_s": student}, parent)
    sizes = df.select(F.size(teacher), F.size(student)).first()
    head = Head(sizes[1], len(names), hidden)
    taught = Head(sizes[1], len(names), hidden, len(above))
    models = [Model("teacher", Head(sizes[0], len(names), hidden if teacher_head == "mlp" else 0), "_t", seed), Model("alone", head, "_s", seed)]
    models += [Model("taught", taught, "_s", seed, 0, float(a), float(t), hierarchical_weight if parent else 0.0) for a, t in grid]
    models = _trained(rows, models, epochs, lr, decay, batch_size, batches)
    about = F.array(*[F.struct(F.lit(m.name).alias("branch"), F.lit(m.alpha if m.teacher == 0 else None).cast("double").alias("alpha"), F.lit(m.temperature if m.teacher == 0 else None).cast("double").alias("temperature")) for m in models])
    out = predictions(rows, key, models, names).withColumn("_m", F.get(about, F.col("model")))
    return out.select("_m.branch", "_m.alpha", "_m.temperature", key, "truth", "predicted", "confidence"), models


def distil(df: DataFrame, key: str, teacher: str, student: str, grid: tuple[tuple[float, float], ...] = ((0.4, 4.0),), **how) -> DataFrame:
    """alpha, temperature, the test accuracies of teacher, taught and lone student, and the test rows that only one student gets right."""
    return distillation_summary(distillation(df, key, teacher, student, grid, **how)[0], key)


def distillation_summary(branches: DataFrame, key: str) -> DataFrame:
    right = (F.col("truth") == F.col("predicted")).alias("right")
    base = branches.where("branch != 'taught'").groupBy(F.col(key).alias("_k")).agg(*[F.max(F.when(F.col("branch") == b, right)).alias(b) for b in ("teacher", "alone")])
    x = branches.where("branch = 'taught'").select(key, "alpha", "temperature", right).join(base, F.col(key) == F.col("_k"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    only = lambda a, b: F.count(F.when(F.col(a) & ~F.col(b), 1))
    return x.groupBy("alpha", "temperature").agg(share("teacher").alias("teacher_accuracy"), share("right").alias("distilled_accuracy"), share("alone").alias("alone_accuracy"), only("right", "alone").alias("only_distilled"), only("alone", "right").alias("only_alone"), F.count("*").alias("n_test"))

"""Data-parallel training against the same steps in one process, gradients against finite differences."""

import numpy as np
import pytest

from strandloom.operators import sampling, train


def clusters(rng, n, dim, classes, noise):
    centre = rng.normal(size=(classes, dim)) * 3
    return [(i, (centre[i % classes] + noise * rng.normal(size=dim)).tolist(), f"c{i % classes}", f"p{i % classes // 2}") for i in range(n)]


@pytest.fixture(scope="module")
def split(spark):
    rows = clusters(np.random.default_rng(3), 400, 12, 4, 1.5)
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label string, parent string")
    return sampling.stratified_split(df, "label", df["id"]).cache()


@pytest.mark.parametrize("hidden,parents,soft,alpha,weight", [(0, 0, False, 0, 0), (7, 0, False, 0, 0), (7, 0, True, 0.4, 0), (7, 3, True, 0.4, 0.7), (0, 3, True, 1.0, 0.5)])
def test_gradient_equals_finite_differences(hidden, parents, soft, alpha, weight):
    rng = np.random.default_rng(hidden + parents)
    head = train.Head(5, 4, hidden, parents)
    params, x, y, p = head.start(1), rng.normal(size=(20, 5)), rng.integers(0, 4, 20), rng.integers(0, max(1, parents), 20)
    mask = train.dropped(np.arange(20), head, 3, 9)
    how = dict(mask=mask, soft=rng.normal(size=(20, 4)) * 3 if soft else None, alpha=alpha, temperature=2.5, parents=p, weight=weight)
    _, g = train.gradient(head, params, x, y, **how)
    for i in rng.choice(len(params), 24, replace=False):
        step = np.zeros_like(params)
        step[i] = 1e-6
        slope = (train.gradient(head, params + step, x, y, **how)[0] - train.gradient(head, params - step, x, y, **how)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_dropout_is_drawn_by_row_and_epoch():
    head = train.Head(5, 4, 300, dropout=0.2)
    a, b = train.dropped(np.arange(50), head, 1, 7), train.dropped(np.arange(49, -1, -1), head, 1, 7)
    assert (a == b[::-1]).all() and (a != train.dropped(np.arange(50), head, 2, 7)).any() and set(np.unique(a)) == {0.0, 1.25}
    assert 0.18 < (a == 0).mean() < 0.22 and train.dropped(np.arange(5), train.Head(5, 4), 1, 7) is None


def alone(rows, models, epochs, lr, decay):
    """The same training in one process, all rows at once."""
    ids = np.array([r["_id"] for r in rows]).view(np.uint64)
    y, p, on = np.array([r["_y"] for r in rows]), np.array([r["_p"] for r in rows]), np.array([r["split"] == "train" for r in rows])
    x = {c: np.array([r[c] for r in rows]) for c in {m.reads for m in models}}
    params, steps = [m.head.start(m.seed) for m in models], [train.AdamW(lr, decay) for _ in models]
    for e in range(epochs):
        soft = models[0].head.logits(params[0], x[models[0].reads][on])
        grads = [train.gradient(m.head, w, x[m.reads][on], y[on], train.dropped(ids[on], m.head, e, m.seed), soft if m.teacher == 0 else None, m.alpha, m.temperature, p[on], m.weight)[1] for m, w in zip(models, params)]
        params = [s.step(w, g / on.sum()) for s, w, g in zip(steps, params, grads)]
    return params


def test_training_equals_one_process_however_rows_are_dealt(spark, split, monkeypatch):
    monkeypatch.setattr(train, "FAN", 2)  # so that the sums meet in a tree
    rows, names, above = train.prepared(split, "id", {"_t": "embedding", "_s": "embedding"}, "parent")
    assert names == ["c0", "c1", "c2", "c3"] and above == ["p0", "p1"]
    made = lambda: [train.Model("teacher", train.Head(12, 4, 6), "_t", 5), train.Model("alone", train.Head(12, 4, 6), "_s", 5), train.Model("taught", train.Head(12, 4, 6, 2), "_s", 5, 0, 0.4, 4.0, 0.3)]
    want = alone(rows.collect(), made(), 6, 0.02, 1e-3)
    for parts in (1, 9):
        got = train.descend(rows.repartition(parts).cache(), made(), 6, 0.02, 1e-3)
        for m, w in zip(got, want):
            assert np.allclose(m.params, w, rtol=1e-8, atol=1e-10)
        assert got[0].history[-1]["train_loss"] < got[0].history[0]["train_loss"] and len(got[0].history) == 6 and got[1].history[0]["val_accuracy"] is not None


def test_mini_batches_cover_all_rows_once(spark, split):
    rows, names, _ = train.prepared(split, "id", {"_x": "embedding"})
    rows = rows.cache()
    model = train.Model("m", train.Head(12, 4), "_x", 1)
    model.params = model.head.start(1)
    shared = spark.sparkContext.broadcast([model])
    n = [sum(r["n"] for r in rows.mapInArrow(train._pass(shared, 2, b, 3), train._SUMS).collect()) for b in range(3)]
    assert sum(n) == rows.where("split = 'train'").count() and min(n) > 0
    p, _ = train.probes(split, "id", epochs=10, lr=0.02, batches=3)
    assert p.where("truth = predicted").count() > 0.9 * p.count()


def test_probes_beat_chance_and_history_is_kept(split):
    p, models = train.probes(split, "id", hidden=(0, 32), epochs=25, lr=0.01)
    for h in (0, 32):
        own = p.where(f"hidden = {h}")
        assert own.count() == split.where("split = 'test'").count() and own.where("truth = predicted").count() > 0.9 * own.count()
    assert [m.head.hidden for m in models] == [0, 32] and all(len(m.history) == 25 for m in models)


def test_lone_and_taught_students_start_alike(spark, split):
    df = split.selectExpr("*", "slice(embedding, 1, 3) AS student")
    out, models = train.distillation(df, "id", "embedding", "student", ((0.0, 1.0), (0.6, 2.0)), epochs=12, hidden=16, lr=0.02)
    teacher, lone, same, taught = models
    assert teacher.head.hidden == lone.head.hidden == taught.head.hidden == 16
    assert np.allclose(lone.params, same.params) and not np.allclose(lone.params, taught.params)
    rows = {(r["alpha"], r["temperature"]): r for r in train.distillation_summary(out, "id").collect()}
    assert set(rows) == {(0.0, 1.0), (0.6, 2.0)} and rows[0.0, 1.0]["distilled_accuracy"] == rows[0.0, 1.0]["alone_accuracy"]
    assert rows[0.0, 1.0]["only_distilled"] == rows[0.0, 1.0]["only_alone"] == 0 and rows[0.6, 2.0]["teacher_accuracy"] > 0.9
    test = df.where("split = 'test'").count()
    assert {r["branch"]: r["count"] for r in out.groupBy("branch").count().collect()} == {"teacher": test, "alone": test, "taught": 2 * test}
    by_parent, m2 = train.distillation(df, "id", "embedding", "student", ((0.6, 2.0),), epochs=4, hidden=16, parent="parent", hierarchical_weight=0.5)
    assert m2[2].head.parents == 2 and np.allclose(m2[2].head.start(m2[2].seed)[: len(m2[1].head.start(m2[1].seed))], m2[1].head.start(m2[1].seed))
    with pytest.raises(ValueError):
        train.distillation(df, "id", "embedding", "student", teacher_head="forest")


def test_masks_and_teachers_logits_are_made_once_for_all_models(monkeypatch):
    rng = np.random.default_rng(4)
    made = [train.Model("teacher", train.Head(5, 3, 8), "_t", 5)] + [train.Model("taught", train.Head(2, 3, 8), "_s", 5, 0, a, 2.0) for a in (0.2, 0.5, 0.8)]
    for m in made:
        m.params = m.head.start(m.seed)
    x, y, ids = {"_t": rng.normal(size=(40, 5)), "_s": rng.normal(size=(40, 2))}, rng.integers(0, 3, 40), np.arange(40).astype(np.uint64)
    drawn, reads, one, two = [], [], train.dropped, train.Head.read
    monkeypatch.setattr(train, "dropped", lambda *a: drawn.append(1) or one(*a))
    monkeypatch.setattr(train.Head, "read", lambda *a: reads.append(1) or two(*a))
    sums = [[i, 0, 0.0, 0, 0, 0.0, 0, np.zeros(len(m.params))] for i, m in enumerate(made)]
    train._take(made, sums, "train", 2, np.arange(40), ids, y, np.zeros(40, int), x)
    assert len(drawn) == 1 and len(reads) == 4
    soft, mask = made[0].head.logits(made[0].params, x["_t"]), one(ids, made[0].head, 2, 5)
    for m, s in zip(made, sums):
        assert np.allclose(s[7], train.gradient(m.head, m.params, x[m.reads], y, mask, soft if m.teacher == 0 else None, m.alpha, m.temperature)[1])

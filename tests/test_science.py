"""Formulas against closed forms and independent computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strandloom.operators import cluster, metrics, sampling, taxonomy, train, variants, vectors


def spectrum(spark, d):
    return spark.createDataFrame(list(d.items()), "k long, f long")


def test_diversity_by_hand(spark):
    r = variants.diversity(spectrum(spark, {5: 1, 3: 1, 1: 2})).first()
    p = np.array([5, 3, 1, 1]) / 10
    assert r["shannon_h"] == pytest.approx(-(p * np.log(p)).sum(), abs=1e-6) and r["simpson_d"] == pytest.approx((p**2).sum(), abs=1e-8)
    assert (r["reads"], r["observed_richness_variants"], r["singletons"]) == (10, 4, 2) and r["goods_coverage"] == pytest.approx(0.8)
    even = variants.diversity(spectrum(spark, {10: 5})).first()
    assert even["pielou_evenness_j"] == pytest.approx(1) and even["hill_q1_exp_shannon"] == pytest.approx(5)
    assert variants.diversity(spectrum(spark, {1: 1}).limit(0)).count() == 0


def test_chao1(spark):
    r = variants.chao1_interval(spectrum(spark, {1: 10, 2: 4, 7: 3})).first()
    t, v = 90 / 10, 90 / 10 + 10 * 19**2 / 100 + 100 * 4 * 81 / 2500
    c = math.exp(1.96 * math.sqrt(math.log1p(v / t**2)))
    assert r["chao1"] == pytest.approx(17 + t) and r["chao1_variance"] == pytest.approx(v) and r["chao1_ci95_lower"] == pytest.approx(17 + t / c, abs=0.01) and r["chao1_ci95_upper"] == pytest.approx(17 + t * c, abs=0.01)
    flat = variants.chao1_interval(spectrum(spark, {2: 3, 5: 2})).first()
    assert flat["chao1"] == flat["chao1_ci95_lower"] == flat["chao1_ci95_upper"] == 5


def test_rarefaction_against_draws(spark):
    counts = [40, 25, 15, 10, 5, 3, 1, 1]
    curve = {r["depth"]: r["expected_richness"] for r in variants.rarefaction(spectrum(spark, Counter(counts)), 10).collect()}
    assert curve[100] == 8
    pool = [i for i, c in enumerate(counts) for _ in range(c)]
    rng = random.Random(0)
    for m in (10, 50):
        assert curve[m] == pytest.approx(np.mean([len(set(rng.sample(pool, m))) for _ in range(2000)]), abs=0.15)


def test_rank_abundance_is_exact(spark):
    counts = [100, 50, 50, 20, 5, 5, 5, 1, 1, 1, 1]
    s = spectrum(spark, Counter(counts))
    got = variants.rank_abundance(s).orderBy("rank").collect()
    assert [r["abundance"] for r in got] == counts
    cum = np.cumsum(counts) / sum(counts)
    assert [r["cumulative_read_fraction"] for r in got] == pytest.approx(cum.tolist(), abs=1e-8)
    t = variants.coverage_thresholds(s).first()
    for x in (50, 90, 99):
        assert t[f"variants_for_{x}pct_reads"] == int(np.searchsorted(cum, x / 100)) + 1
    assert t["top10_read_share"] == pytest.approx(cum[9], abs=1e-6) and t["top1000_read_share"] == 1
    thin = variants.rank_abundance(s, 4).collect()
    assert {r["rank"] for r in thin} <= set(range(1, 12)) and len(thin) <= 4


def pairs(spark, left, right, ends=None):
    rows = [(i, a.tolist(), b.tolist(), int(ends[i]) if ends is not None else 0) for i, (a, b) in enumerate(zip(left, right))]
    return spark.createDataFrame(rows, "pair_id long, left_vec array<double>, right_vec array<double>, right_end int")


def test_retrieval_finds_mates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 12))
    same = vectors.retrieval_summary(vectors.retrieval(pairs(spark, x, x), 20), 20).first()
    assert same["top1_accuracy"] == 1 and same["mean_reciprocal_rank"] == 1 and same["lift_over_chance"] == 21
    noise = vectors.retrieval_summary(vectors.retrieval(pairs(spark, x, rng.normal(size=x.shape), np.arange(120) % 2), 20), 20).first()
    assert noise["top1_accuracy"] < 0.2 and noise["n_queries"] == 120
    assert vectors.retrieval(pairs(spark, x, x, np.arange(120)), 20).count() == 0


def test_auroc_with_ties(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 20, 300), rng.integers(0, 2, 300)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    got = vectors.auroc(spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "score long, positive int")).first()["auroc"]
    assert got == pytest.approx(want, abs=1e-6)


def test_mcnemar(spark):
    a = spark.createDataFrame([(i, i < 30) for i in range(50)], "q long, hit boolean")
    b = spark.createDataFrame([(i, 10 <= i < 35) for i in range(50)], "q long, hit boolean")
    r = vectors.mcnemar(a, b, "q", "hit")
    p = 2 * sum(math.comb(15, k) for k in range(10, 16)) / 2**15
    assert (r["only_a"], r["only_b"]) == (10, 5) and r["p_value"] == pytest.approx(p) and r["verdict"] == "not significant"
    assert vectors.mcnemar(a, a, "q", "hit")["verdict"] == "no discordant queries"
    with pytest.raises(ValueError):
        vectors.mcnemar(a, b.where("q < 40"), "q", "hit")


def test_health_and_standardising(spark):
    x = spark.createDataFrame([(i, [float(i), 5.0, float("nan") if i == 3 else 1.0 * (i % 2)]) for i in range(10)], "id long, embedding array<double>")
    h = vectors.health(x).first()
    assert not h["finite"] and h["n_nan"] == 1 and h["dead_dims"] == 1 and h["dim"] == 3
    clean = x.where("id <> 3")
    z = np.array([r["embedding"] for r in vectors.standardize(clean).collect()])
    assert z.mean(0) == pytest.approx([0, 0, 0], abs=1e-9) and z[:, [0, 2]].std(0) == pytest.approx([1, 1])


def test_pca_and_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 1, 1, 1, 1]) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    p = vectors.pca(df)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.eigvalsh(z.T @ z / len(z))[::-1]
    assert p["explained_variance_ratio"] == pytest.approx((w / w.sum()).tolist(), abs=1e-9) and p["cumulative"][-1] == pytest.approx(1)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = {}
    for r in vectors.nearest(df, "id", 4, block=64).collect():
        near.setdefault(r["id"], set()).add(r["neighbour"])
    assert all(near[i] == set(np.argsort(-s[i])[:4].tolist()) for i in range(200))
    n = vectors.nearest(df, "id", 4)
    assert {r["jaccard"] for r in vectors.neighbourhood_jaccard(n, n, "id").collect()} == {1.0}


def test_classification_and_calibration(spark):
    rng = np.random.default_rng(4)
    t, q = rng.integers(0, 4, 400), rng.integers(0, 5, 400)
    df = spark.createDataFrame(list(zip(t.tolist(), q.tolist())), "truth long, predicted long")
    per = {r["class"]: r for r in metrics.per_class(df, "truth", "predicted").collect()}
    for c in range(5):
        h = ((t == c) & (q == c)).sum()
        assert per[c]["precision"] == pytest.approx(h / max((q == c).sum(), 1)) and per[c]["recall"] == pytest.approx(h / max((t == c).sum(), 1)) and per[c]["support"] == (t == c).sum()
    assert metrics.summary(df, "truth", "predicted").first()["accuracy"] == pytest.approx((t == q).mean(), abs=1e-6)
    over = spark.createDataFrame([(0.99, i % 2 == 0, 0.5) for i in range(2000)], "confidence double, correct boolean, b double")
    s = metrics.calibration_summary(over, "confidence", "correct", over["b"]).first()
    assert s["expected_calibration_error"] == pytest.approx(0.49) and s["high"] == 2000
    bins = metrics.calibration_bins(over, "confidence", "correct").collect()
    assert len(bins) == 15 and sum(b["count"] for b in bins) == 2000
    edge = spark.createDataFrame([(0.0, True), (0.2, True), (1.0, False)], "confidence double, correct boolean")
    assert {b["bin"]: b["count"] for b in metrics.calibration_bins(edge, "confidence", "correct", 5).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}


def test_partitions(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a long, b long")
    r = metrics.partition_agreement(same, "a", "b").first()
    assert r["adjusted_rand"] == r["fowlkes_mallows"] == 1 and metrics.adjusted_mutual_information(same, "a", "b") == pytest.approx(1)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    tp = sum((a[i] == a[j]) and (b[i] == b[j]) for i in range(200) for j in range(i))
    pa, pb = (sum(x[i] == x[j] for i in range(200) for j in range(i)) for x in (a, b))
    e = pa * pb / (200 * 199 / 2)
    r = metrics.partition_agreement(df, "a", "b").first()
    assert r["adjusted_rand"] == pytest.approx((tp - e) / ((pa + pb) / 2 - e), abs=1e-6) and r["fowlkes_mallows"] == pytest.approx(tp / math.sqrt(pa * pb), abs=1e-6)
    assert abs(metrics.adjusted_mutual_information(df, "a", "b")) < 0.05
    v = metrics.variance_explained(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 7.0), (1, 9.0)], "g long, v double"), "g", "v").first()[0]
    assert v == pytest.approx(0.9)


def test_naive_bayes_equals_the_dense_formula(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, f"c{i % 3}", [f"w{rng.randint(0, 8) + 4 * (i % 3)}" for _ in range(12)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string, ws array<string>")
    fit, query = df.where("id < 45"), df.where("id >= 45").unionByName(spark.createDataFrame([(99, "", [])], df.schema))
    counts = taxonomy.count_words(fit, F.col("ws"), "label")
    got = {r["id"]: r["predicted"] for r in taxonomy.classify(query, "id", F.col("ws"), counts).collect()}
    train_rows = [r for r in rows if r[0] < 45]
    total, names = len(train_rows), sorted({r[1] for r in train_rows})
    nw = Counter(w for r in train_rows for w in set(r[2]))
    for i, _, ws in rows[45:]:
        score = []
        for c in names:
            own = [set(r[2]) for r in train_rows if r[1] == c]
            score.append(sum(math.log((sum(w in s for s in own) + (nw[w] + 0.5) / (total + 1)) / (len(own) + 1)) for w in set(ws)))
        assert got[i] == names[int(np.argmax(score))]
    assert got[99] == ""
    b = taxonomy.assigned(taxonomy.bootstrap(query, "id", F.col("ws"), counts, 10), 0.7, 10).collect()
    assert all(r["predicted"] == got[r["id"]] and 0 <= r["votes"] <= 10 and r["assigned"] == (r["votes"] >= 7) for r in b)
    assert sorted(map(tuple, b)) == sorted(map(tuple, taxonomy.assigned(taxonomy.bootstrap(query.repartition(5), "id", F.col("ws"), counts, 10), 0.7, 10).collect()))


def test_clusters_probe_and_distillation(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(4, 8)) * 6
    rows = [(i, (centre[i % 4] + rng.normal(size=8)).tolist(), i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label long").cache()
    x, sweep = cluster.community(df, "id", k_grid=(2, 4), sample=200, n_init=2)
    assert max(sweep, key=lambda s: s[1])[0] == 4 and metrics.partition_agreement(x, "label", "cluster").first()["adjusted_rand"] == 1
    null = cluster.shuffled_null(df, "id").collect()
    for d in range(8):
        assert sorted(r["embedding"][d] for r in null) == sorted(r[1][d] for r in rows)
    split = sampling.stratified_split(df, "label", df["id"])
    p = train.train_probe(split, "id", hidden=(0, 16), epochs=20, lr=0.02)
    acc = {r["hidden"]: r["a"] for r in p.selectExpr("hidden", "double(truth = predicted) AS h").groupBy("hidden").agg({"h": "avg"}).toDF("hidden", "a").collect()}
    assert acc[0] > 0.9 and acc[16] > 0.9
    again = train.train_probe(split, "id", hidden=(0,), epochs=20, lr=0.02).orderBy("id").collect()
    assert np.allclose([r["confidence"] for r in again], [r["confidence"] for r in p.where("hidden = 0").orderBy("id").collect()])
    d = train.distil(split.withColumn("student", split["embedding"]), "id", "embedding", "student", ((0.0, 1.0), (0.5, 2.0)), epochs=10).collect()
    assert next(r for r in d if r["alpha"] == 0)["distilled_accuracy"] == next(r for r in d if r["alpha"] == 0)["alone_accuracy"]
    assert train.Head(8, 4).parameter_counts() == {"trainable": 36, "backbone": 0}


def test_pcr_window_starts_two_bases_before_the_core(spark):
    from strandloom.operators import taxonomy

    core, tail = "GGGCACCACAAGAACG", "ACGT" * 60
    seqs = {"a": "TTTCC" + core + tail, "b": core + tail, "c": "T" + core + tail, "d": "ccuu" + core.lower().replace("t", "u") + tail, "e": "AAGGGCACCACAAGAA" + tail, "f": "GA" + core + tail[:60]}
    x = spark.createDataFrame(list(seqs.items()), "accession string, sequence string")
    tax = spark.createDataFrame([(k, "E;S;D") for k in seqs], "accession string, taxonomy string")
    got = {r["accession"]: r["sequence"] for r in taxonomy.build_reference(x, tax).collect()}
    assert got == {"a": ("CC" + core + tail)[:151], "b": (core + tail)[:151], "c": ("T" + core + tail)[:151], "d": ("TT" + core + tail)[:151]}


def test_taxonomy_hints(spark):
    from pyspark.sql import functions as F

    from strandloom.functions.sequences import TAXONOMY_HINT

    yes = ["r1 tax=5", "r2 taxonomy:x", "r3 TAXID 5", "r4 species x", "r5 asv", "r6 k__ x", "r7 lineage;a"]
    no = ["SYN.1 LH:11:FC:5:1101:0:0 length=151", "r taxi", "r taxon x", "r organism", "r ;abc;", "r subspecies", "r asv1"]
    df = spark.createDataFrame([(h,) for h in yes + no], "h string")
    hits = {r["h"] for r in df.where(F.col("h").rlike(TAXONOMY_HINT)).collect()}
    assert {"r2 taxonomy:x", "r3 TAXID 5", "r4 species x", "r5 asv", "r7 lineage;a"} <= hits and not hits & set(no)


def test_counts_default_to_one(spark):
    import math

    from pyspark.sql import functions as F

    from strandloom.operators import train, variants

    x = spark.createDataFrame([("a", [0.5]), ("b", [0.25])], "id string, v array<double>")
    n = spark.createDataFrame([("a", 99)], "id string, count bigint")
    got = {r["id"]: (r["count"], r["student"]) for r in train.student_features(variants.with_counts(x, n, "id"), F.col("v")).collect()}
    assert got == {"a": (99, [0.5, 2.0]), "b": (1, [0.25, math.log10(2)])}


def test_settings_have_the_interface_names(tmp_path):
    import json

    from strandloom.session import load_config

    (tmp_path / "c.json").write_text(json.dumps({"subset": {"encode_size": 5, "pair_subset_pairs": 7}, "note": 1}))
    c = load_config(str(tmp_path / "c.json"), ["analysis.knn_k=3", "new.deep.key=x", "taxonomy.ranks.class=0.5"])
    assert c["subset"] == {"test_run_size": 2000, "encode_size": 5, "pair_subset_pairs": 7, "visualization_size": 20_000} and c["analysis"]["knn_k"] == 3
    assert c["new"] == {"deep": {"key": "x"}} and c["taxonomy"]["ranks"] == {"class": 0.5, "order": 0.7} and c["note"] == 1


def test_ranks_and_splits_by_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandloom.operators import sampling, variants

    monkeypatch.setattr(variants, "BLOCK", 7)
    rows = [(f"s{i}", 1 + i % 3 % 2, i * 5 % 101) for i in range(101)]
    counts = spark.createDataFrame(rows, "sequence string, count bigint, first_index bigint")
    got = [r["sequence"] for r in variants.variant_table(counts).orderBy("rank").collect()]
    assert got == [s for s, _, _ in sorted(rows, key=lambda r: (-r[1], r[2]))]
    x = spark.range(200).select("id", F.when(F.col("id") < 150, "a").when(F.col("id") < 190, "b").alias("label"))
    split = sampling.stratified_split(x, "label", F.col("id"))
    n = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert split.columns == ["id", "label", "split"] and n["a", "train"] == 105 and n["b", "train"] == 28 and n[None, "train"] == 7 and sum(n.values()) == 200


def test_chance_information_equals_every_overlap():
    import math
    from fractions import Fraction

    for n, x, y in [(10, 3, 4), (10, 7, 8), (60, 30, 30), (500, 1, 1), (500, 499, 2), (2000, 900, 1500)]:
        c = math.comb
        every = sum(k / n * math.log(n * k / (x * y)) * float(Fraction(c(x, k) * c(n - x, y - k), c(n, y))) for k in range(max(1, x + y - n), min(x, y) + 1))
        assert metrics._expected_information(x, y, n) == pytest.approx(every, abs=1e-12)
        assert metrics._expected_information(x, y, n, block=3) == pytest.approx(every, abs=1e-12)


def test_running_totals_and_medians_by_ranges(spark):
    rng = np.random.default_rng(5)
    for v in (rng.normal(size=101), rng.integers(0, 4, size=60).astype(float), np.array([2.5]), np.array([1.0, 4.0]), np.array([0.0, 1e300, -np.inf])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
        assert metrics.median(df, "v").first()["median"] == np.median(v)
        by = df.where("v IS NOT NULL").groupBy("v").count()
        got = {r["v"]: r["before"] for r in sampling.running_total(by, "v", "count").collect()}
        assert got == {x: int((v < x).sum()) for x in set(v.tolist())}
    assert metrics.median(spark.createDataFrame([], "v double"), "v").first()["median"] is None


def test_running_index_within_groups(spark):
    df = spark.range(200).selectExpr("id * 3 AS k", "id % 3 AS g")
    rows = sampling.running_index(df, "k", 16, ("g",)).collect()
    assert {(r["g"], r["k"]): r["idx"] for r in rows} == {(i % 3, i * 3): i // 3 for i in range(200)}


def test_cross_validation_and_projection(spark):
    rows = [(i, "ab"[i % 2], ["x", "y", "z"] if i % 2 else ["p", "q", "r"]) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, label string, words array<string>")
    got = taxonomy.cross_validate(df, "id", df["words"], "label", k=2, n_bootstrap=4).collect()
    assert sum(r["n"] for r in got) == 24 and all(r["accuracy"] == 1 and r["confidence_correct"] == 1 and r["confidence_wrong"] is None for r in got)

    v = np.random.default_rng(8).normal(size=(30, 4))
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    axes = np.eye(4)[:2]
    coords = {r["id"]: r["coords"] for r in vectors.project(e, axes.tolist()).collect()}
    want = ((v - v.mean(0)) / v.std(0)) @ axes.T
    assert all(np.allclose(coords[i], want[i]) for i in range(30))


def test_scores_by_join_equal_those_in_place(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(i % 37 or None, rng.choice(["a", "b", "c", None]), [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 30))] or None, i) for i in range(80)]
    rows += [(5, "a", ["w1", "w2"], 1)] * 3 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, label string, ws array<string>, n long").withColumn("fold", F.pmod(F.hash("n"), F.lit(3)))
    counts = taxonomy.count_words(df, F.col("ws"), "label", F.col("fold"), 3)
    of = lambda: sorted(map(str, taxonomy.evaluate(df, "id", F.col("ws"), counts, 7, 42, F.col("fold"), F.col("label"), F.col("n")).collect()))
    one = of()
    monkeypatch.setattr(taxonomy, "TABLE", 10)
    assert of() == one and len(one) == len(rows)
    folds = sampling.kfold(spark.range(103), F.col("id"), 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20, 20, 21, 21, 21]
    assert taxonomy.classify(df.limit(0), "id", F.col("ws"), counts).count() == 0 and taxonomy.count_words(df.limit(0), F.col("ws"), "label").names == []


def test_only_rare_words_are_joined_to_their_counts(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "ab"[i % 2], [f"c{j}" for j in range(10)] + [f"own{i}"]) for i in range(200)], "id long, label string, ws array<string>")
    asked, unknown = spark.sparkContext.accumulator(0), taxonomy._unknown

    def counted(shared):
        run = unknown(shared)

        def work(batches):
            for b in run(batches):
                asked.add(b.num_rows)
                yield b

        return work

    monkeypatch.setattr(taxonomy, "_unknown", counted)
    monkeypatch.setattr(taxonomy, "TABLE", 50)
    got = taxonomy.evaluate(df, "id", F.col("ws"), taxonomy.count_words(df, F.col("ws"), "label"), 5).collect()
    assert asked.value == 200 and all(r["predicted"] == "ab"[r["id"] % 2] for r in got) and len(got) == 200


def test_rank_abundance_without_a_bound_has_every_rank(spark, monkeypatch):
    monkeypatch.setattr(variants, "RUN", 1000)
    s = spark.createDataFrame([(9, 1), (2, 2500), (1, 3500)], "k long, f long")
    got = variants.rank_abundance(s, None).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 6002)) and [r["abundance"] for r in got] == [9] + [2] * 2500 + [1] * 3500
    total, run = 9 + 5000 + 3500, np.cumsum([9] + [2] * 2500 + [1] * 3500)
    assert np.allclose([r["cumulative_read_fraction"] for r in got], run / total, atol=1e-8) and len(variants.rank_abundance(s, 5000).collect()) <= 5000


def test_tiles_keep_the_best_of_copies_and_ties(monkeypatch):
    monkeypatch.setattr(vectors, "SCORES", 600)  # several products a tile
    monkeypatch.setattr(vectors, "TILE", 50)
    rng = np.random.default_rng(4)
    y = rng.normal(size=(1500, 8))
    y[100:400] = y[7]  # a large group of copies
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    keys = rng.permutation(1500) * 3
    x = y[::20]
    best = vectors._Best(x, y, keys[::20], keys, 6)
    best.show(np.arange(len(x)), np.arange(1500))
    s = np.round(np.einsum("id,jd->ij", x, y), 12)
    for i, own in enumerate(keys[::20]):
        want = [j for j in np.lexsort((keys, -s[i])) if keys[j] != own][:6]
        assert [keys[j] for j in best.at[i]] == [keys[j] for j in want] and np.array_equal(best.value[i], s[i][want])


def test_vectors_move_as_they_are_and_a_tile_gives_a_row_a_query(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(90)], "id long, embedding array<float>").cache()
    seen = []
    kind = type(df)
    before = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema, *a: seen.append((self, before(self, f, schema, *a))) or seen[-1][1])
    got = vectors.nearest(df, "id", 7, block=40)
    tiles, found = seen[0]
    assert got.count() == 630 and dict(tiles.dtypes)["v"] == "array<float>"
    assert found.count() == 90 * 3  # one row a query and block of data


def test_a_query_goes_once_to_a_block_with_its_draws(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 64)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 5))
    x[40:90] = x[3]
    df = spark.createDataFrame([(i * 2, v.tolist(), w.tolist(), i % 2) for i, (v, w) in enumerate(zip(x, x + rng.normal(size=x.shape)))], "pair_id long, left_vec array<float>, right_vec array<float>, right_end int").cache()
    rows = df.orderBy("pair_id").collect()
    seen = []
    kind = type(df)
    before = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *c: (seen.append(self) if [str(x) for x in c] == ["pool", "a", "b"] else None, before(self, *c))[1])
    got = {r["pair_id"]: r for r in vectors.retrieval(df, 20, controlled=True, standardized=False).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    import hashlib

    for pool in (0, 1):
        own = [r for r in rows if r["right_end"] == pool]
        for place, r in enumerate(own):
            at = [int(hashlib.md5(f"42:{r['pair_id']}:{j}".encode()).hexdigest()[:15], 16) % len(own) for j in range(20)]
            at = [(a + 1) % len(own) if a == place else a for a in at]
            want = [float(unit(r["left_vec"]) @ unit(own[a]["right_vec"])) for a in at]
            mate = float(unit(r["left_vec"]) @ unit(r["right_vec"]))
            g = got[r["pair_id"]]
            assert g["distractors"] == pytest.approx(want, abs=2e-9) and g["mate_similarity"] == pytest.approx(mate, abs=2e-9)
            assert g["rank"] == 1 + sum(d > g["mate_similarity"] for d in g["distractors"])
    sent = seen[0].where("codes IS NOT NULL")
    assert len(got) == 300 and sent.count() <= 300 * 3 and dict(sent.dtypes)["v"] == "array<float>"  # not 300 * 20


def test_draws_equal_hashlib_without_a_call_a_draw(monkeypatch):
    from hashlib import md5

    from strandloom.operators import taxonomy

    heads = [h.encode() for h in ("42:7:", "42:123456789012:", "1:é:", "42::", "42:long:" + "x" * 31, "42:1:", "42:2:")]
    sizes = [300, 9, 700, 1, 40, 0, 7]
    want = [[[(int.from_bytes(md5(h + f"{b}:{j}".encode()).digest()[:8]) >> 4) % n for j in range(max(1, n // 8) if n else 0)] for b in range(12)] for h, n in zip(heads, sizes)]
    long, calls = b"42:" + b"y" * 90 + b":", []
    monkeypatch.setattr(taxonomy, "md5", lambda x: calls.append(x) or md5(x))
    for texts in (50, 16_384):  # a few at a time, all at once
        monkeypatch.setattr(taxonomy, "HASHED", texts)
        assert [x.tolist() for x in taxonomy.drawn(heads, sizes, 12)] == want and not calls
    got = list(taxonomy.drawn([heads[0], long, heads[1]], [300, 20, 9], 12))  # of more than one block
    assert [got[0].tolist(), got[2].tolist()] == want[:2] and len(calls) == 24
    assert got[1].tolist() == [[(int.from_bytes(md5(long + f"{b}:{j}".encode()).digest()[:8]) >> 4) % 20 for j in range(2)] for b in range(12)]
    taxonomy._Scorer(np.array([[3.0, 4.0]]), 12, 42).best(300, got[0], None, np.arange(300), np.arange(300) % 2, np.ones(300))
    assert len(calls) == 24


def test_words_of_a_batch_are_looked_up_once():
    import pyarrow as pa

    from strandloom.operators import taxonomy

    asked = []

    class Places(dict):
        def get(self, w, other=None):
            asked.append(w)
            return super().get(w, other)

    lists = pa.array([["a", "b"], [], ["b", "c", "a"], ["a"]], pa.list_(pa.string()))
    for part, first in ((lists, 0), (lists.slice(2), 2)):
        asked.clear()
        ends, place, code, distinct = taxonomy._looked_up(part, Places(a=5, b=7))
        words = [w for r in lists.to_pylist()[first:] for w in r]
        assert [distinct[c] for c in code] == words and place.tolist() == [{"a": 5, "b": 7}.get(w, -1) for w in words]
        assert len(asked) == 3 and np.diff(ends).tolist() == [len(r) for r in lists.to_pylist()[first:]]
    assert taxonomy._looked_up(lists.slice(0, 0), {})[0].tolist() == [0]

"""The stages as a command line: python -m strandloom.plans.stages STAGE --input reads.fasta --output folder [--set a.b=v] [--force]."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from strandloom.functions.sequences import LABEL_SUFFIXES, TAXONOMY_HINT
from strandloom.operators import amplicon, cluster, kmer, layout, metrics, qc, sampling, stats, taxonomy, train, variants, vectors
from strandloom.session import load_config, spark_session
from strandloom.sources import fasta, store, tables


class Run:
    """Paths, settings and inputs of one run. Results are Parquet tables and metrics documents below the output folder."""

    def __init__(self, spark, cfg: dict, source: str, output: str, force: bool = False, reference: str | None = None, lineages: str | None = None, labels: str | None = None):
        self.spark, self.cfg, self.source, self.output, self.force = spark, cfg, source, output.rstrip("/"), force
        self.reference, self.lineages, self.labels = reference, lineages, labels
        self.qc = qc.QCConfig.from_dict(cfg["qc"])

    def table(self, name: str, build):
        """A table that is built once; its lineage ends here."""
        path = f"{self.output}/{name}.parquet"
        if self.force or not tables.exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def metrics(self, name: str, value) -> dict:
        tables.save_json(value, f"{self.output}/metrics/{name}.json")
        return value

    def reads(self):
        return fasta.scan(self.spark, self.source, self.cfg["preprocessing"]["max_records"])

    def checked(self):
        return self.table("checked", lambda: qc.evaluate(self.reads(), self.qc, track_positions=True))

    def passed(self):
        x = self.checked().where("qc_pass")
        return x.withColumn("sequence", F.col("qc_sequence")).select("record_index", "seq_id", "sequence", "raw_length", "effective_length", "gc_content")

    def counts(self):
        return self.table("variant_counts", lambda: variants.count_variants(self.passed(), self.cfg["dereplication"]["canonical"]))

    def variants(self):
        d = self.cfg["dereplication"]
        return self.table("variants", lambda: variants.variant_table(self.counts(), d["keep_top_variants"], d["min_count_for_representative"]))

    def pairs(self):
        ids = lambda: self.checked().select("seq_id").distinct().count()
        return self.table("subset_pairs", lambda: sampling.sample_pairs(self.passed(), ids(), self.cfg["subset"]["pair_subset_pairs"]))

    def vectors(self, name: str, subset):
        encoder = kmer.build_encoder("kmer", **{k: v for k, v in self.cfg["baseline"].items() if k in ("k", "canonical", "include_gc", "include_length")})
        s = store.EmbeddingStore(self.spark, f"{self.output}/embeddings/{name}", encoder.dim)
        store.extract(subset, encoder, s, self.cfg["encoder"]["batch_size"])
        return s.committed()


def _row(df) -> dict:
    r = df.first()
    return r.asDict(recursive=True) if r else {}


def preprocess(run: Run):
    run.table("read_metadata", lambda: qc.metadata(run.reads(), run.qc))
    from strandloom.functions.sequences import header_fields

    h = header_fields(F.col("header"))
    m = run.checked().withColumn("tile", h["tile"]).withColumn("declared_length", h["declared_length"])
    out = _row(stats.dataset_summary(m)) | {"length": _row(stats.histogram_stats(stats.histogram(m, "raw_length"))), "gc": _row(stats.array_stats(m, "gc_content")), "ids": _row(stats.read_id_analysis(m))}
    out["reasons"] = {qc.REASONS[r["qc_reason"]]: r["n"] for r in m.groupBy("qc_reason").agg(F.count("*").alias("n")).collect()}
    return run.metrics("dataset_metrics", out)


def subsets(run: Run):
    c = run.cfg["subset"]
    for name, n in (("test", c["test_run_size"]), ("main", c["encode_size"])):
        run.table(f"subset_{name}", lambda n=n: sampling.systematic_sample(run.passed(), n))
    return run.metrics("subset_metrics", {"pairs": run.pairs().count() // 2})


def dereplicate(run: Run):
    run.variants()
    spectrum = run.table("spectrum", lambda: variants.frequency_spectrum(run.counts()))
    run.table("rank_abundance", lambda: variants.rank_abundance(spectrum))
    curve = run.table("rarefaction", lambda: variants.rarefaction(spectrum, run.cfg["community"]["rarefaction_points"]))
    parts = (variants.dereplication_summary(run.counts()), variants.diversity(spectrum), variants.chao1_interval(spectrum), variants.coverage_thresholds(spectrum), variants.saturation(curve))
    return run.metrics("diversity_metrics", {k: v for p in parts for k, v in _row(p).items()})


def _ends(v):
    """Variants with the group of their amplicon end."""
    return amplicon.end_groups(v.withColumn("record_index", F.col("variant_id"))).drop("record_index")


def structure(run: Run):
    v = _ends(run.variants())
    n = amplicon.modal_length(v)
    used = amplicon.usable(v, n)
    prof = run.table("conservation", lambda: amplicon.profile(used, n))
    run.table("changepoints", lambda: amplicon.changepoint(prof))
    per_end = run.table("amplicon_ends", lambda: amplicon.summary(used, prof, n).join(amplicon.consensus(prof), "end"))
    return run.metrics("amplicon_metrics", {"read_length": n, "ends": [r.asDict() for r in per_end.collect()], **_row(amplicon.weighted_summary(per_end))})


def varregion(run: Run):
    structure(run)
    cuts = run.spark.read.parquet(f"{run.output}/changepoints.parquet")
    x = run.table("subset_pairs_var", lambda: amplicon.variable_region(amplicon.end_groups(run.pairs()), cuts))
    return run.metrics("variable_region_metrics", _row(x.agg(F.count("*").alias("reads"), F.avg("retained_fraction").alias("retained_fraction"))) | _retrieve(run, x, "pairs_var"))


def _retrieve(run: Run, pairs, name: str) -> dict:
    """Retrieval of mates by the vectors of pairs; ends always come from the reads as they were."""
    ids = pairs.withColumn("seq_id", F.concat_ws("/", "seq_id", "mate", "pair_id"))
    vec = run.vectors(name, ids.select("seq_id", "sequence"))
    ends = amplicon.end_groups(run.pairs()).select("pair_id", "mate", "end")
    x = ids.select("pair_id", "mate", "seq_id").join(vec, F.col("seq_id") == F.col("sequence_id")).join(ends, ["pair_id", "mate"])
    side = lambda m, *c: x.where(F.col("mate") == m).select("pair_id", *c)
    both = side(1, F.col("embedding").alias("left_vec")).join(side(2, F.col("embedding").alias("right_vec"), F.col("end").alias("right_end")), "pair_id")
    n = run.cfg["analysis"]["retrieval_distractors"]
    r = run.table(f"retrieval_{name}", lambda: vectors.retrieval(both, n))
    return _row(vectors.retrieval_summary(r, n)) if not r.isEmpty() else {"n_queries": 0}


def strandtest(run: Run):
    flipped = run.table("subset_pairs_rc", lambda: sampling.reverse_second_mates(run.pairs()))
    return run.metrics("strand_orientation_metrics", {"as_read": _retrieve(run, run.pairs(), "pairs"), "second_mate_reversed": _retrieve(run, flipped, "pairs_rc")})


def baseline(run: Run):
    v = run.vectors("main", run.table("subset_main", lambda: sampling.systematic_sample(run.passed(), run.cfg["subset"]["encode_size"])).withColumn("seq_id", F.concat_ws("/", "seq_id", "record_index")))
    return run.metrics("encoder_metrics", _row(vectors.health(v)))


def analyze(run: Run):
    baseline(run)
    v = store.load(run.spark, f"{run.output}/embeddings/main")
    p = vectors.pca(v, n_components=run.cfg["analysis"]["pca_components"])
    run.table("coords", lambda: vectors.project(v, p["axes"][:2]).select("sequence_id", "coords"))
    c, few = run.cfg["analysis"], cluster.hashed_sample(v, "sequence_id", run.cfg["subset"]["visualization_size"], run.cfg["seed"])
    run.table("umap", lambda: layout.umap(few, "sequence_id", neighbours=c["umap_neighbors"], min_dist=c["umap_min_dist"], seed=run.cfg["seed"]))
    if c["run_tsne"]:
        run.table("tsne", lambda: layout.tsne(few, "sequence_id", seed=run.cfg["seed"]))
    tend = cluster.tendency(v, "sequence_id", k_grid=tuple(run.cfg["analysis"]["kmeans_k_grid"]), sample=run.cfg["analysis"]["silhouette_sample"])
    return run.metrics("embedding_metrics", {k: v for k, v in p.items() if k != "axes"} | {"tendency": [r.asDict() for r in tend.collect()]})


def community(run: Run):
    v = _ends(run.variants().where(F.col("rank") <= run.cfg["community"]["encode_variants"])).withColumn("seq_id", F.concat(F.lit("variant_"), F.col("variant_id").cast("string")))
    vec = run.vectors("variants", v.select("seq_id", "sequence"))
    c = run.cfg["community"]
    x, sweep = cluster.community(v.join(vec, F.col("seq_id") == F.col("sequence_id")), "seq_id", k_grid=tuple(c["cluster_k_grid"]), sample=run.cfg["analysis"]["silhouette_sample"], n_init=10)
    labels = run.table("communities", lambda: x.drop("embedding"))
    return run.metrics("community_metrics", {"sweep": sweep, "profile": [r.asDict() for r in metrics.cluster_profile(labels).collect()], "gc_explained": _row(metrics.variance_explained(labels, "cluster", "gc_content")), "end_agreement": _row(metrics.partition_agreement(labels.where("end >= 0"), "end", "cluster"))})


def labels(run: Run):
    """Which labels there are: those of the file given, or hints in the headers and files beside the reads. None are made up,
    and no file found is trusted."""
    given = run.labels or run.cfg["classification"]["labels_path"]
    if given and tables.exists(run.spark, given):
        found = tables.load_labels(run.spark, given)
        return run.metrics("label_verification", {"source": given, **_row(found.agg(F.count("*").alias("labels"), F.countDistinct("taxon").alias("classes")))})
    hints = run.reads().orderBy("record_index").limit(20_000).where(F.col("header").rlike(TAXONOMY_HINT))
    return run.metrics("label_verification", {"source": None, "headers_with_hints": hints.count(), "sibling_files": tables.siblings(run.spark, run.source, LABEL_SUFFIXES)})


def assign(run: Run):
    from strandloom.functions.sequences import word_set

    t = run.cfg["taxonomy"]
    seqs = fasta.scan(run.spark, run.reference).select(F.col("header").alias("accession"), "sequence")
    ref = run.table("reference", lambda: taxonomy.build_reference(seqs, tables.load_taxonomy(run.spark, run.lineages), region=t["region_length"], least=t["min_region_length"]))
    out = {"ranks": {r["rank"]: r["n"] for r in taxonomy.rank_counts(ref).collect()}}
    words = word_set(F.col("sequence"), t["kmer_size"])
    for rank, threshold in t["ranks"].items():
        known = ref.where(~F.col(rank).isin("", "NA"))
        counts = taxonomy.count_words(known, words, rank)
        # only variants of the end that the reference's windows come from can be told apart by them
        q = _ends(run.variants()).where(F.col("end") == t["amplicon_end"]).withColumn("seq_id", F.concat(F.lit("variant_"), F.col("variant_id").cast("string")))

        def build(q=q, counts=counts, threshold=threshold):
            b = taxonomy.assigned(taxonomy.bootstrap(q, "seq_id", words, counts, t["bootstrap"], run.cfg["seed"], weight=F.col("count")), threshold, t["bootstrap"])
            b = b.withColumnRenamed("weight", "read_count").withColumn("variant_id", F.substring_index("seq_id", "_", -1).cast("int"))
            return b.select("seq_id", "variant_id", "predicted", F.col("confidence").cast("float").alias("confidence"), "read_count", "assigned")

        out[rank] = _row(taxonomy.assignment_summary(run.table(f"variant_labels_{rank}", build), "read_count"))
    return run.metrics("taxonomy_metrics", out)


def _labelled(run: Run, rank: str = "class"):
    lab = run.spark.read.parquet(f"{run.output}/variant_labels_{rank}.parquet").where("assigned").select("seq_id", F.col("predicted").alias("label"))
    x = sampling.min_class_size(store.load(run.spark, f"{run.output}/embeddings/variants").withColumnRenamed("sequence_id", "seq_id").join(lab, "seq_id"), "label", run.cfg["classification"]["min_class_size"])
    return sampling.stratified_split(x, "label", F.col("seq_id"), tuple(run.cfg["classification"]["split"][:2]), run.cfg["seed"])


def _training(c: dict) -> dict:
    return {"lr": c["lr"], "decay": c["weight_decay"], "batch_size": c["batch_size"]}


def train_stage(run: Run):
    c = run.cfg["classification"]
    hidden = (0,) if c["model"] == "linear" else (c["hidden_dim"],)
    p = run.table("predictions", lambda: train.train_probe(_labelled(run), "seq_id", hidden=hidden, epochs=c["epochs"], seed=run.cfg["seed"], **_training(c)))
    return run.metrics("classification_metrics", _row(metrics.summary(p, "truth", "predicted")) | {"model": c["model"]})


def distill(run: Run, ablation: bool = False):
    """The teacher reads the stored vectors of the variants, the student their k-mers and how many reads they have."""
    d, c = run.cfg["distillation"], run.cfg["classification"]
    grid = [(d["alpha"], d["temperature"])] if not ablation else [(a, d["temperature"]) for a in d["alpha_grid"]] + [(d["alpha"], t) for t in d["temperature_grid"]]
    x = _labelled(run, d["ablation_rank"] if ablation else "class")
    known = run.variants().select(F.concat(F.lit("variant_"), F.col("variant_id").cast("string")).alias("seq_id"), "sequence", "count")
    x = variants.with_counts(x, known.select("seq_id", "count"), "seq_id").join(known.select("seq_id", "sequence"), "seq_id")
    encoder = kmer.build_encoder("kmer", **{k: v for k, v in run.cfg["baseline"].items() if k in ("k", "canonical", "include_gc", "include_length")})
    x = train.student_features(x, kmer.encode(F.col("sequence"), encoder), d["include_abundance"])
    how = {"epochs": d["epochs"], "seed": run.cfg["seed"], "hidden": c["hidden_dim"], "teacher_head": d["teacher_head"], **_training(c)}
    rows = [r.asDict() for r in train.distil(x, "seq_id", "embedding", "student", tuple(dict.fromkeys(grid)), **how).collect()]
    for r in rows:
        r["p_value"] = vectors.binomial_two_sided(r["only_distilled"], r["only_alone"])
    return run.metrics("distillation_ablation" if ablation else "distillation_metrics", rows)


def distill_ablation(run: Run):
    return distill(run, True)


def performance(run: Run):
    """Measured throughput of the encoder by Arrow batch size, and what the whole file would take."""
    import time

    x = run.passed().limit(run.cfg["performance"]["sweep_reads"]).cache()
    n, rates = x.count(), {}
    encoder = kmer.build_encoder("kmer", k=run.cfg["baseline"]["k"])
    before = run.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    x.select(kmer.encode(F.col("sequence"), encoder)).write.format("noop").mode("overwrite").save()  # workers start before anything is timed
    for size in run.cfg["performance"]["batch_size_sweep"]:
        run.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        t = time.time()
        x.select(kmer.encode(F.col("sequence"), encoder)).write.format("noop").mode("overwrite").save()
        rates[size] = n / (time.time() - t)
    run.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    total = run.checked().count()
    best = max(rates, key=rates.get)
    return run.metrics("performance_metrics", {"rates": rates, "best_batch": best, "projected_seconds": total / rates[best], "projected_bytes": total * encoder.dim * 4})


def report(run: Run):
    """A Markdown report of the metrics documents that exist."""
    lines = ["# Results"]
    for name in ("dataset_metrics", "diversity_metrics", "amplicon_metrics", "strand_orientation_metrics", "community_metrics", "taxonomy_metrics", "classification_metrics", "distillation_metrics"):
        doc = tables.read_json(f"{run.output}/metrics/{name}.json")
        lines += ["", f"## {name.replace('_', ' ')}", ""]
        if doc is None:
            lines.append("not run")
        else:
            rows = doc.items() if isinstance(doc, dict) else enumerate(doc)
            lines += ["| | |", "|-|-|"] + [f"| {k} | {v if not isinstance(v, float) else format(v, '.6g')} |" for k, v in rows if not isinstance(v, (list,)) or len(v) <= 20]  # long arrays stay in the JSON
    from pathlib import Path

    Path(f"{run.output}/report.md").write_text("\n".join(lines) + "\n")
    return {"report": f"{run.output}/report.md"}


STAGES = {
    "preprocess": preprocess, "subsets": subsets, "baseline": baseline, "strandtest": strandtest, "dereplicate": dereplicate, "community": community, "amplicon": structure, "varregion": varregion, "labels": labels,
    "assign": assign, "train": train_stage, "distill": distill, "distill-ablation": distill_ablation, "analyze": analyze, "performance": performance, "report": report,
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config")
    p.add_argument("--set", action="append", default=[], dest="overrides")
    p.add_argument("--force", action="store_true")
    p.add_argument("--reference")
    p.add_argument("--lineages")
    p.add_argument("--labels")
    a = p.parse_args(argv)
    run = Run(spark_session(), load_config(a.config, a.overrides), a.input, a.output, a.force, a.reference, a.lineages, a.labels)
    skip = set() if a.reference and a.lineages else {"assign", "train", "distill", "distill-ablation"}
    for name in [a.stage] if a.stage != "all" else [s for s in STAGES if s not in skip]:
        print(name, STAGES[name](run), flush=True)


if __name__ == "__main__":
    main()

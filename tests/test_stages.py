"""The stages end to end on a small file."""

import json
import random

from strandloom.plans.stages import STAGES, Run
from strandloom.session import load_config


def test_stages_run_and_reuse_results(spark, tmp_path):
    rng = random.Random(1)
    flip = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    frags = ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(12)]
    lines = []
    for i in range(60):
        f = frags[min(i % 12, i % 7)]
        for read in ("AAGGGCACCACAAGAACG" + f[:133], "CGGTCACGTTCGTTGCCT" + flip(f[17:])):
            lines.append(f">SYN.{i} LH:11:FC:5:{1101 + i % 4}:{i}:{i} length={len(read)}\n{read}\n")
    (tmp_path / "notes.tsv").write_text("a\tb\n")
    (tmp_path / "r.fasta").write_text("".join(lines))
    cfg = load_config(None, ["subset.pair_subset_pairs=30", "subset.encode_size=40", "subset.test_run_size=10", "analysis.retrieval_distractors=3", "dereplication.min_count_for_representative=1"])
    run = Run(spark, cfg, str(tmp_path / "r.fasta"), str(tmp_path / "out"))
    assert STAGES["preprocess"](run)["total_sequence_records"] == 120
    assert STAGES["subsets"](run) == {"pairs": 30}
    d = STAGES["dereplicate"](run)
    assert d["reads"] == 120 and d["unique_variants"] == d["observed_richness_variants"] <= 24
    assert STAGES["amplicon"](run)["read_length"] == 151
    assert STAGES["varregion"](run)["reads"] == 60
    assert STAGES["strandtest"](run)["second_mate_reversed"]["n_queries"] == 30
    assert STAGES["baseline"](run)["finite"]
    assert STAGES["labels"](run) == {"source": None, "headers_with_hints": 0, "sibling_files": ["notes.tsv"]}
    STAGES["report"](run)
    assert "diversity" in (tmp_path / "out" / "report.md").read_text() and "not run" in (tmp_path / "out" / "report.md").read_text()
    assert json.loads((tmp_path / "out" / "metrics" / "diversity_metrics.json").read_text())["reads"] == 120
    assert STAGES["dereplicate"](run) == d


def test_training_stages_read_labels_vectors_and_kmers(spark, tmp_path):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("AT" if i % 2 else "CG") if rng.random() < 0.7 else rng.choice("ACGT") for _ in range(150)) for i in range(80)]
    (tmp_path / "r.fasta").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(seqs) for _ in range(1 + i % 3)))
    cfg = load_config(None, ["dereplication.min_count_for_representative=1", "qc.max_single_base_fraction=null", "classification.min_class_size=5", "classification.epochs=8", "classification.lr=0.03", "classification.hidden_dim=12", "distillation.epochs=6", "distillation.alpha_grid=[0.0,0.4]", "distillation.temperature_grid=[2.0]"])
    run = Run(spark, cfg, str(tmp_path / "r.fasta"), str(tmp_path / "out"))
    v = run.variants().selectExpr("concat('variant_', variant_id) AS seq_id", "sequence").cache()
    run.vectors("variants", v)
    for rank in ("class", "order"):
        v.selectExpr("seq_id", "if(length(replace(replace(sequence, 'A', ''), 'T', '')) < 75, 'at', 'cg') AS predicted", "true AS assigned").write.parquet(str(tmp_path / "out" / f"variant_labels_{rank}.parquet"))
    got = STAGES["train"](run)
    assert got["model"] == "linear" and got["accuracy"] > 0.8
    one = STAGES["distill"](run)
    assert [(r["alpha"], r["temperature"]) for r in one] == [(0.4, 4.0)] and 0 <= one[0]["p_value"] <= 1 and one[0]["n_test"] > 5
    assert {(r["alpha"], r["temperature"]) for r in STAGES["distill-ablation"](run)} == {(0.0, 4.0), (0.4, 4.0), (0.4, 2.0)}

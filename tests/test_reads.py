"""Scans, quality control, statistics and samples on hand-made inputs."""

import gzip
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import amplicon, kmer, qc, sampling, stats, variants
from strandloom.plans import queries
from strandloom.session import load_config, parse_override
from strandloom.sources import fasta, store, tables
from strandloom.streaming import ingest


def frame(spark, seqs):
    return spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(seqs)], "record_index long, seq_id string, sequence string")


def one(df, *cols):
    r = df.select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_fasta_scan(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text("junk\n>read0 extra field\nACGT\nAC\n\nGT\n>only_header\n>last  x\r\nTT\r\n")
    got = [tuple(r) for r in fasta.scan(spark, str(p)).orderBy("record_index").collect()]
    assert got == [(0, "read0", "read0 extra field", "ACGTACGT"), (1, "only_header", "only_header", ""), (2, "last", "last  x", "TT")]
    assert fasta.scan(spark, str(p), 2).count() == 2 and fasta.scan(spark, str(p), 0).count() == 0
    assert [r["header"] for r in fasta.peek_headers(spark, str(p), 1).collect()] == ["read0 extra field"]
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">a\nAC\n>b\nGT\n")
    assert [r["sequence"] for r in fasta.scan(spark, str(tmp_path / "b.fasta.gz")).orderBy("record_index").collect()] == ["AC", "GT"]


def test_fasta_splits_keep_every_record_in_order(spark, tmp_path):
    p = tmp_path / "c.fasta"
    p.write_text("".join(f">read{i}\n{'ACGT' * (i % 50 + 1)}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        x = fasta.scan(spark, str(p))
        assert [(r["record_index"], r["seq_id"], len(r["sequence"])) for r in x.orderBy("record_index").collect()] == [(i, f"read{i}", 4 * (i % 50 + 1)) for i in range(2000)]
        assert Counter(r["batch"] for r in fasta.batches(x, 300).collect()) == {**{i: 300 for i in range(6)}, 6: 200}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    fasta.write(x.where("record_index < 5"), str(tmp_path / "out"), 10)
    again = fasta.scan(spark, str(tmp_path / "out"))
    assert sorted(r["sequence"] for r in again.collect()) == sorted("ACGT" * (i + 1) for i in range(5))


def test_headers(spark):
    h = "SRR26872904.1 LH00271:11:225VV3LT3:5:1101:23320:1032 length=151"
    x = spark.createDataFrame([(h,), ("contig_1 len=500",)], "header string").select(*[c.alias(k) for k, c in S.header_fields(F.col("header")).items()], S.accession(S.seq_id(F.col("header"))).alias("accession"))
    a, b = x.collect()
    assert (a["instrument"], a["flowcell"], a["lane"], a["tile"], a["x"], a["y"], a["declared_length"], a["accession"]) == ("LH00271", "225VV3LT3", 5, 1101, 23320, 1032, 151, "SRR26872904")
    assert all(b[k] is None for k in ("lane", "tile", "x", "y", "declared_length", "instrument"))


@pytest.mark.parametrize(
    "seq,cfg,reason,kept",
    [
        ("ACGTNACGTACGTACGT", {}, 0, "ACGTACGTACGT"),
        ("NNACGTNACGTNN", {"ambiguity_policy": "trim_ends", "max_ambiguous_fraction": None}, 0, "ACGTNACGT"),
        ("ACGTNACGTACGTACGT", {"ambiguity_policy": "reject"}, 6, ""),
        ("ACGTNACGTACGTACGT", {"ambiguity_policy": "keep"}, 0, "ACGTNACGTACGTACGT"),
        ("ACGTXACGTACGT", {}, 4, ""),
        ("", {}, 1, ""),
        ("ACGT", {}, 2, ""),
        ("ACGTACGTACGT", {"max_length": 11}, 3, ""),
        ("ACGTACGTNNNN", {}, 5, ""),
        ("A" * 50, {"max_single_base_fraction": 0.9}, 8, ""),
        ("ACGTACGTACGT", {"min_gc": 0.6}, 9, ""),
        ("ACGTACNACGTAC", {"min_effective_length": 10}, 7, "ACGTAC"),
        ("acgtacgtacgt", {}, 0, "ACGTACGTACGT"),
    ],
)
def test_quality_control(spark, seq, cfg, reason, kept):
    c = qc.QCConfig(**({"min_length": 10, "min_effective_length": 5, "max_single_base_fraction": None} | cfg))
    r = qc.evaluate(frame(spark, [seq]), c, True).first()
    assert (r["qc_reason"], r["qc_sequence"], r["qc_pass"]) == (reason, kept, reason == 0)
    assert r["ambiguous_positions"] == [i for i, b in enumerate(seq.upper()) if b in c.ambiguity_codes]


def test_quality_control_settings(spark):
    assert qc.QCConfig.from_dict({"min_length": 3, "other": 1}).min_length == 3
    with pytest.raises(ValueError):
        qc.QCConfig(ambiguity_policy="guess")
    assert one(qc.evaluate(frame(spark, ["GGCCAATTNN"]), qc.QCConfig(min_length=5)), "gc_content") == 0.5
    reads = frame(spark, ["ACGT" * 40, None]).withColumn("header", F.lit("r LH:1:F:2:3:4:5 length=160"))
    m = qc.metadata(reads)
    assert m.columns[:4] == ["record_index", "seq_id", "raw_length", "effective_length"] and len(m.columns) == 14 and m.count() == 2


def test_reverse_complement_and_canonical_form(spark):
    for s in ("ACGT", "ACGT" * 30, "AACCGGTT"):
        assert one(frame(spark, [s]), S.reverse_complement(F.col("sequence"))) == s
    assert one(frame(spark, ["AAAACCCC"]), S.reverse_complement(F.col("sequence"))) == "GGGGTTTT"


def test_dereplication_counts_and_ranks(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(30)]
    seqs = [p for i, p in enumerate(pool) for _ in range(i + 1)] + ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(50)]
    rng.shuffle(seqs)
    want = Counter(seqs)
    counts = variants.count_variants(frame(spark, seqs))
    v = variants.variant_table(counts).orderBy("rank").collect()
    assert {r["sequence"]: r["count"] for r in v} == want
    first = {s: i for i, s in reversed(list(enumerate(seqs)))}
    order = sorted(want, key=lambda s: (-want[s], first[s]))
    assert [r["sequence"] for r in v] == order and [r["rank"] for r in v] == list(range(1, len(order) + 1))
    top = variants.variant_table(counts, top=10, min_count=25).collect()
    assert [r["sequence"] for r in sorted(top, key=lambda r: r["rank"])] == [s for s in order[:10] if want[s] >= 25]
    rc = pool[0].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    both = frame(spark, [pool[0]] * 5 + [rc] * 3)
    assert variants.count_variants(both).count() == 2 and one(variants.count_variants(both, True), "count") == 8


def test_id_analysis_and_histograms(spark):
    rows = [(0, "a", 0.5, 1), (1, "a", 0.6, 1), (2, "b", 0.5, 1), (3, "c", 0.5, None), (9, "c", 0.5, None), (4, "d", 0.1, 2), (5, "d", 0.1, 3), (6, "d", 0.1, 2)]
    r = stats.read_id_analysis(spark.createDataFrame(rows, "record_index long, seq_id string, gc_content double, tile int")).first()
    assert (r["total_records"], r["unique_sequence_ids"], r["ids_occurring_more_than_once"], r["max_multiplicity"]) == (8, 4, 3, 3)
    assert r["fraction_of_repeats_adjacent_in_file"] == pytest.approx(2 / 3, abs=1e-6) and r["fraction_of_repeats_with_identical_gc"] == pytest.approx(2 / 3, abs=1e-6) and r["fraction_of_repeats_on_same_tile"] == 0.5
    h = stats.histogram_stats(spark.createDataFrame([(10, 1), (20, 2), (30, 1)], "value long, n long")).first()
    assert (h["median"], h["p25"], h["p75"], h["p99"], h["mean"], h["n"]) == (20, 10, 20, 30, 20.0, 4)


def test_pairs_are_greedy_neighbours(spark):
    x = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (4, "b"), (5, "c"), (6, "c"), (7, "c"), (8, "c"), (9, "c")], "record_index long, seq_id string").withColumn("sequence", F.lit("AAC"))
    got = sorted((r["pair_key"], r["mate"], r["record_index"]) for r in sampling.mate_pairs(x).collect())
    assert got == [(0, 1, 0), (0, 2, 1), (5, 1, 5), (5, 2, 6), (7, 1, 7), (7, 2, 8)]
    s = sampling.sample_pairs(x, 3, 2)
    assert sorted(r["row_pos"] for r in s.collect()) == [0, 1, 2, 3]
    assert {r["sequence"] for r in sampling.reverse_second_mates(sampling.mate_pairs(x)).where("mate = 2").collect()} == {"GTT"}


def test_systematic_sample_and_index(spark):
    x = frame(spark, ["A"] * 100).where("record_index % 3 <> 1")
    got = sampling.systematic_sample(x, 10).orderBy("row_pos").collect()
    order = [i for i in range(100) if i % 3 != 1]
    assert [r["record_index"] for r in got] == order[::6][:10]
    assert [r["idx"] for r in sampling.running_index(x, "record_index", 7).orderBy("record_index").collect()] == list(range(len(order)))


def test_split_is_proportional_and_repeats(spark):
    x = spark.createDataFrame([(i, i % 10 // 7) for i in range(500)], "id long, y long")
    a = sampling.stratified_split(x, "y", F.col("id")).collect()
    n = Counter((r["y"], r["split"]) for r in a)
    assert n[0, "train"] == 245 and n[1, "train"] == 105 and sum(n.values()) == 500
    assert sorted(map(tuple, a)) == sorted(map(tuple, sampling.stratified_split(x.repartition(7), "y", F.col("id")).collect()))
    assert sampling.min_class_size(x, "y", 200).select("y").distinct().count() == 1


def test_amplicon_ends(spark):
    rng = random.Random(2)
    tail = lambda: "".join(rng.choice("ACGT") for _ in range(60))
    seqs = ["AAGGGCACCACAAGAACG" + tail() for _ in range(60)] + ["CGGTCACGTTCGTTGCCT" + tail() for _ in range(40)]
    got = amplicon.end_groups(frame(spark, seqs)).orderBy("record_index").collect()
    assert [r["end"] for r in got] == [0] * 60 + [1] * 40
    far = amplicon.end_groups(frame(spark, seqs[:30] + ["T" * 18 + tail()] * 5 + ["AA"]), n_groups=1, max_mismatch=3).orderBy("record_index").collect()
    assert [r["end"] for r in far] == [0] * 30 + [-1] * 6
    assert {r["end"] for r in amplicon.end_groups(frame(spark, ["AC"])).collect()} == {-1}


def test_conservation_and_changepoint(spark):
    rng = random.Random(3)
    seqs = ["ACGTA" * 8 + "".join(rng.choice("ACGT") for _ in range(40)) for _ in range(200)]
    used = spark.createDataFrame([(0, s, 2) for s in seqs], "end int, sequence string, count long")
    prof = amplicon.profile(used, 80)
    cut = amplicon.changepoint(prof).first()
    assert cut["position"] == 40 and cut["before"] == 1.0 and one(amplicon.consensus(prof), "consensus").startswith("ACGTA" * 8)
    empty = amplicon.profile(spark.createDataFrame([(0, "NN", 2)], "end int, sequence string, count long"), 2).orderBy("pos").collect()
    assert [(r["base"], r["conservation"]) for r in empty] == [("A", 0.0), ("A", 0.0)]
    pairs = spark.createDataFrame([("AAACGT", 0, 1), ("AAACGT", 0, 2), ("AC", 0, 1), ("ACGT", -1, 1)], "sequence string, end int, mate int")
    got = [r["sequence"] for r in amplicon.variable_region(pairs, spark.createDataFrame([(0, 3)], "end int, position long")).collect()]
    assert sorted(got) == sorted(["CGT", "ACG", "AC", "ACGT"])


def test_kmers(spark):
    assert [len(kmer.vocabulary(k)) for k in (2, 3, 4)] == [10, 32, 136]
    assert [r["kmer"] for r in kmer.vocabulary_table(spark, 3).orderBy("idx").collect()] == list(kmer.vocabulary(3))
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGT") for _ in range(151)) for _ in range(25)] + ["ACGT" * 40, "ACGTACGTNACGTACGTACGT", "NN", ""]
    e = kmer.KmerEncoder(3)
    v = e.encode_batch(seqs)
    rel = {(r["record_index"], r["kmer"]): r["frequency"] for r in kmer.frequencies(frame(spark, seqs), "record_index", 3).collect()}
    for i in range(len(seqs)):
        for j, w in enumerate(kmer.vocabulary(3)):
            assert v[i, j] == pytest.approx(rel.get((i, w), 0.0), abs=1e-6)
    flip = [s.translate(str.maketrans("ACGT", "TGCA"))[::-1] for s in seqs]
    assert abs(v - e.encode_batch(flip)).max() < 1e-6
    plain = kmer.KmerEncoder(3, canonical=False)
    assert plain.dim == 64 and abs(plain.encode_batch(seqs[:25]) - plain.encode_batch(flip[:25])).max() > 0.01
    assert kmer.build_encoder("kmer", k=2, include_gc=True, include_length=True).dim == 12
    with pytest.raises(ValueError):
        kmer.build_encoder("unknown")
    got = [r["v"] for r in frame(spark, seqs).select("record_index", kmer.encode(F.col("sequence"), e).alias("v")).orderBy("record_index").collect()]
    assert abs(v - got).max() < 1e-6
    assert one(frame(spark, ["ACGTACGTN"]), S.word_set(F.col("sequence"), 4)) == ["ACGT", "CGTA", "GTAC", "TACG"]


def test_store_resumes_by_id(spark, tmp_path):
    subset = frame(spark, ["ACGTAC", "GGGTTT", "CCCAAA"])
    s = store.EmbeddingStore(spark, str(tmp_path / "e"), kmer.KmerEncoder(2).dim)
    assert s.n_committed() == 0
    assert store.extract(subset.limit(2), kmer.KmerEncoder(2), s)["rows"] == 2
    assert s.missing(subset).count() == 1
    got = store.extract(subset, kmer.KmerEncoder(2), s)
    assert {k: got[k] for k in ("encoder", "dim", "rows", "failed", "written", "restarted")} == {"encoder": "kmer2", "dim": 10, "rows": 3, "failed": 0, "written": 1, "restarted": False}
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([("x", [1.0])], "sequence_id string, embedding array<float>"))
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([("x", [1.0] * 10)] * 2, "sequence_id string, embedding array<float>"))
    assert store.load(spark, s.path, spark.createDataFrame([("r0",)], "sequence_id string")).count() == 1


def test_label_and_taxonomy_files(spark, tmp_path):
    with gzip.open(tmp_path / "t.tsv.gz", "wt") as f:
        f.write("A1\tx;y;;\nA2\tz\nA1\tw;v;\n\nA3\n")
    assert {r["accession"]: r["taxonomy"] for r in tables.load_taxonomy(spark, str(tmp_path / "t.tsv.gz")).collect()} == {"A1": "w;v", "A2": "z", "A3": ""}
    (tmp_path / "l.csv").write_text("read,taxon\n# no\n\nr1,A\nr2,B\nr1,C\nshort\n")
    assert {r["read_id"]: r["taxon"] for r in tables.load_labels(spark, str(tmp_path / "l.csv")).collect()} == {"r1": "C", "r2": "B"}
    (tmp_path / "l.json").write_text(json.dumps({"r1": "A"}))
    (tmp_path / "l.tsv").write_text("read\ttaxon\nr1\tBacteria, uncultured\nr2,x\n")
    assert {tuple(r) for r in tables.load_labels(spark, str(tmp_path / "l.tsv")).collect()} == {("r1", "Bacteria, uncultured")}
    assert [tuple(r) for r in tables.load_labels(spark, str(tmp_path / "l.json")).collect()] == [("r1", "A")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(f">a\n{'ACGT' * 30}\n>b\n{'ACGT' * 30}\n>c\nAC\n")
    ingest.metadata_sink(ingest.read_folder(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in" / "b.fasta").write_text(f">d\n{'TTGCA' * 30}\n")
    ingest.metadata_sink(ingest.read_folder(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r["seq_id"], r["qc_reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 0), ("b", 0), ("c", 2), ("d", 0)]
    q = ingest.variant_counts(ingest.read_folder(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("variants").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["count"] for r in spark.table("variants").collect()) == [1, 2]


def test_canonical_table_has_all_repeated_variants(spark, tmp_path):
    spark.range(36_000).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    want = Counter(min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))) for s in (r["sequence"] for r in queries._passed(spark, str(tmp_path)).select("sequence").collect()))
    got = queries.QUERIES["dereplicate_canonical"](spark, str(tmp_path)).collect()
    repeated = {s: n for s, n in want.items() if n >= 2}
    assert len(repeated) > 500 and {r["sequence"]: r["count"] for r in got} == repeated
    assert sorted(r["rank"] for r in got) == list(range(1, len(repeated) + 1)) and all(r["variant_id"] == r["rank"] - 1 for r in got)


def test_settings():
    assert parse_override("qc.min_length=5") == ("qc.min_length", 5) and parse_override("a=b") == ("a", "b")
    assert load_config(None, ["qc.min_length=5"])["qc"]["min_length"] == 5 and load_config()["qc"]["min_length"] == 100
    with pytest.raises(ValueError):
        parse_override("x")


def test_token_fit_measures_every_read(spark):
    df = spark.createDataFrame([("ACGTAC",), ("ACN",), (None,)], "sequence string")
    three = lambda seqs: [[0 if "N" in s[i : i + 3] else 1 for i in range(0, len(s), 3)] for s in seqs]
    x = kmer.token_fit(df, three, 4, unknown=0)
    assert x == {"reads": 3, "bp_min": 0, "bp_max": 6, "tokens_min": 0, "tokens_max": 2, "tokens_mean": 1.0, "bp_per_token": 3.0, "unknown_tokens": 1, "token_limit": 4, "limit_used": 0.5}
    with pytest.raises(ValueError, match="2 tokens"):
        kmer.token_fit(df, three, 1)
    assert kmer.token_fit(df.where("false"), three, 4)["tokens_max"] is None


def test_kmer_frequencies_by_read(spark):
    seqs = {1: "ACGTACGTNACG", 2: "", 3: None, 4: "AC", None: "GGGTTTacgCCC", 2**60 + 1: "ACGT" * 9000}
    df = spark.createDataFrame(list(seqs.items()), "read long, sequence string")
    flip = str.maketrans("ACGT", "TGCA")
    for k, canonical in ((3, True), (3, False), (31, True)):
        want = {}
        for key, s in seqs.items():
            words = [w for w in ((s or "")[i : i + k] for i in range(len(s or "") - k + 1)) if set(w) <= set("ACGT")]
            words = [min(w, w.translate(flip)[::-1]) for w in words] if canonical else words
            want |= {(key, w): words.count(w) / len(words) for w in set(words)}
        assert {tuple(r)[:2]: r["frequency"] for r in kmer.frequencies(df, "read", k, canonical).collect()} == pytest.approx(want)


def test_reads_are_dealt_to_as_many_tasks_as_they_need(spark):
    from strandloom.plans import reads

    few = spark.range(0, 1000, 1, 2)
    assert reads.spread(few, 50).rdd.getNumPartitions() == 20 and reads.spread(few, 10**6).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_vocabulary_counts_come_from_the_reads(spark):
    got = {r["kmer"]: r["n"] for r in kmer.vocabulary_counts(frame(spark, ["AAC", "GTT", "ANAAC", ""]), 2).collect()}
    assert len(got) == 10 and got["AA"] == 3 and got["AC"] == 3 and sum(got.values()) == 6
    assert kmer.vocabulary_counts(frame(spark, ["AC"]).limit(0), 2).agg({"n": "sum"}).first()[0] == 0

"""Quality statistics against a plain reading of each text, and decision lists against what they must learn."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import quality
from strandloom.llm.toxicity import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, _statistics string, n_words long"


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    near = sum(any(w[j] == x for j in range(max(0, i - 16), i)) for i, x in enumerate(w))
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_near_words": near, "n_top_word": max(Counter(w).values(), default=0), "n_upper": sum("A" <= c <= "Z" for c in t), "n_digits": sum("0" <= c <= "9" for c in t), "n_stops": sum(c in ".!?" for c in t),
    }


def prose(rng, n, sep=" "):
    return sep.join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    line = prose(rng, 9)
    out = [None, "", " \t\n\r ", "one", line, "\n".join([line] * 4), f"{line}\n\n \n{line} \n{line}\r\n{line}", "Naïve café ☃ \U0001f600 #1 <b> " * 9, prose(rng, 30_000), " ".join(["spam"] * 40), "A\x0bb\x0cc a\xa0b c " * 5, "x" * 300_000, "\n" * 50]
    for _ in range(80):
        parts = [prose(rng, rng.randint(1, 40), rng.choice([" ", "  ", "\n", " \n"])) for _ in range(rng.randint(1, 5))]
        out.append("\n".join(parts + parts[: rng.randint(0, 2)]).replace("s ", rng.choice(["s. ", "s# ", "S9 ", "s "])))
    return out


def test_statistics_equal_a_plain_reading(spark, texts):
    rows = [(i, t, "en", "x", 7) for i, t in enumerate(texts)] + [(None, texts[4], None, None, None)] * 2
    out, name = quality.measure(spark.createDataFrame(rows, DOCS))
    assert name == "__statistics" and out.columns == ["doc_id", "text", "lang", "_statistics", "n_words", name]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want, s = plain(r["text"]), r[name].asDict()
        assert {k: s[k] for k in want} == want, r["text"][:80]
        for share, (a, b) in quality.SHARES.items():
            assert s[share] == pytest.approx(want[a] / want[b] if want[b] else 0)
    assert quality.measure(spark.createDataFrame([], DOCS))[0].count() == 0


def test_lists_learn_conjunctions_and_ignore_chance():
    rng = np.random.default_rng(4)
    x = {s: rng.random(3000) for s in quality.STATISTICS}
    bad = ((x["symbols"] > 0.7) & (x["upper"] < 0.4)) | (x["digits"] > 0.9)
    flipped = bad ^ (rng.random(3000) < 0.02)
    rules = quality.learn(x, ~flipped)
    assert rules.default and all(not r.verdict for r in rules.rules)
    fresh = {s: rng.random(5000) for s in quality.STATISTICS}
    bad = ((fresh["symbols"] > 0.7) & (fresh["upper"] < 0.4)) | (fresh["digits"] > 0.9)
    assert (rules.decide(fresh) == ~bad).mean() > 0.97
    noise = quality.learn(x, rng.random(3000) < 0.8)
    assert noise.decide(fresh).mean() > 0.95
    assert quality.learn(x, ~flipped) == rules


def test_lists_of_one_kind_or_none():
    empty = {s: np.zeros(0) for s in quality.STATISTICS}
    some = {s: np.arange(9.0) for s in quality.STATISTICS}
    assert quality.learn(empty, np.zeros(0, bool)) == quality.DecisionList((), True)
    assert quality.learn(some, np.ones(9, bool)).default and not quality.learn(some, np.zeros(9, bool)).default
    mostly = {s: np.concatenate([np.zeros(40), np.ones(60)]) for s in quality.STATISTICS}
    kept = mostly["symbols"] == 0
    assert (quality.learn(mostly, kept).decide(mostly) == kept).all() and not quality.learn(mostly, kept).default


def test_expression_decides_as_the_list(spark, texts):
    c = quality.Condition
    rules = quality.DecisionList((quality.Rule((c("symbols", True, 0.02), c("n_words", False, 60)), False), quality.Rule((c("upper", True, 0.01),), True), quality.Rule((c("stops", False, 0.001),), False)), True)
    out, of = quality.measure(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = out.select(f"{of}.*", rules.column(of).alias("kept"), rules.reason(of).alias("why")).collect()
    want = rules.decide({s: np.array([r[s] for r in got], float) for s in quality.STATISTICS})
    assert [r["kept"] for r in got] == want.tolist() and {None, "drop if symbols >= 0.02 and n_words <= 60"} <= {r["why"] for r in got}
    assert out.select(quality.DecisionList().column(of).alias("k")).distinct().collect()[0]["k"] is True


def test_query_and_filter(spark, tmp_path):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(w + "###" if bad else w for w in prose(rng, rng.randint(25, 90)).split())
        docs.append((i, text, "en", "x", 7))
        if i % 3:
            labels.append((i, int(not bad), 0))
    docs += [(None, "few words", None, None, None), (9999, None, None, None, None), (3, docs[3][1], "en", "x", 7)]
    labels += [(1, None, 0), (None, 0, 0), (2, 1, 0), (5, 1, 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op12_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(next(t for i, t, *_ in docs if i == r["doc_id"]))
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert r["base_failed"] == failed and all(r[k] == want[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["kept"] == (not failed and r["doc_id"] % 5 != 0)
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.read.parquet(str(tmp_path / "labels.parquet"))
    kept = quality.accepted(df, marks)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    held = {r["doc_id"] for r in df.where(fold(df.doc_id) == 0).collect()}
    wrong = marks.collect()
    swapped = spark.createDataFrame([(r["doc_id"], 1 - r["quality"] if r["doc_id"] in held and r["quality"] is not None else r["quality"], 0) for r in wrong], marks.schema)
    assert quality.judged(df, swapped)[2] == quality.judged(df, marks)[2]  # held-out labels are not learned from
    assert quality.accepted(df, marks.limit(0)).count() == sum(not r["base_failed"] for r in got)
    assert quality.accepted(df.limit(0), marks).count() == 0

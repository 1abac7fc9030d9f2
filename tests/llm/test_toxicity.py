"""Clauses read plainly, word by word, against the composed transducers; weights that keep the grammar's order."""

import random
import re

import numpy as np

from strandloom.llm import toxicity as T

INSULTS = {"grobnik": 5.0, "zorp*": 4.0, "blat": 3.0}


def weight(word):
    return max([INSULTS.get(word, 0.0), *(w for s, w in INSULTS.items() if s.endswith("*") and word.startswith(s[:-1]))])


def plain(text):
    """(kind, heaviest, total) of each clause that matches, in order."""
    out = []
    for clause in re.split(r"[.!?;:\n]+", text.lower()):
        tokens = re.findall(r"\w+(?:'\w+)?|[\"“”„«»]", clause)
        quoted = told = target = False
        since, found, weights = 99, set(), []
        for t in tokens:
            if t in "\"“”„«»":
                quoted = not quoted
                continue
            w = weight(t)
            kind = "insult" if w else "threat" if t in T.THREAT else None
            if kind:
                weights.append(w or T.THREAT_WEIGHT)
                # of three words after a negation; insults and threats do not use up its reach
                found.add("negated" if since < 3 else "reported" if told or quoted else kind)
                continue
            since = 0 if t in T.NEGATION and t not in T.TARGET else since + 1
            told |= t in T.REPORTED and t not in T.TARGET and t not in T.NEGATION
            target |= t in T.TARGET
        part = next((k for k in ("insult", "threat", "reported", "negated") if k in found), None)
        kind = {"insult": "targeted" if target else "plain", "threat": "threat" if target else None}.get(part, part)
        if kind:
            out.append((kind, max(weights), sum(weights)))
    return out


def test_clauses_equal_a_plain_reading():
    rng = random.Random(7)
    scorer = T.Scorer(INSULTS)
    words = ["grobnik", "zorpling", "zorp", "blat", "blatant", "you", "he", "not", "never", "said", "called", "kill", "hurt", "the", "house", "skill", '"', "«", "»", ".", "!", ":", "\n", "don't", "très", "zor"]
    seen = set()
    for _ in range(4000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        got, want = scorer.matched(text), plain(text)
        assert [(k, w, round(t, 9)) for k, w, t in got] == [(k, w, round(t, 9)) for k, w, t in want], text
        seen |= {k for k, *_ in got}
    assert seen == {"targeted", "plain", "threat", "negated", "reported"}


def test_weights_keep_the_order_of_the_grammar():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(4000, len(T.PRIOR))))
    x[:, 2] = x[:, 4] = 0  # nothing is told of threats and reported speech
    truth = np.array([1.0, 0.8, 0, 2.0, 0, -1.0, 0.5, 0.7])  # negated raises and the heaviest lowers, which the grammar forbids
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ truth - 3)))).astype(float)
    w = dict(zip(["bias", *(p[0] for p in T.PRIOR)], T._logistic(x, y)))
    assert w["threats"] == 3.0 and w["reported"] == -0.1 and w["negated"] == 0.0 and w["heaviest"] == 0.0
    assert w["insults"] > 0.3 and w["targeted"] > 0.3 and w["dense"] > 0.2
    for name, _, low, high in T.PRIOR:
        assert low <= w[name] <= high


def test_lexicon_has_no_nested_beginnings():
    odds = {"grob*": 5.0, "grobn*": 5.1, "grobni*": 5.6, "grobnik": 5.6, "blat": 2.5, "blat*": 1.0, "low": 1.9, "zorp*": 3.0, "zorpling": 3.2}
    assert T.lexicon(odds) == {"grob*": 5.0, "grobni*": 5.6, "blat": 2.5, "zorp*": 3.0}


def test_scores_follow_the_grammar():
    weights = [-4.0, *(p[1] for p in T.PRIOR)]
    score = lambda t: weights[0] + float(np.array(T.Scorer(INSULTS).features(t)) @ np.array(weights[1:]))
    clean = score("The house stands.")
    assert score("I will kill you.") > clean and score("You are a grobnik.") > score("The grobnik left.") > clean
    assert score("You are not a grobnik.") <= clean and score("He said you are a grobnik.") <= clean

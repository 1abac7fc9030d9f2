"""Conversation repair against a plain search over edits, row by row."""

import random
import re
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest

from strandloom.llm import turns

CONVS = "conv_id long, turn long, role string, text string, place long, g string, cost string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range((kind != 0) + (kind == 3)):
            yield conv, turn, "user" if kind == 4 else role, text


def legal(state, initial):
    """The automaton of (s?(ua)+)?: the next state, or None."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired rows) of one conversation's damaged rows, in order."""
    from hashlib import md5

    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        ink = INK.findall(text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts):
        """(cost, audit, rows) from row i on."""
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))
        if inserts < 3:
            for name in ("user", "assistant"):
                if to := legal(state, name[0]):
                    c, a, r = best(i, to, inserts + 1)
                    out.append((c + 2, "I" + a, (f"{name}:", *r)))
        if i < len(rows):
            c, a, r = best(i + 1, state, 0)
            out.append((c + 3, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                for letter, name in (("K", rows[i][2]), ("R", "user"), ("R", "assistant")):
                    if to := legal(state, name[:1]):
                        c, a, r = best(i + 1, to, 0)
                        out.append((c + (faults[i] == "truncated") + 2 * (letter == "R"), letter + a, (f"{name}:{rows[i][3]}", *r)))
        return min(out, default=(10**9, "", ()))

    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = best(0, "", 0)
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    texts = ["Fine.", "Cut off", "What? ", "", " \t", "Yes!\n", "Fine.", "Äh…", None, "a\xa0"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Uther", "a"]
    for conv in range(120):
        for t in range(rng.randint(1, 14)):
            clean = rng.random() < 0.6
            out.append((conv, t + (rng.random() < 0.1), ["user", "assistant"][t % 2] if clean else rng.choice(roles), f"Text {rng.randint(0, 99)}." if clean else rng.choice(texts), 1, "x", "y"))
    out += [(None, None, "user", "Hi.", None, None, None), (None, 3, "system", "Be.", None, None, None), (None, None, None, None, None, None, None), (500, None, "assistant", "A.", 1, "x", "y"), (500, None, "assistant", "A.", 1, "x", "y")]
    out += [(501, t, ["user", "assistant"][t % 2], f"word{t}. " * (20_000 if t == 1 else 1), 1, "x", "y") for t in range(2)]
    out += [(600, 5 * t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"Other {t}.", f"Other {t}"]), 1, "x", "y") for t in range(150)]
    out += [(c, t, "user", "x.", 1, "x", "y") for c in range(700, 760) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    return out


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    return {c: brute(rs) for c, rs in by.items()}


def test_damage(spark, rows):
    got = turns.damage(spark.createDataFrame(rows, CONVS))
    assert got.columns == ["conv_id", "turn", "role", "text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, damaged(rows)))


@pytest.mark.parametrize("segment,flush", [(1024, 1 << 15), (1024, 50), (4, 1 << 15), (1, 64), (3, 20)])
def test_edits_equal_a_plain_search(spark, rows, segment, flush, monkeypatch):
    monkeypatch.setattr(turns, "FLUSH_ROWS", flush)
    df = turns.damage(spark.createDataFrame(rows, CONVS).repartition(4))
    want = expected(rows)
    got = {r["g"]: tuple(r)[1:] for r in turns.digest(turns.repair(df, segment)).collect()}
    for conv, (*figures, out) in want.items():
        key = "" if conv is None else f"={conv}"
        if out or figures[-1] or any(figures[:5]):
            assert got[key] == (*figures, sha256("\n".join(out).encode()).hexdigest()), conv
        else:
            assert key not in got or got[key][:6] == tuple(figures[:6])


def test_query_returns_every_conversation(spark, rows, tmp_path):
    spark.createDataFrame(rows, CONVS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: (*x[:-1], sha256("\n".join(x[-1]).encode()).hexdigest()) for c, x in expected(rows).items()}
    assert got == want and sum(x == (0, 0, 0, 0, 0, 0, "", sha256().hexdigest()) for x in got.values()) >= 1


def test_repaired_rows_are_sound(spark, rows):
    edits = turns.repair(spark.createDataFrame(rows, CONVS))
    out = {}
    for r in sorted(turns.repaired(edits).collect(), key=lambda r: (r["place"], r["part"])):
        out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append((r[0], r[1], *(" " if x is None else x for x in r[2:4])))
    for conv, x in out.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in x)), conv
        assert tuple(f"{r}:{t}" for r, t in x) == brute(want[conv])[-1]
    empty = turns.repair(spark.createDataFrame([], CONVS))
    assert empty.count() == 0 and turns.digest(empty).count() == 0 and turns.repaired(empty).count() == 0


def test_tensors_pad_without_cost():
    rng = np.random.default_rng(1)
    n, t = 40, 9
    one = turns.Tensors(rng.integers(0, 4, (t, n)), rng.random((t, n)) < 0.2, rng.random((t, n)) < 0.3, np.zeros((t, n), bool))
    two = turns.Tensors(*(np.concatenate([x, np.full((5, n), fill, x.dtype)]) for x, fill in ((one.initial, 3), (one.forced, 0), (one.truncated, 1), (one.absent, 1))))
    end = np.tile(turns.END, (n, 1))
    assert (one.backward(end)[0] == two.backward(end)[0]).all()
    for a, b in zip(one.trace(one.backward(end), np.zeros(n, int))[:3], two.trace(two.backward(end), np.zeros(n, int))[:3]):
        assert (a == b[:t]).all() and not b[t:].any()

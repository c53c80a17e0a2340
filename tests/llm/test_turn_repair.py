import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pyarrow.parquet as pq
import pytest
from llm_cases import LONG, SF_MID

from panelkit.llm import turn_repair as T

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def best(turns):
    """Least (cost, audit) by walking the grammar as an automaton. ``turns``:
    (initial, must go, truncated)."""
    n = len(turns)

    @lru_cache(None)
    def go(i, state, inserts):
        found = [(0, "")] if i == n and state in ("", "a") else []
        if inserts < 4:
            for c, to in NEXT[state].items():
                if c != "s":
                    cost, rest = go(i, to, inserts + 1)
                    found.append((cost + 2, "I" + rest))
        if i < n:
            c, must, cut = turns[i]
            cost, rest = go(i + 1, state, 0)
            found.append((cost + 3, "D" + rest))
            if not must:
                for want, to in NEXT[state].items():
                    cost, rest = go(i + 1, to, 0)
                    if c == want:
                        found.append((cost + cut, "K" + rest))
                    if want != "s":
                        found.append((cost + 2 + cut, "R" + rest))
        return min(found, default=(1 << 40, ""))

    return go(0, "", 0)


def code_of(turns):
    return "".join("x" if must else (c if c in "sua" else "o").upper() if cut else c if c in "sua" else "o" for c, must, cut in turns)


@pytest.mark.parametrize("size, tries, faults", [(7, 3000, 0.3), (40, 150, 0.2), (3, 400, 0.6)])
def test_alignment_is_least_in_cost_and_audit(size, tries, faults):
    rnd = random.Random(size)
    for _ in range(tries):
        n = rnd.randrange(0, size + 1)
        turns = []
        for i in range(n):
            c = "ua"[i % 2] if rnd.random() > faults else rnd.choice("suasot")
            turns.append((c, rnd.random() < faults / 2, rnd.random() < faults / 2))
        assert T.align(code_of(turns)) == best(turns), turns


@pytest.mark.parametrize("size, tries, faults", [(9, 4000, 0.25), (9, 1500, 0.6), (40, 150, 0.2)])
def test_pieces_add_up_to_the_whole(monkeypatch, size, tries, faults):
    monkeypatch.setattr(T, "WHOLE", 0)
    rnd = random.Random(size + 1)
    cut = 0
    for _ in range(tries):
        turns = []
        for i in range(rnd.randrange(0, size + 1)):
            c = "ua"[i % 2] if rnd.random() > faults else rnd.choice("suasot")
            turns.append((c, rnd.random() < faults / 2, rnd.random() < faults / 2))
        assert T.align(code_of(turns)) == best(turns), turns
        cut += len(list(T.kept_answers(code_of(turns))))
    assert cut > tries / 4


def test_incumbent_is_never_below_the_least():
    rnd = random.Random(1)
    for _ in range(2000):
        code = "".join(rnd.choice("uasoUASOx") for _ in range(rnd.randrange(0, 9)))
        assert T.incumbent(code) >= T.align(code)[0]


def test_long_conversation_in_blocks(monkeypatch):
    sys.setrecursionlimit(10_000)
    rnd = random.Random(9)
    turns = [("ua"[i % 2] if rnd.random() > 0.1 else rnd.choice("suao"), rnd.random() < 0.05, rnd.random() < 0.05) for i in range(230)]
    want = best(turns)
    assert T.align(code_of(turns)) == T._align(code_of(turns), True) == want
    monkeypatch.setattr(T, "BLOCK", 3)
    assert T.align(code_of(turns)) == T._align(code_of(turns), True) == want


def plain(rows):
    """The contract on one conversation's rows (turn, role, text), after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, turns, count = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    ids = [t for t, *_ in rows if t is not None]
    gaps = max(ids) - min(ids) + 1 - len(set(ids)) if ids else 0
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    cost, audit = best(turns)
    out, want, i = [], "user", 0
    for op in audit:
        if op in "IR":
            out.append(want + ":" + (rows[i][2] if op == "R" else ""))
        elif op == "K":
            out.append(rows[i][1] + ":" + rows[i][2])
        if op != "D" and not (op == "K" and first[i] == "s"):
            want = "assistant" if want == "user" else "user"
        i += op != "I"
    text = "\n".join(out)
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


def broken(rows):
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        yield conv, [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def brute(rows):
    convs = {}
    for conv, made in broken(rows):
        convs.setdefault(conv, []).extend(made)
    return {conv: plain(made)[0] for conv, made in convs.items()}


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, None, "system", "Be kind."), (1, 1, "assistant", "Yes!"), (1, 7, "user", "cut"),
    (2, 0, None, None), (2, 1, "user", " \t\x0b"), (3, None, "tool", "x."), (3, None, "tool", "x."),
    (None, 0, "user", "a?"), (None, 3, "", "b."), (4, 0, "system", "only a system turn."), (5, 2, "user", LONG), (5, 3, "assistant", "é."),
] + [(100 + i, 0, "user", f"{i}.") for i in range(60)] + [(6, 4, "user", "same.")] * 30


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(3) for c in ("conv", "sha", "copies", "kind", "facts", "audit")})


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_odd_rows_match_brute_force(spark):
    from pyspark.sql import functions as F

    got = result(T.repairs(T.damaged(frame(spark, ROWS)), copies=F.col("copies")))
    want = brute(ROWS)
    assert got == want
    empty = [k for k in want if want[k][6] == "" and want[k][5] == 0]  # every row dropped
    assert empty and all(want[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in empty)


def test_query_matches_brute_force(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF_MID}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = T.op13_turn_repair(spark, SF_MID)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert result(got) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "q?"), (1, 2, "user", "r?"), (1, 3, "assistant", "a."), (2, 0, "user", " ")]
    got = sorted(map(tuple, T.repaired_turns(frame(spark, rows)).collect()))
    assert got == [(1, 0, "K", "system", "S."), (1, 1, "K", "user", "q?"), (1, 2, "I", "assistant", ""),
                   (1, 3, "K", "user", "r?"), (1, 4, "K", "assistant", "a.")]


def test_empty_table(spark):
    assert T.repairs(frame(spark, [])).count() == 0
    assert T.repaired_turns(frame(spark, [])).count() == 0

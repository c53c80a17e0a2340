"""Conversation structure repair by Wagner-Fischer alignment of turns.

A conversation's turns are aligned to a target of alternating roles, the
grammar ``(s?(ua)+)?`` of role initials (system, user, assistant). Edits: Keep
a turn whose initial is the target's (0), Rerole it to user or assistant (2),
Delete it (3; the only edit of blank and duplicate turns), Insert an empty user
or assistant turn (2); a truncated turn that stays adds 1.

Method: all targets of one kind are ends of one alternating string, so one
matrix, filled from the last turn and the last role backwards, holds the costs
of every feasible length: cell (i, r) aligns the turns from i on to the last r
roles. A system turn in front consumes no role of the string and is tried at
every turn that can be reached by deletions. A one-pass repair gives an
incumbent cost. It bounds how far r can be from the number of turns left
(Ukkonen's band: a role too many costs 2, one too few 3), so only a band of
the matrix is filled, a diagonal strip of numpy rows. Lengths that reach the
least cost are backtraced forwards, ASCII-least edit first, and their audits
compared.

Size: a conversation is one sequence and its audit one string, so its slim
facts (a hash and a few bytes a row, equal rows counted map-side) meet in one
task. A long one is cut at assistant turns that every least-cost repair keeps,
so the band is as wide as the faults of one piece, and time is linear unless
faults follow each other without end; then it is turns x band (a strip row per
block of sqrt(n) turns is kept and the rest recomputed). Texts are never
gathered: they stream past the audit in turn order, and repaired turns or
their digest go out as they pass.

Order: by turn, nulls first; rows that share a turn by role, then SHA-256 of
the text. Cases: null role and text are read as one space, a null conversation
id is a conversation of its own; a turn is blank, else duplicate (its role and
text were seen earlier), else truncated, and one fault counts; repeated rows
are duplicates; an initial other than s, u, a can't be kept; ``gaps`` beyond
the largest long are the largest long; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import register, table

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
FAR = 1 << 30
WHITE = " \t\n\x0b\x0c\r"
LARGEST = (1 << 63) - 1
#: Turns whose strip rows are always kept together.
BLOCK = 256
#: Turns aligned without a look for places to cut.
WHOLE = 64
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# --- alignment of one conversation ------------------------------------------
# A code has a letter per turn: u, a, s or o (other), a capital if truncated,
# x if the turn must go.


def incumbent(code: str, first: bool = True) -> int:
    """Cost of a repair made in one pass, or of deleting every turn. ``first``:
    the turns open a conversation, so a system turn may stand in front."""
    cost, want, started = 0, "u", not first
    for c in code:
        if c == "x":
            cost += DELETE
            continue
        cost += CUT * c.isupper()
        role = c.lower()
        if role == "s" and not started:
            started, want = True, "u"
            continue
        if role in "ua" and role != want:
            cost += INSERT
        else:
            cost += REROLE * (role != want)
            want = "a" if want == "u" else "u"
        started = True
    if want == "a":
        cost += INSERT
    elif first and started and all(c in "xsS" for c in code):
        cost += 2 * INSERT
    return min(cost, DELETE * len(code))


class Strip:
    """Band of the matrix around the diagonal: row i holds r from left[i] - low on,
    left[i] the turns from i on that may stay."""

    def __init__(self, code: str, bound: int):
        self.code, n = code, len(code)
        slack = bound - DELETE * code.count("x")
        self.low, self.width = slack // DELETE, slack // DELETE + slack // INSERT + 1
        self.left = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            self.left[i] = self.left[i + 1] + (code[i] != "x")
        self.steps = INSERT * np.arange(self.width, dtype=np.int64)
        self.odd = (np.arange(self.width) - self.low) % 2 == 1
        self.block = max(BLOCK, isqrt(n))
        r = np.arange(self.width, dtype=np.int64) - self.low
        row = np.where(r >= 0, INSERT * r, FAR)
        self.ends = {n: row}  # rows kept: the last and the first of every block
        for i in range(n - 1, -1, -1):
            row = self.above(i, row)
            if i % self.block == 0:
                self.ends[i] = row

    def above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        c = self.code[i]
        if c == "x":
            return below + DELETE
        stay, role = CUT * c.isupper(), c.lower()
        odd = self.odd if self.left[i] % 2 == 0 else ~self.odd  # r odd: the role is an assistant's
        change = np.where(odd == (role == "a"), 0, REROLE) if role in "ua" else REROLE
        row = below + change + stay
        row[:-1] = np.minimum(row[:-1], below[1:] + DELETE)
        return np.minimum(np.minimum.accumulate(row - self.steps) + self.steps, FAR)

    def rows(self, start: int) -> list[np.ndarray]:
        """Rows of a block and the one behind it."""
        end = min(start + self.block, len(self.code))
        out = [self.ends[end]]
        for i in range(end - 1, start - 1, -1):
            out.append(self.above(i, out[-1]))
        return out[::-1]

    def at(self, i: int, row: np.ndarray, r: int) -> int:
        k = r - self.left[i] + self.low
        return int(row[k]) if 0 <= k < self.width else FAR


class Walker:
    """A least-cost alignment on its way through the strip."""

    def __init__(self, i: int, r: int, done: str):
        self.i, self.r, self.audit = i, r, [done]

    def pass_row(self, strip: Strip, i: int, row: np.ndarray, below: np.ndarray | None) -> None:
        """Edits up to the next turn, ASCII-least first."""
        here = strip.at(i, row, self.r)
        while True:
            if below is not None and strip.at(i + 1, below, self.r) + DELETE == here:
                self.audit.append("D")
                break
            if self.r and strip.at(i, row, self.r - 1) + INSERT == here:
                self.audit.append("I")
                self.r -= 1
                here -= INSERT
                continue
            if below is not None:
                self.audit.append("K" if strip.code[i].lower() == ("a" if self.r % 2 else "u") else "R")
                self.r -= 1
            break
        self.i = i + 1


def kept_answers(code: str) -> Iterator[int]:
    """Ends of the pieces that can be aligned on their own: turns of the
    assistant that every least-cost repair keeps. Costs of the best repair
    before and behind every turn, by what the grammar allows next (0 anything,
    1 a user after the system, 2 an assistant, 3 a user or the end), tell
    whether a repair without that Keep costs more."""
    n = len(code)
    behind = [array("q", [0]) * (n + 1) for _ in range(4)]
    h = (0, 2 * INSERT, INSERT, 0)
    for i in range(n, -1, -1):
        if i < n:
            c = code[i]
            h0, h1, h2, h3 = (x + DELETE for x in h)
            if c != "x":
                cut, role = CUT * c.isupper(), c.lower()
                user = h[2] + cut + (0 if role == "u" else REROLE)
                h0, h1, h3 = min(h0, user), min(h1, user), min(h3, user)
                h2 = min(h2, h[3] + cut + (0 if role == "a" else REROLE))
                if role == "s":
                    h0 = min(h0, h[1] + cut)
            h2 = min(h2, h3 + INSERT)
            h = (min(h0, h2 + INSERT), min(h1, h2 + INSERT), h2, min(h3, h2 + INSERT))
        for k in range(4):
            behind[k][i] = h[k]
    least = behind[0][0]
    g = (0, FAR, INSERT, 2 * INSERT)
    for i, c in enumerate(code):
        h0, h1, h2, h3 = (behind[k][i + 1] for k in range(4))
        cut, role = CUT * c.isupper(), c.lower()
        user = min(g[0], g[1], g[3]) + cut + (0 if role == "u" else REROLE)
        if role == "a" and min(g[0] + h0, g[1] + h1, g[2] + h2, g[3] + h3) + DELETE > least and user + h2 > least:
            yield i + 1
        g0, g1, g2, g3 = (x + DELETE for x in g)
        if c != "x":
            g3 = min(g3, g[2] + cut + (0 if role == "a" else REROLE))
            g2 = min(g2, user)
            if role == "s":
                g1 = min(g1, g[0] + cut)
        g2 = min(g2, min(g0, g1, g3) + INSERT)
        g = (g0, g1, g2, min(g3, g2 + INSERT))


def align(code: str) -> tuple[int, str]:
    """(least cost, ASCII-least audit of that cost). A long sequence is cut
    behind turns that every such audit keeps; the pieces' audits, none a prefix
    of another of its piece, add up to the whole one."""
    if len(code) <= WHOLE:
        return _align(code, True)
    cost, audit, start = 0, [], 0
    for end in (*kept_answers(code), len(code)):
        if end > start:
            c, a = _align(code[start:end], start == 0)
            cost, start = cost + c, end
            audit.append(a)
    return cost, "".join(audit)


def _align(code: str, first: bool) -> tuple[int, str]:
    n = len(code)
    strip = Strip(code, incumbent(code, first))
    starts = [(strip.at(0, strip.ends[0], r), 0, r, "") for r in _lengths(strip, 0, 0)]
    best = min((c for c, *_ in starts), default=FAR)
    for i0 in range(n if first else 0):  # a system turn in front, all before it deleted
        if DELETE * i0 > best:
            break
        if code[i0] in "sS":
            row = strip.rows((i0 + 1) // strip.block * strip.block)[(i0 + 1) % strip.block] if i0 + 1 < n else strip.ends[n]
            spent = DELETE * i0 + CUT * code[i0].isupper()
            starts += [(spent + strip.at(i0 + 1, row, r), i0 + 1, r, "D" * i0 + "K") for r in _lengths(strip, i0 + 1, 2)]
            best = min(c for c, *_ in [*starts, (best,)])
    walkers = [Walker(i, r, done) for c, i, r, done in starts if c == best]
    for start in range(0, n, strip.block):
        rows = strip.rows(start)
        for i in range(start, min(start + strip.block, n)):
            for w in walkers:
                if w.i == i:
                    w.pass_row(strip, i, rows[i - start], rows[i - start + 1])
    for w in walkers:
        w.pass_row(strip, n, strip.ends[n], None)
    return best, min("".join(w.audit) for w in walkers)


def _lengths(strip: Strip, i: int, least: int) -> range:
    """Feasible even numbers of roles from turn i on."""
    first = max(least, strip.left[i] - strip.low)
    return range(first + first % 2, strip.left[i] - strip.low + strip.width, 2)


_aligned = lru_cache(1 << 14)(align)


def aligned(code: str) -> tuple[int, str]:
    """Short conversations repeat, so their alignments are kept."""
    return _aligned(code) if len(code) <= WHOLE else align(code)


# --- facts of every conversation ---------------------------------------------


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None) -> DataFrame:
    text = F.coalesce(rows[text_col], F.lit(" "))
    return rows.select(rows[conv_col].cast("long").alias("conv"), rows[turn_col].cast("long").alias("turn"),
                       F.coalesce(rows[role_col], F.lit(" ")).alias("role"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
                       text.alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "sha")


class Facts:
    """What one conversation's turns, in order, add up to."""

    def __init__(self):
        self.code: list[str] = []
        self.turns: list = [None, None, 0]  # least, largest, different ones
        self.seen: set = set()
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last: str | None = None

    def add(self, turn: int | None, role: str, sha: bytes, blank: bool, cut: bool, copies: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        again = (role, sha) in self.seen
        self.seen.add((role, sha))
        first = role[:1]
        letter = first if first and first in "sua" else "o"
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            self.count[fault] += 1
        self.code.append("x" if blank or again else letter.upper() if cut else letter)
        # copies of a row stand behind it
        self.count["blank" if blank else "duplicate"] += copies - 1
        self.code.append("x" * (copies - 1))
        self.count["illegal"] += (self.last is not None and self.last + first not in ("su", "ua", "au")) \
            + (copies - 1)  # the same initial twice is never legal
        self.last = first

    def row(self, conv: int | None) -> tuple:
        cost, audit = aligned("".join(self.code))
        low, high, different = self.turns
        gaps = 0 if low is None else min(high - low + 1 - different, LARGEST)
        return (conv, gaps, *self.count.values(), cost, audit)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", *FACTS, "audit"]
    types = [pa.int64()] * 7 + [pa.string()]
    held, now = None, None

    def out(rows: list) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for batch in batches:
        done = []
        for conv, *rest in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "sha", "blank", "cut", "copies"))):
            if held is None or conv != now:
                if held is not None:
                    done.append(held.row(now))
                held, now = Facts(), conv
            held.add(*rest)
        yield out(done)
    if held is not None:
        yield out([held.row(now)])


def facts(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated,
    illegal, cost, audit."""
    tail = F.rtrim(F.col("text"), F.lit(WHITE))
    slim = turns.select("conv", "turn", "role", "sha", (tail == "").alias("blank"),
                        ~F.right(tail, F.lit(1)).isin(".", "!", "?"), "copies").toDF("conv", "turn", "role", "sha", "blank", "cut", "copies")
    counted = slim.groupBy("conv", "turn", "role", "sha", "blank", "cut").agg(F.sum("copies").alias("copies"))
    return _in_order(counted).mapInArrow(_facts, "conv long, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string")


# --- repaired turns -----------------------------------------------------------


class Editor:
    """Applies an audit to the turns that stream past."""

    def __init__(self, audit: str):
        self.audit, self.at, self.want = audit, 0, "user"

    def _turned(self) -> str:
        role, self.want = self.want, "assistant" if self.want == "user" else "user"
        return role

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield "I", self._turned(), ""

    def edit(self, role: str, text: str) -> Iterator[tuple]:
        """(edit, role, text) of the turns that this one becomes."""
        yield from self.inserted()
        what = self.audit[self.at]
        self.at += 1
        if what == "R":
            yield what, self._turned(), text
        elif what == "K":
            if role[:1] != "s":
                self._turned()
            yield what, role, text


def _marked(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's facts, then its turns in order."""
    none = F.lit(None)
    marks = found.select("conv", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("sha"),
                         F.col("audit").alias("text"), none.cast("long").alias("copies"), F.array(*FACTS).alias("facts"))
    rows = turns.select("conv", F.lit(1).alias("kind"), "turn", "role", "sha", "text", "copies", none.cast("array<bigint>").alias("facts"))
    return _in_order(marks.unionByName(rows), "kind").select("conv", "kind", "role", "text", "copies", "facts")


def _passing(batches: Iterator[pa.RecordBatch], start, put, end) -> Iterator[list]:
    """Run an editor over sorted turns. ``start(conv, facts, audit)`` opens a
    conversation's state, ``put(state, edited)`` takes its turns, ``end`` closes
    it; lists of what ``put`` and ``end`` return go out with every batch."""
    state = editor = None

    def close() -> list:
        left = [put(state, e) for e in editor.inserted()]
        return [x for x in (*left, end(state)) if x is not None]

    for batch in batches:
        out: list = []
        for conv, kind, role, text, copies, found in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if kind == 0:
                if editor is not None:
                    out += close()
                state, editor = start(conv, found, text), Editor(text)
                continue
            for _ in range(copies):
                out += [x for x in (put(state, e) for e in editor.edit(role, text)) if x is not None]
        yield out
    if editor is not None:
        yield close()


def _batch(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", *FACTS, "audit", "repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def start(conv, found, audit):
        return [conv, found, audit, hashlib.sha256(), b""]

    def put(state, edited):
        _, role, text = edited
        state[3].update(state[4] + f"{role}:{text}".encode("utf-8", "replace"))
        state[4] = b"\n"

    def end(state):
        return (state[0], *state[1], state[2], state[3].hexdigest())

    for rows in _passing(batches, start, put, end):
        yield _batch(rows, names, types)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["conv", "at", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def start(conv, found, audit):
        return [conv, -1]

    def put(state, edited):
        state[1] += 1
        return (*state, *edited)

    for rows in _passing(batches, start, put, lambda state: None):
        yield _batch(rows, names, types)


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """The repaired conversations: id, at (from 0), edit, role, text."""
    turns = _turns(rows, conv_col, turn_col, role_col, text_col, copies)
    return _marked(turns, facts(turns)).mapInArrow(_repaired, "conv long, at long, edit string, role string, text string") \
        .withColumnRenamed("conv", conv_col)


def repairs(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """One row per conversation: id, gaps, faults, cost, audit and the SHA-256
    of the repaired ``role:text`` lines. ``copies`` (default 1) says how often
    a row stands; a conversation whose rows all stand 0 times is empty."""
    turns = _turns(rows, conv_col, turn_col, role_col, text_col, copies)
    schema = "conv long, " + ", ".join(f"{c} long" for c in FACTS) + ", audit string, repaired_sha256 string"
    return _marked(turns, facts(turns)).mapInArrow(_digests, schema).withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults by crc32 of ``conv_id:turn`` modulo
    20: 0 drops the row (``copies`` 0), 1 empties its text, 2 removes its
    sentence ends, 3 repeats it (``copies`` 2), 4 makes it the user's."""
    def known(c: str) -> Column:
        return F.coalesce(rows[c].cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    return rows.select(
        rows["conv_id"], rows["turn"],
        F.when(kind == 4, F.lit("user")).otherwise(known("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text")).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


@register("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, edits and digest of every conversation, after planted damage."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repairs(rows, copies=F.col("copies"))

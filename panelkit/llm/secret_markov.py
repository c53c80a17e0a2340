"""Secret scans: pattern rules plus two character Markov models.

Base rules give ``assign``, ``access`` and ``hex`` spans. The method adds
``markov`` spans: runs of identifier characters whose log-likelihood ratio
between a model of random strings and a model of ordinary identifiers is high
enough, in total and per character, and that touch no base span.

Both models are first-order chains over ``ALPHABET`` with a border state,
add-``ALPHA`` smoothed, trained on labelled samples from every document: the
values that base rules find are random strings, all other text is ordinary.
Training adds up pair counts: numpy inside tasks, one small row set per task,
then a sum by (label, pair); the model has 2 x 69 x 69 cells whatever the
input. ``train`` takes any other labelled strings.

Offsets are code points of the whole text, end exclusive. Cases: a null text
is empty and has no span; the digest of no span is that of the empty string;
without samples both chains are uniform and nothing is added; rows are
independent, so ties, repeats and extra columns need nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import register, table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so as [0-9a-f]+ with 24 or more
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1  # state 0: the border, and every other character
CODES = bytes(ALPHABET.find(chr(b)) + 1 if b < 128 else 0 for b in range(256))
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHA = 0.5
MIN_TOTAL = 12.0  # nats over the whole run
MIN_MEAN = 1.5  # nats per character
MIN_DISTINCT = 8  # different characters; rulers and padding have fewer


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules; leftmost, not overlapping within
    a kind, failing matches dropped after they have been consumed."""
    out = []
    low = text.lower()  # only a gate: at least every A-Z is lowered
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def codes(text: str) -> np.ndarray:
    """State of every code point."""
    return np.frombuffer(text.encode("ascii", "replace").replace(b"?", b"\x00").translate(CODES), np.uint8)


def pair_counts(state: np.ndarray) -> np.ndarray:
    """Counts of (state, next state), with a border at both ends."""
    s = np.concatenate(([0], state, [0])).astype(np.int64)
    return np.bincount(s[:-1] * STATES + s[1:], minlength=STATES * STATES)


def sample_counts(text: str) -> tuple[np.ndarray | None, np.ndarray]:
    """(random, ordinary) pair counts: values of base spans against the rest."""
    state, spans = codes(text), base_spans(text)
    if not spans:
        return None, pair_counts(state)
    rest, random = state.copy(), np.zeros(STATES * STATES, np.int64)
    for start, end, kind in spans:
        rest[start:end] = 0
        value = ASSIGN.match(text, start)[2] if kind == "assign" else text[start:end]
        random += pair_counts(codes(value))
    return random, pair_counts(rest)


def train(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log-likelihood ratio of every pair, from labelled samples of all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, STATES * STATES), np.int64)
        for pdf in batches:
            for text in pdf["text"].fillna(""):
                random, ordinary = sample_counts(text)
                total[1] += ordinary
                if random is not None:
                    total[0] += random
        label, pair = np.nonzero(total)
        yield pd.DataFrame({"label": label, "pair": pair, "n": total[label, pair]})

    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "label int, pair int, n long")
    rows = counts.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()  # at most 2 * STATES**2
    n = np.zeros((2, STATES * STATES))
    for r in rows:
        n[r["label"], r["pair"]] = r["n"]
    return ratio(n[0], n[1])


def ratio(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(next | state) under ``random`` minus that under ``ordinary``."""
    logs = []
    for n in (random, ordinary):
        n = n.reshape(STATES, STATES) + ALPHA
        logs.append(np.log(n / n.sum(axis=1, keepdims=True)))
    return (logs[0] - logs[1]).ravel()


def score(value: str, llr: np.ndarray) -> float:
    """Log-likelihood ratio of a run, borders included."""
    s = np.concatenate(([0], codes(value), [0])).astype(np.int64)
    return float(llr[s[:-1] * STATES + s[1:]].sum())


def markov_spans(text: str, base: list, llr: np.ndarray) -> list[tuple[int, int, str]]:
    out = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if any(start < b and a < end for a, b, _ in base) or len(set(m[0])) < MIN_DISTINCT:
            continue
        s = score(m[0], llr)
        if s >= MIN_TOTAL and s >= MIN_MEAN * (end - start):
            out.append((start, end, "markov"))
    return out


def joined(spans: list) -> str:
    """kind:start:end, by start, then kind as listed in ``KINDS``."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(docs: DataFrame, id_col: str, text_col: str, llr: np.ndarray) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"].fillna(""):
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                             hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(base + markov_spans(text, base, llr))))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "id", pdf["id"].array)
            yield out

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string") \
        .withColumnRenamed("id", id_col)


@register("op10_secret_markov")
def op10_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, "doc_id", "text", train(docs, "text"))

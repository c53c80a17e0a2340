"""Token counts under a unigram tokenizer, by dynamic programming on a trie.

The distinct pre-tokens of a batch are inserted in a trie. Each trie node
holds the forward score of its prefix (the best total log-probability of any
split into vocabulary pieces) and the number of pieces of that split, so a
prefix that many pre-tokens share is computed
once. The end node of a pre-token gives its terminal count, kept per worker
for later batches. Tries and terminal tables are dropped when they pass their
bounds; that changes the time, not the counts.

The vocabulary is a public rank file; a piece of rank r has the Zipf
probability 1 / ((r + 1) H), H normalising over the file. All 256 bytes are
pieces, so every text has a split. Of equal scores the split with fewer pieces
wins.

Cases: null texts count as empty (all zero); very long pre-tokens get a
throw-away trie path; rows are independent, so ties, repeats, empty tables and
extra columns need nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.bpe_prefix import RANK_FILE, chunks, load_ranks
from panelkit.llm.common import register, table
from panelkit.llm.endings import Endings

MAX_NODES = 300_000
MAX_TERMINALS = 1_000_000
CHUNK_CHARS = 1 << 22


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    h = math.fsum(1.0 / (r + 1) for r in ranks.values())
    return {piece: -math.log((r + 1) * h) for piece, r in ranks.items()}


class UnigramTrie:
    """Node 0 is the empty prefix; per node its children by byte, its forward
    score and count, and the automaton state that tells which pieces end
    there."""

    def __init__(self, scores: dict[bytes, float]):
        self.endings, self.scores = Endings(scores), scores
        self.options: dict[bytes, list[tuple[int, float]]] = {}  # state -> (length, score) of the pieces ending
        self.terminal: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.state: list[bytes] = [Endings.START]

    def insert(self, raw: bytes) -> int:
        """Add the path of ``raw``; returns its end node."""
        child, best, count, state = self.child, self.best, self.count, self.state
        at, path = 0, [0]
        for byte in raw:
            to = child[at].get(byte)
            if to is None:
                s = self.endings.step(state[at], byte)
                options = self.options.get(s)
                if options is None:
                    options = self.options[s] = [(len(p), self.scores[p]) for p in self.endings.ends[s]]
                top, n = -math.inf, 0
                for size, own in options:
                    start = path[-size] if size <= len(path) else None
                    if start is not None:
                        total = best[start] + own
                        if total > top or total == top and count[start] + 1 < n:
                            top, n = total, count[start] + 1
                if not n:
                    raise ValueError("the vocabulary lacks a byte")
                to = child[at][byte] = len(child)
                child.append({})
                best.append(top)
                count.append(n)
                state.append(s)
            at = to
            path.append(at)
        return at

    def learn(self, pieces) -> None:
        """Terminal counts of new pre-tokens."""
        for piece in pieces:
            if len(self.child) > MAX_NODES:
                self.reset()
            self.terminal[piece] = self.count[self.insert(piece.encode("utf-8", "surrogatepass"))]


class Counter:
    def __init__(self, scores: dict[bytes, float], pattern: str):
        self.trie, self.find = UnigramTrie(scores), regex.compile(pattern).findall

    def count_all(self, texts: list[str]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        split = [self.find(t) for t in texts]
        new = set().union(*split)
        known = self.trie.terminal
        if len(known) + len(new) > MAX_TERMINALS:
            known.clear()
        self.trie.learn(sorted(new.difference(known)))
        get = known.__getitem__
        return [(len(pieces), sum(map(get, pieces))) for pieces in split]


_COUNTERS: dict[bytes, Counter] = {}


def _counter(vocabulary, key: bytes, pattern: str) -> Counter:
    """The worker's counter: built once per worker, not per task."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary.value, pattern)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, id_col: str, text_col: str, scores: dict[bytes, float],
                 pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row: id, n_pretokens, n_tokens."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(scores)
    key = hashlib.sha256((pattern + repr(sorted(scores.items()))).encode()).digest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(vocabulary, key, pattern)
        for pdf in batches:
            rows = []
            for part in chunks(pdf["text"].fillna(""), CHUNK_CHARS):
                rows += counter.count_all(part)
            out = pd.DataFrame(rows, columns=["n_pretokens", "n_tokens"])
            out.insert(0, "id", pdf["id"].array)
            yield out

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "id long, n_pretokens long, n_tokens long") \
        .withColumnRenamed("id", id_col)


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    scores = zipf_scores(load_ranks(public_tokenizers.path(RANK_FILE)))
    return count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", scores)

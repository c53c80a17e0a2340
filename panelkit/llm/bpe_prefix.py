"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A sequence of tokens is the encoding of its bytes exactly when every token
encodes to itself and every two neighbours encode to themselves when joined.
So each byte prefix of a pre-token has one valid last token: the token ``t``
ending there whose left neighbour (the last token of the prefix before ``t``)
is compatible with it. ``PrefixTable`` stores that token for every prefix:
appending bytes only adds entries, and after an edit only the entries behind
it are computed again.

Per document: pre-tokens by the public pattern, each encoded on its own. A
pre-token that is itself in the vocabulary is that token. New pre-tokens of a
batch are encoded in sorted order, so one table is cut back to the shared
prefix and extended. The ids of known pre-tokens are kept per worker in a
cache of ``CACHE`` entries; the bound changes no result.

The rank file is read in the driver and broadcast: it is a fixed vocabulary
(under 1 MB), not data that grows.

Cases: null texts count as empty and give zero tokens; white space, very long
runs and special-token strings are ordinary text; rows are independent, so
ties, repeats, empty tables and extra columns need nothing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import register, table
from panelkit.llm.endings import Endings

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
CACHE = 200_000
#: Characters of text whose pre-tokens are held at a time.
CHUNK_CHARS = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with the two questions the dynamic program asks of them: does a
    token encode to itself, and do two tokens stay apart when joined?"""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.endings = Endings(ranks)
        self.packed = {b: r.to_bytes(4, "little") for b, r in ranks.items()}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.edges: dict[bytes, tuple] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes, log: list | None = None) -> list[bytes]:
        """The textbook merge loop; only used on single tokens (and on pairs
        of a token whose merges are not in rank order)."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            rank, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if log is not None:
                log.append((rank, parts[0], parts[-1]))
        return parts

    def edge(self, token: bytes) -> tuple:
        """(stable, in_order, first, last) of a token. ``first`` and ``last``
        list the parts that stand at its left and right end while it is being
        merged: (part, rank at which it appears, rank at which it is gone)."""
        got = self.edges.get(token)
        if got is None:
            log: list = []
            stable = self.merge(token, log) == [token]
            in_order = all(a[0] < b[0] for a, b in zip(log, log[1:]))
            ends = []
            for side, part in ((1, token[:1]), (2, token[-1:])):
                spans, born = [], -1
                for step in log:
                    if step[side] != part:
                        spans.append((part, born, step[0]))
                        part, born = step[side], step[0]
                spans.append((part, born, 1 << 60))
                ends.append(spans)
            got = self.edges[token] = (stable, in_order, *ends)
        return got

    def is_stable(self, token: bytes) -> bool:
        return self.edge(token)[0]

    def compatible(self, left: bytes, right: bytes) -> bool:
        """No merge ever crosses the border: no part at the right end of
        ``left`` and part at the left end of ``right`` stand there together
        at the moment their own merge is due. Of equal ranks the left merge
        goes first."""
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            a, b, ranks = self.edge(left), self.edge(right), self.ranks
            if not (a[0] and b[0]):
                ok = False
            elif a[1] and b[1]:
                ok = True
                for x, x_from, x_to in a[3]:
                    for y, y_from, y_to in b[2]:
                        r = ranks.get(x + y)
                        if r is not None and max(x_from, y_from) < min(x_to, y_to) and r < x_to and r <= y_to:
                            ok = False
                            break
                    if not ok:
                        break
            else:
                ok = self.merge(left + right) == [left, right]
            self.pairs[left, right] = ok
        return ok


class PrefixTable:
    """``last[i]``: the last token of the encoding of the first i + 1 bytes;
    ``states``: what may end behind each prefix."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last, self.states = vocab, b"", [], [Endings.START]
        self.append(data)

    def truncate(self, size: int) -> None:
        self.data = self.data[:size]
        del self.last[size:]
        del self.states[size + 1:]

    def append(self, more: bytes) -> None:
        vocab, last, states = self.vocab, self.last, self.states
        go, ends, pairs = vocab.endings.go, vocab.endings.ends, vocab.pairs
        self.data += more
        state, at = states[-1], len(last)
        for byte in more:
            state = go[state].get(byte) or vocab.endings.step(state, byte)
            states.append(state)
            for token in ends[state]:
                begin = at + 1 - len(token)
                if begin > 0:
                    left = last[begin - 1]
                    ok = pairs.get((left, token))
                    if ok is None:
                        ok = vocab.compatible(left, token)
                else:
                    ok = begin == 0 and vocab.is_stable(token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            at += 1

    def splice(self, start: int, stop: int, new: bytes) -> None:
        """Replace ``data[start:stop]``; prefixes before ``start`` stay, and
        entries behind the edit are taken over once they agree again."""
        tail, old, old_states = self.data[stop:], self.last[stop:], self.states[stop + 1:]
        self.truncate(start)
        self.append(new)
        shift, at, same = self.vocab.longest, 0, 0
        while at < len(tail):
            # entries depend on the last `longest` entries only: after that many equal ones the rest is equal
            if same >= shift:
                self.data += tail[at:]
                self.last += old[at:]
                self.states += old_states[at:]
                return
            self.append(tail[at:at + 1])
            same = same + 1 if self.last[-1] == old[at] else 0
            at += 1

    def tokens(self) -> list[bytes]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(out[-1])
        return out[::-1]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.vocab = Vocabulary(ranks)
        self.find = regex.compile(pattern).findall
        self.packed: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Pack the ids of new pre-tokens, sharing the table of prefixes."""
        ids, packed = self.vocab.packed, self.packed
        prefix = PrefixTable(self.vocab)
        for raw, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
            whole = ids.get(raw)
            if whole is None:
                prefix.truncate(shared(prefix.data, raw))
                prefix.append(raw[len(prefix.data):])
                whole = b"".join([ids[t] for t in prefix.tokens()])
            packed[piece] = whole

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        new = set().union(*split)
        if len(self.packed) + len(new) > CACHE:
            self.packed.clear()
        self.learn(new.difference(self.packed))
        get = self.packed.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def chunks(texts: Iterable[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Lists of whole texts of about ``chars`` characters, in order."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(vocabulary, key: bytes, pattern: str) -> Encoder:
    """The worker's encoder: built once per worker, not per task."""
    if (key, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key, pattern] = Encoder(vocabulary.value, pattern)
    return _ENCODERS[key, pattern]


def encode_decode(docs: DataFrame, id_col: str, text_col: str, ranks: dict[bytes, int],
                  pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, on request, the
    ids themselves (``ids``) and the decoded text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).digest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(vocabulary, key, pattern)
        for pdf in batches:
            rows = []
            for part in chunks(pdf["text"].fillna("")):
                for packed in enc.encode_all(part):
                    raw = enc.decode(packed)
                    row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(raw).hexdigest())
                    rows.append(row + (np.frombuffer(packed, "<u4").astype("int32"), raw.decode("utf-8", "replace"))
                                if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "id", pdf["id"].array)
            yield out

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + \
        (", ids array<int>, decoded string" if with_ids else "")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, schema).withColumnRenamed("id", id_col)


@register("op9_bpe_prefix")
def op9_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded."""
    ranks = load_ranks(public_tokenizers.path(RANK_FILE))
    return encode_decode(table(spark, sf_dir, "documents"), "doc_id", "text", ranks)

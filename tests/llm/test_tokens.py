"""BPE by prefix dynamic programming and unigram counts on the trie."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_cases import LONG

from panelkit.llm import bpe_prefix as B
from panelkit.llm import token_counts as C

RANKS = B.load_ranks(public_tokenizers.path(B.RANK_FILE))
ODD = ["", " ", "\n\n  \t x", "don't  I'LL", "日本語テキスト 🙂🙃", "a" * 3000, "<|endoftext|>", "é" * 500 + "é", "\x00\x01 ",
       "     x", "1234567890" * 50, "!!!???---" * 30]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_equal_tiktoken(reference, texts):
    enc = B.Encoder(RANKS)
    every = texts[:400] + ODD
    got = enc.encode_all(every)
    assert [np.frombuffer(p, "<u4").tolist() for p in got] == [reference.encode_ordinary(t) for t in every]
    assert [enc.decode(p) for p in got] == [t.encode() for t in every]


def test_pair_rule_equals_merging():
    rng, vocab = random.Random(1), B.Vocabulary(RANKS)
    tokens = list(RANKS)
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if rng.random() < 0.5:  # pairs that might merge
            whole = rng.choice(tokens)
            cut = rng.randrange(len(whole) + 1)
            a, b = whole[:cut], whole[cut:]
            if a not in RANKS or b not in RANKS:
                continue
        assert vocab.compatible(a, b) == (vocab.merge(a + b) == [a, b])


def test_appends_and_edits_equal_encoding_afresh():
    rng, vocab = random.Random(2), B.Vocabulary(RANKS)
    for _ in range(1500):
        data = bytes(rng.choice(b"abcthe ing\xc3\xa9") for _ in range(rng.randint(0, 80)))
        made = B.PrefixTable(vocab, data)
        assert made.tokens() == vocab.merge(data)
        i = rng.randint(0, len(data))
        j, new = rng.randint(i, len(data)), bytes(rng.choice(b"the x") for _ in range(rng.randint(0, 6)))
        made.splice(i, j, new)
        fresh = B.PrefixTable(vocab, data[:i] + new + data[j:])
        assert (made.data, made.last, made.states) == (fresh.data, fresh.last, fresh.states)


def test_encode_decode_table(docs, reference):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, LONG), (None, "x"), (1, "hello world")] + [(9, t) for t in ODD]
    got = B.encode_decode(docs(rows), "doc_id", "text", RANKS).collect()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    full = B.encode_decode(docs(rows[:1]), "doc_id", "text", RANKS, with_ids=True).first()
    assert full["ids"] == reference.encode_ordinary("hello world") and full["decoded"] == "hello world"
    assert B.encode_decode(docs([]), "doc_id", "text", RANKS).count() == 0


def viterbi(raw, scores):
    """(score, -pieces) by trying every piece at every place."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(raw)
    for end in range(1, len(raw) + 1):
        for begin in range(end):
            s = scores.get(raw[begin:end])
            if s is not None:
                best[end] = max(best[end], (best[begin][0] + s, best[begin][1] - 1))
    return best[-1]


def test_trie_counts_equal_plain_viterbi(texts):
    import regex

    scores = C.zipf_scores(RANKS)
    pieces = sorted({p for t in texts[:60] + ODD for p in regex.findall(public_tokenizers.PATTERN, t) if len(p) < 200})
    trie = C.UnigramTrie(scores)
    trie.learn(pieces)
    for p in pieces:
        assert trie.terminal[p] == -viterbi(p.encode(), scores)[1], p


def test_trie_counts_equal_a_unigram_tokenizer():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    pieces = [(b.decode(), s) for b, s in C.zipf_scores(RANKS).items() if b.isascii()]
    model = Tokenizer(Unigram([("<unk>", -100.0), *pieces], unk_id=0))
    trie = C.UnigramTrie({p.encode(): s for p, s in pieces})
    for word in ("internationalization", " thereupon", "aaaaaaa", "xyzzyqwv", " 0123456789", "tionably"):
        trie.learn([word])
        assert trie.terminal[word] == len(model.encode(word).ids)


def test_ties_take_fewer_pieces():
    trie = C.UnigramTrie({b"a": -1.0, b"aa": -2.0, b"aaaa": -4.0})
    trie.learn(["aaaa", "aaaaa", "aaa"])
    assert trie.terminal == {"aaaa": 1, "aaaaa": 2, "aaa": 2}


def test_bounds_change_no_count(texts, monkeypatch):
    scores = C.zipf_scores(RANKS)
    free = C.Counter(scores, public_tokenizers.PATTERN).count_all(texts[:50])
    monkeypatch.setattr(C, "MAX_NODES", 50)
    monkeypatch.setattr(C, "MAX_TERMINALS", 100)
    tight = C.Counter(scores, public_tokenizers.PATTERN)
    assert [x for t in texts[:50] for x in tight.count_all([t])] == free


def test_count_table(docs):
    scores = C.zipf_scores(RANKS)
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in C.count_tokens(
        docs([(1, "hello world"), (2, None), (3, ""), (None, "x"), (5, LONG)]), "doc_id", "text", scores).collect()}
    assert got[2] == got[3] == (0, 0) and got[None] == (1, 1) and got[1][0] == 2 and got[5][0] == 120_001
    assert C.count_tokens(docs([]), "doc_id", "text", scores).count() == 0

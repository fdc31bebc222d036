"""Viterbi against a plain dynamic programme, decoding against the library, round trips."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece

from granary.llm import sentencepieces as S
from granary.llm.tokens import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ß", "中", "😀", "\x01", "e", "r", "ing", "tion"]


@pytest.fixture(scope="module")
def codec():
    return S.codec(PATH)


def best_score(model, text):
    """Best sum of piece scores, over all ways to cut the text."""
    scores = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k in (S.NORMAL, S.USER)}
    best = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 40), j):
            if (s := scores.get(text[i:j])) is not None:
                best[j] = max(best[j], best[i] + s)
        if text[j - 1] not in scores:
            best[j] = max(best[j], best[j - 1] + model.unknown_score)
    return best[-1]


def score(model, ids):
    total, i = 0.0, 0
    while i < len(ids):
        if model.kinds[ids[i]] == S.BYTE:
            first = model.bytes_at.index(ids[i])
            i += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            total += model.unknown_score
        else:
            total += model.scores[ids[i]]
            i += 1
    return total


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), np.int32).tolist()


def test_best_cut_and_round_trip(codec):
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 20)))
        ids = ids_of(codec, text)
        assert codec.decode(ids) == text
        assert score(codec.model, ids) == pytest.approx(best_score(codec.model, codec.normal(text)))


def test_decoding_equals_the_library(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.randint(0, 600) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids)


def test_trie_holds_exactly_its_keys():
    rng = random.Random(3)
    keys = {bytes(rng.choices(b"abc\xff\x00", k=rng.randint(1, 5))): i for i in range(300)}
    trie = S.DoubleArray.of(keys)

    def find(key):
        s = 0
        for b in key:
            t = trie.base[s] + b + 1
            if trie.check[t] != s:
                return -1
            s = t
        return trie.value[s]

    assert all(find(k) == v for k, v in keys.items())
    for _ in range(500):
        key = bytes(rng.choices(b"abcd\xff\x00", k=rng.randint(1, 6)))
        assert find(key) == keys.get(key, -1)


def test_rows(spark, docs, corpus, nothing):
    rows = {r.doc_id: r for r in S.encoded(docs).collect()}
    for doc_id, text in corpus:
        r = rows[doc_id]
        assert (r.ids is None) == (text is None) and r.decoded == text
        assert text is None or r.n_ids == len(r.ids)
    back = {r.doc_id: r.text for r in S.decoded(S.encoded(docs, decode=False)).collect()}
    assert back == dict(corpus)
    assert S.encoded(nothing).count() == 0

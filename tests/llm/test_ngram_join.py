"""Components against all pairs; signatures of any two linked sets meet."""

from __future__ import annotations

import random

import numpy as np
import pytest

from granary.llm import ngram_join as J
from granary.llm.common import shared_folder


def sets_of(corpus, n):
    out = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def components(sets, num, den):
    ids, label = sorted(sets), {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("n", "num", "den", "joined", "frequent", "rounds", "held"), [(3, 90, 100, 48, 16, 3, 1 << 19), (5, 80, 100, 1, 16, 3, 1 << 19), (3, 90, 100, 1, 2, 0, 400), (3, 60, 100, 3, 4, 1, 4000)])
def test_equals_all_pairs(spark, docs, corpus, monkeypatch, n, num, den, joined, frequent, rounds, held):
    monkeypatch.setattr(J, "JOINED", joined)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "HELD", held)
    monkeypatch.setattr(J, "FREQUENT_FROM", frequent)
    monkeypatch.setattr(J, "BLOCK", 16)
    sets = sets_of(corpus, n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similarity_components(docs, shared_folder(spark), n, num, den).collect()}
    want = components(sets, num, den)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_share_a_signature(seed):
    rng = np.random.default_rng(seed)
    num, den = random.Random(seed).choice([(90, 100), (80, 100), (60, 100)])
    for _ in range(150):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lose = int(rng.integers(0, max(1, len(x) // 4) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[lose:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 5)))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or den * both < num * (len(x) + len(y) - both):
            continue
        share = rng.random()
        frequent = {v: k + 1 for k, v in enumerate(x[rng.random(len(x)) < share].tolist())}
        sx, sy = (J.signatures(h, np.array([frequent.get(v, 0) for v in h.tolist()]), num, den) for h in (x, y))
        assert len(np.intersect1d(sx, sy))
        longer, shorter = sorted((J.bitmap(x), J.bitmap(y)), key=len, reverse=True)
        while len(longer) > len(shorter):
            longer = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
        assert np.bitwise_count((longer ^ shorter).view(np.uint64)).sum() <= len(x) + len(y) - 2 * both


def test_blocks_give_few_links_and_all_components():
    import pandas as pd

    rng = np.random.default_rng(3)
    base, rows = rng.integers(0, 2**62, 300), []
    for i in range(90):
        x = np.concatenate([rng.permutation(base)[: int(rng.integers(230, 300))], rng.integers(0, 2**62, int(rng.integers(0, 20)))]) if i % 3 else rng.integers(0, 2**62, 250)
        rows.append((i, i, len(x), bool(i % 5), i % 2, J.bitmap(np.unique(x).astype(np.uint64)), np.unique(x).astype(np.int64)))
    pdf = pd.DataFrame(rows, columns=["rep", "comp", "n_shingles", "late", "block", "bits", "shingles"])
    got = J.block_links(80, 100)(pdf)

    def parts(pairs):
        label = list(range(90))
        for _ in range(90):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    sets = [set(r[6].tolist()) for r in rows]
    want = [(a, b) for a in range(90) for b in range(a + 1, 90) if rows[a][4] != rows[b][4] and (rows[a][3] or rows[b][3]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(want) > 150 and len(got) == 90 - len(set(parts(want)))
    assert parts(got.to_numpy().tolist()) == parts(want)


def test_connected(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 240), rng.randint(200, 240)) for _ in range(25)] + [(5, 5)]
    got = {r.node: r.label for r in J.connected(spark.createDataFrame(edges, "a long, b long"), shared_folder(spark), "t").collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_one_stays_and_nothing(spark, docs, corpus, nothing):
    kept = J.one_of_each(docs, shared_folder(spark))
    want = components(sets_of(corpus, 5), 80, 100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
    assert kept.columns == docs.columns
    assert J.similarity_components(nothing, shared_folder(spark)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (2, "A b c D"), (2, "A b c D"), (9, "z")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id) for r in J.similarity_components(df, shared_folder(spark), 3, 90, 100).collect())
    assert rows == [(-1, 2), (2, 2), (2, 2), (4, 2), (9, 9)]

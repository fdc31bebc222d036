"""Recall against brute force; ties, copies and vectors that take no part."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import hilbert_ann as H
from granary.llm.common import shared_folder

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    m = np.stack([vectors[i] for i in ids]).astype(np.float64)
    out = {}
    for q in queries:
        s = m @ vectors[q].astype(np.float64)
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(H, "BLOCK", 128)
    rng = np.random.default_rng(3)
    n = 3000
    m = rng.standard_normal((n, 32)) if kind == "noise" else rng.standard_normal((30, 32))[rng.integers(0, 30, n)] + 0.2 * rng.standard_normal((n, 32))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    vectors = dict(enumerate(m))
    df = spark.createDataFrame([(i, v.tolist(), 0, 7) for i, v in vectors.items()], SCHEMA)
    rows = H.nearest(df, F.col("vec_id") % 20 == 0, shared_folder(spark), k=20).collect()
    want, got = brute(vectors, range(0, n, 20), 20), {}
    for r in rows:
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
        assert r.score == pytest.approx(float(vectors[r.query_id].astype(float) @ vectors[r.vec_id].astype(float)), abs=1e-12)
    recall = np.mean([len({i for i, _ in want[q]} & set(got[q])) / 20 for q in want])
    assert recall >= 0.9, recall


def test_copies_ties_and_invalid_vectors(spark):
    rng = np.random.default_rng(4)
    common = rng.standard_normal(8).astype(np.float32)
    vectors = {i: common if i % 3 else rng.standard_normal(8).astype(np.float32) for i in range(300)}
    rows = [(i, v.tolist(), 0, 0) for i, v in vectors.items()] + [(5, vectors[5].tolist(), 1, 1)]
    rows += [(400, None, 0, 0), (420, [0.0] * 8, 0, 0), (440, [float("nan")] * 8, 0, 0), (460, [None] + [1.0] * 7, 0, 0), (480, [1.0] * 3, 0, 0), (500, [float("inf")] * 8, 0, 0), (None, [1.0] * 8, 0, 0)]
    got = {}
    for r in H.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, shared_folder(spark), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in x] for q, x in brute(vectors, range(0, 300, 20), 20).items()}


def test_ties_of_different_vectors_go_to_the_smaller_id():
    rng = np.random.default_rng(9)
    m = rng.standard_normal((2000, 6))
    m[:, 0] = np.where(np.arange(2000) % 2, 5.0, m[:, 0].clip(-1, 1))  # odd ones tie at the first axis, ahead of all others
    ids = rng.permutation(2000)
    got = H._best(np.eye(6)[:1], np.array([7]), m, ids, 24)
    assert sorted(got["vid"]) == sorted(ids[1::2])[:24]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, 0), (1, [0.5, 1.0], 0, 0)], SCHEMA)
    rows = H.nearest(df, F.col("vec_id") % 20 == 0, shared_folder(spark)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 1, 0.5)]
    assert H.nearest(df.limit(0), F.lit(True), shared_folder(spark)).count() == 0


def test_curve_visits_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    order = cells[np.argsort(H.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()

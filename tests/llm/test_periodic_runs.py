"""Runs against the definition, word by word; ranges against whole scans."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import periodic_runs as P
from granary.llm.common import shared_folder

DOCS = "doc_id long, text string, runs string, blob int, `a.b` int, own int"


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(words[i] == words[i + p] for i in range(len(words) - p)))


def plain_runs(words, least, min_exp):
    """Every maximal stretch of each lag; those whose smallest period the lag is."""
    out, n = [], len(words)
    for p in range(1, n // min_exp + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, min_exp * p) and smallest_period(words[i : j + p]) == p:
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(rng, n):
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.5:
                unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
                size = rng.randint(0, 60)
                words += (unit * (size // len(unit) + 1))[:size]
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 25))]
        out.append(" ".join(words))
    return out


AWKWARD = [None, "", " \n\t ", "a", "a " * 23, "a " * 24, "x" + " a" * 25 + " y", "ab " * 8 + "ab", "a b c " * 8, "a b c d " * 5 + "a b c", ("a b " * 12 + "c ") * 3, "ä ö ü\x0b" * 30, "w\r\n" * 4000, " ".join(f"u{i}" for i in range(3000)) * 3]


@pytest.mark.parametrize(("least", "min_exp"), [(24, 3), (6, 2), (9, 4)])
def test_scan_equals_the_definition(least, min_exp):
    rng = random.Random(least)
    for text in texts(rng, 150):
        words = text.encode().split()
        runs = P.scan_lags(P.word_ids(words), 1, len(words), least, min_exp)
        assert sorted(map(tuple, runs.tolist()), key=lambda r: (r[0], r[2])) == plain_runs(words, least, min_exp)
        cuts = [P.scan_lags(P.word_ids(words), a, a + 4, least, min_exp) for a in range(1, len(words) + 1, 5)]
        best = {}
        for s, n, p in np.concatenate([*cuts, np.zeros((0, 3), np.int64)]).tolist():
            best[s, n] = min(p, best.get((s, n), p))
        assert sorted((s, n, p) for (s, n), p in best.items()) == sorted(map(tuple, runs.tolist()))


@pytest.mark.parametrize("work", [1 << 28, 300])
def test_whole_documents_and_ranges_give_the_same(spark, work):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(AWKWARD + texts(rng, 40))]
    rows += [(5, AWKWARD[5]), (None, AWKWARD[9]), (900, AWKWARD[12]), (901, AWKWARD[12])]
    df = spark.createDataFrame([(i, t, "clash", 4, 5, 6) for i, t in rows], DOCS).repartition(4)
    out = P.periodic_runs(df, shared_folder(spark), range_work=work, range_lags=7 if work == 300 else 1024)
    assert out.columns == ["doc_id", "text", "runs", "blob", "a.b", "own", "n_words", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows) and {(r.blob, r["a.b"], r.own) for r in got} == {(4, 5, 6)}
    known = {}
    for r in got:
        words = [w.decode() for w in (r.text or "").encode().split()]
        if r.text not in known:
            known[r.text] = plain_runs(words, 24, 3) if len(words) < 1000 else None
        runs = [(x.start, x.length, x.period) for x in r.runs]
        if known[r.text] is not None:
            assert runs == known[r.text]
        assert r.n_words == len(words) and r.collapsed == plain_collapse(words, runs)
        if r.doc_id in (900, 901):
            assert runs == [(0, 4000, 1)]


def test_strongest_compares_exactly(spark):
    rows = [([(0, 30, 10), (5, 24, 8), (40, 60, 20)],), ([(0, 2_000_000_001, 666_666_667), (1, 2_000_000_000, 666_666_666)],), ([],)]
    df = spark.createDataFrame(rows, f"runs array<{P.RUN}>")
    assert [r[0] and r[0].start for r in df.select(P.strongest(F.col("runs"))).collect()] == [0, 1, None]


def test_nothing(spark):
    assert P.periodic_runs(spark.createDataFrame([], DOCS), shared_folder(spark)).count() == 0


def test_sql(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t) for i, t in enumerate(AWKWARD[:12] + texts(rng, 200))] + [(None, "a b " * 20), (7, "c " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ours = sorted([tuple(r) for r in P.op12_periodic_runs(spark, str(tmp_path)).collect()], key=str)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert ours == sorted(c.execute(P.SQL).fetchall(), key=str)
    assert sum(r[1] > 0 for r in ours) > 100

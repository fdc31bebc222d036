"""Common lines against a plain count in Python."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.llm import line_dedup as L
from granary.llm.common import shared_folder

BLANKS = " \t\n\x0b\f\r"
DOCS = "doc_id long, text string, n_lines string, row int, `a.b` int"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, least_docs, least_chars=1):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    stock = ["Share this page", "  share THIS page\t", "Über uns", "über uns", "ÜBER UNS", " padded ", "padded", "", " ", "x", "\r", "cookie \x0b", "Cookie", "a\x1cb", "𝔸 line", "Menu"]
    out = [(i, "\n".join(rng.choice(stock) if rng.random() < 0.6 else f"line {rng.randint(0, 40)}" for _ in range(rng.randint(1, 12)))) for i in range(60)]
    out += [(60, None), (61, ""), (62, "\n"), (63, "Menu\n" * 3000 + "own\n" + "Menu\n" * 3000), (64, "Menu"), (5, out[5][1]), (5, "another text\nMenu"), (None, "Menu\nshare this page"), (None, "Menu")]
    return out


@pytest.mark.parametrize(("least_docs", "least_chars"), [(10, 1), (3, 1), (2, 8), (1, 1), (1000, 1)])
def test_equals_a_plain_count(spark, rows, least_docs, least_chars):
    df = spark.createDataFrame([(i, t, "clash", 7, 9) for i, t in rows], DOCS).repartition(5)
    out = L.without_common_lines(df, shared_folder(spark), least_docs=least_docs, least_chars=least_chars)
    assert out.columns == ["doc_id", "text", "n_lines", "row", "a.b", "n_dropped"]
    got = out.collect()
    assert {(r.row, r["a.b"]) for r in got} == {(7, 9)}
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got], key=str) == plain(rows, least_docs, least_chars)


def test_a_line_in_one_document_many_times_counts_once(spark):
    df = spark.createDataFrame([(1, "again\n" * 50), (2, "again")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in L.without_common_lines(df, shared_folder(spark), least_docs=3).collect()} == {1: 0, 2: 0}


def test_hot_key_is_counted_in_parts(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Every page\n"), F.col("id").cast("string")).alias("text"))
    common = L.common_keys(L.hashed_lines(df))
    assert [r.n_docs for r in common.collect()] == [20_000]
    plan = common._jdf.queryExecution().toString()
    assert plan.count("partial_count(1)") and "Window" not in plan


def test_nothing(spark):
    assert L.without_common_lines(spark.createDataFrame([], DOCS), shared_folder(spark)).count() == 0


def test_sql(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ours = sorted([tuple(r) for r in L.op11_line_dedup(spark, str(tmp_path)).collect()], key=str)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert ours == sorted(c.execute(L.SQL).fetchall(), key=str)

"""Run tables and cuts against plain splitting; exact round trips."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import fill_middle as M

PATTERNS = {"line": "[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "char": "(?s:.)"}
TEXTS = ["one\ntwo\n\nthree", "\n\n\n", "no end", "a\n", "😀ä\n x\n", "with <M> in it\nx", "<\n<P\nS>\n<", "<<\nP>", "", None, "\r\nx\ty  z \n", "long line " * 3000 + "\n" * 500 + "tail", "  lead\nx"]
DOCS = "doc_id long, text string, form string, `a.b` int, own int, h int"


@given(st.text(alphabet="ab \n\t 😀\r", max_size=60), st.sampled_from(M.UNITS))
@settings(max_examples=300, deadline=None)
def test_cuts_fall_where_plain_units_end(text, unit):
    units = re.findall(PATTERNS[unit], text)
    first, ended, each = M.class_runs(text, unit)
    assert ended[-1] == len(units) and first[-1] == len(text)
    assert [M.cut_offset(first, ended, each, k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_a_run_table_takes_room_by_runs():
    first, ended, each = M.class_runs("x" * 1000 + "\n" * 100_000 + "y")
    assert first.tolist() == [0, 1000, 101_000, 101_001] and ended.tolist() == [0, 0, 100_000, 100_001] and each.tolist() == [False, True, False]
    assert M.cut_offset(first, ended, each, 77_777) == 78_777


def expected(doc_id, text, unit="line", seed=7, rate=100, spm=50, marks=M.MARKS):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(PATTERNS[unit], text)
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    P, S, E = marks
    return (len(units), "spm", len(p), len(m), S + s + P + p + E + m) if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), P + p + S + s + E + m)


@pytest.mark.parametrize(("unit", "rate", "spm", "marks"), [("line", 100, 50, M.MARKS), ("word", 60, 0, M.MARKS), ("char", 100, 100, ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>"))])
def test_documents_turn_and_come_back(spark, unit, rate, spm, marks):
    rows = [(i if i != 20 else None, TEXTS[i % len(TEXTS)], "clash", 1, 2, 3) for i in range(6 * len(TEXTS))] + [(3, TEXTS[3], "clash", 1, 2, 3)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    out = M.fill_in_middle(df, unit=unit, rate=rate, suffix_first=spm, marks=marks)
    assert out.columns == ["doc_id", "text", "form", "a.b", "own", "h", "n_units", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", M.restored(F.col("output"), F.col("form"), marks)).collect()
    assert len(got) == len(rows) and {(r["a.b"], r.own, r.h) for r in got} == {(1, 2, 3)}
    for r in got:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, unit, 7, rate, spm, marks)
        assert r.back == (r.text or "")


def test_a_stored_run_table_serves_other_draws(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    df.withColumn("runs", M.run_table(F.col("text"))).write.parquet(f"{tmp_path}/runs")
    stored = spark.read.parquet(f"{tmp_path}/runs")
    for seed in (7, 8):
        got = {r.doc_id: (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) for r in M.fill_in_middle(stored, seed=seed, runs_col="runs").collect()}
        assert got == {i: expected(i, t, seed=seed) for i, t in enumerate(TEXTS)}
    with pytest.raises(ValueError):
        M.fill_in_middle(stored, runs_col="text")


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("aba", "x", "y"), ("ab", "bc", "z"), ("a", "xay", "z")])
def test_marks_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        M._checked(marks)


def test_nothing(spark):
    assert M.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_pass_python_once_and_stay_where_they_are(spark):
    plan = M.fill_in_middle(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("encoded(text") == 1 and "Exchange" not in plan


def test_sql(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    ours = sorted([tuple(r) for r in M.op13_fill_middle(spark, str(tmp_path)).collect()], key=str)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert ours == sorted(c.execute(M.SQL).fetchall(), key=str)

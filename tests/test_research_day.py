"""Whole research runs: what a failed run keeps, what is written back, and what the next day takes from it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary import run_queries
from granary.operators import budgets
from granary.plans import opportunities

SETTINGS = budgets.Settings(pool=60, hard=40, wave=10, target=50)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("orders"))
    spark.range(160).select(F.col("id").alias("o_orderkey")).write.parquet(f"{d}/orders.parquet")
    return run_queries.notice_day(spark, d)


def run(inputs, folder, decide=None, now=run_queries.NOW, index=None, day="2024-03-01"):
    candidates, old, own, *rest = inputs
    return opportunities.research_day(candidates, old if index is None else index, decide or own, *rest, now, run_queries.YEAR, day, SETTINGS, 10, folder=folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def whole(inputs, tmp_path_factory):
    trace, shown, index = run(inputs, str(tmp_path_factory.mktemp("whole")))
    return rows(trace), shown.collect(), index


def test_a_failed_run_goes_on_behind_its_last_stage(spark, inputs, whole, tmp_path):
    def broken(_):
        raise RuntimeError("no answer")

    with pytest.raises(RuntimeError):
        run(inputs, str(tmp_path), broken)
    done = {p.name: p.stat().st_mtime_ns for p in tmp_path.iterdir()}
    assert {"candidates", "pool", "reused", "filtered"} <= set(done) and "queue" not in done
    trace, shown, _ = run(inputs, str(tmp_path))
    assert rows(trace) == whole[0]
    assert {n: (tmp_path / n).stat().st_mtime_ns for n in done} == done
    assert [r.project_key for r in shown.collect()] == [r.project_key for r in whole[1]]
    (tmp_path / "verified" / "_SUCCESS").unlink()  # a stage that was cut short is written anew
    (tmp_path / "trace" / "_SUCCESS").unlink()
    assert rows(run(inputs, str(tmp_path))[0]) == whole[0] and (tmp_path / "verified" / "_SUCCESS").exists()


def test_void_decisions_leave_the_pools_own_order(inputs, tmp_path):
    trace, _, _ = run(inputs, str(tmp_path), lambda pool: inputs[2](pool).where("score > 10"))
    stages = {r.pipeline_stage for r in trace.collect()}
    assert "triage" not in stages and {"ranking", "research_queue"} <= stages


def test_what_was_researched_is_remembered_and_reused_the_next_hour(spark, inputs, whole, tmp_path):
    index = whole[2]
    first = {r.project_key: r for r in index.collect()}
    assert len({r.index_ord for r in first.values()}) == len(first)
    researched = [r for r in first.values() if r.last_researched_ts == run_queries.NOW]
    assert researched and all(r.source_content_hash.startswith("h") and r.research_mode in ("ai", "preview") for r in researched)
    old = {r.project_key: r.index_ord for r in inputs[1].collect()}
    assert all(first[k].index_ord == n for k, n in old.items())
    trace, _, after = run(inputs, str(tmp_path), now=run_queries.NOW + 3600, index=index, day="2024-03-02")
    again = {r.page for r in trace.collect() if r.drop_reason == "reused_verified_snapshot"}
    before = {t[0] for t in whole[0] if t[2] == "reused_verified_snapshot"}
    read = {c.verified_url for c in inputs[0].where("verified_url <> '' and (_ord + 1) % 7 <> 3").collect()}  # pages of one row
    fresh = {r.source_url for r in researched if r.research_mode == "ai"} & read
    assert fresh and fresh <= again and len(again) > len(before)
    seen = {r.project_key: (r.first_seen, r.last_seen) for r in after.collect()}
    assert any(a != b for a, b in seen.values() if a)


def test_nothing(spark, inputs, tmp_path):
    candidates, *rest = inputs
    trace, shown, index = run((candidates.limit(0), *rest), str(tmp_path))
    assert trace.count() == 0 and shown.count() == 0 and index.count() == rest[0].count()

"""Budgets, contracts, delivery, folds and whole days."""

from __future__ import annotations

import pandas as pd

from granary.operators import budgets, contracts, delivery
from granary.streaming import folds


def test_preflight():
    assert budgets.preflight(budgets.Settings()) == ([], [], "research")
    errors, warnings, mode = budgets.preflight(budgets.Settings(discovery=9, total=20, wave=0))
    assert errors == ["wave_must_be_positive"] and warnings == ["discovery_budget_below_channels", "total_budget_below_phases"] and mode == "error"


def test_unknown_use_stays_charged():
    m, s = budgets.Meter(), budgets.Settings(discovery=3, verification=3, total=5)
    assert m.step("discovery", 2, True, 1, s) == (2, "settled") and m.remaining("discovery", s) == 2
    assert m.step("discovery", 5, True, None, s) == (2, "unknown") and m.remaining("discovery", s) == 0
    assert m.step("discovery", 1, True, 1, s) == (0, "search_call_budget_exhausted") and m.remaining("verification", s) == 2


def test_contracts():
    good = {"queries": ["a"]}
    assert contracts.problems(contracts.SEARCHES, good) == []
    assert contracts.problems(contracts.SEARCHES, {"queries": [1], "token=abc": 2}) == [("queries.0", "string_type"), ("[unknown_field]", "extra_forbidden")]
    assert contracts.diagnosed(contracts.RESEARCH, "") == [("$", "empty_response")] and contracts.diagnosed(contracts.RESEARCH, "{") == [("$", "json_invalid")]
    strict = contracts.strict_schema(contracts.RESEARCH)
    assert strict["required"] == list(contracts.RESEARCH.items) and strict["additionalProperties"] is False and strict["properties"]["stage"]["enum"] == list(contracts.STAGES)
    assert "abc" not in contracts.retry_feedback(contracts.problems(contracts.SEARCHES, {"abc": 1}))
    assert contracts.provider("x", "auto", {}) == ("glm", "existing") and contracts.safe_code("Bearer x") == "value_error"


def test_answers_are_read(spark):
    df = spark.createDataFrame([(1, '{"queries": ["a", "b"]}'), (2, '{"queries": "a"}'), (3, None)], "id int, payload string")
    assert [(r.id, r.data.queries) for r in contracts.parsed(df, contracts.SEARCHES).collect()] == [(1, ["a", "b"])]


def test_retries_are_bounded():
    d = delivery.Delivery()
    assert [d.step(t, "d", "x", t > 0, False) for t in (0, 100, 300, 700, 2000)] == ["failed", "idle", "failed", "failed", "idle"]
    assert d.step(3000, "d", "x", False, True) == "retry_exhausted" and d.step(3001, "e", "x", False, True) == "success"


def test_fallback(spark):
    schema = "project_key string, verification_status string, research_mode string, risk_flags array<string>"
    fresh, shown = spark.createDataFrame([], schema), spark.createDataFrame([("a", "preview", "ai", ["x"]), ("b", "verified", "ai", None)], schema)
    rows = {r.project_key: (r.research_mode, r.risk_flags) for r in delivery.with_fallback(fresh, shown, fresh, False).collect()}
    assert rows == {"a": ("preview", ["x", "cached_snapshot_fallback"]), "b": ("fallback", ["cached_snapshot_fallback"])}
    assert delivery.with_fallback(fresh, fresh, shown, True).count() == 2 and delivery.with_fallback(fresh, fresh, shown, False).count() == 0


def test_folds_go_on_across_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(folds, "SLICE", 3)
    df = spark.createDataFrame([(k, i, float(i)) for k in (None, 1, 2) for i in range(40)], "key long, seq long, x double").repartition(3)

    def running(state, rows: pd.DataFrame):
        sums = state[0] + rows["x"].cumsum()
        return (sums.iloc[-1],), pd.DataFrame({"total": sums.to_numpy()})

    got = folds.folded(df, "key", ["seq"], ["x"], running, (0.0,), "total double").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 120 and all(r.total == r.seq * (r.seq + 1) / 2 for r in got)
    assert folds.folded(df.limit(0), "key", ["seq"], ["x"], running, (0.0,), "total double").count() == 0

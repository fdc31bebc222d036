"""Verification joins tables that grow with the projects by sorting, whatever the size of their files."""

from __future__ import annotations

from granary import run_queries


def test_verification_broadcasts_nothing(spark, tmp_path):
    spark.range(1, 200).selectExpr("id as o_orderkey", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    out = run_queries.verified_projects(spark, str(tmp_path))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == sum(k % 11 != 0 and k % 13 != 0 for k in range(1, 200))

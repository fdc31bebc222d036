"""Verification works out once what a claim, a title or a plain address tells, and not anew for every filter and join that looks at it."""

from __future__ import annotations

from granary import run_queries
from granary.functions import urls
from granary.operators import verify


def test_accepted_evidence_takes_claims_apart_once(spark):
    claims = spark.createDataFrame([("p", "立体库改造", "title", "立体库改造", "立体库 改造公告", "https://a.example.com/1"), ("p", "立体库改造", "deadline", "2024年3月5日", "截止 2024-03-05", "HTTPS://A.example.com/1?utm_x=1#y"), ("p", "立体库改造", "deadline", "2024年3月5日", "发布 2024-03-05", "https://a.example.com/1"), ("p", "立体库改造", "owner", "甲", "甲公司", "https://a.example.com/1"), ("p", "立体库改造", "owner", None, None, None)], "project_key string, title string, field string, value string, quote string, source_url string")
    docs = spark.createDataFrame([("https://a.example.com/1", "立体库改造公告 截止 2024-03-05 甲公司", "")], "url string, text string, parent_url string")
    out = verify.accepted_evidence(claims, docs)
    assert sorted((r.field, r.quote) for r in out.collect()) == [("deadline", "截止 2024-03-05"), ("title", "立体库 改造公告")] and out.columns == [*claims.columns, "page", "retrieval_method"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert filters and not any("source_url" in x or "regexp_replace(quote" in x or "regexp_replace(coalesce(quote" in x for x in filters)


def test_titles_are_compared_once(spark, tmp_path):
    spark.range(1, 200).selectExpr("id as o_orderkey", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    out = run_queries.verified_projects(spark, str(tmp_path))
    assert "别的事" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_plain_addresses_stay_and_others_do_not(spark):
    same = ["https://a.cn/", "http://a-b.example.com/x/y.pdf;z:@中", "https://www.x.gov.cn/1"]
    other = {"https://a.cn": "https://a.cn/", "https://a.cn/x\n": "https://a.cn/x", "https://a.cn/x ": "https://a.cn/x", "https://a.cn/x ": "https://a.cn/x ", "https://a.test/x": "", "https://localhost.localdomain/x": "", "https://10.0.0.1/x": "", "https://1.2.3.com4/": "https://1.2.3.com4/", "https://A.cn/X": "https://a.cn/X", "https://a.cn:8080/x": "", "https://u@a.cn/x": "", "https://a.cn/x?utm_a=1": "https://a.cn/x", "https://a.cn/x#y": "https://a.cn/x", "https://a.cn/\x01x": "https://a.cn/x"}
    want = {u: u for u in same} | other
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.f for r in df.select("u", urls.fetch_url("u").alias("f")).collect()} == want
    assert not df.select(urls.fetch_url("u").alias("f")).schema["f"].nullable

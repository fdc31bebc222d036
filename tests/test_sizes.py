"""Steps whose cost must follow the rows: what a task holds, what is broadcast, how often a page is read through."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from granary import run_queries, tables
from granary.operators import verify
from granary.plans import candidates, opportunities
from granary.sources import pages


def _plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


def test_lookups_are_dealt_by_rows_and_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 10)
    asked = spark.range(40).select(F.concat(F.lit("p"), "id").alias("page"), F.concat(F.lit("t"), "id").alias("title"))
    query = F.concat(F.lit('"t'), F.floor(F.col("id") / 3).cast("string"), F.lit('" 官方 招标 采购 公告 企业采购平台 企业官网 最新公告'))
    results = spark.range(120).select(query.alias("query"), (F.col("id") % 3).alias("position"), F.concat(F.lit("u"), F.when(F.col("id") % 3 == 1, "0/").otherwise((F.col("id") % 3).cast("string"))).alias("url"), F.lit("r").alias("title"))
    out = candidates.source_lookups(asked, results)
    assert sorted((r.page, r.position) for r in out.collect()) == sorted((f"p{i}", p) for i in range(40) for p in (0, 2))
    plan = _plan(out)
    assert "BroadcastHashJoin" not in plan and re.search(r"hashpartitioning\([^)]*, 13\), REPARTITION_BY_NUM", plan)


def test_rows_are_numbered_without_a_task_that_holds_all(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 10)
    rows = spark.range(95).select((F.col("id") * 37 % 95).alias("k"))
    out = tables.numbered(rows, "rank", "k")
    assert [(r.k, r["rank"]) for r in out.orderBy("rank").collect()] == [(k, k + 1) for k in range(95)]
    assert out.inputFiles() and len(out.inputFiles()) > 5
    assert tables.numbered(rows.where("k < 0"), "rank", "k").count() == 0


def test_cover_cuts_a_page_once(spark):
    late = "x" * 49_990 + '<meta property="og:image" content="late"/>'
    html = [None, "", '<meta property="og:image" content=" "/>var msg_cdn_url = "c"', '<meta property="og:image"  content="i"/>', late, "é" * 49_900 + '<meta property="og:image" content="in"/>' + "é" * 99, 'var msg_cdn_url="d"' + late]
    out = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, html string").select("i", pages.cover("html").alias("c"))
    assert [r.c for r in out.orderBy("i").collect()] == ["", "", "c", "i", "", "in", "d"]
    assert _plan(out).count("substring(") <= 2  # once in the tree, once in the list of nodes


def test_attachments_are_matched_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(verify, "stored", lambda df, folder, name: kept.append(name) or tables.stored(df, folder, name))
    parents = spark.createDataFrame([("https://a.example.com/1", ["https://A.example.com/x.pdf#p", "https://a.example.com/y.pdf", "https://a.example.com/z.pdf"], ["old"])], "url string, attachment_urls array<string>, risk_flags array<string>")
    fetched = spark.createDataFrame([("https://a.example.com/x.pdf", "text", "")], "url string, text string, failure string")
    read, told = verify.attachments(parents, fetched)
    assert [(r.url, r.parent_url, r.text) for r in read.collect()] == [("https://a.example.com/x.pdf", "https://a.example.com/1", "text")]
    assert [r.risk_flags for r in told.collect()] == [["old", "attachment_unavailable"]] and kept == ["attachments"]


def test_projects_are_judged_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(opportunities, "stored", lambda df, folder, name: kept.append(name) or tables.stored(df, folder, name))
    out = run_queries.opportunity_ranking(spark, "/root/testdata/sf0.001")
    assert kept == ["judged"]
    assert out.groupBy("project_key").count().where("count > 1").count() == 0

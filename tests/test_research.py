"""Reading order, query plans, triage, history titles, narratives, wrapped addresses."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import functions as F

from granary.functions import urls
from granary.operators import research as R


def test_research_text(spark):
    pages = [(1, "a" * 7000), (2, "预算 " + "b" * 10), (3, "c" * 7000), (4, "d" * 7000), (5, "e" * 7000)]
    df = spark.createDataFrame([(pages, "t"), ([], "t" * 17_000), (None, "t")], "pages array<struct<page:int,text:string>>, text string")
    a, b, c = [r.y for r in df.select(R.research_text(F.col("pages"), F.col("text")).alias("y")).collect()]
    parts = a.split("\n")
    assert [p[:12] for p in parts] == ["[PDF page 2]", "[PDF page 1]", "[PDF page 3]", "[PDF page 4]", "[PDF page 5]"]
    assert sum(len(p) - 13 for p in parts) == 24_000 and (len(b), c) == (16_000, "t")


def test_resolver_queries(spark):
    df = spark.createDataFrame([("某厂 AGV 项目", "采购人：某某公司，无锡", "", "https://www.x.gov.cn/1"), ("标题 - 站点", "", "", "")], "title string, summary string, content string, url string")
    first, second = [[(q.purpose, q.query) for q in r.y] for r in df.select(R.resolver_queries(F.when(F.col("url") != "", 1).otherwise(3)).alias("y")).collect()]
    assert [p for p, _ in first] == ["owner_equipment", "official_domain", "region_equipment"] and first[0][1].startswith('"某某公司" AGV 采购')
    assert second == [("project_core", "标题 仓储 生产物流 企业采购平台 最新公告")]


@pytest.mark.parametrize(("ids", "n"), [([1, 2], 2), ([1], 0), ([1, 2, 3], 0), ([1, 1, 2], 0)])
def test_triage_is_all_or_nothing(spark, ids, n):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    d = spark.createDataFrame([(i, True, 5.0) for i in ids], "id int, worth_research boolean, score double")
    assert R.triage(c, d).count() == n


def test_history_titles(spark):
    day = 86400.0
    t = spark.createDataFrame([("x", 1, "立体库项目签约", 10 * day), ("x", 2, "完全无关的话", 0.0), ("y", 3, "没有历史", 0.0)], "account string, _ord long, title string, published_ts double")
    h = spark.createDataFrame([("x", 0, "立体库 项目，签约！", 30 * day, "far"), ("x", 1, "立体库项目签约", 10 * day, "near")], "account string, position int, title string, published_ts double, url string")
    assert [tuple(r) for r in R.history_titles(t, h).collect()] == [(1, "near")]


def test_narratives_become_cautious(spark):
    row = ("预算300万元，另需50万元，2026年3月1日截止，5月不变 2025-01-02", "甲公司的项目", None, "300万元", "", "2026-03-01", "", "江苏", "", "甲公司", "江苏", "无锡")
    df = spark.createDataFrame([row], "summary string, opportunity_reason string, entry_point string, budget string, published string, deadline string, owner string, province string, city string, claimed_owner string, claimed_province string, claimed_city string")
    r = R.cautious(df).first()
    assert r.summary == "预算300万元，另需金额待核实，2026年3月1日截止，5月不变 日期待核实"
    assert r.opportunity_reason == "待核实的项目" and r.entry_point == ""


def test_wrapped_addresses(spark):
    coded = "a1" + base64.urlsafe_b64encode("https://a.cn/?q=智".encode()).decode().rstrip("=")
    cases = [(f"https://www.bing.com/ck/a?u={coded}", "https://a.cn/?q=智"), ("https://www.bing.com/x?url=https%3A%2F%2Fb.cn%2F1", "https://b.cn/1"), ("https://www.bing.com/x?u=a1!!", "https://www.bing.com/x?u=a1!!"), ("https://c.cn/?u=https://d.cn", "https://c.cn/?u=https://d.cn"), (None, ""), ("", "")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string")
    assert [r.y for r in df.orderBy("i").select(urls.unwrapped("u").alias("y")).collect()] == [y for _, y in cases]


def test_account_articles(spark):
    cases = [("https://mp.weixin.qq.com/s?__biz=M%3D&mid=2&idx=1&sn=ab&scene=1#x", "https://mp.weixin.qq.com/s?__biz=M%3D&mid=2&idx=1&sn=ab"), ("https://mp.weixin.qq.com/s?mid=2", ""), ("https://x.cn/s?__biz=1&mid=2", ""), (None, "")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(cases)], "i int, u string")
    assert [r.y for r in df.orderBy("i").select(urls.account_article("u").alias("y")).collect()] == [y for _, y in cases]


def test_history_titles_equal_the_plain_loop(spark):
    import random
    import re
    from difflib import SequenceMatcher

    rng = random.Random(3)
    title = lambda: "".join(rng.choice(["仓储", "AGV", "agv", "，", " ", "物流", "系统", "发布", "-", "a", "b"]) for _ in range(rng.randint(0, 9)))
    targets = [(rng.choice("xy"), i, title(), rng.choice([0.0, 1e6 + rng.randint(0, 9) * 43_200.0])) for i in range(60)]
    history = [(rng.choice("xy"), i, title(), rng.choice([0.0, 1e6 + rng.randint(0, 9) * 43_200.0]), f"u{i}") for i in range(80)]
    plain = lambda t: re.sub(R.TITLE_MARKS.removeprefix("(?U)"), "", t.strip().lower())
    want = []
    for account, o, t, ts in targets:
        best, url = 0.0, ""
        for other, _, h, hts, u in history:
            if other != account:
                continue
            a, b = plain(t), plain(h)
            score = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            if ts > 0 and hts > 0:
                score += 0.2 if abs(ts - hts) <= 86400 else 0.1 if abs(ts - hts) <= 3 * 86400 else 0.0
            if score > best:
                best, url = score, u
        if best >= 0.62:
            want.append((o, url))
    t = spark.createDataFrame(targets, "account string, _ord long, title string, published_ts double")
    h = spark.createDataFrame(history, "account string, position int, title string, published_ts double, url string").repartition(3)
    assert sorted(map(tuple, R.history_titles(t, h).collect())) == sorted(want) and 10 < len(want) < 60

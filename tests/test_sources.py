"""Landed payloads, pages, discovery and sinks."""

from __future__ import annotations

import json

import pytest

from granary.sources import discovery, landed, pages, sinks, specs

RSS = "<rss><channel><item><title>智能 &amp;仓储</title><link>https://a.cn/1</link><description>&lt;p&gt;一 二&lt;/p&gt;</description><pubDate>2026-10-01</pubDate></item><item><title>仓储 b</title><link>https://a.cn/2</link><pubDate>Thu, 01 Oct 2026 08:00:00 GMT</pubDate></item></channel></rss>"
PAGE = '<ul><li><a href="/n/1.html" title="一个足够长的标题文字">短</a><span class="date">2026-10-01</span><p class="brief">摘要</p></li><li><a href="/n/1.html">一个足够长的标题文字</a></li><li><a href="/x">短</a></li><li><a href="http://[bad/x">一个地址坏掉的长标题</a></li></ul><nav><a href="/n/2.html">导航里面的一个长标题</a></nav>'
NOW = 1791000000.0


def test_feed_and_listing(spark):
    df = spark.createDataFrame([("s", "https://a.cn/feed", RSS), ("t", "https://b.cn/list", PAGE), ("u", "https://c.cn", None), ("v", None, "")], "source string, url string, payload string")
    rows = {(r.source, r.position): r for r in landed.feeds(df).collect()}
    assert len(rows) == 3
    assert rows["s", 0].title == "智能 &仓储" and rows["s", 0].summary == "一 二" and rows["s", 0].published == "2026-10-01"
    assert rows["s", 1].published_ts == 1790841600.0
    assert rows["t", 0].url == "https://b.cn/n/1.html" and rows["t", 0].published == "2026-10-01" and rows["t", 0].summary == "摘要"


def test_feed_articles_inherit_only_under_their_domain(spark):
    df = spark.createDataFrame([("s", "https://a.cn/feed", RSS.replace("https://a.cn/2", "https://z.cn/2"))], "source string, url string, payload string")
    source = specs.Source("s", feeds=(specs.Feed("f", "https://a.cn/feed", "P", "vendor", "g"),), exclude=("排除",))
    articles = landed.feed_articles(landed.feeds(df), specs.feed_table(spark, (source,)), NOW)
    assert {r.url: (r.source_kind, r.source_name) for r in articles.collect()} == {"https://a.cn/1": ("vendor", "P"), "https://z.cn/2": ("", "z.cn")}


def test_details_fill_what_lacks(spark):
    df = spark.createDataFrame([("s", "https://a.cn/feed", RSS.replace("<pubDate>2026-10-01</pubDate>", ""))], "source string, url string, payload string")
    source = specs.Source("s", feeds=(specs.Feed("f", "https://a.cn/feed", "P"),))
    articles = landed.feed_articles(landed.feeds(df), specs.feed_table(spark, (source,)), NOW)
    details = spark.createDataFrame([("https://a.cn/1", "s", 5.0, "1970-01-01", "i")], "url string, summary string, published_ts double, published string, image_url string")
    row = landed.enriched(articles, details).where("url = 'https://a.cn/1'").first()
    assert (row.published_ts, row.published, row.summary, row.image_url) == (5.0, "1970-01-01", "一 二", "i")


def test_search_results(spark):
    payload = json.dumps({"data": [{"title": "A&amp;B", "share_url": "", "source_url": "https://a.cn", "abstract": "<b>x</b>", "publish_time": "12"}, {"title": "", "share_url": "https://b.cn"}, {"title": "c"}]})
    rows = landed.search_results(spark.createDataFrame([("q", payload), ("r", "broken"), ("s", None)], "query string, payload string")).collect()
    assert [(r.title, r.url, r.summary, r.published_ts) for r in rows] == [("A&B", "https://a.cn", "x", 12.0)]


def test_registry_and_accounts(spark):
    assert [s.name for s in specs.registry()] == ["本地项目", "知乎发现", "B站发现", "今日头条", "公众号RSS", "政策标准", "招投标", "行业媒体", "展会协会", "行业直采", "展会主办方"]
    more = specs.registry(account_search=True)
    assert (more[0].name, more[4].name, len(more)) == ("本地公众号", "微信公众号", 13)
    assert {s.name for s in specs.in_scope(specs.registry(), "local")} == {"本地项目", "公众号RSS"}
    read = specs.Accounts.read('﻿{"sources": [{"name": "a", "scopes": ["local", "odd"], "rss_url": "u"}, {"name": "b", "enabled": false}, {"name": " "}, 3], "queries": {"wechat": [{"keyword": "k"}, {}]}}')
    assert [(a.name, a.scopes) for a in read.feeds()] == [("a", ("local", "wechat"))] and read.queries["wechat"] == (("k", "k"),)
    assert specs.Accounts.read("[") == specs.Accounts() and specs.query_table(spark, specs.registry()).count() == 41


@pytest.mark.parametrize(("html", "want"), [
    ("<meta property='article:published_time' content='2026-10-01T08:00:00Z'><time datetime='2020-01-01'>", ["2026-10-01T08:00:00Z"]),
    ("<a><time datetime='2026-10-02'></time></a><time datetime='2026-10-01'>", ["2026-10-01"]),
    ("<div class='pub-date'>2026-10-01 09:00</div><footer>2020-01-01</footer>", ["2026-10-01 09:00"]),
    ("<script type='application/ld+json'>[{\"datePublished\": \"2026-10-01\"}, 3]</script>", ["2026-10-01"]),
    ("<script type='application/ld+json'>broken</script>", []), (None, []), ("", []),
])
def test_what_dates_a_page(html, want):
    assert pages.metadata(html, "https://a.cn/")[3] == want


def test_addresses_in_scripts():
    assert discovery.script_target("url += 'https://mp.w.com/s?'; url += 'a=1&amp;timestamp=2';") == "https://mp.w.com/s?a=1&timestamp=2"
    assert discovery.script_target("var u = 'https:\\/\\/x.cn\\/1';\nvar v = u;\nwindow.location.href = v;") == "https://x.cn/1"
    assert discovery.script_target("location.replace('http://y.cn')") == "http://y.cn" and discovery.script_target(None) == ""
    assert discovery.lasting_address("https://mp.weixin.qq.com/s?sn=1&scene=2") == ("https://mp.weixin.qq.com/s?sn=1", "loose")
    assert discovery.lasting_address("https://mp.weixin.qq.com/s?scene=2") == ("", "none") == discovery.lasting_address(None)


def test_nothing_is_something(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, keyword string, payload string")
    assert pages.page_metadata(empty).count() == landed.page_links(empty).count() == discovery.embedded(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)], empty.schema)
    assert pages.page_metadata(nulls).first().title == "" and discovery.video_results(nulls).count() == 0


def test_days_are_replaced(spark, tmp_path):
    path = str(tmp_path / "days")
    assert landed.snapshot(spark, path).count() == 0
    sinks.write_day(spark.createDataFrame([(1,), (2,)], "a int"), path, "2026-10-01")
    sinks.write_day(spark.createDataFrame([(3,)], "a int"), path, "2026-10-02")
    sinks.write_day(spark.createDataFrame([(4,)], "a int"), path, "2026-10-01")
    df = landed.snapshot(spark, path)
    assert sorted((str(r.day), r.a) for r in df.collect()) == [("2026-10-01", 4), ("2026-10-02", 3)]
    assert [str(r.day) for r in sinks.available_days(df, 1).collect()] == ["2026-10-02"]
    for day in ("2026-1-01", "20261001", "2026-02-30"):
        with pytest.raises(ValueError):
            landed.snapshot(spark, path, day)


def test_digest_fits(spark):
    row = ("题" * 80, "A", "ai", "PROCUREMENT", "", "无锡", "", ["AGV"] * 30, "切" * 90, "", "", "h")
    df = spark.createDataFrame([(i, *row) for i in range(9)], "_ord long, title string, priority string, research_mode string, stage string, province string, city string, budget string, technical_scope array<string>, entry_point string, last_reported_at string, last_digest_hash string, digest_hash string")
    whole, cut = (sinks.digest(df, "2026-10-01", "https://s.cn", 5, n).first().message for n in (4096, 1200))
    assert whole.count("**") == 10 and "题" * 54 + "…" in whole
    assert len(cut.encode()) <= 1200 and cut.count("…\n") == 5 and "�" not in cut and cut.endswith("(https://s.cn/?scope=opportunity)")


def test_pictures_and_answers(spark):
    df = spark.createDataFrame([("https://qpic.cn/a", "image/png", 100, 200, '{"errcode":0}'), ("https://x.cn/a", "image/webp", 100, 200, '{"errcode":1}'), ("https://x.cn/b", None, None, 404, "x"), (None, None, None, None, None)], "url string, type string, n int, status int, payload string")
    rows = df.select(sinks.local_image("url", "type", "n").alias("i"), sinks.acknowledged("payload").alias("a")).collect()
    assert rows[0].i == "" and rows[1].i.startswith("/images/") and rows[1].i.endswith(".webp") and rows[2].i == "https://x.cn/b" and rows[3].i == ""
    assert [r.a for r in rows[:3]] == ["", "wecom_rejected", "wecom_delivery_failed"]

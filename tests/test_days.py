"""Whole days against their parts, and drops against a plain count."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from granary.adapters import NOW, YEAR
from granary.operators import dedup, diagnostics
from granary.plans import news
from granary.queries import LIMITS, LOCAL_REGIONS

SCHEMA = "_ord long, title string, summary string, url string, source_name string, source_kind string, source_group string, skill_name string, region_scope string, published_ts double, content string, image_url string, wechat_category string"


def day_rows():
    words = ["立体库 投产", "AGV 改造", "物流中心 签约", "堆垛机 中标", "仓储 WMS 升级", "自动化 产线 扩建"]
    out = []
    for i in range(72):
        scope = ["", "local", "discover", "wechat"][i % 4]
        skill = {"": f"媒体{i % 3}", "local": "本地项目", "discover": ["知乎发现", "B站发现"][i // 4 % 2], "wechat": "公众号RSS"}[scope]
        title = f"{'无锡 引进项目 ' if scope == 'local' else ''}{words[i % 6]} {chr(0x4E00 + i * 37)}{chr(0x5E00 + i * 53)}{chr(0x6E00 + i * 11)}{chr(0x7E00 + i * 71)}{chr(0x8E00 + i * 17)}{chr(0x4F00 + i * 29)}"
        out.append((i, title, "摘要", f"https://s{i % 5}.cn/{i}", "来源", "", "", skill, scope, NOW - i * 40_000.0, "", "", "local" if i % 8 == 3 else "industry"))
    return out


def test_a_day_is_its_parts(spark):
    df = spark.createDataFrame(day_rows(), SCHEMA)
    whole = {}
    for r in news.whole_day(df, NOW, YEAR, LOCAL_REGIONS).select("_ord", "page", "published_ts").collect():
        whole.setdefault(r.page, set()).add(r._ord)
    assert set(whole) == {"national", "local", "discover", "wechat"}
    for scope in whole:
        assert {r._ord for r in news.scope_day(df, scope, NOW, YEAR, LOCAL_REGIONS).collect()} == whole[scope]
    assert all(i % 4 == 0 for i in whole["national"]) and all(i % 4 == 2 for i in whole["discover"]) and all(i % 4 == 1 or i % 8 == 3 for i in whole["local"]) and all(i % 8 == 7 for i in whole["wechat"])
    assert len(whole["discover"]) == LIMITS.discover


def test_an_empty_local_page_shows_the_latest(spark):
    old = [(*r[:9], NOW - (40 + r[0]) * 86_400.0, *r[10:]) for r in day_rows()]
    shown = news.scope_day(spark.createDataFrame(old, SCHEMA), "local", NOW, YEAR, LOCAL_REGIONS).collect()
    assert [r._ord for r in shown] == [1, 5, 9]


def test_drops_name_the_limit(spark):
    rows = [(i, f"https://a.cn/{i}", f"g{i % 2}", ["c1", "c2"][i % 3 == 0], 0.0 if i % 5 == 0 else 9.0, "stale" if i % 7 == 0 else "") for i in range(60)]
    df = spark.createDataFrame(rows, "_ord long, url string, source_group string, news_category string, published_ts double, reject_reason string")
    chosen = [r for r in rows if not r[5]][:14]
    got = {r.drop_reason: r.n for r in diagnostics.selection_drops(df, df.where(df["_ord"].isin([r[0] for r in chosen]))).collect()}
    groups, kinds, undated = Counter(r[2] for r in chosen), Counter(r[3] for r in chosen), sum(r[4] == 0 for r in chosen)
    want = Counter()
    for r in rows:
        if r not in chosen:
            want[r[5] or ("publisher_limit" if groups[r[2]] >= LIMITS.per_group else "category_limit" if kinds[r[3]] >= 8 else "unknown_date_limit" if not r[4] and undated >= LIMITS.unknown_dates else "display_limit")] += 1
    assert got == want




def test_refresh_stores_a_day_and_replaces_one_scope(spark, tmp_path):
    from granary import api

    base, df = str(tmp_path), spark.createDataFrame(day_rows(), SCHEMA)
    assert api.news(spark, base, "2024-03-01").count() == 0 and api.status(spark, base).count() == 0
    first = api.refresh(spark, df, base, "2024-03-01", NOW, regions=LOCAL_REGIONS)
    pages = Counter(r.page for r in first.collect())
    assert {s: api.news(spark, base, "2024-03-01", s).count() for s in pages} == pages
    api.refresh(spark, df.where("_ord >= 40"), base, "2024-03-01", NOW + 60, "discover", LOCAL_REGIONS)
    assert api.news(spark, base, "2024-03-01", "discover").agg({"fetched_at": "min"}).first()[0] == NOW + 60
    assert api.news(spark, base, "2024-03-01", "local").count() == pages["local"]
    assert [(str(r.day), r.fetched_at) for r in api.status(spark, base).collect()] == [("2024-03-01", NOW + 60)] and api.days(spark, base).count() == 1
    api.views(spark, base, "2024-03-01")
    assert spark.sql("select count(*) from news_wechat").first()[0] == pages["wechat"] and spark.sql("select * from opportunities").count() == 0


def test_a_day_looks_at_each_article_once(spark):
    looks = spark.sparkContext.accumulator(0)

    def told(text):
        looks.add(1)
        return text

    rows = day_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    seen = df.withColumn("summary", F.udf(told, "string")("summary"))
    got = news.scope_day(seen, "local", NOW, YEAR, LOCAL_REGIONS).select("_ord", "summary").collect()
    assert sorted(r._ord for r in got) == sorted(r._ord for r in news.scope_day(df, "local", NOW, YEAR, LOCAL_REGIONS).collect()) and got
    assert looks.value == sum(r[8] != "" for r in rows)


def test_frequent_characters_are_code_points(spark):
    rows = spark.createDataFrame([("仓a😀é仓",), ("a" * 3,)], "t string").select(F.struct(F.col("t").alias("_title")).alias("row"))
    assert set(dedup._frequent(rows, dedup.characters)) == set("仓a😀é") and list(dedup._frequent(rows, dedup.characters))[-1] == "a"

"""Expectations of the rules with the default vocabulary, on rows made here."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary import lexicon as L
from granary.functions import facts, urls
from granary.functions import text as T
from granary.operators import classify, dedup, filters, history, select
from granary.streaming import states

NOW = 1_760_000_000.0


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("title", "stage"), [("某厂立体库项目招标公告", "PROCUREMENT"), ("自动化立体库中标结果公示", "AWARD"), ("堆垛机维保采购意向公开", "EARLY_SIGNAL"), ("仓储项目废标公告", "CLOSED"), ("WMS 系统询价", "PROCUREMENT"), ("仓库简介", "UNKNOWN"), (None, "UNKNOWN"), ("", "UNKNOWN")])
def test_candidate_stage(spark, title, stage):
    assert one(spark, title, classify.candidate_stage("x", "x")) == stage


@pytest.mark.parametrize(("text", "kind"), [("新建立体库设备改造", "MIXED"), ("年度维保服务", "MAINTENANCE"), ("wms 上线", "SOFTWARE"), ("没有", "UNKNOWN")])
def test_project_type(spark, text, kind):
    assert one(spark, text, classify.project_type(F.col("x"))) == kind


@pytest.mark.parametrize(("text", "words"), [("不含物业服务", []), ("不含 物业服务", []), ("物业服务和不含物业服务", ["物业服务"]), ("保洁服务", ["保洁服务"])])
def test_negated_exclusions(spark, text, words):
    assert one(spark, text, T.unnegated(F.col("x"), L.OPPORTUNITY_EXCLUDES)) == words


@pytest.mark.parametrize(("text", "yuan"), [("预算1,200万元", 12_000_000.0), ("0.5亿元", 50_000_000.0), ("300 元", 300.0), ("无", None), (None, None)])
def test_amount(spark, text, yuan):
    assert one(spark, text, facts.amount("x")) == yuan


@pytest.mark.parametrize(("text", "ts"), [("2026年10月7日", 1791302400.0), ("截止 2026-10-07 08:00", 1791331200.0), ("2026-02-30", 0.0), ("", 0.0), (None, 0.0)])
def test_date(spark, text, ts):
    assert one(spark, text, facts.date_ts("x")) == ts


def test_deadline_lasts_through_its_day(spark):
    start = one(spark, "2026-10-07", facts.date_ts("x"))
    assert not one(spark, "2026-10-07", facts.expired("x", start + 3600))
    assert one(spark, "2026-10-07", facts.expired("x", start + 86400))
    assert one(spark, "2026-10-07 08:00", facts.expired("x", start + 9 * 3600))


@pytest.mark.parametrize(("url", "key", "fetch"), [
    ("https://www.A.com/x/?utm_source=1&b=2&a=1#t", "a.com/x?a=1&b=2", "https://www.a.com/x/?b=2&a=1"),
    ("http://u:p@a.com/", "a.com", ""), ("http://127.0.0.1/x", "127.0.0.1/x", ""), ("http://a.com:8080/", "a.com", ""), ("ftp://a.com/", "a.com", ""), ("nonsense", "nonsense", ""), (None, "", ""),
])
def test_urls(spark, url, key, fetch):
    assert (one(spark, url, urls.page_key("x")), one(spark, url, urls.fetch_url("x"))) == (key, fetch)


def test_known_domain_by_list_order(spark):
    assert one(spark, "https://www.ccgp.gov.cn/a", urls.source_domain("x")) == "gov.cn"
    assert one(spark, "https://m.other.cn/a", urls.source_domain("x")) == "other.cn"


def test_words_need_boundaries(spark):
    assert one(spark, "amr", T.has(F.col("x"), "amr")) and not one(spark, "damrak", T.has(F.col("x"), "amr"))
    assert one(spark, "新amr车", T.has(F.col("x"), "amr"))


def test_assess_reasons(spark):
    rows = [("智能仓储项目交付", "", "", "", "项目案例", ""), ("高考与仓储", "", "", "", "", "irrelevant_content"), ("住宅 AMR", "", "", "", "", "unrelated_topic"), ("天气", "", "", "", "", "no_industry_context"), ("PLC 招标", "", "", "", "", "bidding_without_logistics"), ("CeMAT 物流展", "", "", "", "展会活动", "")]
    df = spark.createDataFrame(rows, "title string, summary string, skill_name string, source_kind string, c string, r string")
    for r in classify.assess(df).collect():
        assert (r.news_category, r.assess_reason) == (r.c, r.r), r.title


def articles(rng, n):
    return [(i, f"标题{rng.randint(0, 9)}" + "仓储输送系统项目正式投产运行成功"[: rng.randint(6, 16)], "", f"https://h{rng.randint(0, 4)}.cn/{rng.randint(0, 30)}", rng.choice(["vendor", "", "aggregator"]), rng.choice(["h.cn", "toutiao.com"]), rng.choice([0.0, NOW - rng.randint(0, 9) * 86400.0]), rng.randint(0, 5) / 10, f"g{rng.randint(0, 3)}", f"c{rng.randint(0, 2)}") for i in range(n)]


SCHEMA = "_ord long, title string, summary string, url string, source_kind string, source_domain string, published_ts double, quality_score double, source_group string, news_category string"


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_and_capacity_do_not_depend_on_partitions(spark, seed):
    df = spark.createDataFrame(articles(random.Random(seed), 60), SCHEMA)
    a = sorted(r._ord for r in dedup.leaders_national(df.repartition(1)).select("_ord").collect())
    b = sorted(r._ord for r in dedup.leaders_national(df.repartition(7)).select("_ord").collect())
    assert a == b and 0 < len(a) < 60


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_capacity_equals_the_walk(spark, seed):
    rows = articles(random.Random(seed), 80)
    limits = L.Limits(national=12, per_group=4, unknown_dates=2)
    groups, cats, undated, want = {}, {}, 0, []
    for r in sorted(rows, key=lambda r: (-r[7], r[0])):
        if len(want) == 12:
            break
        if groups.get(r[8], 0) >= 4 or cats.get(r[9], 0) >= 4 or (r[6] == 0 and undated >= 2):
            continue
        groups[r[8]], cats[r[9]] = groups.get(r[8], 0) + 1, cats.get(r[9], 0) + 1
        undated += r[6] == 0
        want.append(r[0])
    got = select.capacity(spark.createDataFrame(rows, SCHEMA), limits).orderBy("selected").collect()
    assert [r._ord for r in got] == want


def test_account_filter_and_empty_names(spark):
    accounts = spark.createDataFrame([("无锡发布", ["锡发"])], "name string, aliases array<string>")
    df = spark.createDataFrame([("无锡发布官方",), ("锡发",), ("",), (None,), ("别的",)], "source_name string")
    assert filters.account_scope(df, accounts).count() == 2


def test_history_key_wins_over_page(spark):
    i = spark.createDataFrame([(1, "k1", "t", "", "", ["https://a.cn/1"]), (2, "zz", "", "A", "", ["https://a.cn/1"])], "_ord long, project_key string, title string, owner string, city string, pages array<string>")
    x = spark.createDataFrame([(1, "k0", "q", "B", "", ["https://a.cn/1"]), (2, "k1", "w", "", "", [])], "index_ord long, project_key string, title string, owner string, city string, pages array<string>")
    assert {r._ord: r.index_ord for r in history.match(i, x).collect()} == {1: 2}


def test_guard_steps():
    g = states.Guard()
    assert [g.step(0, False, 0), g.step(1, False, 0), g.step(2, True, 3), g.step(1000, True, 3), g.step(1001, True, 3), g.step(9000, True, 0)] == ["failed", "failed", "cooldown_skip", "live", "cache", "live"]


def test_guard_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), i, float(i * rng.choice([1, 400])), rng.random() < 0.5, rng.randint(0, 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, seq long, ts double, ok boolean, rows int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = states.source_guard_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("guard").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    want = sorted(map(tuple, states.source_guard(df).collect()))
    assert sorted(map(tuple, spark.table("guard").collect())) == want

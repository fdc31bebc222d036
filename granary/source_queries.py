"""Queries of sources, pages and dates over payloads made of the test tables, with SQL that knows how they were made."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import NOW, table
from .functions import dates
from .lexicon import AUTH_FAILURE
from .operators import filters, research
from .plans import candidates
from .sources import discovery, landed, pages, queries_reader, specs
from .tables import scratch


def _s(x: str | Column) -> Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


_M, _D = "event_id % 12 + 1", "event_id % 28 + 1"


def news_dates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    m, day = F.expr(_M).cast("int"), F.expr(_D).cast("int")
    y = F.lit("2024-")
    forms = [
        F.concat(F.lit("发布于2024年"), m.cast("string"), F.lit("月"), day.cast("string"), F.lit("日")),
        F.concat(F.lit("t "), y, _two(m), F.lit("-"), _two(day), F.lit("T10:30:00Z x")),
        F.concat(y, _two(m), F.lit("-"), _two(day), F.lit(" 23:15")),
        F.concat(_two(m), F.lit("-"), _two(day), F.lit("  2024")),
        F.concat(y, m.cast("string"), F.lit("/31 and 2024/5/5")),
        F.lit("no date 2024"),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    shown = e.withColumn("text", text)
    one, both = dates.news_date("text"), dates.unique_date(F.array("text", F.when(F.col("event_id") % 5 == 0, F.concat(y, F.lit("01-01"))).otherwise("-")))
    return shown.select("event_id", one["ts"].alias("ts"), one["label"].alias("label"), both["label"].alias("agreed"), dates.article_date("text", F.col("event_id") * 86400.0).alias("shown"))


NEWS_DATES_SQL = f"""
with e as (select event_id, event_id % 6 as k, {_M} as m, {_D} as d from events),
t as (select *, case k when 4 then try_strptime(printf('2024-%02d-31', m), '%Y-%m-%d') when 5 then null else strptime(printf('2024-%02d-%02d', m, d), '%Y-%m-%d') end as day from e),
u as (select *, case when day is null then 0.0 else epoch(day) + case k when 1 then 37800 when 2 then 83700 - 28800 else -28800 end end as ts from t),
v as (select *, case when day is null then '' else strftime(day, '%Y-%m-%d') end as label from u)
select event_id, cast(ts as double) as ts, label, case when event_id % 5 <> 0 then label when label in ('', '2024-01-01') then '2024-01-01' else '' end as agreed,
  case when k in (3, 5) then strftime(make_timestamp(cast((event_id * 86400 + 28800) as bigint) * 1000000), '%Y-%m-%d') when label = '' then strftime(make_timestamp(cast((event_id * 86400 + 28800) as bigint) * 1000000), '%Y-%m-%d') else label end as shown from v"""


def _article_page(doc_id: Column, text: Column) -> Column:
    """A page with a title, a date in one of four places, a picture, and the text's first characters as its paragraph."""
    n, day = _s(doc_id), F.concat(F.lit("2024-02-"), _two((doc_id % 28 + 1).cast("int")))
    head = F.concat(F.lit('<html><head><meta property="og:image" content="/i/'), n, F.lit('.png">'))
    meta = F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T08:00:00+08:00">'))
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"datePublished":"'), day, F.lit('"}]}</script>'))
    node = F.concat(F.lit('<span class="pubTime">'), day, F.lit("</span><a><span class='date'>2020-01-01</span></a>"))
    clash = F.concat(meta, F.lit('<meta name="pubdate" content="2023-12-31">'))
    k = doc_id % 4
    plain = F.regexp_replace(F.substring(text, 1, 90), "[^A-Za-z ]+", "")
    body = F.concat(F.lit("<h1>Title "), n, F.lit("</h1>"), F.when(k == 2, node).otherwise(""), F.lit("<article><p>"), plain, F.lit("</p></article><footer><p>foot 2019-01-01</p></footer>"))
    return F.concat(head, F.when(k == 0, meta).when(k == 1, ld).when(k == 3, clash).otherwise(""), F.lit("</head><body>"), body, F.lit("</body></html>"))


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    landed_pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://n.example.com/a/"), _s("doc_id")).alias("url"), _article_page(F.col("doc_id"), F.col("text")).alias("html"))
    seen = pages.page_metadata(landed_pages).join(pages.page_publication(landed_pages).select("page_id", F.col("published_ts").alias("stated_ts"), "quote"), "page_id")
    return seen.select("page_id", "title", "summary", "image_url", "published_ts", "published", "stated_ts", F.length("quote").alias("n_quote"))


_PLAIN = "trim(regexp_replace(regexp_replace(substr(text, 1, 90), '[^A-Za-z ]+', '', 'g'), ' +', ' ', 'g'))"
METADATA_SQL = f"""
with b as (select doc_id as page_id, doc_id % 4 as k, doc_id % 28 + 1 as dd, {_PLAIN} as p from documents)
select page_id, 'Title ' || page_id as title, p as summary, 'https://n.example.com/i/' || page_id || '.png' as image_url,
  case when k = 3 then 0.0 else epoch(strptime(printf('2024-02-%02d', dd), '%Y-%m-%d')) + case when k = 0 then 0 else -28800 end end as published_ts, case when k = 3 then '' else printf('2024-02-%02d', dd) end as published,
  case when k = 0 then epoch(strptime(printf('2024-02-%02d', dd), '%Y-%m-%d')) when k = 1 then epoch(strptime(printf('2024-02-%02d', dd), '%Y-%m-%d')) - 28800 else 0.0 end as stated_ts,
  case k when 0 then length('<meta property="article:published_time" content="2024-02-01T08:00:00+08:00">') when 1 then length('"datePublished":"2024-02-01"') else 0 end as n_quote from b"""


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = F.col("doc_id")
    html = F.concat(F.lit("<html><nav>skip me</nav><body><p>"), F.regexp_replace(F.substring("text", 1, 200), "[^A-Za-z ]+", ""), F.lit('</p><a href="/f/'), _s("doc_id"), F.lit('.pdf">f</a><a href="/f/'), _s("doc_id"), F.lit('.pdf?utm_source=x">g</a><a href="http://[bad/x.pdf">h</a><script>no</script></body></html>'))
    landing = docs.select(n.alias("page_id"), F.concat(F.lit("https://d.example.com/"), F.when(n % 11 == 0, "wappoc_appmsgcaptcha/").otherwise(""), _s("doc_id")).alias("url"), F.when(n % 7 == 0, 404).otherwise(200).alias("status"), F.when(n % 5 == 0, "image/png").otherwise("text/html; charset=utf-8").alias("content_type"), F.when(n % 13 == 0, 3_000_000).otherwise(1000).cast("long").alias("n_bytes"), html.alias("html"))
    return pages.page_documents(landing).select("page_id", "failure", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.array_join(F.coalesce("attachment_urls", F.array().cast("array<string>")), ",").alias("attachments"), F.coalesce(F.array_join("risk_flags", ","), F.lit("")).alias("flags"))


_VISIBLE = "trim(regexp_replace(regexp_replace(substr(text, 1, 200), '[^A-Za-z ]+', '', 'g') , ' +', ' ', 'g'))"
DOCUMENTS_SQL = f"""
with b as (select doc_id as page_id, {_VISIBLE} as p from documents),
f as (select *, case when page_id % 7 = 0 then 'source_http_404' when page_id % 11 = 0 then 'source_access_challenge' when page_id % 5 = 0 then 'source_unsupported_content' when page_id % 13 = 0 then 'html_size_limit' else '' end as early from b),
t as (select *, case when length(p) >= 60 then length(p) else length(trim(p || ' f g h')) + case when p = '' then -1 + 1 else 0 end end as n0 from f),
g as (select *, case when early <> '' then early when n0 < 60 then 'source_text_unavailable' else '' end as failure from t)
select page_id, failure, cast(case when failure = '' then n0 else 0 end as int) as n, case when failure = '' then 'https://d.example.com/f/' || page_id || '.pdf' else '' end as attachments, '' as flags from g"""


def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Listing pages made of the parts of one size: a card each, with a date and a picture, beside navigation and broken links."""
    part = table(spark, d, "part")
    n = _s("p_partkey")
    card = F.concat(F.lit('<li><a href="/news/'), n, F.lit('.html" title="'), F.col("p_name"), F.lit(" number "), n, F.lit('">x</a><div class="brief">About '), F.col("p_name"), F.lit('</div><span class="date">2024-03-'), _two((F.col("p_partkey") % 31 + 1).cast("int")), F.lit('</span><img src="/p/'), n, F.lit('.jpg"></li>'))
    page = F.concat(F.lit('<nav><a href="/news/0.html">Navigation is no article</a></nav><a href="http://[bad/1">A broken link with a title</a><ul>'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), ""), F.lit('</ul><a href="/about/">About this company page</a><footer><a href="/news/9.html">Footer is no article</a></footer>'))
    made = part.groupBy(F.col("p_size").cast("long").alias("page_id"), F.pmod(F.xxhash64("p_name"), F.lit(1)).alias("z")).agg(page.alias("html")).select("page_id", F.concat(F.lit("https://l.example.com/list/"), _s("page_id")).alias("url"), "html")
    return landed.page_links(made)


LINKS_SQL = """
with r as (select *, row_number() over (partition by p_size order by p_partkey) - 1 as position from part)
select cast(p_size as bigint) as page_id, cast(position as int) as position, p_name || ' number ' || p_partkey as title, 'https://l.example.com/news/' || p_partkey || '.html' as url, 'About ' || p_name as summary, 'https://l.example.com/p/' || p_partkey || '.jpg' as image_url,
  epoch(strptime(printf('2024-03-%02d', p_partkey % 31 + 1), '%Y-%m-%d')) - 28800 as published_ts, printf('2024-03-%02d', p_partkey % 31 + 1) as published
from r where position < 120"""

_FEED = "https://www.f{}.example.com/feed"


def _feed_landing(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of suppliers: an item a part, on the feed's own site or another."""
    s = table(spark, d, "part").select((F.col("p_partkey") % 50 + 1).alias("s_suppkey")).distinct()
    part = table(spark, d, "part").withColumn("s_suppkey", F.col("p_partkey") % 50 + 1)
    n = _s("p_partkey")
    site = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://other.example.org/"), n)).otherwise(F.concat(F.lit("https://www.f"), _s("s_suppkey"), F.lit(".example.com/"), n))
    item = F.concat(F.lit("<item><title>"), F.when(F.col("p_partkey") % 4 == 0, "物流 ").when(F.col("p_partkey") % 4 == 1, "招聘 物流 ").otherwise("仓储 AGV "), n, F.lit("</title><link>"), site, F.lit("</link><description>text</description><pubDate>Thu, 29 Feb 2024 "), _two((F.col("p_partkey") % 24).cast("int")), F.lit(":00:00 +0000</pubDate></item>"))
    items = part.groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x["i"]), "").alias("items"))
    return s.join(items, "s_suppkey").select(F.lit("来源").alias("source"), F.concat(F.lit("https://www.f"), _s("s_suppkey"), F.lit(".example.com/feed")).alias("url"), F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("payload"), F.lit(200).alias("status"))


def feed_articles(spark: SparkSession, d: str) -> DataFrame:
    source = specs.Source("来源", feeds=tuple(specs.Feed(f"f{i}", _FEED.format(i), f"Publisher {i}", "industry_media", f"g{i}") for i in range(1, 51)), include=("物流", "agv"), exclude=("招聘",), per_feed=10)
    entries = landed.feeds(_feed_landing(spark, d))
    return landed.feed_articles(entries, specs.feed_table(spark, (source,)), NOW).select("collection_url", "position", "title", "url", "source_name", "source_kind", "source_group", "published_ts", "quality_score")


FEED_SQL = """
with p as (select p_partkey as k, p_partkey % 50 + 1 as s, p_partkey % 4 as w, p_partkey % 3 = 0 as foreign_, p_partkey % 24 as h from part),
o as (select *, row_number() over (partition by s order by k) - 1 as position from p),
c as (select *, case w when 0 then 55 else 80 end * 65 + 2000 + case when foreign_ then 0 else 700 end as q from o where w <> 1 and position < 120),
r as (select *, row_number() over (partition by s order by q desc, position) as n from c)
select 'https://www.f' || s || '.example.com/feed' as collection_url, cast(position as int) as position, case w when 0 then '物流 ' else '仓储 AGV ' end || k as title, case when foreign_ then 'https://other.example.org/' || k else 'https://www.f' || s || '.example.com/' || k end as url,
  case when foreign_ then 'other.example.org' else 'Publisher ' || s end as source_name, case when foreign_ then '' else 'industry_media' end as source_kind, case when foreign_ then 'other.example.org' else 'g' || s end as source_group,
  epoch(strptime('2024-02-29', '%Y-%m-%d')) + h * 3600 as published_ts, cast(q as double) / 10000 as quality_score from r where n <= 10"""


def feed_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of landed listings: broken, dynamic, empty, filtered and good ones."""
    s = table(spark, d, "customer")
    k = F.col("c_custkey") % 5
    page = F.when(k == 0, "<div v-for='x'>{{title}}</div>").when(k == 1, "<p>nothing</p>").when(k == 2, "<li><a href='/n/1.html' title='A title about nothing much'>x</a></li>").otherwise("<li><a href='/n/1.html' title='A title about 物流 of sorts'>x</a></li>")
    landing = s.select(F.lit("来源").alias("source"), F.concat(F.lit("https://c"), _s("c_custkey"), F.lit(".example.com/l")).alias("url"), page.alias("payload"), F.when(k == 4, 503).otherwise(200).alias("status"))
    source = landing.select("source", F.col("url").alias("feed_url"), F.lit("P").alias("publisher"), F.lit("vendor").alias("kind"), F.lit("").alias("group"), F.lit("").alias("pattern"), F.array(F.lit("物流")).alias("include"), F.array().cast("array<string>").alias("exclude"), F.lit(10).alias("per_feed"), F.lit("national").alias("region_scope"), F.lit(0).alias("position"))
    entries = landed.feeds(landing.where("status = 200"))
    return landed.feed_reports(landing, entries, landed.feed_articles(entries, source, NOW))


REPORTS_SQL = "select '来源' as source, 'https://c' || c_custkey || '.example.com/l' as feed_url, cast(case when c_custkey % 5 in (2, 3) then 1 else 0 end as bigint) as parsed, cast(case when c_custkey % 5 = 3 then 1 else 0 end as bigint) as returned, ['dynamic_page_unparsed', 'no_article_links', 'keyword_filtered_empty', 'ok', 'http_503'][c_custkey % 5 + 1] as status from customer"


def _search_payload(key: Column, title: Column, url: Column) -> Column:
    return F.to_json(F.struct(F.array(F.struct(title.alias("title"), url.alias("share_url"), F.lit("摘要").alias("abstract"), F.lit("媒体").alias("media_name"), key.cast("string").alias("publish_time"))).alias("data")))


def bidding_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The bidding source: a layer of feeds, then filtered searches; one row an address, the first layer's."""
    part, orders = table(spark, d, "part"), table(spark, d, "orders")
    feeds = part.select(F.col("p_partkey").alias("_ord"), F.concat(F.lit("公告 "), "p_name").alias("title"), F.concat(F.lit("https://b.example.com/"), _s(F.col("p_partkey") % 700)).alias("url"), F.lit("official").alias("source_kind"))
    key = F.col("o_orderkey")
    word = F.element_at(F.array(*map(F.lit, ("仓储 招标", "保洁 招标", "news", "wms"))), (key % 4 + 1).cast("int"))
    searches = orders.select(key.alias("_ord"), _search_payload(key, word, F.concat(F.lit("https://b.example.com/"), _s(key % 1500))).alias("payload"))
    found = landed.keyword_search(searches, specs.BIDDING.include, specs.BIDDING.exclude, "招投标搜索")
    return landed.first_wins([feeds, found], specs.BIDDING.name).select("_ord", "title", "url", "source_kind", "source_name", "skill_name")


BIDDING_SQL = """
with f as (select 0 as l, p_partkey as _ord, '公告 ' || p_name as title, 'https://b.example.com/' || (p_partkey % 700) as url, 'official' as source_kind, cast(null as varchar) as source_name from part),
s as (select 1 as l, o_orderkey as _ord, ['仓储 招标', '保洁 招标', 'news', 'wms'][o_orderkey % 4 + 1] as title, 'https://b.example.com/' || (o_orderkey % 1500) as url, 'aggregator' as source_kind, '招投标搜索/媒体' as source_name from orders where o_orderkey % 4 in (0, 3)),
u as (select * from f union all select * from s)
select _ord, title, url, source_kind, source_name, '招投标' as skill_name from u qualify row_number() over (partition by url order by l, _ord) = 1"""


def organizer_news(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    rows = F.array(F.struct(F.when(k % 7 == 0, "x1").otherwise(_s(k)).alias("id"), F.when(k % 3 == 0, F.concat(F.lit("物流展 动态 "), _s(k))).otherwise(F.concat(F.lit("无关 "), _s(k))).alias("wzmc"), F.lit("2024/2/3 10:00").alias("addtime"), F.lit("/p/1.png").alias("wznr")))
    payload = F.to_json(F.struct(F.when(k % 5 == 0, "002").otherwise("001").alias("code"), F.struct(rows.alias("zslist")).alias("data")))
    return landed.organizer_news(o.select(k.alias("key"), payload.alias("payload"))).select("key", "title", "url", "published", "image_url", "news_category")


ORGANIZER_SQL = "select o_orderkey as key, '物流展 动态 ' || o_orderkey as title, 'https://www.chinalet.cn/home/news_x.html?id=' || o_orderkey as url, '2024-02-03' as published, 'https://www.chinalet.cn/p/1.png' as image_url, '展会活动' as news_category from orders where o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 3 = 0"


def account_articles(spark: SparkSession, d: str) -> DataFrame:
    """Entries of account feeds: those past the bound go, placeholders of a failed login too."""
    o = table(spark, d, "orders")
    k = F.col("o_custkey") % 40
    n = F.row_number().over(_by("acc", "o_orderkey"))
    rows = o.withColumn("acc", k).withColumn("position", n - 1)
    entries = rows.select("position", F.concat(F.lit("账号"), _s("acc")).alias("source"), F.concat(F.lit("https://r.example.com/"), _s("acc")).alias("feed_url"), F.when(F.col("o_orderkey") % 9 == 0, "请扫码登录后查看").otherwise(F.concat(F.lit("文章 "), _s("o_orderkey"))).alias("title"), F.concat(F.lit("https://mp.example.com/"), _s("o_orderkey")).alias("url"), F.lit("").alias("summary"), F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(100.0).alias("published_ts"), F.lit(50.0).alias("updated_ts"))
    accounts = specs.account_table(spark, tuple(specs.Account(f"账号{i}", ("local",) if i % 4 == 0 else ("wechat",), (), f"https://r.example.com/{i}") for i in range(40)))
    good, failed = landed.account_feed(entries, accounts, AUTH_FAILURE)
    return good.select("title", "url", "region_scope", "wechat_category", "published_ts").unionByName(failed.select("title", F.col("source").alias("url"), F.lit("failed").alias("region_scope"), F.col("keyword").alias("wechat_category"), F.lit(0.0).alias("published_ts")))


def _by(key: str, order: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


ACCOUNT_SQL = """
with o as (select o_orderkey as k, o_custkey % 40 as a, row_number() over (partition by o_custkey % 40 order by o_orderkey) as n from orders)
select case when k % 9 = 0 then '请扫码登录后查看' else '文章 ' || k end as title, case when k % 9 = 0 then '账号' || a else 'https://mp.example.com/' || k end as url,
  case when k % 9 = 0 then 'failed' when a % 4 = 0 then 'local' else 'wechat' end as region_scope, case when k % 9 = 0 then '扫码登录' when a % 4 = 0 then 'local' else 'industry' end as wechat_category, case when k % 9 = 0 then 0.0 when k % 2 = 0 then 50.0 else 100.0 end as published_ts
from o where n <= 20"""


def official_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Official lists of bytes in one charset that name another."""
    part = table(spark, d, "part")
    n = _s("p_partkey")
    link = F.concat(F.lit("<a class=x href='./t"), n, F.lit(".htm'>"), F.when(F.col("p_partkey") % 2 == 0, "采购 WMS <b>系统</b> ").otherwise("采购 办公 用品 桌椅 "), n, F.lit("</a>"))
    made = part.withColumn("b", F.floor(F.col("p_partkey") / 50)).groupBy("b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", link.alias("l")))), lambda x: x["l"]), "\n").alias("html"))
    rows = made.select(F.col("b").alias("page_id"), F.concat(F.lit("https://www.ccgp.gov.cn/l/"), _s("b"), F.lit("/index.htm")).alias("url"), F.encode("html", "UTF-8").alias("content"), F.lit("utf-8").alias("charset"), F.lit("官方").alias("label"))
    read = rows.drop("content").join(pages.decoded_pages(rows), "page_id")
    return pages.official_candidates(read)


OFFICIAL_SQL = """
with p as (select p_partkey as k, p_partkey // 50 as b from part where p_partkey % 2 = 0), r as (select *, row_number() over (partition by b order by k) - 1 as position from p)
select cast(b as bigint) as page_id, cast(position as int) as position, '采购 WMS 系统 ' || k as title, 'https://www.ccgp.gov.cn/l/' || b || '/t' || k || '.htm' as url, '官方' as source_name from r where position < 80"""


def engine_results(spark: SparkSession, d: str) -> DataFrame:
    """Result pages in three forms: blocks, bare links, and escaped addresses."""
    c = table(spark, d, "customer")
    n, k = _s("c_custkey"), F.col("c_custkey") % 3
    target = F.concat(F.lit("https://www.zhihu.com/question/"), n)
    block = F.concat(F.lit('<li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u='), F.url_encode(target), F.lit('">Question <b>'), n, F.lit("</b></a></h2><p>Text of it</p></li><li class=\"b_algo\"><h2><a href=\"https://elsewhere.example.com/\">Other</a></h2></li>"))
    link = F.concat(F.lit('<div><a class="r" href="'), target, F.lit('">Question '), n, F.lit('</a><a href="'), target, F.lit('">Question again</a></div>'))
    escaped = F.concat(F.lit("<script>go('"), F.url_encode(target), F.lit("')</script>"))
    landing = c.select(F.col("c_custkey").alias("page_id"), F.when(k == 0, block).when(k == 1, link).otherwise(escaped).alias("html"))
    return discovery.results(landing, ("zhihu.com/question",), source_name="知乎")


ENGINE_SQL = "select c_custkey as page_id, 0 as position, case when c_custkey % 3 = 2 then '' || c_custkey else 'Question ' || c_custkey end as title, 'https://www.zhihu.com/question/' || c_custkey as url, case when c_custkey % 3 = 0 then 'Text of it' else '来自搜索引擎的知乎相关结果。' end as summary from customer"


def discovery_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Per search the interface's rows, else the embedded state's, else bare addresses, else a placeholder that the engine may replace."""
    c = table(spark, d, "customer")
    n, k = _s("c_custkey"), F.col("c_custkey") % 5
    word = F.concat(F.lit("词"), n)
    searches = c.select(word.alias("keyword"), F.concat(F.lit("https://www.zhihu.com/search?q="), n).alias("search_url"))
    obj = F.to_json(F.struct(F.array(*[F.struct(F.struct(F.lit("answer").alias("type"), _s(F.col("c_custkey") * 10 + i).alias("id"), F.lit("").alias("url"), F.lit(f"<em>Ans</em> {i}").alias("title"), F.struct(n.alias("id")).alias("question")).alias("object")) for i in range(2)]).alias("data")))
    api = discovery.answer_results(c.where(k == 0).select(word.alias("keyword"), obj.alias("payload")))
    state = F.concat(F.lit('<script id="js-initialData" type="text/json">{"a":{"b":[{"title":"State 1","url":"/api/v4/questions/'), n, F.lit('"},{"title":"State 2","id":"77"},{"title":"Again","url":"/question/77"}]}}</script>'))
    embedded = discovery.embedded(c.where(k <= 1).select(word.alias("keyword"), state.alias("html")), key="keyword")
    bare = discovery.page_answers(c.where(k == 2).select(word.alias("keyword"), F.concat(F.lit("x https://www.zhihu.com/question/"), n, F.lit(" https://zhuanlan.zhihu.com/p/9 https://www.zhihu.com/question/"), n).alias("html")))
    engine = c.where(k.isin(0, 3)).select(word.alias("keyword"), F.lit(0).alias("position"), F.lit("Engine").alias("title"), F.concat(F.lit("https://www.zhihu.com/p/"), n).alias("url"), F.lit("s").alias("summary"))
    return discovery.cascade(searches, [api, embedded, bare], engine, "知乎").select("keyword", "position", "title", "url")


CASCADE_SQL = """
with c as (select c_custkey as n, '词' || c_custkey as keyword, c_custkey % 5 as k from customer)
select keyword, cast(i as int) as position, 'Ans ' || i as title, 'https://www.zhihu.com/question/' || n || '/answer/' || (n * 10 + i) as url from c, (select unnest([0, 1]) as i) where k = 0
union all select keyword, 0, 'State 1', 'https://www.zhihu.com/question/' || n from c where k = 1 union all select keyword, 1, 'State 2', 'https://www.zhihu.com/question/77' from c where k = 1 and n <> 77
union all select keyword, 0, '知乎：' || keyword || ' [' || n || ']', 'https://www.zhihu.com/question/' || n from c where k = 2 union all select keyword, 1, '知乎：' || keyword || ' [9]', 'https://zhuanlan.zhihu.com/p/9' from c where k = 2
union all select keyword, 0, 'Engine', 'https://www.zhihu.com/p/' || n from c where k = 3
union all select keyword, 0, '知乎搜索：' || keyword, 'https://www.zhihu.com/search?q=' || n from c where k = 4"""


def account_search(spark: SparkSession, d: str) -> DataFrame:
    """Result blocks of account searches, kept where the source is a configured account, and their addresses resolved."""
    c = table(spark, d, "customer")
    n, k = _s("c_custkey"), F.col("c_custkey") % 4
    block = F.concat(F.lit('<li id="sogou_vr_1" d><div class="img-box"><a><img src="//i.example.com/'), n, F.lit('.png"></a></div><h3><a href="/link?url=abc&amp;timestamp='), n, F.lit('"><em><!--red_beg-->文章<!--red_end--></em> '), n, F.lit('</a></h3><p class="txt-info">摘要</p><span class="all-time-y2">'), F.when(F.col("c_custkey") % 3 == 0, "无锡发布").otherwise("路人"), F.lit("</span><script>timeConvert('17000"), F.lpad(F.substring(n, 1, 5), 5, "0"), F.lit("')</script></li>"))
    page = F.when(F.col("c_custkey") % 10 == 9, "请输入验证码").otherwise(block)
    rows = discovery.account_results(c.select(F.col("c_custkey").alias("page_id"), F.lit("https://weixin.sogou.com/weixin").alias("url"), page.alias("html")))
    accounts = specs.account_table(spark, (specs.Account("无锡发布"),))
    ours = filters.account_scope(rows, accounts).withColumnRenamed("page_id", "_ord")
    real = F.concat(F.lit("https://mp.weixin.qq.com/s?__biz=B"), n, F.lit("&mid="), n, F.lit("&idx=1&scene=5"))
    script = F.concat(F.lit("var url = '';\nurl += 'https://mp.weixin.qq.com/s?__biz=B"), n, F.lit("&mid="), n, F.lit("';\nurl += '&idx=1&scene=5';"))
    landing = c.select(F.concat(F.lit("https://weixin.sogou.com/link?url=abc&timestamp="), n).alias("url"), F.when(k == 0, real).otherwise("").alias("location"), F.when(k == 1, script).when(k == 2, F.lit("var msg_link = \"https://mp.weixin.qq.com/s?sn=s1&amp;timestamp=3\";")).otherwise("").alias("html"))
    return discovery.resolved(ours, landing).select("_ord", "title", "source_name", "image_url", "published_ts", "resolved_url", "resolved_by")


ACCOUNT_SEARCH_SQL = """
with c as (select c_custkey as n, c_custkey % 4 as k from customer where c_custkey % 3 = 0 and c_custkey % 10 <> 9)
select n as _ord, '文章 ' || n as title, '无锡发布' as source_name, 'https://i.example.com/' || n || '.png' as image_url, cast('17000' || lpad(substr('' || n, 1, 5), 5, '0') as double) as published_ts,
  case k when 3 then 'https://weixin.sogou.com/weixin?type=2&query=' || url_encode('无锡发布') || '+' || url_encode('文章') || '+' || n when 2 then 'https://mp.weixin.qq.com/s?sn=s1' else 'https://mp.weixin.qq.com/s?__biz=B' || n || '&mid=' || n || '&idx=1' end as resolved_url,
  case k when 3 then 'failed' when 2 then 'loose' else 'strict' end as resolved_by from c"""


def account_history(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    n = _s("c_custkey")
    data = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("c_custkey").alias("datetime")).alias("comm_msg_info"), F.struct(F.concat(F.lit("头条 "), n).alias("title"), F.concat(F.lit("/s?__biz=1&amp;mid="), n).alias("content_url"), F.array(F.struct(F.lit("次条").alias("title"), F.lit("//mp.weixin.qq.com/s?mid=2").alias("content_url")), F.struct(F.lit("").alias("title"), F.lit("x").alias("content_url"))).alias("multi_app_msg_item_list")).alias("app_msg_ext_info"))).alias("list")))
    return discovery.account_history(c.select(n.alias("account"), F.concat(F.lit("<script>var msgList = "), data, F.lit(";</script>")).alias("html")))


HISTORY_PAGE_SQL = "select '' || c_custkey as account, 0 as position, '头条 ' || c_custkey as title, 'https://mp.weixin.qq.com/s?__biz=1&mid=' || c_custkey as url, cast(c_custkey as double) as published_ts from customer union all select '' || c_custkey, 1, '次条', 'https://mp.weixin.qq.com/s?mid=2', cast(c_custkey as double) from customer"


def web_addresses(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = _s("event_id")
    k = (F.col("event_id") % 7 + 1).cast("int")
    url = F.element_at(F.array(F.concat(F.lit("//www.zhihu.com/api/v4/questions/"), n), F.concat(F.lit("https://api.zhihu.com/api/v4/articles/"), n), F.concat(F.lit("/api/v4/answers/"), n), F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), n), F.lit(""), F.lit(""), F.lit("x")), k)
    kind = F.element_at(F.array(*map(F.lit, ("", "", "", "", "Answer", "article", "topic"))), k)
    return e.select("event_id", discovery.web_address(url, kind, F.when(k == 7, "abc").otherwise(n), F.when(F.col("event_id") % 2 == 0, "5").otherwise("")).alias("url"))


WEB_SQL = """
select event_id, case event_id % 7 when 0 then 'https://www.zhihu.com/question/' || event_id when 1 then 'https://zhuanlan.zhihu.com/p/' || event_id
  when 2 then case when event_id % 2 = 0 then 'https://www.zhihu.com/question/5/answer/' || event_id else 'https://www.zhihu.com/answer/' || event_id end when 3 then 'https://zhuanlan.zhihu.com/p/' || event_id
  when 4 then case when event_id % 2 = 0 then 'https://www.zhihu.com/question/5/answer/' || event_id else 'https://www.zhihu.com/answer/' || event_id end when 5 then 'https://zhuanlan.zhihu.com/p/' || event_id else '' end as url from events"""


def video_results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = _s("event_id")
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit('<em class="k">AGV</em> '), n).alias("title"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("http://www.bilibili.com/video/av"), n)).otherwise("").alias("arcurl"), F.concat(F.lit("BV"), n).alias("bvid"), F.lit("介绍").alias("description"), F.concat(F.lit("//i0.hdslb.com/"), n).alias("pic"), F.lit("UP").alias("author"), F.col("event_id").cast("double").alias("pubdate"))).alias("result")).alias("data")))
    return discovery.video_results(e.select(n.alias("keyword"), payload.alias("payload")))


VIDEO_SQL = "select '' || event_id as keyword, 0 as position, 'AGV ' || event_id as title, case when event_id % 2 = 0 then 'http://www.bilibili.com/video/av' || event_id else 'https://www.bilibili.com/video/BV' || event_id end as url, '介绍' as summary, 'https://i0.hdslb.com/' || event_id as image_url, 'B站/UP' as author, cast(event_id as double) as published_ts from events"


def web_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = _s("event_id")
    result = F.struct(F.concat(F.lit("项目 "), n, F.when(F.col("event_id") % 2 == 0, "（发布时间：2024-02-03）").otherwise("")).alias("title"), F.concat(F.lit("https://w.example.com/"), n).alias("link"), F.lit("正文").alias("content"), F.lit("站").alias("media"), F.when(F.col("event_id") % 3 == 0, "2024-02-05").otherwise("").alias("publish_time"))
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.array(result).alias("search_result"))).alias("tool_calls")).alias("message"))).alias("choices")))
    return discovery.web_results(e.select(n.alias("query"), payload.alias("payload"))).select("query", "title", "url", "source_name", "published", "published_ts")


WEB_SEARCH_SQL = "with e as (select event_id as n, case when event_id % 3 = 0 then '2024-02-05' when event_id % 2 = 0 then '2024-02-03' else '' end as p from events) select '' || n as query, '项目 ' || n as title, 'https://w.example.com/' || n as url, 'GLM搜索/站' as source_name, p as published, case when p = '' then 0.0 else epoch(strptime(p, '%Y-%m-%d')) - 28800 end as published_ts from e"


def credential_ends(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = _s("event_id")
    value = F.element_at(F.array(F.concat(F.lit('{"a":{"expires_at":'), n, F.lit("}}")), F.concat(F.lit('{"expire":"17000000'), F.lpad(F.substring(n, 1, 5), 5, "0"), F.lit('"}')), F.lit('[{"token_expire_time":"2024-03-01T08:00:00+08:00"}]'), F.lit('{"x":{"expiry":"2024/03/01 08:00:00"},"expired_at":"2024-03-01 00:00:00Z"}'), F.lit('{"x":1}'), F.lit("broken")), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", dates.expiry_ts(dates.expiry_value(value)).alias("expiry_ts"))


CREDENTIAL_SQL = "select event_id, cast(case event_id % 6 when 0 then event_id when 1 then cast('17000000' || lpad(substr('' || event_id, 1, 5), 5, '0') as double) / 1000 when 2 then 1709251200 when 3 then 1709251200 end as double) as expiry_ts from events"


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose links take no hop, one to four, or go in circles; the landed hops; and what the accounts' histories say."""
    e = table(spark, d, "events").select(F.col("event_id").alias("n"))
    n, kind = F.col("n"), F.col("n") % 7
    own = lambda c: F.concat(F.lit("https://mp.weixin.qq.com/s?__biz=B"), _s(c), F.lit("&mid="), _s(c), F.lit("&idx=1&scene=27"))
    loose = F.concat(F.lit("https://mp.weixin.qq.com/s?sn="), _s("n"), F.lit("&scene=27"))
    link = F.concat(F.lit("https://weixin.sogou.com/link?k="), _s("n"), F.when(kind == 0, F.concat(F.lit("&url="), F.url_encode(own(n)))).otherwise(""))
    rows = e.select(n.alias("_ord"), F.when(kind == 6, F.concat(F.lit("https://own.example.com/"), _s("n"))).otherwise(link).alias("url"), F.concat(F.lit("Title "), _s("n")).alias("title"), F.lit("src").alias("source_name"))
    page = lambda j: F.concat(F.lit(f"https://r{j}.example.com/"), _s("n"))
    meta = lambda to: F.concat(F.lit('<meta property="og:url" content="'), to, F.lit('">'))
    hop = lambda when, url, location, html: e.where(when).select(url.alias("url"), location.alias("location"), html.alias("html"))
    none, first = F.lit(""), F.concat(F.lit("https://weixin.sogou.com/link?k="), _s("n"))
    hops = (
        hop(kind == 1, first, none, F.when(n % 30 == 1, "请输入验证码").otherwise(meta(own(n))))
        .union(hop(kind == 2, first, page(1), none)).union(hop(kind == 2, page(1), none, F.concat(F.lit('msg_link = "'), own(n), F.lit('"'))))
        .union(hop(kind == 3, first, page(1), none)).union(hop(kind == 3, page(1), F.concat(F.lit("//r2.example.com/"), _s("n")), none)).union(hop(kind == 3, page(2), none, F.concat(F.lit("<a href='"), loose, F.lit("'>"))))
        .union(hop(kind == 4, first, page(1), none)).union(hop(kind == 4, page(1), page(2), none)).union(hop(kind == 4, page(2), page(3), none)).union(hop(kind == 4, page(3), own(n), none))
        .union(hop(kind == 5, first, page(1), none)).union(hop(kind == 5, page(1), first, none))
    )
    history = e.where((kind == 5) & (n % 3 != 0)).select(n.alias("_ord"), F.when(n % 3 == 1, own(n)).otherwise(F.concat(F.lit("https://h.example.com/"), _s("n"))).alias("url"))
    return rows, hops, history


def address_hops(spark: SparkSession, d: str) -> DataFrame:
    return discovery.resolved_hops(*_links(spark, d)).select("_ord", "resolved_url", "resolved_by", "hops", "looped")


_HOPS_SQL = """r as (select event_id as n, event_id % 7 as k, event_id % 30 = 1 as b from events),
h as (select n as _ord, case when k = 6 then 'https://own.example.com/' || n when k = 3 then 'https://mp.weixin.qq.com/s?sn=' || n when k in (0, 2, 4) or (k = 1 and not b) or (k = 5 and n % 3 = 1) then 'https://mp.weixin.qq.com/s?__biz=B' || n || '&mid=' || n || '&idx=1'
  when k = 5 and n % 3 = 2 then 'https://h.example.com/' || n else 'https://weixin.sogou.com/weixin?type=2&query=src+Title+' || n || '&ie=utf8' end as resolved_url,
  case when k = 6 then 'direct' when k = 3 then 'loose' when k in (0, 2, 4) or (k = 1 and not b) or (k = 5 and n % 3 = 1) then 'strict' when k = 5 and n % 3 = 2 then 'history' else 'failed' end as resolved_by,
  case k when 2 then 1 when 3 then 2 when 4 then 4 when 5 then 1 else 0 end as hops, k = 5 as looped from r)"""
HOPS_SQL = f"with {_HOPS_SQL} select * from h"


def address_counts(spark: SparkSession, d: str) -> DataFrame:
    return discovery.resolution_counts(discovery.resolved_hops(*_links(spark, d)))


COUNTS_SQL = f"with {_HOPS_SQL} select resolved_by, count(*) as n, sum(hops) as hops, count(*) filter (looped) as loops from h group by 1"


def history_matches(spark: SparkSession, d: str) -> DataFrame:
    """Titles matched with an account's history: a common beginning of one alphabet, ends of two others, so that the ratio is plain; times far and near.

    Beginnings are a Latin letter and syllables of 4,096: of an alphabet of 16, one in some thousands was by chance nearer to another document's than to its own.
    """
    k, sha = F.col("doc_id"), F.sha2(_s("doc_id").cast("binary"), 256)
    syllables = F.decode(F.unhex(F.regexp_replace(F.substr(sha, F.lit(2), F.lit(45)), "(...)", "b$1")), "UTF-16BE")
    begin = F.substr(F.concat(F.translate(F.substr(sha, F.lit(1), F.lit(1)), "0123456789", "ghijklmnop"), syllables), F.lit(1), (k % 9 + 8).cast("int"))
    end = lambda letters, size: F.substr(F.repeat(F.lit(letters), 6), F.lit(1), size.cast("int"))
    docs = table(spark, d, "documents").select("doc_id")
    account, when = F.concat(F.lit("acc"), _s(k % 12)), F.lit(NOW) - k * 10.0
    targets = docs.select(account.alias("account"), k.alias("_ord"), F.concat(begin, F.lit("，"), end("一二三四", k % 13)).alias("title"), F.when(k % 11 == 0, 0.0).otherwise(when).alias("published_ts"))
    posted = docs.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    history = posted.select(
        account.alias("account"), (k * 2 + F.col("j")).alias("position"), F.concat(F.upper(begin), F.lit(" "), end("七八九十", k % 7 + F.col("j") * (k % 5))).alias("title"),
        F.when(F.col("j") == 0, when - (k % 6) * 43_200.0 - 60).otherwise(when - 400_000.0).alias("published_ts"), F.concat(F.lit("https://h.example.com/"), _s("doc_id"), F.lit("-"), _s("j")).alias("url"),
    )
    return research.history_titles(targets, history)


HISTORY_MATCH_SQL = """
with d as (select doc_id as k, doc_id % 9 + 8 as b, doc_id % 13 as e, doc_id % 7 as f, doc_id % 5 as g from documents),
c as (select k, j, cast(2 * b as double) / (2 * b + e + f + j * g) as r, case when k % 11 = 0 then 0.0 when j = 1 then 0.0 when k % 6 * 43200 + 60 <= 86400 then 0.2 when k % 6 * 43200 + 60 <= 259200 then 0.1 else 0.0 end as bonus from d, (select unnest([0, 1]) as j)),
s as (select *, r + bonus as score from c)
select k as _ord, 'https://h.example.com/' || k || '-' || j as url from s where score >= 0.62 qualify row_number() over (partition by k order by score desc, j) = 1"""


def candidate_plan(spark: SparkSession, d: str) -> DataFrame:
    """Official lists, searches and stored days as one run's candidates, read where they are plausible."""
    n = lambda c: F.col(c).cast("string")
    part = table(spark, d, "part").where("p_partkey % 2 = 0")
    official = part.select(F.floor(F.col("p_partkey") / 50).alias("page_id"), F.col("p_partkey").alias("position"), F.concat(F.lit("采购 WMS 系统 "), n("p_partkey")).alias("title"), F.concat(F.lit("https://www.ccgp.gov.cn/o/"), n("p_partkey")).alias("url"), F.lit("官方").alias("source_name"))
    c = table(spark, d, "customer").withColumn("query_no", F.floor(F.col("c_custkey") / 20))
    item = F.struct(
        F.concat(F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" AGV 招标公告 "), n("c_custkey")))).alias("title"), F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://t.example.com/"), n("c_custkey"))).alias("share_url"),
        F.concat(F.lit(" https://s.example.com/"), n("c_custkey"), F.lit(" ")).alias("source_url"), F.lit(" 摘要 ").alias("abstract"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(" 报 ").alias("media_name"), F.lit("2024-02-05 10:00:00").alias("datetime"), F.lit("1707000000").alias("publish_time"),
    )
    news = c.groupBy("query_no").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("i")))), lambda x: x["i"]).alias("data"))).alias("payload"))
    host = F.when(F.col("c_custkey") % 3 == 0, "www.ggzy.gov.cn").when(F.col("c_custkey") % 3 == 1, "cebpubservice.com").otherwise("xggzy.gov.cn.example.com")
    block = F.concat(F.lit('<li class="b_algo"><h2><a href="https://'), host, F.lit("/e/"), n("c_custkey"), F.lit('?a=1&amp;b=2">堆垛机 <b>采购公告</b> '), n("c_custkey"), F.lit("</a></h2><p>大 &amp; 小</p></li>"))
    engine = c.groupBy("query_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", block.alias("b")))), lambda x: x["b"]), "\n").alias("html"))
    o = table(spark, d, "orders").where("o_orderkey % 10 = 0")
    days = o.select(F.date_add(F.lit("2024-02-01").cast("date"), (F.col("o_orderkey") / 10 % 5).cast("int")).alias("day"), F.concat(F.lit("立体库 改造 "), n("o_orderkey")).alias("title"), F.when(F.col("o_orderkey") % 70 == 0, "").otherwise(F.concat(F.lit("https://d.example.com/"), n("o_orderkey"))).alias("url"), F.lit("旧").alias("summary"), F.lit("旧报").alias("source_name"), F.lit("2024-02-01").alias("published"), F.lit(1706700000.0).alias("published_ts"))
    pages_of = lambda df, base, key: df.select(F.concat(F.lit(base), n(key)).alias("url"), F.concat(F.lit("正文 "), n(key), F.when(F.col(key) % 4 == 0, " 发布时间：2024-02-09").otherwise("")).alias("text"), F.when(F.col(key) % 6 == 0, F.array(F.lit("https://a/1.pdf"))).otherwise(F.array().cast("array<string>")).alias("attachment_urls"), F.array().cast("array<string>").alias("risk_flags"))
    read = pages_of(part, "https://www.ccgp.gov.cn/o/", "p_partkey").unionByName(pages_of(o, "https://d.example.com/", "o_orderkey"))
    out = candidates.gathered(official, news, engine, days, read, most=10_000_000)
    return out.select("title", "url", "summary", "source_name", "published", "published_ts", "content", "verified_url", "snippet_origin", (F.col("content_hash") != "").alias("hashed"), "discovery_method")


CANDIDATE_SQL = """
with read as (select 'https://www.ccgp.gov.cn/o/' || p_partkey as u, p_partkey as k from part where p_partkey % 2 = 0 union all select 'https://d.example.com/' || o_orderkey, o_orderkey from orders where o_orderkey % 10 = 0),
c as (select c_custkey as k, row_number() over (partition by c_custkey // 20 order by c_custkey) as n from customer),
e as (select k, row_number() over (partition by k // 20 order by k) as n from c where k % 3 <> 2),
dd as (select o_orderkey as k, cast(o_orderkey / 10 as int) % 5 as day from orders where o_orderkey % 10 = 0),
r as (
  select '采购 WMS 系统 ' || p_partkey as title, 'https://www.ccgp.gov.cn/o/' || p_partkey as url, '' as summary, '官方' as source_name, '' as published, 0.0 as ts, '' as origin, 'existing' as method from part where p_partkey % 2 = 0
  union all select 'AGV 招标公告 ' || k, case when k % 4 = 0 then 'https://s.example.com/' else 'https://t.example.com/' end || k, '摘要', case when k % 3 = 0 then '搜索发现' else '搜索发现/报' end, '2024-02-05 10:00', 1707000000.0, '', 'existing' from c where n <= 15 and k % 5 <> 0
  union all select '堆垛机 采购公告 ' || k, 'https://' || case k % 3 when 0 then 'www.ggzy.gov.cn' else 'cebpubservice.com' end || '/e/' || k || '?a=1&b=2', '大 & 小', '搜索发现/官方公告', '', 0.0, 'existing_search', 'existing' from e where n <= 10
  union all select '立体库 改造 ' || k, 'https://d.example.com/' || k, '旧', '旧报', '2024-02-01', 1706700000.0, '', 'existing' from dd where day >= 2 and k % 70 <> 0)
select title, url, case when summary = '' and read.k is not null then '正文 ' || read.k || case when read.k % 4 = 0 then ' 发布时间：2024-02-09' else '' end else summary end as summary, source_name, case when read.k % 4 = 0 then '2024-02-09' else published end as published, cast(case when read.k % 4 = 0 then 1707408000.0 else ts end as double) as published_ts,
  case when read.k is null then '' else '正文 ' || read.k || case when read.k % 4 = 0 then ' 发布时间：2024-02-09' else '' end end as content, case when read.k is null then '' else url end as verified_url, origin as snippet_origin, coalesce(read.k % 6 <> 0, false) as hashed, method as discovery_method
from r left join read on read.u = r.url"""


def native_search(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a searching model: what it lists, and its tool's sources at no listed address."""
    e = table(spark, d, "events")
    n, at = _s("event_id"), lambda host, tail="": F.concat(F.lit(f"https://{host}.example.com/"), _s("event_id"), F.lit(tail))
    listed = F.array(F.struct(F.concat(F.lit("项目 "), n).alias("title"), at("a", "?utm_source=x").alias("url"), F.lit("要点").alias("summary")), F.struct(F.lit("二").alias("title"), at("b").alias("url"), F.lit(None).cast("string").alias("summary")))
    source = lambda url, title: F.struct(url.alias("url"), F.lit(title).alias("title"), F.lit("片段").alias("snippet"), F.lit("openai_web_search").alias("origin"))
    sources = F.when(F.col("event_id") % 3 == 0, F.array(source(at("a"), "同"), source(at("c"), ""), source(at("b", "?x"), "三"))).otherwise(F.array(source(at("c"), "四")))
    rows = candidates.native_candidates(e.select(F.col("event_id").alias("answer"), F.when(F.col("event_id") % 7 == 0, F.slice(listed, 1, 0)).otherwise(listed).alias("candidates"), sources.alias("sources")))
    return rows.select("answer", "position", "title", "url", "summary", F.size("search_sources").alias("n_sources"), "discovery_method")


NATIVE_SQL = """
with e as (select event_id as n, event_id % 7 = 0 as bare, event_id % 3 = 0 as many from events),
l as (select n, 0 as o, '项目 ' || n as title, 'https://a.example.com/' || n || '?utm_source=x' as url, '要点' as summary, case when many then 3 else 1 end as ns from e where not bare union all select n, 1, '二', 'https://b.example.com/' || n, '', case when many then 3 else 1 end from e where not bare
 union all select n, 2, '同', 'https://a.example.com/' || n, '', 1 from e where many and bare union all select n, 3, 'https://c.example.com/' || n, 'https://c.example.com/' || n, '', 1 from e where many union all select n, 4, '三', 'https://b.example.com/' || n || '?x', '', 1 from e where many
 union all select n, 5, '四', 'https://c.example.com/' || n, '', 1 from e where not many)
select n as answer, cast(row_number() over (partition by n order by o) - 1 as int) as position, title, url, summary, ns as n_sources, 'ai_search' as discovery_method from l"""


def source_lookups(spark: SparkSession, d: str) -> DataFrame:
    """The first five results of each candidate's quoted-title query, one an address."""
    c = table(spark, d, "customer").select(F.concat(F.lit("https://p.example.com/"), _s("c_custkey")).alias("page"), F.concat(F.lit("立体库 "), _s("c_custkey")).alias("title"), F.col("c_custkey").alias("k"))
    found = c.withColumn("position", F.explode(F.sequence(F.lit(0), (F.col("k") % 9).cast("int"))))
    results = found.select(F.concat(F.lit('"'), "title", F.lit('" 官方 招标 采购 公告 企业采购平台 企业官网 最新公告')).alias("query"), "position", F.concat(F.lit("https://r.example.com/"), _s("k"), F.lit("/"), _s(F.floor(F.col("position") / 2)), F.when(F.col("position") % 2 == 1, "/").otherwise("")).alias("url"), F.concat(F.lit("r"), _s("position")).alias("title"))
    return candidates.source_lookups(c, results).select("page", "position", "url", "title")


LOOKUP_SQL = "with c as (select c_custkey as k, unnest(range(c_custkey % 9 + 1)) as p from customer) select 'https://p.example.com/' || k as page, cast(p as int) as position, 'https://r.example.com/' || k || '/' || (p // 2) as url, 'r' || p as title from c where p % 2 = 0 and p < 10"


def cover_images(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = _s("event_id")
    html = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('<meta property="og:image" content="https://i/'), n, F.lit('"/>var msg_cdn_url = "x"'))).when(F.col("event_id") % 3 == 1, F.concat(F.repeat(F.lit(" "), 60_000), F.lit('<meta property="og:image" content="late"/>'))).otherwise(F.concat(F.lit('var msg_cdn_url = "https://c/'), n, F.lit('";')))
    return e.select("event_id", pages.cover(html).alias("image_url"))


COVER_SQL = "select event_id, case event_id % 3 when 0 then 'https://i/' || event_id when 1 then '' else 'https://c/' || event_id end as image_url from events"

def _registry_searches(spark: SparkSession) -> str:
    return queries_reader.search_list(specs.query_table(spark, specs.registry("无锡", True)))


def _land_rounds(spark: SparkSession, d: str, path: str, n: int, *rounds: int) -> None:
    """Rounds of a zone in which documents answer ``n`` searches."""
    k = F.col("doc_id")
    entry = F.struct(
        F.when(k % 13 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Title&nbsp;"), _s(k))).alias("title"), F.concat(F.lit("https://l.example.com/"), _s(k)).alias("share_url"), F.concat(F.lit("<b>"), F.coalesce("lang", F.lit("")), F.lit("</b> text")).alias("abstract"),
        F.coalesce("source", F.lit("")).alias("media_name"), F.when(k % 2 == 0, _s(F.lit(1700000000) + k)).otherwise("soon").alias("publish_time"),
    )
    docs = table(spark, d, "documents").select((k % n).cast("int").alias("search"), (F.floor(k / n) % 3).cast("int").alias("batch"), F.struct(k.alias("k"), entry.alias("e")).alias("e"))
    answers = docs.groupBy("search", "batch").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["e"]).alias("data"))).alias("payload"))
    for batch in rounds:
        queries_reader.land(answers.where(F.col("batch") == batch), path, batch)


def _contract(df: DataFrame) -> DataFrame:
    return queries_reader.articles(df).select("skill_name", "region_scope", "keyword", "batch", "position", "title", "url", "summary", "source_name", "published_ts")


def source_contract(spark: SparkSession, d: str) -> DataFrame:
    """Every source's searches read through the data source, ten entries an answer at most."""
    queries_reader.register(spark)
    path, searches = scratch(spark), _registry_searches(spark)
    _land_rounds(spark, d, path, len(json.loads(searches)), 0, 1, 2)
    return _contract(spark.read.format("landed_queries").option("searches", searches).load(path))


def source_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream over rounds that land one after the other, into a table that each micro-batch adds to."""
    queries_reader.register(spark)
    path, out, searches = scratch(spark), scratch(spark), _registry_searches(spark)

    def drained() -> None:
        rows = _contract(spark.readStream.format("landed_queries").option("searches", searches).load(path))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()

    for rounds in ((0,), (1, 2)):
        _land_rounds(spark, d, path, len(json.loads(searches)), *rounds)
        drained()  # goes on where the last run of the stream ended
    return spark.read.parquet(f"{out}/rows")


_SEARCHES = [(s.name, s.scope, k, label or k) for s in specs.registry("无锡", True) for k, label in s.searches() if k]
CONTRACT_SQL = f"""with q as (select unnest({[x[0] for x in _SEARCHES]}) as skill_name, unnest({[x[1] for x in _SEARCHES]}) as region_scope, unnest({[x[2] for x in _SEARCHES]}) as keyword, unnest(range({len(_SEARCHES)})) as n),
d as (select *, cast(doc_id // {len(_SEARCHES)} % 3 as int) as batch, cast(row_number() over (partition by doc_id % {len(_SEARCHES)}, doc_id // {len(_SEARCHES)} % 3 order by doc_id) - 1 as int) as position from documents)
select skill_name, region_scope, keyword, batch, position, 'Title' || chr(160) || doc_id as title, 'https://l.example.com/' || doc_id as url, trim(coalesce(lang, '') || ' text') as summary, coalesce(source, '') as source_name, case when doc_id % 2 = 0 then 1700000000.0 + doc_id else 0.0 end as published_ts
from d join q on q.n = doc_id % {len(_SEARCHES)} where position < 10 and doc_id % 13 <> 0"""

PAIRS = {
    "address_hops": (address_hops, HOPS_SQL),
    "address_counts": (address_counts, COUNTS_SQL),
    "history_matches": (history_matches, HISTORY_MATCH_SQL),
    "candidate_plan": (candidate_plan, CANDIDATE_SQL),
    "native_search": (native_search, NATIVE_SQL),
    "source_lookups": (source_lookups, LOOKUP_SQL),
    "source_contract": (source_contract, CONTRACT_SQL),
    "source_stream": (source_stream, CONTRACT_SQL),
    "news_dates": (news_dates, NEWS_DATES_SQL),
    "page_metadata": (page_metadata, METADATA_SQL),
    "page_documents": (page_documents, DOCUMENTS_SQL),
    "html_links": (html_links, LINKS_SQL),
    "feed_articles": (feed_articles, FEED_SQL),
    "feed_reports": (feed_reports, REPORTS_SQL),
    "bidding_first_wins": (bidding_first_wins, BIDDING_SQL),
    "organizer_news": (organizer_news, ORGANIZER_SQL),
    "account_articles": (account_articles, ACCOUNT_SQL),
    "official_candidates": (official_candidates, OFFICIAL_SQL),
    "engine_results": (engine_results, ENGINE_SQL),
    "discovery_cascade": (discovery_cascade, CASCADE_SQL),
    "account_search": (account_search, ACCOUNT_SEARCH_SQL),
    "account_history": (account_history, HISTORY_PAGE_SQL),
    "web_addresses": (web_addresses, WEB_SQL),
    "video_results": (video_results, VIDEO_SQL),
    "web_search": (web_search, WEB_SEARCH_SQL),
    "credential_ends": (credential_ends, CREDENTIAL_SQL),
    "cover_images": (cover_images, COVER_SQL),
}

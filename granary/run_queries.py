"""Queries of runs: verification, benchmarks, budgets, delivery, health, contracts and whole days, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicon as L
from .adapters import ARTICLES_SQL, NOW, SIGNALS_SQL, YEAR, articles, signals, table
from .functions import text as T
from .functions import urls
from .operators import budgets, classify, contracts, delivery, diagnostics, evaluate, filters, score, select, verify
from .plans import news, opportunities
from .queries import LIMITS, LOCAL_REGIONS, RULES
from .sources import sinks
from .streaming import machines, states
from .tables import numbered, scratch


def _s(x: str | Column) -> Column:
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


def _pick(n: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def notice_versions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    title = F.concat(_pick(F.col("event_id"), "二次 招标", "招标", "澄清 公告"), _s("event_id"))
    return e.select("event_id", T.notice_version(title, F.lit("2024"), urls.fetch_url(F.concat(F.lit("https://n.example.com/"), _s("event_id")))).alias("version"))


NOTICE_SQL = "select event_id, case when event_id % 3 = 1 then '' else substr(sha256(lower(replace(case event_id % 3 when 0 then '二次 招标' else '澄清 公告' end || event_id || '|2024|https://n.example.com/' || event_id, ' ', ''))), 1, 24) end as version from events"


def _opportunities(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("_ord"), F.concat(F.lit("p"), _s(k)).alias("project_key"), _pick(k, "verified", "preview", "").alias("verification_status"), _pick(k, "ai", "rules", "preview", "fallback").alias("research_mode"),
        F.when(k % 5 == 0, F.array(F.lit("original_page_unavailable"))).otherwise(F.array(F.lit("x"))).alias("risk_flags"), F.when(F.col("o_orderstatus") == "F", "AWARD").when(F.col("o_orderstatus") == "O", "PROCUREMENT").otherwise("EARLY_SIGNAL").alias("stage"),
        _pick(k, "A", "B", "WATCH", "DROP", "A").alias("priority"), F.when(k % 2 == 0, "").otherwise("2024-02-01").alias("last_reported_at"), F.concat(F.lit("h"), _s(k % 3)).alias("last_digest_hash"), F.lit("h1").alias("digest_hash"), _pick(k, "", "2024-02-10", "2024-03-20").alias("deadline"),
        F.concat(F.lit("标题 "), _s(k)).alias("title"), F.col("o_totalprice").alias("final_score"),
    )


_OPEN = """o as (select o_orderkey as k, o_orderkey % 3 = 1 or o_orderkey % 4 = 2 or o_orderkey % 5 = 0 as unverified, o_orderstatus <> 'F' and o_orderkey % 5 <> 3 and (o_orderkey % 2 = 0 or o_orderkey % 3 <> 1) as report, o_orderkey % 3 = 1 as expired from orders)"""


def unverified_rows(spark: SparkSession, d: str) -> DataFrame:
    return _opportunities(spark, d).select("_ord", filters.unverified().alias("unverified"), filters.needs_report().alias("needs_report"))


UNVERIFIED_SQL = f"with {_OPEN} select k as _ord, unverified, report as needs_report from o"


def publishable(spark: SparkSession, d: str) -> DataFrame:
    rows = _opportunities(spark, d)
    receipts = rows.where("_ord % 4 = 0").select("project_key", "digest_hash")
    return filters.publishable(rows, receipts, NOW, 5000).select("_ord", "project_key")


PUBLISHABLE_SQL = f"with {_OPEN} select k as _ord, 'p' || k as project_key from o where not unverified and report and not expired and k % 4 <> 0 order by k limit 5000"


def digest_message(spark: SparkSession, d: str) -> DataFrame:
    rows = _opportunities(spark, d).withColumns({"province": F.lit(""), "city": F.lit("无锡"), "budget": F.lit(""), "technical_scope": F.array(F.lit("AGV")), "entry_point": F.lit("")})
    return sinks.digest(rows.where("research_mode = 'ai' and priority = 'A'"), "2024-03-01", "https://s.example.com/")


DIGEST_SQL = """
with o as (select o_orderkey as k, o_orderstatus as st from orders where o_orderkey % 4 = 0 and o_orderkey % 5 in (0, 4) order by o_orderkey limit 5), n as (select *, row_number() over (order by k) as n from o),
b as (select n, chr(10) || '🔴 **' || n || '. 标题 ' || k || '**' || chr(10) || '无锡 · 预算待核实 · ' || case st when 'F' then '已中标' when 'O' then '采购/招标' else '采购前期' end || chr(10) || '涉及：AGV' || chr(10) as t from n)
select '📌 智能仓储商机日报｜2024-03-01' || chr(10) || chr(10) || '今日筛选 ' || count(*) || ' 条' || chr(10) || 'A级 ' || count(*) || ' 条 · B级 0 条 · 观察 0 条' || chr(10) || string_agg(t, '' order by n) || chr(10) || '👉 [查看完整日报与原始来源](https://s.example.com/?scope=opportunity)' as message from b"""


def priority_counts(spark: SparkSession, d: str) -> DataFrame:
    return delivery.priority_counts(_opportunities(spark, d))


def verified_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects with a page each, some with an attachment, and evidence that holds or not."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    n = _s(k)
    key, title = F.concat(F.lit("p"), n), F.concat(F.lit("立体库改造"), n, F.lit("号"))
    research = o.select(
        key.alias("project_key"), F.when(k % 11 == 0, "别的事").otherwise(title).alias("candidate_title"), F.lit("https://c.example.com/").alias("candidate_url"), F.lit("来源").alias("source_name"), (k % 13 != 0).alias("is_real_project"), title.alias("title"),
        F.lit("甲公司").alias("owner"), F.lit("江苏").alias("province"), F.lit("").alias("city"), F.lit("2024-02-01").alias("published"), F.lit("300万元").alias("budget"), F.lit("2024年3月5日").alias("deadline"), F.lit("PROCUREMENT").alias("stage"), F.array(F.lit("AGV"), F.lit("无此")).alias("technical_scope"),
    )
    url = F.concat(F.when(k % 2 == 0, "https://www.x.gov.cn/").otherwise("https://x.example.com/"), n)
    body = F.concat(title, F.lit(" 招标公告 采购人：甲公司 预算 300 万元 AGV 投标截止 2024-03-05 发布 2024-02-01"))
    page = o.select(key.alias("project_key"), url.alias("url"), body.alias("text"), F.when(k % 17 == 0, "search_excerpt").otherwise("html").alias("retrieval_method"), F.lit("").alias("parent_url"), F.array().cast("array<string>").alias("risk_flags"), F.lit(None).cast("array<struct<page:int,text:string>>").alias("pages"))
    pdf = o.where(k % 3 == 0).select(key.alias("project_key"), F.concat(url, F.lit(".pdf")).alias("url"), F.lit("江苏 省内\n预算 300万元").alias("text"), F.lit("pdf").alias("retrieval_method"), url.alias("parent_url"), F.array(F.lit("pdf_truncated")).alias("risk_flags"), F.array(F.struct(F.lit(1).alias("page"), F.lit("江苏 省内").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("预算 300万元").alias("text"))).alias("pages"))
    claim = lambda f, v, q, u: F.struct(F.lit(f).alias("field"), v.alias("value") if isinstance(v, Column) else F.lit(v).alias("value"), q.alias("quote") if isinstance(q, Column) else F.lit(q).alias("quote"), u.alias("source_url"))
    claims = F.array(
        claim("title", title, F.concat(title, F.lit(" 招标公告")), url), claim("owner", "甲公司", F.when(k % 5 == 0, "采购人：乙公司").otherwise("采购人：甲公司"), url), claim("province", "江苏", "江苏省内", F.concat(url, F.lit(".pdf"))), claim("published", "2024-02-01", "发布 2024-02-01", url),
        claim("budget", "300万元", "预算 300万元", url), claim("deadline", "2024年3月5日", F.when(k % 7 == 0, "2024-03-05 发布").otherwise("投标截止 2024-03-05"), url), claim("stage", "PROCUREMENT", "招标公告", url),
    )
    evidence = o.select(key.alias("project_key"), F.inline(claims))
    out = verify.verified_projects(research, evidence, page.unionByName(pdf))
    return out.select("project_key", *verify.FACTS, "source_url", F.size("source_urls").alias("n_sources"), "source_tier", "research_mode", F.array_join("technical_scope", ",").alias("scope"), F.array_join("risk_flags", ",").alias("flags"))


VERIFIED_SQL = """
with o as (select o_orderkey as k, 'p' || o_orderkey as project_key, '立体库改造' || o_orderkey || '号' as title, case when o_orderkey % 2 = 0 then 'https://www.x.gov.cn/' else 'https://x.example.com/' end || o_orderkey as url, o_orderkey % 17 = 0 as pre, o_orderkey % 3 = 0 as pdf from orders where o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0)
select project_key, title, case when k % 5 = 0 then '' else '甲公司' end as owner, case when pdf then '江苏' else '' end as province, '' as city, '2024-02-01' as published, '300万元' as budget, case when k % 7 = 0 then '' else '2024年3月5日' end as deadline, 'PROCUREMENT' as stage,
  url as source_url, case when pdf then 2 else 1 end as n_sources, case when pre then 3 when k % 2 = 0 then 1 else 3 end as source_tier, case when pre then 'preview' else 'ai' end as research_mode, 'AGV' as scope,
  concat_ws(',', case when pdf then 'pdf_truncated' end, case when pre then 'search_excerpt_only' end, case when pre then 'original_page_unavailable' end, case when pre or k % 2 = 1 then 'official_source_not_found' end, case when k % 5 = 0 then 'unsupported_owner' end, case when k % 7 = 0 then 'unsupported_deadline' end) as flags from o"""


def attachment_documents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    n = _s("o_orderkey")
    parents = o.select(F.concat(F.lit("https://a.example.com/"), n).alias("url"), F.array(*[F.concat(F.lit("https://a.example.com/"), n, F.lit(f"-{i}.pdf")) for i in range(3)]).alias("attachment_urls"), F.array(F.lit("old")).alias("risk_flags"))
    fetched = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("https://a.example.com/"), n, F.lit("-0.pdf")).alias("url"), F.when(F.col("o_orderkey") % 4 == 0, "text").alias("text"), F.when(F.col("o_orderkey") % 4 != 0, "pdf_parse_failed").otherwise("").alias("failure"))
    read, told = verify.attachments(parents, fetched)
    return read.select("url", "parent_url", F.lit("").alias("flags")).union(told.select("url", F.lit("").alias("parent_url"), F.array_join("risk_flags", ",")))


ATTACHMENT_SQL = "select 'https://a.example.com/' || o_orderkey || '-0.pdf' as url, 'https://a.example.com/' || o_orderkey as parent_url, '' as flags from orders where o_orderkey % 4 = 0 union all select 'https://a.example.com/' || o_orderkey, '', 'old,' || case o_orderkey % 4 when 0 then '' when 2 then 'pdf_parse_failed,' else 'attachment_unavailable,' end || 'attachment_unavailable' from orders"


def _benchmark(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    page = lambda c: F.array(F.concat(F.lit("https://b.example.com/"), _s(c)))
    cases = table(spark, d, "customer").select(
        F.col("c_custkey").alias("_ord"), F.concat(F.lit("项目 case "), _s("c_custkey")).alias("title"), page(F.col("c_custkey") * 5).alias("pages"), F.concat(F.lit("k"), _s(F.col("c_custkey") * 7)).alias("project_key"), F.when(F.col("c_custkey") % 2 == 0, "X").otherwise("").alias("expected_owner"),
        (F.col("c_custkey") % 3 != 0).alias("expected_relevant"), F.lit("PROCUREMENT").alias("expected_stage"), F.lit("100万元").alias("expected_budget"), F.lit("2024-03-05").alias("expected_deadline"), (F.col("c_custkey") <= 4).alias("expected_top5"),
    )
    items = table(spark, d, "orders").select(
        k.alias("_ord"), F.concat(F.lit("item "), _s(k)).alias("title"), page(k).alias("pages"), F.concat(F.lit("k"), _s(k % 3000)).alias("project_key"), F.lit("x").alias("owner"), F.when(F.col("o_orderstatus") == "O", "PROCUREMENT").otherwise("AWARD").alias("stage"),
        _pick(k, "1000000元", "200万元", "").alias("budget"), _pick(k, "2024年3月5日", "").alias("deadline"), F.when(k % 4 == 0, "u").otherwise("").alias("official_source_url"),
    )
    return cases, items


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.benchmark(*_benchmark(spark, d))


_PAIRED = """
i as (select o_orderkey as k, o_orderkey % 3000 as pk, case when o_orderstatus = 'O' then 'PROCUREMENT' else 'AWARD' end as stage, ['1000000元', '200万元', ''][o_orderkey % 3 + 1] as bu, o_orderkey % 2 = 0 as dl, o_orderkey % 4 = 0 as off from orders),
m as (select c, min(k) as k from (select c_custkey as c, k from customer join i on k = c_custkey * 5 union all select c_custkey, k from customer join i on pk = c_custkey * 7) group by c),
j as (select c_custkey as c, c_custkey % 3 <> 0 as pos, c_custkey % 2 = 0 as ow, i.* from customer left join m on m.c = c_custkey left join i on i.k = m.k)"""
BENCHMARK_SQL = f"""with {_PAIRED},
h as (select k, pk from i order by k limit 5), s as (select distinct c_custkey as c from customer join h on k = c_custkey * 5 or pk = c_custkey * 7),
t as (select count(*) as labeled_cases, count(k) as matched_predictions, count(*) filter (k is not null and pos) as hit, count(*) filter (pos) as n_positive, count(*) filter (pos and k is not null) as stage_denominator, count(*) filter (pos and stage = 'PROCUREMENT') as st,
 count(*) filter (c <= 4) as n_top, count(*) filter (c <= 4 and c in (select c from s)) as shown, count(*) filter (pos) as budget_expected, count(*) filter (pos and bu <> '') as budget_available, count(*) filter (pos and bu = '1000000元') as budget_correct,
 count(*) filter (pos and ow) as owner_expected, count(*) filter (pos and ow and k is not null) as owner_available, count(*) filter (pos and ow and k is not null) as owner_correct, count(*) filter (pos) as deadline_expected, count(*) filter (pos and dl) as deadline_available, count(*) filter (pos and dl) as deadline_correct from j),
q as (select count(*) as verified_count, count(*) - count(distinct pk) as copies, count(*) filter (off) as offs from i)
select labeled_cases, matched_predictions, n_positive, stage_denominator, n_top, budget_expected, budget_available, budget_correct, owner_expected, owner_available, owner_correct, deadline_expected, deadline_available, deadline_correct, verified_count,
 hit / nullif(matched_predictions, 0) as precision, hit / nullif(n_positive, 0) as recall, st / nullif(stage_denominator, 0) as stage_accuracy, offs / verified_count as official_source_rate, copies / verified_count as duplicate_rate, shown / nullif(n_top, 0) as top5_overlap,
 budget_correct / nullif(budget_available, 0) as budget_accuracy, owner_correct / nullif(owner_available, 0) as owner_accuracy, deadline_correct / nullif(deadline_available, 0) as deadline_accuracy,
 budget_available / nullif(budget_expected, 0) as budget_completeness, owner_available / nullif(owner_expected, 0) as owner_completeness, deadline_available / nullif(deadline_expected, 0) as deadline_completeness from t, q"""


def benchmark_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.benchmark_errors(*_benchmark(spark, d))


ERRORS_SQL = f"""with {_PAIRED}, e as (select c, unnest([case when pos and k is null then 'missed_high_value' end, case when k is not null and not pos then 'false_positive' end, case when stage <> 'PROCUREMENT' then 'wrong_stage' end, case when k is not null and not off then 'official_source_missing' end, case when pos and bu = '200万元' then 'wrong_budget' end]) as error from j)
select c as case, error from e where error is not null""".replace(" as case,", ' as "case",')


def benchmark_problems(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    cases = o.select(k.alias("_ord"), F.when(k % 10 == 1, "").otherwise("t").alias("title"), F.when(k % 10 == 2, "ftp://x").otherwise(F.concat(F.lit("https://v.example.com/"), _s("o_custkey"))).alias("url"), F.when(k % 10 == 3, None).otherwise(True).alias("expected_relevant"), F.lit("why").alias("human_reason"), F.when(k % 2 == 0, _s(k)).otherwise("").alias("project_id"))
    landed = table(spark, d, "customer").select(F.concat(F.lit("https://v.example.com/"), _s("c_custkey")).alias("url"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("text").alias("text"), F.when(F.col("c_custkey") % 7 == 0, "excerpt").otherwise("html").alias("retrieval_method"))
    return evaluate.validated(evaluate.frozen(cases, landed), frozen=True).select("_ord", "problem")


PROBLEMS_SQL = """
with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 10 as m, case when o_orderkey % 2 = 0 then '' || o_orderkey when o_orderkey % 10 = 2 then '' else 'u' || o_custkey end as ident from orders), r as (select *, row_number() over (partition by ident order by k) as n from o)
select k as _ord, case when m = 3 then 'label_missing' when m in (1, 2) then 'identity_missing' when n > 1 then 'duplicate_identity' when c % 4 = 0 then 'documents_missing' when c % 7 = 0 then 'document_not_original' else '' end as problem from r"""


def delivery_events(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("_ord"), F.to_date("o_orderdate").alias("day"), _s(F.col("o_custkey") % 300).alias("project_key"), F.col("o_orderpriority").alias("material_hash"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(_s(F.to_date("o_orderdate"))).alias("last_reported_at"))
    return evaluate.deliveries(rows)


EVENTS_SQL = """
with e as (select '' || (o_custkey % 300) as p, o_orderpriority as h, cast(o_orderdate as date) as d, min(o_orderkey) as k from orders where o_orderkey % 3 <> 0 group by all),
r as (select *, row_number() over (partition by p, h order by d, k) as n from e) select d as day, count(*) as n_events, count(*) filter (n > 1) as n_repeated from r group by d"""


def metered_requests(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    rows = e.select((k % 400).alias("run"), k.alias("seq"), F.when(k % 3 == 0, "verification").otherwise("discovery").alias("phase"), (k % 4).cast("int").alias("asked"), (k % 5 != 0).alias("model"), F.when(k % 7 == 0, None).otherwise((k % 3).cast("int")).alias("used"))
    return budgets.metered(rows, budgets.Settings(model_calls=40))


METERED_SQL = """
with recursive e as (select event_id % 400 as run, event_id as seq, event_id % 3 = 0 as ver, event_id % 4 as asked, cast(event_id % 5 <> 0 as int) as model, case when event_id % 7 <> 0 then event_id % 3 end as used, row_number() over (partition by event_id % 400 order by event_id) as n from events),
w as (select run, cast(0 as bigint) as n, cast(null as bigint) as seq, 0::bigint as calls, 0::bigint as total, 0::bigint as dis, 0::bigint as ver, 0::bigint as allowed, '' as outcome from (select distinct run from e)
 union all
 select e.run, e.n, e.seq, w.calls + case when x.ok then e.model else 0 end, w.total + x.charge, w.dis + case when e.ver then 0 else x.charge end, w.ver + case when e.ver then x.charge else 0 end, x.allowed, x.outcome
 from w join e on e.run = w.run and e.n = w.n + 1,
 lateral (select least(e.asked, greatest(0, least(case when e.ver then 24 - w.ver else 12 - w.dis end, 36 - w.total))) as a, e.model = 1 and w.calls >= 40 as full_) g,
 lateral (select not g.full_ and not (e.asked > 0 and g.a = 0) as ok) o,
 lateral (select o.ok as ok, case when o.ok then g.a else 0 end as allowed, case when not o.ok then 0 when e.used is null then g.a else least(g.a, e.used) end as charge, case when g.full_ then 'llm_call_budget_exhausted' when not o.ok then 'search_call_budget_exhausted' when e.asked > 0 and e.used is null then 'unknown' else 'settled' end as outcome) x)
select run, seq, allowed, outcome, total as charged from w where n > 0"""


def search_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = budgets.planned_searches(spark, "2024-03-01", 12, 2)
    answers = table(spark, d, "events").groupBy(_pick(F.col("event_id"), "direct", "intention", "retrofit").alias("channel")).agg(F.sum(F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).alias("returned")).withColumn("error", F.when(F.col("channel") == "retrofit", "http_429"))
    covered = budgets.coverage(plan, answers)
    proposed = spark.createDataFrame([(0, " 新词 "), (1, "新词"), (2, ""), (3, "又一")], "position int, query string")
    more = budgets.supplements(covered, proposed, 2, "2024-03-01")
    return covered.select("position", "channel", "status", F.length("query").alias("n")).union(more.select("position", "channel", F.lit("supplement"), F.length("query")))


def _channel_rows() -> str:
    return ", ".join(f"({i}, '{k}', '{q if q.startswith('中国') else '中国 ' + q}', '{q}', {days})" for i, (k, (_, q, days)) in enumerate(budgets.CHANNELS.items()))


PLAN_SQL = f"""
with c(position, channel, q, q0, days) as (values {_channel_rows()}),
n as (select case event_id % 3 when 0 then 'direct' when 1 then 'intention' else 'retrofit' end as channel, count(*) filter (event_id % 3 = 0) as r from events group by 1),
s as (select c.*, case when position >= 6 then 'budget_exhausted' when r > 0 then 'returned' when n.channel = 'retrofit' then 'failed' when n.channel is not null then 'empty' else 'not_searched' end as status from c left join n using (channel)),
t as (select position, channel, status, q, days from s union all select -1, channel, 'supplement', q0 || ' 最新企业公告 项目需求', days from (select * from s where status not in ('returned', 'budget_exhausted') order by position limit 1) union all select 0, 'dynamic', 'supplement', '新词', 30)
select cast(position as int) as position, channel, status, cast(length(q || ' 发布时间 2024-01-01 至 2024-03-01 优先原始公告，排除历史案例和纯行业资讯') as int) as n from t"""


def research_waves(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = numbered(o.select("o_orderkey"), "rank", "o_orderkey").select(F.col("rank").cast("int").alias("rank"), _pick(F.col("rank"), "A", "WATCH").alias("priority"), (F.col("rank") % 3 != 0).alias("verified"))
    return budgets.waves(rows, budgets.Settings(hard=600, wave=60, target=55)).select("rank", "wave", "researched")


WAVES_SQL = "with r as (select row_number() over (order by o_orderkey) as rank from orders), w as (select rank, cast((rank - 1) // 60 as int) as wave, rank % 2 = 0 and rank % 3 <> 0 as good from r), g as (select wave, sum(cast(good as int)) as g from w where rank <= 600 group by wave), b as (select wave, coalesce(sum(g) over (order by wave rows between unbounded preceding and 1 preceding), 0) as before from g) select rank, w.wave, coalesce(rank <= 600 and before < 55, false) as researched from w left join b on b.wave = w.wave"


def rescue_searches(spark: SparkSession, d: str) -> DataFrame:
    """Searches for more sources in runs of forty candidates, two strategies and a spare each."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 40).alias("run"), F.col("event_id").alias("page"), (F.col("event_id") % 40 + 1).cast("int").alias("rank"))
    k = F.col("page")
    queue = e.select("run", "page", "rank", (k * 7 % 100).cast("double").alias("triage_score"), (k % 3 == 0).alias("related"))
    strategies = e.select("run", "page", F.posexplode(F.array(*map(F.lit, ("owner_equipment", "region_equipment", "project_core")))).alias("position", "strategy")).withColumn("finds", (k + F.col("position")) % 4 == 1)
    return budgets.rescue_searches(queue, strategies, budgets.Settings(verification=28, hard=24), 40.0)


RESCUE_SQL = """
with e as (select event_id // 40 as run, event_id as page, event_id % 40 + 1 as rank from events where event_id % 3 <> 0 and event_id * 7 % 100 >= 40 and event_id % 40 < 24),
s as (select run, page, rank, p as position, ['owner_equipment', 'region_equipment'][p + 1] as strategy from e, (select unnest([0, 1]) as p) where p = 0 or page % 4 <> 1),
t as (select *, row_number() over (partition by run order by rank, position) as turn from s),
o as (select *, sum(case when turn > 4 then 1 else 0 end) over (partition by run, page order by position) as over from t)
select run, page, cast(position as int) as position, strategy, case when turn > 4 then 'verification_budget_reserved_or_exhausted' else 'searched' end as outcome from o where over <= 1"""


def source_order(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    rows = line.select(_s(F.col("l_orderkey") % 900).alias("project_key"), F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber")).alias("url"), (F.col("l_partkey") % 9 == 0).alias("original"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("source_tier"), F.col("l_linenumber").alias("position"))
    return budgets.ordered_sources(rows).select("project_key", "url", "place")


SOURCE_ORDER_SQL = "with l as (select '' || (l_orderkey % 900) as project_key, l_orderkey || '-' || l_linenumber as url, row_number() over (partition by l_orderkey % 900 order by l_partkey % 9 = 0 desc, l_suppkey % 3, l_linenumber, l_orderkey || '-' || l_linenumber) as place from lineitem) select * from l where place <= 8"


def delivery_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    rows = e.select(_s("user_id").alias("key"), k.alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.to_date("ts").cast("string").alias("day"), _pick(k, "d1", "d1", "d2", "").alias("digest"), (k % 2 == 1).alias("retry"), (k % 6 == 0).alias("ok"))
    return delivery.deliveries(rows)


DELIVERY_SQL = """
with recursive e as (select '' || user_id as key, event_id as seq, epoch_us(ts) / 1e6 as ts, cast(cast(ts as date) as varchar) as day, ['d1', 'd1', 'd2', ''][event_id % 4 + 1] as digest, event_id % 2 = 1 as retry, event_id % 6 = 0 as ok, row_number() over (partition by user_id order by ts, event_id) as n from events),
w as (select distinct key, cast(0 as bigint) as n, cast(null as bigint) as seq, '' as day, '' as digest, '' as status, 0 as att, 0.0::double as nxt, '' as outcome from e
 union all
 select e.key, e.n, e.seq, case when s.o in ('success', 'failed') then e.day else w.day end, case when s.o in ('success', 'failed') then e.digest else w.digest end, case when s.o in ('success', 'failed', 'expired', 'superseded') then s.o else w.status end,
   case when s.o in ('success', 'failed') then s.b + 1 else w.att end, case s.o when 'failed' then case when s.b + 1 >= 3 then 0.0 else e.ts + 300 end when 'success' then 0.0 when 'expired' then 0.0 when 'superseded' then 0.0 else w.nxt end, s.o
 from w join e on e.key = w.key and e.n = w.n + 1,
 lateral (select w.day = e.day and w.digest = e.digest as same) q, lateral (select case when q.same then w.att else 0 end as b,
  case when e.retry and (w.status <> 'failed' or w.nxt = 0 or w.nxt > e.ts) then 'idle' when e.retry and w.day <> e.day then 'expired' when e.digest = '' then 'no_new_opportunities' when e.retry and not q.same then 'superseded' when case when q.same then w.att else 0 end >= 3 then 'retry_exhausted' when e.ok then 'success' else 'failed' end as o) s)
select key, seq, outcome, att as attempt from w where n > 0"""


def check_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = F.when(F.col("event_id") % 50 == 0, None).otherwise((F.col("event_id") % 480) / 8 - 2)
    return e.select("event_id", F.round(states.check_interval_hours(left), 6).alias("hours"), F.round(states.next_run(F.lit(0.0), states.check_interval_hours(left))).alias("next_run"))


INTERVAL_SQL = """
with e as (select event_id, case when event_id % 50 <> 0 then (event_id % 480) / 8 - 2 end as l from events), b as (select *, case when l is null then 6.0 when l > 24 then 12.0 when l > 6 then 6.0 else 3.0 end as base from e),
h as (select *, case when l is null or l <= 0 then base else greatest(least(base, case when l > 12 then greatest(l - 12, 1 / 12) else 99 end, case when l > 3 then greatest(l - 3, 1 / 12) else 99 end), 1 / 12) end as h from b)
select event_id, round(h, 6) as hours, round(greatest(h * 3600, 300.0)) as next_run from h"""


def expiry_warnings(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return states.expiry_warnings(s.select("key", "seq", "ts", (F.floor(F.col("ts") / 86400) * 86400 + 86400).alias("expiry_ts")))


WARNINGS_SQL = f"""
with e as ({SIGNALS_SQL}), l as (select key, seq, ts, floor(ts / 86400) * 86400 + 86400 as x from e), t as (select key, seq, ts, x, unnest([case when (x - ts) / 3600 <= 12 then 12.0 end, case when (x - ts) / 3600 <= 3 then 3.0 end]) as threshold from l where x > ts)
select key, seq, cast(threshold as double) as threshold from t where threshold is not null qualify row_number() over (partition by key, x, threshold order by ts, seq) = 1"""


def _feed_runs(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select(F.col("key").cast("long").alias("key"), "seq", "ts", F.when(F.col("seq") % 400 < 250, 0).otherwise(F.col("seq") % 9).cast("int").alias("n_good"), F.when(F.col("seq") % 97 == 0, 1).otherwise(0).alias("n_failed"), (F.col("ts") - F.when(F.col("seq") % 11 == 0, 200_000).otherwise(10)).alias("newest_ts"))


def feed_health(spark: SparkSession, d: str) -> DataFrame:
    return states.feed_health(_feed_runs(spark, d), silence=10.0).select("key", "seq", "alert")


HEALTH_SQL = f"""
with e as ({SIGNALS_SQL}), r as (select key, seq, ts, us, case when seq % 400 < 250 then 0 else seq % 9 end as g, seq % 97 = 0 as f, ts - case when seq % 11 = 0 then 200000 else 10 end as newest from e),
t as (select *, sum(case when g > 0 then 1 else 0 end) over (partition by key order by us, seq) as run, g < 5 and f as word from r), s as (select *, min(case when g = 0 and not word then ts end) over (partition by key, run) as since from t)
select key, seq, case when word then 'keyword' when g = 0 then case when (ts - since) / 3600 >= 10 then 'silence' else '' end when (ts - newest) / 3600 > 10 then 'staleness' else '' end as alert from s"""


def _in_parts(df: DataFrame, machine, parts: int = 3) -> DataFrame:  # noqa: ANN001
    """The rows of a machine over ``df`` as a stream that lands in parts, by time, the state going on from one to the next."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    cuts = df.approxQuantile("ts", [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df.where(F.lit(True) if low is None else F.col("ts") >= low).where(F.lit(True) if high is None else F.col("ts") < high)
        part.write.mode("append").parquet(f"{folder}/landed")
        rows = machine(spark.readStream.schema(df.schema).parquet(f"{folder}/landed"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def health_stream(spark: SparkSession, d: str) -> DataFrame:
    """``feed_health`` on a stream; what timers tell besides is left to tests."""
    return _in_parts(_feed_runs(spark, d), lambda df: machines.feed_health(df, silence=10.0)).where("seq is not null").select("key", "seq", "alert")


def cooldown_stream(spark: SparkSession, d: str) -> DataFrame:
    return _in_parts(signals(spark, d).select(F.col("key").cast("string"), "seq", "ts"), machines.alert_cooldown)


def block_waits(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    hits = s.where("marker = 'error'").select("key", "seq", "ts", (F.col("seq") % 5 * 200).cast("int").alias("seconds"))
    return states.blocked_until(hits).select("key", "seq", F.round("until", 3).alias("until"))


BLOCK_SQL = f"with e as ({SIGNALS_SQL}) select key, seq, round(max(ts + greatest(seq % 5 * 200, 60)) over (partition by key order by us, seq), 3) as until from e where marker = 'error'"


def alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return states.alert_cooldown(signals(spark, d).select(F.col("key").cast("string"), "seq", "ts"))


COOLDOWN_SQL = f"""
with recursive e as ({SIGNALS_SQL}), o as (select '' || key as key, seq, ts, row_number() over (partition by key order by us, seq) as n from e),
w as (select key, n, seq, ts as last, true as sent from o where n = 1 union all select o.key, o.n, o.seq, case when o.ts - w.last >= 21600 then o.ts else w.last end, o.ts - w.last >= 21600 from w join o on o.key = w.key and o.n = w.n + 1)
select key, seq, sent from w"""


def source_guard(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return states.source_guard(s.select("key", "seq", "ts", (F.col("marker") != "error").alias("ok"), (F.col("seq") % 4).cast("int").alias("rows")))


GUARD_SQL = f"""
with recursive e as ({SIGNALS_SQL}), o as (select key, seq, ts, marker <> 'error' as ok, seq % 4 as nr, row_number() over (partition by key order by us, seq) as n from e),
w as (select distinct key, cast(0 as bigint) as n, cast(null as bigint) as seq, 0.0::double as at, cast(0 as bigint) as cr, 0 as fails, 0.0::double as cool, '' as outcome from o
 union all
 select o.key, o.n, o.seq, case when x.o = 'live' then o.ts else w.at end, case when x.o = 'live' then o.nr else w.cr end, case when x.o = 'live' then 0 when x.o in ('degraded_cache', 'failed') then w.fails + 1 else w.fails end,
  case when x.o = 'live' then 0.0 when x.o in ('degraded_cache', 'failed') and w.fails + 1 >= 2 then o.ts + 900 else w.cool end, x.o
 from w join o on o.key = w.key and o.n = w.n + 1, lateral (select w.cr > 0 and o.ts - w.at <= 1800 as fresh) f,
 lateral (select case when w.cool > o.ts then case when f.fresh then 'cooldown_cache' else 'cooldown_skip' end when f.fresh then 'cache' when o.ok then 'live' else 'failed' end as o) x)
select key, seq, outcome from w where n > 0"""


def run_flights(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    return states.single_flight(s.select("key", "seq", "ts", (F.col("seq") % 7 * 9000).cast("double").alias("seconds")))


FLIGHT_SQL = f"""
with recursive e as ({SIGNALS_SQL}), o as (select key, seq, ts, seq % 7 * 9000 as took, row_number() over (partition by key order by us, seq) as n from e),
w as (select key, n, seq, ts + took as until, true as started from o where n = 1 union all select o.key, o.n, o.seq, case when o.ts >= w.until then o.ts + o.took else w.until end, o.ts >= w.until from w join o on o.key = w.key and o.n = w.n + 1)
select key, seq, started from w"""


def answer_contracts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    good = F.lit('{"decisions":[{"id":"1","worth_research":true,"score":50,"reason":"r"}]}')
    payload = F.element_at(F.array(good, F.lit('{"decisions":[{"id":1,"worth_research":true,"score":101,"reason":"r","secret":"s"}]}'), F.lit('{"decisions":[{"id":"1"}],"x":1}'), F.lit("no json"), F.lit(""), F.lit("[]")), (k % 6 + 1).cast("int"))
    rows = e.select(k.alias("id"), payload.alias("payload"))
    return contracts.checked(rows, contracts.TRIAGE).select("id", "valid", F.array_join(F.transform("errors", lambda x: F.concat_ws(":", x["path"], x["type"])), ",").alias("errors"))


CONTRACT_SQL = """select event_id as id, event_id % 6 = 0 as valid, ['', 'decisions.0.id:string_type,decisions.0.score:less_than_equal,decisions.0.[unknown_field]:extra_forbidden', 'decisions.0.worth_research:missing,decisions.0.score:missing,decisions.0.reason:missing,[unknown_field]:extra_forbidden', '$:json_invalid', '$:empty_response', '$:model_type'][event_id % 6 + 1] as errors from events"""


def provider_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    rows = e.select(F.floor(k / 2).alias("id"), (k % 2).cast("int").alias("attempt"), F.element_at(F.array(*[F.lit(x).cast("int") for x in (200, 200, 401, 429, None)]), (k % 5 + 1).cast("int")).alias("status"), F.when(k % 3 == 0, '{"queries":["a"]}').otherwise("x").alias("payload"))
    return contracts.attempts(rows, contracts.SEARCHES)


ATTEMPT_SQL = """
with r as (select event_id // 2 as id, event_id % 2 as a, event_id % 5 as s, event_id % 3 = 0 as v from events),
o as (select *, case s when 4 then 'provider_network_error' when 3 then 'provider_http_429' when 2 then 'provider_http_401' else case when v then 'ok' else 'invalid_structured_output' end end as outcome from r)
select id, outcome, cast(a as int) as attempt from o qualify row_number() over (partition by id order by case when outcome in ('ok', 'provider_http_401') then a else 9 - a end) = 1"""


def _scoped_articles(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    k = F.col("_ord")
    return a.withColumns({"region_scope": _pick(k, "", "local", "discover", "wechat"), "skill_name": F.when(k % 4 == 1, "本地项目").when(k % 4 == 2, _pick(F.floor(k / 4), "知乎发现", "B站发现")).when(k % 4 == 3, "公众号RSS").otherwise(F.col("skill_name")), "wechat_category": F.when(k % 8 == 3, "local").otherwise("industry"), "title": F.when(k % 4 == 1, F.concat(F.lit("无锡 引进项目 仓储 物流 "), "title")).otherwise(F.col("title"))})


def whole_day(spark: SparkSession, d: str) -> DataFrame:
    return news.whole_day(_scoped_articles(spark, d), NOW, YEAR, LOCAL_REGIONS, RULES, LIMITS).select("_ord", "page", "url", "published_ts")


def local_day(spark: SparkSession, d: str) -> DataFrame:
    return news.scope_day(_scoped_articles(spark, d), "local", NOW, YEAR, LOCAL_REGIONS, RULES, LIMITS).select("_ord", "url", "published_ts")


def local_fallback(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d).select("_ord", "published_ts", F.when(F.col("_ord") % 9 == 0, "本地项目").otherwise("公众号RSS").alias("skill_name"), (F.col("_ord") % 7 / 7).alias("score"))
    return select.scope_fallback(a.where("_ord < 0"), a, 12).select("_ord", "skill_name")


FALLBACK_SQL = f"with a as ({ARTICLES_SQL}) select _ord, case when _ord % 9 = 0 then '本地项目' else '公众号RSS' end as skill_name from a order by _ord % 9 = 0 desc, published_ts desc, _ord % 7 desc, _ord limit 3"


def selection_drops(spark: SparkSession, d: str) -> DataFrame:
    a = classify.annotate(articles(spark, d), RULES).withColumn("reject_reason", filters.news_reject_reason(NOW, YEAR))
    unique = a.withColumn("_page", urls.page_key("url")).withColumn("_n", F.row_number().over(Window.partitionBy("_page").orderBy("_ord"))).where("_n = 1").drop("_n", "_page")
    chosen = unique.where("reject_reason = ''").withColumn("quality_score", score.national_quality(NOW, RULES)).orderBy("_ord").limit(24)
    return diagnostics.selection_drops(unique, chosen, LIMITS)


def opportunity_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Versions of projects ranked: one row a project, with its place or the reason why it has none."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    mode = _pick(F.floor(k / 3), "fallback", "ai", "preview", "rules", "ai")
    items = o.select(
        k.alias("_ord"), F.concat(F.lit("p"), _s("o_custkey")).alias("project_key"), F.concat(_pick(F.floor(k / 7), "", "2022年 ", "2024年 ", ""), _pick(k, "立体库 项目 ", "老库 改造 ", "制造 仓库 ", "机场 行李系统 "), _s(k)).alias("title"),
        F.concat(_pick(k, "https://www.x.gov.cn/", "https://a.media.cn/", "https://c.example.com/"), _s(k)).alias("source_url"), F.when(k % 8 == 3, 0.0).when(k % 50 == 9, F.lit(NOW + 200_000.0)).otherwise(NOW - (k % 60) * 86400.0).alias("published_ts"),
        _pick(k, "", "2024-03-20", "", "2024-02-10", "2024年3月1日").alias("deadline"), _pick(k, "300万元", "", "800万元", "2亿元").alias("budget"), _pick(F.floor(k / 2), "PROCUREMENT", "EARLY_SIGNAL", "PROCUREMENT", "UNKNOWN", "AWARD", "PROCUREMENT", "CLOSED").alias("stage"),
        F.lit("").alias("owner"), F.lit("").alias("province"), F.lit("").alias("city"), F.array().cast("array<string>").alias("technical_scope"), F.lit("UNKNOWN").alias("project_type"), (F.col("o_orderkey") % 71 + 30).cast("double").alias("relevance_score"),
        F.lit(50.0).alias("source_score"), (k % 45 + 40).cast("double").alias("final_score"), _pick(k, "A", "B", "WATCH", "DROP").alias("priority"), mode.alias("research_mode"), F.when(k % 13 == 5, "unverified").when(mode == "ai", "verified").otherwise("").alias("verification_status"),
        F.when(k % 17 == 2, F.array(F.lit("search_excerpt_only"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"), F.when(k % 4 == 1, "2024-02-28").otherwise("").alias("last_reported_at"), F.when(k % 8 == 1, "h").otherwise("old").alias("last_digest_hash"), F.lit("h").alias("digest_hash"),
    )
    out = opportunities.ranked(items, NOW, YEAR, 30, L.CompanyProfile(regions=("无锡",)), authoritative=("media.cn",))
    return out.select("_ord", "project_key", "research_mode", "final_score", "priority", F.array_join("risk_flags", ",").alias("flags"), "place", "drop_reason")


RANKING_SQL = """
with o as (select o_orderkey as k, o_custkey as c, k // 7 % 4 as y, ['fallback', 'ai', 'preview', 'rules', 'ai'][k // 3 % 5 + 1] as m0, case when k % 8 = 3 then 0.0 when k % 50 = 9 then 1709251200.0 + 200000 else 1709251200.0 - (k % 60) * 86400 end as ts,
  ['', '2024-03-20', '', '2024-02-10', '2024年3月1日'][k % 5 + 1] as due, ['PROCUREMENT', 'EARLY_SIGNAL', 'PROCUREMENT', 'UNKNOWN', 'AWARD', 'PROCUREMENT', 'CLOSED'][k // 2 % 7 + 1] as stage, cast(k % 71 + 30 as double) as rel from orders),
v as (select *, min(k) over (partition by c) as turn from o qualify row_number() over (partition by c order by ts desc, list_position(['UNKNOWN', 'EARLY_SIGNAL', 'PROCUREMENT', 'AWARD', 'CLOSED'], stage) desc, k) = 1),
a as (select *, 1709251200.0 - ts as late, due in ('2024-03-20', '2024年3月1日') as live, due = '2024-02-10' as gone, m0 = 'preview' or k % 13 = 5 or k % 17 = 2 as pre from v),
r as (select *, case when pre then 'preview' else m0 end as mode, case when y = 1 and not (ts <> 0 and late between -86400 and 90 * 86400) and not live then 'freshness_reject' when ts > 1709251200.0 + 86400 then 'future_publication'
  when stage in ('CLOSED', 'AWARD') or gone or (ts <> 0 and late > case stage when 'PROCUREMENT' then 45 when 'EARLY_SIGNAL' then 90 else 30 end * 86400 and not (stage = 'PROCUREMENT' and live)) then 'freshness_or_inactive_reject'
  when stage <> 'EARLY_SIGNAL' and ts <> 0 and late > 15 * 86400 and due = '' then 'old_without_deadline' when rel < 38 then 'low_relevance' else '' end as why0 from a),
t as (select *, mode = 'ai' as own, case when pre then 3 else k % 3 + 1 end as tier from r),
f as (select *, case when ts = 0 then 30 when late <= 86400 then 100 when late <= 3 * 86400 then 90 when late <= 7 * 86400 then 75 when late <= 15 * 86400 then 50 when stage = 'EARLY_SIGNAL' and late <= 90 * 86400 then 35 else 10 end as fresh,
  case stage when 'PROCUREMENT' then 100 when 'EARLY_SIGNAL' then 85 when 'AWARD' then 25 when 'CLOSED' then 0 else 30 end as urg, case tier when 1 then 100 when 2 then 75 else 40 end as src,
  greatest(0, 10 + case when k % 4 = 2 then 20 else 0 end + case k % 4 when 0 then 15 when 2 then 10 when 3 then -20 else 0 end + case when k % 4 = 1 then 15 else 0 end - case when k % 4 = 3 then 25 else 0 end - case when stage = 'AWARD' then 25 else 0 end) as fit from t),
s as (select *, case when own then cast(k % 45 + 40 as double) else round((rel * 30 + urg * 20 + fresh * 15 + src * 10 + fit * 25) / 100, 1) end as s0, ts = 0 and due = '' as undated from f),
p as (select *, case when pre then 'WATCH' when own then ['A', 'B', 'WATCH', 'DROP'][k % 4 + 1] when s0 >= 80 then 'A' when s0 >= 65 then 'B' when s0 >= 55 then 'WATCH' else 'DROP' end as p0 from s),
w as (select *, case when why0 <> '' then why0 when p0 = 'DROP' then 'low_priority' else '' end as why, case when pre or undated then least(s0, 64.0) else s0 end as fin from p),
n as (select *, case when undated and why = '' then 'WATCH' else p0 end as pri from w),
q as (select *, stage not in ('AWARD', 'CLOSED') and pri <> 'DROP' and (k % 4 <> 1 or k % 8 <> 1) as report from n),
z as (select k, row_number() over (order by not report, fin desc, turn) as place from q where why = '')
select q.k as _ord, 'p' || c as project_key, mode as research_mode, fin as final_score, pri as priority,
  concat_ws(',', case when k % 17 = 2 then 'search_excerpt_only' end, case when not own and (tier <> 1 or pre) then 'official_source_not_found' end, case when undated then 'published_date_not_verified' end) as flags,
  case when z.place <= 30 then z.place end as place, case when why <> '' then why when z.place > 30 then 'ranking_limit' else '' end as drop_reason
from q left join z using (k)"""

_DAY = budgets.Settings(pool=400, hard=200, wave=40, target=25)


def notice_day(spark: SparkSession, d: str) -> tuple:
    """Inputs of a research run over notices made of orders, of which two of seven share a page.

    Kinds of titles, dates, addresses, decisions, answers, documents, evidence and memory follow the page's number.
    """
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumn("q", F.when(F.col("k") % 7 == 3, F.col("k") - 1).otherwise(F.col("k")))
    k, q = F.col("k"), F.col("q")
    title = F.concat(_pick(q, "立体库 招标公告 ", "AGV 拟建 ", "堆垛机 采购公告 ", "仓库租赁 招标公告 ", "2022年 立体库 招标公告 ", "立体库 招标公告 ", "立体库 招标公告 ", "立体库 招标公告 ", "立体库 招标公告 ", "AGV 拟建 ", "堆垛机 采购公告 ", "WMS 中标 "), _s(q + 100_000), F.lit("号"))
    page = F.when(q % 12 == 7, F.concat(F.lit("http://10.0.0.1/"), _s(q))).otherwise(F.concat(F.when(q % 3 == 0, "https://www.x.gov.cn/n/").otherwise("https://c.example.com/n/"), _s(q)))
    days = F.when(q % 12 == 5, 400).when(q % 12 == 6, 60).when(q % 24 == 4, 100).when(q % 12 == 4, 20).otherwise(q % 20)
    ts = F.when((q % 9 == 0) & ~(q % 12).isin(5, 6), 0.0).otherwise(NOW - days * 86400.0)
    candidates = o.select(
        k.alias("_ord"), title.alias("title"), F.concat(page, F.lit("?utm_source="), _s(k)).alias("url"), F.lit("").alias("summary"), F.concat(title, F.when(q % 24 == 6, " 截止时间：2024-03-20").otherwise(""), F.repeat(F.lit("长"), (k % 5).cast("int"))).alias("content"),
        F.lit("来源").alias("source_name"), F.lit("").alias("published"), ts.alias("published_ts"), F.when(k % 4 == 1, "ai_search").otherwise("existing").alias("discovery_method"), F.when(k % 6 == 0, page).otherwise("").alias("verified_url"), F.lit("").alias("snippet_origin"),
        F.concat(F.lit("h"), _s(q)).alias("content_hash"), F.array(_pick(k, "direct", "early", "packaging")).alias("discovery_channels"),
    )
    own = o.where("k = q")
    index = own.where(q % 23 == 5).select(
        k.alias("index_ord"), F.concat(F.lit("p"), _s(q)).alias("project_key"), F.concat(F.lit("旧 "), _s(q)).alias("title"), page.alias("source_url"), F.array(page).alias("pages"), F.lit("").alias("owner"), F.lit("").alias("city"), F.lit("PROCUREMENT").alias("stage"), F.lit("").alias("budget"), F.lit("").alias("deadline"),
        F.array().cast("array<string>").alias("technical_scope"), F.array().cast("array<string>").alias("risk_flags"), F.lit("").alias("notice_version"), F.concat(F.lit("h"), _s(q)).alias("source_content_hash"), F.lit("ai").alias("research_mode"), F.lit("verified").alias("verification_status"),
        (NOW - 3600.0 - (q % 2) * 100_000).alias("last_researched_ts"), F.lit("").alias("published"), F.lit(NOW - 5 * 86400).alias("published_ts"), F.lit(90.0).alias("relevance_score"), F.lit(100.0).alias("source_score"), F.lit("2024-02-01").alias("first_seen"),
        F.lit("").alias("last_reported_at"), F.lit("").alias("last_reported_stage"), F.lit("").alias("last_digest_hash"),
    )
    number = F.regexp_extract("url", "/([0-9]+)$", 1).cast("long")
    decide = lambda pool: pool.select(F.col("url").alias("page"), (number % 5 != 0).alias("worth_research"), (number % 90).cast("double").alias("score"))
    answers = own.select(
        page.alias("page"), F.when(q % 11 == 2, "timeout").otherwise("").alias("error"), (q % 13 != 4).alias("is_real_project"), F.when(q % 29 == 7, 50.0).otherwise(60.0 + q % 40).alias("warehouse_relevance"), title.alias("title"), F.lit("甲公司").alias("owner"), F.lit("").alias("province"), F.lit("").alias("city"),
        F.lit("2024-02-20").alias("published"), F.lit("").alias("budget"), F.lit("2024-03-20").alias("deadline"), F.lit("PROCUREMENT").alias("stage"), F.array().cast("array<string>").alias("technical_scope"), F.lit("UNKNOWN").alias("project_type"),
    )
    documents = own.where(q % 17 != 6).select(page.alias("project_key"), page.alias("url"), F.concat(title, F.lit(" 招标公告 采购人：甲公司 发布 2024-02-20 截止时间 2024-03-20")).alias("text"), F.when(q % 8 == 1, "search_excerpt").otherwise("html").alias("retrieval_method"))
    claim = lambda f, v, quote: F.struct(F.lit(f).alias("field"), v.alias("value"), quote.alias("quote"))
    claims = F.array_compact(F.array(
        claim("title", title, F.concat(F.when(q % 19 == 9, "不在").otherwise(""), title, F.lit(" 招标公告"))), claim("owner", F.lit("甲公司"), F.lit("采购人：甲公司")), claim("published", F.lit("2024-02-20"), F.lit("发布 2024-02-20")),
        F.when(q % 2 == 0, claim("deadline", F.lit("2024-03-20"), F.lit("截止时间 2024-03-20"))), F.when(q % 31 != 3, claim("stage", F.lit("PROCUREMENT"), F.lit("招标公告"))),
    ))
    evidence = own.select(page.alias("project_key"), page.alias("source_url"), F.inline(claims))
    feedback = own.where(q % 46 == 28).select(F.concat(F.lit("p"), _s(q)).alias("project_key"), F.lit("reject").alias("decision"))
    return candidates, index, decide, answers, evidence, documents, feedback


def research_day(spark: SparkSession, d: str) -> DataFrame:
    """A day's research: every page's last stage and reason."""
    trace, _, _ = opportunities.research_day(*notice_day(spark, d), NOW, YEAR, "2024-03-01", _DAY, 40)
    return trace.select("page", "pipeline_stage", "drop_reason")


RESEARCH_SQL = """
with o as (select o_orderkey as k, case when o_orderkey % 7 = 3 then o_orderkey - 1 else o_orderkey end as q from orders),
c as (select *, q % 12 as kind, case when q % 9 = 0 and q % 12 not in (5, 6) then 0.0 else 1709251200.0 - case when q % 12 = 5 then 400 when q % 12 = 6 then 60 when q % 24 = 4 then 100 when q % 12 = 4 then 20 else q % 20 end * 86400 end as ts from o where q % 12 <> 7),
g as (select *, case when kind = 3 then 'hard_exclusion' when kind = 4 and (ts = 0 or q % 24 = 4) then 'historical_title_year' when kind = 5 then 'old_publication' when kind = 6 and q % 24 <> 6 then 'stale_publication' else '' end as why from c),
pages as (select q, max(why) as why from g group by q),
pool0 as (select q, kind, ts, min(k) over (partition by q) as place, k, k % 4 = 1 as ai, k % 6 = 0 as ver from g where why = '' qualify row_number() over (partition by q order by k % 5 desc, k) = 1),
ch as (select distinct q, k % 3 as ch from g where why = ''),
pool as (select *, case when kind in (1, 9) then 18 when kind in (2, 10) then 68 when kind = 11 then 45 else 61 end as rel from pool0),
wt as (select *, rel + ai::int * 10 + (ts <> 0 and 1709251200.0 - ts <= 15 * 86400)::int * 15 + (q % 3 = 0)::int * 25 + ver::int * 10 as weight from pool),
reused as (select q from wt where q % 23 = 5 and q % 7 <> 3 and q % 2 = 0 and ver),
pend as (select *, row_number() over (order by weight desc, place) as rk, row_number() over (partition by rel < 38 order by weight desc, place) as lk from wt where q not in (select q from reused)),
cnt as (select count(*) as n, least(100, count(*) filter (rel < 38)) as quota from pend),
heads as (select distinct q from (select p.q, row_number() over (partition by ch order by weight desc, place) as n from pend p join ch on ch.q = p.q) where n = 1),
hn as (select count(*) as h from heads),
tiered as (select pend.*, case when n <= 400 then 0 when pend.q in (select q from heads) then 0 when rk <= greatest(0, 400 - quota - h) then 1 when rel < 38 and lk <= quota then 2 else 3 end as tier from pend, cnt, hn),
filt as (select *, row_number() over (order by tier, rk) as pp from tiered qualify pp <= 400),
queue as (select *, case when q % 5 <> 0 then row_number() over (order by (q % 5 <> 0) desc, q % 90 desc, pp) end as rank from filt),
res as (select *, (rank - 1) // 40 as wave, case when q % 11 = 2 then 'research_error' when q % 17 = 6 then 'source_unavailable' when q % 13 = 4 or q % 29 = 7 then 'semantic_reject' when q % 19 = 9 then 'verifier_reject' else '' end as why from queue where q % 5 <> 0),
itm as (select *, q % 8 = 1 as pre, case when q % 31 = 3 then 'UNKNOWN' else 'PROCUREMENT' end as stage, case when q % 2 = 0 then '2024-03-20' else '' end as due, 60 + q % 40 as irel, 1708358400.0 as its from res where why = '' and rank <= 200),
sc as (select *, case when pre then 3 when q % 3 = 0 then 1 else 3 end as tier, round((irel * 30 + case stage when 'PROCUREMENT' then 100 else 30 end * 20 + 50 * 15 + case when not pre and q % 3 = 0 then 100 else 40 end * 10 + 10 * 25) / 100, 1) as s from itm),
good as (select w, count(*) as n from sc, (select unnest(range(1, 6)) as w) where wave < w and not pre and s >= 65 group by w),
stop as (select min(w) as stop from good where n >= 25),
wv as (select res.*, case when rank > 200 then 'research_hard_limit' when wave >= stop then 'verified_target_met' else '' end as stopped from res, stop),
ai as (select sc.q, sc.place, 'ai' as kind_, pre, sc.s, sc.stage, sc.due, sc.its as ts, sc.irel as rel from sc join wv on wv.q = sc.q and wv.stopped = ''),
fb as (select wv.q, place, case when kind = 11 then 'AWARD' else 'PROCUREMENT' end as stage, case when kind = 6 then '2024-03-20' else '' end as due, ts, rel from wv where stopped = '' and why in ('research_error', 'source_unavailable') and (not ai or ver) and rel >= 38),
ru as (select wt.q, wt.place from wt join reused using (q)),
obs as (select q, place, 'ai' as mode, pre, s, stage, due, ts, rel::double as rel from ai union all select q, place, 'fallback', false, 0.0, stage, due, ts, rel from fb union all select q, place, 'ai', false, 70.8, 'PROCUREMENT', '', 1709251200.0 - 5 * 86400, 90 from ru),
hist as (select *, q % 23 = 5 and q % 7 <> 3 as known from obs),
hs as (select q, place, mode, pre, s, rel, known, case when known and ts <> 0 and 1709251200.0 - 5 * 86400 > ts then 'PROCUREMENT' else stage end as stage, case when known and ts <> 0 and 1709251200.0 - 5 * 86400 > ts then '' else due end as due, ts from hist),
rr as (select *, 1709251200.0 - ts as late from hs),
rk as (select *, case when stage = 'AWARD' or (ts <> 0 and late > case stage when 'PROCUREMENT' then 45 else 30 end * 86400 and not (stage = 'PROCUREMENT' and due <> '')) then 'freshness_or_inactive_reject' when ts <> 0 and late > 15 * 86400 and due = '' then 'old_without_deadline' when rel < 38 then 'low_relevance' else '' end as w0,
  case when ts = 0 then 30 when late <= 86400 then 100 when late <= 3 * 86400 then 90 when late <= 7 * 86400 then 75 when late <= 15 * 86400 then 50 else 10 end as fresh from rr),
fs as (select *, case when mode = 'ai' then case when pre then least(s, 64.0) else s end else round((rel * 30 + 100 * 20 + fresh * 15 + case when q % 3 = 0 then 100 else 40 end * 10 + 10 * 25) / 100, 1) end as s1 from rk),
hy as (select *, case when q % 12 = 4 and ts <> 0 and late > 90 * 86400 and due = '' then 'freshness_reject' else w0 end as w1 from fs),
pv as (select *, case when mode = 'ai' and pre then 64.0 else 999.0 end as cap from hy),
vs as (select *, case when pre then round((rel * 30 + case stage when 'PROCUREMENT' then 100 else 30 end * 20 + fresh * 15 + 40 * 10 + 250) / 100, 1) else s1 end as s2 from pv),
dr as (select *, case when w1 <> '' then w1 when not pre and s2 < 55 then 'low_priority' else '' end as w2, case when pre or (ts = 0 and due = '') then least(s2, 64.0) else s2 end as fin from vs),
pl as (select q, row_number() over (order by fin desc, place) as place from dr where w2 = ''),
fin as (select dr.q, case when dr.known and dr.q % 46 = 28 then 'feedback_reject' when w2 <> '' then w2 when pl.place > 40 then 'ranking_limit' else '' end as why from dr left join pl on pl.q = dr.q),
marks as (
  select wv.q, case when fin.why = '' then 'retained' else 'ranking' end as st, fin.why as why from wv join fin on fin.q = wv.q where stopped = '' and wv.why = ''
  union all select q, case when why in ('semantic_reject', 'research_error') then 'research' else 'verifier' end, why from wv where stopped = '' and why <> ''
  union all select q, 'research_queue', stopped from wv where stopped <> '' union all select q, 'triage', 'triage_reject' from queue where q % 5 = 0
  union all select q, 'candidate_pool', 'candidate_pool_limit' from pend where q not in (select q from filt) union all select q, 'memory', 'reused_verified_snapshot' from reused)
select case when p.q % 3 = 0 then 'https://www.x.gov.cn/n/' else 'https://c.example.com/n/' end || p.q as page, coalesce(m.st, 'prefilter') as pipeline_stage, coalesce(m.why, p.why) as drop_reason from pages p left join marks m on m.q = p.q"""


PAIRS = {
    "notice_versions": (notice_versions, NOTICE_SQL),
    "unverified_rows": (unverified_rows, UNVERIFIED_SQL),
    "publishable": (publishable, PUBLISHABLE_SQL),
    "digest_message": (digest_message, DIGEST_SQL),
    "priority_counts": (priority_counts, "select count(*) filter (o_orderkey % 5 in (0, 4)) as n_a, count(*) filter (o_orderkey % 5 = 1) as n_b, count(*) filter (o_orderkey % 5 = 2) as n_watch from orders"),
    "verified_projects": (verified_projects, VERIFIED_SQL),
    "attachment_documents": (attachment_documents, ATTACHMENT_SQL),
    "benchmark_figures": (benchmark, BENCHMARK_SQL),
    "benchmark_errors": (benchmark_errors, ERRORS_SQL),
    "benchmark_problems": (benchmark_problems, PROBLEMS_SQL),
    "delivery_events": (delivery_events, EVENTS_SQL),
    "metered_requests": (metered_requests, METERED_SQL),
    "search_plan": (search_plan, PLAN_SQL),
    "research_waves": (research_waves, WAVES_SQL),
    "rescue_searches": (rescue_searches, RESCUE_SQL),
    "source_order": (source_order, SOURCE_ORDER_SQL),
    "delivery_attempts": (delivery_attempts, DELIVERY_SQL),
    "check_intervals": (check_intervals, INTERVAL_SQL),
    "expiry_warnings": (expiry_warnings, WARNINGS_SQL),
    "feed_health": (feed_health, HEALTH_SQL),
    "health_stream": (health_stream, HEALTH_SQL),
    "cooldown_stream": (cooldown_stream, COOLDOWN_SQL),
    "block_waits": (block_waits, BLOCK_SQL),
    "alert_cooldown": (alert_cooldown, COOLDOWN_SQL),
    "source_guard": (source_guard, GUARD_SQL),
    "run_flights": (run_flights, FLIGHT_SQL),
    "answer_contracts": (answer_contracts, CONTRACT_SQL),
    "provider_attempts": (provider_attempts, ATTEMPT_SQL),
    "whole_day": (whole_day, None),
    "local_day": (local_day, None),
    "local_fallback": (local_fallback, FALLBACK_SQL),
    "selection_drops": (selection_drops, None),
    "opportunity_ranking": (opportunity_ranking, RANKING_SQL),
    "research_day": (research_day, RESEARCH_SQL),
}

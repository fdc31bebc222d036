"""News: from article rows to the day's selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..functions import urls
from ..operators import classify, dedup, filters, score, select
from ..sources import discovery
from ..tables import scratch, stored


def national(articles: DataFrame, now: float, year: int, rules: L.NewsRules = L.NewsRules(), limits: L.Limits = L.Limits(), near: bool = True, scope: list[str] | None = None) -> DataFrame:
    """Annotate, reject, score, deduplicate, and select under caps. ``near`` False deduplicates by page only."""
    annotated = classify.annotate(articles, rules)
    kept = annotated.withColumn("reject_reason", filters.news_reject_reason(now, year, limits.max_age_days)).where("reject_reason = ''")
    scored = kept.withColumn("quality_score", score.national_quality(now, rules))
    if near:
        unique = dedup.leaders_national(scored, scope)
        order = [F.desc("quality_score"), F.asc("_place")]
    else:
        unique = dedup.first_by(scored.withColumn("_page", urls.page_key("url")), ["_page"], F.desc("quality_score")).drop("_page")
        order = [F.desc("quality_score"), F.asc("_ord")]
    return select.capacity(unique, limits, order, scope)


def _scored(kept: DataFrame, now: float, regions: tuple[str, ...]) -> DataFrame:
    """Rows outside the national scope with vendor_hit, uid, demand_signal (tenths), the flag of 0.8 and more, and score."""
    signal = classify.demand_signal(filters.told()[0], regions)
    marked = kept.withColumns({"vendor_hit": filters.vendor_hit(), "bidding_hit": filters.bidding_hit(), "uid": urls.uid("url"), "demand_signal": signal})
    marked = marked.withColumn("is_potential_warehouse_demand", F.col("demand_signal") >= 8)
    return marked.withColumn("score", score.article_score(now, F.col("demand_signal"), F.col("vendor_hit"), F.col("bidding_hit"), T.any_of(T.text("source_name"), L.TRUSTED))).drop("bidding_hit")


def _others(rows: DataFrame, now: float, regions: tuple[str, ...]) -> DataFrame:
    """Rows outside the national scope that filters and near titles leave, scored. Both tables are written: titles and texts are looked at once, however often rows are asked for."""
    folder = scratch(rows.sparkSession)
    kept = dedup.leaders_overlap(filters.filter_relevant(stored(rows, folder, "articles"), regions))
    return stored(_scored(kept, now, regions), folder, "scored")


def other_scope(articles: DataFrame, now: float, count: int, regions: tuple[str, ...] = ()) -> DataFrame:
    """Filter, drop near titles, score with the demand signal, and take turns between sources."""
    return select.round_robin(_others(articles, now, regions), count, now)


def pool(df: DataFrame, scope: str) -> DataFrame:
    """Rows that a scope's page draws on. Accounts' rows of the local kind, or from local accounts, belong to the local page."""
    region, kind = T.text("region_scope"), F.lower(F.trim(T.text("wechat_category") if "wechat_category" in df.columns else F.lit("industry")))
    ours = (region == "wechat") & ((kind == "local") | T.any_of(T.text("source_name"), L.LOCAL_ACCOUNTS))
    if scope == "local":
        return df.where((region == "local") | ours)
    if scope == "wechat":
        return df.where((region == "wechat") & ~ours)
    return by_scope(df, scope)


def _selected(scored: DataFrame, scope: str, now: float, limits: L.Limits, fallback: bool) -> DataFrame:
    rows = pool(scored, scope)
    if scope == "discover":
        keyed = rows.withColumns({"source_key": discovery.source_key(), "placeholder": discovery.placeholder()})
        unique = dedup.first_by(keyed, ["uid"], F.col("placeholder").cast("int").asc(), F.desc("score"))
        return select.two_source_quota(unique, limits.discover, "zhihu", "bilibili").drop("source_key", "placeholder")
    chosen = select.round_robin(rows, limits.local if scope == "local" else limits.account, now)
    return select.scope_fallback(chosen, rows, limits.local) if fallback and scope == "local" else chosen


def whole_day(articles: DataFrame, now: float, year: int, regions: tuple[str, ...] = (), rules: L.NewsRules = L.NewsRules(), limits: L.Limits = L.Limits()) -> DataFrame:
    """The day's four selections together, newest first: national, local, discover and accounts. Column ``page`` tells which."""
    first = national(by_scope(articles, "national"), now, year, rules, limits)
    scored = _others(articles.where(~classify.is_national("region_scope")), now, regions)
    parts = [first.withColumn("page", F.lit("national"))] + [_selected(scored, s, now, limits, False).withColumn("page", F.lit(s)) for s in ("local", "discover", "wechat")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(F.desc("published_ts"), "_ord")


def scope_day(articles: DataFrame, scope: str, now: float, year: int, regions: tuple[str, ...] = (), rules: L.NewsRules = L.NewsRules(), limits: L.Limits = L.Limits()) -> DataFrame:
    """A partial refresh: one scope's selection. An empty local page shows the best three rows of its pool."""
    if scope == "national":
        return national(by_scope(articles, scope), now, year, rules, limits)
    scored = _others(articles.where(~classify.is_national("region_scope")), now, regions)
    return _selected(scored, scope, now, limits, True)


def by_scope(df: DataFrame, scope: str) -> DataFrame:
    return df.where(classify.is_national("region_scope") if scope == "national" else T.text("region_scope") == scope)

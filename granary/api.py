"""What readers ask for: a day's news by scope, a day's opportunities, the days there are, a refresh. Data lie under one path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from .functions import text as T
from .plans import news as plans
from .sources import landed, sinks
from .sources.versions import Days

NEWS = ", ".join(f"{c} {'double' if c in ('published_ts', 'fetched_at', 'content_quality', 'relevance_score', 'demand_signal_score') else 'boolean' if c == 'is_potential_warehouse_demand' else 'string'}" for c in sinks.SNAPSHOT)
SCOPES = ("national", "local", "discover", "wechat")


def stored_news(spark: SparkSession, base: str) -> Days:
    return Days(spark, f"{base.rstrip('/')}/news", f"{NEWS}, page string, day date")


def stored_opportunities(spark: SparkSession, base: str) -> Days:
    return Days(spark, f"{base.rstrip('/')}/opportunities", "project_key string, title string, final_score double, day date")


def news(spark: SparkSession, base: str, day: str, scope: str = "national", kind: str = "all") -> DataFrame:
    """A day's rows of one scope, newest first; no rows where the day was not stored. Unknown scopes count as national.

    Accounts' rows of the local kind stand on the local page; with ``kind`` the accounts' page shows only them, or none of them.
    """
    scope = scope if scope in SCOPES else "national"
    rows = stored_news(spark, base).read(day)
    if scope == "wechat" and kind != "all":
        ours = T.text("region_scope") == "wechat"
        rows = rows.where(ours & (F.col("page") == ("local" if kind == "local" else "wechat")))
    else:
        rows = rows.where(F.col("page") == scope)
    return rows.orderBy(F.desc("published_ts"), "url")


def opportunities(spark: SparkSession, base: str, day: str) -> DataFrame:
    """A day's projects in order; no rows where the day was not stored."""
    return stored_opportunities(spark, base).read(day).orderBy(F.desc("final_score"), "project_key")


def days(spark: SparkSession, base: str, limit: int = 30) -> DataFrame:
    return sinks.available_days(stored_news(spark, base).read(), limit)


def status(spark: SparkSession, base: str) -> DataFrame:
    """Per stored day its rows and when they were taken."""
    rows = stored_news(spark, base).read()
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.max("fetched_at").alias("fetched_at")).orderBy(F.desc("day"))


def refresh(spark: SparkSession, articles: DataFrame, base: str, day: str, now: float, scope: str = "", regions: tuple[str, ...] = (), rules: L.NewsRules = L.NewsRules(), limits: L.Limits = L.Limits()) -> DataFrame:
    """Select the day's news, or one scope's in place of what the day had of it, and store the day's next version. Returns what is stored.

    Readers see the old version whole until the new one is. No rows go through the driver.
    """
    year = int(landed.strict_day(day)[:4])
    days = stored_news(spark, base)
    if scope:
        fresh = plans.scope_day(articles, scope, now, year, regions, rules, limits).withColumn("page", F.lit(scope))
    else:
        fresh = plans.whole_day(articles, now, year, regions, rules, limits)
    fresh = sinks.snapshot_columns(fresh.withColumn("fetched_at", F.lit(now)), "page")
    rows = days.read(day).drop("day").where(F.col("page") != scope).unionByName(fresh, allowMissingColumns=True) if scope else fresh
    days.write(rows, day)
    return days.read(day).drop("day")


def views(spark: SparkSession, base: str, day: str) -> None:
    """Temporary views ``news_<scope>`` and ``opportunities`` of a day, for SQL."""
    for scope in SCOPES:
        news(spark, base, day, scope).createOrReplaceTempView(f"news_{scope}")
    opportunities(spark, base, day).createOrReplaceTempView("opportunities")


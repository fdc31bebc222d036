"""Counts that explain a run: funnels, drop reasons, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..lexicon import Limits


def summary(df: DataFrame, top: int = 6) -> DataFrame:
    """Rows by region, by skill (the ``top`` largest, ties by name) and by category: kind, name, n."""
    count = lambda c: df.groupBy(F.coalesce(F.col(c), F.lit("")).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(c))
    skills = count("skill_name").orderBy(F.desc("n"), "name").limit(top)
    return count("region_scope").unionByName(skills).unionByName(count("news_category")).select("kind", "name", "n")


def funnel(df: DataFrame, by: str, stages: list[str]) -> DataFrame:
    """Per value of ``by``, how many rows reached each stage (boolean columns)."""
    return df.groupBy(by).agg(F.count("*").alias("raw"), *[F.count_if(s).alias(s) for s in stages])


def drop_reasons(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    return df.where(F.col(reason) != "").groupBy(reason).agg(F.count("*").alias("n"))


def selection_drops(unique: DataFrame, selected: DataFrame, limits: Limits = Limits(), reason: str = "reject_reason") -> DataFrame:
    """(drop_reason, n) of deduplicated rows whose page was not selected: their reason, else the limit that the selection has reached.

    The limits are looked at in turn: publisher, category, undated rows, all rows.
    """
    page = lambda df: df.withColumn("_page", urls.page_key("url"))
    rest = page(unique).join(page(selected).select("_page").distinct(), "_page", "left_anti")
    full = lambda c, most: selected.groupBy(c).agg(F.count("*").alias("_c")).where(F.col("_c") >= most).select(F.col(c), F.lit(True).alias(f"_full_{c}"))
    undated = selected.agg((F.count_if(F.col("published_ts") == 0) >= limits.unknown_dates).alias("_undated"))
    told = rest.join(F.broadcast(full("source_group", limits.per_group)), "source_group", "left").join(F.broadcast(full("news_category", max(1, (limits.national + 2) // 3))), "news_category", "left").crossJoin(F.broadcast(undated))  # one row
    limit = F.when(F.coalesce("_full_source_group", F.lit(False)), "publisher_limit").when(F.coalesce("_full_news_category", F.lit(False)), "category_limit").when((F.col("published_ts") == 0) & F.col("_undated"), "unknown_date_limit").otherwise("display_limit")
    return told.select(F.when(F.col(reason) != "", F.col(reason)).otherwise(limit).alias("drop_reason")).groupBy("drop_reason").agg(F.count("*").alias("n"))


def channel_funnel(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows by discovery channel; a row counts in each of its channels."""
    return df.select(F.explode(F.array_distinct("discovery_channels")).alias("channel"), *flags).groupBy("channel").agg(F.count("*").alias("pool"), *[F.count_if(f).alias(f) for f in flags])


def usage(ledger: DataFrame, days: int = 90) -> DataFrame:
    """Daily sums by provider and phase over the last ``days`` dates that occur."""
    recent = ledger.select("day").distinct().orderBy(F.desc("day")).limit(days)
    return ledger.join(F.broadcast(recent), "day", "left_semi").groupBy("day", "provider", "phase").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))

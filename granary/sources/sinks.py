"""Sinks: day snapshots, replaced as a whole, and a digest within a size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T


def write_day(df: DataFrame, path: str, day: str, *more: str) -> None:
    """Replace the partitions that ``df`` holds of one day, others stay; readers see whole files only."""
    df.withColumn("day", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", *more).parquet(path)


def available_days(df: DataFrame, limit: int = 30) -> DataFrame:
    return df.select("day").distinct().orderBy(F.desc("day")).limit(limit)


STAGE_LABELS = {"EARLY_SIGNAL": "采购前期", "PROCUREMENT": "采购/招标", "AWARD": "已中标", "CLOSED": "已结束", "UNKNOWN": "阶段待核实"}
SNAPSHOT = ("title", "url", "summary", "source_name", "image_url", "published", "published_ts", "fetched_at", "content_quality", "skill_name", "source_domain", "source_group", "source_kind", "collection_url", "news_category", "relevance_score", "region_scope", "demand_signal_score", "is_potential_warehouse_demand")


def snapshot_columns(df: DataFrame, *more: str) -> DataFrame:
    """The 19 columns of a news snapshot, defaults where the rows lack one, and ``more``."""
    numbers, flags = ("published_ts", "fetched_at", "content_quality", "relevance_score", "demand_signal_score"), ("is_potential_warehouse_demand",)
    default = lambda c: F.lit(0.0) if c in numbers else F.lit(False) if c in flags else F.lit("national" if c == "region_scope" else "")
    return df.select(*[F.coalesce(F.col(c), default(c)).alias(c) if c in df.columns else default(c).alias(c) for c in SNAPSHOT], *more)


def cut_bytes(c: Column, most: Column) -> Column:
    """The longest prefix of whole characters within ``most`` bytes of UTF-8."""
    raw = c.cast("binary")
    cuts = [F.try_validate_utf8(F.substr(raw, F.lit(1), F.greatest(most - k, F.lit(0))).cast("string")) for k in range(4)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*cuts))


def digest(df: DataFrame, day: str, site: str, limit: int = 5, most_bytes: int = 4096) -> DataFrame:
    """One row, ``message``: counts by priority, a block for each of the first rows (in order of ``_ord``), and a link.

    A message over ``most_bytes`` of UTF-8 keeps every block, each cut to an equal share.
    """
    head = df.orderBy("_ord").limit(min(limit, 5))
    row = head.withColumn("_n", F.row_number().over(Window.orderBy("_ord")))
    changed = (T.text("last_reported_at") != "") & (T.text("last_digest_hash") != T.text("digest_hash"))
    mark = F.when(F.col("priority") == "A", "🔴").when(F.col("priority") == "B", "🟠").otherwise("⚪")
    mode = F.when(F.col("research_mode") == "preview", " · 搜索摘要预览").when(F.col("research_mode") == "fallback", " · 规则筛选").otherwise("")
    stage = F.coalesce(*[F.when(F.col("stage") == k, F.lit(v)) for k, v in STAGE_LABELS.items()], F.lit("阶段待核实"))
    either = lambda *c: F.coalesce(*[F.nullif(T.text(x), F.lit("")) for x in c[:-1]], F.lit(c[-1]))
    scope, entry = F.array_join(F.col("technical_scope"), " / "), T.text("entry_point")
    block = F.concat(
        F.lit("\n"), mark, F.lit(" **"), F.col("_n").cast("string"), F.lit(". "), T.marked("title", 54), F.lit("**"), F.when(changed, " · 项目更新").otherwise(""), mode, F.lit("\n"),
        T.marked(either("province", "city", "地区待核实"), 12), F.lit(" · "), T.marked(either("budget", "预算待核实"), 28), F.lit(" · "), stage, F.lit("\n"),
        F.when(F.coalesce(F.size("technical_scope"), F.lit(0)) > 0, F.concat(F.lit("涉及："), T.marked(scope, 45), F.lit("\n"))).otherwise(""), F.when(entry != "", F.concat(F.lit("切入："), T.marked(entry, 60), F.lit("\n"))).otherwise(""),
    )
    n = lambda p: F.count_if(F.col("priority") == p).cast("string")
    whole = row.withColumn("_block", block).agg(F.array_sort(F.collect_list(F.struct("_n", "_block"))).alias("_b"), F.count("*").cast("string").alias("_size"), n("A").alias("_a"), n("B").alias("_bb"), n("WATCH").alias("_w"), F.coalesce(F.max(F.col("research_mode") == "fallback"), F.lit(False)).alias("_f"), F.coalesce(F.max(F.col("research_mode") == "preview"), F.lit(False)).alias("_p"))
    top = F.concat(
        F.lit(f"📌 智能仓储商机日报｜{day}\n\n今日筛选 "), F.col("_size"), F.lit(" 条\nA级 "), F.col("_a"), F.lit(" 条 · B级 "), F.col("_bb"), F.lit(" 条 · 观察 "), F.col("_w"), F.lit(" 条\n"),
        F.when(F.col("_f"), "\n部分项目为规则筛选结果，请核对原文。\n").otherwise(""), F.when(F.col("_p"), "\n部分项目仅依据搜索摘要初步判断，原文尚未读取，不进入自动推送。\n").otherwise(""),
    )
    foot = F.lit(f"\n👉 [查看完整日报与原始来源]({site.rstrip('/')}/?scope=opportunity)")
    texts = F.transform("_b", lambda b: b["_block"])
    message = F.concat(top, F.array_join(texts, ""), foot)
    share = F.floor(F.greatest(most_bytes - F.octet_length(F.concat(top, foot)) - 32, F.lit(0)) / F.greatest(F.size("_b"), F.lit(1))).cast("int")
    cut = F.concat(top, F.array_join(F.transform(texts, lambda b: F.concat(cut_bytes(b, share), F.lit("…\n"))), ""), foot)
    return whole.select(F.when(F.octet_length(message) <= most_bytes, message).otherwise(cut).alias("message"))


def feature(df: DataFrame, scope: str = "national") -> DataFrame:
    """Rows of a day's page with their place: national ones by quality, others as they are; the first is the feature."""
    order = [F.desc("quality_score"), F.asc("_ord")] if scope == "national" else [F.asc("_ord")]
    placed = df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return placed.withColumns({"is_feature": F.col("place") == 1, "shown_date": dates.article_date("published", F.col("published_ts")), "picture": F.when(T.text("image_url") == "", bucket("title", "url"))})


REFERRERS = ((("sogoucdn.com",), "https://weixin.sogou.com/"), (("mmbiz.qpic.cn", "mmbiz.qlogo.cn"), "https://mp.weixin.qq.com/"), (("zhimg.com",), "https://www.zhihu.com/"), (("hdslb.com", "bilibili.com"), "https://www.bilibili.com/"))


def local_image(url: str, content_type: str, n_bytes: str, status: str = "status") -> Column:
    """Address of a landed picture on the own site; empty for a guarded site's stand-in, the old address where it did not land."""
    kind = F.lower(T.text(content_type))
    ext = F.when(F.contains(kind, F.lit("icon")), ".ico").when(F.contains(kind, F.lit("png")), ".png").when(F.contains(kind, F.lit("gif")), ".gif").when(F.contains(kind, F.lit("webp")), ".webp").otherwise(".jpg")
    guarded = T.any_of(T.text(url), ("qpic.cn", "qlogo.cn", "sogoucdn.com")) & (F.col(n_bytes) < 5000) & ~F.contains(kind, F.lit("svg"))
    stored = F.concat(F.lit("/images/"), F.substring(F.md5(T.text(url).cast("binary")), 1, 10), ext)
    return F.when(T.text(url) == "", "").when(F.coalesce(F.col(status) != 200, F.lit(True)), T.text(url)).when(guarded, "").otherwise(stored)


def referrer(url: str) -> Column:
    """The address that a picture's site wants to have been linked from; empty if none."""
    return F.coalesce(*[F.when(T.any_of(T.text(url), sites), F.lit(r)) for sites, r in REFERRERS], F.lit(""))


def acknowledged(payload: str, status: str = "status") -> Column:
    """Stable reason of a webhook's answer; empty if it took the message."""
    code = F.get_json_object(T.text(payload), "$.errcode")
    return F.when(F.col(status) != 200, "wecom_delivery_failed").when(~T.text(payload).rlike("^\\s*\\{"), "wecom_invalid_response").when(F.coalesce(code.try_cast("int"), F.lit(-1)) != 0, "wecom_rejected").otherwise("")


def alert_message(title: str, content: str, hint: str = "", mentioned: str = "") -> dict:
    """Payload of an alert: text with a hint, and whom it names (comma-separated)."""
    names = [x.strip() for x in (mentioned or "").split(",") if x.strip()]
    return {"msgtype": "text", "text": {"content": "\n\n".join(x for x in (title, content, hint) if x)} | ({"mentioned_list": names} if names else {})}


def bucket(title: str, url: str, n: int = 4) -> Column:
    """Number of the stand-in picture of a row without one, from the lengths of its title and address."""
    return F.pmod(F.length(T.text(title)) * 3 + F.length(T.text(url)), F.lit(n))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

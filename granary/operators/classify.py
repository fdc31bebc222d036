"""Classifiers and annotations: news categories, opportunity types, stages, relevance and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..functions.urls import host, source_domain


def news_text(title: Column | str, summary: Column | str) -> Column:
    return F.lower(F.concat(T.text(title), F.lit(" "), T.text(summary)))


def assess(df: DataFrame, rules: L.NewsRules = L.NewsRules()) -> DataFrame:
    """Add news_category, relevance_score and assess_reason (empty if relevant) from title, summary, skill_name, source_kind.

    The event words are looked for in the title only, all others in title and summary.
    """
    both, title = news_text("title", "summary"), F.lower(T.text("title"))
    n_core, solid = T.count_of(both, rules.core, True), T.any_of(both, [w for w in rules.core if w not in rules.ambiguous], True)
    found = df.withColumns({"_n": n_core, "_solid": solid, "_related": T.any_of(both, rules.related, True), "_context": T.any_of(both, rules.context), "_bid": T.any_of(both, rules.bid), "_event": T.any_of(title, rules.event, True)})
    core, context = F.col("_n") > 0, F.col("_context")
    reason = (
        F.when(T.any_of(both, rules.hard_exclude), "irrelevant_content")
        .when(T.any_of(both, rules.unrelated) & ~F.col("_solid"), "unrelated_topic")
        .when(~core & ~F.col("_related") & ~context, "no_industry_context")
        .when(~F.col("_event") & F.col("_bid") & ~core & ~context, "bidding_without_logistics")
        .otherwise("")
    )
    category = (
        F.when(F.col("_event"), "展会活动")
        .when(F.col("_bid"), "项目招采")
        .when((T.text("skill_name") == "政策标准") | T.any_of(both, rules.policy), "政策标准")
        .when(core & T.any_of(both, rules.case), "项目案例")
        .when(T.text("source_kind") == "vendor", "企业动态")
        .when(~core & ~context, "相关工业动态")
        .when(core, "技术产品")
        .otherwise("行业动态")
    )
    relevance = F.when(core, F.least(F.lit(95), 72 + 4 * F.col("_n")) / 100).otherwise(F.when(context, 0.55).otherwise(0.38))
    out = found.withColumn("assess_reason", reason)
    kept = F.col("assess_reason") == ""
    out = out.withColumns({"news_category": F.when(kept, category).otherwise(""), "relevance_score": F.when(kept, relevance).otherwise(0.0)})
    return out.drop("_n", "_solid", "_related", "_context", "_bid", "_event")


def annotate(df: DataFrame, rules: L.NewsRules = L.NewsRules(), groups: dict[str, str] = L.GROUPS, names: dict[str, str] = L.SOURCE_NAMES) -> DataFrame:
    """``assess``, and source_domain, source_group and a name for generic sources."""
    domain = source_domain("url", (*names, *L.NEWS_DOMAINS))
    out = df.withColumn("source_domain", domain)

    def looked_up(table: dict[str, str]) -> Column:
        return F.coalesce(*[F.when(F.col("source_domain") == k, F.lit(v)) for k, v in table.items()], F.lit(None).cast("string"))

    own = F.when(T.text("source_group") != "", F.col("source_group"))
    out = out.withColumn("source_group", F.coalesce(looked_up(groups), own, F.col("source_domain")))
    generic = T.text("source_name").isin(*L.GENERIC_SOURCES)
    return assess(out.withColumn("source_name", F.when(generic, F.coalesce(looked_up(names), F.col("source_domain"))).otherwise(F.col("source_name"))), rules)


def is_national(scope: Column | str) -> Column:
    return ~T.text(scope).isin("local", "discover", "wechat")


def demand_signal(c: Column, regions: tuple[str, ...] = ()) -> Column:
    """Demand score in tenths, 12 at most: strong words 7, medium 3, warehouse context 3, region 2. Case does not matter."""
    low = F.lower(c)
    parts = [(T.any_of(low, L.DEMAND_STRONG), 7), (T.any_of(low, L.DEMAND_MEDIUM), 3), (T.any_of(low, L.WAREHOUSE_CONTEXT), 3), (T.any_of(low, [w.lower() for w in regions if w]), 2)]
    return F.least(F.lit(12), reduce(lambda a, b: a + b, [F.when(p, w).otherwise(0) for p, w in parts]))


def stage(c: Column, stages: dict[str, tuple[str, ...]] = L.STAGES) -> Column:
    """The first stage with a word in the text; UNKNOWN if none."""
    return F.coalesce(*[F.when(T.any_of(c, words), F.lit(name)) for name, words in stages.items()], F.lit("UNKNOWN"))


def candidate_stage(title: Column | str, whole: Column | str) -> Column:
    """The title's stage, softer words of the title, then the whole text's stage."""
    t = T.text(title)
    own = F.nullif(stage(t), F.lit("UNKNOWN"))
    return F.coalesce(own, F.when(T.any_of(t, L.TITLE_EARLY), "EARLY_SIGNAL").when(T.any_of(t, L.TITLE_TENDER), "PROCUREMENT"), stage(T.text(whole)))


def project_type(c: Column, types=L.TYPES) -> Column:  # noqa: ANN001
    hits = F.array_compact(F.array(*[F.when(T.any_of(F.upper(c) if upper else c, words), F.lit(name)) for name, words, upper in types]))
    return F.when(F.size(hits) > 1, "MIXED").when(F.size(hits) == 1, F.get(hits, 0)).otherwise("UNKNOWN")


def relevance(df: DataFrame, terms: dict[str, int] = L.WAREHOUSE_TERMS, intents: dict[str, int] = L.INTENT_TERMS) -> DataFrame:
    """Add relevance_score (0-100), matched_terms and risk_flags from title, summary and content."""
    text = F.trim(F.concat_ws(" ", T.text("title"), T.text("summary"), T.text("content")))
    df = df.withColumn("_whole", text).withColumn("_upper", F.upper("_whole"))
    whole, upper = F.col("_whole"), F.col("_upper")
    risks = F.concat(
        F.transform(T.unnegated(whole, L.OPPORTUNITY_EXCLUDES), lambda t: F.concat(F.lit("excluded:"), t)),
        F.transform(T.unnegated(whole, L.EDITORIAL_EXCLUDES), lambda t: F.concat(F.lit("editorial:"), t)),
    )
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t.upper()).alias("u"), F.lit(w).alias("w"), F.lit(t in terms).alias("domain"), F.lit(t in intents).alias("intent")) for t, w in (terms | intents).items()])
    df = df.withColumn("_hits", F.filter(every, lambda e: F.contains(upper, e["u"]))).withColumn("_risks", risks)
    generic = F.contains(whole, F.lit("仓储")) & ~T.any_of(upper, ("智能仓储", "仓储自动化", "立体库", "WMS", "WCS"))
    domain = F.exists("_hits", lambda e: e["domain"])
    intent = F.exists("_hits", lambda e: e["intent"] & F.contains(whole, e["t"]))
    total = F.aggregate("_hits", F.lit(0), lambda n, e: n + e["w"]) + F.when(generic, 6).otherwise(0) + F.when(domain & intent, 15).otherwise(0)
    none = F.array().cast("array<string>")
    matched = F.concat(F.transform("_hits", lambda e: e["t"]), F.when(generic, F.array(F.lit("仓储"))).otherwise(none))
    bad = F.size("_risks") > 0
    return df.withColumns({
        "relevance_score": F.when(bad, 0.0).otherwise(F.least(total, F.lit(100)).cast("double")),
        "matched_terms": F.when(bad, none).otherwise(matched),
        "risk_flags": F.when(bad, F.col("_risks")).when(~domain, F.array(F.lit("weak_warehouse_fit"))).otherwise(none),
    }).drop("_risks", "_hits", "_whole", "_upper")


def source_tier(url: Column | str, official: tuple[str, ...], authoritative: tuple[str, ...]) -> Column:
    """1 government or official, 2 authoritative, 3 other; domains match whole labels."""
    h = host(url)
    under = lambda ds: reduce(lambda a, b: a | b, [(h == d) | F.endswith(h, F.lit("." + d)) for d in ds], F.lit(False))
    return F.when(under(("gov.cn", *official)), 1).when(under(authoritative), 2).otherwise(3)


def stale_title(title: Column | str, published_ts: Column, deadline: Column, now: float, year: int) -> Column:
    """A year of the past in the title, unless published within 90 days (or tomorrow), or with a deadline that has not passed."""
    from ..functions.facts import date_ts, expired, last_year

    recent = (published_ts != 0) & (now - published_ts).between(-86400, 90 * 86400)
    live = (date_ts(deadline) > 0) & ~expired(deadline, now)
    return F.coalesce(last_year(title) < year, F.lit(False)) & ~recent & ~live

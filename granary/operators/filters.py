"""Admission rules. Each gives the first reason to drop a row, empty to keep it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import facts, urls
from ..functions import text as T
from . import classify

#: Names and aliases up to which the account filter is one expression.
ACCOUNTS = 500


def news_reject_reason(now: float, year: int, max_age_days: int = 15) -> Column:
    """After ``classify.assess``: content, future, stale, or a title of past years without a date."""
    ts = F.coalesce(F.col("published_ts"), F.lit(0.0))
    return (
        F.when(F.col("assess_reason") != "", F.col("assess_reason"))
        .when((ts != 0) & (ts > now + 86400), "future_publication")
        .when((ts != 0) & (now - ts > max_age_days * 86400), "stale_publication")
        .when((ts == 0) & (facts.last_year("title") < year), "historical_title_without_date")
        .otherwise("")
    )


def _lower(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(w.lower() for w in words if w)


def told() -> tuple[Column, Column]:
    """Title and summary, and both with the source's name, in lower case: the texts in which rules of other scopes look."""
    both = F.lower(F.concat_ws(" ", T.text("title"), T.text("summary")))
    return both, F.concat_ws(" ", both, F.lower(T.text("source_name")))


def pure_robot(both: Column) -> Column:
    return T.any_of(both, _lower(L.ROBOT)) & ~T.any_of(both, _lower(L.WAREHOUSE_CONTEXT))


def vendor_hit() -> Column:
    return T.any_of(told()[1], _lower(L.VENDORS))


def bidding_hit() -> Column:
    return T.any_of(told()[1], _lower(L.BIDDING)) | (T.text("skill_name") == "招投标")


def local_admitted(skill: Column, source: Column, accounts: tuple[str, ...] = L.LOCAL_ACCOUNTS) -> Column:
    """Intent and industry words in title and summary, fewer of them from known accounts and the local source."""
    both, _ = told()
    intent, industry = T.count_of(both, _lower(L.LOCAL_INTENT)), T.count_of(both, _lower(L.LOCAL_INDUSTRY))
    known = T.any_of(source, accounts)
    strict = (intent >= 1) & (industry >= 2)
    fallback = known & (intent >= 1) & (industry >= 1)
    prefiltered = ((skill == "本地项目") & ((intent >= 1) | (industry >= 1))) | (known & (skill != "本地项目") & ((intent >= 1) | (industry >= 2) | (vendor_hit() & (industry >= 1))))
    return strict | fallback | prefiltered


def scope_drop_reason(regions: tuple[str, ...] = (), local_exclude: tuple[str, ...] = ()) -> Column:
    """For rows that are not national: excluded word, robots without warehouse, locality, required words. Case does not matter."""
    both, whole = told()
    scope = T.text("region_scope")
    local = T.any_of(whole, _lower(regions)) & ~T.any_of(whole, _lower(local_exclude)) & local_admitted(T.text("skill_name"), T.text("source_name"))
    return (
        F.when(T.any_of(whole, _lower(L.EXCLUDE)), "excluded")
        .when(pure_robot(both) & (scope != "discover"), "pure_robot")
        .when((scope == "local") & ~local, "not_local")
        .when(T.text("skill_name").isin(*L.PREFILTERED), "")
        .when(~T.any_of(F.lower(F.concat(T.text("title"), T.text("summary"))), _lower(L.REQUIRED)), "no_required_word")
        .otherwise("")
    )


def filter_relevant(df: DataFrame, regions: tuple[str, ...] = (), local_exclude: tuple[str, ...] = ()) -> DataFrame:
    """National rows by ``assess``, others by scope rules; drop_reason is kept out of the result."""
    judged = classify.assess(df).withColumn("drop_reason", F.when(classify.is_national("region_scope"), F.col("assess_reason")).otherwise(scope_drop_reason(regions, local_exclude)))
    return judged.where("drop_reason = ''").drop("drop_reason", "assess_reason")


def should_keep() -> Column:
    return (F.col("relevance_score") >= L.KEEP_SCORE) & F.col("stage").isin(*L.KEEP_STAGES)


def too_old(now: float, stage: Column | None = None) -> Column:
    """Older than its stage's limit; undated rows are not."""
    stage = F.col("stage") if stage is None else stage
    limit = F.coalesce(*[F.when(stage == s, F.lit(d)) for s, d in L.AGE_LIMITS.items()], F.lit(L.AGE_LIMIT_ELSE))
    return (F.col("published_ts") != 0) & (F.greatest((now - F.col("published_ts")) / 86400, F.lit(0.0)) > limit)


def prefilter_reason(now: float, year: int) -> Column:
    """Candidates before research: addresses and exclusions, titles of past years, publications of past years, stale calls without a live deadline."""
    whole = F.trim(F.concat_ws(" ", T.text("title"), T.text("summary"), T.text("content")))
    ts, due = F.coalesce(F.col("published_ts"), F.lit(0.0)), facts.deadline(whole)
    told = facts.deadline(F.concat_ws(" ", T.text("summary"), T.text("content")))
    old = classify.stale_title("title", ts, told, now, year) & ~T.any_of(T.text("title"), L.VERSION_TERMS)
    stage = classify.candidate_stage("title", whole)
    return (
        F.when((urls.fetch_url("url") == "") | (F.size(T.unnegated(whole, L.OPPORTUNITY_EXCLUDES + L.EDITORIAL_EXCLUDES)) > 0), "hard_exclusion")
        .when(old, "historical_title_year")
        .when((ts != 0) & (now - ts > 365 * 86400), "old_publication")
        .when(stage.isin("PROCUREMENT", "EARLY_SIGNAL") & too_old(now, stage) & ((due == "") | facts.expired(due, now)), "stale_publication")
        .otherwise("")
    )


def ranking_reason(now: float, year: int) -> Column:
    """Why a project's latest version is not shown, before it is scored; the first reason counts."""
    ts, due = F.col("published_ts"), T.text("deadline")
    live = (due != "") & ~facts.expired(due, now)
    return (
        F.when(classify.stale_title("title", ts, due, now, year), "freshness_reject")
        .when(ts > now + 86400, "future_publication")
        .when(F.col("stage").isin("CLOSED", "AWARD") | facts.expired(due, now) | (too_old(now) & ~((F.col("stage") == "PROCUREMENT") & live)), "freshness_or_inactive_reject")
        .when((F.col("stage") != "EARLY_SIGNAL") & (ts != 0) & (now - ts > 15 * 86400) & (due == ""), "old_without_deadline")
        .when(F.col("relevance_score") < L.KEEP_SCORE, "low_relevance")
        .otherwise("")
    )


def needs_report() -> Column:
    changed = (T.text("last_reported_at") == "") | (T.text("last_digest_hash") != T.text("digest_hash"))
    return ~F.col("stage").isin("AWARD", "CLOSED") & (F.col("priority") != "DROP") & changed


def auth_failure(words: tuple[str, ...] = L.AUTH_FAILURE) -> Column:
    """The first word of a failed login in title and summary; empty if none."""
    return T.first_of(F.lower(F.concat_ws(" ", T.text("title"), T.text("summary"))), words)


def unverified() -> Column:
    """Opportunities that rest on a search excerpt or were never verified."""
    flags = ("search_excerpt_only", "search_excerpt_supports_some_fields", "original_page_unavailable")
    return T.text("verification_status").isin("preview", "unverified") | (T.text("research_mode") == "preview") | F.arrays_overlap(F.coalesce("risk_flags", F.array().cast("array<string>")), F.array(*map(F.lit, flags)))


def can_rule_fallback() -> Column:
    """Candidates that the rules may judge alone: not found by a search, or read in the original, which has their title.

    Fixed value: how sources of searches are called.
    """
    found = (T.text("discovery_method") == "ai_search") | (T.text("snippet_origin") != "") | F.startswith(T.text("source_name"), F.lit("搜索发现"))
    read = (T.text("verified_url") != "") & (T.text("content") != "") & F.contains(T.compact("content"), T.compact("title"))
    return ~found | read


def research_accepted(least: float = 60.0) -> Column:
    return F.coalesce(F.col("is_real_project") & (F.col("warehouse_relevance") >= least), F.lit(False))


def publishable(df: DataFrame, receipts: DataFrame, now: float, limit: int = 5) -> DataFrame:
    """The first ``limit`` rows, in order of ``_ord``, that are verified, need a report, were not delivered as they are, and have not expired.

    ``receipts`` (project_key, digest_hash) are acknowledged deliveries.
    """
    sent = receipts.select("project_key", F.col("digest_hash").alias("_sent")).distinct()
    open_ = df.where(~unverified() & needs_report() & ~facts.expired("deadline", now))
    unsent = open_.join(sent, (open_["project_key"] == sent["project_key"]) & (open_["digest_hash"] == sent["_sent"]), "left_anti")
    return unsent.orderBy("_ord").limit(limit)


def account_scope(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows whose source_name contains a name or alias of ``accounts`` (name, aliases array).

    Up to ``ACCOUNTS`` accounts become literals, so that the rows are only filtered. Of more, each row's substrings of a name's
    length are looked up by an equi-join; their number is bounded by the source_name, which is short. Case is ignored.
    """
    df = df.withColumn("_name_of_source", F.lower(F.trim(T.text("source_name"))))
    every = accounts.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_name")).select(F.lower("_name").alias("_name")).where("_name <> ''").distinct()
    if every.limit(ACCOUNTS + 1).count() > ACCOUNTS:
        lengths = sorted(r[0] for r in every.select(F.length("_name")).distinct().collect())  # as many as names have lengths
        places = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_name_of_source") - n + 1, F.lit(1))), lambda i: F.substr("_name_of_source", i, F.lit(n)))
        parts = F.array_distinct(F.flatten(F.array(*[F.when(F.length("_name_of_source") >= n, places(n)).otherwise(F.array().cast("array<string>")) for n in lengths])))
        hits = df.select("_name_of_source").distinct().select("_name_of_source", F.explode(parts).alias("_name")).join(every, "_name", "left_semi").select("_name_of_source").distinct()
        return df.join(hits, "_name_of_source", "left_semi").drop("_name_of_source")
    names = [r["_name"] for r in every.collect()]
    return df.where(T.any_of(F.col("_name_of_source"), names)).drop("_name_of_source")


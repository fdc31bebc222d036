"""Cross-day memory: matching with an index, carrying fields over, snapshots, replacement and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from . import filters

CARRIED = ("stage", "budget", "deadline", "technical_scope", "notice_version", "source_content_hash")
REPORTED = ("last_reported_at", "last_reported_stage", "last_digest_hash")


def page_set(*columns: str, many: str | None = None) -> Column:
    """Distinct fetchable addresses of a row."""
    single = F.array(*[urls.fetch_url(c) for c in columns])
    every = F.concat(single, F.transform(F.coalesce(many, F.array().cast("array<string>")), urls.fetch_url)) if many else single
    return F.array_distinct(F.filter(every, lambda u: u != ""))


def match(items: DataFrame, index: DataFrame) -> DataFrame:
    """(_ord, index_ord): an equal project_key wins, else the first index row with a page or title in common.

    Both sides have project_key, title, owner, city and pages (array); index rows are ordered by index_ord. Rows whose
    known owners or cities differ do not match by page or title. An index row is posted under its key, pages and title, with its owner and city and
    for any; of the rows at one place only the first counts, so an item meets as many rows as it has places and not all that share a page with it.
    """
    everyone = F.lit("*")
    named = lambda c: F.concat(F.lit("="), T.text(c))
    near = F.concat(F.array(F.concat(F.lit("title "), T.identity("title"))), F.transform(F.coalesce("pages", F.array().cast("array<string>")), lambda p: F.concat(F.lit("page "), p)))

    def places(rows: DataFrame, ordinal: str, who) -> DataFrame:  # noqa: ANN001
        """Places of rows: rank, token, owner and city; ``who`` gives the owners or cities that a row stands for."""
        by_key = rows.select(ordinal, F.lit(0).alias("rank"), F.concat(F.lit("key "), F.col("project_key")).alias("token"), everyone.alias("o"), everyone.alias("c"))
        others = rows.select(ordinal, F.lit(1).alias("rank"), F.array_distinct(near).alias("tokens"), who("owner").alias("os"), who("city").alias("cs"))
        others = others.select(ordinal, "rank", "os", "cs", F.explode("tokens").alias("token")).select(ordinal, "rank", "token", "cs", F.explode("os").alias("o")).select(ordinal, "rank", "token", "o", F.explode("cs").alias("c"))
        return by_key.unionByName(others).where("token is not null")

    asked = places(items, "_ord", lambda c: F.when(T.text(c) == "", F.array(everyone)).otherwise(F.array(F.lit("="), named(c))))
    posted = places(index, "index_ord", lambda c: F.array(everyone, named(c)))
    first = posted.groupBy("token", "o", "c").agg(F.min("index_ord").alias("index_ord"))
    found = asked.join(first, ["token", "o", "c"])
    best = found.groupBy("_ord").agg(F.min(F.struct("rank", "index_ord")).alias("m"))
    return best.select("_ord", "m.index_ord")


def apply_history(items: DataFrame, index: DataFrame, now: str) -> DataFrame:
    """Carry an index row's fields into its item: older items revert, closed projects stay closed, reports are kept.

    The order is: revert, pin, carry, compare.
    """
    old = index.select("index_ord", F.struct(*[c for c in index.columns if c != "index_ord"]).alias("old"))
    joined = items.join(match(items, index), "_ord", "left").join(old, "index_ord", "left").drop("index_ord")
    known, ts, old_ts = F.col("old").isNotNull(), F.col("published_ts"), F.col("old.published_ts")
    revert = known & (ts != 0) & (old_ts > ts)
    pin = known & F.col("old.stage").isin("AWARD", "CLOSED") & (old_ts >= ts)
    take = lambda when, c: F.when(when, F.col(f"old.{c}")).otherwise(F.col(c))
    first = lambda a, b: F.when(T.text(a) != "", F.col(a)).otherwise(F.col(b))
    out = joined.withColumns({
        "is_new": ~known, "previous_stage": F.when(known, F.col("old.stage")).otherwise(""),
        "previous_budget": F.when(known, F.col("old.budget")).otherwise(""), "previous_deadline": F.when(known, F.col("old.deadline")).otherwise(""),
        "project_key": F.when(known, first("old.project_key", "project_key")).otherwise(F.col("project_key")),
        "first_seen": F.when(known, first("old.first_seen", "first_seen")).otherwise(F.col("first_seen")),
        **{c: take(revert, c) for c in CARRIED},
        **{c: F.when(known, first(f"old.{c}", c)).otherwise(F.col(c)) for c in REPORTED},
        "last_seen": F.lit(now),
    })
    out = out.withColumns({"stage": take(pin, "stage"), "published": take(pin, "published"), "published_ts": take(pin, "published_ts")})
    own = T.material_hash(F.col("stage"), F.col("budget"), F.col("deadline"), F.col("technical_scope"), F.col("notice_version"))
    theirs = T.material_hash(*[F.col(f"old.{c}") for c in ("stage", "budget", "deadline", "technical_scope", "notice_version")])
    return out.withColumn("material_hash", own).withColumn("is_updated", known & (own != theirs)).drop("old")


def snapshot(observed: DataFrame) -> DataFrame:
    """Active rows to show today: per key the strictly highest score, first wins."""
    best = Window.partitionBy("project_key").orderBy(F.desc("final_score"), "_ord")
    return observed.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").where(~F.col("stage").isin("AWARD", "CLOSED"))


def merged_index(index: DataFrame, observed: DataFrame, stages: tuple[str, ...] = ("UNKNOWN", "EARLY_SIGNAL", "PROCUREMENT", "AWARD", "CLOSED")) -> DataFrame:
    """New index: the last observation by (time, source score, stage), then active rows unless a closing is as new."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    last = Window.partitionBy("project_key").orderBy(F.desc("published_ts"), F.desc("source_score"), place.desc(), F.desc("_ord"))
    latest = observed.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    columns = [c for c in latest.columns if c != "_ord"]
    active = snapshot(observed).select("project_key", F.struct(*columns).alias("active"))
    both = latest.join(active, "project_key", "left")
    over = F.col("active").isNotNull() & (~F.col("stage").isin("AWARD", "CLOSED") | (F.col("active.published_ts") > F.col("published_ts")))
    fresh = both.select("project_key", *[F.when(over, F.col(f"active.{c}")).otherwise(F.col(c)).alias(c) for c in columns if c != "project_key"])
    kept = index.join(fresh.select("project_key"), "project_key", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def reusable(candidates: DataFrame, index: DataFrame, now_ts: float, hours: float = 24) -> DataFrame:
    """(_ord, index_ord) of candidates whose project was verified lately from the very text that they have now.

    ``candidates``: _ord, title, url, published, content_hash, verified_url. The index row is matched by title and page alone, and must be research
    of the last ``hours`` over a page that was read, of the same notice version.
    """
    mine = candidates.select("_ord", T.project_key("title", F.lit(""), F.lit("")).alias("project_key"), "title", F.lit("").alias("owner"), F.lit("").alias("city"), page_set("url").alias("pages"))
    told = candidates.select("_ord", "content_hash", "verified_url", T.notice_version("title", "published", urls.fetch_url("url")).alias("_version"))
    x = index.where((F.col("research_mode") == "ai") & (F.col("verification_status") == "verified") & ~filters.unverified()).select("index_ord", "source_content_hash", "last_researched_ts", "notice_version")
    found = match(mine, index).join(x, "index_ord").join(told, "_ord")
    age = now_ts - F.coalesce(F.col("last_researched_ts"), F.lit(0.0))
    good = (T.text("content_hash") != "") & (T.text("verified_url") != "") & (F.col("content_hash") == F.col("source_content_hash")) & (age >= 0) & (age < hours * 3600) & (T.text("notice_version") == F.col("_version"))
    return found.where(good).select("_ord", "index_ord")


def without_rejected(items: DataFrame, feedback: DataFrame) -> DataFrame:
    """Projects that reviewers turned down go for good."""
    return items.join(feedback.where(F.col("decision").isin("reject", "irrelevant")).select("project_key").distinct(), "project_key", "left_anti")


def replaced_scope(existing: DataFrame, fresh: DataFrame, scope: str) -> DataFrame:
    """One scope of a day replaced by new rows, newest first."""
    return existing.where(F.col("region_scope") != scope).unionByName(fresh).orderBy(F.desc("published_ts"), "_ord")


def delivered(index: DataFrame, receipts: DataFrame) -> DataFrame:
    """Reported fields set from receipts (project_key, reported_at, stage, digest_hash)."""
    r = receipts.select("project_key", F.col("reported_at").alias("r_at"), F.col("stage").alias("r_stage"), F.col("digest_hash").alias("r_hash"))
    j = index.join(r, "project_key", "left")
    return j.withColumns({"last_reported_at": F.coalesce("r_at", "last_reported_at"), "last_reported_stage": F.coalesce("r_stage", "last_reported_stage"), "last_digest_hash": F.coalesce("r_hash", "last_digest_hash")}).drop("r_at", "r_stage", "r_hash")


def recent(index: DataFrame, now_ts: float, days: int = 14, limit: int = 50) -> DataFrame:
    return index.where(F.col("last_seen_ts") >= now_ts - days * 86400).orderBy(F.desc("last_seen_ts"), "project_key").limit(limit)

"""Project opportunities: built by rules, remembered, ranked; and whole research runs that a failed run resumes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import facts, urls
from ..functions import text as T
from ..operators import budgets, classify, dedup, filters, history, research, score, select, verify
from ..operators.budgets import Settings
from ..tables import Stages, scratch, stored

def build(candidates: DataFrame, now: float, include_inactive: bool = False, every: bool = False) -> DataFrame:
    """Candidate rows (title, url, summary, content, source_name, published_ts, _ord) to opportunity rows, by rules.

    Relevant rows of the kept stages come back, with ``include_inactive`` old and closed ones too; with ``every`` all do.
    """
    rated = classify.relevance(candidates).withColumn("_whole", F.trim(F.concat_ws(" ", T.text("title"), T.text("summary"), T.text("content"))))
    whole = F.col("_whole")
    out = rated.withColumns({
        "stage": classify.candidate_stage("title", whole), "project_type": classify.project_type(whole), "province": facts.province(whole), "city": facts.city(whole),
        "budget": facts.budget(whole), "deadline": facts.deadline(whole), "owner": facts.owner(whole), "source_score": score.source_score("source_name", "url"), "technical_scope": F.col("matched_terms"),
    }).drop("_whole")
    out = out.withColumns({"budget_amount": facts.amount("budget"), "urgency_score": score.urgency(now), "project_key": T.project_key("title", "owner", "city")})
    out = out.withColumn("final_score", score.rule_score())
    if every:
        return out
    if include_inactive:
        return out.where(filters.should_keep() | ((F.col("relevance_score") >= L.KEEP_SCORE) & (F.col("stage") == "CLOSED")))
    return out.where(filters.should_keep() & ~filters.too_old(now))


def rescored(items: DataFrame, now: float, profile: L.CompanyProfile = L.CompanyProfile()) -> DataFrame:
    """The five-part score with company fit, and priorities."""
    with_text = items if "verified_text" in items.columns else items.withColumn("verified_text", F.lit(""))
    parts = with_text.withColumns({"company_fit_score": score.company_fit(profile), "freshness_score": score.freshness(now), "urgency_score": score.by_stage(L.URGENCY_V2, 30).cast("double")})
    scored = parts.withColumn("final_score", score.score_v2())
    undated = (F.col("published_ts") == 0) & (T.text("deadline") == "")
    scored = scored.withColumn("final_score", score.capped(F.col("final_score"), F.lit(False), undated))
    return scored.withColumn("priority", F.when(undated & (score.priority(F.col("final_score")) != "DROP"), "WATCH").otherwise(score.priority(F.col("final_score"))))


def ranked(items: DataFrame, now: float, year: int, limit: int = 5, profile: L.CompanyProfile = L.CompanyProfile(), trusted: tuple[str, ...] = (), authoritative: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """One row a project, with drop_reason, and place if it is shown.

    ``items``: _ord, project_key, title, source_url, published_ts, deadline, budget, stage, owner, province, city, technical_scope, project_type,
    relevance_score, source_score, final_score, priority, research_mode, verification_status, risk_flags, last_reported_at,
    last_digest_hash, digest_hash. Of a project's rows the latest version counts: by time, source score and stage. Research that was
    verified keeps its scores; anything else is scored from its source's tier, and what was never verified is a preview, which is
    watched and no more. ``by`` parts runs that share a table.
    """
    key = [*by, "project_key"]
    order = F.array_position(F.array(*[F.lit(s) for s in ("UNKNOWN", "EARLY_SIGNAL", "PROCUREMENT", "AWARD", "CLOSED")]), F.col("stage"))
    version = Window.partitionBy(*key).orderBy(F.desc("published_ts"), F.desc("source_score"), order.desc(), "_ord")
    first = F.min("_ord").over(Window.partitionBy(*key))
    latest = items.withColumns({"_turn": first, "_n": F.row_number().over(version)}).where("_n = 1").drop("_n")
    latest = latest.withColumn("risk_flags", F.coalesce("risk_flags", F.array().cast("array<string>")))
    latest = latest.withColumns({"_reason": filters.ranking_reason(now, year), "_preview": filters.unverified()})
    mode = F.when(F.col("_preview"), "preview").otherwise(F.col("research_mode"))
    latest = latest.withColumns({"research_mode": mode, "verification_status": F.when(F.col("_preview"), "preview").otherwise(F.col("verification_status"))})
    own = F.col("research_mode") == "ai"
    tier = F.when(F.col("_preview"), 3).otherwise(classify.source_tier("source_url", (*verify.OFFICIAL, *trusted), authoritative))
    flagged = lambda when, name: F.when(when & ~F.array_contains("risk_flags", name), F.array_append("risk_flags", F.lit(name))).otherwise(F.col("risk_flags"))
    latest = latest.withColumn("_tier", tier).withColumn("source_score", F.when(own, F.col("source_score")).otherwise(F.coalesce(*[F.when(F.col("_tier") == k, F.lit(v)) for k, v in verify.TIER_SCORES.items()])))
    latest = latest.withColumns({"risk_flags": flagged(~own & ((F.col("_tier") != 1) | F.col("_preview")), "official_source_not_found"), "budget_amount": facts.amount("budget"), "verified_text": F.lit("")})
    latest = latest.withColumns({"company_fit_score": score.company_fit(profile), "freshness_score": score.freshness(now), "urgency_score": score.by_stage(L.URGENCY_V2, 30).cast("double")})
    latest = latest.withColumn("final_score", F.when(own, F.col("final_score")).otherwise(score.score_v2()))
    latest = latest.withColumn("priority", F.when(own, F.col("priority")).otherwise(score.priority(F.col("final_score"))))
    latest = latest.withColumn("priority", F.when(F.col("_preview"), "WATCH").otherwise(F.col("priority")))
    undated = (F.col("published_ts") == 0) & (T.text("deadline") == "")
    drop = F.when(F.col("_reason") != "", F.col("_reason")).when(F.col("priority") == "DROP", "low_priority").otherwise("")
    latest = latest.withColumns({"_reason": drop, "final_score": score.capped(F.col("final_score"), F.col("_preview"), undated), "risk_flags": flagged(undated, "published_date_not_verified")})
    latest = latest.withColumn("priority", F.when(undated & (F.col("_reason") == ""), "WATCH").otherwise(F.col("priority")))
    judged = stored(latest.withColumn("needs_report", filters.needs_report()).drop("_preview", "_tier"), scratch(items.sparkSession), "judged")  # judged once, for what is shown and what is not
    shown = select.final_ranking(judged.where("_reason = ''"), limit, by)
    out = judged.where("_reason <> ''").withColumns({"place": F.lit(None).cast("int"), "drop_reason": F.col("_reason")})
    return shown.unionByName(out).drop("_reason", "_turn")


def rules_run(candidates: DataFrame, index: DataFrame, now: float, year: int, day: str, limit: int = 5, profile: L.CompanyProfile = L.CompanyProfile()) -> DataFrame:
    """A run without research: candidates that the rules may judge, built, remembered and ranked; one row a project."""
    built = build(candidates.where(filters.can_rule_fallback()), now, include_inactive=True)
    items = stored(_fallback(built, "ai_unavailable"), scratch(candidates.sparkSession), "rules")
    return ranked(_remembered(items, index, day), now, year, limit, profile)


#: Columns of an item, with what stands where nothing is known.
ITEM = {
    "title": "''", "source_url": "''", "source_name": "''", "owner": "''", "province": "''", "city": "''", "published": "''", "published_ts": "0.0D", "deadline": "''", "budget": "''", "project_type": "'UNKNOWN'",
    "stage": "'UNKNOWN'", "relevance_score": "0.0D", "source_score": "0.0D", "final_score": "0.0D", "technical_scope": "cast(array() as array<string>)", "risk_flags": "cast(array() as array<string>)", "priority": "'WATCH'",
    "research_mode": "'rules'", "verification_status": "''", "notice_version": "''", "source_content_hash": "''", "last_researched_ts": "0.0D", "first_seen": "''", "last_reported_at": "''", "last_reported_stage": "''",
    "last_digest_hash": "''", "project_key": "''", "pages": "cast(array() as array<string>)",
}


def _as_items(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the columns of an item and ``keys``; absent columns and nulls have their defaults."""
    return df.select(*keys, *[F.coalesce(F.col(c), F.expr(d)).alias(c) if c in df.columns else F.expr(d).alias(c) for c, d in ITEM.items()])


def _fallback(built: DataFrame, flag: str) -> DataFrame:
    """Items of the rules that stand in for research."""
    address = F.when(T.text("verified_url") != "", F.col("verified_url")).otherwise(F.col("url")) if "verified_url" in built.columns else F.col("url")
    source = built.withColumn("source_url", address)
    published = F.col("published") if "published" in built.columns else F.lit("")
    marked = source.withColumns({
        "research_mode": F.lit("fallback"), "risk_flags": F.array_append("risk_flags", F.lit(flag)), "notice_version": T.notice_version("title", published, urls.fetch_url("source_url")),
        "pages": history.page_set("source_url", "url"), "source_score": score.source_score("source_name", "source_url"),
    })
    return _as_items(marked, "_ord")


def _remembered(items: DataFrame, index: DataFrame, day: str) -> DataFrame:
    return history.apply_history(items, index, day).withColumn("digest_hash", F.col("material_hash"))


def _weighed(df: DataFrame, now: float, trusted: tuple[str, ...], authoritative: tuple[str, ...]) -> DataFrame:
    at = F.when(T.text("verified_url") != "", F.col("verified_url")).otherwise(F.col("url"))
    return classify.relevance(df).withColumn("weight", score.candidate_weight(now, classify.source_tier(at, (*verify.OFFICIAL, *trusted), authoritative)))


def _scored(items: DataFrame, texts: DataFrame, by: str, now: float, profile: L.CompanyProfile) -> DataFrame:
    """Researched items with their scores; ``texts`` (``by``, verified_text) is what their sources say. A preview is watched, below the lists' upper part."""
    read = texts.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("verified_text")), " ").alias("verified_text"))  # of a queue's sources
    told = items.join(read, by, "left").withColumns({"verified_text": T.text("verified_text"), "budget_amount": facts.amount("budget")})
    parts = told.withColumns({"company_fit_score": score.company_fit(profile), "freshness_score": score.freshness(now), "urgency_score": score.by_stage(L.URGENCY_V2, 30).cast("double")})
    preview = F.col("research_mode") == "preview"
    scored = parts.withColumn("final_score", score.score_v2()).withColumn("priority", score.priority(F.col("final_score")))
    return scored.withColumns({"priority": F.when(preview, "WATCH").otherwise(F.col("priority")), "final_score": F.when(preview, F.least("final_score", F.lit(64.0))).otherwise(F.col("final_score"))})


def outcomes(answers: DataFrame, verified: DataFrame, documents: DataFrame) -> DataFrame:
    """(page, outcome, why) of landed answers (page, error, is_real_project, warehouse_relevance).

    ``item`` where the research was borne out; ``rejected`` where the answer says that it is no project for us, which nothing may overrule; else
    ``unavailable``, with the reason: an error, evidence that does not hold, or no source. ``verified`` and ``documents`` carry the page as project_key.
    """
    known = lambda df, name: df.select(F.col("project_key").alias("page")).distinct().withColumn(name, F.lit(True))
    told = answers.join(known(verified, "_proven"), "page", "left").join(known(documents, "_read"), "page", "left")
    why = (
        F.when(T.text("error") != "", "research_error").when(F.col("_read").isNull(), "source_unavailable").when(~filters.research_accepted(), "semantic_reject").when(F.col("_proven").isNull(), "verifier_reject").otherwise("")
    )
    told = told.withColumn("why", why)
    return told.select("page", F.when(F.col("why") == "", "item").when(F.col("why") == "semantic_reject", "rejected").otherwise("unavailable").alias("outcome"), "why")


def research_day(
    candidates: DataFrame, index: DataFrame, decide: Callable[[DataFrame], DataFrame], answers: DataFrame, evidence: DataFrame, documents: DataFrame, feedback: DataFrame, now: float, year: int, day: str, settings: Settings = Settings(), limit: int = 10,
    profile: L.CompanyProfile = L.CompanyProfile(), trusted: tuple[str, ...] = (), authoritative: tuple[str, ...] = (), search_failed: bool = False, folder: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One research run over landed answers: (trace, shown, index).

    ``trace``: every page among the candidates with pipeline_stage, drop_reason and project_key. ``shown``: the ranked projects, by place. ``index``: the
    memory after the run, with versions and hashes of what was researched.

    ``candidates``: _ord, title, url, summary, content, source_name, published, published_ts, discovery_method, verified_url, snippet_origin, content_hash,
    discovery_channels. ``index``: index_ord and the columns of an item. ``decide`` gives page, worth_research and score of a pool; a batch
    that does not match the pool one to one is void, and the pool's own order counts. ``answers``: page, error and what ``verify.verified_projects`` needs, of every
    candidate that may be researched; only those whose wave is reached count. ``evidence`` and ``documents`` carry the page as project_key.
    ``feedback``: project_key, decision.

    Each stage is a table in ``folder``. A run that failed is called again with the same folder and goes on behind its last whole stage.
    Candidates are parted by page and project throughout; only the pool (``settings.pool`` rows) is put in one order.
    """
    run = Stages(candidates.sparkSession, folder or scratch(candidates.sparkSession))
    paged = run("candidates", lambda: candidates.withColumns({"page": urls.fetch_url("url"), "_reason": filters.prefilter_reason(now, year)}).where("page <> ''"))
    one = lambda: dedup.longest_content(paged.where("_reason = ''").withColumn("url", F.col("page")).drop("page", "_reason"))
    pool = run("pool", lambda: _weighed(one(), now, trusted, authoritative))
    reused = run("reused", lambda: history.reusable(pool, index, now))
    pending = pool.join(reused, "_ord", "left_anti")
    filtered = run("filtered", lambda: research.prefilter_cap(pending, settings.pool))

    def queued() -> DataFrame:
        told = research.triage(filtered.withColumn("id", F.col("url")), decide(filtered).withColumnRenamed("page", "id")).withColumnRenamed("score", "triage_score").drop("id")
        if not told.take(1):
            return research.reading_order(filtered).withColumns({"worth_research": F.lit(True), "triage_score": F.lit(0.0)})
        order = Window.orderBy(F.col("worth_research").cast("int").desc(), F.desc("triage_score"), "pool_place")
        return told.withColumn("rank", F.when(F.col("worth_research"), F.row_number().over(order))).withColumn("triage_score", F.col("triage_score").cast("double"))

    queue = run("queue", queued)
    head = F.broadcast(queue.where(F.col("rank") <= settings.hard).select(F.col("url").alias("page"), "_ord", "rank", "source_name", F.col("title").alias("candidate_title"), F.col("url").alias("candidate_url"), "content_hash"))
    ours = head.select(F.col("page").alias("project_key"))
    read, told_by = (run(name, lambda df=df: df.join(ours, "project_key", "left_semi")) for name, df in (("documents", documents), ("evidence", evidence)))

    def verified() -> DataFrame:
        mine = answers.join(head, "page").where(filters.research_accepted() & (T.text("error") == "")).withColumn("project_key", F.col("page"))
        found = verify.verified_projects(mine, told_by, read, trusted, authoritative)
        attached = F.lit(False)
        if "attachment_urls" in read.columns:
            some = read.where(F.size("attachment_urls") > 0).select(F.col("project_key").alias("page")).distinct()
            found, attached = found.join(some.withColumn("_attached", F.lit(True)), "page", "left"), F.coalesce("_attached", F.lit(False))
        found = found.withColumns({
            "relevance_score": F.col("warehouse_relevance").cast("double"), "source_content_hash": F.when(attached, "").otherwise(T.text("content_hash")), "last_researched_ts": F.lit(now),
            "notice_version": T.notice_version("title", "published", urls.fetch_url("source_url")), "pages": history.page_set("source_url", "candidate_url", many="source_urls"), "project_key": T.project_key("title", "owner", "city"),
        })
        cited = found.select("page", F.explode("source_urls").alias("_u")).select("page", urls.fetch_url("_u").alias("_u")).distinct()
        texts = read.select(F.col("project_key").alias("page"), urls.fetch_url("url").alias("_u"), F.col("text").alias("verified_text")).join(cited, ["page", "_u"]).drop("_u")
        return _as_items(_scored(found, texts, "page", now, profile), "page", "_ord", "rank")

    found = run("verified", verified)
    told = run("outcomes", lambda: outcomes(answers.join(head.select("page"), "page", "left_semi"), found.select(F.col("page").alias("project_key")), read))

    def waved() -> DataFrame:
        """Waves of the queue, and before which one enough verified projects would have been shown."""
        last = -(-settings.hard // settings.wave)
        asof = found.withColumn("wave", F.explode(F.sequence((F.floor((F.col("rank") - 1) / settings.wave) + 1).cast("int"), F.lit(last)))).withColumn("digest_hash", F.lit(""))
        active = ranked(asof, now, year, settings.hard, profile, trusted, authoritative, ("wave",)).where("drop_reason = '' and research_mode = 'ai' and verification_status = 'verified'")
        good = history.without_rejected(active.where(F.col("priority").isin("A", "B") & ((F.col("published_ts") != 0) | (T.text("deadline") != ""))), feedback)
        stop = good.groupBy("wave").agg(F.count("*").alias("n")).where(F.col("n") >= settings.target).agg(F.min("wave").alias("_stop"))
        out = queue.where("worth_research").withColumn("wave", F.floor((F.col("rank") - 1) / settings.wave).cast("int")).crossJoin(F.broadcast(stop))  # one row
        reason = F.when(F.col("rank") > settings.hard, "research_hard_limit").when(F.col("wave") >= F.col("_stop"), "verified_target_met").otherwise("")
        return out.select(F.col("url").alias("page"), "_ord", "rank", "wave", reason.alias("stopped"))

    waves = run("waves", waved)
    selected = run("selected", lambda: waves.where("stopped = ''").join(told, "page", "left").select("page", "_ord", F.coalesce("outcome", F.lit("unavailable")).alias("outcome"), F.coalesce("why", F.lit("source_unavailable")).alias("why")))

    def items() -> DataFrame:
        kept = _as_items(index.join(reused, "index_ord"), "_ord")
        texts = pool.select(F.col("verified_url").alias("source_url"), F.col("content").alias("verified_text")).where(T.text("source_url") != "")
        kept = _as_items(_scored(kept, texts.join(kept.select("source_url"), "source_url", "left_semi"), "source_url", now, profile), "_ord")
        researched = _as_items(found.join(selected.where("outcome = 'item'").select("page"), "page", "left_semi"), "_ord")
        gone = selected.where("outcome = 'unavailable' and why <> 'verifier_reject'").select("_ord")
        # written first: else the rule is pushed below the join and looks at the texts of the whole pool
        lost = run("lost", lambda: pool.join(F.broadcast(gone), "_ord", "left_semi")).where(filters.can_rule_fallback())
        out = kept.unionByName(researched).unionByName(_fallback(build(lost.select(*candidates.columns), now, include_inactive=True), "research_unavailable"))
        answered = selected.where("outcome in ('item', 'rejected') or why = 'verifier_reject'").take(1)
        nothing_to_do = (not waves.take(1) or reused.take(1)) and not search_failed
        if answered or nothing_to_do or out.take(1):
            return out
        no = selected.where("outcome = 'rejected' or why = 'verifier_reject'").select("page").union(queue.where("not worth_research").select(F.col("url").alias("page")))
        rest = paged.join(no, "page", "left_anti").select(*candidates.columns).where(filters.can_rule_fallback())
        return _fallback(build(rest, now, include_inactive=True), "ai_unavailable")

    made = run("items", items)
    observed = run("observed", lambda: _remembered(made, index, day))
    final = run("ranked", lambda: ranked(observed, now, year, limit, profile, trusted, authoritative))
    turned = feedback.where(F.col("decision").isin("reject", "irrelevant")).select("project_key").distinct().withColumn("_turned", F.lit(True))
    decided = final.join(turned, "project_key", "left").withColumn("drop_reason", F.when(F.col("_turned"), "feedback_reject").otherwise(F.col("drop_reason"))).drop("_turned")

    def traced() -> DataFrame:
        """The stage that each page reached, and why it went no further; of a page's rows in the prefilter, the last one's reason."""
        mark = lambda df, stage, reason, key="''": df.selectExpr("page", f"{stage} as pipeline_stage", f"{reason} as drop_reason", f"{key} as project_key")
        at = lambda df: df.withColumn("page", F.col("url"))
        ranking = observed.select("_ord", "project_key").join(selected.where("outcome = 'item'").select("_ord", "page"), "_ord").join(decided.select("project_key", F.col("drop_reason").alias("_why")), "project_key", "left")
        layers = [
            mark(ranking, "if(_why = '', 'retained', 'ranking')", "coalesce(_why, 'ranking_duplicate_or_reject')", "project_key"),
            mark(selected.where("outcome <> 'item'"), "if(why in ('semantic_reject', 'research_error'), 'research', 'verifier')", "why"),
            mark(waves.where("stopped <> ''"), "'research_queue'", "stopped"),
            mark(at(queue.where("not worth_research")), "'triage'", "'triage_reject'"),
            mark(at(pending.join(filtered.select("_ord"), "_ord", "left_anti")), "'candidate_pool'", "'candidate_pool_limit'"),
            mark(at(pool.join(reused.select("_ord"), "_ord", "left_semi")), "'memory'", "'reused_verified_snapshot'"),
        ]  # a page is in one of them at most
        reached = layers[0]
        for layer in layers[1:]:
            reached = reached.unionByName(layer)
        pages = paged.groupBy("page").agg(F.max_by("_reason", "_ord").alias("_reason"))
        out = pages.join(reached, "page", "left")
        return out.select("page", F.coalesce("pipeline_stage", F.lit("prefilter")).alias("pipeline_stage"), F.coalesce("drop_reason", "_reason").alias("drop_reason"), F.coalesce("project_key", F.lit("")).alias("project_key"))

    def remembered() -> DataFrame:
        """The index with what was seen; new projects follow the known ones in the order in which they were seen."""
        told = ("final_score", "priority", "source_score", "risk_flags", "research_mode", "verification_status")
        scores = final.select("project_key", *[F.col(c).alias(f"_{c}") for c in told])
        seen = observed.join(scores, "project_key", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in told}).select(*[c for c in ITEM if c != "pages"], "pages", "last_seen", "_ord", F.col("_ord").alias("_seen"))
        places = index.select("project_key", F.col("index_ord").alias("_known"))
        end = index.agg(F.coalesce(F.max("index_ord"), F.lit(-1)).alias("_end"))
        merged = history.merged_index(index.withColumn("_seen", F.lit(None).cast("long")), seen).drop("index_ord").join(places, "project_key", "left").crossJoin(F.broadcast(end))  # one row
        return merged.withColumn("index_ord", F.coalesce("_known", F.col("_end") + 1 + F.col("_seen"))).drop("_known", "_end", "_seen")

    trace, after = run("trace", traced), run("index", remembered)
    return trace, decided.where("drop_reason = ''").orderBy("place"), after

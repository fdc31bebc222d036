"""Sources over landed payloads: search results as JSON, feeds, listing pages and stored snapshots.

Nothing is fetched here. A landed row holds the payload of one request with what was asked (source, url, query); the
readers turn it into article rows, ``_ord`` numbering them in a stable order.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import reduce
from html import unescape

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, facts, urls
from ..functions import text as T
from ..operators import classify, score
from . import pages

ARTICLE = "title string, url string, summary string, source_name string, source_kind string, source_group string, skill_name string, region_scope string, published string, published_ts double, image_url string"
_RESULT = "struct<data:array<struct<title:string,share_url:string,source_url:string,abstract:string,media_name:string,large_image_url:string,image_url:string,datetime:string,publish_time:string>>>"


def ordinal(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``_ord``, a 64-bit key that sorts as ``order`` does within a landing and needs no single task.

    Rows are range-partitioned by the order; the ordinal is the partition number and the place in it.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_ord", F.monotonically_increasing_id())


def search_results(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON search responses to articles; entries without title or address go."""
    first = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c])
    rows = landed.withColumn("_r", F.from_json(payload, _RESULT)).select("*", F.posexplode("_r.data").alias("_i", "_d"))
    out = rows.select(
        *[c for c in landed.columns if c != payload], "_i", T.clean_title("_d.title").alias("title"), first("_d.share_url", "_d.source_url").alias("url"), T.summary("_d.abstract").alias("summary"),
        T.text("_d.media_name").alias("source_name"), F.coalesce(first("_d.large_image_url", "_d.image_url"), F.lit("")).alias("image_url"), F.substring(T.text("_d.datetime"), 1, 16).alias("published"),
        F.coalesce(F.expr("try_cast(_d.publish_time as double)"), F.lit(0.0)).alias("published_ts"),
    )
    return out.where("title <> '' and url is not null")


def _text(node: ET.Element | None) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def feed_entries(payload: str, most: int = 120) -> list[dict]:
    """Entries of an RSS or Atom document; the time of change never stands in for the time of publication."""
    try:
        root = ET.fromstring(payload.strip())
    except ET.ParseError:
        return []
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""
    out = []
    for item in [n for n in root.iter() if n.tag in ("item", "entry")][:most]:
        children = {n.tag: n for n in reversed(list(item))}
        links = [n for n in item if n.tag == "link"]
        link = next((n.get("href") for n in links if n.get("href") and n.get("rel", "alternate") == "alternate"), None) or _text(children.get("link"))
        body = "".join(next((children[k].itertext() for k in ("description", "summary", "encoded", "content") if k in children and _text(children[k])), ()))
        media = next((n.get("url") for n in item if n.tag in ("thumbnail", "enclosure") and n.get("url")), None) or (re.search(r"<img[^>]+src=[\"']([^\"']+)", body) or ["", ""])[1]
        date = next((_text(children[k]) for k in ("pubdate", "published", "date", "issued") if k in children), "")
        out.append({"title": unescape(_text(children.get("title"))), "url": link.strip(), "summary": body, "published": date, "updated": next((_text(children[k]) for k in ("updated", "modified") if k in children), ""), "image_url": media})
    return out


def feeds(landed: DataFrame, pattern: str = "") -> DataFrame:
    """(source, url, payload) to entries: as a feed, else as a listing page. Adds source, feed_url, position, published_ts and label.

    ``pattern`` holds for all listings, unless the landing has a column ``pattern`` of its own.
    """

    def read(url: str | None, payload: str | None, own: str | None) -> list[tuple]:
        found = [e | {"dates": [e["published"]]} for e in feed_entries(payload or "")] or pages.listing(url or "", payload, own or "")
        return [(i, e["title"], pages.joined(url or "", e["url"]) or e["url"], e["summary"], e["dates"], e["image_url"], e.get("updated", "")) for i, e in enumerate(found)]

    raw = landed.select(F.to_json(F.struct("source", "url")).alias("_key"), "url", "payload", F.col("pattern") if "pattern" in landed.columns else F.lit(pattern).alias("pattern"))
    rows = pages._read(raw, ["_key", "url", "payload", "pattern"], read, f"position int, {pages.ENTRY}, updated string")
    key = F.from_json("_key", "struct<source:string,url:string>")
    dated = dates.unique_date(F.transform("dates", _plain_date))
    out = rows.withColumn("_d", dated)
    return out.select(key["source"].alias("source"), key["url"].alias("feed_url"), "position", T.clean_text(T.clean_title("title")).alias("title"), "url", T.summary("summary").alias("summary"), F.col("_d.label").alias("published"), "image_url", F.col("_d.ts").alias("published_ts"), dates.news_date(_plain_date(F.col("updated")))["ts"].alias("updated_ts"))


def _plain_date(c: Column) -> Column:
    """Dates of mail headers brought into the form that ``dates`` reads."""
    part = lambda n: F.regexp_extract(c, "(\\d{1,2}) ([A-Za-z]{3})[a-z]* (\\d{4})(?: (\\d{2}:\\d{2}(?::\\d{2})?))?(?: (GMT|UTC|Z|[+-]\\d{4}))?", n)
    month = F.array_position(F.array(*map(F.lit, dates.MONTHS)), F.lower(part(2))).cast("string")
    zone = F.when(part(5).isin("GMT", "UTC", "Z"), "Z").otherwise(part(5))
    return F.when(part(3) == "", c).otherwise(F.concat_ws("", part(3), F.lit("-"), month, F.lit("-"), part(1), F.when(part(4) != "", F.concat(F.lit("T"), part(4), zone))))


def _none() -> Column:
    return F.array().cast("array<string>")


def feed_articles(entries: DataFrame, specs: DataFrame, now: float, count: int | None = None) -> DataFrame:
    """Entries to articles by feed specs (``specs.feed_table``): word filters, then the best of each feed by quality.

    Words match without regard to case. Publisher, kind and group hold only for entries under the feed's own domain; others carry
    their domain as name. ``count`` bounds each feed's rows further.
    """
    joined = entries.join(specs.drop("position"), ["source", "feed_url"])
    both = F.lower(F.concat_ws(" ", "title", "summary"))
    hits = lambda words: F.exists(F.coalesce(words, _none()), lambda w: F.contains(both, F.lower(w)))
    kept = joined.where((F.col("title") != "") & F.col("url").rlike("^https?://") & ~hits(F.col("exclude")) & ((F.size(F.coalesce("include", _none())) == 0) | hits(F.col("include"))))
    domain = urls.source_domain("url")
    own = domain == urls.source_domain("feed_url")
    out = kept.withColumns({
        "source_kind": F.when(own, F.col("kind")).otherwise(""), "source_group": F.when(own, F.col("group")).otherwise(""), "source_name": F.when(own, F.col("publisher")).otherwise(domain),
        "skill_name": F.col("source"), "collection_url": F.col("feed_url"),
    })
    rated = classify.annotate(out).withColumn("quality_score", score.national_quality(now))
    best = Window.partitionBy("source", "feed_url").orderBy(F.desc("quality_score"), "position")
    most = F.col("per_feed") if count is None else F.least(F.col("per_feed"), F.lit(count))
    return rated.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most).drop("_n", "include", "exclude", "kind", "group", "per_feed", "pattern", "publisher")


def enriched(articles: DataFrame, details: DataFrame, most: int = 4) -> DataFrame:
    """Articles with date, summary and picture taken from their own page, for at most ``most`` relevant rows of each listing that lack a date or a summary.

    ``details`` is ``pages.page_metadata`` of landed article pages, with their url.
    """
    lacking = (F.col("relevance_score") >= 0.38) & ((F.col("published_ts") == 0) | (T.text("summary") == ""))
    turn = Window.partitionBy("collection_url").orderBy(F.desc("quality_score"), "position")
    marked = articles.withColumn("_lacks", lacking)
    chosen = marked.where("_lacks").withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= most).select("collection_url", "position", F.lit(True).alias("_chosen"))
    d = details.select("url", F.col("summary").alias("_summary"), F.col("published_ts").alias("_ts"), F.col("published").alias("_published"), F.col("image_url").alias("_image")).dropDuplicates(["url"])
    out = marked.join(chosen, ["collection_url", "position"], "left").join(d, "url", "left")
    use = F.coalesce("_chosen", F.lit(False))
    undated = use & (F.col("published_ts") == 0) & (F.coalesce("_ts", F.lit(0.0)) != 0)
    return out.withColumns({
        "published": F.when(undated, F.col("_published")).otherwise(F.col("published")), "summary": F.when(use & (T.text("summary") == ""), T.summary("_summary")).otherwise(F.col("summary")),
        "image_url": F.when(use & (T.text("image_url") == ""), T.text("_image")).otherwise(F.col("image_url")), "published_ts": F.when(undated, F.col("_ts")).otherwise(F.col("published_ts")),
    }).drop("_lacks", "_chosen", "_summary", "_ts", "_published", "_image")


def feed_reports(landed: DataFrame, entries: DataFrame, articles: DataFrame) -> DataFrame:
    """One row a feed of the landing (source, url, payload, status): parsed, returned and a status that tells why nothing came."""
    parsed = entries.groupBy("source", "feed_url").agg(F.count("*").alias("parsed"))
    returned = articles.groupBy(F.col("skill_name").alias("source"), F.col("collection_url").alias("feed_url")).agg(F.count("*").alias("returned"))
    rows = landed.select("source", F.col("url").alias("feed_url"), "status", T.any_of(T.text("payload"), ("v-for", "{{")).alias("_dynamic"))
    rows = rows.join(parsed, ["source", "feed_url"], "left").join(returned, ["source", "feed_url"], "left").withColumns({"parsed": F.coalesce("parsed", F.lit(0)), "returned": F.coalesce("returned", F.lit(0))})
    told = F.when(F.col("status").isNull(), "timeout").when(F.col("status") != 200, F.concat(F.lit("http_"), F.col("status").cast("string"))).when((F.col("parsed") == 0) & F.col("_dynamic"), "dynamic_page_unparsed").when(F.col("parsed") == 0, "no_article_links").when(F.col("returned") == 0, "keyword_filtered_empty").otherwise("ok")
    return rows.select("source", "feed_url", "parsed", "returned", told.alias("status"))


def keyword_search(landed: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), prefix: str = "", kind: str = "aggregator") -> DataFrame:
    """``search_results`` within a source: rows with an excluded word go, then rows without an included one; sources get a prefix."""
    rows = search_results(landed)
    both = F.lower(F.concat_ws(" ", "title", "summary"))
    words = lambda ws: T.any_of(both, [w.lower() for w in ws])
    kept = rows.where(~words(exclude) & (words(include) if include else F.lit(True)))
    named = F.regexp_replace(F.concat(F.lit(f"{prefix}/"), F.col("source_name")), "^/+|/+$", "") if prefix else F.col("source_name")
    return kept.withColumns({"source_name": named, "source_kind": F.lit(kind)})


def first_wins(parts: list[DataFrame], skill: str, scope: str = "national") -> DataFrame:
    """Layers of one source together, earlier layers first: one row an address, with the source's name and scope. Each layer has ``_ord``."""
    every = union([p.withColumn("_layer", F.lit(i)) for i, p in enumerate(parts)]).where(T.text("url") != "")
    first = Window.partitionBy("url").orderBy("_layer", "_ord")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumns({"skill_name": F.lit(skill), "region_scope": F.lit(scope)})


def organizer_news(landed: DataFrame, now: float | None = None, most: int = 12) -> DataFrame:
    """The organizer's endpoint (key, payload): rows of valid answers with a numeric id that are relevant news."""
    row = "struct<id:string,wzmc:string,addtime:string,wznr:string>"
    answer = F.from_json("payload", f"struct<code:string,data:struct<zslist:array<{row}>>>")
    rows = landed.withColumn("_a", answer).where("_a.code = '001'").select("key", F.posexplode(F.slice("_a.data.zslist", 1, most)).alias("position", "_r"))
    when = dates.news_date(F.col("_r.addtime"))
    image = F.when(T.text("_r.wznr").rlike("^https?://"), F.col("_r.wznr")).when(T.text("_r.wznr") != "", F.concat(F.lit("https://www.chinalet.cn/"), F.regexp_replace("_r.wznr", "^/+", ""))).otherwise("")
    out = rows.where(F.col("_r.id").rlike("^[0-9]+$")).select(
        "key", "position", T.clean_text("_r.wzmc").alias("title"), F.concat(F.lit("https://www.chinalet.cn/home/news_x.html?id="), F.col("_r.id")).alias("url"), F.lit("").alias("summary"), F.lit("LET展会官网").alias("source_name"),
        F.lit("organizer").alias("source_kind"), F.lit("").alias("source_group"), F.lit("展会主办方").alias("skill_name"), F.lit("national").alias("region_scope"), when["ts"].alias("published_ts"), when["label"].alias("published"), image.alias("image_url"),
    )
    return classify.annotate(out.where("title <> ''")).where("assess_reason = ''")


def account_feed(entries: DataFrame, accounts: DataFrame, words: tuple[str, ...], most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(articles, failed) of account feeds: the first ``most`` entries of each account (name, scopes, rss_url), one account a name and address.

    Accounts of the local scope give local rows. Entries that tell of a failed login are no articles. An entry without a time of
    publication has that of its change, which other feeds refuse: ``updated_ts`` if the entries have it.
    """
    known = accounts.where(T.text("rss_url") != "").groupBy("name", "rss_url").agg(F.flatten(F.collect_set("scopes")).alias("scopes"))
    rows = entries.where(F.col("position") < most).join(known, (entries["source"] == known["name"]) & (entries["feed_url"] == known["rss_url"])).drop("name", "rss_url")
    local = F.array_contains("scopes", "local")
    hit = T.first_of(F.lower(F.concat_ws(" ", T.text("title"), T.text("summary"))), words)
    rows = rows.where("title <> '' and url <> ''").withColumns({"source_name": F.col("source"), "skill_name": F.lit("公众号RSS"), "region_scope": F.when(local, "local").otherwise("wechat"), "wechat_category": F.when(local, "local").otherwise("industry"), "_hit": hit}).drop("scopes")
    if "updated_ts" in entries.columns:
        rows = rows.withColumn("published_ts", F.when(F.col("published_ts") != 0, F.col("published_ts")).otherwise(F.coalesce("updated_ts", F.lit(0.0))))
    return rows.where("_hit = ''").drop("_hit"), rows.where("_hit <> ''").select("source", "title", F.col("_hit").alias("keyword"))


def recent_candidates(snapshots: DataFrame, days: int = 3) -> DataFrame:
    """Rows of the last ``days`` stored days as candidates of opportunities, with the fields that candidates know."""
    last = snapshots.select("day").distinct().orderBy(F.desc("day")).limit(days)
    rows = snapshots.join(F.broadcast(last), "day", "left_semi").where((T.text("title") != "") & (T.text("url") != ""))
    return rows.select("day", *[T.text(c).alias(c) for c in ("title", "url", "summary", "source_name", "published")], F.coalesce("published_ts", F.lit(0.0)).alias("published_ts"), F.lit("existing").alias("discovery_method"), F.array(F.lit("existing_source")).alias("discovery_channels"))


def enriched_candidates(candidates: DataFrame, documents: DataFrame, most: int = 60, least: float = 25.0) -> DataFrame:
    """Candidates (_ord, title, url, summary, published, ...) with the text of their page, for the first ``most`` that are relevant enough.

    ``documents`` is ``pages.page_documents``, with failures. A read page gives content (8,000 characters), verified_url, the date that
    its body or metadata states, a content hash unless it has attachments or flags, and a summary where there was none.
    """
    rated = classify.relevance(candidates)
    chosen = rated.where(F.col("relevance_score") >= least).orderBy("_ord").limit(most).select("_ord", F.lit(True).alias("_chosen"))
    docs = documents.where(F.col("text").isNotNull()).select(urls.fetch_url("url").alias("_page"), F.col("text").alias("_text"), (F.size("attachment_urls") + F.size("risk_flags")).alias("_odd")).where("_page <> ''")
    docs = docs.groupBy("_page").agg(F.min(F.struct("_text", "_odd")).alias("_doc"))
    rows = candidates.join(F.broadcast(chosen), "_ord", "left").withColumn("_page", F.when(F.col("_chosen"), urls.fetch_url("url"))).join(docs, "_page", "left")
    body = F.col("_doc._text")

    def dated(text: Column) -> Column:
        meta = F.when(F.contains(T.text(text), F.lit("[网页发布元数据]")), F.regexp_extract(F.substring(text, 1, 600), "(20\\d{2}[-/.]\\d{1,2}[-/.]\\d{1,2})", 1)).otherwise("")
        found = T._let(dates.body_publication(text), lambda s: F.when(s != "", s).otherwise(meta))
        return T._let(found, lambda p: F.struct(p.alias("published"), facts.date_ts(p).alias("ts")))

    told = rows.withColumns({"_told": dated(body), "_read": body.isNotNull()})
    read, new = F.col("_read"), F.col("_read") & (F.col("_told.ts") != 0)
    old = lambda c, v: F.col(c) if c in candidates.columns else F.lit(v)
    return told.withColumns({
        "content": F.when(read, F.substring(body, 1, 8000)).otherwise(old("content", "")), "verified_url": F.when(read, F.col("_page")).otherwise(old("verified_url", "")),
        "content_hash": F.when(read & (F.col("_doc._odd") == 0), T.signature(body)).when(read, "").otherwise(old("content_hash", "")),
        "published": F.when(new, F.col("_told.published")).otherwise(F.col("published")), "published_ts": F.when(new, F.col("_told.ts")).otherwise(F.col("published_ts")),
        "summary": F.when(read & (T.text("summary") == ""), F.concat(F.substring(body, 1, 260), F.when(F.length(body) > 260, "…").otherwise(""))).otherwise(F.col("summary")),
    }).drop("_chosen", "_page", "_doc", "_told", "_read")


def page_links(html_pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", pattern: str = "") -> DataFrame:
    """Listing entries of each page: key, position, title, url, summary, image_url, published_ts and published."""
    rows = pages._read(html_pages, [key, url, html], lambda u, h: [(i, e["title"], e["url"], e["summary"], e["dates"], e["image_url"]) for i, e in enumerate(pages.listing(u or "", h, pattern))], f"position int, {pages.ENTRY}")
    return rows.withColumn("_d", dates.unique_date(F.col("dates"))).select(key, "position", "title", "url", "summary", "image_url", F.col("_d.ts").alias("published_ts"), F.col("_d.label").alias("published"))


def union(sources: list[DataFrame]) -> DataFrame:
    """All sources together, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def account_health(entries: DataFrame, words: tuple[str, ...], least: int = 5) -> DataFrame:
    """Per source: good rows, rows that tell of a failed login, and whether to alert."""
    failed = T.first_of(F.lower(F.concat_ws(" ", T.text("title"), T.text("summary"))), words) != ""
    out = entries.groupBy("source").agg(F.count_if(~failed).alias("n_good"), F.count_if(failed).alias("n_failed"), F.max(F.when(F.col("published_ts") > 0, F.col("published_ts"))).alias("newest_ts"))
    return out.withColumn("alert", (F.col("n_failed") > 0) & (F.col("n_good") < least)).withColumn("newest_ts", F.coalesce("newest_ts", F.lit(0.0)))


def strict_day(day: str) -> str:
    """The day, if it is one written yyyy-MM-dd; raises ValueError."""
    from datetime import date

    if len(day) != 10 or date.fromisoformat(day).isoformat() != day:
        raise ValueError("a day is written yyyy-MM-dd")
    return day


def snapshot(spark: SparkSession, path: str, day: str | None = None, schema: str = f"{ARTICLE}, day date") -> DataFrame:
    """A stored day, or all; missing columns of older days are null. Where nothing has been stored, no rows of ``schema``."""
    if day:
        strict_day(day)
    try:
        df = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return df.where(F.col("day") == day) if day else df

"""From landed sources to candidates of opportunities: official lists, searches, stored days, and what searching models return."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..sources import landed, pages
from ..tables import scratch, stored

# Hosts whose notices a search engine is asked for, and how such sources are called.
OFFICIAL_HOSTS = ("ccgp.gov.cn", "ggzy.gov.cn", "cebpubservice.com")
FOUND, FOUND_OFFICIAL, EXCERPT = "搜索发现", "搜索发现/官方公告", "existing_search"
_ITEM = "struct<data:array<struct<title:string,share_url:string,source_url:string,abstract:string,media_name:string,datetime:string,publish_time:string>>>"
CANDIDATE = {
    "title": "''", "url": "''", "summary": "''", "source_name": "''", "published": "''", "published_ts": "0.0D", "content": "''", "discovery_method": "'existing'", "verified_url": "''", "snippet_origin": "''", "content_hash": "''",
    "discovery_channels": "cast(array() as array<string>)",
}


def as_candidates(df: DataFrame, *keys: str) -> DataFrame:
    """The columns of a candidate, and ``keys``; absent ones and nulls have their defaults."""
    return df.select(*keys, *[F.coalesce(F.col(c), F.expr(d)).alias(c) if c in df.columns else F.expr(d).alias(c) for c, d in CANDIDATE.items()])


def news_search(answers: DataFrame, most: int = 15) -> DataFrame:
    """Landed answers of the news search (query_no, payload) to candidates, with query_no and position."""
    rows = answers.withColumn("_r", F.from_json("payload", _ITEM)).select("query_no", F.posexplode(F.slice("_r.data", 1, most)).alias("position", "d"))
    first = F.coalesce(F.nullif(F.trim("d.share_url"), F.lit("")), F.trim("d.source_url"))
    name = F.concat(F.lit(f"{FOUND}/"), F.trim(T.text("d.media_name")))
    out = rows.select(
        "query_no", "position", F.trim(T.text("d.title")).alias("title"), T.text(first).alias("url"), F.trim(T.text("d.abstract")).alias("summary"), F.regexp_replace(name, "/+$", "").alias("source_name"),
        F.substring(T.text("d.datetime"), 1, 16).alias("published"), F.coalesce(F.expr("try_cast(d.publish_time as double)"), F.lit(0.0)).alias("published_ts"),
    )
    return out.where("title <> '' and url <> ''")


def official_search(landed_pages: DataFrame, most: int = 10) -> DataFrame:
    """Landed result pages of the engine (query_no, html): results under official hosts, with query_no and position."""

    def read(html: str | None) -> list[tuple]:
        out = []
        for block in re.findall(r'<li class="b_algo".*?</li>', html or "", re.I | re.S):
            head = re.search(r'<h2>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', block, re.I | re.S)
            if not head:
                continue
            url, said = unescape(head[1]).strip(), re.search(r"<p>(.*?)</p>", block, re.I | re.S)
            title = " ".join(re.sub(r"<[^>]+>", "", unescape(head[2])).split())
            if title:
                out.append((len(out), title, url, " ".join(re.sub(r"<[^>]+>", " ", unescape(said[1])).split()) if said else ""))
        return out

    rows = pages._read(landed_pages.select("query_no", "html"), ["query_no", "html"], read, "position int, title string, url string, summary string")
    hosts = F.filter(F.array(*map(F.lit, OFFICIAL_HOSTS)), lambda d: (urls.host("url") == d) | F.endswith(urls.host("url"), F.concat(F.lit("."), d)))
    ours = rows.where(F.size(hosts) > 0)
    place = F.row_number().over(landed.Window.partitionBy("query_no").orderBy("position"))
    return ours.withColumn("_n", place).where(F.col("_n") <= most).drop("_n").withColumns({"source_name": F.lit(FOUND_OFFICIAL), "snippet_origin": F.lit(EXCERPT)})


def gathered(official: DataFrame, news: DataFrame, engine: DataFrame, stored_days: DataFrame, documents: DataFrame, days: int = 3, most: int = 60) -> DataFrame:
    """All candidates of a run, numbered in order and read where they are plausible.

    ``official``: ``pages.official_candidates``. ``news`` and ``engine``: landed answers by query_no. ``stored_days``: news as ``api`` stores it, of which the
    last ``days`` count. ``documents``: ``pages.page_documents`` of what was read. The order is: official lists, then each query's news and official results,
    then stored days, newest first. A source that has not landed is an empty frame.
    """
    layer = lambda df, n, a, b, c: as_candidates(df.withColumns({"_layer": F.lit(n), "_a": a.cast("double"), "_b": b.cast("double"), "_c": c.cast("string")}), "_layer", "_a", "_b", "_c")
    none = F.lit("")
    kept = landed.recent_candidates(stored_days, days)
    parts = [
        layer(official, 0, F.col("page_id"), F.col("position"), none),
        layer(news_search(news), 1, F.col("query_no"), F.col("position"), none),
        layer(official_search(engine), 1, F.col("query_no") + 0.5, F.col("position"), none),
        layer(kept, 2, -F.unix_timestamp(F.col("day").cast("timestamp")), -F.col("published_ts"), F.col("url")),
    ]
    numbered = landed.ordinal(landed.union(parts), "_layer", "_a", "_b", "_c", "url", "title").drop("_layer", "_a", "_b", "_c")
    return landed.enriched_candidates(stored(numbered, scratch(official.sparkSession), "candidates"), documents, most)


def native_candidates(answers: DataFrame) -> DataFrame:
    """Answers of a searching model (answer, candidates, sources) to candidates: those that it lists, then what its search tool returned besides.

    ``candidates``: array<struct<title, url, summary>>; ``sources``: array<struct<url, title, snippet, origin>>. A source is left out if a candidate has
    its address. All candidates of an answer carry its sources.
    """
    known = F.transform("candidates", lambda c: urls.fetch_url(c["url"]))
    own = F.transform("candidates", lambda c: F.struct(T.text(c["title"]).alias("title"), T.text(c["url"]).alias("url"), T.text(c["summary"]).alias("summary"), F.col("sources").alias("search_sources")))
    more = lambda known: F.transform(
        F.filter("sources", lambda s: ~F.array_contains(known, s["url"])),
        lambda s: F.struct(F.when(T.text(s["title"]) != "", s["title"]).otherwise(s["url"]).alias("title"), s["url"].alias("url"), F.lit("").alias("summary"), F.array(s).alias("search_sources")),
    )
    rows = answers.withColumn("_known", known).select("answer", F.posexplode(F.concat(own, more(F.col("_known")))).alias("position", "c"))
    return rows.select("answer", "position", "c.*", F.lit("ai_search").alias("discovery_method"))


def source_lookups(candidates: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """(page, query, position, url, title) of what was found for each candidate (page, title): the first ``most`` landed results (query, position, url,
    title) of its quoted-title query, one an address but for a closing slash."""
    from ..operators import research

    asked = candidates.select("page", research.lookup_query("title").alias("query")).hint("merge")  # like texts make small files, which look fit for a broadcast
    found = research.found_sources(results.withColumnRenamed("query", "project_key"), most).withColumnRenamed("project_key", "query")
    return asked.join(found, "query").select("page", "query", "position", "url", "title")

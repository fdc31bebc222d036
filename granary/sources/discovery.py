"""Sources of answers, videos, accounts and search engines over landed pages, and the resolution of their addresses.

A cascade takes, per search, the first of its ways that gives rows. All ways are read from what has been landed; a search that
gives nothing anywhere still gives one placeholder, so that its page is never empty. Nulls read as empty pages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import parse_qs, unquote, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..tables import scratch, stored
from .dom import split
from .pages import _read

# Markers of pages, addresses and texts.
BLOCKED = ("antispider", "verify", "captcha", "验证", "频繁")
UNPARSED = "未解析到结构化条目"
VOLATILE = frozenset("src scene timestamp ver signature new srcid token lang from clicktime enterid".split())
ACCOUNT_SITE, SEARCH_SITE, ANSWER_SITE = "mp.weixin.qq.com", "https://weixin.sogou.com", "https://www.zhihu.com"
ROW = "position int, title string, url string, summary string, image_url string"


def blocked_page(html: Column | str, url: Column | str) -> Column:
    """A page that asks whether a robot reads it."""
    return F.contains(F.lower(T.text(url)), F.lit(BLOCKED[0])) | T.any_of(F.lower(T.text(html)), BLOCKED)


def placeholder() -> Column:
    """Rows that only lead to a search."""
    title = F.trim(T.text("title"))
    return F.startswith(title, F.lit("知乎搜索：")) | F.startswith(title, F.lit("B站搜索：")) | F.contains(F.trim(T.text("summary")), F.lit(UNPARSED))


def source_key() -> Column:
    """zhihu, bilibili or other, from the names of skill and source."""
    both = F.lower(F.concat_ws(" ", T.text("skill_name"), T.text("source_name")))
    return F.when(T.any_of(both, ("知乎", "zhihu")), "zhihu").when(T.any_of(both, ("b站", "bilibili")), "bilibili").otherwise("other")


def web_address(url: Column, kind: Column | str = "", ident: Column | str = "", question: Column | str = "") -> Column:
    """Address of an answer, article or question that a reader can open; interface addresses are turned into it."""
    lit = lambda c: F.trim(T.text(F.lit(c) if isinstance(c, str) else c))
    raw, kind, ident, question = F.trim(T.text(url)), F.lower(lit(kind)), lit(ident), lit(question)
    u = F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).when(F.startswith(raw, F.lit("/")), F.concat(F.lit(ANSWER_SITE), raw)).otherwise(raw)
    digits = lambda c: c.rlike("^[0-9]+$")
    api = lambda name: F.regexp_extract(u, f"/api/v4/{name}/(\\d+)", 1)
    web = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    site = ANSWER_SITE
    return (
        F.when(api("questions") != "", web(f"{site}/question/", api("questions")))
        .when(api("articles") != "", web("https://zhuanlan.zhihu.com/p/", api("articles")))
        .when((api("answers") != "") & digits(question), web(f"{site}/question/", question, "/answer/", api("answers")))
        .when(api("answers") != "", web(f"{site}/answer/", api("answers")))
        .when(T.any_of(u, ("zhihu.com/question/", "zhuanlan.zhihu.com/p/", "zhihu.com/p/", "zhihu.com/answer/")), u)
        .when((kind == "answer") & digits(question) & digits(ident), web(f"{site}/question/", question, "/answer/", ident))
        .when((kind == "answer") & digits(question), web(f"{site}/question/", question))
        .when((kind == "answer") & digits(ident), web(f"{site}/answer/", ident))
        .when(kind.isin("article", "zhuanlan") & digits(ident), web("https://zhuanlan.zhihu.com/p/", ident))
        .when(digits(ident), web(f"{site}/question/", ident))
        .otherwise("")
    )


def target_address(target: Column) -> Column:
    """``web_address`` of a search result's object: struct<url, type, id, question:struct<id>, answer:struct<id>>."""
    return web_address(target["url"], target["type"], target["id"], target["question"]["id"])


def plain_address(raw: str | None) -> str:
    """An address as scripts and markup write it, undone. Entities are not decoded as a whole: ``&times`` would eat ``&timestamp``."""
    out = (raw or "").strip().strip("\"'")
    for a, b in (("&amp;", "&"), ("&#38;", "&"), ("&quot;", '"'), ("&#34;", '"'), ("\\/", "/"), ("\\x26", "&"), ("\\u0026", "&"), ("×tamp", "&timestamp")):
        out = out.replace(a, b)
    return out


def account_links(text: str) -> list[str]:
    return [plain_address(m) for m in re.findall(r"https?:\\/\\/mp\.weixin\.qq\.com\\/s\?[^\"'<>\s]+", text) + re.findall(r"https?://mp\.weixin\.qq\.com/s\?[^\"'<>\s]+", text)]


def script_target(text: str | None) -> str:
    """Where a page's script leads: an address put together piece by piece, a direct jump, a jump to a variable, or a link in the page."""
    text = text or ""
    joined = plain_address("".join(re.findall(r"url\s*\+=\s*'([^']*)'", text)))
    if joined.startswith("http"):
        return joined
    jump = r"(?:window\.)?location\.(?:replace\(\s*|href\s*=\s*)"
    for m in re.finditer(jump + r"(?:'([^']+)'|\"([^\"]+)\")", text):
        if (found := plain_address(m[1] or m[2])).startswith("http"):
            return found
    values: dict[str, str] = {}
    for statement in re.split(r"[;\n]", text):
        if m := re.match(r"\s*(?:var\s+|let\s+|const\s+)?([A-Za-z_]\w*)\s*(\+?=)\s*(?:(['\"])(.*?)\3|([A-Za-z_]\w*))\s*$", statement, re.S):
            value = plain_address(m[4]) if m[3] else values.get(m[5], "")
            values[m[1]] = values.get(m[1], "") + value if m[2] == "+=" else value
    for m in re.finditer(jump + r"([A-Za-z_]\w*)", text):
        if (found := values.get(m[1], "")).startswith("http"):
            return found
    return next(iter(account_links(text)), "")


def _meta_target(text: str | None) -> list[str]:
    """og:url and msg_link of a page."""
    text = text or ""
    patterns = (r'<meta[^>]+property=["\']og:url["\'][^>]+content=["\']([^"\']+)["\']', r'<meta[^>]+content=["\']([^"\']+)["\'][^>]+property=["\']og:url["\']', r"msg_link\s*=\s*[\"']([^\"']+)[\"']")
    return [plain_address(m[1]) for p in patterns if (m := re.search(p, text, re.I))]


def lasting_address(raw: str | None) -> tuple[str, str]:
    """(address, form) of an account's article: strict with account and message, else loose without what changes, else none."""
    parts = split(plain_address(raw))
    if parts is None or ACCOUNT_SITE not in parts.netloc or not parts.path.startswith("/s"):
        return "", "none"
    query = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    if query.get("__biz") and query.get("mid"):
        return f"https://{ACCOUNT_SITE}/s?" + urlencode({k: query[k] for k in ("__biz", "mid", "idx", "sn") if query.get(k)}), "strict"
    kept = {k: v for k, v in query.items() if k not in VOLATILE}
    return (f"https://{ACCOUNT_SITE}/s?" + urlencode(kept), "loose") if kept.keys() & {"__biz", "mid", "sn"} else ("", "none")


def best_address(candidates: list[str]) -> tuple[str, str]:
    """The first strict form among the candidates, else the first loose one."""
    found = [lasting_address(c) for c in candidates]
    return next((f for form in ("strict", "loose") for f in found if f[1] == form), ("", "none"))


def unwrapped(url: str) -> str:
    """Target of a search engine's redirect, or the address itself."""
    import base64

    parts = split(url)
    if parts is None or "bing.com" not in parts.netloc:
        return url
    query = parse_qs(parts.query)
    value = next((query[k][0] for k in ("u", "url", "target", "r", "redir") if query.get(k)), "")
    if value.startswith("a1") and len(value) > 3:
        try:
            value = base64.urlsafe_b64decode(value[2:] + "=" * (-len(value[2:]) % 4)).decode("utf-8", errors="ignore")
        except ValueError:
            return url
    return value if value.startswith(("http://", "https://")) else url


def _stripped(html: str) -> str:
    return " ".join(unescape(re.sub(r"<[^>]+>", "", html)).split())


def result_links(html: str | None, markers: list[str], most: int = 50) -> list[tuple[str, str, str]]:
    """(url, title, summary) of a result page, for addresses with a marker: result blocks, else all links, else any address in the page."""
    html = html or ""
    fits = lambda u: any(m in u for m in markers)
    address = lambda raw: unwrapped(unquote(unescape(raw)).strip())
    found: dict[str, tuple[str, str]] = {}
    for block in re.findall(r'<li class="b_algo".*?</li>', html, re.S):
        if (m := re.search(r'<h2><a href="([^"]+)"[^>]*>(.*?)</a>', block, re.S)) and fits(u := address(m[1])) and u not in found and (title := _stripped(m[2])):
            s = re.search(r"<p>(.*?)</p>", block, re.S)
            found[u] = (title, _stripped(s[1]) if s else "")
    if not found:
        for m in re.finditer(r'<a [^>]*href="([^"]+)"[^>]*>(.*?)</a>', html, re.S):
            if len(found) < most and (u := address(m[1])).startswith("http") and fits(u) and len(title := _stripped(m[2])) >= 4:
                found.setdefault(u, (title, ""))
    if not found:
        for raw in [*re.findall(r"https?://[^\s\"'<>]+", html), *map(unquote, re.findall(r"https?%3A%2F%2F[0-9A-Za-z%._/\-]+", html))]:
            if len(found) < most and (u := address(raw)).startswith("http") and fits(u):
                found.setdefault(u, (u.rstrip("/").split("/")[-1][:80] or "搜索结果", ""))
    return [(u, *x) for u, x in found.items()]


def _objects(node) -> Iterator[dict]:  # noqa: ANN001
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
        todo.extend(reversed(list(x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())))


def embedded_rows(html: str | None) -> list[tuple[str, str, str, str, str]]:
    """(title, url, id, excerpt, image) of every object with a title in the state that a page carries, in order."""
    out = []
    for name in ("js-initialData", "__NEXT_DATA__"):
        if m := re.search(rf'<script[^>]*id="{name}"[^>]*>\s*(\{{.*?\}})\s*</script>', html or "", re.S):
            try:
                data = json.loads(m[1])
            except (ValueError, RecursionError):
                continue
            field = lambda o, k: str(o.get(k) or "").strip()
            out += [(field(o, "title"), field(o, "url"), field(o, "id"), field(o, "excerpt"), field(o, "thumbnail") or field(o, "image_url") or field(o, "cover_url")) for o in _objects(data) if field(o, "title")]
    return out


def embedded(landed: DataFrame, key: str = "page_id", count: int = 10) -> DataFrame:
    """Rows of the state embedded in landed pages (key, html): key, position, title, url, summary, image_url; one a web address."""
    raw = _read(landed, [key, "html"], lambda h: [(i, *r) for i, r in enumerate(embedded_rows(h))], "position int, title string, url string, id string, excerpt string, image_url string")
    given = F.when((F.col("url") == "") & F.col("id").rlike("^[0-9]+$"), F.concat(F.lit(f"{ANSWER_SITE}/question/"), F.col("id"))).otherwise(F.col("url"))
    rows = raw.select(key, "position", T.clean_title("title").alias("title"), web_address(given).alias("url"), T.summary("excerpt").alias("summary"), "image_url").where("title <> '' and url <> ''")
    first = Window.partitionBy(key, "url").orderBy("position")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("position"))).where(F.col("_n") <= count).drop("_n")


def results(landed: DataFrame, markers: tuple[str, ...], key: str = "page_id", source_name: str = "", count: int = 10) -> DataFrame:
    """Rows of landed search-engine pages (key, html), with a stand-in summary where a result has none."""
    rows = _read(landed, [key, "html"], lambda h: [(i, t, u, s) for i, (u, t, s) in enumerate(result_links(h, list(markers))[:count])], "position int, title string, url string, summary string")
    return rows.withColumn("summary", F.when(F.col("summary") == "", f"来自搜索引擎的{source_name}相关结果。").otherwise(T.summary("summary")))


def account_results(landed: DataFrame, key: str = "page_id", count: int = 10) -> DataFrame:
    """Rows of landed account searches (key, url, html): title, address, summary, account, time and picture of each result block.

    Pages that ask whether a robot reads them give no rows.
    """

    def read(html: str | None) -> list[tuple]:
        out = []
        for block in re.findall(r'<li\s+id="sogou_vr[^"]*"[^>]*>(.*?)</li>', html or "", re.S):
            block = re.sub(r"<!--red_(?:beg|end)-->", "", block)
            head = re.search(r'<h3[^>]*>\s*<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', block, re.S)
            if not head or not (title := _stripped(head[2])):
                continue
            url = plain_address(head[1])
            url = best_address(account_links(block))[0] or (SEARCH_SITE + url if url.startswith("/") else url)
            part = lambda p: (re.search(p, block, re.S) or ["", ""])[1]  # noqa: E731, B023
            image = unescape(part(r'<div[^>]*class="img-box"[^>]*>.*?<img[^>]*src="([^"]+)"').strip())
            out.append((len(out), title, url, _stripped(part(r'<p[^>]*class="txt-info"[^>]*>(.*?)</p>')), _stripped(part(r'<span[^>]*class="all-time-y2"[^>]*>(.*?)</span>')), float(part(r"timeConvert\('(\d+)'\)") or 0), "https:" + image if image.startswith("//") else image))
        return out[:count]

    open_pages = landed.where(~blocked_page("html", "url"))
    rows = _read(open_pages, [key, "html"], read, "position int, title string, url string, summary string, source_name string, published_ts double, image_url string")
    return rows.withColumn("summary", T.summary("summary")).where("url <> ''")


def resolved(rows: DataFrame, pages: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Add ``resolved_url`` and ``resolved_by`` to account rows (_ord, url, title, source_name, ...).

    In turn: the address itself or its url parameter; the page landed behind it (pages: url, location, html), by its redirect, script,
    metas or links; the account's history (``research.history_titles``: _ord, url); a search for source and title.
    """

    def read(url: str | None, location: str | None, html: str | None) -> list[tuple[str, str]]:
        parts = split(url or "")
        inner = [plain_address(unquote(x)) for x in (parse_qs(parts.query).get("url", []) if parts else [])]
        return [best_address([url or "", *inner, location or "", script_target(html), *_meta_target(html), *account_links(html or "")])]

    joined = rows.select("_ord", "url").join(pages.select("url", "location", "html"), "url", "left")
    found = _read(joined.select("_ord", "url", "location", "html"), ["_ord", "url", "location", "html"], read, "_link string, _form string")
    found = found.groupBy("_ord").agg(F.min_by(F.struct("_link", "_form"), F.struct(F.array_position(F.array(F.lit("strict"), F.lit("loose"), F.lit("none")), F.col("_form")), F.col("_link"))).alias("_best"))
    out = rows.join(found, "_ord", "left")
    out = out.join(history.select("_ord", F.col("url").alias("_old")), "_ord", "left") if history is not None else out.withColumn("_old", F.lit(None).cast("string"))
    search = F.concat(F.lit(f"{SEARCH_SITE}/weixin?type=2&query="), F.url_encode(F.trim(F.concat_ws(" ", T.text("source_name"), T.text("title")))))
    link = F.nullif(F.col("_best._link"), F.lit(""))
    return out.withColumns({"resolved_url": F.coalesce(link, F.nullif("_old", F.lit("")), search), "resolved_by": F.when(link.isNotNull(), F.col("_best._form")).when(T.text("_old") != "", "history").otherwise("failed")}).drop("_best", "_old")


def followed(rows: DataFrame, hops: DataFrame, most: int = 10) -> DataFrame:
    """(_ord, first, final, hops, looped): where the landed redirects (url, location, html) lead each row's address.

    One join a hop, of the rows that are still under way; a row ends at a page without a location, at one that has not landed, at an address that it has
    been to, or after ``most`` hops. ``first`` and ``final`` are structs of url and html; a page that has not landed has a null html.
    """
    folder = scratch(rows.sparkSession)
    known = hops.groupBy("url").agg(F.min(F.struct(T.text("location").alias("location"), T.text("html").alias("html"))).alias("hop"))
    known = stored(known.select("url", "hop.location", "hop.html"), folder, "hops")
    absolute = F.when(F.startswith("location", F.lit("//")), F.concat(F.lit("https:"), "location")).otherwise(F.col("location"))
    at = rows.select("_ord", F.col("url").alias("at"), F.array("url").alias("been"))
    done = []
    for n in range(most + 1):
        met = at.join(known, at["at"] == known["url"], "left").select("_ord", "been", F.struct(F.col("at").alias("url"), "html", "location").alias("page"), absolute.alias("next"), *([] if n == 0 else ["first"]))
        met = stored(met if n else met.withColumn("first", F.col("page")), folder, f"at-{n}")
        again = F.array_contains("been", F.col("next"))
        onward = (T.text("next") != "") & ~F.coalesce(again, F.lit(False)) & F.lit(n < most)
        done.append(met.where(~onward).select("_ord", "first", F.col("page").alias("final"), F.lit(n).alias("hops"), F.coalesce(again, F.lit(False)).alias("looped")))
        at = met.where(onward).select("_ord", F.col("next").alias("at"), F.array_append("been", F.col("next")).alias("been"), "first")
        if not at.take(1):
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def resolved_hops(rows: DataFrame, hops: DataFrame, history: DataFrame | None = None, most: int = 10) -> DataFrame:
    """Rows (_ord, url, title, source_name) whose address is a search engine's link, with resolved_url, resolved_by, hops and looped.

    In turn: the address that the link names; the first page's redirect, script, metas and links; the page that the redirects end at; the account's
    history (``research.history_titles``); a search for source and title. A page that asks for a robot ends the matter. Other addresses stay (``direct``).
    """

    def read(url: str | None, first: str | None, location: str | None, final_url: str | None, final: str | None) -> list[tuple[str, str]]:
        parts = split(url or "")
        inner = [plain_address(unquote(x)) for x in (parse_qs(parts.query).get("url", []) if parts else [])]
        ways = [inner, [plain_address(location), script_target(first), *_meta_target(first), *account_links(first or "")], [final_url or "", *_meta_target(final), *account_links(final or "")]]
        for n in range(1, len(ways) + 1):  # what is known so far, before more is looked at
            best = best_address([c for way in ways[:n] for c in way])
            if best[0]:
                return [best]
        return [("", "none")]

    link = F.contains(T.text("url"), F.lit("sogou.com/link"))
    ways = followed(rows.where(link), hops, most)
    ends = lambda c: blocked_page(F.col(f"{c}.html"), F.col(f"{c}.url"))
    told = stored(ways.withColumn("blocked", ends("first") | ends("final")), scratch(rows.sparkSession), "told")
    open_page = lambda c: F.when(~F.col("blocked"), c)  # noqa: E731  the link itself is read before any page
    seen = told.select("_ord", F.col("first.url").alias("u"), open_page(F.col("first.html")).alias("f"), open_page(F.col("first.location")).alias("l"), open_page(F.col("final.url")).alias("fu"), open_page(F.when(F.col("hops") > 0, F.col("final.html"))).alias("fh"))
    found = _read(seen, ["_ord", "u", "f", "l", "fu", "fh"], read, "link string, form string")
    out = rows.join(told.select("_ord", "hops", "looped", "blocked"), "_ord", "left").join(found, "_ord", "left")
    out = out.join(history.select("_ord", F.col("url").alias("_old")), "_ord", "left") if history is not None else out.withColumn("_old", F.lit(None).cast("string"))
    strict = urls.account_article("_old")
    query = F.trim(F.concat_ws(" ", F.trim(T.text("source_name")), F.trim(T.text("title"))))
    search = F.concat(F.lit(f"{SEARCH_SITE}/weixin?type=2&query="), F.replace(F.replace(F.url_encode(query), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit("&ie=utf8"))
    old = (T.text("_old") != "") & ~F.coalesce("blocked", F.lit(False))
    hit = T.text("link") != ""
    by = F.when(~link, "direct").when(hit, F.col("form")).when(old & (strict != ""), "strict").when(old, "history").otherwise("failed")
    to = F.when(~link, F.col("url")).when(hit, F.col("link")).when(old & (strict != ""), strict).when(old, F.col("_old")).otherwise(search)
    return out.withColumns({"resolved_url": to, "resolved_by": by, "hops": F.coalesce("hops", F.lit(0)), "looped": F.coalesce("looped", F.lit(False))}).drop("link", "form", "blocked", "_old")


def resolution_counts(resolved_rows: DataFrame) -> DataFrame:
    """(resolved_by, n, hops, loops): how addresses were resolved."""
    return resolved_rows.groupBy("resolved_by").agg(F.count("*").alias("n"), F.sum("hops").alias("hops"), F.count_if("looped").alias("loops"))


def history_rows(html: str | None) -> list[tuple[int, str, str, float]]:
    """(position, title, url, time) of the messages on an account's page, each followed by the items sent with it."""
    if m := re.search(r"var\s+msgList\s*=\s*'(.+?)';", html or "", re.S):
        raw = plain_address(m[1].replace("&quot;", '"')) if "&quot;" in m[1] else m[1]
        raw = re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[\"'\\/])", lambda e: chr(int(e[1][1:], 16)) if len(e[1]) > 1 else e[1], raw).replace("\r", "").replace("\n", "")
    else:
        m = re.search(r"var\s+msgList\s*=\s*(\{.*?\});", html or "", re.S)
        raw = m[1] if m else ""
    try:
        data = json.loads(raw)
    except (ValueError, RecursionError):
        return []
    out: list[tuple[int, str, str, float]] = []
    for item in data.get("list") or []:
        first, common = item.get("app_msg_ext_info") or {}, item.get("comm_msg_info") or {}
        ts = float(common.get("datetime") or first.get("datetime") or 0)
        for entry in [first, *(first.get("multi_app_msg_item_list") or [])]:
            title, url = str((entry or {}).get("title", "")).strip(), plain_address(str((entry or {}).get("content_url", "")))
            if title and url:
                url = "https:" + url if url.startswith("//") else f"https://{ACCOUNT_SITE}{url}" if url.startswith("/") else url
                out.append((len(out), title, url, ts))
    return out


def account_history(landed: DataFrame, key: str = "account") -> DataFrame:
    """Landed account pages (key, html) to key, position, title, url, published_ts."""
    return _read(landed, [key, "html"], history_rows, "position int, title string, url string, published_ts double")


def cascade(searches: DataFrame, ways: list[DataFrame], engine: DataFrame, source_name: str, count: int = 10) -> DataFrame:
    """Rows of each search (keyword, search_url) from the first of ``ways`` that has any, else a placeholder.

    ``ways`` and ``engine`` have keyword and the columns of ``ROW``. Where that leaves one row at most, the engine's rows stand in, if
    there are any. Each search gives ``count`` rows at most.
    """
    names = ["keyword", *[c.split()[0] for c in ROW.split(", ")]]
    shown = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in names])
    ranked = [shown(w).withColumn("_way", F.lit(i)) for i, w in enumerate(ways)]
    entry = searches.select("keyword", F.lit(0).alias("position"), F.concat(F.lit(f"{source_name}搜索："), F.col("keyword")).alias("title"), F.col("search_url").alias("url"), F.lit(f"{UNPARSED}，点击进入{source_name}搜索结果页查看更多内容。").alias("summary"), F.lit("").alias("image_url"))
    rows = entry.withColumn("_way", F.lit(len(ways)))
    for way in ranked:
        rows = rows.unionByName(way)
    here = Window.partitionBy("keyword")
    rows = rows.withColumn("_first", F.min("_way").over(here)).where("_way = _first").withColumn("_size", F.count("*").over(here)).drop("_way", "_first")
    stand_in = shown(engine).withColumn("_engine", F.lit(True))
    thin = rows.where("_size <= 1").select("keyword").distinct()
    more = stand_in.join(thin, "keyword", "left_semi")
    kept = rows.drop("_size").join(more.select("keyword").distinct(), "keyword", "left_anti")
    both = kept.unionByName(more.drop("_engine"))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("keyword").orderBy("position", "url"))).where(F.col("_n") <= count).drop("_n").withColumn("source_name", F.lit(source_name))


def page_videos(landed: DataFrame, key: str = "keyword") -> DataFrame:
    """Bare video addresses on landed search pages (key, html), once each, with a title that tells them apart."""
    found = F.array_distinct(F.regexp_extract_all(T.text("html"), F.lit("(https://www\\.bilibili\\.com/video/BV[0-9A-Za-z]+)"), F.lit(1)))
    rows = landed.select(key, F.posexplode(found).alias("position", "url"))
    number = F.regexp_extract("url", "/video/(BV[0-9A-Za-z]+)", 1)
    return rows.select(key, "position", F.concat(F.lit("B站视频："), F.col(key), F.lit(" ["), number, F.lit("]")).alias("title"), "url", F.lit("来自B站搜索结果的相关视频。").alias("summary"), F.lit("").alias("image_url"))


def page_answers(landed: DataFrame, key: str = "keyword") -> DataFrame:
    """Bare addresses of questions and articles on landed search pages (key, html), once each."""
    found = F.array_distinct(F.regexp_extract_all(T.text("html"), F.lit("(https://(?:www\\.zhihu\\.com/question/\\d+(?:/answer/\\d+)?|zhuanlan\\.zhihu\\.com/p/\\d+))"), F.lit(1)))
    rows = landed.select(key, F.posexplode(found).alias("position", "url"))
    return rows.select(key, "position", F.concat(F.lit("知乎："), F.col(key), F.lit(" ["), F.regexp_extract("url", "(\\d+)$", 1), F.lit("]")).alias("title"), "url", F.lit("来自知乎搜索结果的相关内容。").alias("summary"), F.lit("").alias("image_url"))


def answer_results(landed: DataFrame, key: str = "keyword") -> DataFrame:
    """The search interface's payloads (key, payload): objects with a title and an address that a reader can open."""
    target = "struct<type:string,id:string,url:string,title:string,excerpt:string,question:struct<id:string,name:string,title:string>,answer:struct<id:string>>"
    rows = landed.withColumn("_r", F.from_json("payload", f"struct<data:array<struct<object:{target},highlight:struct<title:string,description:string>>>>")).select(key, F.posexplode("_r.data").alias("position", "_d"))
    o = F.col("_d.object")
    title = F.coalesce(*[F.nullif(T.clean_title(F.regexp_replace(T.text(x), "<[^>]+>", "")), F.lit("")) for x in (o["title"], F.col("_d.highlight.title"), o["question"]["name"], o["question"]["title"])], F.lit(""))
    out = rows.select(key, "position", title.alias("title"), target_address(o).alias("url"), T.summary(o["excerpt"]).alias("summary"), F.lit("").alias("image_url"))
    return out.where("title <> '' and url <> ''")


def video_results(landed: DataFrame, key: str = "keyword") -> DataFrame:
    """The video search's payloads (key, payload): key, position, title, url, summary, image_url, author and published_ts."""
    video = "struct<title:string,arcurl:string,bvid:string,description:string,pic:string,author:string,pubdate:double>"
    rows = landed.withColumn("_r", F.from_json("payload", f"struct<data:struct<result:array<{video}>>>")).select(key, F.posexplode("_r.data.result").alias("position", "_d"))
    url = F.coalesce(F.nullif(F.trim(T.text("_d.arcurl")), F.lit("")), F.when(T.text("_d.bvid") != "", F.concat(F.lit("https://www.bilibili.com/video/"), F.col("_d.bvid"))))
    image = F.when(F.startswith(T.text("_d.pic"), F.lit("//")), F.concat(F.lit("https:"), F.col("_d.pic"))).otherwise(T.text("_d.pic"))
    out = rows.select(key, "position", T.clean_title(F.regexp_replace(T.text("_d.title"), "<[^>]+>", "")).alias("title"), url.alias("url"), T.summary("_d.description").alias("summary"), image.alias("image_url"), F.concat(F.lit("B站/"), T.text("_d.author")).alias("author"), F.coalesce("_d.pubdate", F.lit(0.0)).alias("published_ts"))
    return out.where("title <> '' and url is not null")


def web_results(landed: DataFrame, key: str = "query") -> DataFrame:
    """A dedicated web search's payloads (key, payload): results with a title and an address, dated by their label where no date is given."""
    from ..functions import facts

    result = "struct<title:string,link:string,url:string,content:string,snippet:string,media:string,site_name:string,publish_time:string,date:string>"
    schema = f"struct<choices:array<struct<message:struct<tool_calls:array<struct<search_result:array<{result}>>>>>>>"
    calls = F.coalesce(F.get(F.from_json("payload", schema)["choices"], 0)["message"]["tool_calls"], F.array().cast(f"array<struct<search_result:array<{result}>>>"))
    found = F.flatten(F.filter(F.transform(calls, lambda c: c["search_result"]), lambda r: r.isNotNull()))
    rows = landed.select(key, F.posexplode(found).alias("position", "_d"))
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(T.text(f"_d.{n}")), F.lit("")) for n in names], F.lit(""))
    title, content = first("title"), F.substring(first("content", "snippet"), 1, 2000)
    stated = F.regexp_extract(F.concat_ws(" ", title, content), "(?i)(?:发布时间|发布日期|发布于|发表于|published(?:\\s+on)?)\\s*[：:]?\\s*(20\\d{2}[年./-]\\d{1,2}[月./-]\\d{1,2}日?(?:[ T\\s]+\\d{1,2}[:：]\\d{2}(?:[:：]\\d{2})?)?)", 1)
    published = F.when(first("publish_time", "date") != "", first("publish_time", "date")).otherwise(stated)
    bare = F.trim(F.regexp_replace(title, "\\s*[（(]\\s*(?:发布时间|发布日期)[：:]?\\s*20\\d{2}[^）)]*[）)]\\s*$", ""))
    name = F.concat(F.lit("GLM搜索/"), F.coalesce(F.nullif(first("media", "site_name"), F.lit("")), F.lit("智谱联网搜索")))
    out = rows.select(key, "position", F.when(bare != "", bare).otherwise(title).alias("title"), first("link", "url").alias("url"), content.alias("summary"), name.alias("source_name"), F.substring(published, 1, 32).alias("published"), facts.date_ts(published).alias("published_ts"))
    return out.where("title <> '' and url <> ''")

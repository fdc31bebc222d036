"""Readers of landed pages: metadata, publication, visible text, attachments, listings and official lists.

Each reader parses a page once, in Arrow batches. Nulls: a null page reads as an empty one and gives empty fields; an
empty table gives no rows. A page's links that are no addresses are left out, the rest of it is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, facts, urls
from ..functions import text as T
from .dom import Node, below, joined, parse, short_texts, split

# Names under which pages publish their dates, and the words and limits of the readers.
DATE_META = ("article:published_time", "datepublished", "publishdate", "pubdate")
GUARD_META = ("article:published_time", "datepublished", "pubdate", "publishdate", "publication_date")
SUMMARY_CLASSES = ("intro", "brief", "summary", "excerpt", "richText", "rwznr")
SKIPPED = frozenset("script style noscript svg nav footer header form".split())
SPACED = frozenset("p div br li tr h1 h2 h3".split())
OFFICIAL_TERMS = ("仓储", "立体库", "物流自动化", "wms", "wcs", "agv", "堆垛", "输送")
NO_ARTICLE = re.compile(r"(?:list|tags|login|register|about|contact)(?:\d|/|\.|$)", re.I)
FULL, REVERSED = re.compile(dates.FULL), re.compile(dates.REVERSED)
HTML_BYTES, PDF_BYTES, DOCUMENT_CHARS, LEAST_CHARS = 2_000_000, 10_000_000, 16_000, 60

METADATA = "title string, summary string, image_url string, dates array<string>"
ENTRY = "title string, url string, summary string, dates array<string>, image_url string"


def _flat(x: str | None) -> str:
    return " ".join(unescape(x or "").split())


def linked_dates(script: str) -> list[str]:
    """``datePublished`` of the objects of a JSON-LD block, in its graph or outside."""
    try:
        data = json.loads(script)
    except (ValueError, RecursionError):
        return []
    out = []
    for item in data if isinstance(data, list) else [data]:
        nodes = item.get("@graph", [item]) if isinstance(item, dict) else []
        out += [str(n["datePublished"]) for n in (nodes if isinstance(nodes, list) else []) if isinstance(n, dict) and n.get("datePublished")]
    return out


def _is_json_ld(node: Node) -> bool:
    return node.tag == "script" and node.get("type").lower() == "application/ld+json"


def _raw_text(node: Node) -> str:
    return "".join(x for x in node.children if isinstance(x, str))


def body_text(root: Node) -> str:
    """Text of the article's paragraphs, or of all paragraphs where no element marks the article."""
    main = next((n for tag in ("article", "main") for n in root.nodes(tag)), root)
    return " ".join(t for t in (n.text() for n in main.nodes("p") if not n.inside("nav", "footer", "header", "aside", "form")) if t)


def metadata(html: str | None, url: str) -> tuple[str, str, str, list[str]]:
    """Title, summary of 200 characters, image, and the texts that may date the page: metas and JSON-LD, else its own date nodes.

    Links' texts and footers never date a page.
    """
    root = parse(html)
    metas = [(n.get("property") or n.get("name") or n.get("itemprop"), n.get("content")) for n in root.nodes("meta")]
    named = lambda *names: [v for k, v in metas if k in names]
    title = _flat(" ".join(named("og:title"))) or _flat(" ".join(n.text() for n in root.nodes("h1")))
    found = [v for k, v in metas if k.lower() in DATE_META] + [d for n in root.nodes("script") if _is_json_ld(n) for d in linked_dates(_raw_text(n))]
    if not found:
        linked, texts = below(root, "a"), short_texts(root, 80)
        found = [n.get("datetime") for n in root.nodes("time") if n.get("datetime") and id(n) not in linked]
        for n in root.nodes():
            classes = n.get("class")
            if ("time" in classes.lower() or "date" in classes.lower() or "publish" in classes) and n.tag not in ("script", "style") and id(n) not in linked:
                value = texts[id(n)]
                if value is not None and FULL.search(value):
                    found.append(value)
    summary = body_text(root)
    if title and summary.startswith(title):
        summary = summary[len(title) :].strip()
    summary = summary or _flat(" ".join(named("description", "og:description")))
    images = named("og:image")
    return title, summary[:200], joined(url, images[0]) if images else "", found


def publication(html: str | None) -> list[tuple[str, str]]:
    """(value, fragment) pairs that name the time of publication, the fragment as it stands in the page."""
    root, out = parse(html), []
    for n in root.nodes("meta", "time"):
        key = (n.get("property") or n.get("name") or n.get("itemprop")).lower()
        if n.tag == "meta" and key in GUARD_META:
            out.append((n.get("content"), n.raw))
        elif n.tag == "time" and (key == "datepublished" or "publish" in n.get("class").lower()):
            out.append((n.get("datetime"), n.raw))
    for n in root.nodes("script"):
        if _is_json_ld(n):
            out += [(unescape(m[1]), m[0]) for m in re.finditer(r'"datePublished"\s*:\s*"([^"<>]+)"', _raw_text(n))]
    return out


def visible_text(html: str | None) -> tuple[str, str]:
    """(text, title): what is not in scripts, navigation, headers, footers and forms, on one line."""
    root, parts, title = parse(html), [], []
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, titled = todo.pop()
        if isinstance(node, str):
            parts.append(node)
            if titled:
                title.append(node)
        elif node.tag not in SKIPPED:
            todo += [(" ", False)] if node.tag in SPACED else []
            todo += [(c, titled or node.tag == "title") for c in reversed(node.children)]
    return " ".join(" ".join(parts).split()), " ".join(" ".join(title).split())


def pdf_links(base: str, html: str | None) -> list[str]:
    found = (joined(base, n.get("href")) for n in parse(html).nodes("a") if n.get("href"))
    return list(dict.fromkeys(u for u in found if (p := split(u)) and p.path.lower().endswith(".pdf")))


class _Cards:
    """The elements around a page's links. What is known of an element is kept, so that a block of many links is looked at once."""

    def __init__(self, root: Node, base: str):
        self._base, self._short, self._links = base, short_texts(root, 1801), {}

    def _titled(self, around: Node) -> set[str]:
        """Up to two addresses of titled links below."""
        if id(around) not in self._links:
            found: set[str] = set()
            for a in around.nodes("a"):
                if a.get("href") and "tags" not in a.get("href") and len(_flat(a.get("title")) or a.text()) >= 8:
                    found.add(joined(self._base, a.get("href")))
                    if len(found) == 2:
                        break
            self._links[id(around)] = found
        return self._links[id(around)]

    def of(self, anchor: Node, url: str) -> Node:
        """The largest element around a link, up to four levels, that holds no other titled link and little text."""
        card = anchor
        for _ in range(4):
            around = card.parent
            if around is None or around.tag in ("body", "html", "main", "nav"):
                break
            if self._titled(around) - {url} or self._short[id(around)] is None:
                break
            card = around
            if card.tag in ("li", "article"):
                break
        return card


def _card_dates(card: Node) -> list[str]:
    out = []
    for n in card.nodes():
        if n.tag in ("a", "img", "script", "style"):
            continue
        value, classes = n.text(" "), n.get("class").lower()
        if len(value) >= 50:
            continue
        if FULL.fullmatch(value) or REVERSED.fullmatch(value):
            out.append(value)
        elif any(x in classes for x in ("date", "time", "publish")):
            out += [m[0] for m in FULL.finditer(value)]
    return out


def listing(base: str, html: str | None, pattern: str = "", most: int = 120) -> list[dict]:
    """Entries of a listing page: links with a title of 8 to 180 characters, once each, with their card's summary, dates and image."""
    root = parse(html)
    for n in list(root.nodes("script", "style", "nav", "footer")):
        n.children, n.tag = [], "gone"
    wanted = re.compile(pattern, re.I) if pattern else None
    seen, out, cards = set(), [], _Cards(root, base)
    for a in root.nodes("a"):
        href = a.get("href")
        url = joined(base, href) if href else ""
        parts = split(url)
        if parts is None or href.startswith("#") or url.split("#")[0] == base.split("#")[0] or url in seen:
            continue
        if wanted and not wanted.search(parts.path) or not wanted and (parts.path.endswith((".pdf", ".zip")) or NO_ARTICLE.search(parts.path)):
            continue
        title = _flat(a.get("title"))
        if not title:
            heads = (n.text() for n in a.nodes() if n.tag in ("h1", "h2", "h5", "h6") or "tit" in n.get("class"))
            title = next((t for t in heads if len(t) >= 8 and not FULL.fullmatch(t)), "") or a.text()
        if not 8 <= len(title) <= 180 or "{{" in title:
            continue
        seen.add(url)
        card = cards.of(a, url)
        summary = next((n.text() for n in card.nodes() if any(x in n.get("class") for x in SUMMARY_CLASSES)), "")
        if not summary and title == a.text():
            title = re.sub(r"^20\d{2}[-/年]\d{1,2}[-/月]\d{1,2}(?:日)?\s*", "", title)
        image = next((n.get("data-original") or n.get("src") for n in card.nodes("img") if n.get("data-original") or n.get("src")), "")
        out.append({"title": title, "url": url, "summary": summary, "dates": _card_dates(card), "image_url": joined(base, image) if image else ""})
        if len(out) == most:
            break
    return out


def official_links(base: str, html: str | None, most: int = 80) -> list[tuple[str, str]]:
    """(title, url) of links whose title has 8 characters and one of the terms, in order."""
    out = []
    for href, inner in re.findall(r'<a[^>]+href=["\']([^"\']+)["\'][^>]*>(.*?)</a>', html or "", re.I | re.S):
        title = " ".join(re.sub(r"<[^>]+>", " ", inner).split())
        if len(title) >= 8 and any(x in title.lower() for x in OFFICIAL_TERMS):
            out.append((title, joined(base, href)))
    return out[:most]


def repaired(content: bytes | None, url: str, declared: str = "utf-8") -> str:
    """Text of a page; of one site that names a wrong charset the right one is tried first, and taken if its words appear."""
    if "ccgp.gov.cn" in url:
        try:
            text = (content or b"").decode("gb18030")
            if "采购" in text or "公告" in text:
                return text
        except UnicodeDecodeError:
            pass
    return (content or b"").decode(declared or "utf-8", errors="replace")


def _read(df: DataFrame, columns: list[str], read: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows that ``read`` makes of each row's values, the first column carried along as key."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    key = df.select(columns[0]).schema[0]
    key_type = kinds.get(key.dataType.simpleString().replace("bigint", "long"), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(values[0], *row) for values in zip(*(c.to_pylist() for c in part.columns)) for row in read(*values[1:])]
                cols = list(zip(*rows)) or [[]] * (1 + len(names))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [key_type, *types])], [columns[0], *names])

    return df.select(*columns).mapInArrow(run, f"`{columns[0]}` {key.dataType.simpleString()}, {schema}")


def page_metadata(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, title, summary, image_url, published_ts and published of each page; pages that date themselves differently stay undated."""
    read = _read(pages, [key, url, html], lambda u, h: [metadata(h, u or "")], METADATA)
    return read.withColumn("_d", dates.unique_date(F.col("dates"))).select(key, "title", "summary", "image_url", F.col("_d.ts").alias("published_ts"), F.col("_d.label").alias("published"))


def page_publication(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, published_ts and quote: the page's one time of publication and the fragment that states it; none where they differ."""
    read = _read(pages, [key, html], lambda h: [([v for v, _ in found], [q for _, q in found]) for found in [publication(h)]], "stated array<string>, quotes array<string>")
    known = F.filter(F.transform(F.arrays_zip("stated", "quotes"), lambda x: F.struct(facts.date_ts(x["stated"]).alias("ts"), x["quotes"].alias("quote"))), lambda x: x["ts"] != 0)
    one = F.size(F.array_distinct(F.transform(known, lambda x: x["ts"]))) == 1
    return read.select(key, F.when(one, F.get(known, 0)["ts"]).otherwise(0.0).alias("published_ts"), F.when(one, F.get(known, 0)["quote"]).otherwise("").alias("quote"))


def page_documents(landed: DataFrame, key: str = "page_id") -> DataFrame:
    """Landed responses (key, url, status, content_type, n_bytes, html) to documents with flags, or to the reason there is none.

    Returns key, url, text, title, attachment_urls (two at most), risk_flags and failure (empty where there is a document).
    """
    kind, path = F.lower(T.text("content_type")), F.lower(urls.part("url", 3))
    pdf = F.contains(kind, F.lit("application/pdf")) | F.endswith(path, F.lit(".pdf"))
    early = (
        F.when(F.col("status") != 200, F.concat(F.lit("source_http_"), F.col("status").cast("string")))
        .when(F.contains(path, F.lit("wappoc_appmsgcaptcha")), "source_access_challenge")
        .when(~F.contains(kind, F.lit("html")) & ~pdf, "source_unsupported_content")
        .when(F.col("n_bytes") > F.when(pdf, PDF_BYTES).otherwise(HTML_BYTES), F.when(pdf, "pdf_size_limit").otherwise("html_size_limit"))
        .otherwise("")
    )

    def read(url: str | None, html: str | None) -> list[tuple]:
        text = body_text(parse(html))
        text, title = (text, "") if len(text) >= LEAST_CHARS else visible_text(html)
        stated = publication(html)
        return [(text, title, pdf_links(url or "", html), [v for v, _ in stated], [q for _, q in stated])]

    marked = landed.withColumn("failure", early)
    parsed = _read(marked.where("failure = ''"), [key, "url", "html"], read, "text string, title string, links array<string>, stated array<string>, quotes array<string>")
    known = F.filter(F.transform(F.arrays_zip("stated", "quotes"), lambda x: F.struct(facts.date_ts(x["stated"]).alias("ts"), x["quotes"].alias("quote"))), lambda x: x["ts"] != 0)
    quote = F.when(F.size(F.array_distinct(F.transform(known, lambda x: x["ts"]))) == 1, F.get(known, 0)["quote"]).otherwise("")
    short = F.length("text") < LEAST_CHARS
    body = F.when(quote != "", F.concat(F.lit("[网页发布元数据] "), quote, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    links = F.slice(F.array_distinct(F.filter(F.transform("links", urls.fetch_url), lambda u: u != "")), 1, 2)
    flags = F.when(F.length("text") > DOCUMENT_CHARS, F.array(F.lit("html_text_truncated"))).otherwise(F.array().cast("array<string>"))
    ready = parsed.select(key, F.when(~short, F.substring(body, 1, DOCUMENT_CHARS)).alias("text"), "title", F.when(~short, links).alias("attachment_urls"), F.when(~short, flags).alias("risk_flags"), F.when(short, "source_text_unavailable").otherwise("").alias("_late"))
    out = marked.select(key, "url", "failure").join(ready, key, "left")
    return out.withColumn("failure", F.when(F.col("failure") == "", F.col("_late")).otherwise(F.col("failure"))).drop("_late")


def official_candidates(landed: DataFrame, key: str = "page_id") -> DataFrame:
    """Landed official lists (key, url, label, html) to candidates: key, position, title, url, source_name."""
    read = _read(landed, [key, "url", "label", "html"], lambda u, label, h: [(i, t, x, label or "官方公告") for i, (t, x) in enumerate(official_links(u or "", h))], "position int, title string, url string, source_name string")
    return read


def decoded_pages(landed: DataFrame, key: str = "page_id") -> DataFrame:
    """key and html of landed bytes (key, url, content, charset)."""
    return _read(landed, [key, "url", "content", "charset"], lambda u, c, d: [(repaired(c, u or "", d or "utf-8"),)], "html string")


def bounded_pdf(read: Column, most_pages: int = 80, most_chars: int = 120_000) -> Column:
    """struct<pages, risk_flags> of a PDF's pages (array<struct<page, text>>): the first pages and characters, and what was cut or is empty."""
    none = F.array().cast("array<struct<page:int,text:string>>")
    given = F.coalesce(read, none)

    def step(acc: Column, p: Column) -> Column:
        part = F.substr(T.text(p["text"]), F.lit(1), acc["left"])
        kept = F.concat(acc["pages"], F.array(F.struct(p["page"].cast("int").alias("page"), part.alias("text"))))
        return F.struct((acc["left"] - F.length(part)).cast("int").alias("left"), F.when((acc["left"] > 0) & (part != ""), kept).otherwise(acc["pages"]).alias("pages"))

    kept = F.aggregate(F.slice(given, 1, most_pages), F.struct(F.lit(most_chars).alias("left"), none.alias("pages")), step, lambda acc: acc["pages"])
    chars = F.aggregate(F.slice(given, 1, most_pages), F.lit(0), lambda n, p: n + F.length(T.text(p["text"])))
    flag = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(flag(F.size(given) > most_pages, "pdf_pages_truncated"), flag(chars > most_chars, "pdf_text_truncated"), flag(chars < LEAST_CHARS, "pdf_text_unavailable"))
    return F.struct(kept.alias("pages"), flags.alias("risk_flags"))


def cover(html: Column | str) -> Column:
    """An account article's cover: its og:image, else the address in its script, within the first 50,000 characters.

    The head is cut once, as the variable of a lambda; as a plain expression it would be cut again wherever it stands. A pattern runs where its fixed word is found.
    """

    def found(head: Column) -> Column:
        first = lambda word, p: F.when(F.contains(head, F.lit(word)), F.nullif(F.trim(F.regexp_extract(head, p, 1)), F.lit("")))
        return F.coalesce(first('property="og:image"', 'property="og:image"\\s+content="([^"]+)"'), first("msg_cdn_url", 'var\\s+msg_cdn_url\\s*=\\s*"([^"]+)"'), F.lit(""))

    return F.coalesce(F.get(F.transform(F.array(F.substring(T.text(html), 1, 50_000)), found), F.lit(0)), F.lit(""))



"""Around research: reading order, query plans, triage checks, candidate caps, history titles, and cautious narratives."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, urls
from ..functions import text as T
from ..functions.urls import host
from ..tables import dealt

# Words that make a page worth reading first, and the terms a search is built from.
PAGE_TERMS = ("预算", "截止", "采购人", "技术规格", "堆垛机", "WMS", "澄清")
SEARCH_TERMS = ("WMS", "WCS", "堆垛机", "立体库", "输送", "粮库", "仓储", "生产物流", "物料", "码垛", "AGV")


def research_text(pages: Column, text: Column, per_page: int = 6000, total: int = 24_000, plain: int = 16_000) -> Column:
    """Pages (array<struct<page, text>>) with telling words first, cut per page and in all; without pages the cut text."""
    keyed = F.transform(pages, lambda p: F.struct((~T.any_of(p["text"], PAGE_TERMS)).alias("late"), p["page"].alias("page"), p["text"].alias("text")))

    def step(acc: Column, p: Column) -> Column:
        part = F.substr(p["text"], F.lit(1), F.least(acc["left"], F.lit(per_page)))
        block = F.concat(F.lit("[PDF page "), p["page"].cast("string"), F.lit("] "), part)
        open_ = acc["left"] > 0
        return F.struct(F.when(open_, acc["left"] - F.length(part)).otherwise(acc["left"]).cast("int").alias("left"), F.when(open_, F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"))

    start = F.struct(F.lit(total).alias("left"), F.array().cast("array<string>").alias("blocks"))
    read = F.aggregate(F.array_sort(keyed), start, step, lambda acc: F.array_join(acc["blocks"], "\n"))
    return F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, read).otherwise(F.substring(text, 1, plain))


def resolver_queries(tier: Column) -> Column:
    """Ordered array<struct<purpose, query>> for a candidate (title, summary, content, url); ``tier`` is its source tier."""
    whole = F.concat_ws(" ", T.text("title"), T.text("summary"), T.text("content"))
    owner, province, city = facts.owner(whole), facts.province(whole), facts.city(whole)
    found = F.array_join(F.array_compact(F.array(*[F.when(F.contains(F.lower(whole), F.lit(t.lower())), F.lit(t)) for t in SEARCH_TERMS])), " ")
    terms = F.when(found != "", found).otherwise("仓储 生产物流")
    query = lambda purpose, *parts: F.struct(F.lit(purpose).alias("purpose"), F.concat(*parts).alias("query"))
    some = F.array_compact(F.array(
        F.when(owner != "", query("owner_equipment", F.lit('"'), owner, F.lit('" '), terms, F.lit(" 采购 招标 最新公告"))),
        F.when((tier == 1) & (host("url") != ""), query("official_domain", F.lit("site:"), host("url"), F.lit(" "), owner, F.lit(" "), terms, F.lit(" 采购 最新公告"))),
        F.when((province != "") | (city != ""), query("region_equipment", province, F.lit(" "), city, F.lit(" "), terms, F.lit(" 采购意向 企业采购 公告"))),
    ))
    core = F.trim(F.regexp_replace(T.text("title"), "[-—|].*$", ""))
    return F.when(F.size(some) > 0, some).otherwise(F.array(query("project_core", core, F.lit(" "), terms, F.lit(" 企业采购平台 最新公告"))))


def triage(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates (id, ...) with their decision (id, worth_research, score), if ids match one to one; else no rows.

    A batch with a missing, unknown or repeated id is invalid as a whole.
    """
    ours, theirs = candidates.select("id"), decisions.select("id")
    odd = ours.join(theirs, "id", "left_anti").union(theirs.join(ours, "id", "left_anti")).union(theirs.groupBy("id").count().where("count > 1").select("id"))
    valid = odd.limit(1).agg((F.count("*") == 0).alias("_valid"))
    return candidates.join(decisions, "id").join(F.broadcast(valid), F.col("_valid")).drop("_valid")


def _ranks(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows by weight with their rank."""
    top = df.orderBy(F.desc("weight"), "_ord").limit(limit)
    return top.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("weight"), "_ord")))


def research_selection(df: DataFrame, limit: int, least: float = 38.0) -> DataFrame:
    """A third of the places is for rows below ``least``; the rest goes by weight, and free places to whoever is next."""
    most = max(1, limit // 3)
    low = _ranks(df.where(F.col("relevance_score") < least), most).select("_ord", F.col("_rank").alias("_low"))
    quota = min(low.count(), most)
    top = _ranks(df, limit).select("_ord", "_rank")
    both = top.join(low, "_ord", "full").select("_ord", "_rank", "_low")
    tier = F.when(F.col("_rank") <= limit - quota, 0).when(F.col("_low") <= quota, 1).otherwise(2)
    chosen = both.withColumn("_tier", tier).orderBy("_tier", F.coalesce("_rank", F.lit(limit) + F.col("_low"))).limit(limit)
    return df.join(F.broadcast(chosen.select("_ord")), "_ord")


def prefilter_cap(df: DataFrame, limit: int, least: float = 38.0) -> DataFrame:
    """The best of each discovery channel, then the best, then rows below ``least`` (a quarter at most), then whoever is next.

    ``pool_place`` is the order in which they were taken; by weight where all rows fit.
    """
    most = max(1, limit // 4)
    low = _ranks(df.where(F.col("relevance_score") < least), most).select("_ord", F.col("_rank").alias("_low"))
    first = F.struct((-F.col("weight")).alias("w"), "_ord")
    heads = df.select("_ord", "weight", F.explode("discovery_channels").alias("channel")).groupBy("channel").agg(F.min(first).alias("f")).select(F.col("f._ord").alias("_ord"), (-F.col("f.w")).alias("weight")).distinct()
    fits = df.limit(limit + 1).count() <= limit
    quota = min(low.count(), most)
    heads = heads.orderBy(F.desc("weight"), "_ord").limit(limit - quota).select("_ord", F.lit(not fits).alias("_head"))
    n = heads.count()
    both = _ranks(df, limit).select("_ord", "_rank").join(low, "_ord", "full").join(heads, "_ord", "full").join(df.select("_ord", "weight"), "_ord")
    tier = F.lit(0) if fits else F.when(F.col("_head"), 0).when(F.col("_rank") <= max(0, limit - quota - n), 1).when(F.col("_low") <= quota, 2).otherwise(3)
    chosen = both.withColumn("_tier", tier).orderBy("_tier", F.desc("weight"), "_ord").limit(limit)
    chosen = chosen.select("_ord", F.row_number().over(Window.orderBy("_tier", F.desc("weight"), "_ord")).alias("pool_place"))
    return df.join(F.broadcast(chosen), "_ord")


def reading_order(df: DataFrame, least: float = 38.0) -> DataFrame:
    """A pool (relevance_score, pool_place) with ``rank``: two thirds in its own order, then up to a third of rows below ``least``, then the rest."""
    everywhere, low = Window.partitionBy(), F.col("relevance_score") < least
    n, broad = F.count("*").over(everywhere), F.sum(low.cast("int")).over(everywhere)
    nth = F.sum(low.cast("int")).over(Window.orderBy("pool_place"))
    counted = df.withColumns({"_n": n, "_quota": F.least(broad, F.greatest(F.lit(1), F.floor(n / 3))), "_nth": nth})
    tier = F.when(F.col("pool_place") <= F.col("_n") - F.col("_quota"), 0).when(low & (F.col("_nth") <= F.col("_quota")), 1).otherwise(2)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(tier, "pool_place"))).drop("_n", "_quota", "_nth")


#: Marks that do not count when titles are compared (fixed values), and the bonus for near times.
TITLE_MARKS = "(?U)[\\s，。、“”‘’！？：；,.!?;:·\\-_/（）()\\[\\]【】]+"
NEAR_TIMES = ((86400.0, 0.2), (3 * 86400.0, 0.1))


#: Rows of a target block and of a history block; cells of a matrix of titles; pairs of characters looked up at once, and in a block at most.
TARGETS, POSTS, CELLS, PAIRS, MOST = 65_536, 131_072, 1 << 22, 1 << 22, 1 << 25


class _Letters:
    """Titles as matrices of letters, those of like length together, for an upper bound of what another title shares with each of them."""

    def __init__(self, titles: list[str]):
        self.lengths = np.array([len(t) for t in titles], np.int64)
        self.parts, order, at = [], np.argsort(self.lengths, kind="stable"), 0
        while at < len(order):
            n = max(1, CELLS // max(1, int(self.lengths[order[min(at + CELLS // max(1, int(self.lengths[order[at]])), len(order)) - 1]])))
            rows = order[at : at + n]
            width = max(1, int(self.lengths[rows].max()))
            codes = np.frombuffer("".join(titles[i].ljust(width, "\0") for i in rows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), width)
            letters, ids = np.unique(codes, return_inverse=True)
            self.parts.append((rows, {chr(c): i for i, c in enumerate(letters)}, np.ascontiguousarray(ids.reshape(codes.shape).T)))
            at += len(rows)

    def shared(self, title: str) -> np.ndarray:
        """Length of the longest common subsequence with each title, at least; of more than 64 characters the parts' sum. Blocks that match are one."""
        out = np.zeros(len(self.lengths), np.int64)
        for rows, letters, ids in self.parts:
            for i in range(0, len(title), 64):
                piece = title[i : i + 64]
                masks = np.zeros(len(letters), np.uint64)
                for k, c in enumerate(piece):
                    if c in letters:
                        masks[letters[c]] |= np.uint64(1 << k)
                free = np.full(len(rows), (1 << 64) - 1, np.uint64)
                for column in ids:
                    met = free & masks[column]
                    free = (free + met) | (free - met)
                out[rows] += np.bitwise_count(~free & np.uint64((1 << len(piece)) - 1))
        return np.minimum(out, np.minimum(self.lengths, len(title)))


def _tokens(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of every character, numbered within its title: the n-th of a kind is one token. Ordered by row."""
    sizes = np.array([len(t) for t in titles], np.int64)
    codes = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    rows = np.repeat(np.arange(len(titles)), sizes)
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    fresh = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])]) if len(rows) else np.zeros(0, np.int64)
    nth = np.arange(len(rows)) - np.repeat(fresh, np.diff(np.r_[fresh, len(rows)]))
    return rows, codes << 32 | nth


def _heads(rows: np.ndarray, ranks: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their ranks) by size: of each row's ranks, in order, all but the last ``least`` - 2, so that of ``least`` common ones two are among them."""
    order = np.lexsort((ranks, rows))
    rows, ranks = rows[order], ranks[order]
    count = np.bincount(rows, minlength=len(least))
    start, size = np.cumsum(count) - count, np.where((count >= least) & (least >= 2), count - least + 2, 0)
    return [(at, ranks[start[at][:, None] + np.arange(n)]) for n in np.unique(size[size > 0]).tolist() for at in [np.flatnonzero(size == n)]]


def _pieces(heads: list, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) of every two ranks of a head, in pieces of about ``PAIRS``."""
    keys, owners, held = [], [], 0
    for at, ranks in heads:
        i, j = np.triu_indices(ranks.shape[1], 1)
        step = max(1, PAIRS // len(i))
        for x in range(0, len(at), step):
            keys.append((ranks[x : x + step, i] * base + ranks[x : x + step, j]).ravel())
            owners.append(np.repeat(at[x : x + step], len(i)))
            held += len(keys[-1])
            if held >= PAIRS:
                yield np.concatenate(keys), np.concatenate(owners)
                keys, owners, held = [], [], 0
    if held:
        yield np.concatenate(keys), np.concatenate(owners)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _wide(rows: np.ndarray, ranks: np.ndarray, n: int, nothing: int) -> np.ndarray:
    """A matrix of each row's ranks, filled up with ``nothing``."""
    order = np.argsort(rows, kind="stable")
    rows, ranks = rows[order], ranks[order]
    count = np.bincount(rows, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), nothing, np.int32)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)] = ranks
    return out


def _meeting(asked: list[str], titles: list[str], share: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(who, whom, common characters) of asked titles and those that may be like them, and which asked ones must be compared with all.

    ``share`` and ``held``: the part of both lengths' sum that two must have in common, for each asked one and each title. Who has n characters in common
    at least shares two of those that come first in an order for all, the last n - 2 left out; characters that one side lacks are none.
    Titles are looked up by these twos; where that gives more than comparing with all would take, all are compared.
    """
    (r, a), (q, b) = _tokens(asked), _tokens(titles)
    known, count = np.unique(b, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(known))
    place = np.minimum(np.searchsorted(known, a), len(known) - 1)
    live = known[place] == a
    r, a, b = r[live], rank[place[live]], rank[np.searchsorted(known, b)]
    mine = np.isin(b, a)
    q, b = q[mine], b[mine]

    def fewest(lengths: np.ndarray, part: np.ndarray, others: np.ndarray) -> np.ndarray:
        """What a title of this length has in common at least with one that is like it, which is no shorter than that."""
        least = np.maximum(lengths * part / (1 - part), others.min())
        return np.maximum(1, np.ceil(part * (lengths + np.ceil(least - 1e-6)) - 1e-6)).astype(np.int64)

    na, nb = np.array([len(t) for t in asked], np.int64), np.array([len(t) for t in titles], np.int64)
    least_a, least_b, most = fewest(na, share, nb), fewest(nb, held, na), len(titles) // 256 + 64
    few, every, none = np.flatnonzero(least_b < 2), least_a < 2, np.zeros(0, np.int64)  # some are too short for twos
    left, right = _heads(r, a, least_a), _heads(q, b, least_b)
    size = lambda heads: sum(len(at) * m.shape[1] * (m.shape[1] - 1) // 2 for at, m in heads)
    if max(size(left), size(right)) > MOST or len(few) > most:
        return none, none, none, np.ones(len(asked), bool)
    ordered = lambda keys, owners, o: (keys[o], owners[o])
    posted = [ordered(keys, owners.astype(np.int32), np.argsort(keys, kind="stable")) for keys, owners in _pieces(right, max(1, len(known)))]
    found = [(np.repeat(np.flatnonzero(~every), len(few)), np.tile(few, int((~every).sum())))]
    for wanted, who in _pieces(left, max(1, len(known))):
        wanted, who = ordered(wanted, who, np.argsort(wanted, kind="stable"))
        at = [(np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")) for keys, _ in posted]
        every |= np.bincount(who, sum((hi - lo for lo, hi in at), np.zeros(len(who), np.int64)), minlength=len(asked)) > most
        pairs = []
        for (lo, hi), (_, owners) in zip(at, posted):
            fits = np.flatnonzero((hi > lo) & ~every[who])
            n = (hi - lo)[fits]
            part = np.cumsum(n) // PAIRS
            for y in np.split(np.arange(len(fits)), np.flatnonzero(np.diff(part)) + 1):
                spread = np.repeat(lo[fits[y]] - (np.cumsum(n[y]) - n[y]), n[y]) + np.arange(n[y].sum())
                pairs.append(_distinct(np.repeat(who[fits[y]], n[y]) * len(titles) + owners[spread]))
        if pairs:
            found.append(np.divmod(_distinct(np.concatenate(pairs)), len(titles)))
    who, whom = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    who, whom = who[~every[who]], whom[~every[who]]
    theirs, ours = _wide(r, a, len(asked), -1), _wide(q, b, len(titles), -2)
    common, step = np.zeros(len(who), np.int64), max(1, PAIRS // ours.shape[1])
    for x in range(0, len(who), step):
        mine, other = theirs[who[x : x + step]], ours[whom[x : x + step]]
        for k in range(mine.shape[1]):
            common[x : x + step] += (other == mine[:, k, None]).any(1)
    return who, whom, common, every


def _closest(targets: pd.DataFrame, posts: pd.DataFrame, least: float) -> Iterator[tuple]:
    """(_ord, score, position, url) of the best post of each target that has one; posts that may be like it are compared from the highest bound down, as long as one can win."""
    if not len(posts) or not len(targets):
        return
    posts = posts.sort_values("position", kind="stable")
    titles, places, addresses, times = posts["h"].tolist(), posts["position"].tolist(), posts["url"].tolist(), posts["hts"].fillna(0.0).to_numpy(np.float64)
    asked, since, ords = targets["t"].tolist(), targets["ts"].fillna(0.0).to_numpy(np.float64), targets["_ord"].tolist()
    lengths, sizes = np.array([len(t) for t in titles], np.int64), np.array([len(t) for t in asked], np.int64)
    needed = lambda when, others: (least - np.where((when > 0) & (others > 0).any(), NEAR_TIMES[0][1], 0.0)) / 2
    who, whom, common, every = _meeting(asked, titles, needed(since, times), needed(times, since))

    def near(ts: np.ndarray, hts: np.ndarray) -> np.ndarray:
        bonus = np.zeros(len(hts))
        for seconds, x in reversed(NEAR_TIMES):
            bonus[(ts > 0) & (hts > 0) & (np.abs(hts - ts) <= seconds)] = x
        return bonus

    def best(k: int, able: np.ndarray, bound: np.ndarray, bonus: np.ndarray) -> Iterator[tuple]:
        high, at = least, -1
        for x in np.argsort(-bound, kind="stable").tolist():
            if bound[x] < high - 1e-9:
                break
            i = int(able[x])
            score = SequenceMatcher(None, asked[k], titles[i]).ratio() + float(bonus[x])
            if score > high or (score == high and (at < 0 or i < at)):
                high, at = score, i
        if at >= 0:
            yield ords[k], high, places[at], addresses[at]

    bonus = near(since[who], times[whom])
    bound = 2 * common / (sizes[who] + lengths[whom]) + bonus
    able = np.flatnonzero(bound >= least - 1e-9)
    able = able[np.argsort(who[able], kind="stable")]
    for part in np.split(able, np.flatnonzero(np.diff(who[able])) + 1):
        if len(part):
            yield from best(int(who[part[0]]), whom[part], bound[part], bonus[part])
    letters = _Letters(titles) if every.any() else None
    for k in np.flatnonzero(every).tolist():
        bonus = near(np.broadcast_to(since[k], len(times)), times)
        bound = 2 * letters.shared(asked[k]) / (sizes[k] + lengths) + bonus
        able = np.flatnonzero(bound >= least - 1e-9)
        yield from best(k, able, bound[able], bonus[able])


def history_titles(targets: DataFrame, history: DataFrame, least: float = 0.62) -> DataFrame:
    """(_ord, url): the account's article whose title is most like the target's, with a bonus for near times; the first of equals wins.

    Targets (account, _ord, title, published_ts) and history (account, position, title, published_ts, url). A loose ratio leaves nearly all pairs of an
    account possible, so pairs are never rows: an account's targets and history are dealt into blocks by a hash, each block of targets meets each block of
    history in a task, and what leaves it is one row a target. There titles are looked up by two of their rarer characters, and where those are common (few
    letters, titles of hundreds of characters) a bound over the whole block tells whom to compare: that grows with targets times history.
    Rows travel once for each block of the other side.
    """
    plain = F.regexp_replace(F.lower(F.trim(T.text("title"))), TITLE_MARKS, "")
    a = targets.select("account", "_ord", plain.alias("t"), F.col("published_ts").cast("double").alias("ts")).where("t <> '' and account is not null")
    b = history.select("account", "position", plain.alias("h"), F.col("published_ts").cast("double").alias("hts"), "url").where("h <> '' and account is not null")
    blocks = lambda df, size, name: df.groupBy("account").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = blocks(a, TARGETS, "na").join(blocks(b, POSTS, "nb"), "account")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = a.join(sizes, "account").withColumn("x", F.pmod(F.xxhash64("_ord"), "na").cast("int")).withColumn("y", every("nb")).select("account", "x", "y", "_ord", "t", "ts")
    posts = b.join(sizes, "account").withColumn("y", F.pmod(F.xxhash64("position", "url"), "nb").cast("int")).withColumn("x", every("na")).select("account", "x", "y", "position", "h", "hts", "url")
    kinds, keys = dict(asks.dtypes) | dict(posts.dtypes), ["account", "x", "y"]
    parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: Spark would merge blocks into a task

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_closest(left, right, least)), columns=["_ord", "score", "position", "url"])

    found = asks.repartition(parts, *keys).groupBy(*keys).cogroup(posts.repartition(parts, *keys).groupBy(*keys)).applyInPandas(compare, f"_ord {kinds['_ord']}, score double, position {kinds['position']}, url string")
    best = found.groupBy("_ord").agg(F.max_by(F.struct("url"), F.struct("score", -F.col("position"))).alias("m"))
    return best.select("_ord", "m.url")


def cautious(df: DataFrame, fields: tuple[str, ...] = ("summary", "opportunity_reason", "entry_point")) -> DataFrame:
    """Amounts, dates and names in narratives that no verified fact bears out are replaced by a remark.

    Needs the verified budget, published, deadline, owner, province and city, and the claimed_<name> of the last three.
    """
    import re

    money, date = re.compile(r"([0-9]+(?:[,.][0-9]+)*)\s*(亿元|万元|万|元)"), re.compile(r"(20\d{2})[年./-](\d{1,2})[月./-](\d{1,2})日?")
    unit = {"亿元": 1e8, "万元": 1e4, "万": 1e4, "元": 1.0}

    def amount(text: str | None) -> float | None:
        m = money.search(text or "")
        return float(m[1].replace(",", "")) * unit[m[2]] if m and m[1].count(".") < 2 else None

    def day(text: str | None) -> tuple | None:
        m = date.search(text or "")
        return tuple(map(int, m.groups())) if m else None

    def told(text: str | None, budget: str | None, published: str | None, deadline: str | None, *names: str | None) -> str:
        known, days = amount(budget), {d for d in (day(published), day(deadline)) if d}
        text = money.sub(lambda m: m[0] if budget and amount(m[0]) == known else "金额待核实", text or "")
        text = date.sub(lambda m: m[0] if day(m[0]) in days else "日期待核实", text)
        for claimed, proven in zip(names[::2], names[1::2]):
            if claimed and not proven:
                text = text.replace(claimed, "待核实")
        return text

    facts_ = ["budget", "published", "deadline", *(c for n in ("owner", "province", "city") for c in (f"claimed_{n}", n))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [pdf[c] for c in facts_]
            yield pdf.assign(**{f: [told(*row) for row in zip(pdf[f], *values)] for f in fields})

    return df.mapInPandas(run, df.schema)


def lookup_query(title: Column | str) -> Column:
    """The search that looks for a candidate's own sources. Its words."""
    return F.concat(F.lit('"'), T.text(title), F.lit('" 官方 招标 采购 公告 企业采购平台 企业官网 最新公告'))


def found_sources(results: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` results of each candidate's search (project_key, position, url, ...), one an address but for a closing slash.

    Both windows run on one deal of the rows by project_key, in tasks of a bounded number of rows.
    """
    page = F.regexp_replace(F.trim(T.text("url")), "/+$", "")
    first = Window.partitionBy("project_key", "_page").orderBy("position")
    rows = dealt(results, "project_key").withColumn("_page", page).where("_page <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_page")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("project_key").orderBy("position"))).where(F.col("_n") <= most).drop("_n")


def with_tool_sources(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates that an answer lists, and what its search tool returned besides: sources (url, title, snippet) at no candidate's address."""
    mine = candidates.select(urls.fetch_url("url").alias("_page")).distinct()
    more = sources.withColumn("_page", urls.fetch_url("url")).where("_page <> ''").join(mine, "_page", "left_anti").dropDuplicates(["_page"])
    return candidates.unionByName(more.select(T.text("title").alias("title"), "url", F.col("snippet").alias("summary"), F.lit("ai_search").alias("discovery_method")), allowMissingColumns=True)

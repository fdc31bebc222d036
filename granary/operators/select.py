"""Selections with diversity: caps, quotas and round robin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import Limits
from ..tables import scratch, stored


def _walk(pdf: pd.DataFrame, total: int, per_group: int, per_category: int, unknown: int) -> pd.DataFrame:
    groups: dict = {}
    categories: dict = {}
    undated, out = 0, []
    for o, g, c, dated in pdf.sort_values("_rank")[["_ord", "source_group", "news_category", "_dated"]].itertuples(index=False):
        if len(out) == total:
            break
        if groups.get(g, 0) >= per_group or categories.get(c, 0) >= per_category or (not dated and undated >= unknown):
            continue
        groups[g], categories[c], undated = groups.get(g, 0) + 1, categories.get(c, 0) + 1, undated + (not dated)
        out.append(o)
    return pd.DataFrame({"_ord": out, "selected": range(1, len(out) + 1)}, dtype="int64")


def capacity(df: DataFrame, limits: Limits = Limits(), order: list | None = None, scope: list[str] | None = None) -> DataFrame:
    """Greedy acceptance by rank under total, group, category and unknown-date caps; skipped rows use up nothing.

    The walk is sequential, but it never needs more than the first ``total`` rows of each (group, category, dated or
    not): only those go into it. That bounds a scope's walk by its groups and categories, not its rows.
    """
    scope = scope or []
    order = order or [F.desc("quality_score"), F.asc("_ord")]
    per_category = max(1, (limits.national + 2) // 3)
    keyed = df.withColumn("_dated", F.col("published_ts") != 0).withColumn("_scope", F.concat_ws("|", *scope) if scope else F.lit(""))
    near = Window.partitionBy("_scope", "source_group", "news_category", "_dated").orderBy(*order)
    few = keyed.withColumn("_near", F.row_number().over(near)).where(F.col("_near") <= limits.national)
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy("_scope").orderBy(*order)))
    total, group, unknown = limits.national, limits.per_group, limits.unknown_dates
    chosen = ranked.select("_scope", "_ord", "_rank", "source_group", "news_category", "_dated").groupBy("_scope").applyInPandas(lambda pdf: _walk(pdf, total, group, per_category, unknown), "_ord long, selected long")
    return df.join(F.broadcast(chosen) if not scope else chosen, "_ord")


def _turns(queues: dict, order: list, taken: set, picked: list, count: int, turn: int) -> list:
    """One turn: each group in order gives its first row whose uid nobody has given. Returns the groups that gave one."""
    gave = []
    for name in order:
        if len(picked) == count:
            break
        row = next((r for r in queues[name] if r[0] not in taken), None)
        if row is not None:
            taken.add(row[0])
            picked.append((row[1], turn, name))
            gave.append(name)
    return gave


def round_robin(df: DataFrame, count: int, now: float, group: str = "skill_name", max_age_days: int = 15) -> DataFrame:
    """Groups in order of appearance take turns with their best row that is not too old and whose uid no group has given yet; newest first.

    Rows without a group are one group. A uid may stand in several groups; who comes first gives it. The turns are few and small: no group needs more than its
    first ``2 * count`` uids, since ``count`` rows are given in all; and groups are looked at ``count`` at a time, in order of appearance,
    those apart whose uids have all been given. Each look gives one row at least, mostly all of them.
    """
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    name = F.when(T.text(group) == "", "default").otherwise(F.col(group))
    own = df.select(name.alias("_group"), "uid", "_ord", "vendor_hit", "score", "published_ts")
    first = own.groupBy("_group").agg(F.min("_ord").alias("_first"))
    eligible = own.where((F.col("published_ts") <= 0) | (now - F.col("published_ts") <= max_age_days * 86400))
    best = [F.desc("vendor_hit"), F.desc("score"), F.asc("_ord")]
    unique = eligible.withColumn("_n", F.row_number().over(Window.partitionBy("_group", "uid").orderBy(*best))).where("_n = 1")
    short = unique.withColumn("_n", F.row_number().over(Window.partitionBy("_group").orderBy(*best))).where(F.col("_n") <= 2 * count)
    short = stored(short.join(first, "_group").select("_first", "_n", "uid", "_ord"), folder, "queues")
    taken, picked, queues, active, last = set(), [], {}, [], None
    while len(picked) < count:  # the first turn; no more than ``count`` groups' rows at a time
        rest = short if last is None else short.where(F.col("_first") > last)
        rest = rest.where(~F.col("uid").isin(list(taken))) if taken else rest
        heads = rest.select("_first").distinct().orderBy("_first").limit(count)
        rows = rest.join(F.broadcast(heads), "_first").orderBy("_first", "_n").collect()
        if not rows:
            break
        last, block = rows[-1]["_first"], {}
        for r in rows:
            block.setdefault(r["_first"], []).append((r["uid"], r["_ord"]))
        active += _turns(block, sorted(block), taken, picked, count, 1)
        queues |= block
    turn = 2
    while active and len(picked) < count:
        active = _turns(queues, active, taken, picked, count, turn)
        turn += 1
    chosen = spark.createDataFrame([(o, i) for i, (o, _, _) in enumerate(picked)], "_ord long, _pick int")
    return df.join(F.broadcast(chosen), "_ord").orderBy(F.desc("published_ts"), "_pick").drop("_pick")


def two_source_quota(df: DataFrame, count: int, first: str, second: str, source: str = "source_key") -> DataFrame:
    """Half from each of two sources (an odd one to the second), then others, then what is left; placeholders last."""
    order = [F.col("placeholder").cast("int").asc(), F.desc("score"), F.asc("_ord")]
    place = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    quota = F.when(F.col(source) == first, count // 2).when(F.col(source) == second, count - count // 2).otherwise(0)
    classed = df.withColumn("_place", place).where(F.col("_place") <= count)
    tier = F.when(F.col("placeholder"), 3).when(F.col("_place") <= quota, 0).when(~F.col(source).isin(first, second), 1).otherwise(2)
    return classed.withColumn("_tier", tier).orderBy("_tier", F.desc("score"), "_ord").limit(count).orderBy(F.desc("score"), "_ord").drop("_place", "_tier")


def final_ranking(df: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """What needs a report first, then by score, then in order of ``_turn``; rows past the limit, of each ``by``, get a reason.

    Only the first ``limit`` rows of each part go through the ranking, which Spark prunes before the shuffle.
    """
    order = [(~F.col("needs_report")).cast("int"), F.desc("final_score"), F.col("_turn")]
    place = F.row_number().over(Window.partitionBy(*(by or (F.lit(0),))).orderBy(*order))
    top = df.withColumn("_n", place).where(F.col("_n") <= limit).select(*by, "_ord", F.col("_n").alias("place"))
    return df.join(F.broadcast(top), [*by, "_ord"], "left").withColumn("drop_reason", F.when(F.col("place").isNotNull(), "").otherwise("ranking_limit"))


def scope_fallback(pool: DataFrame, everything: DataFrame, limit: int, local_skill: str = "本地项目") -> DataFrame:
    """The local pool, or where that is empty the three best rows of all: local source, newest, best score."""
    best = everything.orderBy(F.desc((F.col("skill_name") == local_skill).cast("int")), F.desc("published_ts"), F.desc("score"), "_ord").limit(3)
    return pool.limit(limit) if pool.take(1) else best

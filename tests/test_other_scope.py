"""The other-scope day against plain Python over its filtered rows."""

from __future__ import annotations

import re

import stories
from pyspark.sql import functions as F

from granary import lexicon as L
from granary import queries
from granary.functions import text as T
from granary.operators import classify, filters, score


def test_other_scope_day_runs_the_whole_plan(spark, monkeypatch):
    df = spark.createDataFrame(stories.rows(400), stories.SCHEMA).repartition(5)
    monkeypatch.setattr(queries, "articles", lambda *_: df)
    a = df.withColumns({"region_scope": F.lit("discover"), "skill_name": F.when(F.col("_ord") % 2 == 0, "知乎发现").otherwise("B站发现")})
    both = F.concat_ws(" ", "title", "summary")
    vendor, bidding = T.any_of(F.concat_ws(" ", both, F.col("source_name")), L.VENDORS), T.any_of(both, L.BIDDING) | (F.col("skill_name") == "招投标")
    scored = filters.filter_relevant(a, queries.LOCAL_REGIONS).withColumns({"vendor_hit": vendor, "demand_signal": classify.demand_signal(both, queries.LOCAL_REGIONS)})
    scored = scored.withColumn("score", score.article_score(queries.NOW, F.col("demand_signal"), F.col("vendor_hit"), bidding, T.any_of(F.col("source_name"), L.TRUSTED)))
    found = scored.orderBy("_ord").collect()
    kept, titles = [], []
    for r in found:
        t = re.sub(r"\s+", "", r.title)
        if not any(sum(c in k for c in t) / max(len(t), len(k)) > 0.6 for k in titles):
            kept.append(r)
            titles.append(t)
    groups = {}
    for r in kept:
        groups.setdefault(r.skill_name, [])
        if r.published_ts <= 0 or queries.NOW - r.published_ts <= 15 * 86400:
            groups[r.skill_name].append(r)
    for g in groups.values():
        g.sort(key=lambda r: (-r.vendor_hit, -r.score, r._ord))
    turns = [(i, n, g[i]) for n, g in enumerate(groups.values()) for i in range(len(g))]
    taken = sorted(turns, key=lambda x: x[:2])[: queries.LIMITS.discover]
    want = [r._ord for i, n, r in sorted(taken, key=lambda x: (-x[2].published_ts, x[0], x[1]))]
    got = queries.other_scope_day(spark, "").collect()
    assert [r._ord for r in got] == want and 0 < len(want) < len(found)
    assert {r._ord: r.score for r in got} == {r._ord: r.score for r in kept if r._ord in want}

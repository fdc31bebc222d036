"""The history match against a plain loop, and on a page that all rows share."""

from __future__ import annotations

import random
import time

from granary.operators import history

SCHEMA = "project_key string, title string, owner string, city string, pages array<string>"


def plain(items, index):
    out = []
    for o, key, title, owner, city, pages in items:
        fits = lambda a, b: not a or not b or a == b
        near = [i for i, _, t, w, c, p in index if (set(pages or ()) & set(p or ()) or (t or "") == (title or "")) and fits(owner, w) and fits(city, c)]
        keyed = [i for i, k, *_ in index if key is not None and k == key]
        if keyed or near:
            out.append((o, min(keyed or near)))
    return sorted(out)


def test_match_equals_the_plain_loop(spark):
    rng = random.Random(5)
    row = lambda i, keys: (i, rng.choice(["k%d" % rng.randint(0, keys), None]), rng.choice(["a", "b", "c", "d", "", None]), rng.choice(["", None, "x", "y", "*", "="]), rng.choice(["", "n", "m", None]), rng.choice([None, [], ["p1"], ["p2", "p3"], ["p1", None]]))
    items, index = [row(i, 40) for i in range(150)], [row(i, 40) for i in range(60)]
    for left, right in ((items, index), (items, index[:7]), (items, [])):
        got = history.match(spark.createDataFrame(left, "_ord long, " + SCHEMA), spark.createDataFrame(right, "index_ord long, " + SCHEMA))
        want = plain([(*r[:5], [p for p in r[5] or () if p]) for r in left], right)
        assert sorted(map(tuple, got.collect())) == want


def test_a_page_that_all_rows_share_costs_no_pairs(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("id", "'k' || id as project_key", "'t' || id as title", "'o' || id % 7 as owner", "'' as city", "array('https://p.cn/') as pages")
    index = rows.selectExpr("id as index_ord", "'x' || id as project_key", "'u' || id as title", "owner", "city", "pages")
    began = time.perf_counter()
    got = history.match(rows.withColumnRenamed("id", "_ord"), index).where("index_ord <> _ord % 7").count()
    assert got == 0 and time.perf_counter() - began < 60

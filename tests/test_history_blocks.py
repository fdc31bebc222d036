"""Titles of an account meet in blocks: no row a pair, the same best match whatever the blocks."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np

from granary.operators import research as R

LEFT, RIGHT = "account string, _ord long, title string, published_ts double", "account string, position int, title string, published_ts double, url string"


def test_blocks_find_what_the_plain_loop_finds(spark, monkeypatch):
    rng = random.Random(8)
    title = lambda: "".join(rng.choice("abcdefgh仓储") for _ in range(rng.choice([0, 3, 9, 14, 70, 140])))
    when = lambda: rng.choice([0.0, 1e6 + rng.randint(0, 9) * 43_200.0])
    history = [(rng.choice("xy"), i, title(), when(), f"u{i}") for i in range(60)]
    change = lambda t: "".join(c for c in t if rng.random() > 0.25)
    targets = [(rng.choice("xy"), i, rng.choice([title(), change(rng.choice(history)[2])]), when()) for i in range(50)] + [(None, 99, "abc", 0.0)]
    want = []
    for account, o, t, ts in targets:
        best, url = 0.0, ""
        for other, _, h, hts, u in history:
            score = SequenceMatcher(None, t, h).ratio() if other == account and t and h else 0.0
            if score and ts > 0 and hts > 0:
                score += 0.2 if abs(ts - hts) <= 86400 else 0.1 if abs(ts - hts) <= 3 * 86400 else 0.0
            if score > best:
                best, url = score, u
        if best >= 0.62:
            want.append((o, url))
    monkeypatch.setattr(R, "TARGETS", 7)
    monkeypatch.setattr(R, "POSTS", 5)
    got = R.history_titles(spark.createDataFrame(targets, LEFT), spark.createDataFrame(history, RIGHT).repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(want) and 5 < len(want) < 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "token" not in plan and "FlatMapCoGroupsInPandas" in plan


def test_bound_is_never_below_what_matches():
    rng = random.Random(9)
    titles = ["".join(rng.choice("abc智\0") for _ in range(rng.randint(1, 150))) for _ in range(200)]
    letters = R._Letters(titles)
    for t in titles[:40]:
        matched = np.array([sum(m.size for m in SequenceMatcher(None, t, h).get_matching_blocks()) for h in titles])
        assert (letters.shared(t) >= matched).all()

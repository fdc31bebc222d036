"""Turns between groups against the plain loop, with rows without a group and uids in several groups."""

from __future__ import annotations

import random

import pytest

from granary.operators import select

NOW = 1_000_000_000.0
SCHEMA = "_ord long, skill_name string, uid string, vendor_hit boolean, score double, published_ts double"


def plain(rows, count):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "default", []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[3], r[4]), reverse=True)
    picked, taken, at, stalls = [], set(), dict.fromkeys(groups, 0), 0
    while len(picked) < count and stalls < len(groups) + 1:
        any_ = False
        for name in groups:
            if len(picked) >= count:
                break
            i = at[name]
            while i < len(groups[name]):
                r = groups[name][i]
                i += 1
                if r[2] not in taken and not (r[5] > 0 and (NOW - r[5]) / 86400 > 15):
                    picked.append(r)
                    taken.add(r[2])
                    any_ = True
                    break
            at[name] = i
        stalls = 0 if any_ else stalls + 1
    return [r[0] for r in sorted(picked, key=lambda r: r[5], reverse=True)]


@pytest.mark.parametrize(("seed", "n", "groups", "uids", "count"), [(1, 200, 5, 60, 18), (2, 200, 5, 400, 18), (3, 300, 120, 9, 12), (4, 40, 30, 6, 12), (5, 100, 3, 20, 50), (6, 500, 200, 40, 24)])
def test_turns_equal_the_plain_loop(spark, seed, n, groups, uids, count):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "default", *(f"g{j}" for j in range(groups))]), f"u{rng.randrange(uids)}", rng.random() < 0.3, rng.randint(0, 4) / 4, rng.choice([0.0, NOW - rng.randint(0, 20) * 86400.0])) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert [r._ord for r in select.round_robin(df, count, NOW).collect()] == plain(rows, count)


def test_groups_whose_uids_are_all_given_are_passed_over(spark):
    rows = [(i, f"g{i}", "one", False, 0.5, 0.0) for i in range(100)] + [(100, "last", "two", False, 0.5, 0.0)]
    assert sorted(r._ord for r in select.round_robin(spark.createDataFrame(rows, SCHEMA), 5, NOW).collect()) == [0, 100]


def test_nothing(spark):
    assert select.round_robin(spark.createDataFrame([], SCHEMA), 5, NOW).count() == 0

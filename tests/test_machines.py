"""Machines on streams against their batch forms, micro-batch by micro-batch; and what timers tell when nothing comes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.streaming import machines, states

HOUR = 3600.0


def streamed(spark, rows, schema, machine, tmp_path, batches=4, tail=None):
    """Rows in order of time, in so many files, one a micro-batch; ``tail`` rows of other keys move the watermark on, in two more."""
    rows = sorted(rows, key=lambda r: (r[2], r[1]))
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + ([tail[:1], tail[1:]] if tail else [])
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    name = "m" + str(abs(hash(str(tmp_path))))
    machine(df).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    spark.conf.set(*machines.STORE)
    yield
    spark.conf.unset(machines.STORE[0])


def times(seed, n=60, keys="abc", step=5 * HOUR):
    rng, out, at = random.Random(seed), [], 1_000_000.0
    for i in range(n):
        at += rng.random() * step
        out.append((rng.choice(keys), i, at))
    return out, rng


def test_cooldowns_and_flights_equal_their_batch_forms(spark, tmp_path):
    rows, rng = times(1)
    schema = "key string, seq long, ts double"
    got = streamed(spark, rows, schema, machines.alert_cooldown, tmp_path / "a")
    assert sorted(got) == sorted(tuple(r) for r in states.alert_cooldown(spark.createDataFrame(rows, schema)).collect())
    rows = [(*r, rng.random() * 12 * HOUR) for r in rows]
    schema += ", seconds double"
    got = streamed(spark, rows, schema, machines.single_flight, tmp_path / "b")
    assert sorted(got) == sorted(tuple(r) for r in states.single_flight(spark.createDataFrame(rows, schema)).collect()) and 10 < sum(r[2] for r in got) < 60


def test_waits_move_on_and_end(spark, tmp_path):
    rows, rng = times(2, 20, step=400)
    rows = [(*r, rng.choice([30, 200, 900, None])) for r in rows]
    schema = "key string, seq long, ts double, seconds int"
    end = rows[-1][2] + 10_000
    got = streamed(spark, rows, schema, machines.blocked_until, tmp_path, tail=[("z", 99, end, 60), ("z", 100, end + 1, 60)])
    want = sorted((r.key, r.seq, r.until) for r in states.blocked_until(spark.createDataFrame(rows, schema)).collect())
    assert sorted(r[:3] for r in got if r[1] is not None and r[0] != "z") == want
    last = {}
    for k, _, until in want:
        last[k] = max(until, last.get(k, 0))
    over = {r[0]: r[2] for r in got if r[3]}
    assert over == last


def test_signals_are_told_once_they_have_lasted_without_another_row(spark, tmp_path):
    rows, rng = times(3)
    rows = [(*r, rng.random() < 0.8) for r in rows]
    schema = "key string, seq long, ts double, active boolean"
    end = rows[-1][2] + 100 * HOUR
    got = streamed(spark, rows, schema, lambda df: machines.persistent_signals(df, 6 * HOUR), tmp_path, tail=[("z", 900, end, False), ("z", 901, end + 1, False)])
    batch = {(r.key, r["since"]) for r in states.persistent_signals(spark.createDataFrame(rows, schema), 6 * HOUR).collect()}
    told = [(r[0], r[2]) for r in got]
    assert len(set(told)) == len(told) and batch <= set(told)
    last = {r[0]: r for r in sorted(rows, key=lambda r: r[2])}
    still = {k for k, r in last.items() if r[3]}
    assert still and still <= {k for k, since in set(told)}  # runs that no row ended
    assert all(r[3] - r[2] >= 6 * HOUR for r in got)


def test_health_equals_its_batch_form_and_tells_silence_without_input(spark, tmp_path):
    rows, rng = times(4, 80, keys="ab", step=6 * HOUR)
    rows = [(*r, rng.choice([0, 0, 0, 0, 1, 7]), rng.choice([0, 0, 0, 2]), r[2] - rng.choice([1.0, 60.0]) * HOUR) for r in rows]
    schema = "key string, seq long, ts double, n_good int, n_failed int, newest_ts double"
    end = rows[-1][2] + 200 * HOUR
    got = streamed(spark, rows, schema, lambda df: machines.feed_health(df, silence=12.0), tmp_path, tail=[("z", 900, end, 9, 0, end), ("z", 901, end + 1, 9, 0, end)])
    want = sorted((r.key, r.seq, r.ts, r.alert) for r in states.feed_health(spark.createDataFrame(rows, schema), silence=12.0).collect())
    assert sorted(r for r in got if r[1] is not None and r[0] != "z") == want
    assert {a for *_, a in want} == {"", "keyword", "silence", "staleness"}
    last = {r[0]: r[2] for r in sorted(rows, key=lambda r: r[2])}
    silent = {r[0]: r[2] for r in got if r[1] is None and r[3] == "silence" and r[2] > last[r[0]]}
    assert set(silent) == {"a", "b"} and all(t <= last[k] + 12 * HOUR + 1 for k, t in silent.items())


def test_warnings_fall_due_between_checks(spark, tmp_path):
    start = 1_000_000.0
    rows = [("a", 0, start, start + 20 * HOUR), ("a", 1, start + 9 * HOUR, start + 20 * HOUR), ("b", 2, start, start + 10 * HOUR), ("c", 3, start, start + 2 * HOUR), ("b", 4, start + HOUR, start + 10 * HOUR), ("c", 5, start + HOUR, start + 60 * HOUR), ("d", 6, start, start - 1)]
    schema = "key string, seq long, ts double, expiry_ts double"
    end = start + 100 * HOUR
    got = streamed(spark, rows, schema, machines.expiry_warnings, tmp_path, batches=3, tail=[("z", 90, end, end - 1), ("z", 91, end + 1, end - 1)])
    batch = sorted((r.key, r.seq, r.threshold) for r in states.expiry_warnings(spark.createDataFrame(rows, schema)).collect())
    assert sorted(r for r in got if r[1] is not None) == batch
    rest = sorted((r[0], r[2]) for r in got if r[1] is None)
    assert rest == [("a", 3.0), ("b", 3.0), ("c", 3.0), ("c", 12.0)]


def test_many_keys_share_the_state_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(machines, "BUCKETS", 4)
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(200)]), i, 1_000_000.0 + i * HOUR / 7, rng.choice([0, 0, 3]), rng.choice([0, 0, 1]), 1_000_000.0 + (i - rng.choice([1, 500])) * HOUR / 7) for i in range(2_000)]
    schema = "key long, seq long, ts double, n_good int, n_failed int, newest_ts double"
    calls = spark.sparkContext.accumulator(0)
    plain = machines._Processor.handleInputRows

    class Counted(machines._Processor):
        def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN202, N802, N803
            calls.add(1)
            yield from plain(self, key, rows, timerValues)

    monkeypatch.setattr(machines, "_Processor", Counted)
    got = streamed(spark, rows, schema, lambda df: machines.feed_health(df, silence=12.0), tmp_path, batches=2)
    want = [(r.key, r.seq, r.ts, r.alert) for r in states.feed_health(spark.createDataFrame(rows, schema), silence=12.0).collect()]
    order = lambda r: r[1]
    assert sorted((r for r in got if r[1] is not None), key=order) == sorted(want, key=order) and len({r[3] for r in want}) == 4
    assert 0 < calls.value <= 2 * 5  # two micro-batches, four buckets and that of null keys; before, once a key

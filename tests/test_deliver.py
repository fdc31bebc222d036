"""Deliveries from a stream: outcomes of the batch form, and no message twice however often a batch is played."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException

from granary.operators import delivery
from granary.streaming.deliver import ReceiptSink, deliver

SCHEMA = "key string, seq long, ts double, day string, digest string, message string, retry boolean"


def requests(n=60, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        out.append((rng.choice("ab"), i, i * 200.0, f"d{i // 30}", rng.choice(["x", "x", "y", ""]), f"m{i}", rng.random() < 0.4))
    return out


def landed(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_outcomes_are_those_of_the_batch_form(spark, tmp_path):
    rows, sent = requests(), []
    ok = lambda message: int(message[1:]) % 3 != 0

    def send(key, message):
        sent.append((key, message))
        return "" if ok(message) else "wecom_rejected"

    sink = ReceiptSink(str(tmp_path / "out"), send)
    for part in (rows[:25], rows[25:50], rows[50:]):
        deliver(landed(spark, part, str(tmp_path / "in")), sink).awaitTermination()
    told = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[6], ok(r[5])) for r in rows], "key string, seq long, ts double, day string, digest string, retry boolean, ok boolean")
    want = sorted(tuple(r) for r in delivery.deliveries(told).collect())
    got = sorted((r.key, r.seq, r.outcome, r.attempt) for r in sink.receipts(spark).collect())
    assert got == want and {"success", "failed"} <= {w[2] for w in want}
    assert len(sent) == sum(w[2] in ("success", "failed") for w in want)


@pytest.mark.parametrize("at", ["before", "after"])
def test_a_batch_that_is_played_again_sends_nothing_twice(spark, tmp_path, at):
    """The driver dies while the third message is under way: before its answer, or after."""
    rows = [("a", i, float(i), "d", f"g{i}", f"m{i}", False) for i in range(6)]
    sent, broken = [], [True]

    def send(key, message):
        sent.append(message)
        if message == "m2" and broken[0] and at == "before":
            broken[0] = False
            raise RuntimeError("the driver is gone")
        return ""

    sink = ReceiptSink(str(tmp_path / "out"), send)
    if at == "after":
        note = sink._one

        def dying(steps, name, row):
            status = note(steps, name, row)
            if row.message == "m2" and broken[0]:
                broken[0] = False
                raise RuntimeError("the driver is gone")
            return status

        sink._one = dying
    with pytest.raises(StreamingQueryException):
        deliver(landed(spark, rows, str(tmp_path / "in")), sink).awaitTermination()
    deliver(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), sink).awaitTermination()
    assert sent == [f"m{i}" for i in range(6)]
    outcomes = {r.seq: r.outcome for r in sink.receipts(spark).collect()}
    assert outcomes == {i: "unknown" if i == 2 and at == "before" else "success" for i in range(6)}


def test_a_whole_batch_played_again_changes_nothing(spark, tmp_path):
    sent = []
    sink = ReceiptSink(str(tmp_path), lambda key, message: sent.append(message) or "")
    df = spark.createDataFrame([("a", 1, 1.0, "d", "x", "m", False), ("b", 2, 1.0, "d", "", "m", False)], SCHEMA)
    for _ in range(3):
        sink(df, 0)
    assert sent == ["m"] and {r.key: r.outcome for r in sink.receipts(spark).collect()} == {"a": "success", "b": "no_new_opportunities"}
    sink(df, 1)  # the same content in the next batch is an attempt more, and a third one the last
    sink(df, 2)
    sink(df, 3)
    assert sent == ["m"] * 3

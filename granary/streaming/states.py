"""State machines over ordered signals: batch forms by windows or folds, and the same folds on streams."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lexicon import Limits
from .folds import folded, folded_stream


@dataclass
class Guard:
    """A source's cache, failures in a row, and cooldown. Times are seconds."""

    cached_at: float = 0.0
    cached_rows: int = 0
    failures: int = 0
    cooldown_until: float = 0.0

    def fresh(self, now: float, seconds: float) -> bool:
        return self.cached_rows > 0 and now - self.cached_at <= seconds

    def step(self, now: float, ok: bool, rows: int, limits: Limits = Limits()) -> str:
        """What one refresh at ``now`` gives, if a live attempt would end as told."""
        fresh = self.fresh(now, limits.cache_seconds)
        if self.cooldown_until > now:
            return "cooldown_cache" if fresh else "cooldown_skip"
        if fresh:
            return "cache"
        if ok:
            self.failures, self.cooldown_until, self.cached_at, self.cached_rows = 0, 0.0, now, rows
            return "live"
        self.failures += 1
        if self.failures >= limits.failures:
            self.cooldown_until = now + limits.cooldown_seconds
        return "degraded_cache" if self.fresh(now, limits.cache_seconds) else "failed"


def _guarded(limits: Limits):  # noqa: ANN202
    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        guard = Guard(*state)
        out = [guard.step(t, bool(o), int(r), limits) for t, o, r in zip(rows["ts"], rows["ok"], rows["rows"])]
        return (guard.cached_at, guard.cached_rows, guard.failures, guard.cooldown_until), pd.DataFrame({"outcome": out})

    return fold


def source_guard(attempts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(key, seq, ts, ok, rows) to (key, seq, outcome): each source's attempts, in order of time."""
    return folded(attempts, "key", ["ts", "seq"], ["ok", "rows"], _guarded(limits), (0.0, 0, 0, 0.0), "outcome string").select("key", "seq", "outcome")


def source_guard_stream(attempts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``source_guard`` on a stream: the guard is the key's state between batches."""
    state = "cached_at double, cached_rows int, failures int, cooldown_until double"
    return folded_stream(attempts, "key", ["ts", "seq"], ["ok", "rows"], _guarded(limits), (0.0, 0, 0, 0.0), "outcome string", state).select("key", "seq", "outcome")


def spaced(seconds: float):  # noqa: ANN201
    """Fold of times: whether each is let through, ``seconds`` after the last one that was."""

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (last,), out = state, []
        for ts in rows["ts"]:
            send = ts - last >= seconds
            last = ts if send else last
            out.append(send)
        return (last,), pd.DataFrame({"sent": out})

    return fold


def alert_cooldown(alerts: DataFrame, seconds: float = Limits().alert_seconds) -> DataFrame:
    """(key, seq, ts) to (key, seq, sent): an alert is sent unless one was sent less than ``seconds`` before; waits start at sent ones only."""
    return folded(alerts, "key", ["ts", "seq"], [], spaced(seconds), (float("-inf"),), "sent boolean").select("key", "seq", "sent")


def marker_changes(df: DataFrame) -> DataFrame:
    """(key, seq, ts, marker): rows whose marker differs from the one before."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    return df.withColumn("_last", F.lag("marker").over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col("marker"))).drop("_last")


def persistent_signals(df: DataFrame, seconds: float) -> DataFrame:
    """(key, seq, ts, active): one row per unbroken run of active signals that lasts ``seconds``, when it first does."""
    order = Window.partitionBy("key").orderBy("ts", "seq")
    runs = df.withColumn("_run", F.sum((~F.col("active")).cast("int")).over(order)).where("active")
    since = runs.withColumn("_since", F.min("ts").over(Window.partitionBy("key", "_run")))
    ripe = since.where(F.col("ts") - F.col("_since") >= seconds)
    first = ripe.withColumn("_n", F.row_number().over(Window.partitionBy("key", "_run").orderBy("ts", "seq"))).where("_n = 1")
    return first.select("key", "seq", F.col("_since").alias("since"), F.col("ts").alias("alerted_at"))


def signal_windows(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window; on a stream, windows close once the watermark passes them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


#: Hours before a credential's end at which to warn, and between checks.
WARNING_HOURS = (12.0, 3.0)
CHECK_HOURS, LEAST_HOURS, SILENCE_HOURS, RECHECK_SECONDS, BLOCK_SECONDS = 6.0, 1 / 12, 48.0, 300, 300


def check_interval_hours(hours_left: Column, warnings: tuple[float, ...] = WARNING_HOURS, usual: float = CHECK_HOURS) -> Column:
    """Hours until the next credential check: rarer while there is time, in time for the next warning, five minutes at least.

    ``hours_left`` is null where the end is unknown.
    """
    base = F.when(hours_left.isNull(), usual).when(hours_left > 24, 12.0).when(hours_left > 6, 6.0).otherwise(3.0)
    until = [F.when(hours_left > w, F.greatest(hours_left - w, F.lit(LEAST_HOURS))) for w in warnings]
    return F.when(hours_left.isNull() | (hours_left <= 0), base).otherwise(F.greatest(F.least(base, *until), F.lit(LEAST_HOURS)))


def expiry_warnings(checks: DataFrame, warnings: tuple[float, ...] = WARNING_HOURS) -> DataFrame:
    """(key, seq, ts, expiry_ts) to the warnings to send: key, seq, threshold. Each threshold warns once for each end of validity."""
    left = (F.col("expiry_ts") - F.col("ts")) / 3600
    due = checks.withColumn("_left", left).where("_left > 0").select("key", "seq", "ts", F.floor("expiry_ts").alias("_end"), F.explode(F.array(*[F.when(F.col("_left") <= w, F.lit(w)) for w in sorted(warnings, reverse=True)])).alias("threshold")).where("threshold is not null")
    first = Window.partitionBy("key", "_end", "threshold").orderBy("ts", "seq")
    return due.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("key", "seq", "threshold")


def feed_health(runs: DataFrame, least: int = 5, silence: float = SILENCE_HOURS) -> DataFrame:
    """Runs of account feeds (key, seq, ts, n_good, n_failed, newest_ts) with ``alert``: keyword, silence, staleness, or empty for none.

    Words of a failed login alert only where hardly anything else came. Runs without rows alert once that has lasted; a run with rows
    whose newest is too old is stale.
    """
    order = Window.partitionBy("key").orderBy("ts", "seq")
    word = (F.col("n_failed") > 0) & (F.col("n_good") < least)
    empty = (F.col("n_good") == 0) & ~word
    # a run that alerts by word ends before the other checks and leaves their state as it is
    checked = runs.withColumns({"_word": word, "_empty": empty})
    streak = checked.withColumn("_run", F.sum(F.when(F.col("n_good") > 0, 1).otherwise(0)).over(order))
    since = F.min(F.when(F.col("_empty"), F.col("ts"))).over(Window.partitionBy("key", "_run"))
    timed = streak.withColumn("_since", since)
    silent = F.col("_empty") & ((F.col("ts") - F.col("_since")) / 3600 >= silence)
    stale = ~F.col("_empty") & (F.col("newest_ts") > 0) & ((F.col("ts") - F.col("newest_ts")) / 3600 > silence)
    return timed.withColumn("alert", F.when(F.col("_word"), "keyword").when(silent, "silence").when(stale, "staleness").otherwise("")).drop("_word", "_empty", "_run", "_since")


def blocked_until(hits: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(key, seq, ts, seconds) of pages that asked for a robot to (key, seq, until): the end of the shared wait, which only moves on."""
    wait = F.greatest(F.coalesce("seconds", F.lit(seconds)), F.lit(60)) if "seconds" in hits.columns else F.lit(max(seconds, 60))
    order = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return hits.select("key", "seq", F.max(F.col("ts") + wait).over(order).alias("until"))


def credential_checks(requests: DataFrame, interval: float) -> DataFrame:
    """(key, seq, ts) to (key, seq, checked): a credential is checked when the last check lies ``interval`` seconds back."""
    return alert_cooldown(requests, interval).withColumnRenamed("sent", "checked")


def flights(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    """Fold of runs: whether each starts, none while another is under way."""
    (until,), out = state, []
    for ts, took in zip(rows["ts"], rows["seconds"]):
        start = ts >= until
        until = ts + took if start else until
        out.append(start)
    return (until,), pd.DataFrame({"started": out})


def single_flight(runs: DataFrame) -> DataFrame:
    """(key, seq, ts, seconds) of asked-for runs to (key, seq, started): none starts while another is under way."""
    return folded(runs, "key", ["ts", "seq"], ["seconds"], flights, (float("-inf"),), "started boolean").select("key", "seq", "started")


def next_run(ts: Column, hours: Column) -> Column:
    """Time of the next run after one that asked for so many hours: five minutes at least."""
    return ts + F.greatest(hours * 3600, F.lit(float(RECHECK_SECONDS)))


def daily_runs(days: DataFrame, at: tuple[str, ...] = ("07:00", "07:20"), zone_hours: int = 8) -> DataFrame:
    """(day) to (day, at, ts): when the scheduled runs of each day are due, in epoch seconds."""
    minutes = F.substring("at", 1, 2).cast("int") * 60 + F.substring("at", 4, 2).cast("int")
    return days.select("day", F.explode(F.array(*map(F.lit, at))).alias("at")).withColumn("ts", F.unix_timestamp(F.col("day").cast("timestamp")) + minutes * 60 - zone_hours * 3600)

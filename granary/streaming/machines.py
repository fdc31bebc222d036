"""The state machines on streams, with timers: what must be told when nothing comes is told by event time, without input.

A machine is a fold, the same that runs in batch where there is one, and what it does when a timer rings. Keys are dealt into ``BUCKETS`` buckets, which
go in parallel: a call of Spark's state interface costs some milliseconds, and so it is made once a bucket and micro-batch and not once a key. A key's
rows of a micro-batch are sorted and passed through the fold, its state lies in Spark's state store (RocksDB) between batches. Timers are
set in event time: they ring when the watermark has passed them, which other keys' rows move on. Rows that a timer gives have a null ``seq``.
Timers also clear the state of keys that have nothing more to remember, so that the store holds live keys only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..lexicon import Limits
from . import states
from .folds import Fold

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Buckets of keys. A stream keeps the number that it began with.
BUCKETS = 1024


@dataclass(frozen=True)
class Machine:
    """``fold`` over a key's rows (ts and ``values``, each a list by its name) with a state of ``kept`` columns that starts as ``start``; it gives ``out`` columns.

    ``wake(state)`` is the time of the next timer, or None. ``ring(state, time)`` gives the state after it, None to forget the key, and the
    ``out`` values of the row that it gives, or None for no row.
    """

    fold: Fold
    start: tuple
    kept: str
    values: tuple[str, ...]
    out: str
    wake: Callable[[tuple], float | None]
    ring: Callable[[tuple, float], tuple[tuple | None, tuple | None]]


class _Processor(StatefulProcessor):
    """The keys of a bucket: their states lie in the store together, and the bucket's timer is that of the key that comes next."""

    def __init__(self, machine: Machine, kind: str):
        self._machine, self._names = machine, [x.split()[0] for x in machine.out.split(", ")]
        self._schema = f"live array<struct<key {kind}, {machine.kept}>>"

    def init(self, handle) -> None:  # noqa: ANN001
        self._handle, self._state = handle, handle.getValueState("kept", self._schema)

    def _live(self) -> dict:
        return {key: tuple(state) for key, *state in self._state.get()[0]} if self._state.exists() else {}

    def _due(self, state: tuple) -> int | None:
        at = self._machine.wake(state)
        return math.ceil(at * 1000) if at is not None and math.isfinite(at) else None

    def _keep(self, live: dict) -> None:
        for at in list(self._handle.listTimers()):
            self._handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if not live:
            self._state.clear()
            return
        self._state.update(([(key, *state) for key, state in live.items()],))
        due = [at for at in map(self._due, live.values()) if at is not None]
        if due:
            self._handle.registerTimer(min(due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        pdf = pd.concat(list(rows)).sort_values(["ts", "seq"])
        codes, keys = pd.factorize(pdf["key"], use_na_sentinel=False)
        pdf = pdf.iloc[np.argsort(codes, kind="stable")]
        ends = np.cumsum(np.bincount(codes)).tolist()
        values = {c: pdf[c].tolist() for c in ("ts", *self._machine.values)}
        live, out = self._live(), {x: [] for x in self._names}
        for k, low, high in zip([None if pd.isna(k) else k for k in keys.tolist()], [0, *ends], ends):
            live[k], part = self._machine.fold(live.get(k, self._machine.start), {c: x[low:high] for c, x in values.items()})
            for x in self._names:
                out[x] += part[x].tolist()
        self._keep(live)
        yield pdf[["key", "seq", "ts"]].reset_index(drop=True).assign(**{x: pd.Series(out[x]) for x in self._names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        live, told = self._live(), []
        for k, state in list(live.items()):
            while state is not None and (at := self._due(state)) is not None and at <= until:
                state, row = self._machine.ring(state, at / 1000)
                if row is not None:
                    told.append((k, None, at / 1000, *row))
            if state is None:
                del live[k]
            else:
                live[k] = state
        self._keep(live)
        if told:
            yield pd.DataFrame(told, columns=["key", "seq", "ts", *self._names]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def run(df: DataFrame, machine: Machine, late: str = "0 seconds") -> DataFrame:
    """``machine`` over the stream ``df`` (key, seq, ts in seconds, and the machine's values): key, seq, ts and what it gives."""
    df.sparkSession.conf.set(*STORE)
    kind = df.schema["key"].dataType.simpleString()
    timed = df.select("key", "seq", "ts", *machine.values).withColumn("_at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("_at", late)
    dealt = timed.withColumn("_bucket", F.when(F.col("key").isNull(), -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).cast("int"))  # null keys by themselves: pandas holds no nulls among longs
    return dealt.groupBy("_bucket").transformWithStateInPandas(_Processor(machine, kind), f"key {kind}, seq long, ts double, {machine.out}", "append", "EventTime")


def _forget(state: tuple, at: float) -> tuple[None, None]:
    return None, None


def alert_cooldown(alerts: DataFrame, seconds: float = Limits().alert_seconds) -> DataFrame:
    """``states.alert_cooldown`` on a stream. A key whose wait is over is forgotten."""
    machine = Machine(states.spaced(seconds), (float("-inf"),), "last double", (), "sent boolean", lambda s: s[0] + seconds, _forget)
    return run(alerts, machine).where("seq is not null").select("key", "seq", "sent")


def single_flight(runs: DataFrame) -> DataFrame:
    """``states.single_flight`` on a stream. A key whose run is over is forgotten."""
    machine = Machine(states.flights, (float("-inf"),), "until double", ("seconds",), "started boolean", lambda s: s[0], _forget)
    return run(runs, machine).where("seq is not null").select("key", "seq", "started")


def blocked_until(hits: DataFrame, seconds: int = states.BLOCK_SECONDS) -> DataFrame:
    """``states.blocked_until`` on a stream of (key, seq, ts, seconds); when the wait is over, a row with null seq and ``over`` tells so."""

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (until,), out = state, []
        for ts, wait in zip(rows["ts"], rows["seconds"]):
            until = max(until, ts + max(seconds if pd.isna(wait) else wait, 60))
            out.append((until, False))
        return (until,), pd.DataFrame(out, columns=["until", "over"])

    machine = Machine(fold, (float("-inf"),), "until double", ("seconds",), "until double, over boolean", lambda s: s[0], lambda s, at: (None, (s[0], True)))
    return run(hits, machine).select("key", "seq", "until", "over")


def persistent_signals(signals: DataFrame, seconds: float) -> DataFrame:
    """``states.persistent_signals`` on a stream: key, seq, since, alerted_at, once for each unbroken run of active signals that lasts ``seconds``.

    A run that no row interrupts is told when it has lasted, whether or not a row comes then.
    """

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (since, told), out = state, []
        for ts, active in zip(rows["ts"], rows["active"]):
            if not active:
                since, told, hit = math.nan, False, False
            else:
                since = ts if math.isnan(since) else since
                hit = not told and ts - since >= seconds
                told = told or hit
            out.append((since, hit))
        return (since, told), pd.DataFrame(out, columns=["since", "hit"])

    wake = lambda s: None if math.isnan(s[0]) or s[1] else s[0] + seconds
    machine = Machine(fold, (math.nan, False), "since double, told boolean", ("active",), "since double, hit boolean", wake, lambda s, at: ((s[0], True), (s[0], True)))
    return run(signals, machine).where("hit").select("key", "seq", "since", F.col("ts").alias("alerted_at"))


def feed_health(runs: DataFrame, least: int = 5, silence: float = states.SILENCE_HOURS) -> DataFrame:
    """``states.feed_health`` on a stream: key, seq, ts, alert.

    Where no run comes at all for ``silence`` hours, or a feed's newest entry grows too old without one, a row with null seq tells it, once.
    """
    wait = silence * 3600

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        (since, newest, last, _), out = state, []
        for ts, good, failed, new in zip(rows["ts"], rows["n_good"], rows["n_failed"], rows["newest_ts"]):
            word = failed > 0 and good < least
            if good > 0:
                since = math.nan
            if word:
                alert = "keyword"
            elif good == 0:
                since = ts if math.isnan(since) else since
                alert = "silence" if (ts - since) / 3600 >= silence else ""
            else:
                alert = "staleness" if new > 0 and (ts - new) / 3600 > silence else ""
            newest, last = (new if good > 0 else newest), ts
            out.append((alert,))
        return (since, newest, last, ""), pd.DataFrame(out, columns=["alert"])

    def wake(state: tuple) -> float | None:
        since, newest, last, told = state
        if told == "silence":
            return None
        quiet = (last if math.isnan(since) else since) + wait
        return min(quiet, newest + wait + 0.001) if newest + wait >= last and newest > 0 and told != "staleness" and math.isnan(since) else max(quiet, last)

    def ring(state: tuple, at: float) -> tuple[tuple, tuple | None]:
        since, newest, last, told = state
        kind = "silence" if at >= (last if math.isnan(since) else since) + wait else "staleness"
        return (since, newest, last, kind), (kind,)

    machine = Machine(fold, (math.nan, 0.0, 0.0, ""), "since double, newest double, last double, told string", ("n_good", "n_failed", "newest_ts"), "alert string", wake, ring)
    return run(runs, machine).select("key", "seq", "ts", "alert")


def expiry_warnings(checks: DataFrame, warnings: tuple[float, ...] = states.WARNING_HOURS) -> DataFrame:
    """``states.expiry_warnings`` on a stream of (key, seq, ts, expiry_ts): key, seq, threshold.

    A warning that falls due between two checks is given when it does, with null seq. Ends of validity are forgotten once they have passed.
    """
    marks = sorted(warnings, reverse=True)

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        told, out = {tuple(x) for x in state[0]}, []
        ends = {x[0] for x in told}
        for ts, expiry in zip(rows["ts"], rows["expiry_ts"]):
            due = []
            if expiry > ts:
                end = math.floor(expiry)
                ends.add(end)
                told.add((float(end), 0.0))
                due = [w for w in marks if (expiry - ts) / 3600 <= w and (float(end), w) not in told]
                told |= {(float(end), w) for w in due}
            out.append((due,))
        return ([list(x) for x in sorted(told)],), pd.DataFrame({"thresholds": [d for (d,) in out]})

    def next_due(told: set, after: float) -> list[tuple[float, float, float]]:
        """(time, end, threshold) of warnings to come; an end itself is its threshold 0."""
        ends = {e for e, w in told if w == 0.0}
        return sorted([(e - w * 3600, e, w) for e in ends for w in marks if (e, w) not in told and e - w * 3600 > after] + [(e, e, 0.0) for e in ends if e > after])

    def wake(state: tuple) -> float | None:
        due = next_due({tuple(x) for x in state[0]}, float("-inf"))
        return due[0][0] if due else None

    def ring(state: tuple, at: float) -> tuple[tuple | None, tuple | None]:
        told = {tuple(x) for x in state[0]}
        now = [(e, w) for t, e, w in next_due(told, float("-inf")) if t <= at + 0.001]
        told |= {(e, w) for e, w in now if w}
        over = {e for e, w in now if not w}
        told = {(e, w) for e, w in told if e not in over}
        given = sorted({w for e, w in now if w and e not in over}, reverse=True)
        return ([list(x) for x in sorted(told)],) if told else None, (given,) if given else None

    machine = Machine(fold, ([],), "told array<array<double>>", ("expiry_ts",), "thresholds array<double>", wake, ring)
    return run(checks, machine).select("key", "seq", F.explode("thresholds").alias("threshold"))

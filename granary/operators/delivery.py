"""Delivery of digests: intents before sends, acknowledged receipts, bounded retries, and what falls back when research fails."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.folds import folded

ATTEMPTS, RETRY_SECONDS = 3, 300


@dataclass
class Delivery:
    """State of a channel's deliveries: the digest under way, how often it was tried, when it is tried again."""

    day: str = ""
    digest: str = ""
    status: str = ""
    attempts: int = 0
    next_retry: float = 0.0

    def asked(self, ts: float, day: str, digest: str, retry: bool, attempts: int = ATTEMPTS) -> str:
        """What a request comes to without a send; empty if it is to be sent. An empty digest has nothing new to say.

        A retry needs a failed delivery that is due; one of another day has expired, one of other content is superseded.
        """
        if retry:
            if self.status != "failed" or not self.next_retry or self.next_retry > ts:
                return "idle"
            if self.day != day:
                self.status, self.next_retry = "expired", 0.0
                return "expired"
        if not digest:
            return "no_new_opportunities"
        same = self.day == day and self.digest == digest
        if retry and not same:
            self.status, self.next_retry = "superseded", 0.0
            return "superseded"
        return "retry_exhausted" if same and self.attempts >= attempts else ""

    def told(self, ts: float, day: str, digest: str, status: str, attempts: int = ATTEMPTS, wait: float = RETRY_SECONDS) -> str:
        """Keep the end of a send: success, failed, or unknown, where no answer is known and none may be asked for again."""
        before = self.attempts if self.day == day and self.digest == digest else 0
        self.day, self.digest, self.attempts, self.status = day, digest, before + 1, status
        self.next_retry = ts + wait if status == "failed" and self.attempts < attempts else 0.0
        return status

    def step(self, ts: float, day: str, digest: str, retry: bool, ok: bool, attempts: int = ATTEMPTS, wait: float = RETRY_SECONDS) -> str:
        """What one request does, if a send would end as told."""
        return self.asked(ts, day, digest, retry, attempts) or self.told(ts, day, digest, "success" if ok else "failed", attempts, wait)


def deliveries(requests: DataFrame, attempts: int = ATTEMPTS, wait: float = RETRY_SECONDS) -> DataFrame:
    """(key, seq, ts, day, digest, retry, ok) to (key, seq, outcome, attempt): each channel's requests, in order of time."""

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        d, out = Delivery(*state), []
        for ts, day, digest, retry, ok in zip(rows["ts"], rows["day"], rows["digest"], rows["retry"], rows["ok"]):
            outcome = d.step(ts, day or "", digest or "", bool(retry), bool(ok), attempts, wait)
            out.append((outcome, d.attempts))
        return (d.day, d.digest, d.status, d.attempts, d.next_retry), pd.DataFrame(out, columns=["outcome", "attempt"])

    return folded(requests, "key", ["ts", "seq"], ["day", "digest", "retry", "ok"], fold, ("", "", "", 0, 0.0), "outcome string, attempt int").select("key", "seq", "outcome", "attempt")


def digest_identity(rows: DataFrame) -> DataFrame:
    """One row, ``digest``: a fingerprint of the projects (project_key, digest_hash) of a message; empty for none."""
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "project_key", "digest_hash"))), ",")
    return rows.agg(F.when(F.count("*") > 0, F.sha2(pairs.cast("binary"), 256)).otherwise("").alias("digest"))


def receipts(delivered: DataFrame, earlier: DataFrame) -> DataFrame:
    """Receipts (project_key, digest_hash, reported_at, stage) with those of a delivery put over them; one a project, the latest."""
    both = earlier.unionByName(delivered, allowMissingColumns=True)
    latest = F.max_by(F.struct(*[c for c in both.columns if c != "project_key"]), F.struct("reported_at", "digest_hash"))
    return both.groupBy("project_key").agg(latest.alias("r")).select("project_key", "r.*")


def fallback_mode(reason: str) -> dict[str, Column]:
    """Columns of observations that stand in when research ran out of time, or of a snapshot shown again: mode and flag."""
    from .filters import unverified

    flags = F.array_distinct(F.concat(F.coalesce("risk_flags", F.array().cast("array<string>")), F.array(F.lit(reason))))
    return {"research_mode": F.when(unverified(), "preview").otherwise("fallback"), "risk_flags": flags}


def with_fallback(fresh: DataFrame, snapshot: DataFrame, rules: DataFrame, timed_out: bool) -> DataFrame:
    """The rows of a run. After a time-out the day's snapshot stands in, or the rules' rows where there is none; an empty run shows the snapshot again."""
    if timed_out:
        return (snapshot if snapshot.take(1) else rules).withColumns(fallback_mode("task_timeout"))
    if fresh.take(1) or not snapshot.take(1):
        return fresh
    return fresh.unionByName(snapshot.withColumns(fallback_mode("cached_snapshot_fallback")), allowMissingColumns=True)


def priority_counts(df: DataFrame) -> DataFrame:
    """Rows by priority A, B and WATCH, zeros included, in one row."""
    return df.agg(*[F.count_if(T.text("priority") == p).alias(f"n_{p.lower()}") for p in ("A", "B", "WATCH")])

"""Deliveries from a stream, no message twice: a sink for ``foreachBatch`` with intents, claims, and receipts by batch.

A micro-batch of requests (key, seq, ts, day, digest, message, retry) goes like this, each step a table or file in the sink's folder:

1. ``intents/batch=n``: the requests, before anything is sent.
2. ``sends/n/i``: a claim for the i-th request, a file that only one attempt can make, before it is sent; then the answer, beside it.
3. ``receipts/batch=n``: what each request came to, with the channel's state after it.
4. ``state/batch=n``: the last state of every channel.

A batch that Spark plays again goes on behind the last whole step: answers that are known are taken as they are, and a claim without an answer is of a
send whose end nobody knows. It is told as ``unknown`` and never sent again; the channel's next request may be. Which requests are sent at all
is what ``delivery.Delivery`` says: new content, retries that are due, so many attempts.

Channels' messages are few and their order counts, so the driver sends them, one partition of a micro-batch in memory at a time; states are joined by
the keys of the micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delivery import ATTEMPTS, RETRY_SECONDS, Delivery
from ..tables import Stages

STATE = "struct<day:string,digest:string,status:string,attempts:int,next_retry:double>"
RECEIPT = f"key string, seq long, ts double, digest string, outcome string, attempt int, state {STATE}, n long"


class ReceiptSink:
    """``send(key, message)`` gives an empty text if the message was taken, else a reason."""

    def __init__(self, folder: str, send: Callable[[str, str], str], attempts: int = ATTEMPTS, wait: float = RETRY_SECONDS):
        self.folder, self.send, self.attempts, self.wait = folder.rstrip("/"), send, attempts, wait

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        steps = Stages(spark, self.folder)
        intents = steps(f"intents/batch={batch_id}", lambda: batch.select("key", "seq", "ts", "day", "digest", "message", "retry"))
        before = self._before(spark, steps, batch_id)
        receipts = steps(f"receipts/batch={batch_id}", lambda: self._sent(spark, steps, batch_id, intents, before))
        last = receipts.groupBy("key").agg(F.max_by("state", "n").alias("state"))
        steps(f"state/batch={batch_id}", lambda: before.join(last.select("key"), "key", "left_anti").unionByName(last))

    def _before(self, spark: SparkSession, steps: Stages, batch_id: int) -> DataFrame:
        """Channels' states before a batch; Spark numbers batches without gaps."""
        if batch_id and steps.whole(f"state/batch={batch_id - 1}"):
            return spark.read.parquet(f"{self.folder}/state/batch={batch_id - 1}")
        return spark.createDataFrame([], f"key string, state {STATE}")

    def _sent(self, spark: SparkSession, steps: Stages, batch_id: int, intents: DataFrame, before: DataFrame) -> DataFrame:
        rows = intents.join(before, "key", "left").orderBy("key", "ts", "seq")
        out, key, channel = [], None, Delivery()
        for n, r in enumerate(rows.toLocalIterator()):
            if n == 0 or r.key != key:
                key, channel = r.key, Delivery(*r.state) if r.state else Delivery()
            outcome = channel.asked(r.ts, r.day or "", r.digest or "", bool(r.retry), self.attempts)
            if not outcome:
                outcome = channel.told(r.ts, r.day or "", r.digest or "", self._one(steps, f"sends/{batch_id}/{n}", r), self.attempts, self.wait)
            out.append((r.key, r.seq, r.ts, r.digest, outcome, channel.attempts, astuple(channel), n))
        return spark.createDataFrame(out, RECEIPT)

    def _one(self, steps: Stages, name: str, row) -> str:  # noqa: ANN001
        known = steps.noted(f"{name}.answer")
        if known is None:
            if not steps.claim(name):
                return "unknown"
            known = self.send(row.key, row.message) or "ok"
            steps.note(f"{name}.answer", known)
        return "success" if known == "ok" else "failed"

    def receipts(self, spark: SparkSession) -> DataFrame:
        """All receipts, with their batch."""
        return spark.read.parquet(f"{self.folder}/receipts")


def deliver(requests: DataFrame, sink: ReceiptSink, **trigger: bool) -> StreamingQuery:
    """Start the delivery of a stream of requests; the stream's own log lies in the sink's folder too."""
    return requests.writeStream.foreachBatch(sink).option("checkpointLocation", f"{sink.folder}/log").trigger(**(trigger or {"availableNow": True})).start()

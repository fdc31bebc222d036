"""Harmonic packing of documents into sequences of at most ``capacity`` tokens.

A document's ids are cut into whole sequences, then into powers of two down to ``grain``, and a rest
shorter than ``grain``. A piece of length l belongs to the reciprocal-capacity class
floor(capacity / l): a bin of the class takes exactly that many pieces. Because documents may be cut freely, the cuts
are chosen so that every class above the rests holds one length and wastes nothing; only the rests' classes hold lengths
that their bins' count does not fill to the end. Pieces of one class and one length fill bins of their own, so a piece's bin and place follow from its ordinal alone. Workers
number their own pieces; a prefix sum over (worker, length) counts turns these into global
ordinals, and no piece is moved. What is left in the last, unfull bin of each length is fewer than
``capacity / l`` pieces a length whatever the input's size; these are joined, cut again at sequence
ends, and end in sequences whose lengths are powers of two, which need no padding.

Nulls: a null text is an empty text, which still has its end id; a null doc_id is kept. Literals of the vocabulary's
added tokens become those tokens, as the library has it. Very long texts are cut like others, none is shortened. Repeated
rows are packed each. An empty table gives no pieces. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored, table
from .tokens import encoder, slices

#: Rows of the (worker, length) table up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long"


def cuts(n: int, capacity: int, grain: int) -> list[int]:
    """Lengths of a document's pieces."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity
    while size > grain:
        size //= 2
        if rest >= size:
            out.append(size)
            rest -= size
    return out + [rest] * (rest > 0)


def binary_cuts(n: int, capacity: int) -> list[int]:
    return cuts(n, capacity, 1)


def cut_documents(df: DataFrame, tokenizer: str, space_prefixed: bool, end_id: int, capacity: int, grain: int) -> DataFrame:
    """Pieces with the worker that made them and their ordinal there among pieces of their length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodes, tail = encoder(tokenizer, space_prefixed), np.array([end_id], "<u4").tobytes()
        worker, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(part[0].to_pylist(), encodes.encode_many(part[1].to_pylist())):
                ids, at = ids + tail, 0
                for n in cuts(len(ids) // 4, capacity, grain):
                    rows.append((doc_id, at, n, ids[4 * at : 4 * (at + n)], len(ids) // 4, worker, int(seen[n])))
                    seen[n] += 1
                    at += n
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "worker", "ordinal"]
    return df.mapInArrow(pieces, f"{_PIECE}, worker long, ordinal long")


def pack_documents(df: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", space_prefixed: bool = False, end_id: int = 1, capacity: int = 2048, grain: int = 64, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Return every piece with its ids (little-endian unsigned 32-bit), sequence_id and offset.

    ``capacity`` and ``grain`` are powers of two. ``folder`` holds the pieces while they are numbered.
    """
    if capacity & (capacity - 1) or grain & (grain - 1) or not 1 <= grain <= capacity:
        raise ValueError("capacity and grain must be powers of two, grain at most capacity")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(cut_documents(docs, tokenizer, space_prefixed, end_id, capacity, grain), folder, "pieces", "snappy")

    counts = stored(pieces.groupBy("worker", "length").agg(F.count("*").alias("n")), folder, "counts")
    earlier = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("worker", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    # one row a length: at most log2(capacity / grain) + grain of them
    totals = sorted((r["length"], r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())
    plan, first = [], 0
    for length, n in totals:
        per_bin = capacity // length
        plan.append((length, per_bin, n - n % per_bin, first))
        first += n // per_bin
    plans = F.broadcast(spark.createDataFrame(plan, "length long, per_bin long, whole long, first long")) if plan else None
    if plans is None:
        return pieces.select(*[x.split()[0] for x in _PIECE.split(", ")], F.col("start").alias("sequence_id"), F.col("start").alias("offset"))
    rank = F.col("base") + F.col("ordinal")
    numbered = pieces.join(bases, ["worker", "length"]).join(plans, "length").withColumn("rank", rank)
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    placed = numbered.where("rank < whole").select(*columns, F.expr("first + rank div per_bin").alias("sequence_id"), F.expr("(rank % per_bin) * length").alias("offset"))

    def rejoin(rest: pa.Table) -> pa.Table:
        rest, rows = rest.sort_by([("length", "descending"), ("rank", "ascending")]), []
        room, sequence, offset = binary_cuts(sum(rest["length"].to_pylist()), capacity), 0, 0
        for doc_id, start, ids, doc_tokens in zip(*(rest[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
            at = 0
            while at < len(ids):
                n = min(len(ids) - at, 4 * (room[sequence] - offset))
                rows.append((doc_id, start + at // 4, n // 4, ids[at : at + n], doc_tokens, first + sequence, offset))
                at, offset = at + n, offset + n // 4
                if offset == room[sequence]:
                    sequence, offset = sequence + 1, 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows)) or [[]] * 7
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[*columns, "sequence_id", "offset"])

    tail = numbered.where("rank >= whole").select(*columns, "rank", F.lit(0).alias("tail")).groupBy("tail").applyInArrow(rejoin, f"{_PIECE}, sequence_id long, offset long")
    return placed.unionByName(tail)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), shared_folder(spark))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

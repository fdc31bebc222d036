"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard is a sequence of frames::

    u64 length of payload | u32 masked crc of those 8 bytes | payload | u32 masked crc of payload | 0x0A

and a payload is ``u8 flags | i64 doc_id | ids``. Flag 1: ids are unsigned 16-bit, else unsigned
32-bit; flag 2: the doc_id was null. All numbers are little-endian. The crc is zlib's CRC-32,
masked as ``((crc >> 15 | crc << 17) + 0xa282ead8)`` modulo 2**32, so that a crc stored inside data
that is itself checked does not weaken it. The closing 0x0A lets Spark's own text writer place the
frames, so shards reach any file system Spark writes to, through its commit protocol.

Shards are range-partitioned: their names in order hold ascending doc_ids. The index is a Parquet
table (path, offset, length, doc_id, n_tokens, local_start, ids_crc32) and is built from the
shards themselves, every checksum verified.

A shard holds ``RECORDS`` records at most, whatever the size of the table, so that a reader can hold it; very long texts
are encoded whole, each as one record.

Nulls: a null text is an empty text; a null doc_id is kept, first. Literals of the vocabulary's added tokens become those
tokens, as the library has it. Rows with one doc_id keep the order of their texts. An empty table gives no records. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored, table
from .tokens import encoder, slices

_HEAD, _BODY, _CRC = struct.Struct("<Q"), struct.Struct("<Bq"), struct.Struct("<I")
_NARROW, _NO_ID = 1, 2
#: Records in a shard at most: 64 KB a record on average would fill the 2 GB that Spark reads as one binary value.
RECORDS = 32_768
_INDEX = "path string, offset long, length long, doc_id long, n_tokens long, local_start long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    """One frame. ``ids``: little-endian unsigned 32-bit ids."""
    if narrow:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    flags = (_NARROW if narrow else 0) | (_NO_ID if doc_id is None else 0)
    payload = _BODY.pack(flags, doc_id or 0) + ids
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked_crc(head)), payload, _CRC.pack(masked_crc(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """The doc_id and ids of the frame at an offset, and the offset after it. Raises on damage."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or _CRC.unpack_from(data, at + 8)[0] != masked_crc(head):
        raise ValueError(f"damaged frame length at offset {at}")
    end = at + 12 + _HEAD.unpack(head)[0]
    payload = bytes(data[at + 12 : end])
    if _CRC.unpack_from(data, end)[0] != masked_crc(payload):
        raise ValueError(f"damaged frame payload at offset {at}")
    flags, doc_id = _BODY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if flags & _NARROW else "<u4", offset=_BODY.size).astype("<u4")
    return None if flags & _NO_ID else doc_id, ids, end + 5


def write_records(df: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", space_prefixed: bool = True, end_id: int | None = 0, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Encode whole texts, append ``end_id`` and write the shards ``folder/part-*`` in ascending id order."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodes, tail = encoder(tokenizer, space_prefixed), b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        narrow = max(encodes.size, (end_id or 0) + 1) <= 1 << 16
        for part in slices(batches):
            done = [frame(i, ids + tail, narrow) for i, ids in zip(part[0].to_pylist(), encodes.encode_many(part[1].to_pylist()))]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["frame"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", RECORDS).text(folder)


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """Read every shard back, verify every checksum, and give the rows of the offset index."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch[0].to_pylist(), batch[1]):
                data, at, before, out = memoryview(content.as_buffer()), 0, 0, []
                while at < len(data):
                    doc_id, ids, end = unframe(data, at)
                    out.append((path, at, end - at, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                    at, before = end, before + len(ids)
                cols = list(zip(*out)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    names = [x.split()[0] for x in _INDEX.split(", ")]
    shards = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return shards.select("path", "content").mapInArrow(rows, _INDEX)


def read_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Decode the records named by rows of the index, in any order: doc_id and ids.

    Each shard meets the index rows that point into it; both are bounded by the shard's size.
    """

    def decode(key, shard, index):  # noqa: ANN001, ANN202
        if shard.empty:
            raise FileNotFoundError(key[0])
        data = memoryview(shard["content"].iloc[0])
        got = [unframe(data, int(at))[:2] for at in index["offset"]]
        return pd.DataFrame({"doc_id": pd.array([i for i, _ in got], "Int64"), "ids": [a.astype("int64") for _, a in got]})

    import pandas as pd

    shards = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    named = shards.join(wanted.select("path").distinct(), "path", "left_semi")
    return named.groupBy("path").cogroup(wanted.select("path", "offset").groupBy("path")).applyInPandas(decode, "doc_id long, ids array<long>")


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all records before. One row per shard passes through one task."""
    shards = index.groupBy("path").agg(F.sum("n_tokens").alias("n"))
    part, cut = (F.regexp_extract("path", p, 1).cast("long") for p in (r"part-(\d+)", r"-c(\d+)\.[^/]*$"))
    order = Window.orderBy(part, cut).rowsBetween(Window.unboundedPreceding, -1)
    before = shards.select("path", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shard_start"))
    return index.join(before, "path").withColumn("start", F.col("shard_start") + F.col("local_start")).drop("shard_start")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_records(table(spark, sf_dir, "documents"), f"{folder}/shards")
    index = stored(scan_records(spark, f"{folder}/shards"), folder, "index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", F.element_at(F.split("path", "/"), -1).alias("shard"), "offset", "length")

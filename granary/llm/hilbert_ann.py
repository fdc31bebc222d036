"""Approximate nearest neighbours over several shifted Hilbert orderings.

Each ordering projects the vectors on ``dims`` random orthonormal directions, adds a random shift, and sorts
them by their place on a Hilbert curve, range-partitioned in Spark. Ranks cut an ordering into blocks of
``BLOCK`` vectors. A query looks at every block that its window of ranks touches, in each ordering; block results
are merged, candidates reranked by the exact inner product in double precision.

The window is fitted, not fixed: ``SAMPLE`` queries are compared with all vectors, and the window is the rank
distance within which ``TARGET`` of their true neighbours lie in some ordering. Data with structure get narrow
windows, data without any get wide ones, and recall holds in both. The sample's recall is measured by the tests
against brute force.

Equal vectors are indexed once, with their k + 1 smallest ids, which is all that a result can hold of them, and
searched for once. Vectors that are null or zero, hold null or non-finite components or have another
length than most take no part; rows with a null id neither. Ties go to the smaller id. Rows repeated under one
id are one, with the least of their vectors. With fewer than k candidates all are returned; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored, table

SAMPLE, TARGET, BLOCK = 200, 0.97, 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points, one row each; columns times bits at most 63."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where(x[n - 1] & q, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | x[i] >> np.uint64(b) & one
    return key.astype(np.int64)


def ordering(vectors: np.ndarray, curve: int, dims: int, bits: int, scale: float) -> np.ndarray:
    """Keys of vectors in one ordering; a function of the vector and the curve's number only."""
    rng = np.random.default_rng(7_919 + curve)
    directions, _ = np.linalg.qr(rng.standard_normal((vectors.shape[1], min(dims, vectors.shape[1]))))
    place = vectors @ directions / (scale or 1.0) + rng.uniform(-1, 1, directions.shape[1])
    return hilbert_keys(np.clip((place / 10 + 0.5) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def _taking_part(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists("v", lambda x: x != 0))
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (widths["n"] if widths else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _place_rows(curves: int, dims: int, bits: int, scale: float):  # noqa: ANN202
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = _matrix(pdf["v"])
                for c in range(curves):
                    yield pd.DataFrame({"curve": c, "key": ordering(m, c, dims, bits, scale), "vid": pdf["vid"]})

    return place


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    worker, seen = TaskContext.get().partitionId(), {}
    for pdf in batches:
        for curve, part in pdf.groupby("curve", sort=False):
            at = seen.get(curve, 0)
            seen[curve] = at + len(part)
            yield pd.DataFrame({"curve": part["curve"], "vid": part["vid"], "worker": worker, "ordinal": np.arange(at, at + len(part))})


def ranked(vectors: DataFrame, folder: str, curves: int, dims: int, bits: int) -> DataFrame:
    """(curve, vid, rank): the place of each vector in each ordering."""
    scale = float(np.sqrt(vectors.select(F.avg(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x) / size(v)"))).first()[0] or 1.0))
    placed = vectors.select("vid", "v").mapInPandas(_place_rows(curves, dims, bits, scale), "curve int, key long, vid long")
    ordered = placed.repartitionByRange("curve", "key", "vid").sortWithinPartitions("curve", "key", "vid")
    numbered = stored(ordered.mapInPandas(_number, "curve int, vid long, worker int, ordinal long"), folder, "numbered")
    earlier = Window.partitionBy("curve").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy("curve", "worker").agg(F.count("*").alias("n")).select("curve", "worker", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return stored(numbered.join(base, ["curve", "worker"]).select("curve", "vid", (F.col("base") + F.col("ordinal")).alias("rank")), folder, "ranked")


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, vids: np.ndarray, k: int) -> pd.DataFrame:
    """The k largest inner products of each query; ties, up to rounding, go to the smaller vid."""
    part, power = np.frexp(queries @ vectors.T)
    scores = np.ldexp(np.round(np.ldexp(part, 40)), power - 40)
    n = min(k, len(vids))
    if n < len(vids):
        top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        least = np.take_along_axis(scores, top, 1).min(axis=1)
        for i in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > n):
            tied = np.flatnonzero(scores[i] >= least[i])
            top[i] = tied[np.lexsort((vids[tied], -scores[i, tied]))[:n]]
    else:
        top = np.tile(np.arange(n), (len(ids), 1))
    return pd.DataFrame({"qid": np.repeat(ids, n), "vid": vids[top.ravel()], "near": np.take_along_axis(scores, top, 1).ravel()})


def fitted_window(vectors: DataFrame, places: DataFrame, queries: DataFrame, k: int) -> int:
    """Rank distance that holds TARGET of the true neighbours of SAMPLE queries, from a scan of all vectors."""
    sample = queries.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).join(vectors, "vid").select("vid", "v").toPandas()
    if sample.empty:
        return 0
    asked, ids = _matrix(sample["v"]), sample["vid"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _best(asked, ids, _matrix(pdf["v"]), pdf["vid"].to_numpy(), k + 1)

    order = Window.partitionBy("qid").orderBy(F.desc("near"), "vid")
    truth = vectors.select("vid", "v").mapInPandas(scan, "qid long, vid long, near double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    theirs = truth.join(places, "vid").select("qid", "vid", "curve", "rank")
    own = F.broadcast(places.join(F.broadcast(queries.sparkSession.createDataFrame(sample[["vid"]])), "vid").select(F.col("vid").alias("qid"), "curve", F.col("rank").alias("own")))
    apart = theirs.join(own, ["qid", "curve"]).groupBy("qid", "vid").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("apart"))
    return int(np.quantile(apart.where("qid <> vid").toPandas()["apart"].to_numpy(), TARGET, method="higher")) if len(apart.where("qid <> vid").take(1)) else 0


def nearest(df: DataFrame, queries: Column, folder: str, k: int = 20, curves: int = 8, dims: int = 4, bits: int = 12, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to each row for which ``queries`` holds."""
    flagged = df.withColumn("_query", queries)
    rows = stored(_taking_part(flagged, id_col, vec_col).join(flagged.where("_query").select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("asked", F.lit(True)), "id", "left"), folder, "rows")
    same = Window.partitionBy("v").orderBy("id")
    few = rows.select("id", "v").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    vectors = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("vid", F.get("ids", 0)), folder, "vectors")
    asked = stored(rows.where("asked").join(vectors.select("v", "vid"), "v").select(F.col("id").alias("query_id"), "vid"), folder, "asked")
    wanted = asked.select("vid").distinct()
    places = ranked(vectors, folder, curves, dims, bits)
    window = fitted_window(vectors, places, wanted, k)

    members = places.withColumn("block", F.expr(f"rank div {BLOCK}")).join(vectors.select("vid", "v"), "vid").select("curve", "block", "vid", "v")
    ends = places.groupBy("curve").agg(F.max("rank").alias("last")).collect()  # one row an ordering
    last = F.coalesce(*[F.when(F.col("curve") == r["curve"], F.lit(r["last"])) for r in ends], F.lit(0).cast("long"))
    spread = F.sequence(F.expr(f"greatest(rank - {window}, 0) div {BLOCK}"), F.floor(F.least(F.col("rank") + window, last) / BLOCK))
    probes = places.join(wanted, "vid").select("curve", F.explode(spread).alias("block"), "vid").join(vectors.select("vid", "v"), "vid").select("curve", "block", F.col("vid").alias("qid"), "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "vid": [], "near": []}).astype({"qid": "int64", "vid": "int64"})
        m, vids = _matrix(right["v"]), right["vid"].to_numpy()
        parts = [_best(_matrix(left["v"][i : i + 256]), left["qid"].to_numpy()[i : i + 256], m, vids, k + 4) for i in range(0, len(left), 256)]
        return pd.concat(parts)

    probes, members = stored(probes, folder, "probes"), stored(members, folder, "members")
    found = probes.groupBy("curve", "block").cogroup(members.groupBy("curve", "block")).applyInPandas(search, "qid long, vid long, near double")
    merged = found.groupBy("qid", "vid").agg(F.max("near").alias("near"))
    order = Window.partitionBy("qid").orderBy(F.desc("near"), "vid")
    close = merged.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 4)
    dot = F.expr("aggregate(zip_with(qv, v, (a, b) -> cast(a as double) * cast(b as double)), 0D, (s, x) -> s + x)")
    scored = close.join(vectors, "vid").join(vectors.select(F.col("vid").alias("qid"), F.col("v").alias("qv")), "qid").select("qid", "ids", dot.alias("score"))
    pairs = asked.join(scored, asked["vid"] == scored["qid"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, shared_folder(spark))

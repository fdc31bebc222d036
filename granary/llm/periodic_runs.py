"""Periodic runs of words: every maximal stretch that repeats itself three times and more, and texts without the repeats.

All-lag vectorised scan: the array of word ids is compared with itself shifted by each lag p up to n / ``MIN_EXP``, blocks of lags at a
time. True stretches of L words are periodic stretches of L + p words; those of ``max(LEAST, MIN_EXP * p)`` words and more are runs,
maximal by construction. A run of smallest period q shows at multiples of q with the same borders, and only there (two periods
of a stretch that holds both have their greatest common divisor as period), so of equal borders the smallest lag stays.

Spark distributes ranges of (document, lags): a document whose lags make at most ``RANGE_WORK`` comparisons is one range and is scanned where
it lies. A longer one is dealt out, its distinct text once for each range, and a range has ``RANGE_LAGS`` lags at least, so that
comparing outweighs moving. Runs found in the ranges are reduced to the smallest lag by (text, borders) before they meet
by text, and are joined to the documents from a written table. Every lag of every document is scanned either way.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``, numbered from 0; lengths and periods are in words. A word is dropped if a
run holds it after the run's first period; the others are joined by one space. Null and empty texts have no words, no runs and an
empty collapsed text. Repeated rows get the same runs each. Very long texts are read whole. An empty table gives no rows. Other
columns pass through; ``n_words``, ``runs`` and ``collapsed`` replace columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, table

LEAST, MIN_EXP = 24, 3
#: Comparisons of a range; lags of a range of a long document, at least; comparisons of a block, which is held at once.
RANGE_WORK, RANGE_LAGS, BLOCK = 1 << 28, 1024, 1 << 19
RUN = "struct<start:int,length:int,period:int>"
SPACE = "[\\x20\\x09-\\x0D]+"


def word_ids(words: list[bytes]) -> np.ndarray:
    known: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return ids.astype(np.int16) if len(known) < 1 << 15 else ids


def scan_lags(ids: np.ndarray, low: int, high: int, least: int = LEAST, min_exp: int = MIN_EXP) -> np.ndarray:
    """Rows (start, length, period) of the stretches found at lags from ``low`` to ``high``, one for each pair of borders."""
    n, found = len(ids), []
    high = min(high, n // min_exp)
    if n < least or high < low:
        return np.zeros((0, 3), np.int64)
    shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.full(high, -1, ids.dtype)]), n)
    step = max(1, BLOCK // n)
    for at in range(low, high + 1, step):
        lags = np.arange(at, min(at + step, high + 1))
        same = shifted[at : at + len(lags)] == ids
        need = np.maximum(least - lags, (min_exp - 1) * lags)
        rows = np.flatnonzero(np.fromiter(map(np.count_nonzero, same), np.int64, len(lags)) >= need)
        if not len(rows):
            continue
        framed = np.zeros((len(rows), n + 2), bool)
        framed[:, 1:-1] = same[rows]
        row, place = np.divmod(np.flatnonzero(framed[:, 1:] != framed[:, :-1]), n + 1)
        row, start, long = row[::2], place[::2], place[1::2] - place[::2]
        enough = long >= need[rows[row]]
        lag = lags[rows[row[enough]]]
        found.append(np.stack([start[enough], long[enough] + lag, lag], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)  # by lag, so the first of equal borders has the smallest
    _, first = np.unique(runs[:, 0] * (n + 1) + runs[:, 1], return_index=True)
    return runs[np.sort(first)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(depth[:-1]) == 0
    return b" ".join([w for w, s in zip(words, stays.tolist()) if s])


def _run_lists(each: list[np.ndarray]) -> pa.ListArray:
    """Runs in order of start, then period."""
    ordered = [r[np.lexsort((r[:, 2], r[:, 0]))] for r in each]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in ordered])]).astype(np.int32)
    flat = np.concatenate([np.zeros((0, 3), np.int64), *ordered]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(offsets, values)


def _whole(least: int, min_exp: int):  # noqa: ANN202
    """text -> words, runs and collapsed text of documents of one range."""

    @F.arrow_udf(f"struct<n_words:int,runs:array<{RUN}>,collapsed:binary>")
    def whole(texts: pa.Array) -> pa.Array:
        sizes, runs, left = [], [], []
        for t in texts:
            words = t.as_py().split()
            found = scan_lags(word_ids(words), 1, len(words), least, min_exp)
            sizes.append(len(words))
            runs.append(found)
            left.append(collapse(words, found))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), _run_lists(runs), pa.array(left, pa.binary())], ["n_words", "runs", "collapsed"])

    return whole


def _ranged(least: int, min_exp: int):  # noqa: ANN202
    """text, low, high -> runs of a range of lags."""

    @F.arrow_udf(f"array<{RUN}>")
    def ranged(texts: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        return _run_lists([scan_lags(word_ids(t.as_py().split()), a, b, least, min_exp) for t, a, b in zip(texts, low.to_pylist(), high.to_pylist())])

    return ranged


def _joined():  # noqa: ANN202
    """text, runs -> collapsed text."""

    @F.arrow_udf("binary")
    def collapsed(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts, runs):
            rows = [(r["start"], r["length"], r["period"]) for r in found.as_py()]
            out.append(collapse(t.as_py().split(), np.array(rows, np.int64).reshape(-1, 3)))
        return pa.array(out, pa.binary())

    return collapsed


def periodic_runs(df: DataFrame, folder: str, text_col: str = "text", least: int = LEAST, min_exp: int = MIN_EXP, range_work: int = RANGE_WORK, range_lags: int = RANGE_LAGS) -> DataFrame:
    """All rows of ``df`` with n_words, runs (array of start, length, period, in order of start and period) and collapsed."""
    if min_exp < 2 or least < 2:
        raise ValueError("a run repeats itself twice at least")
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    most = int((min_exp * range_work) ** 0.5)  # words of a document of one range; a word and a space are two bytes at least
    short, long = own.where(F.octet_length("text") <= 2 * most), own.where(F.octet_length("text") > 2 * most)
    near = short.withColumn("got", _whole(least, min_exp)("text")).select("own", "got.*")

    keyed = long.withColumn("blob", F.unhex(F.sha2("text", 256)))
    one = keyed.groupBy("blob").agg(F.first("text").alias("text"))
    n = F.size(F.filter(F.split(F.decode("text", "UTF-8"), SPACE), lambda w: w != ""))
    sized = stored(one.select("blob", "text", n.alias("n_words")), folder, "long_texts")
    lags = F.floor(F.col("n_words") / min_exp)
    each = F.greatest(F.lit(range_lags), F.floor(F.lit(range_work) / F.greatest("n_words", F.lit(1)))).cast("long")
    ranges = sized.where(lags > 0).withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), lags, each))).withColumn("high", F.least(F.col("low") + each - 1, lags))
    dealt = ranges.repartition("blob", "low")
    parts = dealt.select("blob", F.explode(_ranged(least, min_exp)("text", "low", "high")).alias("run"))
    best = parts.groupBy("blob", "run.start", "run.length").agg(F.min("run.period").alias("period"))
    runs = best.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    runs = runs.select("blob", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    merged = sized.select("blob", "n_words").join(stored(runs, folder, "long_runs"), "blob", "left")
    merged = stored(merged.withColumn("runs", F.coalesce("runs", F.array().cast(f"array<{RUN}>"))), folder, "long_found")
    far = keyed.join(merged, "blob").select("own", "n_words", "runs", _joined()("text", "runs").alias("collapsed"))

    new = {"n_words": F.col("n_words").cast("long"), "runs": F.col("runs"), "collapsed": F.decode("collapsed", "UTF-8")}
    kept = {c: F.col("own").getField(c) for c in df.columns} | new
    return near.unionByName(far).select(*[c.alias(name) for name, c in kept.items()])


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equals the first by start, then period. Null without runs."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"].cast("long") * best["period"] > best["length"].cast("long") * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def planted(docs: DataFrame) -> DataFrame:
    """The query's texts: of one document in ten, by the CRC-32 h of its id, the words from a on repeat with a period.

    With g = floor(h / 10): a = g % n, and the period is 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def turned(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        later = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % period))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), later), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(F.array(words), turned), F.lit(0))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")), shared_folder(spark)).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = [F.col(f"best.{c}").cast("long").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("(1000L * best.length) div best.period").alias("exponent_milli")
    digests = [F.sha2(c.cast("binary"), 256).alias(name) for name, c in (("runs_sha256", lines), ("collapsed_sha256", F.col("collapsed")))]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *top, exponent, *digests)


#: Equal words of a document, by lag, in islands of consecutive places; of islands with equal borders the smallest lag.
SQL = f"""
with w0 as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
  xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten([[ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0] for c in string_split(coalesce(cast(doc_id as varchar), ''), '')])), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) as h from documents),
w1 as (select *, len(w) as n, h // 10 as g from w0),
w2 as (select *, case when n > 0 then g % n end as a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end as p from w1),
docs as (select r, doc_id, n, case when h % 10 = 0 and n > 0 then [case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end for i in range(n)] else w end as w from w2),
words as (select r, n, unnest(w) as word, unnest(range(n)) as i from docs),
pairs as (select x.r, y.i - x.i as p, x.i, x.i - row_number() over (partition by x.r, y.i - x.i order by x.i) as island from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i and {MIN_EXP} * (y.i - x.i) <= x.n),
stretches as (select r, p, min(i) as s, count(*) + p as len from pairs group by r, p, island having count(*) + p >= greatest({LEAST}, {MIN_EXP} * p)),
runs as (select r, s, len, min(p) as q from stretches group by r, s, len),
dropped as (select distinct r, unnest(range(s + q, s + len)) as i from runs),
listed as (select r, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as lines from runs group by r),
best as (select * from runs qualify row_number() over (partition by r order by cast(len as double) / q desc, s, q) = 1),
kept as (select r, string_agg(word, ' ' order by i) as t from words anti join dropped using (r, i) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, s as start, len as length, q as period, (1000 * len) // q as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from docs left join listed using (r) left join best using (r) left join kept using (r)
"""

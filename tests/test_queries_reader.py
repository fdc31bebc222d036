"""The data source over a landing zone: batch, pushed filters, whole rounds only, and the stream that goes on where it ended."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from granary.sources import queries_reader as Q

SEARCHES = [["A", "national", "k0", "l0"], ["A", "local", "k1", "l1"], ["B", "national", "k2", "l2"]]


def answer(*names, data=True):
    return json.dumps({"data": [{"title": n, "share_url": f"https://x.cn/{n}"} for n in names]} if data else {"no": 1})


@pytest.fixture
def zone(spark, tmp_path):
    Q.register(spark)
    path = str(tmp_path / "zone")
    rows = [(0, answer("a", "b", "c")), (1, answer("d")), (2, None), (2, "broken"), (2, answer(data=False)), (0, answer("e", "f"))]
    Q.land(spark.createDataFrame(rows, "search int, payload string"), path, 0)
    Q.land(spark.createDataFrame([(2, answer("g")), (7, answer("h"))], "search int, payload string"), path, 1)
    return path


def read(spark, path, count=10):
    return spark.read.format("landed_queries").option("searches", json.dumps(SEARCHES)).option("count", count).load(path)


def rows(df):
    return sorted((r.skill_name, r.region_scope, r.keyword, r.batch, r.title) for r in Q.articles(df).collect())


def test_each_search_is_a_partition(spark, zone):
    df = read(spark, zone)
    assert df.rdd.getNumPartitions() == 3
    assert rows(df) == sorted([("A", "national", "k0", 0, t) for t in "abcef"] + [("A", "local", "k1", 0, "d"), ("B", "national", "k2", 1, "g")])


def test_an_answer_gives_so_many_entries(spark, zone):
    assert [r.position for r in read(spark, zone, 2).where("keyword = 'k0'").orderBy("position").collect()] == [0, 1]


def test_filters_leave_searches_out(spark, zone):
    df = read(spark, zone).where((F.col("source") == "A") & F.col("region_scope").isin("national") & (F.col("position") > 0))
    assert df.rdd.getNumPartitions() == 1
    assert [r[4] for r in rows(df)] == ["b", "c", "e", "f"]
    reader = Q._Batch({"path": zone, "searches": json.dumps(SEARCHES)})
    left = list(reader.pushFilters([EqualTo(("source",), "B"), GreaterThan(("position",), 1), In(("keyword",), ("k2", "k9"))]))
    assert [type(f) for f in left] == [GreaterThan] and [s[2] for _, s in reader.searches] == ["k2"]


def test_the_stream_gives_what_the_batch_gives_and_goes_on(spark, zone, tmp_path):
    def drain():
        stream = spark.readStream.format("landed_queries").option("searches", json.dumps(SEARCHES)).load(zone)
        Q.articles(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(f"{tmp_path}/rows").awaitTermination()
        return sorted((r.skill_name, r.region_scope, r.keyword, r.batch, r.title) for r in spark.read.parquet(f"{tmp_path}/rows").collect())

    assert drain() == rows(read(spark, zone)) == drain()
    Q.land(spark.createDataFrame([(1, answer("late"))], "search int, payload string"), zone, 2)
    marker = tmp_path / "zone" / "batch=2" / "_SUCCESS"
    marker.unlink()  # a round that has not landed whole is not read
    assert "late" not in [r[4] for r in drain()] and "late" not in [r[4] for r in rows(read(spark, zone))]
    marker.touch()
    assert drain() == rows(read(spark, zone)) and "late" in [r[4] for r in drain()]


def test_an_empty_zone_has_no_rows(spark, tmp_path):
    Q.register(spark)
    assert read(spark, str(tmp_path / "nothing")).count() == 0

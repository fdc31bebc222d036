"""Stored days: one whole version to each reader, whoever writes meanwhile."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.sources.versions import Days

SCHEMA = "a int, day date"


def days(spark, path):
    return Days(spark, str(path), SCHEMA)


def held(df):
    return sorted((str(r.day), r.a) for r in df.collect())


def test_a_reader_keeps_its_version_while_the_next_is_written(spark, tmp_path):
    d = days(spark, tmp_path)
    assert d.read().count() == 0 and d.read("2024-03-01").count() == 0
    assert d.write(spark.createDataFrame([(1,), (2,)], "a int"), "2024-03-01") == 0
    old = d.read("2024-03-01")
    assert d.write(d.read("2024-03-01").drop("day").where("a = 2").unionByName(spark.createDataFrame([(3,)], "a int")), "2024-03-01") == 1
    assert held(old) == [("2024-03-01", 1), ("2024-03-01", 2)] and held(d.read("2024-03-01")) == [("2024-03-01", 2), ("2024-03-01", 3)]


def test_a_version_that_is_not_whole_is_not_seen(spark, tmp_path):
    d = days(spark, tmp_path)
    d.write(spark.createDataFrame([(1,)], "a int"), "2024-03-01")

    def broken(x):
        raise RuntimeError("gone")

    with pytest.raises(Exception, match="gone"):
        d.write(spark.range(3).select(F.udf(broken, "int")("id").alias("a")), "2024-03-01")
    assert held(d.read()) == [("2024-03-01", 1)]
    (tmp_path / "day=2024-03-01" / "v=7").mkdir(parents=True)
    (tmp_path / "day=2024-03-01" / "v=7" / "part-0.parquet").write_bytes(b"torn")
    assert held(d.read()) == [("2024-03-01", 1)]
    assert d.write(spark.createDataFrame([(9,)], "a int"), "2024-03-01") == 8 and held(d.read()) == [("2024-03-01", 9)]


def test_two_writers_have_versions_of_their_own(spark, tmp_path):
    a, b = days(spark, tmp_path), days(spark, tmp_path)
    a._versions = b._versions = lambda *_, **__: {}  # neither sees the other begin
    df = spark.createDataFrame([(1,)], "a int")
    assert {a.write(df, "2024-03-01"), b.write(df, "2024-03-01")} == {0, 1}


def test_days_of_other_columns_and_old_versions(spark, tmp_path):
    d = days(spark, tmp_path)
    for n in range(4):
        d.write(spark.createDataFrame([(n,)], "a int"), "2024-03-01")
    d.write(spark.createDataFrame([(5, "x")], "a int, b string"), "2024-03-02")
    got = {(str(r.day), r.a, r.b) for r in d.read().collect()}
    assert got == {("2024-03-01", 3, None), ("2024-03-02", 5, "x")}
    assert d.clean() == 2 and len(list((tmp_path / "day=2024-03-01").glob("v=*"))) == 2 and held(d.read("2024-03-01")) == [("2024-03-01", 3)]
    with pytest.raises(ValueError):
        d.read("2024-3-1")

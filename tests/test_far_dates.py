"""Days of years beyond 9999."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import dates


def test_years_of_five_digits_have_no_sign(spark):
    df = spark.createDataFrame([(86400.0 * 6_000_000,), (86400.0,), (-57600.0,)], "ts double")
    got = [r.y for r in df.select(dates.article_date(F.lit(""), F.col("ts")).alias("y")).collect()]
    assert got == ["18397-06-11", "1970-01-02", "1969-12-31"]

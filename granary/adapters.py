"""The test tables seen as articles, versions, signals and pages. Times hang on a fixed evaluation time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-03-01T00:00:00Z
NOW, YEAR = 1709251200.0, 2024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("official", "vendor", "aggregator", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("_ord"),
        F.regexp_extract("text", "^([^\\n.]*)", 1).alias("title"),
        F.substring(F.regexp_replace("text", "[ \\t\\n\\r]+", " "), 1, 200).alias("summary"),
        F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/a/"), (F.col("doc_id") - F.col("doc_id") % 3).cast("string")).alias("url"),
        F.col("source").alias("source_name"), kind.alias("source_kind"), F.lit("").alias("source_group"), F.col("source").alias("skill_name"), F.lit("").alias("region_scope"),
        F.when(F.col("doc_id") % 17 == 0, 0.0).otherwise(NOW - (F.col("doc_id") % 40) * 43200).alias("published_ts"),
        F.col("text").alias("content"), F.lit("").alias("image_url"),
    )


ARTICLES_SQL = """
select doc_id as _ord, regexp_extract(text, '^([^\n.]*)', 1) as title,
  substr(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), 1, 200) as summary,
  'https://www.' || source || '.example.com/a/' || cast(doc_id - doc_id % 3 as varchar) as url,
  source as source_name, ['official', 'vendor', 'aggregator', ''][doc_id % 4 + 1] as source_kind, '' as source_group, source as skill_name, '' as region_scope,
  case when doc_id % 17 = 0 then 0.0 else 1709251200.0 - (doc_id % 40) * 43200 end as published_ts, text as content, '' as image_url
from documents"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.create_map(*[F.lit(x) for x in ("P", "PROCUREMENT", "F", "AWARD", "O", "EARLY_SIGNAL")])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_ord"), F.col("o_custkey").cast("string").alias("project_key"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("published_ts"),
        stage[F.col("o_orderstatus")].alias("stage"), F.col("o_totalprice").alias("final_score"), (F.col("o_custkey") % 3).cast("double").alias("source_score"), F.col("o_orderpriority").alias("budget"),
        F.to_date("o_orderdate").alias("day"),
    )


VERSIONS_SQL = """
select o_orderkey as _ord, cast(o_custkey as varchar) as project_key, cast(epoch(o_orderdate) as double) as published_ts,
  case o_orderstatus when 'P' then 'PROCUREMENT' when 'F' then 'AWARD' when 'O' then 'EARLY_SIGNAL' end as stage,
  o_totalprice as final_score, cast(o_custkey % 3 as double) as source_score, o_orderpriority as budget, cast(o_orderdate as date) as day
from orders"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("marker"), (F.col("value") > 40).alias("active"), "value")


SIGNALS_SQL = """select user_id as key, event_id as seq, epoch_us(ts) as us, epoch_us(ts) / 1e6 as ts, event_type as marker, value > 40 as active, value from events"""

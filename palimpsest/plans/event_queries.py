"""Queries over events and sessions, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import streaming as St
from palimpsest.plans import sql as Q
from palimpsest.plans.catalog import query
from palimpsest.sources import adapters as A


@query("SELECT event_type AS event, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean, round(count(*) / (SELECT count(*) FROM events), 3) AS ratio FROM events GROUP BY event_type")
def log_stats(spark: SparkSession, sf: str) -> DataFrame:
    return St.log_stats(A.hook_events(spark, sf))


@query(f"SELECT event_type AS event, count(*) AS n FROM events WHERE ts >= {Q.NOW} - INTERVAL 72 HOUR GROUP BY event_type")
def log_window(spark: SparkSession, sf: str) -> DataFrame:
    return St.since(A.hook_events(spark, sf), 72).groupBy("event").agg(F.count("*").alias("n"))


@query("SELECT event_type AS event, k, count(*) AS n FROM (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events) GROUP BY ALL")
def event_fields(spark: SparkSession, sf: str) -> DataFrame:
    return A.hook_events(spark, sf).groupBy("event", "k").agg(F.count("*").alias("n"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    c = A.table(spark, sf, "conversations")
    return c.select(F.col("role").alias("session_key"), (F.lit("2024-01-01").cast("timestamp").cast("double") + F.col("conv_id") * 4 + F.col("turn")).cast("timestamp").alias("ts"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")


MESSAGES = "m AS (SELECT role AS session_key, conv_id * 4 + turn AS t, conv_id * 1000 + turn AS seq, text FROM conversations)"


@query(f"WITH {MESSAGES} SELECT session_key, seq, qhash FROM (SELECT *, md5({Q.strip('text')}) AS qhash, row_number() OVER (PARTITION BY session_key, md5({Q.strip('text')}) ORDER BY t, seq) AS n FROM m) WHERE n = 1")
def session_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return St.session_dedup(_messages(spark, sf)).select("session_key", "seq", "qhash")


@query(f"WITH {MESSAGES} SELECT session_key, seq, coalesce(t - lag(t) OVER (PARTITION BY session_key, substr(text, 1, 50) ORDER BY t, seq) <= 10, false) AS is_repeat FROM m")
def rapid_repeat_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return St.rapid_repeats(_messages(spark, sf)).select("session_key", "seq", "is_repeat")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS event, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_stats(spark: SparkSession, sf: str) -> DataFrame:
    return St.windowed_stats(A.hook_events(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 180000000 THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id AS session_key, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('second', max(ts)), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_timeout(spark: SparkSession, sf: str) -> DataFrame:
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return St.sessions(A.hook_events(spark, sf)).select("session_key", show("start"), show("last"), "n")

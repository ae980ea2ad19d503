"""Ranking, analytic functions and frames, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources import table


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("c_nationkey").orderBy(F.floor(F.col("c_acctbal") / 100).desc())
    whole = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.rank().over(by).cast("long").alias("place"), F.dense_rank().over(by).cast("long").alias("dense"), F.ntile(4).over(whole).cast("long").alias("quarter"),
        F.round(F.percent_rank().over(by), 6).alias("part"), F.round(F.cume_dist().over(by), 6).alias("share"))


def analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    all_of = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lag("o_orderkey", 1).over(by).alias("before"), F.lead("o_orderkey", 2, -1).over(by).alias("second_after"), F.first("o_orderkey").over(all_of).alias("first"),
        F.last("o_orderkey").over(all_of).alias("last"), F.nth_value("o_orderkey", 3).over(all_of).alias("third"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moving mean over rows, a sum over the last seven days, and a running sum of a user's events."""
    events = table(spark, sf_dir, "events").where("user_id < 100")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    day = 24 * 3600 * 1_000_000
    timed = events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    week = Window.partitionBy("user_id").orderBy("at").rangeBetween(-7 * day, 0)
    return timed.select(
        "event_id", F.round(F.avg("value").over(by.rowsBetween(-3, 1)), 6).alias("moving"), F.round(F.sum("value").over(week), 4).alias("week"), F.count(F.lit(1)).over(week).alias("n_week"),
        F.round(F.sum("value").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), 4).alias("running"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's part of its nation's revenue: an aggregate under a window."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("sold"))
    joined = sold.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("s_suppkey", F.round(F.col("sold") / F.sum("sold").over(Window.partitionBy("s_nationkey")), 8).alias("share"))


QUERIES = {"q_ranking": ranking, "q_analytic": analytic, "q_frames": frames, "q_shares": shares}
ORACLES = {
    "q_ranking": """
        SELECT c_custkey, rank() OVER o AS place, dense_rank() OVER o AS dense, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter,
            round(percent_rank() OVER o, 6) AS part, round(cume_dist() OVER o, 6) AS share
        FROM customer WINDOW o AS (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC)""",
    "q_analytic": """
        SELECT o_orderkey, lag(o_orderkey) OVER o AS before, lead(o_orderkey, 2, -1) OVER o AS second_after, first(o_orderkey) OVER w AS first,
            last(o_orderkey) OVER w AS last, nth_value(o_orderkey, 3) OVER w AS third
        FROM orders WINDOW o AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
            w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "q_frames": """
        SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS moving,
            round(sum(value) OVER r, 4) AS week, count(*) OVER r AS n_week, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running
        FROM events WHERE user_id < 100 WINDOW r AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""",
    "q_shares": """
        SELECT s_suppkey, round(sold / sum(sold) OVER (PARTITION BY s_nationkey), 8) AS share
        FROM (SELECT l_suppkey, sum(l_extendedprice) AS sold FROM lineitem GROUP BY l_suppkey) JOIN supplier ON l_suppkey = s_suppkey""",
}

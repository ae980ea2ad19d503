"""Joins, aggregates, windows and set operations over the star schema, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import asof, top_per_group
from millrace.sources import table


def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of the lines shipped in 1996 by the customer's region."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1997-01-01'")
    joined = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(paid), 2).alias("revenue"))


def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(paid), 2).alias("paid"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n")
    )


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'2001-01-01'")
    return table(spark, sf_dir, "customer").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def events_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return table(spark, sf_dir, "events").select("event_type", day, "value").rollup("event_type", "day").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each priority."""
    best = top_per_group(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return best.select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: events less than a day apart."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(order) >= F.expr("interval 1 day")
    marked = table(spark, sf_dir, "events").withColumn("fresh", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("fresh").over(order).cast("long"))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view at or before it."""
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof(left, right, "user_id", "ts", ["view_id"]).select("event_id", "view_id")


QUERIES = {
    "q_revenue_by_region": revenue_by_region, "q_price_summary": price_summary, "q_customers_without_orders": customers_without_orders, "q_events_rollup": events_rollup,
    "q_top_orders": top_orders, "q_sessions": sessions, "q_view_before_purchase": view_before_purchase,
}
ORACLES = {
    "q_revenue_by_region": """
        SELECT r_name, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY r_name""",
    "q_price_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS paid,
            round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "q_customers_without_orders": """
        SELECT c_custkey, c_name FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')""",
    "q_events_rollup": """
        SELECT event_type, day, count(*) AS n, round(sum(value), 2) AS total
        FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, value FROM events) GROUP BY ROLLUP (event_type, day)""",
    "q_top_orders": """
        SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
        ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
    "q_sessions": """
        WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER o < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events
            WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
        numbered AS (SELECT *, (sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS session FROM marked)
        SELECT user_id, session, count(*) AS n, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, session""",
    "q_view_before_purchase": """
        SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
}

"""Distinct counts, cubes, grouping sets, statistics, sketches and pivots, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import table


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderstatus", F.year("o_orderdate")).alias("kinds"), F.count(F.lit(1)).alias("n"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().cast("int").alias("level"))


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    sets = [["c_mktsegment"], ["c_nationkey"], []]
    return customers.groupingSets(sets, "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.median("value"), 6).alias("median"), F.round(F.stddev("value"), 6).alias("deviation"), F.round(F.var_pop("value"), 4).alias("variance"),
        F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"), F.round(F.corr("value", "user_id"), 6).alias("correlation"))


def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates over a part of the rows, and the values that belong to an extreme."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("dearest_order"),
        F.bool_or(F.col("l_tax") > 0.07).alias("taxed"), F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), 2).alias("returned"))


def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).where("n > 70")


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether estimates from mergeable sketches are within their bounds of the exact figures."""
    each = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 14)).alias("hll"), F.approx_count_distinct("user_id", 0.02).alias("hllpp"), F.countDistinct("user_id").alias("users"),
        F.kll_sketch_get_rank_double(F.kll_sketch_agg_double("value"), F.lit(100.0)).alias("kll"), F.avg((F.col("value") <= 100).cast("double")).alias("share"),
        F.percentile_approx("value", 0.5, 10_000).alias("middle"), F.percentile("value", F.lit(0.49)).alias("low"), F.percentile("value", F.lit(0.51)).alias("high"))
    near = lambda a, b, bound: F.abs(F.col(a) - F.col(b)) <= bound * F.col(b)
    return each.select(
        "event_type", near("hll", "users", 0.05).alias("hll_near"), near("hllpp", "users", 0.1).alias("hllpp_near"), (F.abs(F.col("kll") - F.col("share")) <= 0.05).alias("kll_near"),
        F.col("middle").between(F.col("low"), F.col("high")).alias("middle_near"))


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by week day; the pivoted values are named, so no job looks for them."""
    days = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "E"))
    return days.groupBy("event_type").pivot("day", ["Mon", "Tue", "Wed"]).agg(F.count(F.lit(1))).na.fill(0)


def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where("p_partkey < 500").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return parts.unpivot("p_partkey", ["size", "price"], "name", "value")


QUERIES = {
    "q_distinct_counts": distinct_counts, "q_cube": cube, "q_grouping_sets": grouping_sets, "q_statistics": statistics, "q_conditional_aggregates": conditional, "q_having": having,
    "q_sketches": sketches, "q_pivot": pivot, "q_unpivot": unpivot,
}
ORACLES = {
    "q_distinct_counts": """
        SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_orderstatus, year(o_orderdate))) AS kinds, count(*) AS n
        FROM orders GROUP BY o_orderpriority""",
    "q_cube": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag, l_linestatus)::INTEGER AS level
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "q_grouping_sets": """
        SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS balance
        FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""",
    "q_statistics": """
        SELECT event_type, round(median(value), 6) AS median, round(stddev(value), 6) AS deviation, round(var_pop(value), 4) AS variance,
            round(quantile_cont(value, 0.9), 6) AS p90, round(corr(value, user_id), 6) AS correlation FROM events GROUP BY event_type""",
    "q_conditional_aggregates": """
        SELECT l_suppkey, count(*) FILTER (l_discount > 0.05) AS discounted, (max(row(l_extendedprice, l_orderkey, l_linenumber)))[2] AS dearest_order,
            bool_or(l_tax > 0.07) AS taxed, round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS returned FROM lineitem GROUP BY l_suppkey""",
    "q_having": "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id HAVING count(*) > 70",
    "q_sketches": "SELECT DISTINCT event_type, true AS hll_near, true AS hllpp_near, true AS kll_near, true AS middle_near FROM events",
    "q_pivot": """
        SELECT event_type, count(*) FILTER (isodow(ts) = 1) AS Mon, count(*) FILTER (isodow(ts) = 2) AS Tue, count(*) FILTER (isodow(ts) = 3) AS Wed
        FROM events GROUP BY event_type""",
    "q_unpivot": """
        SELECT p_partkey, 'size' AS name, p_size::DOUBLE AS value FROM part WHERE p_partkey < 500
        UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_partkey < 500""",
}

"""Sorts, limits, set operations and subqueries, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import table


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global top-k: each task keeps its best rows, and one task merges those."""
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal").limit(50)


def page_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate").offset(100).limit(25)


def nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each nation in an order with nulls first."""
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("region"))
    return named.orderBy(F.asc_nulls_first("region"), F.desc("n_nationkey")).limit(10)


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return customers, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))


def unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b).groupBy("nation").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("all")).unionByName(a.union(b).distinct().select("nation", F.lit(1).cast("long").alias("n"), F.lit("distinct").alias("kind")))


def intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersect(b.where("nation > 3")).withColumn("kind", F.lit("distinct")).unionByName(a.intersectAll(b).withColumn("kind", F.lit("all")))


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.subtract(b.where("nation > 3")).withColumn("kind", F.lit("distinct")).unionByName(b.exceptAll(a.where("nation <= 20")).withColumn("kind", F.lit("all")))


def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dearer than 1.9 times their customer's mean: a correlated scalar subquery, which becomes a join to an aggregate."""
    orders = table(spark, sf_dir, "orders")
    own = orders.where(F.col("o_custkey") == F.col("o.o_custkey").outer()).select(F.avg("o_totalprice")).scalar()
    return orders.alias("o").where(F.col("o_totalprice") > F.lit(1.9) * own).select("o_orderkey", "o_totalprice")


def exists_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_orderkey") == F.col("o.o_orderkey").outer()) & (F.col("l_quantity") >= 49))
    return table(spark, sf_dir, "orders").alias("o").where(lines.exists()).select("o_orderkey", "o_orderstatus")


def recursive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive query: all days of the events' span, each with its number of events."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return spark.sql(
        """
        WITH RECURSIVE days(day, last) AS (
            SELECT min(day), max(day) FROM {events} UNION ALL SELECT date_add(day, 1), last FROM days WHERE day < last)
        SELECT CAST(d.day AS STRING) AS day, count(e.day) AS n FROM days AS d LEFT JOIN {events} AS e ON d.day = e.day GROUP BY d.day""",
        events=events,
    )


def piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL in pipe form."""
    return spark.sql(
        """
        FROM {orders} |> WHERE o_orderstatus = 'F' |> AGGREGATE count(*) AS n, max(o_totalprice) AS dearest GROUP BY o_orderpriority
        |> EXTEND n * 2 AS twice |> SELECT o_orderpriority, n, dearest, twice""",
        orders=table(spark, sf_dir, "orders"),
    )


QUERIES = {
    "q_top_customers": top_customers, "q_page_of_orders": page_of_orders, "q_nulls_first": nulls_first, "q_unions": unions, "q_intersections": intersections, "q_differences": differences,
    "q_correlated_scalar": above_average, "q_correlated_exists": exists_late, "q_recursive": recursive_days, "q_pipe": piped,
}
ORACLES = {
    "q_top_customers": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
    "q_page_of_orders": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 100",
    "q_nulls_first": "SELECT n_nationkey, nullif(n_regionkey, 2) AS region FROM nation ORDER BY region NULLS FIRST, n_nationkey DESC LIMIT 10",
    "q_unions": """
        WITH both_of AS (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier)
        SELECT nation, count(*) AS n, 'all' AS kind FROM both_of GROUP BY nation
        UNION ALL SELECT nation, 1::BIGINT, 'distinct' FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier)""",
    "q_intersections": """
        SELECT nation, 'distinct' AS kind FROM (SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 3)
        UNION ALL SELECT nation, 'all' FROM (SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)""",
    "q_differences": """
        SELECT nation, 'distinct' AS kind FROM (SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 3)
        UNION ALL SELECT nation, 'all' FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer WHERE c_nationkey <= 20)""",
    "q_correlated_scalar": """
        SELECT o_orderkey, o_totalprice FROM orders AS o
        WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders WHERE o_custkey = o.o_custkey)""",
    "q_correlated_exists": """
        SELECT o_orderkey, o_orderstatus FROM orders AS o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity >= 49)""",
    "q_recursive": """
        WITH RECURSIVE days(day, last) AS (
            SELECT min(ts)::DATE, max(ts)::DATE FROM events UNION ALL SELECT (day + 1)::DATE, last FROM days WHERE day < last)
        SELECT d.day::VARCHAR AS day, count(e.ts) AS n FROM days AS d LEFT JOIN events AS e ON d.day = e.ts::DATE GROUP BY d.day""",
    "q_pipe": """
        SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS dearest, count(*) * 2 AS twice FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""",
}

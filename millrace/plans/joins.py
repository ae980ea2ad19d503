"""Joins beyond the inner equi join, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import interval_join, not_in, range_join
from millrace.sources import table


def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order, also of those without any."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last_shipped"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "n", "last_shipped")


def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich customers and rich suppliers by nation; a nation may have either only."""
    buyers = table(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    sellers = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    both = buyers.join(sellers, F.col("c_nationkey") == F.col("s_nationkey"), "full")
    return both.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers")


def right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation with its suppliers of a high balance."""
    sellers = table(spark, sf_dir, "supplier").where("s_acctbal > 8000")
    both = sellers.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right")
    return both.select("n_name", "s_name")


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


def null_aware_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers not in the customers of urgent orders; the outer key is null for some of them."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    own = table(spark, sf_dir, "customer").select("c_name", F.expr("nullif(c_custkey, 7)").alias("key"))
    return not_in(own, urgent, "key")


def prices_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers' balances lie in each brand's range of prices: a range join."""
    prices = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    found = range_join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), prices, "c_acctbal", "low", "high", 500.0)
    return found.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("most"))


def views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user in the 12 hours before each purchase: an interval join."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    seen = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("seen_value"))
    return interval_join(bought, seen, "user_id", "ts", "seen", 12 * 3600).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("last_seen"))


def orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with figures of its own orders: a lateral join."""
    orders = table(spark, sf_dir, "orders")
    own = orders.where(F.col("o_custkey") == F.col("c.c_custkey").outer()).select(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("dearest"))
    return table(spark, sf_dir, "customer").where("c_custkey < 1000").alias("c").lateralJoin(own).select("c_custkey", "n", "dearest")


def shipped_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations of a region, by an equi join and an inequality."""
    a, b = (table(spark, sf_dir, "nation").select(F.col("n_name").alias(x), "n_regionkey", F.col("n_nationkey").alias(f"{x}_key")) for x in ("one", "other"))
    return a.join(b, (a["n_regionkey"] == b["n_regionkey"]) & (F.col("one_key") < F.col("other_key"))).select("one", "other")


QUERIES = {
    "q_left_join": left_join, "q_right_join": right_join, "q_full_join": full_join, "q_semi_join": semi_join, "q_null_aware_not_in": null_aware_not_in, "q_range_join": prices_of_brands,
    "q_interval_join": views_before_purchases, "q_lateral_join": orders_of_customers, "q_theta_join": shipped_elsewhere,
}
ORACLES = {
    "q_left_join": """
        SELECT o_orderkey, o_orderstatus, n, last_shipped FROM orders LEFT JOIN
        (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last_shipped FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "q_right_join": "SELECT n_name, s_name FROM (SELECT * FROM supplier WHERE s_acctbal > 8000) RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "q_full_join": """
        SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers
        FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9900 GROUP BY c_nationkey)
        FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 9000 GROUP BY s_nationkey) ON c_nationkey = s_nationkey""",
    "q_semi_join": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "q_null_aware_not_in": """
        SELECT c_name, key FROM (SELECT c_name, nullif(c_custkey, 7) AS key FROM customer)
        WHERE key NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "q_range_join": """
        SELECT p_brand, count(*) AS n, max(c_acctbal) AS most FROM customer
        JOIN (SELECT p_brand, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand) ON c_acctbal BETWEEN low AND high GROUP BY p_brand""",
    "q_interval_join": """
        SELECT p.event_id, count(*) AS n, max(v.ts) AS last_seen FROM events AS p JOIN events AS v
        ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 12 HOUR AND p.ts
        WHERE p.event_type = 'purchase' AND v.event_type = 'view' GROUP BY p.event_id""",
    "q_lateral_join": """
        SELECT c_custkey, n, dearest FROM customer AS c,
        LATERAL (SELECT count(*) AS n, max(o_totalprice) AS dearest FROM orders WHERE o_custkey = c.c_custkey) WHERE c_custkey < 1000""",
    "q_theta_join": "SELECT a.n_name AS one, b.n_name AS other FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
}

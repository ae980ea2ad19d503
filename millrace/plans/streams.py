"""Streams over the events' files, drained, each with the SQL that its batch twin must agree with; and the connector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import streaming
from millrace.sources import table
from millrace.sources.calendar import Calendar


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.watermarked(streaming.flushed(streaming.file_stream(spark, sf_dir, "events"), "ts"), "ts", "10 minutes")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    return streaming.drained(streaming.windowed(_events(spark, sf_dir), F.window("ts", "1 hour"), ["event_type"], *sums)).drop("batch")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.drained(streaming.windowed(_events(spark, sf_dir), F.window("ts", "1 hour", "15 minutes"), [], F.count(F.lit(1)).alias("n"))).drop("batch")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: events less than 8 hours apart."""
    return streaming.drained(streaming.windowed(_events(spark, sf_dir), F.session_window("ts", "8 hours"), ["user_id"], F.count(F.lit(1)).alias("n"))).drop("batch")


def without_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come twice, once each."""
    once = streaming.file_stream(spark, sf_dir, "events")
    twice = streaming.watermarked(once.unionByName(streaming.file_stream(spark, sf_dir, "events").where("event_id % 3 = 0")), "ts", "1 hour")
    return streaming.drained(streaming.first_of_each(twice, ["event_id"]).select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))).drop("batch")


def views_of_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [streaming.watermarked(streaming.file_stream(spark, sf_dir, "events").where(F.col("event_type") == kind), "ts", "10 minutes") for kind in ("purchase", "view")]
    bought = kinds[0].select("user_id", "event_id", F.col("ts").alias("bought"))
    seen = kinds[1].select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))
    return streaming.drained(streaming.joined_within(bought, seen, "user_id", "bought", "seen", "6 hours").select("event_id", "view_id")).drop("batch")


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user; state is kept by the stream, a batch gives the users that it has seen."""
    states = streaming.drained(streaming.totals(streaming.file_stream(spark, sf_dir, "events"), "user_id", "value"), "update")
    last = states.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "most"), "n").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 2).alias("total"), "s.most")


def events_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each Monday of a quarter, from the calendar connector."""
    spark.dataSource.register(Calendar)
    days = spark.read.format("calendar").option("start", "2024-01-01").option("days", "91").load().where("weekday = 1")
    events = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(events, F.col("day") == F.col("d"), "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    "q_stream_tumbling": tumbling, "q_stream_sliding": sliding, "q_stream_sessions": sessions, "q_stream_dedup": without_copies, "q_stream_join": views_of_purchases, "q_stream_state": running_totals,
    "q_connector": events_of_days,
}
ORACLES = {
    "q_stream_tumbling": """
        SELECT date_trunc('hour', ts) AS began, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ended, event_type, count(*) AS n, round(sum(value), 2) AS total
        FROM events GROUP BY ALL""",
    "q_stream_sliding": """
        SELECT began, began + INTERVAL 1 HOUR AS ended, count(*) AS n
        FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS began FROM events, range(4) AS r(k)) GROUP BY ALL""",
    "q_stream_sessions": """
        WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER o < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked)
        SELECT min(ts) AS began, max(ts) + INTERVAL 8 HOUR AS ended, user_id, count(*) AS n FROM numbered GROUP BY user_id, session""",
    "q_stream_dedup": "SELECT event_id, event_type, ts FROM events",
    "q_stream_join": """
        SELECT p.event_id, v.event_id AS view_id FROM events AS p JOIN events AS v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts
        WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
    "q_stream_state": "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most FROM events GROUP BY user_id",
    "q_connector": """
        SELECT day, count(e.ts) AS n FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-04-01', INTERVAL 1 DAY))::DATE AS day) AS d
        LEFT JOIN events AS e ON e.ts::DATE = day WHERE isodow(day) = 1 GROUP BY day""",
}

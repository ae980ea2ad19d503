"""User-defined functions over Arrow batches, where built-in functions wouldn't say it, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import table


def scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def digits(x: pd.Series) -> pd.Series:
        return x.astype(str).map(lambda s: sum(map(int, s)))

    return table(spark, sf_dir, "customer").select("c_custkey", digits("c_custkey").alias("digit_sum"))


def aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(spread("value"), 6).alias("spread"))


def of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least-squares slope of value by place, for each user: a group in one frame (a user's events, so of bounded size)."""

    def slope(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("event_id")
        x = np.arange(len(g)) - (len(g) - 1) / 2
        return pd.DataFrame({"user_id": [g["user_id"].iloc[0]], "n": [len(g)], "slope": [round(float((x * g["value"]).sum() / max((x**2).sum(), 1e-12)), 6)]})

    return table(spark, sf_dir, "events").where("user_id < 100").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(slope, "user_id long, n long, slope double")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each power of two in a part's size."""

    def powers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = [(k, 1 << b) for k, size in zip(*(c.to_pylist() for c in batch.columns), strict=True) for b in range(size.bit_length()) if size >> b & 1]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["p_partkey", "power"])

    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long")).mapInArrow(powers, "p_partkey long, power long")


class Countdown:
    """n, n - 1, ... 1 of a number."""

    def eval(self, n: int) -> Iterator[tuple[int]]:
        yield from ((k,) for k in range(n, 0, -1))


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("countdown", F.udtf(Countdown, returnType="k: int"))
    return spark.sql("SELECT n_nationkey, k FROM {nation}, LATERAL countdown(n_regionkey)", nation=table(spark, sf_dir, "nation"))


QUERIES = {"q_udf_scalar": scalar, "q_udf_aggregate": aggregate, "q_udf_group": of_group, "q_udf_batches": batches, "q_udf_table": table_function}
ORACLES = {
    "q_udf_scalar": "SELECT c_custkey, list_sum([x::INTEGER FOR x IN string_split(c_custkey::VARCHAR, '')])::BIGINT AS digit_sum FROM customer",
    "q_udf_aggregate": "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type",
    "q_udf_group": """
        SELECT user_id, count(*) AS n, round(coalesce(regr_slope(value, place), 0), 6) AS slope
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE user_id < 100) GROUP BY user_id""",
    "q_udf_batches": "SELECT p_partkey, (1 << b)::BIGINT AS power FROM part, range(7) AS r(b) WHERE (p_size >> b) & 1 = 1",
    "q_udf_table": "SELECT n_nationkey, k::INTEGER AS k FROM nation, range(1, 5) AS r(k) WHERE k <= n_regionkey",
}

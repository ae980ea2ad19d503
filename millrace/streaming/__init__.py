"""Event-time plans that give the same rows over a stream as over a table, and a runner that drains a stream.

Every function takes a DataFrame that is streaming or not. Times of type timestamp_ntz are cast, as watermarks need an instant; bounds
are cast back. Rows later than the watermark are dropped from a stream only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources import shared_dir


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def flushed(stream: DataFrame, time: str, at: str = "9999-01-01") -> DataFrame:
    """``stream`` with one more row of a far time and nulls, which moves the watermark past every real row.

    Append mode gives back a window only when the watermark has passed it, so without this the last ones are never returned. The
    row's own window never closes.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/last-{uuid.uuid4().hex}"
    spark.range(1).select(*[(F.lit(at) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def watermarked(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def windowed(df: DataFrame, window: Column, keys: list[str], *aggregates: Column) -> DataFrame:
    """``aggregates`` by window and keys, with the window's bounds as ``began`` and ``ended``."""
    bounds = [F.col(f"w.{a}").cast("timestamp_ntz").alias(b) for a, b in (("start", "began"), ("end", "ended"))]
    grouped = df.groupBy(window.alias("w"), *keys).agg(*aggregates)
    return grouped.select(*bounds, *[c for c in grouped.columns if c != "w"])


def first_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``; a stream must be watermarked, and forgets keys once the watermark has passed them."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, span: str) -> DataFrame:
    """Pairs of a key whose right time is at most ``span`` before the left one; both sides watermarked, so state is bounded."""
    near = (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - F.expr(f"interval {span}"))
    return left.join(right, (left[key] == right[key]) & near).drop(right[key])


def totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Running state of each key: n, total and most of ``value``; a stream gives a row for each key of a batch, in update mode."""
    if not df.isStreaming:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, most = state.get if state.exists else (0, 0.0, float("-inf"))
        for frame in frames:
            if len(frame):
                n, total, most = n + len(frame), total + float(frame[value].sum()), max(most, float(frame[value].max()))
        state.update((n, total, most))
        yield pd.DataFrame({key: [name[0]], "n": [n], "total": [total], "most": [most]})

    kept = "n long, total double, most double"
    return df.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(update, f"{key} long, {kept}", kept, "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that ``stream`` gives for the input that is there now, as a table in the shared folder.

    A batch that is run again overwrites its own folder, so each is there once.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/out/batch=-1")
    write = lambda batch, no: batch.write.mode("overwrite").parquet(f"{path}/out/batch={no}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")

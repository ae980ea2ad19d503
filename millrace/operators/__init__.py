"""Operators that compose DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group and their place as ``name``; Spark limits each group before the shuffle.

    Defined cases: null keys are a group of their own; ties in ``order`` are broken by nothing, so ``order`` should end with a key;
    a group of fewer rows is returned whole; an empty table gives an empty result; a column ``name`` of the input is replaced.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def asof(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], ties: list[str] | None = None) -> DataFrame:
    """Each left row with ``values`` of the key's last right row at or before its time: one shuffle, no pairs.

    Defined cases: all values come from one right row, nulls among them too; of right rows of one time the greatest by ``ties`` (by
    default ``values``) holds; a null key or time on either side matches nothing, and such a left row has null values; repeated left
    rows are each returned; empty tables give no rows or null values; other left columns are kept whatever their names, but must not be
    in ``values``.
    """
    last = F.struct(*[F.col(v) for v in values])
    order = F.struct(*[F.col(v) for v in ties or values])
    a = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), F.struct("*").alias("own"), F.lit(None).alias("last"), F.lit(None).alias("tie"))
    b = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    b = b.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(0).alias("side"), F.lit(None).alias("own"), last.alias("last"), order.alias("tie"))
    frame = Window.partitionBy("k").orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.where(F.col("k").isNotNull() & F.col("t").isNotNull()).unionByName(b).withColumn("found", F.last("last", ignorenulls=True).over(frame))
    matched = both.where("side = 1").select("own", "found")
    alone = a.where(F.col("k").isNull() | F.col("t").isNull()).select("own", F.lit(None).cast(matched.schema["found"].dataType).alias("found"))
    out = matched.unionByName(alone)
    return out.select(*[F.col("own")[c].alias(c) for c in left.columns], *[F.col("found")[v].alias(v) for v in values])


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SQL's null-aware ``left.key NOT IN (SELECT key FROM right)`` as an equi anti join, which shuffles where a broadcast wouldn't fit.

    Defined cases: with an empty right side every left row stays, of a null key too; with a null on the right none does; else rows
    with a null key go; repeated rows are each returned.
    """
    counted = right.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("nulls"))
    rows, nulls = counted.select("n").scalar(), counted.select("nulls").scalar()
    there = right.where(F.col(key).isNotNull()).select(F.col(key).alias("__there"))
    rest = left.join(there, left[key] == there["__there"], "left_anti")
    return rest.where((rows == 0) | ((nulls == 0) & F.col(key).isNotNull()))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= point <= high``, as an equi join on buckets of ``width``: each range goes to the buckets it touches.

    ``width`` near the usual length of a range keeps both the copies of a range and the false pairs of a bucket few.

    Defined cases: a null point or bound, and a range that ends before it begins, match nothing; repeated rows are each paired; empty
    tables give an empty result; all columns of both sides are kept, so their names must differ.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    wide = ranges.where(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    found = points.withColumn("__b", bucket(point)).join(wide, "__b")
    return found.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__b")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of a key whose right time is at most ``seconds`` before the left time or equal to it.

    Both sides are dealt by key and bucket of ``seconds``, so a hot key spreads over its buckets; a right row goes to its own bucket
    and the next.

    Defined cases: null keys and times match nothing; repeated rows are each paired; empty tables give an empty result; all columns of
    both sides are kept but the right's key, so their other names must differ.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    a = left.withColumn("__b", bucket(left_time))
    b = right.withColumn("__b", F.explode(F.array(bucket(right_time), bucket(right_time) + 1)))
    near = (F.col(right_time) <= F.col(left_time)) & (F.col(right_time) >= F.col(left_time) - F.make_dt_interval(secs=F.lit(seconds)))
    return a.join(b, [key, "__b"]).where(near).drop("__b")

"""Column functions that Spark has no single name for. All are made of built-in functions, so they stay in generated code where those do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def iso_weekday(day: Column) -> Column:
    """1 (Monday) to 7 (Sunday); null for null."""
    return F.pmod(F.dayofweek(day) + 5, F.lit(7)) + 1


def title_words(text: Column) -> Column:
    """The words of a text, split at single spaces, each with a capital first letter, in one string."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of numbers, as double; null if their lengths differ or either is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    """The Euclidean length of an array of numbers."""
    return F.sqrt(dot(a, a))


def round_half_up(x: Column, digits: int) -> Column:
    """A double times 10^digits, rounded to whole (halves away from zero) and divided again, as SQL engines in C++ do; zero keeps the sign of ``x``."""
    scale = F.lit(10.0**digits)
    whole = F.round(x * scale)
    return F.when(whole == 0, x * 0.0).otherwise(whole / scale)


def histogram_bucket(x: Column, low: float, high: float, n: int) -> Column:
    """The bucket, 0 to n - 1, of ``x`` among ``n`` equal ones of [low, high]; values outside count to the first and last; null for null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - low) * n / (high - low)).cast("int"))))

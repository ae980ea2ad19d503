"""Operators, functions, sources and streams on hand-made rows: nulls, ties, empty tables, repeated rows, clashing names."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import functions, operators, sources, streaming

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_asof_takes_one_right_row_and_no_null_keys(spark):
    left = spark.createDataFrame([(1, at(5), "a"), (1, at(1), "b"), (None, at(5), "c"), (2, None, "d"), (3, at(9), "e"), (1, at(5), "a"), (1, at(0), "f")], "k long, t timestamp_ntz, side string")
    right = spark.createDataFrame([(1, at(1), 1, 2), (1, at(4), None, 3), (None, at(1), 9, 9), (2, at(1), 8, 8), (1, at(5), 4, 1), (1, at(5), 4, 0), (3, None, 7, 7)], "k long, t timestamp_ntz, v int, w int")
    got = operators.asof(left, right, "k", "t", ["v", "w"])
    assert got.columns == ["k", "t", "side", "v", "w"]
    assert rows(got, "side", "v", "w") == sorted([("a", 4, 1), ("a", 4, 1), ("b", 1, 2), ("c", None, None), ("d", None, None), ("e", None, None), ("f", None, None)], key=repr)
    before = operators.asof(left.where("side = 'a'").withColumn("t", F.col("t") - F.expr("interval 1 minute")), right, "k", "t", ["v", "w"])
    assert rows(before, "v", "w") == [(None, 3)] * 2  # the last row, its null too
    for a, b, n in ((left.where("false"), right, 0), (left, right.where("false"), 7)):
        assert operators.asof(a, b, "k", "t", ["v", "w"]).where("v is null and w is null").count() == n


def test_asof_against_sql_with_nulls_and_ties(spark):
    import random

    rng = random.Random(4)
    some = lambda x: None if rng.random() < 0.1 else x
    left = [(i, some(rng.randrange(4)), some(at(rng.randrange(30)))) for i in range(80)]
    right = [(some(rng.randrange(4)), some(at(rng.randrange(30))), some(rng.randrange(9)), i) for i in range(60)]
    got = operators.asof(spark.createDataFrame(left, "i long, k long, t timestamp_ntz"), spark.createDataFrame(right, "k long, t timestamp_ntz, v long, r long"), "k", "t", ["v", "r"], ["r"])
    want = []
    for i, k, t in left:
        best = max(((b, r, v) for a, b, v, r in right if None not in (k, t, a, b) and a == k and b <= t), key=lambda x: x[:2], default=(None, None, None))
        want.append((i, best[2], best[1]))
    assert rows(got, "i", "v", "r") == sorted(want, key=repr)


def test_top_per_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), (None, 5), ("b", None)], "g string, rank int")
    got = operators.top_per_group(df.withColumn("x", F.col("rank")), ["g"], [F.desc_nulls_last("x")], 2)
    assert rows(got, "g", "x", "rank") == sorted([("a", 2, 1), ("a", 2, 2), (None, 5, 1), ("b", None, 1)], key=repr)
    assert operators.top_per_group(df.where("false"), ["g"], [F.col("g")], 2).count() == 0


@pytest.mark.parametrize("right", [[], [1, 2], [1, None], [None]])
def test_not_in_as_sql(spark, right):
    left = [1, 2, 3, 3, None]
    got = operators.not_in(spark.createDataFrame([(x,) for x in left], "k int"), spark.createDataFrame([(x,) for x in right], "k int"), "k")
    inner = ", ".join("(NULL::INT)" if x is None else f"({x})" for x in right)
    inner = f"SELECT * FROM (VALUES {inner})" if right else "SELECT 1 WHERE false"
    want = duckdb.sql(f"SELECT k FROM (VALUES (1), (2), (3), (3), (NULL::INT)) AS t(k) WHERE k NOT IN ({inner})").fetchall()
    assert rows(got, "k") == sorted(want, key=repr)


def test_range_join(spark):
    points = [(x,) for x in (-3.0, 0.0, 4.9, 5.0, 12.5, 12.5, None)]
    ranges = [("a", 0.0, 5.0), ("b", -10.0, 20.0), ("c", 7.0, 6.0), ("d", None, 3.0), ("e", 5.0, 5.0)]
    a, b = spark.createDataFrame(points, "x double"), spark.createDataFrame(ranges, "name string, low double, high double")
    want = [(x, n) for (x,) in points for n, lo, hi in ranges if None not in (x, lo, hi) and lo <= x <= hi]
    for width in (0.7, 5.0, 1000.0):
        assert rows(operators.range_join(a, b, "x", "low", "high", width), "x", "name") == sorted(want, key=repr)
    assert operators.range_join(a, b.where("false"), "x", "low", "high", 1.0).count() == 0


def test_interval_join(spark):
    left = [(k, at(h)) for k in (1, 2, None) for h in (0, 1, 5, 5)] + [(1, None)]
    right = [(k, at(h), n) for n, (k, h) in enumerate([(1, 0), (1, 3), (1, 4.5), (2, 5), (None, 5), (3, 1), (1, 5)])]
    a, b = spark.createDataFrame(left, "k long, t timestamp_ntz"), spark.createDataFrame(right, "k long, u timestamp_ntz, n int")
    want = [(k, t, n) for k, t in left for j, u, n in right if None not in (k, t, j) and k == j and timedelta(0) <= t - u <= timedelta(hours=2)]
    assert rows(operators.interval_join(a, b, "k", "t", "u", 7200), "k", "t", "n") == sorted(want, key=repr)


def test_functions_of_nulls_and_bounds(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [1.0, 2.0]), (None, None, [1.0]), (0, [], []), (99, [1.0], [1.0, 2.0])], "n int, a array<double>, b array<double>")
    n = F.col("n")
    got = df.select(functions.ratio(n, n), functions.dot(F.col("a"), F.col("b")), functions.norm(F.col("a")), functions.histogram_bucket(n, 0.0, 10.0, 5)).collect()
    assert [tuple(r) for r in got] == [(1.0, 11.0, 5.0, 0), (None, None, None, None), (None, 0.0, 0.0, 0), (1.0, None, 1.0, 4)]
    days = spark.createDataFrame([(datetime(2024, 1, 1 + k).date(),) for k in range(7)], "d date")
    assert [r[0] for r in days.select(functions.iso_weekday(F.col("d"))).collect()] == list(range(1, 8))


@pytest.mark.parametrize("kind", sources.FORMATS)
def test_files_of_each_format_come_back(spark, tmp_path, kind):
    schema = "id long, name string, x double, day date, part int"
    some = [(1, "a, \"b\"", 1.5, T0.date(), 1), (2, None, None, None, 2), (3, "é", -0.25, T0.date(), 2)]
    df = spark.createDataFrame(some, schema)
    sources.write_files(df, f"{tmp_path}/x", kind, ["part"])
    assert rows(sources.read_files(spark, f"{tmp_path}/x", kind, df.schema), *df.columns) == sorted(some, key=repr)
    assert sources.read_files(spark, f"{tmp_path}/x", kind, df.schema).where("part = 1").count() == 1
    with pytest.raises(ValueError):
        sources.write_files(df, f"{tmp_path}/y", "avro")


def test_late_rows_are_dropped_from_a_stream_only(spark, tmp_path):
    schema = "ts timestamp_ntz, n int"
    for k, hours in enumerate(([1, 2, 3], [30, 31], [33], [2, 34])):  # 2 is late in the last file
        spark.createDataFrame([(at(h), k) for h in hours], schema).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/*")
    count = lambda df: streaming.windowed(streaming.watermarked(df, "ts", "1 hour"), F.window("ts", "1 hour"), [], F.count(F.lit(1)).alias("n"))
    got = {r["began"]: r["n"] for r in streaming.drained(count(stream)).collect()}
    want = {r["began"]: r["n"] for r in count(spark.read.parquet(f"{tmp_path}/*")).collect()}
    assert got[at(2)] == 1 and want[at(2)] == 2 and set(got) < set(want)


def test_state_goes_on_over_batches(spark, tmp_path):
    schema = "k long, v double"
    for n in range(3):
        spark.createDataFrame([(1, float(n)), (2, 1.0), (None, 5.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    got = streaming.drained(streaming.totals(stream, "k", "v"), "update")
    last = got.groupBy("k").agg(F.max_by(F.struct("n", "total", "most"), "n").alias("s")).select("k", "s.*")
    batch = streaming.totals(spark.read.parquet(f"{tmp_path}/*"), "k", "v")
    assert rows(last, "k", "n", "total", "most") == rows(batch, "k", "n", "total", "most") == [(1, 3, 3.0, 2.0), (2, 3, 3.0, 1.0)]


def test_repeated_rows_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, at(1)), (1, at(1)), (2, at(1)), (None, at(2))], "id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/a")
    stream = streaming.watermarked(spark.readStream.schema("id long, ts timestamp_ntz").parquet(f"{tmp_path}/a"), "ts", "1 hour")
    assert rows(streaming.drained(streaming.first_of_each(stream, ["id"])), "id") == [(1,), (2,), (None,)]


def test_arrays_as_sql_at_the_bounds_of_floats(spark, tmp_path):
    from millrace.plans import scalars

    rows_ = [(1, [0.3, -0.3]), (2, [0.9]), (3, [0.001, 0.007, 0.009, -0.023]), (4, []), (5, None), (6, [-0.0, 0.0, 0.1]), (7, [1e-4, -1e-3]), (8, [-0.273, -0.347, -0.2])]
    spark.createDataFrame(rows_, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.sql(scalars.ORACLES["q_arrays"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in scalars.QUERIES["q_arrays"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))

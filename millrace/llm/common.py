"""What the operators of this subpackage share: text columns, lineage cuts, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import shared_dir

#: Spark's own setting: an execution's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting: rows of an Arrow batch at most.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's own setting: a power of two, the groups for which an aggregate in generated code has its fast map.
GROUPS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
_folders: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _folders.items():
        with contextlib.suppress(Exception):  # the session may have been stopped
            _remove(spark, path)


#: Files at least, and rows of a file, of a ``stored`` table whose number of rows is known to be bounded.
FILES, FILE_ROWS = 12, 100_000


def stored(df: DataFrame, name: str, codec: str = "snappy", rows: int | None = None, group: int | None = None, batch: int | None = None, groups: int | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again; the application's files go when it exits, or by ``release``.

    With ``rows``, a bound of its number of rows, it is written by no more tasks than these rows need, however many partitions it has.
    With ``group`` no row group has more rows: a task holds as many at once when it writes and reads rows that are large. With ``batch`` no
    Arrow batch that Python gets has more rows. With ``groups`` aggregates have their fast map for 2 ** groups groups of a task.

    Unlike a checkpoint, the files carry their measured size, so Catalyst broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it (with AQE's skew handling) above. The shuffle files behind
    them go when they are written, so that disk doesn't hold those of all steps at once.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    _folders[folder] = spark
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(FILES, -(-rows // FILE_ROWS)))
    own = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {}) | ({GROUPS: str(groups)} if groups else {})
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = df.write.option("compression", codec)
        (out.option("parquet.block.row.count.limit", group) if group else out).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Numbers (rows, or entries of the arrays in them) that ``bounded`` lets be broadcast.
BROADCAST = 500_000


def bounded(table: DataFrame, size: str = "1") -> DataFrame:
    """A ``stored`` table, marked for a broadcast only if the sum of ``size`` over its rows, which is counted, is at most BROADCAST."""
    n = table.agg(F.sum(F.expr(size).cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(table) if n <= BROADCAST else table


def release(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            _remove(df.sparkSession, path)


def whole_text(name: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distributed union-find: (``node``, ``root``) for every node of ``edges``, root the component's smallest node.

    Alternates the large-star and small-star steps on an edge table (u > v) until it no longer changes. Each step joins the edges to a
    stored table of a minimum per node, so no neighbour list is ever collected. Of more than BROADCAST edges both sides of each join are
    plain shuffles whose hot keys (the hub of a large component) AQE splits. Self loops and nulls are ignored; nodes without
    edges don't appear. Roots themselves are returned too.
    """
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = stored(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state = _state(now)
    while n := state[0]:  # no step makes more edges than there were
        known = F.broadcast if n <= BROADCAST else lambda table: table
        least = stored(now.groupBy("u").agg(F.min("v").alias("m")), "least", rows=n)
        # a node's smallest neighbour is one that is smaller than itself, if it has such a one; else the node itself is the least
        large = now.join(known(least.select(F.col("u").alias("v"), "m")), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = stored(large.distinct(), "edges", rows=n)
        release(now, least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least", rows=n)
        small = large.join(known(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", rows=n)
        release(large, least)
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Tables as DataFrames, files of other formats, and the folder for what a query writes on its way."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "xml")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; columns and filters are pushed into its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_files(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None) -> None:
    """``df`` as files of one of FORMATS, in a folder for each value of ``partition_by``; an existing folder is an error."""
    options = {"csv": {"header": "true", "nullValue": "\\N"}, "xml": {"rowTag": "row"}}.get(kind, {})
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {FORMATS}")
    df.write.format(kind).options(**options).partitionBy(*partition_by or []).save(path)


def read_files(spark: SparkSession, path: str, kind: str, schema: StructType | str) -> DataFrame:
    """What ``write_files`` has written; the schema is given, so no job infers it."""
    options = {"csv": {"header": "true", "nullValue": "\\N"}, "xml": {"rowTag": "row"}}.get(kind, {})
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {FORMATS}")
    return spark.read.format(kind).schema(schema).options(**options).load(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the context's checkpoint folder, or ``spark.checkpoint.dir``.

    One of our own is made only in local mode, where driver and executors are one process; elsewhere a missing folder is an error.
    """
    context = spark.sparkContext
    place = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = os.path.join(tempfile.gettempdir(), "checkpoints", "millrace")
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return place

"""Cutting lineage with a table in the shared folder that the cluster names, and keeping frames from the driver."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder that the cluster names; a session on one machine may name none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{uuid.uuid4().hex}"


def unsent(df: DataFrame) -> DataFrame:
    """The rows, met by a shuffled join and never broadcast.

    Spark takes a frame for as large as the compressed files below it, whatever explode() made of their rows:
    what seems to be under the broadcast limit can be a hundred times as large, and passes through the driver.
    """
    return df.hint("merge")


def bound(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns worked out once a row: a generator keeps the optimizer from copying their expressions into every later one."""
    at = "_bound"
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.explode(F.array(F.struct(*names))).alias(at)).select(*(F.col(f"{at}.{c}").alias(c) if c in names else F.col(c) for c in df.columns))


#: Whether Spark deals rows out again for a join whose keys hold more than what they are dealt out by.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def as_dealt(spark: SparkSession) -> Iterator[None]:
    """While it lasts, rows that are dealt out by sheet meet in joins by sheet and cell (edge, ray, ...) where they are."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: computed once, safe when executors are lost. Joins don't broadcast them.

    Rows that are dealt out by sheet are not moved for joins of more keys on the way.
    """
    path = new_folder(df.sparkSession)
    with as_dealt(df.sparkSession):
        df.write.parquet(path)
    return unsent(df.sparkSession.read.schema(df.schema).parquet(path))

"""A session with the settings that the library expects."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session(app: str = "fathom", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; the cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fathom-"))
    return context.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession, batch_bytes: int | None) -> Iterator[None]:
    """Arrow batches that go to Python meanwhile have at most ``batch_bytes``, unless the session says less."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    own = before.rstrip("b")
    if batch_bytes and (not own.isdigit() or int(own) > batch_bytes):
        conf.set(key, f"{batch_bytes}b")
    try:
        yield
    finally:
        conf.set(key, before)


def cut(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """A table computed once for several uses, in the folder that the cluster names for checkpoints (in local
    tests without one, a temporary folder), so a lost executor doesn't lose it. ``batch_bytes``: see ``small_batches``."""
    _checkpoint_folder(df.sparkSession)
    with small_batches(df.sparkSession, batch_bytes):
        return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps checkpoints, which driver and executors share."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def free(name: str, *taken: DataFrame) -> str:
    """A column name like ``name`` that none of these tables has, in any case."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


def numbered(df: DataFrame, *order: Column | str, out: str = "pos") -> DataFrame:
    """Rows with their place (from 1) in an order over the whole table, in two steps: rows are dealt by range of the
    order, each part numbers its own, and the parts' sizes, one row a part, say where each begins. No task has
    more than a part. Ties should be told apart by the order; a column named like ``out`` is replaced."""
    df = df.drop(out)
    part, before = free("_part", df), free("_before", df)
    # What is dealt by a sample is written, so that both steps see one dealing.
    dealt = cut(df.repartitionByRange(*[c if isinstance(c, Column) else F.col(c) for c in order]).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    starts = sizes.select(part, F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn(out, own).join(F.broadcast(starts), part).withColumn(out, F.col(before) + F.col(out)).drop(part, before)

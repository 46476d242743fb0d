"""What the operators share: the cluster's shared folder, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from functools import wraps
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LOCAL: dict[str, str] = {}
#: Where written tables are, for those whose files may go early.
_WRITTEN: WeakKeyDictionary = WeakKeyDictionary()
#: A worker's caches, by the operator that fills them.
_CACHES: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset (local tests only) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="fathom-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def small_batches(spark: SparkSession, most: int = 8 << 20) -> str:
    """From now on Arrow batches have at most so many bytes, unless the session says less; what it said before. Spark's
    own bound, 64 MB, is held several times by every task, in the JVM beside the heap and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    if not before.rstrip("b").isdigit() or int(before.rstrip("b")) > most:
        spark.conf.set(key, f"{most}b")
    return before


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/fathom-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs start there, not at the sources,
    so a lost executor costs one stage. The files belong to the folder's owner, like checkpoints."""
    path, before = new_path(df.sparkSession, name), small_batches(df.sparkSession)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of written tables that no later job reads: what is made of them has been written, too."""
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def only(owner: str, *caches) -> None:
    """At the start of a task: a worker keeps the caches of one operator from task to task, and those of all
    others are emptied, so a worker that serves a pipeline's stages in turn holds one stage's alone."""
    _CACHES[owner] = caches
    for name, others in _CACHES.items():
        if name != owner:
            for cache in others:
                cache.clear()


def released() -> None:
    """Give back the freed memory that this process's allocators hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def task(run):
    """A function over the batches of a task, behind which the worker, which stays for others, is as small as can be."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def unused(name: str, *taken: DataFrame) -> str:
    """A column name like ``name`` that none of these tables has, in any case."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name += "_"
    return name


def with_partition_offsets(df: DataFrame, part: str, amount: str, out: str) -> DataFrame:
    """Add to each row the sum of ``amount`` over all partitions before its own.

    There is one total a partition, so the window and the broadcast hold as many rows as the table has
    partitions (thousands), however large the table is."""
    totals = df.groupBy(part).agg(F.sum(amount).alias("_total"))
    before = F.sum("_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(part, F.coalesce(before, F.lit(0)).cast("long").alias(out))
    return df.join(F.broadcast(offsets), part)


def with_classes(rows: DataFrame, classes: DataFrame, *keys: str, heavy: int = 200, most: int = 500_000) -> DataFrame:
    """Join rows (keys not null) with the one row of their class. The classes of more than ``heavy`` rows, no more
    than rows / heavy, are broadcast, so that none of them meets in one task; the limit rises until there are
    at most ``most``. The rest goes by shuffle."""
    large = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > heavy), "large-classes")
    while large.where(F.col("_n") > heavy).count() > most:
        heavy *= 2
    large = large.where(F.col("_n") > heavy).select(*keys)
    some = written(classes.join(F.broadcast(large), list(keys), "left_semi"), "classes-of-many")
    rest = rows.join(F.broadcast(large), list(keys), "left_anti").join(classes, list(keys))
    return rest.unionByName(rows.join(F.broadcast(some), list(keys)))

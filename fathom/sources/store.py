"""A keyed table in hash buckets: upserts and deletes rewrite the buckets that they touch, and one file commits them.

    path/data/000000000007-3f.../bucket=3/      rows of bucket 3 as generation 7 left them
    path/manifests/000000000007.json            which folder each bucket is in

A generation is what its manifest says. Every attempt writes to a folder of its own; manifests are written last and
never overwritten, so a batch that fails leaves the table as it was, and of two writers that began at one generation the
second fails. Older generations can be read as
long as their files are kept. All files go through Hadoop's file systems: any store that Spark reads will do."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


class Damaged(RuntimeError):
    """A manifest or a file that it names can't be read."""


@dataclass(frozen=True)
class Generation:
    number: int
    buckets: dict[int, str]  # bucket: the folder that holds it
    keys: tuple[str, ...]
    count: int
    schema: T.StructType
    notes: dict[str, str]


class Store:
    """A table at ``path``. ``keys``: columns that name a row, null among their values; ``buckets``: for a new table."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("id",), buckets: int = 64):
        self.spark, self.path, self.keys, self.count = spark, path.rstrip("/"), tuple(keys), buckets

    # -- files --

    def _path(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at, fs = self._path("manifests")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def generation(self, number: int | None = None) -> Generation | None:
        """The last generation, or a given one; none where the table is empty or has no such generation."""
        known = self._numbers()
        number = (known[-1] if known else None) if number is None else number
        if number not in known:
            return None
        at, fs = self._path(f"manifests/{number:012}.json")
        stream = fs.open(at)
        try:
            said = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            return Generation(number, {int(b): g for b, g in said["buckets"].items()}, tuple(said["keys"]), said["count"], T.StructType.fromJson(said["schema"]), said["notes"])
        except (ValueError, KeyError, TypeError) as e:
            raise Damaged(f"manifest of generation {number}") from e
        finally:
            stream.close()

    def _commit(self, g: Generation) -> None:
        at, fs = self._path(f"manifests/{g.number:012}.json")
        said = json.dumps({"buckets": g.buckets, "keys": g.keys, "count": g.count, "schema": g.schema.jsonValue(), "notes": g.notes})
        draft, _ = self._path(f"drafts/{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}.json")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(said.encode()))
        finally:
            stream.close()
        fs.mkdirs(at.getParent())
        # Renaming a whole file onto a name that must be free: readers see all of a manifest or none.
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise Conflict(f"generation {g.number} has been written by another")

    # -- reading --

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of a generation (of some buckets alone); none where there is no such generation."""
        g = self.generation(number)
        return None if g is None else self._rows(g, g.buckets if buckets is None else {b: folder for b, folder in g.buckets.items() if b in buckets})

    def _rows(self, g: Generation, buckets: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(buckets.items())]
        return self.spark.read.schema(g.schema).parquet(*paths) if paths else self.spark.createDataFrame([], g.schema)

    def bucket(self, count: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")

    def snapshot(self, values: tuple, number: int | None = None) -> DataFrame | None:
        """The rows of one key in a generation, from its bucket alone; none where the generation, the key or the files
        are missing or damaged."""
        try:
            g = self.generation(number)
            if g is None:
                return None
            kinds = T.StructType([g.schema[k] for k in self.keys])
            (b,) = self.spark.createDataFrame([tuple(values)], kinds).select(self.bucket(g.count)).first()
            if b not in g.buckets:
                return None
            rows = self._rows(g, {b: g.buckets[b]})
            for k, v in zip(self.keys, values, strict=True):
                rows = rows.where(F.col(k).eqNullSafe(F.lit(v).cast(g.schema[k].dataType)))
            return None if rows.isEmpty() else rows
        except Damaged:
            return None
        except Exception as e:  # Spark says with several classes that a file is gone or isn't Parquet
            if any(said in str(e) for said in ("FAILED_READ_FILE", "PATH_NOT_FOUND", "is not a Parquet file", "FileNotFoundException", "CANNOT_READ_FILE")):
                return None
            raise

    # -- writing --

    def _last_of_each(self, rows: DataFrame, order: str | None) -> DataFrame:
        """A row a key: the last by ``order``; without one the largest, so that the same rows give the same table."""
        rest = [c for c in rows.columns if c not in self.keys]
        if not rest:
            return rows.distinct()
        by = F.struct(order, F.struct(*rest)) if order else F.struct(*rest)
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*[F.col(c) if c in self.keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])

    def _write(self, rows: DataFrame, folder: str, count: int) -> set[int]:
        """Rows as buckets in a new folder; the buckets that have any."""
        rows.withColumn("bucket", self.bucket(count)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        at, fs = self._path(f"data/{folder}")
        return {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(at) if s.getPath().getName().startswith("bucket=")}

    def replace(self, rows: DataFrame, order: str | None = None, **notes: str) -> Generation:
        """The whole table anew, as the next generation."""
        before = self.generation()
        return self._next(before, self._last_of_each(rows, order), rows.schema, {}, before.count if before else self.count, notes)

    def upsert(self, rows: DataFrame, deleted: DataFrame | None = None, order: str | None = None, **notes: str) -> Generation:
        """Rows by key (the last by ``order`` of those that share one) in place of those that are there, and without the
        keys of ``deleted`` (its key columns), unless a new row has that key. Buckets without any such key aren't read.

        Both are shuffled by key with the rows of the touched buckets once."""
        before = self.generation()
        if before is None:
            return self.replace(rows, order, **notes)
        rows = self._last_of_each(rows.select(*before.schema.names), order)
        gone = rows.select(*self.keys)
        if deleted is not None:
            gone = gone.unionByName(deleted.select(*[F.col(k).cast(before.schema[k].dataType).alias(k) for k in self.keys])).distinct()
        touched = {r[0] for r in gone.select(self.bucket(before.count)).distinct().collect()}  # at most the number of buckets
        old = self._rows(before, {b: folder for b, folder in before.buckets.items() if b in touched})
        same = F.lit(True)
        for k in self.keys:
            same = same & old[k].eqNullSafe(gone[k])
        kept = old.join(gone, same, "left_anti").unionByName(rows)
        untouched = {b: folder for b, folder in before.buckets.items() if b not in touched}
        return self._next(before, kept, before.schema, untouched, before.count, notes)

    def _next(self, before: Generation | None, rows: DataFrame, schema: T.StructType, untouched: dict[int, str], count: int, notes: dict[str, str]) -> Generation:
        number = before.number + 1 if before else 1
        folder = f"{number:012}-{uuid.uuid4().hex}"
        written = self._write(rows, folder, count)
        g = Generation(number, untouched | dict.fromkeys(written, folder), self.keys, count, schema, notes)
        self._commit(g)
        return g

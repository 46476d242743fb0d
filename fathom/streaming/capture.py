"""Change capture as a stream: complete scans of a source go in, changes of its keys come out.

A scan is a batch of rows (key, digest, at) of one time, complete: a key that an earlier scan had and this one hasn't was
removed. Each key has a value of its own in the state store, and timers on the scans' time say when it was missed and when
its tombstone is old enough to go, so a scan costs its own rows and those that change, not the table of all that is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from fathom.sources.store import Store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CHANGE = "key string, digest string, change string, at timestamp, deleted_at timestamp"
#: The state store that keeps values and timers of single keys.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class _Capture(StatefulProcessor):
    """One key: its digest, when it was last seen, and when it was found to be gone (0: it is there), in milliseconds."""

    def __init__(self, retention_ms: int):
        self.retention = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "digest string, seen long, gone long")

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _change(self, key, *rows: tuple) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["key", "digest", "change", "at", "deleted_at"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        scans = pd.concat(list(rows)).sort_values(["at", "digest"]).drop_duplicates("at", keep="last")
        if key[0] is None:  # says that there was a scan
            return
        known, found = self.state.get() if self.state.exists() else None, []
        for at, digest in zip(scans["at"], scans["digest"], strict=True):
            now = int(at.value // 1_000_000)
            alive = known is not None and not known[2]
            if not alive or known[0] != digest:
                found.append((digest, "changed" if alive else "added", _time(now), None))
            known = (digest, now, 0)
        self.state.update(known)
        self._timer(known[1] + 1)
        yield from self._change(key, *found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (digest, seen, gone) = timerValues.getCurrentWatermarkInMs(), self.state.get()
        if not gone and seen < now:
            self.state.update((digest, seen, now))
            self._timer(now + self.retention + 1)
            yield from self._change(key, (digest, "removed", _time(now), _time(now)))
        elif gone and now > gone + self.retention:
            self.state.clear()
            yield from self._change(key, (digest, "expired", _time(now), _time(gone)))


def changes(scans: DataFrame, retention_ms: int = 30 * 86_400_000) -> DataFrame:
    """key, digest, change (added, changed, removed, expired), at, deleted_at of a stream of scans.

    Every scan has one time (``at``), later than those before, and rows for all keys that are there; a row with a null key
    says that there was a scan, for those that found nothing. Of rows with one key and time the last by digest counts. A
    key is found to be gone with the scan that misses it, which is when that scan has been read; scans that are read
    together are taken in order, though a key that one of them misses and a later one has isn't told apart from one that
    stayed. A tombstone expires with the first scan more than ``retention_ms`` after it. Set the state store's
    provider to ``PROVIDER``."""
    rows = scans.select(F.col("key").cast("string").alias("key"), F.col("digest").cast("string").alias("digest"), F.col("at").cast("timestamp").alias("at"))
    keyed = rows.withWatermark("at", "0 seconds").groupBy("key")
    return keyed.transformWithStateInPandas(_Capture(retention_ms), CHANGE, "append", "eventTime")


def marked(scan: DataFrame, at: str) -> DataFrame:
    """A scan's rows (key, digest) with its time, and the row that says that it was made."""
    said = scan.sparkSession.createDataFrame([(None, None)], "key string, digest string")
    return scan.select("key", "digest").unionByName(said).withColumn("at", F.lit(at).cast("timestamp"))


def keep(found: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """The state of all keys in a keyed store, brought up to date by a stream of changes: tombstones stay until they
    expire. A batch that is tried again is known by its number, which the store commits with its rows."""

    def merge(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path, ("key",), buckets)
        last = store.generation()
        if last is not None and int(last.notes.get("batch", -1)) >= number:
            return
        # Of one key the last change of a batch counts.
        rows = batch.groupBy("key").agg(F.max_by(F.struct("digest", "change", "at", "deleted_at"), F.struct("at", F.col("change") == "expired")).alias("r")).select("key", "r.*")
        store.upsert(rows.where("change <> 'expired'"), rows.where("change = 'expired'").select("key"), batch=str(number))

    return found.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, path: str) -> DataFrame | None:
    """What is known of all keys: key, digest, change, at, deleted_at; none before the first batch."""
    return Store(spark, path, ("key",)).read()

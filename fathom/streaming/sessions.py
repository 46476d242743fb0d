"""Sessions and incremental ingest, for tables and streams alike."""

from __future__ import annotations

from fathom.sources.store import Store
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """key, started_at, ended_at, turns of every session; one ends where nothing comes for ``gap``. For a stream
    give a watermark: it bounds the state and says how late an event may come."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    found = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("turns"))
    return found.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "turns")


def last_turns(turns: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def ingest_keyed(stream: DataFrame, path: str, checkpoint: str, key: str, digest: str) -> StreamingQuery:
    """Bring a keyed store at ``path`` up to date with what each batch of a stream adds or changes, a row a key (the last
    by digest of those in one batch): only the buckets that a batch touches are read and written, and rows that are there
    already aren't written again. A batch that is tried again is skipped, as the store commits its number with its rows.
    Ends when what is there has been read."""

    def merge(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path, (key,))
        last = store.generation()
        if last is not None and int(last.notes.get("batch", -1)) >= number:
            return
        fresh = batch
        if last is not None:
            touched = [r[0] for r in batch.select(store.bucket(last.count)).distinct().collect()]  # at most the number of buckets
            known = store.read(last.number, touched).select(F.col(key).alias("_key"), F.col(digest).alias("_digest"))
            fresh = batch.join(known, batch[key].eqNullSafe(known["_key"]) & batch[digest].eqNullSafe(known["_digest"]), "left_anti")
        store.upsert(fresh, order=digest, batch=str(number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str, digest: str) -> StreamingQuery:
    """Append to ``path``, as a log of all versions, what each batch of a stream adds or changes; a batch that is tried again is skipped,
    as its number is a folder of the table. Ends when what is there has been read."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key, digest])
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):  # no batch yet
            fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
            return
        kinds = T.StructType([*batch.schema.fields, T.StructField("batch", T.IntegerType())])
        known = spark.read.schema(kinds).parquet(path).where(F.col("batch") < number).select(key, F.col(digest).alias("_digest"))
        fresh = fresh.join(known, [F.col(digest) == F.col("_digest"), batch[key] == known[key]], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Change capture as a stream against ``next_state`` folded over the same scans, and incremental ingest."""

import random

import pytest
from fathom.operators import governance
from fathom.sources.store import Store
from fathom.streaming import capture, sessions
from pyspark.sql import functions as F

DAY = 86_400_000


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, capture.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def _scans():
    """Keys that come, change, go, come back, and go for longer than tombstones are kept; one scan finds nothing."""
    rng = random.Random(2)
    out = []
    for day in range(1, 8):
        rows = {f"k{i}": f"v{rng.randrange(2)}" for i in range(30) if rng.random() < 0.7} if day != 5 else {}
        if day == 1:
            rows["once"] = "v"
        out.append((f"2024-03-{3 * day:02} 00:00:00", rows))
    return out


def test_a_stream_of_scans_equals_next_state(rocks, tmp_path):
    spark, scans = rocks, _scans()
    source, target, checkpoint = str(tmp_path / "scans"), str(tmp_path / "state"), str(tmp_path / "cp")
    state = spark.createDataFrame([], "key string, digest string, deleted_at timestamp")
    for n, (at, rows) in enumerate(scans):
        now = spark.createDataFrame(list(rows.items()), "key string, digest string")
        capture.marked(now.unionByName(now.limit(3)), at).coalesce(1).write.mode("append").parquet(source)
        if n in (0, 3, 4, len(scans) - 1):  # otherwise the next run finds several scans, one file a batch
            stream = spark.readStream.schema("key string, digest string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
            capture.keep(capture.changes(stream, 7 * DAY), target, checkpoint, 4).awaitTermination()
        time = F.lit(at).cast("timestamp")
        state = spark.createDataFrame(governance.next_state(now, state, "key", "digest", time, time - F.expr("interval 7 days")).select("key", "digest", "deleted_at").collect(), "key string, digest string, deleted_at timestamp")
        if n in (0, 3, 4, len(scans) - 1):
            wanted = sorted((r["key"], r["digest"], r["deleted_at"]) for r in state.collect())
            got = sorted((r["key"], r["digest"], r["deleted_at"]) for r in capture.state(spark, target).collect())
            assert got == wanted, n
    assert "once" not in {r["key"] for r in state.collect()}


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    run = lambda cp: sessions.ingest_keyed(spark.readStream.schema("k string, h string").parquet(source), target, str(tmp_path / cp), "k", "h").awaitTermination()
    spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1"), ("a", "1")], "k string, h string").write.parquet(source)
    run("one")
    first = Store(spark, target, ("k",)).generation()
    assert sorted(map(str, Store(spark, target, ("k",)).read().collect())) == sorted(map(str, spark.createDataFrame([("a", "1"), ("b", "1"), (None, "1")], "k string, h string").collect()))
    run("two")  # the same batch number from a lost checkpoint
    assert Store(spark, target, ("k",)).generation() == first
    spark.createDataFrame([("a", "2"), ("c", "1"), ("b", "1")], "k string, h string").write.mode("append").parquet(source)
    run("one")
    assert {r["k"]: r["h"] for r in Store(spark, target, ("k",)).read().collect()} == {"a": "2", "b": "1", "c": "1", None: "1"}

"""Indexes against scans, and the keyed store: batches, failures, conflicts, snapshots."""

import os
import random

import numpy as np
import pytest
from fathom.operators import batch, index
from fathom.sources.store import Conflict, Store
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((40, 16))
    rows = [(i, (middle[i % 40 if i % 3 else 0] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(3000)]  # a third in one place
    rows += [(3000 + i, rows[i % 7][1]) for i in range(40)] + [(4000, None), (4001, [0.0] * 16), (4002, [1.0] * 3), (4003, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    path = str(tmp_path_factory.mktemp("vectors")) + "/file"
    index.build_vectors(table, path, settings=index.VectorSettings(sample_rows=1500))
    asked = [(q, (middle[q % 40] + 0.6 * rng.standard_normal(16)).tolist()) for q in range(60)] + [(60, None), (61, [0.0] * 16)]
    questions = spark.createDataFrame(asked, "question_id long, query array<double>")
    return rows, table, path, asked, questions


def _nearest(rows, asked, k, allowed=lambda i: True):
    out = set()
    for q, v in asked:
        if v is None or not any(v):
            continue
        scored = [(-round(max(0.0, float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x))), 9), i) for i, x in rows if x and len(x) == len(v) and np.isfinite(x).all() and any(x) and allowed(i)]
        out |= {(q, i, n) for n, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_probing_finds_nine_of_ten(spark, vectors):
    rows, _, path, asked, questions = vectors
    wanted = {(q, i) for q, i, _ in _nearest(rows, asked, 10)}
    got = {(r["question_id"], r["chunk_id"]) for r in index.search_vectors(spark, path, questions, 10, probes=8).collect()}
    assert len(got & wanted) >= 0.9 * len(wanted)


def test_the_exact_way_is_exact(spark, vectors):
    rows, _, path, asked, questions = vectors
    got = {(r["question_id"], r["chunk_id"], r["pos"]) for r in index.search_vectors(spark, path, questions, 10, probes=1, exact=True, block=20).collect()}
    assert got == _nearest(rows, asked, 10)


def test_access_goes_before_the_best(spark, vectors):
    rows, table, path, asked, questions = vectors
    allowed = table.where("chunk_id % 4 = 1").select("chunk_id")
    got = {(r["question_id"], r["chunk_id"], r["pos"]) for r in index.search_vectors(spark, path, questions, 5, exact=True, allowed=allowed).collect()}
    assert got == _nearest(rows, asked, 5, lambda i: i % 4 == 1)


def test_all_rows_are_assigned_and_only_probed_lists_are_read(spark, vectors):
    rows, table, path, _, _ = vectors
    kept = spark.read.parquet(f"{path}/rows")
    assert kept.count() == len(rows) and {r[0] for r in kept.where("_list = -1").select("chunk_id").collect()} == {4000, 4001, 4002, 4003}
    plan = index.probed(kept, [2, 5])._jdf.queryExecution().executedPlan().toString()
    assert "_list" in plan.split("PartitionFilters:")[1].split("]")[0]
    read = {os.path.basename(os.path.dirname(f)) for f in index.probed(kept, [2, 5]).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read <= {"_list=2", "_list=5"}
    index.build_vectors(table.limit(0), path + "-none")
    assert index.search_vectors(spark, path + "-none", table.limit(5).select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("query")), 3).count() == 0


WORDS = ["fox", "foxes", "riverbank", "la", "été", "x-y", "日本語", "aaaa", "A", "né"]


@pytest.mark.parametrize("k", [5, 300])
def test_postings_equal_the_scan(spark, tmp_path, k):
    rng = random.Random(7)
    rows = [(f"u{i:03}", " ".join(rng.choices(WORDS, k=rng.randint(1, 30))) if i % 40 else None, f"c{i % 3}", f"f{i % 4}") for i in range(150)] + [("v", "", "c1", "f1"), ("w", "-- !", "c2", "f0")]
    units = spark.createDataFrame(rows, "chunk_id string, content string, category string, source_file string")
    index.build_postings(units, str(tmp_path / "p"), buckets=8)
    terms = [["fox"], ["x-y", "la", ""], ["aa", "é"], ["fox fox", "x-y la"], ["-", "zzz"], [], ["y x", "日本", "er"], ["a", "a", "A"]]
    questions = spark.createDataFrame([(q, t, f"c{q % 4}", [f"f{q % 5}"]) for q, t in enumerate(terms)], "question_id long, terms array<string>, category string, files array<string>")
    shown = lambda df: sorted((r["question_id"], r["chunk_id"], round(r["score"], 9), r["pos"]) for r in df.collect())
    assert shown(index.term_index_search(spark, str(tmp_path / "p"), units, questions, k)) == shown(batch.term_batch(units, questions, k))
    assert shown(index.keyword_index_search(spark, str(tmp_path / "p"), units, questions, k)) == shown(batch.keyword_batch(units, questions, k))
    found = {(r["term"], r["chunk_id"]): r["n"] for r in index.occurrences(spark, str(tmp_path / "p"), units, questions.select(F.explode("terms"))).collect()}
    index.build_postings(units.limit(0), str(tmp_path / "none"))
    assert index.term_index_search(spark, str(tmp_path / "none"), units.limit(0), questions, k).count() == 0
    assert found == {(t, i): x.count(t) for i, x, *_ in rows if x for ts in terms for t in ts if t and t in x}


def _all(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store_keeps_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ("doc", "part"), 8)
    assert store.read() is None and store.snapshot(("a", 1)) is None and store.generation() is None
    rows = [(f"d{i % 50}", i, f"text {i}") for i in range(200)] + [(None, 1, "no document")]
    table = spark.createDataFrame(rows, "doc string, part int, text string")
    assert store.replace(table, note="first").number == 1
    new = spark.createDataFrame([("d3", 3, "changed"), ("new", 1, "added"), ("new", 1, "added later"), (None, 1, "null again")], "doc string, part int, text string")
    gone = spark.createDataFrame([("d4", 4), ("none", 0), ("new", 1)], "doc string, part int")
    second = store.upsert(new, gone)
    wanted = {(d, p): t for d, p, t in rows} | {("d3", 3): "changed", ("new", 1): "added later", (None, 1): "null again"}
    del wanted["d4", 4]
    assert {(r["doc"], r["part"]): r["text"] for r in store.read().collect()} == wanted and store.read().count() == len(wanted)
    assert _all(store.read(1)) == sorted(rows, key=str) and store.generation(1).notes == {"note": "first"}
    touched = {b for b, folder in second.buckets.items() if folder.startswith("000000000002-")}
    assert 0 < len(touched) < 8 and all(second.buckets[b] == store.generation(1).buckets[b] for b in set(range(8)) - touched)
    assert _all(store.snapshot(("d3", 3))) == [("d3", 3, "changed")] and _all(store.snapshot(("d3", 3), 1)) == [("d3", 3, "text 3")]
    assert _all(store.snapshot((None, 1), 2)) == [(None, 1, "null again")] and store.snapshot(("d4", 4)) is None and store.snapshot(("d3", 3), 9) is None


def test_a_failed_batch_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ("id",), 4)
    rows = spark.createDataFrame([(i, "a") for i in range(40)], "id int, v string")
    store.replace(rows)
    broken = rows.withColumn("v", F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise("b"))
    with pytest.raises(Exception, match="no"):
        store.upsert(broken)
    assert store.generation().number == 1 and _all(store.read()) == sorted([(i, "a") for i in range(40)], key=str)
    assert store.upsert(rows.where("id < 5").withColumn("v", F.lit("c"))).number == 2
    assert store.read().where("v = 'c'").count() == 5 and store.read().count() == 40


def test_the_slower_writer_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(i, "a") for i in range(10)], "id int, v string")
    slow, fast = Store(spark, path, ("id",), 4), Store(spark, path, ("id",), 4)
    slow.replace(rows)
    write = Store._write

    def overtaken(self, *some):
        if self is slow:
            fast.upsert(rows.where("id = 1").withColumn("v", F.lit("fast")))
        return write(self, *some)

    monkeypatch.setattr(Store, "_write", overtaken)
    with pytest.raises(Conflict):
        slow.upsert(rows.where("id = 2").withColumn("v", F.lit("slow")))
    monkeypatch.undo()
    assert store_values(Store(spark, path, ("id",))) == {i: "fast" if i == 1 else "a" for i in range(10)}


def store_values(store):
    return {r["id"]: r["v"] for r in store.read().collect()}


def test_damaged_snapshots_are_none(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ("id",), 2)
    g = store.replace(spark.createDataFrame([(1, "a")], "id int, v string"))
    ((b, folder),) = g.buckets.items()
    folder = tmp_path / "s" / "data" / folder / f"bucket={b}"
    for f in folder.iterdir():
        if f.name.endswith(".parquet"):
            f.write_bytes(b"not parquet")
        elif f.name.endswith(".crc"):
            f.unlink()
    assert store.snapshot((1,)) is None
    (tmp_path / "s" / "manifests" / "000000000002.json").write_text("{")
    assert store.snapshot((1,)) is None

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs with one word between; every coordinate has its
own learning rate and an L1 pull to zero, so the model is a short list of weights, small enough to broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import forget, only, released, task, written
from .tokens import portions

_WORD = re.compile(r"[^\W_]+")
_WORDS: dict[str, int] = {}


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows that are learned from (each class at most half of it), max_features the features
    of all of them together (4 bytes each); a text with more than an eighth of that isn't learned from. The rates were
    chosen by ``cross_validate`` within learning rows."""

    hash_bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 5
    max_rows: int = 8_000
    max_features: int = 16_000_000
    max_weights: int = 1 << 20


@dataclass(frozen=True)
class Model:
    """Hashed feature numbers and their weights, both sorted by number; the rest of the weights are zero."""

    indices: np.ndarray
    weights: np.ndarray
    bias: float
    hash_bits: int


def _word_ids(text: str) -> np.ndarray:
    """64-bit hashes of the lower-case words; a worker keeps those of up to 200,000 short words."""
    known, out = _WORDS, []
    if len(known) > 200_000:
        known.clear()
    for w in _WORD.findall(text.lower()):
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= 32:
                known[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def features(text: str | None, hash_bits: int = 20) -> np.ndarray:
    """Distinct hashed features of a whole text: words, pairs, and pairs that skip a word."""
    w = _word_ids(text or "")
    mix = lambda a, b, salt: (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    found = [w, mix(w[:-1], w[1:], 1), mix(w[:-2], w[2:], 2)] if len(w) else [w]
    return np.unique((np.concatenate(found) >> np.uint64(64 - hash_bits)).astype(np.int64))


def fit_rows(texts: list[str | None], labels: list[int], s: Settings, weight: dict[int, float] | None = None) -> Model:
    """The model of texts in the order given."""
    return fit([features(t, s.hash_bits) for t in texts], labels, s, weight)


def fit(rows: list[np.ndarray], labels: list[int], s: Settings, weight: dict[int, float] | None = None) -> Model:
    """FTRL-proximal over the rows' features in the order given, several times over; gradients count by the weight of
    the label."""
    z, n = np.zeros(1 << s.hash_bits), np.zeros(1 << s.hash_bits)
    zb = nb = 0.0
    weight = weight or {0: 1.0, 1: 1.0}
    for _ in range(s.epochs):
        for f, y in zip(rows, labels, strict=True):
            zf, nf = z[f], n[f]
            root = np.sqrt(nf)
            w = np.where(np.abs(zf) <= s.l1, 0.0, (np.sign(zf) * s.l1 - zf) / ((s.beta + root) / s.alpha + s.l2))
            wb = -zb * s.alpha / (s.beta + nb**0.5)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -30, 30))) - y
            g *= weight[y]
            z[f] += g - (np.sqrt(nf + g * g) - root) / s.alpha * w
            n[f] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / s.alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    kept = np.flatnonzero(w)
    return Model(kept, w[kept], -zb * s.alpha / (s.beta + nb**0.5), s.hash_bits)


def _sample(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, float]]:
    """y, order, id, features of the rows to learn from, and what a row of each class counts (1 on average)."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    counts = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    cut = F.lit(0)
    for y, n in counts.items():
        cut = F.when(F.col("_y") == y, F.lit(round(min(1.0, 0.5 * s.max_rows / n) * (1 << 30)))).otherwise(cut)
    # The order of learning has a hash of its own: by the first one the rarer class, of which more is taken, would come last.
    chosen = marked.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) < cut).withColumn("_order", F.xxhash64("_id", F.lit(12)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("_y").alias("_y"), F.max("_order").alias("_order"), F.min("_text").alias("_text"))

    @task
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words", _WORDS)
        for batch in batches:
            for part in portions(batch, 2):
                found = [features(t, s.hash_bits).astype(np.int32) for t in part.column(2).to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["y", "order", "features"])

    made = written(rows.select("_y", "_order", "_text").mapInArrow(make, "y int, order long, features array<int>"), "features")
    made = made.where(F.size("features") <= s.max_features // 8)
    # At most max_rows rows are added up, so one task may have them.
    running = made.select("y", "order", "features", F.sum(F.size("features")).over(Window.orderBy("order", "y", F.xxhash64("features")).rowsBetween(Window.unboundedPreceding, 0)).alias("all"))
    kept = written(running.where(F.col("all") <= s.max_features).drop("all"), "learned")
    forget(made)
    taken = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}
    scale = sum(taken.values()) / max(1, sum(counts[y] for y in taken))
    return kept, {y: counts[y] / n * scale for y, n in taken.items()}


def _ordered(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of rows in the order of learning."""
    group = group.sort_by([("order", "ascending"), ("y", "ascending")]).combine_chunks()
    lists = group["features"].combine_chunks() if group.num_rows else pa.array([], pa.list_(pa.int32()))
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], group["y"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled documents: a bounded sample by a hash of the id, each class up to half the bound.
    Where that takes more of one class than of the other, rows count by 1 / share of their class (1 on average),
    so scores stand for the classes of the whole table, whatever its size.

    Rows without id or label are left out; an id with several labels is toxic if any says so; of the texts of one
    id the first in order counts; empty and null texts teach the base rate. Features are made where the texts are, and
    the sample's alone are moved, to one task that learns; the driver gets the weights that aren't zero. Without labels
    the model has no weights and a base rate of one half.
    """
    s = settings
    rows, weight = _sample(docs, labels, s, id_col, text_col, label_col)

    def learn(group: pa.Table) -> pa.Table:
        found, y = _ordered(group)
        m = fit(found, y.tolist(), s, weight)
        top = np.sort(np.argsort(-np.abs(m.weights), kind="stable")[: s.max_weights])
        released()
        return pa.table({"i": np.append(m.indices[top], -1), "w": np.append(m.weights[top], m.bias)})

    got = rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "i long, w double").toArrow().sort_by("i")
    forget(rows)
    if not got.num_rows:
        return Model(np.array([], np.int64), np.array([]), 0.0, s.hash_bits)
    i, w = got["i"].to_numpy(), got["w"].to_numpy()
    return Model(i[1:], w[1:], float(w[0]), s.hash_bits)


def cross_validate(
    docs: DataFrame, labels: DataFrame, grid: list[Settings], folds: int = 4, limit: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """setting (its place in the grid), recall, false_alarms, weights (mean number): how each of the settings does on
    folds of the learning rows that it hasn't seen, at a limit of the score. Rows are sampled as ``train`` does it, with
    the bounds and hash of the first of the grid; every fold of every setting is a task of its own."""
    rows, weight = _sample(docs, labels, grid[0], id_col, text_col, label_col)
    jobs = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(f).alias("fold")) for i in range(len(grid)) for f in range(folds)]))

    def judge(group: pa.Table) -> pa.Table:
        s, fold = grid[group["setting"][0].as_py()], group["fold"][0].as_py()
        found, y = _ordered(group)
        out = np.arange(len(y)) % folds == fold
        m = fit([f for f, o in zip(found, out, strict=True) if not o], y[~out].tolist(), s, weight)
        dense = np.zeros(1 << s.hash_bits)
        dense[m.indices] = m.weights
        said = np.array([1 / (1 + np.exp(-np.clip(dense[found[i]].sum() + m.bias, -500, 500))) >= limit for i in np.flatnonzero(out)], bool)
        held = y[out] == 1
        counts = [int(x) for x in (held.sum(), (said & held).sum(), (~held).sum(), (said & ~held).sum(), len(m.indices))]
        return pa.table({"setting": pa.array([group["setting"][0].as_py()], pa.int32())} | {c: pa.array([n], pa.int64()) for c, n in zip(("toxic", "caught", "clean", "alarms", "weights"), counts, strict=True)})

    each = rows.withColumn("job", jobs).select("job.*", "y", "order", "features").groupBy("setting", "fold").applyInArrow(judge, "setting int, toxic long, caught long, clean long, alarms long, weights long")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    return each.groupBy("setting").agg(ratio("caught", "toxic").alias("recall"), ratio("alarms", "clean").alias("false_alarms"), F.avg("weights").alias("weights"))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Add the probability of the toxic label, from the whole text alone, as a column ``out``.

    Empty and null texts get the model's base rate. All rows and columns stay; a column named like ``out`` is
    replaced. No shuffle: the weights go out once to each worker.
    """
    from pyspark.sql import types as T

    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("words", _WORDS)
        m = sent.value
        dense = np.zeros(1 << m.hash_bits)
        dense[m.indices] = m.weights
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in portions(batch, at):
                sums = np.array([dense[features(t, m.hash_bits)].sum() for t in part.column(at).to_pylist()]) + m.bias
                p = 1.0 / (1.0 + np.exp(-np.clip(sums, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))

"""The training-corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns a DataFrame;
every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from fathom.llm import decontam, jaccard, packing, secrets, toxicity
from fathom.llm.shared import forget, small_batches, unused, written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents at or above this probability of the toxic label go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: learn from the labelled documents among these, score all, keep those below the limit.
    Null and empty texts have the model's base rate; repeated rows have one score and go or stay together;
    without labels nothing is toxic."""
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = unused("toxicity", docs)
    return toxicity.score(docs, model, out=out).where(F.col(out) < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near copies stays (five-word shingles, similarity 0.8), of repeated
    rows one; null and empty texts are in no group and stay."""
    small_batches(spark)
    return jaccard.keep_one(docs, settings=jaccard.Settings(words=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that hold a window of a benchmark item go. Null and empty texts, and all if the
    benchmark is empty, stay."""
    small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: secrets are replaced in the text; all documents stay, null and empty texts as they are.
    n_chars, where there is one, is that of the new text (null for null)."""
    small_batches(spark)
    found = secrets.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of documents, by sequence and offset; a null text is its end id alone, repeated rows
    are documents of their own, no documents give no pieces. Workers take less at once than they do alone, as the executors
    still hold what the stages before made of them."""
    small_batches(spark)
    return packing.pack(docs, portion_bytes=2_000_000, cached=150_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), name)
        forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the learned model or the tokenizer; tests compare the other stages with plain versions.
ORACLE_SQL = None

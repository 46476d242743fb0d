"""The driver's tables as the engine's: documents, chunks, vectors, rules, versions, graph, cases and logs."""

from __future__ import annotations

from fathom.operators.chunking import fixed_windows
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), F.concat("source", F.lit(".txt")).alias("source_file"), F.col("text").alias("content"), "lang")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 600 characters that overlap by 100."""
    return fixed_windows(documents(spark, sf_dir), "content", 600, 100)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, with the label as category."""
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"))
    return documents(spark, sf_dir).join(found, "doc_id")


def access(docs: DataFrame) -> DataFrame:
    """Rules of access: two of three documents public, the rest for one role."""
    public = F.col("doc_id") % 3 != 0
    role = F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string"))
    return docs.select("doc_id", F.when(public, "public").otherwise("restricted").alias("visibility"), F.array().cast("array<string>").alias("users"), F.when(public, F.array().cast("array<string>")).otherwise(F.array(role)).alias("roles"), F.array().cast("array<string>").alias("groups"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer's document."""
    status = F.create_map(*map(F.lit, ("F", "published", "O", "draft", "P", "retired")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("doc-"), F.col("o_custkey").cast("string")).alias("document_id"), F.col("o_orderkey").alias("version"), F.element_at(status, F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("effective_at")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers in nations, nations in regions."""
    nation = table(spark, sf_dir, "nation")
    one = lambda df, source, label, target, file: df.select(source.alias("source"), F.lit(label).alias("label"), target.alias("target"), F.lit(file).alias("source_file"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    return (
        one(nation, name("nation-", "n_nationkey"), "part of", name("region-", "n_regionkey"), "nations.txt")
        .unionByName(one(table(spark, sf_dir, "supplier"), name("supplier-", "s_suppkey"), "located in", name("nation-", "s_nationkey"), "suppliers.txt"))
        .unionByName(one(table(spark, sf_dir, "customer"), name("customer-", "c_custkey"), "located in", name("nation-", "c_nationkey"), "customers.txt"))
    )

"""A graph that was built and written as one JSON object, or the one that comes with the library."""

from __future__ import annotations

from fathom.session import cut
from fathom.sources.files import exists
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODE = T._parse_datatype_string("id string, label string, type string, category string, source_files array<string>, document_ids array<string>")
_EDGE = T._parse_datatype_string("id string, source string, target string, label string, relation string, description string, evidence string, source_file string, document_id string, confidence double")
_GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(_NODE)), T.StructField("edges", T.ArrayType(_EDGE)), T.StructField("_corrupt", T.StringType())])


def read_graph(spark: SparkSession, path: str, static_nodes: DataFrame, static_edges: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Nodes, edges, and where they come from: the object at ``path`` (nodes, edges), or the static tables, where there is no
    such file, it isn't JSON, or it has no edges. A node without id has its label for one, an edge without label its relation."""
    if exists(spark, [path])[path]:
        whole = cut(spark.read.schema(_GRAPH).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path))
        edges = whole.select(F.explode("edges").alias("e")).select("e.*").where(F.col("source").isNotNull() & F.col("target").isNotNull())
        if whole.where(F.col("_corrupt").isNotNull()).isEmpty() and not edges.isEmpty():
            label = F.coalesce(F.nullif("label", F.lit("")), F.col("relation"), F.lit(""))
            nodes = whole.select(F.explode("nodes").alias("n")).select("n.*").withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.col("label")))
            return nodes, edges.withColumn("label", label).drop("relation"), "dynamic_graph"
    return static_nodes, static_edges, "static_graph"

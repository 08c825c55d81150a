"""Graph documents in JSON: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, as_edges, as_nodes

SCHEMA_VERSION = "2.0"
_NODE = "struct<id:string,label:string,type:string,source_file:string,source_location:string,confidence:string,is_god_node:boolean,community_id:bigint,metadata:string,language:string>"
_EDGE = "struct<source:string,target:string,relation:string,context:string,confidence:string,source_file:string,source_location:string,weight:double,metadata:string>"
DOCUMENT = f"schema_version string, project_root string, nodes array<{_NODE}>, edges array<{_EDGE}>, communities array<struct<id:bigint,nodes:array<string>>>"


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of a JSON document. Nodes and edges keep the document's order; absent fields have their defaults."""
    d = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    nodes = d.select(F.posexplode("nodes").alias("ord", "n")).select("n.*", "ord")
    edges = d.select(F.posexplode("edges").alias("ord", "e")).select("e.*", "ord")
    members = d.select(F.explode("communities").alias("c")).select(F.explode("c.nodes").alias("node_id"), F.col("c.id").alias("community_id"))
    return Graph(as_nodes(nodes), as_edges(edges), members)


def read_tables(spark: SparkSession, path: str) -> Graph:
    """The graph that write_tables wrote: how graphs beyond one machine are kept."""
    return Graph(as_nodes(spark.read.parquet(f"{path}/nodes")), as_edges(spark.read.parquet(f"{path}/edges")))


def write_tables(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def document(graph: Graph) -> DataFrame:
    """One row, column json: the whole graph as a document. For graphs that fit in a row; otherwise use json_lines."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        row = F.struct("ord", F.struct(*(c for c in df.columns if c != "ord")).alias("x"))
        return df.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]).alias(name))

    both = rows(graph.nodes, "nodes").crossJoin(rows(graph.edges, "edges"))
    return both.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(graph.project).alias("project_root"), "nodes", "edges")).alias("json"))


def json_lines(graph: Graph) -> DataFrame:
    """A JSON object for each node and edge, told apart by kind."""
    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))

    return rows(graph.nodes, "node").unionByName(rows(graph.edges, "edge"))

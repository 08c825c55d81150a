"""The data model: nodes and edges as DataFrames, and the domains of their columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "id string, label string, type string, source_file string, source_location string, confidence string, "
    "is_god_node boolean, community_id bigint, metadata string, language string, ord decimal(38,0)"
)
EDGE_SCHEMA = (
    "source string, target string, relation string, context string, confidence string, source_file string, "
    "source_location string, weight double, metadata string, ord decimal(38,0)"
)
MEMBER_SCHEMA = "node_id string, community_id bigint"

NODE_TYPES = (
    "class", "function", "method", "interface", "enum", "module", "variable", "file", "document", "concept",
    "rationale", "dependency", "config", "image", "database", "api",
)
CODE_TYPES = ("class", "function", "method", "interface", "enum", "module", "variable", "file")
STRUCTURAL = ("calls", "imports", "imports_from", "contains", "inherits", "implements", "re_exports", "depends_on")
SEMANTIC = ("references", "rationale_for", "related_to")
#: Score of each level of confidence.
CONFIDENCE = {"EXTRACTED": 1.0, "INFERRED": 0.7, "AMBIGUOUS": 0.3}


def is_code(type_: Column) -> Column:
    """Whether the type is a kind of code; a file is."""
    return type_.isin(*CODE_TYPES)


def is_rationale(type_: Column) -> Column:
    return type_ == "rationale"


def is_structural(relation: Column) -> Column:
    return relation.isin(*STRUCTURAL)


def is_semantic(relation: Column) -> Column:
    return relation.isin(*SEMANTIC)


def score(confidence: Column) -> Column:
    out = F.lit(None).cast("double")
    for level, value in CONFIDENCE.items():
        out = F.when(confidence == level, F.lit(value)).otherwise(out)
    return out


def is_reliable(confidence: Column) -> Column:
    return confidence != "AMBIGUOUS"


def annotation(confidence: Column, reasoning: Column | None = None) -> Column:
    """A confidence level with its score and, if given, a reason."""
    return F.struct(confidence.alias("level"), score(confidence).alias("score"), (reasoning if reasoning is not None else F.lit(None).cast("string")).alias("reasoning"))


def _conform(df: DataFrame, schema: str, defaults: dict[str, Column]) -> DataFrame:
    columns = []
    for part in schema.split(", "):
        name, kind = part.split(" ")
        if name in df.columns:
            c = F.col(name).cast(kind)
            c = F.coalesce(c, defaults[name].cast(kind)) if name in defaults else c
        else:
            c = defaults.get(name, F.lit(None)).cast(kind)
        columns.append(c.alias(name))
    return df.select(columns)


def as_nodes(df: DataFrame) -> DataFrame:
    """df with the columns of nodes, absent ones filled with their defaults; others go. Without ord, rows tie."""
    return _conform(df, NODE_SCHEMA, {"confidence": F.lit("EXTRACTED"), "is_god_node": F.lit(False), "ord": F.lit(0)})


def as_edges(df: DataFrame) -> DataFrame:
    return _conform(df, EDGE_SCHEMA, {"confidence": F.lit("EXTRACTED"), "weight": F.lit(1.0), "ord": F.lit(0)})


@dataclass(frozen=True)
class Graph:
    """A property graph; edges may point to ids that nodes lack. ord is the order of input, which first-wins rules use; it is wide
    enough for a file's number, a line and a place in it."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame | None = None
    project: str = "."

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_nodes(self, more: DataFrame) -> Graph:
        return Graph(self.nodes.unionByName(as_nodes(more)), self.edges, self.communities, self.project)

    def with_edges(self, more: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.unionByName(as_edges(more)), self.communities, self.project)

    def node(self, id_: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA))

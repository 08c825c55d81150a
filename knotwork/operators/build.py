"""Building graphs: deduplication, pruning, inference, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph, as_edges, as_nodes
from ..storage import spread
from . import metrics

IMPORTS = ("imports", "imports_from")


def _first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return spread(df, *keys).withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """The first node of each id, in input order."""
    return _first(nodes, ["id"], ["ord", "label"])


def dedupe_nodes_richest(nodes: DataFrame) -> DataFrame:
    """Of each id the node that knows most of its source file and metadata; the first of those in input order."""
    known = F.col("source_file").isNotNull().cast("int") + F.col("metadata").isNotNull().cast("int")
    return _first(nodes, ["id"], [known.desc(), F.col("ord"), F.col("label")])


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each file, source, target and relation; the same edge may come from several files."""
    return _first(edges, ["source_file", "source", "target", "relation"], ["ord"])


def prune_dangling(graph: Graph) -> Graph:
    """The graph without edges that lack an end among its nodes."""
    return Graph(graph.nodes, metrics.valid_edges(graph).select(graph.edges.columns), graph.communities, graph.project)


def infer_edges(graph: Graph) -> DataFrame:
    """References that follow from imports in one hop: from A, which imports B, to every C that B imports.

    Each import of B by A counts, and every distinct C that is a node and isn't A; nothing is deduplicated afterwards.
    """
    imports = graph.edges.where(F.col("relation").isin(*IMPORTS)).select("source", "target")
    onward = imports.distinct().join(graph.nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    onward = onward.select(F.col("source").alias("via"), F.col("target").alias("c"))
    hops = imports.join(onward, F.col("target") == F.col("via")).where(F.col("c") != F.col("source"))
    return as_edges(hops.select("source", F.col("c").alias("target"), F.lit("references").alias("relation"), F.lit("transitive_import").alias("context"), F.lit("INFERRED").alias("confidence"), F.lit(0.3).alias("weight")))


def dependency_nodes(deps: DataFrame) -> DataFrame:
    """A node for each dependency of a manifest (name, version, manifest)."""
    return as_nodes(
        deps.select(
            F.concat(F.lit("dep_"), F.translate("name", "-.", "__")).alias("id"), F.col("name").alias("label"), F.lit("dependency").alias("type"),
            F.col("manifest").alias("source_file"), F.to_json(F.struct("version")).alias("metadata"),
        )
    )


def merge(base: Graph, other: Graph, prefix: str) -> Graph:
    """base and other, whose ids get prefix::; edges of other that lack an end in it go. base's ids stay."""
    kept = metrics.valid_edges(other).select(other.edges.columns)
    named = lambda c: F.concat(F.lit(f"{prefix}::"), F.col(c))
    nodes = other.nodes.withColumn("id", named("id"))
    edges = kept.withColumn("source", named("source")).withColumn("target", named("target"))
    return Graph(base.nodes.unionByName(nodes), base.edges.unionByName(edges), None, base.project)


def merge_all(graphs: list[tuple[str, Graph]]) -> Graph:
    """Graphs by project folder: the first as it is, the others prefixed with their folder's name.

    Folders of equal name get a number, so that their ids stay apart.
    """
    used: dict[str, int] = {}

    def prefix(k: int, path: str) -> str:
        name = path.rstrip("/").rsplit("/", 1)[-1] or f"repo{k}"
        used[name] = used.get(name, 0) + 1
        return name if used[name] == 1 else f"{name}{used[name]}"

    names = [prefix(k, path) for k, (path, _) in enumerate(graphs)]
    return reduce(lambda done, x: merge(done, x[1], x[0]), list(zip(names, (g for _, g in graphs), strict=True))[1:], graphs[0][1])


def forget(everything: Graph, project: str) -> Graph:
    """The global graph without what a project put there."""
    mine = lambda c: F.coalesce(F.startswith(F.col(c), F.lit(f"{project}::")), F.lit(False))
    return Graph(everything.nodes.where(~mine("id")), everything.edges.where(~mine("source")), None, everything.project)


def accumulate(everything: Graph, graph: Graph, project: str) -> Graph:
    """The global graph with a project's graph, as it is now, under its name: what the project had there before goes.

    Doing it again changes nothing. Of each id the first node counts, of each source, target and relation the first edge.
    """
    empty = Graph(everything.nodes.limit(0), everything.edges.limit(0))
    own = merge(empty, Graph(dedupe_nodes(graph.nodes), _first(graph.edges, ["source", "target", "relation"], ["ord"])), project)
    rest = forget(everything, project)
    return Graph(rest.nodes.unionByName(own.nodes.select(rest.nodes.columns)), rest.edges.unionByName(own.edges.select(rest.edges.columns)), None, everything.project)


def build_graph(nodes: DataFrame, edges: DataFrame, project: str = ".") -> Graph:
    """A graph of what extraction found: nodes first by id, edges first by file, god nodes flagged."""
    g = Graph(dedupe_nodes(as_nodes(nodes)), dedupe_edges(as_edges(edges)), None, project)
    return Graph(metrics.flag_god_nodes(g), g.edges, None, project)


def build_stats(graph: Graph, nodes_before: int | None = None) -> DataFrame:
    """One row: sizes over all edges, and the rough number of lines, ten for each node found before deduplication."""
    n = graph.nodes.agg(F.count("*").alias("node_count"), F.count_distinct("source_file").alias("files"))
    e = graph.edges.agg(F.count("*").alias("edge_count"), *metrics.confidence_columns())
    nodes, edges = F.col("node_count"), F.col("edge_count")
    lines = F.lit(nodes_before).cast("bigint") if nodes_before is not None else nodes
    return n.crossJoin(e).select(
        "node_count", "edge_count", "files", (10 * lines).alias("total_lines"), F.when(nodes > 0, 2.0 * edges / nodes).otherwise(0.0).alias("avg_degree"),
        F.when(nodes > 1, edges / (nodes * (nodes - 1.0))).otherwise(1.0).alias("density"), "extracted", "inferred", "ambiguous",
    )

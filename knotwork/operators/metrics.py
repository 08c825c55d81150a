"""Degrees, hubs and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import CONFIDENCE, Graph, is_semantic, is_structural
from ..storage import spread, table


def endpoints(edges: DataFrame) -> DataFrame:
    """id of either end of every edge; a self-loop has two."""
    return edges.select(F.explode(F.array("source", "target")).alias("id"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) of whatever edges touch, nodes or not."""
    return spread(endpoints(edges), "id", like=edges).groupBy("id").agg(F.count("*").alias("degree"))


def touched(edges: DataFrame) -> DataFrame:
    """(id, in_degree, degree) of whatever edges touch, nodes or not, in one pass."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i")))).alias("e")).select("e.*")
    return spread(ends, "id", like=edges).groupBy("id").agg(F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def valid_edges(graph: Graph, like: DataFrame | None = None) -> DataFrame:
    """Edges both of whose ends are nodes. like: what nodes and edges are spread like, where edges are fewer than nodes."""
    like = graph.edges if like is None else like
    # Joined, not left_semi: the optimizer would move that below the spreading, into each part of a union.
    ids, columns = spread(graph.nodes.select("id"), "id", like=like).distinct(), graph.edges.columns
    e = spread(graph.edges, "source", like=like).join(ids.withColumnRenamed("id", "source"), "source").select(columns)
    return spread(e, "target", like=like).join(ids.withColumnRenamed("id", "target"), "target").select(columns)


def degree_in_out(graph: Graph) -> DataFrame:
    """(id, in_degree, out_degree, total_degree) of every node, over all edges. One pass over edges, one shuffle."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    counts = spread(ends, "id", like=graph.edges).groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    joined = graph.nodes.join(counts, "id", "left")
    i, o = F.coalesce("i", F.lit(0)).cast("bigint"), F.coalesce("o", F.lit(0)).cast("bigint")
    return joined.select("id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("total_degree"))


def god_nodes(graph: Graph, k: int = 10, counted: DataFrame | None = None) -> DataFrame:
    """The k ids of most edges, by degree, label, id; an id that is no node is labelled unknown. counted: what touched() found."""
    d = (degree(graph.edges) if counted is None else counted.select("id", "degree")).join(graph.nodes.select("id", "label"), "id", "left")
    return d.select("id", F.coalesce("label", F.lit("unknown")).alias("label"), "degree").orderBy(F.desc("degree"), "label", "id").limit(k)


def god_nodes_core(graph: Graph, k: int = 10) -> DataFrame:
    """The k nodes of most valid edges in input order; a self-loop counts once."""
    e = valid_edges(graph)
    ends = e.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    d = graph.nodes.join(ends, "id", "left").select("id", "label", "ord", F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.orderBy(F.desc("degree"), "ord", "id").limit(k).select("id", "label", "degree")


def god_threshold(graph: Graph) -> DataFrame:
    """One row: the degree at rank floor(0.99 n) from 0 of the n degrees. Computed on the histogram of degrees."""
    return _threshold(degree(graph.edges))


def _threshold(degrees: DataFrame) -> DataFrame:
    histogram = degrees.groupBy("degree").agg(F.count("*").alias("n"))
    upto = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.select("degree", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return ranked.where(F.col("upto") > F.floor(F.col("all") * 99 / 100)).agg(F.min("degree").alias("threshold"))


def flag_god_nodes(graph: Graph) -> DataFrame:
    """nodes with is_god_node: degree at or above the 99th percentile, and above 10. Degrees are counted once, into a table."""
    counted = table(degree(graph.edges))
    d = counted.crossJoin(F.broadcast(_threshold(counted)))  # the threshold is one row
    d = d.where((F.col("degree") >= F.col("threshold")) & (F.col("degree") > 10)).select("id", F.lit(True).alias("god"))
    return graph.nodes.join(d, "id", "left").withColumn("is_god_node", F.coalesce("god", F.lit(False))).select(graph.nodes.columns)


def node_metrics(graph: Graph) -> DataFrame:
    """Degrees of every node, its share of the greatest in- or out-degree, and whether it is a god node or a leaf."""
    d = degree_in_out(graph)
    most = d.agg(F.greatest(F.max("in_degree"), F.max("out_degree"), F.lit(1)).alias("most"))
    return d.crossJoin(F.broadcast(most)).select(
        "id", "in_degree", "out_degree", "total_degree", (F.col("total_degree") / F.col("most")).alias("pagerank"),
        (F.col("total_degree") > 50).alias("is_god_node"), (F.col("out_degree") == 0).alias("is_leaf"),
    )


def confidence_columns() -> list[Column]:
    return [F.coalesce(F.sum((F.col("confidence") == c).cast("bigint")), F.lit(0)).alias(c.lower()) for c in CONFIDENCE]


def confidence_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("confidence").agg(F.count("*").alias("n"))


def relation_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.coalesce(F.max(is_structural(F.col("relation"))), F.lit(False)).alias("structural"), F.coalesce(F.max(is_semantic(F.col("relation"))), F.lit(False)).alias("semantic"))


def graph_stats(graph: Graph) -> DataFrame:
    """One row: sizes, density, average degree and levels of confidence, over valid edges. Components are in community.py."""
    n = graph.nodes.agg(F.count("*").alias("node_count"))
    e = valid_edges(graph).agg(F.count("*").alias("edge_count"), *confidence_columns())
    nodes, edges = F.col("node_count"), F.col("edge_count")
    return n.crossJoin(e).select(
        nodes, edges, F.when(nodes > 0, 2.0 * edges / nodes).otherwise(0.0).alias("avg_degree"),
        F.when(nodes > 1, edges / (nodes * (nodes - 1.0))).otherwise(1.0).alias("density"), *(c.lower() for c in CONFIDENCE),
    )


def primary_language(nodes: DataFrame) -> DataFrame:
    """The commonest language of nodes; ties by name."""
    return nodes.where("language is not null").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(1)


def languages(nodes: DataFrame) -> DataFrame:
    return nodes.where("language is not null").agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


def architecture_style(edges: DataFrame) -> DataFrame:
    """One row: which style the kinds of edges suggest; null if none."""
    n = edges.agg(
        *(F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(name) for name, c in (
            ("contains", F.col("relation") == "contains"), ("imports", F.col("relation").isin("imports", "imports_from")), ("calls", F.col("relation") == "calls")))
    )
    c, i, k = F.col("contains"), F.col("imports"), F.col("calls")
    style = F.when((c > i) & (c > k), "Modular Hierarchical").when(i > k, "Package-Oriented").when(k > i, "Service-Oriented")
    return n.select("contains", "imports", "calls", style.alias("style"))

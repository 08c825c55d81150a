"""Quality checks, differences of graphs, and size figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph
from ..storage import spread, table
from .metrics import architecture_style, endpoints, god_nodes, touched

ISSUE = "type string, nodes string, severity double, description string, suggestion string"


def god_classes(graph: Graph, above: int = 50, counted: DataFrame | None = None) -> DataFrame:
    """(id, in_degree, severity) of classes that more than so many edges enter. counted: what touched() found."""
    if counted is None:
        counted = spread(graph.edges.select(F.col("target").alias("id")), "id", like=graph.edges).groupBy("id").agg(F.count("*").alias("in_degree"))
    entered = counted.select("id", "in_degree").where(F.col("in_degree") > above)
    severity = F.least(F.col("in_degree") / 100, F.lit(1.0))
    return graph.nodes.where("type = 'class'").select("id").join(entered, "id").select("id", "in_degree", severity.alias("severity"))


def circular(graph: Graph) -> DataFrame:
    """(a, b), a <= b, each pair of ids with edges both ways once; an edge from an id to itself is such a pair.

    Pairs meet by grouping, so edges are shuffled once and nothing is joined.
    """
    pairs = graph.edges.where("source is not null and target is not null").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") <= F.col("target")).alias("up"), (F.col("source") >= F.col("target")).alias("down"))
    both = spread(pairs, "a", "b", like=graph.edges).groupBy("a", "b").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    return both.where("up and down").select("a", "b", F.lit(0.6).alias("severity"))


def dead_code(graph: Graph, counted: DataFrame | None = None) -> DataFrame:
    """(id, severity) of functions that no edge touches. counted: what touched() found."""
    ends = spread(endpoints(graph.edges), "id", like=graph.edges).distinct() if counted is None else counted.select("id")
    return graph.nodes.where("type = 'function'").select("id").join(ends, "id", "left_anti").select("id", F.lit(0.3).alias("severity"))


def issues(graph: Graph, counted: DataFrame | None = None) -> DataFrame:
    """All findings: type, nodes (comma-separated), severity, description, suggestion. What edges touch is counted once, into a
    table, unless it is given."""
    counted = table(touched(graph.edges)) if counted is None else counted
    god = god_classes(graph, counted=counted).select(F.lit("god_class").alias("type"), F.col("id").alias("nodes"), "severity", F.format_string("%s is used %d times", "id", "in_degree").alias("description"), F.lit("Split it by responsibility").alias("suggestion"))
    loops = circular(graph).select(F.lit("circular_dependency").alias("type"), F.concat_ws(",", "a", "b").alias("nodes"), "severity", F.format_string("%s and %s depend on each other", "a", "b").alias("description"), F.lit("Move what they share to a third place").alias("suggestion"))
    dead = dead_code(graph, counted).select(F.lit("dead_code").alias("type"), F.col("id").alias("nodes"), "severity", F.format_string("Nothing uses %s", "id").alias("description"), F.lit("Remove it or say who needs it").alias("suggestion"))
    return god.unionByName(loops).unionByName(dead)


def health(graph: Graph) -> DataFrame:
    """One row: 1 without issues, otherwise 1 less half their average severity."""
    return _health(issues(graph))


def _health(issues_: DataFrame) -> DataFrame:
    found = issues_.agg(F.count("*").alias("n_issues"), F.avg("severity").alias("s"))
    return found.select("n_issues", F.round(F.coalesce(1 - 0.5 * F.col("s"), F.lit(1.0)), 6).alias("health"))


def issues_shown(found: DataFrame, each: int = 3) -> DataFrame:
    """The first so many issues of each type, by severity and nodes, with the number of all."""
    # The number of all is counted apart, so that of each type only the first rows meet in a task.
    found = table(found)
    of = found.groupBy(F.col("type").alias("t")).agg(F.count("*").alias("of"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("severity"), "nodes"))
    first = found.withColumn("rank", rank).where(F.col("rank") <= each)
    return first.join(F.broadcast(of), F.col("type").eqNullSafe(F.col("t"))).select(*found.columns, F.col("rank").cast("bigint").alias("rank"), "of")  # a row for each type


def analyze(graph: Graph, k: int = 10) -> dict[str, DataFrame]:
    """The architecture report: hubs, issues, health and style. Edges are computed once, into a table, and so are issues."""
    kept = Graph(graph.nodes, table(graph.edges.select("source", "target", "relation")), None, graph.project)
    counted = table(touched(kept.edges))
    found = table(issues(kept, counted))
    return {"god_nodes": god_nodes(kept, k, counted), "issues": found, "health": _health(found), "style": architecture_style(kept.edges)}


def analysis(graph: Graph, k: int = 10) -> DataFrame:
    """(section, name, value): the architecture report as rows: hubs with their degrees, issues by type, health and style."""
    a = analyze(graph, k)
    rows = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    style = a["style"].select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("contains", "imports", "calls"))), F.array("contains", "imports", "calls"))).alias("name", "n"))
    return (
        rows(a["god_nodes"], "god_nodes", F.col("id"), F.col("degree"))
        .unionByName(rows(a["issues"].groupBy("type").agg(F.count("*").alias("n")), "issues", F.col("type"), F.col("n")))
        .unionByName(rows(a["health"], "health", F.lit("score"), F.col("health")))
        .unionByName(rows(style, "style", F.col("name"), F.col("n")))
    )


def diff(base: Graph, new: Graph) -> DataFrame:
    """(id, change): nodes added, removed, or changed, that is of another label."""
    a = base.nodes.select("id", F.col("label").alias("was"), F.lit(True).alias("in_a"))
    b = new.nodes.select("id", F.col("label").alias("is"), F.lit(True).alias("in_b"))
    both = a.join(b, "id", "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.select("id", change.alias("change")).where("change is not null")


def diff_risk(base: Graph, new: Graph) -> DataFrame:
    """One row: how much changed, as a share of base's nodes, and how that is rated."""
    d = diff(base, new).agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")))
    n = base.nodes.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    risk = F.least(F.lit(1.0), (F.col("added") + F.col("removed") + F.col("changed")) / F.col("n"))
    level = F.when(risk > 0.2, "HIGH").when(risk > 0.1, "MEDIUM").otherwise("LOW")
    return d.crossJoin(n).select("added", "removed", "changed", F.round(risk, 6).alias("risk"), level.alias("level"))


def size_reduction(sources: DataFrame, graph_bytes: int) -> DataFrame:
    """One row for files(content): bytes, by how much a graph of graph_bytes is smaller, tokens saved, grade."""
    total = F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("bigint").alias("source_bytes")
    n, g = F.col("source_bytes"), F.lit(graph_bytes).cast("bigint")
    percent = F.when(n > 0, F.greatest(F.lit(0.0), (n - g) / n * 100)).otherwise(0.0)
    saved = F.greatest(F.lit(0), F.expr(f"(source_bytes - {int(graph_bytes)}) div 4"))
    grade = F.when(percent > 90, "excellent").when(percent > 80, "good").when(percent > 60, "fair").otherwise("poor")
    return sources.agg(total).select("source_bytes", g.alias("graph_bytes"), F.round(percent, 6).alias("reduction"), saved.cast("bigint").alias("tokens_saved"), grade.alias("grade"))

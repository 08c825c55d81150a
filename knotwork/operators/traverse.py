"""Bounded walks: reachability, shortest paths, all paths, impact.

A walk advances one level a round. Each level is a written table, so a lost executor costs one level and plans stay short;
a frontier whose counted size is small is broadcast, and then edges are not shuffled for it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import table
from .community import LOCAL_EDGES, in_one_task
from .metrics import valid_edges

#: Frontiers of at most so many rows are broadcast, after counting.
SMALL = 100_000
LINES_PER_NODE = 50


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _ids(graph: Graph) -> DataFrame:
    return graph.nodes.select("id").distinct()


def _steps(graph: Graph, reverse: bool = False) -> DataFrame:
    """(s, id): where an edge leads to from s, as a written table, so that no level computes the graph again."""
    source, target = ("target", "source") if reverse else ("source", "target")
    return table(graph.edges.select(F.col(source).alias("s"), F.col(target).alias("id")))


def bfs(graph: Graph, starts: list[str], max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(id, depth) of nodes within max_depth edges of a start, least depth; starts at 0, unknown ones nowhere. Without
    max_depth, of all that can be reached."""
    edges, nodes = _steps(graph, reverse), table(graph.nodes.select("id"))
    frontier = table(nodes.where(F.col("id").isin(*starts)).distinct().withColumn("depth", F.lit(0).cast("bigint")))
    seen, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and (n := frontier.count()):
        depth += 1
        step = edges.join(_small(frontier.select(F.col("id").alias("s")), n), "s").select("id").distinct()
        new = step.join(seen, "id", "left_anti").join(nodes, "id", "left_semi")
        frontier = table(new.withColumn("depth", F.lit(depth).cast("bigint")))
        seen = seen.unionByName(frontier)
        if depth % 20 == 0:
            seen = table(seen)
    return seen


def _path(source: np.ndarray, target: np.ndarray, _: np.ndarray, ids: list[str], start: str, end: str) -> tuple[list, list]:
    """shortest_path over arrays; places are in the order of ids."""
    at = {i: k for k, i in enumerate(ids)}
    if start not in at or end not in at:
        return [], []
    order = np.lexsort((target, source))
    to, first = target[order], np.searchsorted(source[order], np.arange(len(ids) + 1))
    come = np.full(len(ids), -1)
    come[at[start]] = at[start]
    front = np.array([at[start]])
    while len(front) and come[at[end]] < 0:
        n = first[front + 1] - first[front]
        by = np.repeat(front, n)
        reached = to[np.repeat(first[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        new = come[reached] < 0
        by, reached = by[new], reached[new]
        pick = np.lexsort((by, reached))
        front, k = np.unique(reached[pick], return_index=True)
        come[front] = by[pick][k]
    if come[at[end]] < 0:
        return [], []
    path = [at[end]]
    while path[-1] != at[start]:
        path.append(int(come[path[-1]]))
    return list(range(len(path))), [ids[k] for k in reversed(path)]


def shortest_path(graph: Graph, start: str, end: str, local: int = LOCAL_EDGES) -> DataFrame:
    """(step, id) of the shortest directed path; of equal ones, from the end back, each node comes from the least id that it
    can come from. No row if there is none.

    A level keeps for each new node the least one that leads to it, and the levels are read backwards at last. A graph of at
    most local edges is walked in one task, to the same end.
    """
    if start == end:
        return graph.nodes.where(F.col("id") == start).select("id").distinct().select(F.lit(0).cast("bigint").alias("step"), "id")
    # All edges as they are: where a level comes from is a node, and what it reaches is looked up among nodes.
    edges = _steps(graph)
    if edges.count() <= local:
        links = valid_edges(Graph(graph.nodes, edges.select(F.col("s").alias("source"), F.col("id").alias("target"))))
        return in_one_task(table(links.withColumn("w", F.lit(1.0))), partial(_path, start=start, end=end), "step bigint, id string")
    nodes = table(graph.nodes.select("id"))
    frontier = table(nodes.where(F.col("id") == start).distinct().withColumn("come", F.lit(None).cast("string")))
    seen, levels = frontier.select("id"), [frontier]
    while (n := frontier.count()) and frontier.where(F.col("id") == end).isEmpty():
        step = edges.join(_small(frontier.select(F.col("id").alias("s")), n), "s").groupBy("id").agg(F.min("s").alias("come"))
        frontier = table(step.join(seen, "id", "left_anti").join(nodes, "id", "left_semi"))
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("id"))
        if len(levels) % 20 == 0:
            seen = table(seen)
    path, at = [], end if n else None
    for level in reversed(levels):
        if at is None:
            break
        path.append(at)
        at = level.where(F.col("id") == at).first().come
    return graph.spark.createDataFrame(list(enumerate(reversed(path))), "step bigint, id string")


def all_paths(graph: Graph, start: str, end: str, max_nodes: int) -> DataFrame:
    """(path, n_nodes) of every simple directed path of at most max_nodes nodes; one for each choice of parallel edges.

    Only nodes from which the end can still be reached are entered: a walk back from the end tells how far it is.
    """
    left = bfs(graph, [end], max(max_nodes - 1, 0), reverse=True).select("id", F.col("depth").alias("left"))
    left = table(left)
    nodes = _ids(graph)
    live = table(nodes.where(F.col("id") == start).join(left, "id").where(F.col("left") < max_nodes).select("id", F.array("id").alias("path")))
    done = live.where(F.col("id") == end)
    # Edges towards the end, with the distance that remains; the others never matter.
    near = table(_steps(graph).join(left, "id"))
    for length in range(2, max_nodes + 1):
        live = live.where(F.col("id") != end)
        n = live.count()
        if not n:
            break
        step = near.where(F.col("left") <= max_nodes - length).join(_small(live.withColumnRenamed("id", "s"), n), "s")
        step = step.where(~F.array_contains("path", F.col("id")))
        live = table(step.select("id", F.array_append("path", F.col("id")).alias("path")))
        done = done.unionByName(live.where(F.col("id") == end))
    return done.select(F.array_join("path", ">").alias("path"), F.size("path").cast("bigint").alias("n_nodes"))


def impact_nodes(graph: Graph, ids: list[str], max_depth: int = 3) -> DataFrame:
    """(id, distance, impact, probability) of the nodes that edges from ids lead to, ids themselves left out."""
    d = bfs(graph, ids, max_depth).where("depth > 0").select("id", F.col("depth").alias("distance"))
    kind = F.when(F.col("distance") == 1, "must_change").when(F.col("distance") == 2, "likely_affected").otherwise("should_review")
    p = F.when(F.col("distance") == 1, 1.0).otherwise(F.lit(0.7) / F.col("distance"))
    return d.select("id", "distance", kind.alias("impact"), p.alias("probability"))


def impact_summary(graph: Graph, ids: list[str], max_depth: int = 3) -> DataFrame:
    """One row: how many nodes are hit directly and indirectly, the share of all nodes as risk, and lines by rule of thumb."""
    hit = impact_nodes(graph, ids, max_depth).agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("indirect"))
    all_ = _ids(graph).agg(F.count("*").alias("nodes"))
    blast = F.col("direct") + F.col("indirect")
    risk = F.when(F.col("nodes") > 0, F.least(F.lit(1.0), blast / F.col("nodes"))).otherwise(0.0)
    return hit.crossJoin(all_).select("direct", "indirect", blast.alias("blast_radius"), risk.alias("risk"), (blast * LINES_PER_NODE).alias("estimated_lines"))

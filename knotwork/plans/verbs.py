"""The questions one asks a graph: find, query, path, explain, impact."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph, score
from ..operators import traverse

SHOWN_MATCHES = 20
SHOWN_EDGES = 10
SHOWN_NODES = 50


def find_nodes(graph: Graph, text: str) -> DataFrame:
    """Nodes whose label has text in it, whatever its case; % and _ are themselves."""
    return graph.nodes.where(F.contains(F.lower("label"), F.lit(text.lower())))


def keyword_search(graph: Graph, question: str, most: int = SHOWN_MATCHES) -> DataFrame:
    """(ord, id, label): the first matches of the question's words, word by word; a node that several match comes again."""
    words = question.split()
    if not words:
        return graph.nodes.select("ord", "id", "label").limit(0)
    at = F.array(*(F.when(F.contains(F.lower("label"), F.lit(w.lower())), F.lit(k)) for k, w in enumerate(words)))
    hits = graph.nodes.select("ord", "id", "label", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("word"))
    return hits.orderBy("word", "ord", "id").limit(most).select("word", "id", "label")


def first_match(graph: Graph, text: str) -> str | None:
    row = find_nodes(graph, text).orderBy("ord", "id").select("id").first()
    return row.id if row else None


def query(graph: Graph, question: str, depth: int = 2) -> DataFrame:
    """(id, depth, label) around the first node that the question, or else a word of it, names."""
    start = first_match(graph, question)
    if start is None:
        row = keyword_search(graph, question, 1).first()
        start = row.id if row else None
    found = traverse.bfs(graph, [] if start is None else [start], depth)
    return found.join(graph.nodes.select("id", "label"), "id")


def path(graph: Graph, a: str, b: str) -> DataFrame:
    """(step, id) of the shortest path between the first matches of two patterns."""
    x, y = first_match(graph, a), first_match(graph, b)
    return traverse.shortest_path(graph, x or "", y or "") if x and y else graph.nodes.limit(0).select(F.lit(0).cast("bigint").alias("step"), "id")


def explain(graph: Graph, id_: str, most: int = SHOWN_EDGES) -> DataFrame:
    """(direction, rank, other, label, relation, of): the first edges out of and into a node; of counts all, dangling ones
    included."""
    e = graph.edges.where((F.col("source") == id_) | (F.col("target") == id_))
    both = e.select(F.explode(F.filter(F.array(
        F.when(F.col("source") == id_, F.struct(F.lit("out").alias("direction"), F.col("target").alias("other"))), F.when(F.col("target") == id_, F.struct(F.lit("in").alias("direction"), F.col("source").alias("other")))
    ), lambda x: x.isNotNull())).alias("x"), "relation", "ord").select("x.*", "relation", "ord")
    w = Window.partitionBy("direction")
    ranked = both.withColumns({"rank": F.row_number().over(w.orderBy("ord", "other", "relation")).cast("bigint"), "of": F.count("*").over(w)}).where(F.col("rank") <= most)
    return ranked.join(graph.nodes.select(F.col("id").alias("other"), "label"), "other", "left").select("direction", "rank", "other", F.coalesce("label", "other").alias("label"), "relation", "of")


def impact(graph: Graph, patterns: Sequence[str], depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Summary and nodes of what the first matches of the patterns lead to."""
    ids = [i for p in patterns if (i := first_match(graph, p))]
    return traverse.impact_summary(graph, ids, depth), traverse.impact_nodes(graph, ids, depth)


@dataclass(frozen=True)
class Question:
    """A composed query: where to begin, which edges and nodes count, and how many characters of labels may come."""

    text: str
    strategy: str = "breadth_first"
    budget: int = 2000
    max_depth: int = 3
    relations: Sequence[str] = field(default_factory=tuple)
    types: Sequence[str] = field(default_factory=tuple)
    exclude_types: Sequence[str] = field(default_factory=tuple)
    min_confidence: float = 0.0


def ask(graph: Graph, q: Question) -> DataFrame:
    """(rank, id, label, type, depth): breadth-first answers are ordered by depth, others by label; the budget is spent in
    that order, four characters a token."""
    edges, nodes = graph.edges, graph.nodes
    if q.relations:
        edges = edges.where(F.col("relation").isin(*q.relations))
    if q.min_confidence > 0:
        edges = edges.where(score(F.col("confidence")) >= q.min_confidence)
    if q.types:
        nodes = nodes.where(F.col("type").isin(*q.types))
    if q.exclude_types:
        nodes = nodes.where(~F.col("type").isin(*q.exclude_types))
    g = Graph(nodes, edges, None, graph.project)
    start = first_match(g, q.text)
    found = traverse.bfs(g, [] if start is None else [start], q.max_depth).join(nodes.select("id", "label", "type"), "id")
    order = ["depth", "label", "id"] if q.strategy == "breadth_first" else ["label", "depth", "id"]
    # Every row takes at least a token, so no more rows than the budget can be in the answer.
    near = found.orderBy(*order).limit(q.budget)
    tokens = F.greatest(F.lit(1), F.ceil(F.length("label") / 4))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumns({"spent": F.sum(tokens).over(w), "rank": F.row_number().over(Window.orderBy(*order))}).where(F.col("spent") <= q.budget).select("rank", "id", "label", "type", "depth")


def node_search(graph: Graph, text: str, most: int = SHOWN_NODES) -> DataFrame:
    return find_nodes(graph, text).orderBy("ord", "id").limit(most).select("id", "label", "type")


def node_detail(graph: Graph, id_: str) -> DataFrame:
    """One row, if there is such a node: what is known of it, and how many edges enter and leave it, dangling ones included."""
    e = graph.edges.where((F.col("source") == id_) | (F.col("target") == id_))
    ends = e.agg(F.count_if(F.col("target") == id_).alias("in_degree"), F.count_if(F.col("source") == id_).alias("out_degree"))
    return graph.node(id_).select("id", "label", "type", "source_file", "source_location", "confidence", "language", "is_god_node").crossJoin(ends)


def label_communities(communities: DataFrame, namer) -> DataFrame:
    """communities(community_id, label, ...) with labels by namer, a function from a pandas series of labels to another.

    The hook for names from elsewhere; nothing is called by default.
    """
    named = F.pandas_udf(namer, "string")
    return communities.withColumn("label", F.coalesce(named("label"), F.col("label")))

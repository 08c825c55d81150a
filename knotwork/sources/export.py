"""Exports of graphs: CSV for graph databases, diagrams, pages and reports.

What can be large is written by Spark. Diagrams are for people, so they take a bounded number of nodes; the bound is theirs
and is a parameter.
"""

from __future__ import annotations

import html
import json
import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph
from ..operators import community, metrics, quality
from ..storage import table
from . import graph_json

MERMAID_EDGES = 100
MERMAID_COMMUNITIES = 8
DRAWN_NODES = 5_000
#: Bytes of a page's name; file systems allow 255 with its ending.
NAME_BYTES = 200
#: A document is a row of a table, which can't be larger than memory.
ONE_ROW = 2_000_000
VAULT_PAGES = ("GOD_NODES", "COMMUNITIES", "INDEX")
SHOWN_RELATIONS = {"calls": "calls", "contains": "contains", "imports": "imports", "inherits": "extends", "implements": "implements"}
SHAPES = {"class": ("([", "])"), "interface": ("{{", "}}"), "enum": ("((", "))"), "file": ("[/", "/]")}


def neo4j_nodes(graph: Graph) -> DataFrame:
    return graph.nodes.select(
        F.col("id").alias("nodeId:ID"), "label", "type", F.coalesce("language", F.lit("")).alias("language"), F.col("is_god_node").cast("string").alias("isGodNode:boolean"), F.coalesce("source_file", F.lit("")).alias("sourceFile")
    )


def neo4j_relationships(graph: Graph) -> DataFrame:
    return graph.edges.select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.col("relation").alias(":TYPE"), F.initcap(F.lower("confidence")).alias("confidence"), F.col("weight").alias("weight:float"))


def write_neo4j(graph: Graph, path: str) -> None:
    """CSV folders neo4j_nodes and neo4j_relationships, each with headers."""
    for name, df in (("neo4j_nodes", neo4j_nodes(graph)), ("neo4j_relationships", neo4j_relationships(graph))):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def _safe(c: Column) -> Column:
    return F.translate(c, ".-:", "___")


def mermaid_nodes(graph: Graph) -> DataFrame:
    """(ord, id, text): a line for each node."""
    left, right = (F.coalesce(*(F.when(F.col("type") == t, F.lit(s[k])) for t, s in SHAPES.items()), F.lit("[]"[k])) for k in (0, 1))
    style = F.when(F.col("is_god_node"), " fill:#f96").otherwise("")
    return graph.nodes.select("ord", "id", F.concat(F.lit("    "), _safe(F.col("id")), left, F.lit('"'), F.translate("label", '"', "'"), F.lit('"'), right, style).alias("text"))


def mermaid_edges(graph: Graph, most: int = MERMAID_EDGES) -> DataFrame:
    """(place, text): a line for each of the first edges whose relation is drawn, by their place among those."""
    order = ["ord", "source", "target", "relation"]
    first = graph.edges.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # few rows
    label = F.coalesce(*(F.when(F.col("relation") == r, F.lit(t)) for r, t in SHOWN_RELATIONS.items()))
    arrow = F.when(F.col("confidence") == "EXTRACTED", " -->").otherwise(" -.- ")
    return first.where(label.isNotNull()).select("place", F.concat(F.lit("    "), _safe(F.col("source")), arrow, F.lit("|"), label, F.lit("| "), _safe(F.col("target"))).alias("text"))


def mermaid(graph: Graph, members: DataFrame | None = None, most_nodes: int = DRAWN_NODES) -> str:
    rows = mermaid_nodes(graph).orderBy("ord", "id").limit(most_nodes).collect()
    out = ["# Architecture Call-Flow Diagram", "", "```mermaid", "graph TD", *(r.text for r in rows), *(r.text for r in mermaid_edges(graph).orderBy("place").collect())]
    if members is not None:
        labels = community.community_labels(graph, members).orderBy(F.desc("size"), "community_id").limit(MERMAID_COMMUNITIES)
        inside = members.join(F.broadcast(labels), "community_id").join(graph.nodes.select(F.col("id").alias("node_id")).limit(most_nodes), "node_id", "left_semi")  # eight labels
        by: dict[int, list] = {}
        for r in inside.orderBy("community_id", "node_id").limit(most_nodes).collect():
            by.setdefault(r.community_id, [r.label, r.size]).append(r.node_id)
        for c, (label, size, *ids) in sorted(by.items()):
            out += [f'    subgraph {c}["{label} ({size})"]', *(f"        {i}" for i in ids), "    end"]
    return "\n".join([*out, "```", ""])


def svg_layout(graph: Graph, most: int = DRAWN_NODES) -> DataFrame:
    """(id, label, is_god_node, x, y): the first nodes on a circle of radius 280 around (500, 350), in input order."""
    first = graph.nodes.orderBy("ord", "id").limit(most)
    place = first.withColumns({"i": F.row_number().over(Window.orderBy("ord", "id")) - 1, "n": F.count("*").over(Window.partitionBy())})
    angle = 2 * F.pi() * F.col("i") / F.col("n")
    return place.select("id", "label", "is_god_node", F.round(500 + 280 * F.cos(angle), 6).alias("x"), F.round(350 + 280 * F.sin(angle), 6).alias("y"))


def svg(graph: Graph, most: int = DRAWN_NODES) -> str:
    at = svg_layout(graph, most)
    a, b = (at.select(F.col("id").alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, end in ((1, "source"), (2, "target")))
    lines = graph.edges.join(F.broadcast(a), "source").join(F.broadcast(b), "target").orderBy("ord", "source", "target").limit(4 * most)  # at most DRAWN_NODES rows each
    out = [
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 700">',
        "<style>.node{fill:#58a6ff}.god{fill:#f78166}.edge{stroke:#30363d;stroke-width:0.3}.label{font:5px monospace;fill:#8b949e}</style>",
    ]
    out += [f"<line x1='{r.x1}' y1='{r.y1}' x2='{r.x2}' y2='{r.y2}' class='edge' opacity='{0.3 if r.confidence == 'INFERRED' else 0.5}'/>" for r in lines.collect()]
    for r in at.collect():
        kind, size = ("god", 5.0) if r.is_god_node else ("node", 2.5)
        out.append(f"<circle cx='{r.x}' cy='{r.y}' r='{size}' class='{kind}'/><text x='{r.x + 6}' y='{r.y + 1.5}' class='label'>{html.escape((r.label or '')[:15])}</text>")
    return "\n".join([*out, "</svg>", ""])


def page(graph: Graph, most: int = DRAWN_NODES) -> str:
    """A page that shows the first nodes and the edges between them, without anything from elsewhere."""
    nodes = graph.nodes.orderBy("ord", "id").limit(most)
    ids = nodes.select("id")
    edges = graph.edges.join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi").limit(4 * most)
    data = {"nodes": [r.asDict() for r in nodes.select("id", "label", "type", "is_god_node").collect()], "edges": [r.asDict() for r in edges.select("source", "target", "relation").collect()]}
    body = json.dumps(data).replace("<", "\\u003c")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(graph.project)}</title></head><body><input id='q' placeholder='label'><ul id='found'></ul>{svg(graph, most)}<script>const g={body};const q=document.getElementById('q'),f=document.getElementById('found');q.oninput=()=>{{f.replaceChildren(...g.nodes.filter(n=>n.label&&n.label.toLowerCase().includes(q.value.toLowerCase())).slice(0,50).map(n=>{{const l=document.createElement('li');l.textContent=n.label+' ('+n.type+')';return l}}))}}</script></body></html>"


def report(graph: Graph, members: DataFrame | None = None, now: datetime | None = None) -> str:
    """A Markdown report: sizes, hubs, communities (the 15 largest), issues (three of each type)."""
    # Edges are computed once, and what they touch is counted once, into tables.
    graph = Graph(graph.nodes, table(graph.edges.select("source", "target", "confidence", "weight")), graph.communities, graph.project)
    counted = table(metrics.touched(graph.edges))
    s = metrics.graph_stats(graph).first()
    out = [f"# Graph report: {graph.project}", "", f"Generated {(now or datetime.now(timezone.utc)).strftime('%Y-%m-%d %H:%M')}", "", "## Size", "", f"- Nodes: {s.node_count}", f"- Edges: {s.edge_count}", f"- Average degree: {s.avg_degree:.2f}", f"- Density: {s.density:.4f}", f"- Confidence: {s.extracted} extracted, {s.inferred} inferred, {s.ambiguous} ambiguous", "", "## God nodes", ""]
    out += [f"- {r.label}: {r.degree} edges" for r in metrics.god_nodes(graph, 10, counted).collect()]
    if members is not None:
        q = community.modularity(graph, members)
        best = community.community_labels(graph, members).join(q, "community_id").orderBy(F.desc("size"), "community_id").limit(15)
        out += ["", "## Communities", "", *(f"- {r.community_id}: {r.label}, modularity {r.modularity:.3f}" for r in best.collect())]
    shown = quality.issues_shown(quality.issues(graph, counted)).orderBy("type", "rank").collect()
    out += ["", "## Issues", "", *(f"- {r.type} ({r.rank} of {r.of}): {r.description}. {r.suggestion}." for r in shown)]
    return "\n".join([*out, ""])


def page_names(nodes: DataFrame, by_node: bool = False) -> DataFrame:
    """(id, name, type, source_file): the page of each node, named by its label.

    Characters that file names can't have become _. A name that this makes equal to another label's, that is one of the vault's own
    pages or is longer than a file name may be ends in a hash of the label, so that no two labels share a page. With by_node, so does
    the name of a label that several nodes have.
    """
    label = F.coalesce("label", F.col("id"))
    plain = F.regexp_replace(F.regexp_replace(label, r'[/\\:*?"<>|\x00-\x1f]', "_"), r"^\.", "_")
    labels = nodes.groupBy(label.alias("full"), plain.alias("plain")).agg(F.count("*").alias("n"))
    shared = labels.groupBy(F.lower("plain").alias("low")).agg((F.sum("n") if by_node else F.count("*")).alias("m"))
    odd = (F.col("m") > 1) | F.col("plain").isin(*VAULT_PAGES) | (F.octet_length("plain") > NAME_BYTES) | (F.col("plain") == "")
    short = F.substring("plain", 1, NAME_BYTES // 8)  # at most four bytes a character
    named = labels.join(shared, F.lower("plain") == F.col("low")).select("full", F.when(odd, F.concat(short, F.lit("-"), F.substring(F.sha2("full", 256), 1, 16))).otherwise(F.col("plain")).alias("name"))
    return nodes.select("id", label.alias("full"), "type", "source_file").join(named, "full").select("id", "full", "name", "type", "source_file")


def vault_pages(graph: Graph, by_node: bool = False) -> DataFrame:
    """(name, text): a page for each label with its kinds and links; nodes of equal label share one. by_node is that of page_names."""
    nodes = page_names(graph.nodes, by_node)
    target = nodes.select(F.col("id").alias("target"), F.col("name").alias("to"))
    links = graph.edges.select("source", "target", "relation").join(target, "target", "left")
    lines = links.select(F.col("source").alias("id"), F.concat(F.lit("- "), "relation", F.lit(" [["), F.coalesce("to", "target"), F.lit("]]")).alias("line")).distinct()
    about = F.concat(F.lit("Type: "), F.coalesce("type", F.lit("unknown")), F.coalesce(F.concat(F.lit("; file: "), F.col("source_file")), F.lit("")))
    parts = nodes.select("name", "full", F.lit(0).alias("kind"), about.alias("line")).unionByName(nodes.join(lines, "id").select("name", "full", F.lit(1).alias("kind"), "line"))
    pages = parts.groupBy("name").agg(F.min("full").alias("full"), F.array_sort(F.collect_set(F.struct("kind", "line"))).alias("x"))
    text = lambda k: F.array_join(F.transform(F.filter("x", lambda r: r["kind"] == k), lambda r: r["line"]), "\n")
    return pages.select("name", F.concat(F.lit("# "), "full", F.lit("\n\n"), text(0), F.lit("\n\n"), text(1), F.lit("\n")).alias("text"))


def write_vault(graph: Graph, path: str, members: DataFrame | None = None) -> None:
    """A folder of Markdown pages on the driver's machine: one for each label, the 20 god nodes, the communities, and an index
    of all. Pages come to the driver a partition at a time; write_vault_table keeps a vault of any size as a table."""
    os.makedirs(path, exist_ok=True)

    def put(name: str, text: str) -> None:
        with open(os.path.join(path, f"{name}.md"), "w", encoding="utf-8") as f:
            f.write(text)

    names = []
    for r in vault_pages(graph).toLocalIterator():
        put(r.name, r.text)
        names.append(r.name)
    gods = metrics.god_nodes(graph, 20).join(page_names(graph.nodes).select("id", "name"), "id", "left").orderBy(F.desc("degree"), "label", "id").collect()
    put("GOD_NODES", "# God nodes\n\n" + "".join(f"- [[{r.name or r.id}]]: {r.degree}\n" for r in gods))
    extra = ["GOD_NODES"]
    if members is not None:
        rows = community.community_labels(graph, members).orderBy(F.desc("size"), "community_id").toLocalIterator()
        put("COMMUNITIES", "# Communities\n\n" + "".join(f"- {r.community_id}: {r.label}\n" for r in rows))
        extra.append("COMMUNITIES")
    put("INDEX", "# Index\n\n" + "".join(f"- [[{k}]]\n" for k in extra + sorted(names)))


def write_vault_table(graph: Graph, path: str) -> None:
    """The pages (name, text) as a table, written by all machines."""
    vault_pages(graph).write.mode("overwrite").parquet(path)


def write_all(graph: Graph, path: str, members: DataFrame | None = None, now: datetime | None = None) -> None:
    """Every export below path, on a file system that driver and executors share. The graph is in one document up to ONE_ROW
    nodes and edges, in lines beyond."""
    os.makedirs(path, exist_ok=True)
    if graph.nodes.count() + graph.edges.count() <= ONE_ROW:
        graph_json.document(graph).coalesce(1).write.mode("overwrite").text(f"{path}/graph.json")
    else:
        graph_json.json_lines(graph).write.mode("overwrite").text(f"{path}/graph.jsonl")
    write_neo4j(graph, path)
    for name, text in (("graph.html", page(graph)), ("GRAPH_REPORT.md", report(graph, members, now)), ("callflow.md", mermaid(graph, members)), ("graph.svg", svg(graph))):
        with open(os.path.join(path, name), "w", encoding="utf-8") as f:
            f.write(text)
    write_vault(graph, os.path.join(path, "vault"), members)

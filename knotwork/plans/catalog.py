"""Named queries over the tables of a folder, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graphs
from ..functions.text import sanitize_id
from ..model import Graph, as_edges, as_nodes, empty_graph, is_code, is_rationale
from ..operators import build, community, incremental, metrics, quality, resolve, traverse
from ..sources import export, graph_json
from ..storage import new_path
from ..streaming import changes
from . import snippets, verbs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STAR = """
nodes AS (
  SELECT 'r_' || r_regionkey AS id, r_name AS label, 'module' AS type, 'region.tbl' AS source_file, 'Rust' AS language, 0 + r_regionkey AS ord FROM region
  UNION ALL SELECT 'n_' || n_nationkey, n_name, 'module', 'nation.tbl', 'Rust', 1000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 's_' || s_suppkey, s_name, 'class', 'supplier.tbl', 'Python', 2000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'c_' || c_custkey, c_name, 'class', 'customer.tbl', 'Python', 3000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'p_' || p_partkey, p_name, 'interface', 'part.tbl', 'Go', 4000000000000 + p_partkey FROM part
  UNION ALL SELECT 'o_' || o_orderkey, 'Order#' || o_orderkey, 'function', 'orders.tbl', 'Python', 5000000000000 + o_orderkey FROM orders),
edges AS (
  SELECT 'r_' || n_regionkey AS source, 'n_' || n_nationkey AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS weight, [0, n_regionkey, n_nationkey]::BIGINT[] AS ord FROM nation
  UNION ALL SELECT 'n_' || s_nationkey, 's_' || s_suppkey, 'contains', 'EXTRACTED', 1.0, [1, s_nationkey, s_suppkey]::BIGINT[] FROM supplier
  UNION ALL SELECT 'n_' || c_nationkey, 'c_' || c_custkey, 'contains', 'EXTRACTED', 1.0, [2, c_nationkey, c_custkey]::BIGINT[] FROM customer
  UNION ALL SELECT 'c_' || o_custkey, 'o_' || o_orderkey, 'calls', 'EXTRACTED', 1.0, [3, o_custkey, o_orderkey]::BIGINT[] FROM orders
  UNION ALL SELECT 'o_' || l_orderkey, 'p_' || l_partkey, 'depends_on', CASE min(l_returnflag) WHEN 'N' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, 1.0,
      [4, l_orderkey, l_partkey]::BIGINT[] FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'p_' || l_partkey, 's_' || l_suppkey, 'references', 'INFERRED', 1.0, [5, l_partkey, l_suppkey]::BIGINT[] FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))
"""
EVENT = """
nodes AS (SELECT DISTINCT event_type AS id, event_type AS label, 'function' AS type FROM events),
edges AS (SELECT source, target, count(*)::DOUBLE AS weight, 'calls' AS relation FROM (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL GROUP BY ALL)
"""
WEB = r"""
nodes AS (SELECT 'page_' || page_id AS id, url AS label, 'document' AS type, url AS source_file, page_id AS ord FROM pages),
edges AS (SELECT 'page_' || page_id AS source, href AS target, 'references' AS relation, CAST(page_id AS VARCHAR) AS source_file FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages))
"""
#: A graph with imports: parts import suppliers, suppliers nations, nations regions, which are no nodes here.
IMPORTS = """
nodes AS (SELECT 'p_' || p_partkey AS id, p_name AS label FROM part UNION ALL SELECT 's_' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'n_' || n_nationkey, n_name FROM nation),
edges AS (SELECT DISTINCT 'p_' || l_partkey AS source, 's_' || l_suppkey AS target FROM lineitem UNION ALL SELECT 's_' || s_suppkey, 'n_' || s_nationkey FROM supplier UNION ALL SELECT 'n_' || n_nationkey, 'r_' || n_regionkey FROM nation)
"""
DEGREE = "d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def on_star(name: str, sql: str | None = None, *parts: str) -> Callable:
    def add(f: Callable[[Graph], DataFrame]) -> Callable:
        register(name, _with(STAR, *parts) + sql if sql else None)(lambda spark, d: f(graphs.star(spark, d)))
        return f

    return add


def on_event(name: str, sql: str | None = None, *parts: str) -> Callable:
    def add(f: Callable[[Graph], DataFrame]) -> Callable:
        register(name, _with(EVENT, *parts) + sql if sql else None)(lambda spark, d: f(graphs.event(spark, d)))
        return f

    return add


def on_web(name: str, sql: str | None = None, *parts: str) -> Callable:
    def add(f: Callable[[Graph], DataFrame]) -> Callable:
        register(name, _with(WEB, *parts) + sql if sql else None)(lambda spark, d: f(graphs.web(spark, d)))
        return f

    return add


# Degrees, hubs and statistics.
on_star("degree_total", "SELECT id, degree FROM d", DEGREE)(lambda g: metrics.degree(g.edges))
IN_OUT = "io AS (SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) + coalesce(o.c, 0) AS total_degree FROM nodes n LEFT JOIN (SELECT target AS id, count(*) AS c FROM edges GROUP BY 1) i USING (id) LEFT JOIN (SELECT source AS id, count(*) AS c FROM edges GROUP BY 1) o USING (id))"
on_star("degree_in_out", "SELECT id, in_degree, out_degree, total_degree FROM io", IN_OUT)(metrics.degree_in_out)
on_star("god_nodes_top", "SELECT id, coalesce(label, 'unknown') AS label, degree FROM d LEFT JOIN nodes USING (id) ORDER BY degree DESC, label, id LIMIT 10", DEGREE)(metrics.god_nodes)
on_star("god_nodes_core", "SELECT id, label, degree FROM d JOIN nodes USING (id) ORDER BY degree DESC, ord LIMIT 10", DEGREE)(metrics.god_nodes_core)
P99 = "t AS (SELECT degree AS threshold FROM (SELECT degree, row_number() OVER (ORDER BY degree) AS rn, count(*) OVER () AS n FROM d) WHERE rn = CAST(floor(n * 99 / 100) AS BIGINT) + 1)"
on_star("god_flag_p99", "SELECT n.id, coalesce(degree >= (SELECT threshold FROM t) AND degree > 10, false) AS is_god_node FROM nodes n LEFT JOIN d USING (id)", DEGREE, P99)(lambda g: metrics.flag_god_nodes(g).select("id", "is_god_node"))
on_star("node_metrics", "SELECT id, in_degree, out_degree, total_degree, round(total_degree / (SELECT greatest(max(in_degree), max(out_degree), 1) FROM io), 6) AS pagerank, total_degree > 50 AS is_god_node, out_degree = 0 AS is_leaf FROM io", IN_OUT)(
    lambda g: metrics.node_metrics(g).withColumn("pagerank", F.round("pagerank", 6))
)
VALID = "v AS (SELECT * FROM edges SEMI JOIN (SELECT id AS source FROM nodes) USING (source) SEMI JOIN (SELECT id AS target FROM nodes) USING (target))"
_STATS = "SELECT n AS node_count, e AS edge_count, round(2.0 * e / n, 6) AS avg_degree, round(e / (n * (n - 1.0)), 9) AS density, extracted, inferred, ambiguous FROM (SELECT (SELECT count(*) FROM nodes) AS n, count(*) AS e, count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous FROM v)"
on_star("graph_stats", _STATS, VALID)(lambda g: metrics.graph_stats(g).withColumns({"avg_degree": F.round("avg_degree", 6), "density": F.round("density", 9)}))
on_star("build_stats", "SELECT n AS node_count, e AS edge_count, f AS files, 10 * n AS total_lines, round(2.0 * e / n, 6) AS avg_degree FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(DISTINCT source_file) FROM nodes) AS f, count(*) AS e FROM edges)")(
    lambda g: build.build_stats(g).select("node_count", "edge_count", "files", "total_lines", F.round("avg_degree", 6).alias("avg_degree"))
)
on_star("confidence_hist", "SELECT confidence, count(*) AS n FROM edges GROUP BY confidence")(lambda g: metrics.confidence_histogram(g.edges))
on_star("relation_hist", "SELECT relation, count(*) AS n, relation IN ('calls', 'contains', 'depends_on') AS structural, relation = 'references' AS semantic FROM edges GROUP BY relation")(lambda g: metrics.relation_histogram(g.edges))
on_star("primary_language", "SELECT language, count(*) AS n FROM nodes GROUP BY language ORDER BY n DESC, language LIMIT 1")(lambda g: metrics.primary_language(g.nodes))
on_star("languages", "SELECT string_agg(language, ',' ORDER BY language) AS languages FROM (SELECT DISTINCT language FROM nodes)")(lambda g: metrics.languages(g.nodes))
on_star(
    "architecture_style",
    "SELECT c AS contains, i AS imports, k AS calls, CASE WHEN c > i AND c > k THEN 'Modular Hierarchical' WHEN i > k THEN 'Package-Oriented' WHEN k > i THEN 'Service-Oriented' END AS style FROM (SELECT count(*) FILTER (relation = 'contains') AS c, count(*) FILTER (relation LIKE 'imports%') AS i, count(*) FILTER (relation = 'calls') AS k FROM edges)",
)(lambda g: metrics.architecture_style(g.edges))
on_star("confidence_scores", "SELECT confidence, CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS score, confidence <> 'AMBIGUOUS' AS reliable, count(*) AS n FROM edges GROUP BY confidence")(
    lambda g: g.edges.groupBy("confidence").agg(F.count("*").alias("n")).select("confidence", verbs.score(F.col("confidence")).alias("score"), (F.col("confidence") != "AMBIGUOUS").alias("reliable"), "n")
)

# Building.
DOCS = "docs AS (SELECT doc_id, 'file_' || md5(coalesce(text, '')) AS id, source, lang FROM documents)"


def _doc_nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.concat(F.lit("file_"), F.md5(F.coalesce("text", F.lit("")))).alias("id"), F.col("doc_id").cast("string").alias("label"), F.when(F.col("lang") == "en", F.col("source")).alias("source_file"), F.col("doc_id").alias("ord"))


register("node_dedupe_first", _with(DOCS) + "SELECT id, CAST(min(doc_id) AS VARCHAR) AS label FROM docs GROUP BY id")(lambda s, d: build.dedupe_nodes(_doc_nodes(s, d)).select("id", "label"))
register("node_dedupe_richest", _with(DOCS) + "SELECT id, CAST(doc_id AS VARCHAR) AS label FROM docs QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN lang = 'en' AND source IS NOT NULL THEN 0 ELSE 1 END, doc_id) = 1")(
    lambda s, d: build.dedupe_nodes_richest(_doc_nodes(s, d).withColumn("metadata", F.lit(None).cast("string"))).select("id", "label")
)
on_web("edge_dedupe_per_source", "SELECT DISTINCT source_file, source, target, relation FROM edges")(lambda g: build.dedupe_edges(g.edges).select("source_file", "source", "target", "relation"))
on_star("prune_dangling", "SELECT source, target, relation FROM edges e SEMI JOIN (SELECT id AS source FROM kept) USING (source) SEMI JOIN (SELECT id AS target FROM kept) USING (target)", "kept AS (SELECT id FROM nodes WHERE type <> 'interface')")(
    lambda g: build.prune_dangling(Graph(g.nodes.where("type <> 'interface'"), g.edges)).edges.select("source", "target", "relation")
)


def _imports(spark: SparkSession, d: str) -> Graph:
    g = graphs.star(spark, d)
    kinds = g.nodes.where("id like 'p%' or id like 's%' or id like 'n%'")
    down = g.edges.where("relation = 'references'").select("source", "target")
    up = g.edges.where("relation = 'contains' and target not like 'c%'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return Graph(kinds, as_edges(down.unionByName(up).withColumn("relation", F.lit("imports"))))


register("infer_two_hop", _with(IMPORTS) + "SELECT a.source, b.target, 0.3::DOUBLE AS weight FROM edges a JOIN (SELECT DISTINCT source, target FROM edges) b ON a.target = b.source WHERE b.target <> a.source AND b.target IN (SELECT id FROM nodes)")(
    lambda s, d: build.infer_edges(_imports(s, d)).select("source", "target", "weight")
)
on_star("merge_prefixed", "SELECT id FROM (SELECT id FROM nodes UNION ALL SELECT 'other::' || id FROM nodes WHERE type = 'class')")(
    lambda g: build.merge(g, Graph(g.nodes.where("type = 'class'"), g.edges), "other").nodes.select("id")
)
on_star(
    "merge_prefixed_edges",
    "SELECT source, target FROM edges UNION ALL SELECT 'other::' || source, 'other::' || target FROM edges SEMI JOIN (SELECT id AS source FROM kept) USING (source) SEMI JOIN (SELECT id AS target FROM kept) USING (target)",
    "kept AS (SELECT id FROM nodes WHERE type IN ('class', 'function'))",
)(lambda g: build.merge(g, Graph(g.nodes.where("type in ('class', 'function')"), g.edges), "other").edges.select("source", "target"))
register("accumulate_idempotent", _with(STAR) + "SELECT 'all::' || id AS id FROM nodes")(
    lambda s, d: (lambda g: build.accumulate(build.accumulate(empty_graph(s), g, "all"), g, "all").nodes.select("id"))(graphs.star(s, d))
)
register("dependency_nodes", "SELECT 'dep_' || replace(replace(p_brand, '-', '_'), '.', '_') AS id, p_brand AS label, 'dependency' AS type FROM (SELECT DISTINCT p_brand FROM part)")(
    lambda s, d: build.dependency_nodes(s.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("name")).distinct().withColumns({"version": F.lit(None).cast("string"), "manifest": F.lit("part")})).select("id", "label", "type")
)


def _hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """A manifest from before French documents came, when English ones ended otherwise and src0 had no results; German ones
    are gone now."""
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("path", F.col("doc_id").cast("string"))
    before = F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("lang <> 'fr'").select("path", F.sha2(before, 256).alias("hash"), F.col("lang").alias("language"), F.when(F.col("source") != "src0", "x").alias("cached_result"))
    return incremental.status(docs.where("lang <> 'de'").select("path", F.col("text").alias("content")), old).select("path", "status")


register(
    "content_hash_diff",
    """WITH now AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h FROM documents WHERE lang <> 'de'),
old AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN lang = 'en' THEN text || '!' ELSE text END) AS o, source <> 'src0' AS cached FROM documents WHERE lang <> 'fr')
SELECT path, CASE WHEN now.h IS NULL THEN 'deleted' WHEN old.o IS NULL THEN 'new' WHEN h = o AND cached THEN 'unchanged' ELSE 'changed' END AS status FROM now FULL JOIN old USING (path)""",
)(_hash_diff)


# Resolution of imports: parts import suppliers by label, in quotes; orders import files by path.
RESOLVE = """
nodes AS (SELECT 's_' || s_suppkey AS id, 'db.' || s_name AS label, 'supplier_' || (s_suppkey % 50) || '.py' AS source_file, s_suppkey AS ord FROM supplier UNION ALL SELECT 'p_' || p_partkey, p_name, 'part_' || (p_partkey % 50) || '.py', p_partkey FROM part),
edges AS (SELECT DISTINCT 'p_' || l_partkey AS source, '"' || s_name || '"' AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT 's_' || s_suppkey, 'part_' || (s_suppkey % 60) || '.py' FROM supplier),
symbols AS (SELECT DISTINCT s, id FROM (SELECT unnest([label, regexp_extract(label, '([^.]*)$', 1), lower(label), lower(regexp_extract(label, '([^.]*)$', 1))]) AS s, id FROM nodes)),
own AS (SELECT id AS source, source_file AS own_file FROM nodes),
named AS (SELECT source, lower(trim(trim(trim(target), '"'';,'))) AS name FROM edges),
by_symbol AS (SELECT n.source, s.id AS target, 0.6::DOUBLE AS weight FROM named n JOIN symbols s ON n.name = s.s JOIN own USING (source) JOIN nodes t ON t.id = s.id WHERE t.source_file <> own_file AND t.id <> n.source),
by_file AS (SELECT n.source, f.id AS target, 0.5::DOUBLE AS weight FROM named n JOIN (SELECT source_file, id FROM nodes QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY ord, id) = 1) f ON n.name = f.source_file WHERE f.id <> n.source)
"""


def _resolving(spark: SparkSession, d: str) -> Graph:
    supplier, part, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "part", "lineitem"))
    s = supplier.select(F.expr("'s_' || s_suppkey").alias("id"), F.expr("'db.' || s_name").alias("label"), F.expr("'supplier_' || (s_suppkey % 50) || '.py'").alias("source_file"), F.col("s_suppkey").alias("ord"))
    p = part.select(F.expr("'p_' || p_partkey").alias("id"), F.col("p_name").alias("label"), F.expr("'part_' || (p_partkey % 50) || '.py'").alias("source_file"), F.col("p_partkey").alias("ord"))
    a = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.expr("'p_' || l_partkey").alias("source"), F.expr("'\"' || s_name || '\"'").alias("target")).distinct()
    b = supplier.select(F.expr("'s_' || s_suppkey").alias("source"), F.expr("'part_' || (s_suppkey % 60) || '.py'").alias("target"))
    return Graph(as_nodes(s.unionByName(p).withColumn("type", F.lit("class"))), as_edges(a.unionByName(b).withColumn("relation", F.lit("imports"))))


register("resolve_symbols", _with(RESOLVE) + "SELECT source, target, weight FROM by_symbol")(lambda s, d: resolve.candidates(_resolving(s, d)).where("context = 'cross_file_resolved'").select("source", "target", "weight"))
register("resolve_files", _with(RESOLVE) + "SELECT source, target, weight FROM by_file")(lambda s, d: resolve.candidates(_resolving(s, d)).where("context = 'cross_file_file'").select("source", "target", "weight"))


def _resolve_again(spark: SparkSession, d: str) -> DataFrame:
    g = _resolving(spark, d)
    known = resolve.candidates(g).where("source like '%1'").select("source", "target", F.lit("calls").alias("relation"))
    return resolve.resolve(g.with_edges(known)).select("source", "target", "weight")


register("resolve_dedup", _with(RESOLVE) + "SELECT source, target, weight FROM (FROM by_symbol UNION ALL FROM by_file) WHERE source NOT LIKE '%1'")(_resolve_again)

# Extraction, on snippets.
for _name, (_spark, _sql) in snippets.QUERIES.items():
    register(_name, _sql)(_spark)
register("sanitize_id", r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g') AS id FROM documents")(lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", sanitize_id(F.col("text")).alias("id")))


# Walks.
def _walk(source: str, target: str, starts: str, depth: int) -> list[str]:
    parts = [f"b0 AS (SELECT id, 0 AS depth FROM nodes WHERE id IN ({starts}))"]
    for k in range(1, depth + 1):
        parts.append(f"b{k} AS (FROM b{k - 1} UNION ALL SELECT DISTINCT e.{target} AS id, {k} AS depth FROM edges e JOIN b{k - 1} ON e.{source} = b{k - 1}.id AND b{k - 1}.depth = {k - 1} WHERE e.{target} IN (SELECT id FROM nodes) AND e.{target} NOT IN (SELECT id FROM b{k - 1}))")
    return parts


on_star("bfs_depth", "SELECT id, CAST(depth AS BIGINT) AS depth FROM b3", *_walk("source", "target", "'c_1'", 3))(lambda g: traverse.bfs(g, ["c_1"], 3))
on_star("shortest_path", "SELECT CAST(k - 1 AS BIGINT) AS step, p[k] AS id FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM best)",
    "walks AS (SELECT ['n_0'] AS p, 'n_0' AS id UNION ALL SELECT list_append(p, e.target), e.target FROM walks JOIN edges e ON e.source = walks.id WHERE len(p) < 5 AND walks.id <> 's_1' AND NOT list_contains(p, e.target))",
    "best AS (SELECT p FROM walks WHERE id = 's_1' ORDER BY len(p), list_reverse(p) LIMIT 1)",
)(lambda g: traverse.shortest_path(g, "n_0", "s_1"))
on_star("all_paths_bounded", "SELECT array_to_string(p, '>') AS path, CAST(len(p) AS BIGINT) AS n_nodes FROM walks WHERE id = 's_1'",
    "walks AS (SELECT ['n_0'] AS p, 'n_0' AS id UNION ALL SELECT list_append(p, e.target), e.target FROM walks JOIN edges e ON e.source = walks.id WHERE len(p) < 5 AND walks.id <> 's_1' AND NOT list_contains(p, e.target))",
)(lambda g: traverse.all_paths(g, "n_0", "s_1", 5))
_IMPACT = _walk("source", "target", "'n_0', 'c_1'", 3)
on_star("impact_nodes", "SELECT id, CAST(depth AS BIGINT) AS distance, CASE depth WHEN 1 THEN 'must_change' WHEN 2 THEN 'likely_affected' ELSE 'should_review' END AS impact, round(CASE depth WHEN 1 THEN 1.0 ELSE 0.7 / depth END, 6)::DOUBLE AS probability FROM b3 WHERE depth > 0", *_IMPACT)(
    lambda g: traverse.impact_nodes(g, ["n_0", "c_1"]).withColumn("probability", F.round("probability", 6))
)
on_star("impact_summary", "SELECT d AS direct, i AS indirect, d + i AS blast_radius, round(least(1.0, (d + i) / (SELECT count(*) FROM nodes)), 6)::DOUBLE AS risk, 50 * (d + i) AS estimated_lines FROM (SELECT count(*) FILTER (depth = 1) AS d, count(*) FILTER (depth > 1) AS i FROM b3)", *_IMPACT)(
    lambda g: traverse.impact_summary(g, ["n_0", "c_1"]).withColumn("risk", F.round("risk", 6))
)
on_star("find_nodes", "SELECT id, label FROM nodes WHERE contains(lower(label), 'r#1')")(lambda g: verbs.find_nodes(g, "R#1").select("id", "label"))
on_star("keyword_search", "SELECT word, id, label FROM (SELECT w.word, n.id, n.label, n.ord FROM nodes n JOIN (VALUES (0, 'order#12'), (1, 'asia')) w(word, t) ON contains(lower(label), t)) ORDER BY word, ord, id LIMIT 20")(lambda g: verbs.keyword_search(g, "order#12 ASIA"))
on_star("query_verb", "SELECT id, CAST(depth AS BIGINT) AS depth, label FROM b2 JOIN nodes USING (id)", "s AS (SELECT id FROM nodes WHERE contains(lower(label), 'asia') ORDER BY ord, id LIMIT 1)", *_walk("source", "target", "SELECT id FROM s", 2))(lambda g: verbs.query(g, "asia"))
on_star(
    "explain_node",
    "SELECT direction, rank, other, coalesce(label, other) AS label, relation, n AS of FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY e.ord, other, relation) AS rank, count(*) OVER (PARTITION BY direction) AS n FROM (SELECT 'out' AS direction, target AS other, relation, ord FROM edges WHERE source = 'c_1' UNION ALL SELECT 'in', source, relation, ord FROM edges WHERE target = 'c_1') e) x LEFT JOIN (SELECT id AS other, label FROM nodes) USING (other) WHERE rank <= 10",
)(lambda g: verbs.explain(g, "c_1"))
on_star("ask_filtered", "SELECT row_number() OVER (ORDER BY depth, label, id) AS rank, id, label, type, CAST(depth AS BIGINT) AS depth FROM b2 JOIN nodes USING (id)", "s AS (SELECT id FROM nodes WHERE contains(lower(label), 'asia') ORDER BY ord, id LIMIT 1)",
    *(p.replace("FROM edges e", "FROM (SELECT * FROM edges WHERE relation = 'contains') e").replace("FROM nodes)", "FROM nodes WHERE type <> 'class')") for p in _walk("source", "target", "SELECT id FROM s", 2)),
)(lambda g: verbs.ask(g, verbs.Question("asia", max_depth=2, relations=["contains"], exclude_types=["class"], min_confidence=0.5)).withColumn("rank", F.col("rank").cast("bigint")))

MATCH = "(SELECT id FROM nodes WHERE contains(lower(label), '{}') ORDER BY ord, id LIMIT 1)"
_A, _B = MATCH.format("asia"), MATCH.format("supplier#000000004")
on_star("path_verb", "SELECT CAST(k - 1 AS BIGINT) AS step, p[k] AS id FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM best)", f"ends AS MATERIALIZED (SELECT {_A} AS a, {_B} AS b)",
    "walks AS (SELECT [a] AS p, a AS id, b FROM ends UNION ALL SELECT list_append(p, e.target), e.target, b FROM walks JOIN edges e ON e.source = walks.id WHERE len(p) < 6 AND walks.id <> b AND NOT list_contains(p, e.target))",
    "best AS (SELECT p FROM walks WHERE id = b ORDER BY len(p), list_reverse(p) LIMIT 1)",
)(lambda g: verbs.path(g, "asia", "supplier#000000004"))
_IMPACT_VERB = _walk("source", "target", f"{_A}, {MATCH.format('customer#000000001')}", 3)
on_star("impact_verb", "SELECT d AS direct, i AS indirect, d + i AS blast_radius, round(least(1.0, (d + i) / (SELECT count(*) FROM nodes)), 6)::DOUBLE AS risk, 50 * (d + i) AS estimated_lines FROM (SELECT count(*) FILTER (depth = 1) AS d, count(*) FILTER (depth > 1) AS i FROM b3)", *_IMPACT_VERB)(
    lambda g: verbs.impact(g, ["asia", "customer#000000001"])[0].withColumn("risk", F.round("risk", 6))
)
on_star("node_search", "SELECT id, label, type FROM (SELECT * FROM nodes WHERE contains(lower(label), '#00000000') ORDER BY ord, id LIMIT 50)")(lambda g: verbs.node_search(g, "#00000000"))
on_star("node_detail", "SELECT id, label, type, source_file, NULL::VARCHAR AS source_location, 'EXTRACTED' AS confidence, language, false AS is_god_node, (SELECT count(*) FROM edges WHERE target = 's_1') AS in_degree, (SELECT count(*) FROM edges WHERE source = 's_1') AS out_degree FROM nodes WHERE id = 's_1'")(lambda g: verbs.node_detail(g, "s_1"))
on_star("node_kinds", "SELECT type, type IN ('module', 'class', 'interface', 'function') AS code, false AS rationale, count(*) AS n FROM nodes GROUP BY type")(lambda g: g.nodes.groupBy("type").agg(F.count("*").alias("n")).select("type", is_code(F.col("type")).alias("code"), is_rationale(F.col("type")).alias("rationale"), "n"))

# Whole builds, caches and documents.
on_star("build_graph", "SELECT n.id, n.label, coalesce(degree >= (SELECT threshold FROM t) AND degree > 10, false) AS is_god_node FROM nodes n LEFT JOIN d USING (id)", DEGREE, P99)(
    lambda g: build.build_graph(g.nodes.unionByName(g.nodes.withColumns({"label": F.lit("late"), "ord": F.col("ord") + 10**13})), g.edges.unionByName(g.edges)).nodes.select("id", "label", "is_god_node")
)
on_star("merge_verb", "SELECT id FROM (SELECT id FROM nodes UNION ALL SELECT 'shared::' || id FROM nodes WHERE type = 'module' UNION ALL SELECT 'shared2::' || id FROM nodes WHERE type = 'class')")(
    lambda g: build.merge_all([("a/first", g), ("b/shared", Graph(g.nodes.where("type = 'module'"), g.edges)), ("c/shared/", Graph(g.nodes.where("type = 'class'"), g.edges))]).nodes.select("id")
)
on_star("accumulate_changed", "SELECT 'p::' || id AS id, label || '!' AS label FROM nodes WHERE type <> 'class'")(
    lambda g: build.accumulate(build.accumulate(empty_graph(g.spark), g, "p"), Graph(g.nodes.where("type <> 'class'").withColumn("label", F.concat("label", F.lit("!"))), g.edges), "p").nodes.select("id", "label")
)


def _manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = new_path(spark, "manifest-")
    incremental.save(docs.select(F.col("doc_id").cast("string").alias("path"), incremental.content_hash(F.coalesce("text", F.lit(""))).alias("hash"), F.col("lang").alias("language"), F.lit("x").alias("cached_result")), path)
    return incremental.load(spark, path)


register("manifest_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS hash, lang AS language, 'x' AS cached_result FROM documents")(_manifest_round_trip)


def _document_round_trip(g: Graph) -> DataFrame:
    path = new_path(g.spark, "document-")
    graph_json.document(g).coalesce(1).write.text(path)
    again = graph_json.read(g.spark, path)
    return again.edges.select("source", "target", "relation", "weight").unionByName(again.nodes.select(F.col("id").alias("source"), F.col("label").alias("target"), F.col("type").alias("relation"), F.lit(0.0).alias("weight")))


def _tables_round_trip(g: Graph) -> DataFrame:
    path = new_path(g.spark, "tables-")
    graph_json.write_tables(g, path)
    return metrics.valid_edges(graph_json.read_tables(g.spark, path)).select("source", "target", "relation", "confidence", "weight")


on_event("document_round_trip", "SELECT source, target, relation, weight FROM edges UNION ALL SELECT id, label, type, 0.0 FROM nodes")(_document_round_trip)
on_star("tables_round_trip", "SELECT source, target, relation, confidence, weight FROM v", VALID)(_tables_round_trip)


def _report(g: Graph) -> DataFrame:
    """The report's lines of sizes and hubs."""
    lines = export.report(g).split("\n")
    kept = [x for x in lines if x.startswith(("- Nodes", "- Edges")) or x.endswith(" edges")]
    return g.spark.createDataFrame(list(enumerate(kept, 1)), "line bigint, text string")


on_star("report", "SELECT line, text FROM (SELECT 1 AS line, '- Nodes: ' || (SELECT count(*) FROM nodes) AS text UNION ALL SELECT 2, '- Edges: ' || (SELECT count(*) FROM v) UNION ALL SELECT 2 + row_number() OVER (ORDER BY degree DESC, label, id), '- ' || label || ': ' || degree || ' edges' FROM (SELECT id, coalesce(label, 'unknown') AS label, degree FROM d LEFT JOIN nodes USING (id) ORDER BY degree DESC, label, id LIMIT 10))", VALID, DEGREE)(_report)

# Quality and differences.
on_star("god_class", "SELECT id, in_degree, least(in_degree / 100, 1.0)::DOUBLE AS severity FROM (SELECT target AS id, count(*) AS in_degree FROM edges GROUP BY 1) JOIN nodes USING (id) WHERE type = 'class' AND in_degree > 50")(quality.god_classes)
on_event("circular_deps", "SELECT DISTINCT least(a.source, a.target) AS a, greatest(a.source, a.target) AS b, 0.6::DOUBLE AS severity FROM edges a JOIN edges b ON a.source = b.target AND a.target = b.source")(quality.circular)
on_star("dead_code", "SELECT id, 0.3::DOUBLE AS severity FROM nodes WHERE type = 'function' AND id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges)")(quality.dead_code)
on_star("dead_code_within", "SELECT id, 0.3::DOUBLE AS severity FROM nodes WHERE type = 'function' AND id NOT IN (SELECT source FROM e) AND id NOT IN (SELECT target FROM e)", "e AS (SELECT * FROM edges WHERE confidence = 'AMBIGUOUS')")(lambda g: quality.dead_code(Graph(g.nodes, g.edges.where("confidence = 'AMBIGUOUS'"))))
GOD = "god AS (SELECT id, c, least(c / 100, 1.0)::DOUBLE AS severity FROM (SELECT target AS id, count(*) AS c FROM edges GROUP BY 1) JOIN nodes USING (id) WHERE type = 'class' AND c > 50)"
on_star("issues_shown", "SELECT 'god_class' AS type, id AS nodes, severity, row_number() OVER (ORDER BY severity DESC, id) AS rank, count(*) OVER () AS of FROM god QUALIFY rank <= 3", GOD)(lambda g: quality.issues_shown(quality.issues(g)).select("type", "nodes", "severity", "rank", "of"))
on_star(
    "analysis",
    "(SELECT 'god_nodes' AS section, id AS name, degree::DOUBLE AS value FROM (SELECT id, coalesce(label, 'unknown') AS label, degree FROM d LEFT JOIN nodes USING (id) ORDER BY degree DESC, label, id LIMIT 10)) UNION ALL SELECT 'issues', 'god_class', count(*)::DOUBLE FROM god HAVING count(*) > 0 "
    "UNION ALL SELECT 'health', 'score', round(coalesce(1 - 0.5 * avg(severity), 1.0), 6) FROM god UNION ALL SELECT 'style', name, n::DOUBLE FROM (SELECT unnest(['contains', 'imports', 'calls']) AS name, unnest([count(*) FILTER (relation = 'contains'), count(*) FILTER (relation LIKE 'imports%'), count(*) FILTER (relation = 'calls')]) AS n FROM edges)",
    DEGREE, GOD,
)(quality.analysis)
on_star("health_score", "SELECT count(*) AS n_issues, round(coalesce(1 - 0.5 * avg(s), 1.0), 6) AS health FROM (SELECT least(c / 100, 1.0) AS s FROM (SELECT target AS id, count(*) AS c FROM edges GROUP BY 1) JOIN nodes USING (id) WHERE type = 'class' AND c > 50)")(quality.health)


def _versions(g: Graph) -> tuple[Graph, Graph]:
    """The graph without its suppliers, and the graph without its parts and with other labels for nations."""
    new = g.nodes.where("id not like 'p%'").withColumn("label", F.when(F.col("id").startswith("n_"), F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    return Graph(g.nodes.where("id not like 's%'"), g.edges), Graph(new, g.edges)


_VERSIONS = ("x AS (SELECT id, CASE id[1] WHEN 's' THEN 'added' WHEN 'p' THEN 'removed' WHEN 'n' THEN 'changed' END AS change FROM nodes)",)
on_star("graph_diff", "SELECT id, change FROM x WHERE change IS NOT NULL", *_VERSIONS)(lambda g: quality.diff(*_versions(g)))
on_star("diff_risk", "SELECT a AS added, r AS removed, c AS changed, round(least(1.0, (a + r + c) / n), 6) AS risk, CASE WHEN (a + r + c) / n > 0.2 THEN 'HIGH' WHEN (a + r + c) / n > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'removed') AS r, count(*) FILTER (change = 'changed') AS c, count(*) FILTER (id NOT LIKE 's%') AS n FROM x)", *_VERSIONS)(lambda g: quality.diff_risk(*_versions(g)))
register("size_reduction", "SELECT b AS source_bytes, 100000 AS graph_bytes, round(greatest(0, (b - 100000) / b * 100), 6) AS reduction, greatest(0, (b - 100000) // 4) AS tokens_saved, CASE WHEN r > 90 THEN 'excellent' WHEN r > 80 THEN 'good' WHEN r > 60 THEN 'fair' ELSE 'poor' END AS grade FROM (SELECT b, (b - 100000) / b * 100 AS r FROM (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS b FROM documents))")(
    lambda s, d: quality.size_reduction(s.read.parquet(f"{d}/documents.parquet").select(F.col("text").alias("content")), 100_000)
)

# Communities and centrality. Membership by nation for the checks of what is computed from a membership.
NEAR = "near AS (SELECT id, other, sum(weight) AS w FROM (SELECT source AS id, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges) GROUP BY id, other)"


def _moves(rounds: int) -> list[str]:
    out = [
        "strength AS MATERIALIZED (SELECT n.id, coalesce(sum(w), 0) AS k FROM nodes n LEFT JOIN near USING (id) GROUP BY n.id)", "whole AS MATERIALIZED (SELECT sum(k) AS m FROM strength)", "l0 AS (SELECT id, id AS label FROM nodes)",
    ]
    for i in range(1, rounds + 1):
        out += [
            f"t{i} AS MATERIALIZED (SELECT label, sum(k) AS total FROM l{i - 1} JOIN strength USING (id) GROUP BY label)",
            f"m{i} AS MATERIALIZED (SELECT id, label AS own, k, total AS own_total FROM l{i - 1} JOIN strength USING (id) JOIN t{i} USING (label) WHERE (CAST('0x' || substring(md5(id || ':{(i + 1) // 2}'), 1, 1) AS INT) < 8) = {bool(i % 2)})",
            f"o{i} AS MATERIALIZED (SELECT id, label, own, k, own_total, w * (SELECT m FROM whole) - k * (total - CASE WHEN label = own THEN k ELSE 0 END) AS gain FROM (SELECT n.id, l.label, sum(n.w) AS w FROM near n JOIN l{i - 1} l ON n.other = l.id WHERE n.id <> n.other GROUP BY n.id, l.label) JOIN m{i} USING (id) JOIN t{i} USING (label))",
            f"g{i} AS (SELECT id, new FROM (SELECT id, label AS new, gain, k, own_total, row_number() OVER (PARTITION BY id ORDER BY gain DESC, label) AS rn FROM o{i} WHERE label <> own) LEFT JOIN (SELECT id, gain AS stay FROM o{i} WHERE label = own) USING (id) WHERE rn = 1 AND gain > coalesce(stay, -k * (own_total - k)))",
            f"l{i} AS MATERIALIZED (SELECT l.id, coalesce(g.new, l.label) AS label FROM l{i - 1} l LEFT JOIN g{i} g USING (id))",
        ]
    return out


on_star("community_moves", "SELECT id, label FROM l4", NEAR, *_moves(4))(lambda g: community.local_moves(g, 4))
MEMBERS = "members AS (SELECT id AS node_id, CAST(ascii(substring(id, 1, 1)) AS BIGINT) AS community_id FROM nodes)"


def _members(g: Graph) -> DataFrame:
    return g.nodes.select(F.col("id").alias("node_id"), F.ascii(F.substring("id", 1, 1)).cast("bigint").alias("community_id"))


on_star(
    "community_modularity",
    "SELECT community_id, round(coalesce(i, 0) / (2 * m) - pow(coalesce(w, 0) / (2 * m), 2), 6) AS modularity FROM (SELECT DISTINCT community_id FROM members) LEFT JOIN (SELECT c AS community_id, sum(w) AS w, sum(i) AS i FROM (SELECT sc AS c, w, CASE WHEN sc = tc THEN w ELSE 0 END AS i FROM b UNION ALL SELECT tc, w, CASE WHEN sc = tc THEN w ELSE 0 END FROM b) GROUP BY 1) USING (community_id), (SELECT sum(weight) AS m FROM edges)",
    MEMBERS, "b AS (SELECT weight AS w, x.community_id AS sc, y.community_id AS tc FROM edges JOIN members x ON source = x.node_id JOIN members y ON target = y.node_id)",
)(lambda g: community.modularity(g, _members(g)))
on_star("community_hubs", "SELECT community_id, rank, node_id, degree FROM (SELECT community_id, node_id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(degree, 0) DESC, node_id) AS rank FROM members LEFT JOIN d ON node_id = id) WHERE rank <= 3", MEMBERS, DEGREE)(lambda g: community.community_hubs(g, _members(g)))
on_star("community_label", "SELECT community_id, size, type || ' (' || size || ' elements)' AS label FROM (SELECT community_id, type, CAST(sum(count(*)) OVER (PARTITION BY community_id) AS BIGINT) AS size, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, type) AS rn FROM members JOIN nodes ON node_id = id GROUP BY community_id, type) WHERE rn = 1", MEMBERS)(lambda g: community.community_labels(g, _members(g)))
on_star("surprising_edges", "SELECT source, target, relation, confidence, 'Community ' || x.community_id || ' ↔ Community ' || y.community_id AS reason FROM edges JOIN members x ON source = x.node_id JOIN members y ON target = y.node_id WHERE confidence <> 'EXTRACTED' AND x.community_id <> y.community_id", MEMBERS)(lambda g: community.surprising(g, _members(g)))
on_star("communities")(community.communities)


def _least(rounds: int) -> str:
    """(k, id, label): in each round every node takes the least label of its neighbours."""
    return f"r AS (SELECT 0 AS k, id, id AS label FROM nodes UNION ALL SELECT r.k + 1, r.id, least(r.label, coalesce(f.label, r.label)) FROM r LEFT JOIN (SELECT c.b AS id, min(r.label) AS label FROM c JOIN r ON c.a = r.id GROUP BY 1) f USING (id) WHERE r.k < {rounds})"


on_star("weak_components", "SELECT id, label AS component FROM r WHERE k = 14", "c AS MATERIALIZED (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges)", _least(14))(community.weak_components)
register("weak_components_chains", "SELECT id, min(id) OVER (PARTITION BY conv_id) AS component FROM (SELECT DISTINCT conv_id, 't_' || conv_id || '_' || turn AS id FROM conversations)")(lambda s, d: community.weak_components(graphs.conversation(s, d)))
on_event("scc_small", "SELECT n.id, least(n.id, coalesce(min(f.b), n.id)) AS component FROM nodes n LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) f ON f.a = n.id GROUP BY n.id", "reach AS (SELECT source AS a, target AS b FROM edges UNION SELECT reach.a, e.target FROM reach JOIN edges e ON e.source = reach.b)")(community.strong_components)
on_star("scc_star", "SELECT id, id AS component FROM nodes")(community.strong_components)


RANKS = [
    "deg AS MATERIALIZED (SELECT source, count(*) AS d FROM edges GROUP BY 1)", "links AS MATERIALIZED (SELECT target, source, 1.0::DOUBLE / d AS share FROM edges JOIN deg USING (source))",
    "marked AS MATERIALIZED (SELECT id, id NOT IN (SELECT source FROM deg) AS ends, (SELECT count(*) FROM nodes) AS n FROM nodes)",
    "ranks AS (SELECT 0 AS k, id, 1.0::DOUBLE / n AS rank FROM marked UNION ALL SELECT m.k + 1, m.id, (0.15 + 0.85 * m.lost) / m.n + 0.85 * coalesce(f.flow, 0) "
    "FROM (SELECT k, id, n, sum(CASE WHEN ends THEN rank ELSE 0 END) OVER () AS lost FROM ranks JOIN marked USING (id)) m LEFT JOIN (SELECT l.target AS id, sum(r.rank * l.share) AS flow FROM links l JOIN ranks r ON l.source = r.id GROUP BY 1) f USING (id) WHERE m.k < 100)",
]
on_event("pagerank_small", "SELECT id, round(rank, 6) AS rank FROM ranks WHERE k = 100", *RANKS)(lambda g: community.pagerank(g).withColumn("rank", F.round("rank", 6)))
on_star("pagerank_star", "SELECT id, round(rank, 9) AS rank FROM ranks WHERE k = 100", *RANKS)(lambda g: community.pagerank(g).withColumn("rank", F.round("rank", 9)))

_SCC = "reach AS (SELECT source AS a, target AS b FROM edges UNION SELECT reach.a, e.target FROM reach JOIN edges e ON e.source = reach.b)", "scc AS (SELECT n.id, least(n.id, coalesce(min(f.b), n.id)) AS component FROM nodes n LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) f ON f.a = n.id GROUP BY n.id)"
on_event("graph_summary", "SELECT n AS node_count, e AS edge_count, c AS components, c <= 1 AS is_connected FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e, count(DISTINCT component) AS c FROM scc)", *_SCC)(lambda g: community.summary(g).select("node_count", "edge_count", "components", "is_connected"))
on_event("ranked_metrics", "SELECT id, in_degree, out_degree, total_degree, round(rank, 6) AS pagerank, total_degree > 50 AS is_god_node, out_degree = 0 AS is_leaf FROM io JOIN (SELECT id, rank FROM ranks WHERE k = 100) USING (id)", IN_OUT, *RANKS)(lambda g: community.ranked_metrics(g).withColumn("pagerank", F.round("pagerank", 6)))

# Exports.
on_star("neo4j_nodes", """SELECT id AS "nodeId:ID", label, type, language, 'false' AS "isGodNode:boolean", source_file AS "sourceFile" FROM nodes""")(export.neo4j_nodes)
on_star("neo4j_relationships", """SELECT source AS ":START_ID", target AS ":END_ID", relation AS ":TYPE", upper(confidence[1]) || lower(confidence[2:]) AS confidence, weight AS "weight:float" FROM edges""")(export.neo4j_relationships)
on_web("svg_layout", "SELECT id, label, false AS is_god_node, round(500 + 280 * cos(2 * pi() * i / n), 6) AS x, round(350 + 280 * sin(2 * pi() * i / n), 6) AS y FROM (SELECT *, row_number() OVER (ORDER BY ord, id) - 1 AS i, count(*) OVER () AS n FROM (SELECT * FROM nodes ORDER BY ord, id LIMIT 5000))")(export.svg_layout)
on_star("mermaid_edges", "SELECT place, '    ' || source || CASE confidence WHEN 'EXTRACTED' THEN ' -->' ELSE ' -.- ' END || '|' || CASE relation WHEN 'inherits' THEN 'extends' ELSE relation END || '| ' || target AS text FROM (SELECT *, row_number() OVER (ORDER BY ord) AS place FROM edges ORDER BY ord LIMIT 100) WHERE relation IN ('calls', 'contains', 'imports', 'inherits', 'implements')")(export.mermaid_edges)
on_web(
    "vault_pages",
    "SELECT name, '# ' || min(label) || chr(10) || chr(10) || string_agg(DISTINCT about, chr(10) ORDER BY about) || chr(10) || chr(10) || coalesce(string_agg(DISTINCT line, chr(10) ORDER BY line), '') || chr(10) AS text FROM (SELECT id, p.name, p.label, 'Type: ' || type || '; file: ' || source_file AS about, '- ' || relation || ' [[' || coalesce(t.name, target) || ']]' AS line FROM pages_ p LEFT JOIN (SELECT source, target, relation FROM edges) e ON e.source = p.id LEFT JOIN (SELECT id AS target, name FROM pages_) t USING (target)) GROUP BY name",
    r"plain AS (SELECT *, regexp_replace(regexp_replace(label, '[/\\:*?\"<>|]', '_', 'g'), '^\.', '_') AS plain FROM nodes)",
    "pages_ AS MATERIALIZED (SELECT id, label, type, source_file, CASE WHEN count(*) OVER (PARTITION BY lower(plain)) > 1 OR octet_length(encode(plain)) > 200 THEN substring(plain, 1, 25) || '-' || substring(sha256(label), 1, 16) ELSE plain END AS name FROM plain)",
)(lambda g: export.vault_pages(g, by_node=True))


# Streams.
def _two_batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents arrive as Markdown files in two batches, the second replacing some and deleting others."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"), "lang")
    when = F.lit("2024-01-01 00:00:00").cast("timestamp")
    first = docs.select("path", "content", F.lit(False).alias("deleted"), when.alias("ts"))
    second = docs.where("lang in ('en', 'fr')").select("path", F.concat(F.lit("# Changed\n"), "content").alias("content"), (F.col("lang") == "fr").alias("deleted"), (when + F.expr("interval 1 hour")).alias("ts"))
    return first, second


def _upserted(graph: Graph) -> DataFrame:
    return graph.nodes.select("id", "label", "type", F.col("source_file").alias("path"))


def _batch_upsert(spark: SparkSession, d: str) -> DataFrame:
    store = changes.Store(spark, new_path(spark, "store-"))
    for k, batch in enumerate(_two_batches(spark, d)):
        store.apply(batch, k)
    return _upserted(store.graph())


def _stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The same through a stream of JSON files: each batch arrives, and a query runs over what is there."""
    inbox, store, checkpoint = new_path(spark, "inbox-"), changes.Store(spark, new_path(spark, "store-")), new_path(spark, "check-")
    for batch in _two_batches(spark, d):
        batch.write.mode("append").json(inbox)
        changes.keep_up(changes.read(spark, inbox), store, checkpoint, None).awaitTermination()
    return _upserted(store.graph())


UPSERTED = r"""
WITH f AS (SELECT source || '/d' || doc_id || '.md' AS path, 'd' || doc_id AS stem, regexp_replace(source || '_d' || doc_id, '[^\p{L}\p{N}_-]', '_', 'g') AS file_id,
    CASE WHEN lang = 'en' THEN '# Changed' || chr(10) ELSE '' END || '# ' || source || chr(10) || coalesce(text, '') AS content FROM documents WHERE source IS NOT NULL AND coalesce(lang, '') <> 'fr'),
lines AS (SELECT path, stem, n, rtrim(parts[n], chr(13)) AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT *, string_split(content, chr(10)) AS parts FROM f))),
heads AS (SELECT path, stem, n, regexp_extract(line, '^(#{1,6})\s+(.+)', 1) AS h, trim(regexp_extract(line, '^(#{1,6})\s+(.+)', 2)) AS t FROM lines WHERE line LIKE '#%')
SELECT file_id AS id, path AS label, 'file' AS type, path FROM f
UNION ALL SELECT id, t, type, path FROM (SELECT path, n, t, stem || '_' || regexp_replace(t, '[^\p{L}\p{N}_-]', '_', 'g') AS id, CASE WHEN h = '#' THEN 'class' ELSE 'function' END AS type FROM heads WHERE h <> '') QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1
"""
register("change_batch_upsert", UPSERTED)(_batch_upsert)
register("stream_upsert", UPSERTED)(_stream_upsert)
register("events_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")(lambda s, d: changes.events_tumbling(s.read.parquet(f"{d}/events.parquet")))
register("events_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")(lambda s, d: changes.events_sessions(s.read.parquet(f"{d}/events.parquet")))

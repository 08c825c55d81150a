"""What larger tables showed: names that repeat, rounds, and what one task holds."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_graph import brute_ranks, graph

from knotwork import graphs
from knotwork.operators import build, community, metrics, quality, traverse
from knotwork.plans import catalog
from knotwork.storage import TASK_BYTES, spread


def test_vault_pages_of_urls_that_repeat(spark, tmp_path):
    rows = [(1, "https://a.example/x", '<a href="page_2">'), (2, "https://a.example/x", '<a href="page_3">'), (3, "https://b.example/", "")]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    made = {tuple(r) for r in catalog.QUERIES["vault_pages"](spark, str(tmp_path)).select("name", "text").collect()}
    assert made == set(con.execute(catalog.ORACLES["vault_pages"]).fetchall()) and len(made) == 2


def test_tasks_grow_with_the_table(spark, tmp_path):
    path = str(tmp_path / "wide.parquet")
    spark.range(3_000_000).selectExpr("id", "md5(cast(id as string)) as text").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "wide.parquet").glob("*.parquet"))
    assert size > 8 * TASK_BYTES
    assert spread(df, "id").rdd.getNumPartitions() == -(-size // TASK_BYTES)
    assert spread(df.join(df.withColumnRenamed("text", "t"), "id"), "id", like=df).rdd.getNumPartitions() == -(-size // TASK_BYTES)


def test_lines_are_grouped_by_hash_after_spreading(spark, sf):
    g = graphs.star(spark, sf)
    for df in (metrics.degree(g.edges), metrics.degree_in_out(g), metrics.valid_edges(g)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan


def test_stream_batches_arrive_in_several_files(spark, sf, monkeypatch):
    from knotwork.streaming import changes

    seen = []
    keep = changes.keep_up
    monkeypatch.setattr(changes, "keep_up", lambda stream, *rest: (seen.append(1), keep(stream, *rest))[1])
    first, _ = catalog._two_batches(spark.newSession(), sf)
    made = []
    monkeypatch.setattr(type(first), "coalesce", lambda self, n: made.append(n) or self)
    catalog.QUERIES["stream_upsert"](spark, sf)
    assert len(seen) == 2 and not made


def test_ranks_without_cycles_take_few_rounds(spark, monkeypatch):
    nodes, edges = list("abcdefgh"), ["ab", "ac", "bc", "cd", "ad", "ad", "de", "fe"]
    rounds = []
    written = community.table
    monkeypatch.setattr(community, "table", lambda df: rounds.append(1) or written(df))
    for n in (100, 3):
        rounds.clear()
        ranks = {r.id: r["rank"] for r in community.pagerank(graph(spark, nodes, edges), iterations=n, local=0).collect()}
        assert ranks == pytest.approx(brute_ranks(nodes, edges, n), abs=1e-11)
        assert len(rounds) < 10


def test_rounds_of_moves_leave_no_tables(spark, monkeypatch):
    edges = [f"{a}{b}" for part in ("abcd", "efgh", "ijkl") for a in part for b in part if a < b] + ["de", "hi"]
    g = graph(spark, list("abcdefghijkl"), edges)
    labels = sorted(map(tuple, community.local_moves(g, 4).collect()))
    monkeypatch.setattr(community, "BUCKET_ROWS", 5)
    paths = []
    written = community.table

    def keep(df):
        made = written(df)
        paths.append(made._knotwork_path)
        return made

    monkeypatch.setattr(community, "table", keep)
    assert sorted(map(tuple, community.local_moves(g, 4).collect())) == labels
    assert len(paths) == 11 and len([p for p in paths if Path(p.removeprefix("file:")).exists()]) == 3


def test_modularity_reads_edges_once(spark, sf):
    g = graph(spark, list("abcd"), ["ab", "bc", "cd", "ax"])
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("x", 2), ("d", None)], "node_id string, community_id bigint")
    got = {r.community_id: r.modularity for r in community.modularity(g, members).collect()}
    assert got == {1: round(2 / 6 - (3 / 6) ** 2, 6), 2: round(-((2 / 6) ** 2), 6), None: 0.0}
    df = catalog.QUERIES["community_modularity"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan  # what is left to do is read off the table of pairs


def _components(nodes, edges):
    name = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in name and b in name:
                name[a] = name[b] = min(name[a], name[b])
    return name


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(community, "HOT_ROWS", 1)
    calls = []
    roots = community._roots
    monkeypatch.setattr(community, "_roots", lambda parents: calls.append(1) or roots(parents))
    nodes = list("abcdefghijkl")
    for edges, rounds in ((["gf", "fe", "ed", "dz", "zc", "ha", "hb", "gb", "ii"], None), (["ab", "bc", "ca", "de", "ed", "fe", "gf", "hi"], None), (["la", "lb", "ac", "bc", "cd", "be"], 1)):
        calls.clear()
        got = {r.id: r.component for r in community.weak_components(graph(spark, nodes, edges), local=0).collect()}
        assert got == _components(nodes, edges)
        assert rounds in (None, len(calls))  # whatever one source leads to is one after a round


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_issues_are_grouped_after_spreading(spark, sf):
    g = graphs.star(spark, sf)
    lines = _plan(g.edges).count("REPARTITION_BY_NUM")
    for df in (quality.dead_code(g), quality.circular(g), quality.god_classes(g)):
        assert _plan(df).count("REPARTITION_BY_NUM") == lines + 1  # edges are spread before they are grouped


def test_issues_shown_and_analysis_count_all(spark):
    nodes = [*((f"f{k}", f"f{k}", "function") for k in range(5)), ("a", "a", "class"), ("b", "b", "class")]
    g = graph(spark, nodes, [("a", "b"), ("b", "a")])
    shown = sorted((r.type, r.nodes, r.rank, r.of) for r in quality.issues_shown(quality.issues(g)).collect())
    assert shown == [("circular_dependency", "a,b", 1, 1), *(("dead_code", f"f{k}", k + 1, 5) for k in range(3))]
    rows = {(r.section, r.name): r.value for r in quality.analysis(g).collect()}
    assert rows[("issues", "dead_code")] == 5 and rows[("issues", "circular_dependency")] == 1 and rows[("god_nodes", "a")] == 2
    assert rows[("health", "score")] == round(1 - 0.5 * (5 * 0.3 + 0.6) / 6, 6)


def test_hubs_are_spread(spark, sf):
    g = graphs.star(spark, sf)
    members = g.nodes.select(g.nodes.id.alias("node_id"), g.nodes.ord.cast("bigint").alias("community_id"))
    plan = _plan(community.community_hubs(g, members))
    assert plan.count("REPARTITION_BY_NUM") == _plan(g.edges).count("REPARTITION_BY_NUM") + 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("local", (0, 100))
def test_paths_join_no_edge_with_nodes(spark, monkeypatch, local):
    g = graph(spark, list("abcdef"), ["ab", "ac", "bd", "cd", "df", "zf", "az", "ab", "de"])
    calls = []
    valid = traverse.valid_edges
    monkeypatch.setattr(traverse, "valid_edges", lambda g_: calls.append(1) or valid(g_))
    assert [r.id for r in traverse.shortest_path(g, "a", "f", local).orderBy("step").collect()] == list("abdf")
    assert traverse.shortest_path(g, "a", "z", local).count() == 0 and traverse.shortest_path(g, "f", "a", local).count() == 0
    assert bool(calls) == bool(local)  # edges that lack an end only matter in one task


def test_first_rows_are_spread(spark, sf):
    g = graphs.star(spark, sf)
    lines = _plan(g.edges).count("REPARTITION_BY_NUM")
    assert _plan(build.dedupe_edges(g.edges)).count("REPARTITION_BY_NUM") == lines + 1
    assert "REPARTITION_BY_NUM" in _plan(build.dedupe_nodes(g.nodes))

def test_strong_components_trim_before_nodes_are_looked_up(spark, monkeypatch):
    calls = []
    valid = community.valid_edges
    monkeypatch.setattr(community, "valid_edges", lambda *a, **k: calls.append(1) or valid(*a, **k))
    nodes = list("abcdefghijkl")
    assert all(r.id == r.component for r in community.strong_components(graph(spark, nodes, ["ab", "ac", "bd", "cd", "df", "az", "zy", "ab"]), 3).collect())
    assert not calls  # without a cycle no edge is joined with nodes
    edges = ["ab", "bc", "ca", "cd", "de", "ed", "ef", "fz", "zf", "gg", "hi", "ij", "jk", "kj", "la", "ab"]
    for local in (2, 10):
        got = {r.id: r.component for r in community.strong_components(graph(spark, nodes, edges), local).collect()}
        assert got == {**{n: n for n in "fghil"}, "a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "j": "j", "k": "j"}


def test_ids_that_share_a_mark_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(community, "_mark", lambda c: F.lit(0).cast("bigint"))
    g = graph(spark, list("abcdef"), ["fa", "ab", "bc", "ca", "cd", "de", "ed"])
    got = {r.id: r.component for r in community.strong_components(g, 6).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}

"""Small graphs with known answers."""

import json

import pytest

from knotwork.model import EDGE_SCHEMA, Graph, as_edges, as_nodes, empty_graph
from knotwork.operators import build, community, incremental, metrics, quality, resolve, traverse
from knotwork.plans import verbs
from knotwork.sources import export, graph_json
from knotwork.storage import clean, shared_dir, table


def graph(spark, nodes, edges):
    """nodes: id or (id, label, type[, file]); edges: (source, target[, relation[, confidence]])."""
    n = [(x, x, "function", None, k) if isinstance(x, str) else (x[0], x[1], x[2], x[3] if len(x) > 3 else None, k) for k, x in enumerate(nodes)]
    e = [(x[0], x[1], x[2] if len(x) > 2 else "calls", x[3] if len(x) > 3 else "EXTRACTED", k) for k, x in enumerate(edges)]
    return Graph(
        as_nodes(spark.createDataFrame(n, "id string, label string, type string, source_file string, ord bigint")),
        as_edges(spark.createDataFrame(e, "source string, target string, relation string, confidence string, ord bigint")),
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_chain_walks(spark):
    g = graph(spark, list("abcdef"), ["ab", "bc", "cd", "de", "ef"])
    assert got(traverse.bfs(g, ["a"], 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert got(traverse.bfs(g, ["zz"], 2)) == []
    assert [r.id for r in traverse.shortest_path(g, "a", "c").orderBy("step").collect()] == ["a", "b", "c"]
    assert got(traverse.shortest_path(g, "c", "a")) == []
    assert [r.id for r in traverse.shortest_path(g, "a", "a").collect()] == ["a"]
    assert got(traverse.impact_nodes(g, ["a"], 3)) == [("b", 1, "must_change", 1.0), ("c", 2, "likely_affected", 0.35), ("d", 3, "should_review", pytest.approx(0.7 / 3))]
    s = traverse.impact_summary(g, ["a", "b"], 2).first()
    assert (s.direct, s.indirect, s.blast_radius, s.estimated_lines) == (1, 1, 2, 100)


def test_diamond_and_parallel_edges(spark):
    g = graph(spark, list("abcd"), ["ab", "ac", "bd", "cd", "cd", "aa"])
    assert got(traverse.all_paths(g, "a", "d", 3)) == [("a>b>d", 3), ("a>c>d", 3), ("a>c>d", 3)]
    assert got(traverse.all_paths(g, "a", "d", 2)) == []
    assert got(traverse.all_paths(g, "a", "a", 3)) == [("a", 1)]
    for local in (0, 100):
        assert [r.id for r in traverse.shortest_path(g, "a", "d", local).orderBy("step").collect()] == ["a", "b", "d"]
        assert got(traverse.shortest_path(g, "d", "a", local)) == []


def test_hubs_self_loops_and_dangling(spark):
    g = graph(spark, ["hub", "x", "y", "z"], [("hub", "x"), ("hub", "y"), ("hub", "z"), ("x", "x"), ("y", "gone")])
    assert metrics.god_nodes(g, 1).first().id == "hub"
    assert dict(got(metrics.degree(g.edges)))["x"] == 3
    assert {r.id: r.degree for r in metrics.god_nodes_core(g, 4).collect()} == {"hub": 3, "x": 2, "y": 1, "z": 1}
    assert {r.label for r in metrics.god_nodes(g, 9).collect()} >= {"unknown"}
    kept = build.prune_dangling(g)
    assert kept.edges.count() == 4 and g.edges.count() == 5
    assert got(quality.circular(g)) == [("x", "x", 0.6)]


def test_god_threshold_is_not_percentile(spark):
    # 100 ids of degree 1..100: rank floor(99) from 0 is the greatest.
    g = graph(spark, [], [(f"s{k}", "t") for k in range(3)])
    assert metrics.god_threshold(g).first().threshold == 3


def test_cycles_dead_code_health(spark):
    g = graph(spark, [("hub", "HubClass", "class"), "leaf1", "leaf2", "a", "b", "alone"], [("hub", "leaf1"), ("hub", "leaf2"), ("a", "b"), ("b", "a")])
    assert got(quality.circular(g)) == [("a", "b", 0.6)]
    assert got(quality.dead_code(g)) == [("alone", 0.3)]
    assert quality.health(g).first().health == pytest.approx(1 - 0.5 * 0.45)
    assert "HubClass" in {r.label for r in metrics.god_nodes(g, 3).collect()}
    assert quality.health(empty_graph(spark)).first().health == 1.0
    assert set(quality.analyze(g)) == {"god_nodes", "issues", "health", "style"}


def test_god_class_needs_more_than_fifty(spark):
    nodes = [("k", "K", "class"), ("m", "M", "class"), *(f"f{i}" for i in range(51))]
    g = graph(spark, nodes, [(f"f{i}", "k") for i in range(51)] + [(f"f{i}", "m") for i in range(50)])
    assert got(quality.god_classes(g)) == [("k", 51, 0.51)]


@pytest.mark.parametrize("local", [0, community.LOCAL_EDGES])
def test_components(spark, local):
    g = graph(spark, list("abcdefg"), ["ab", "bc", "ca", "cd", "de", "ed", "ff"])
    assert dict(got(community.strong_components(g, local))) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f", "g": "g"}
    assert dict(got(community.weak_components(g))) == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "f": "f", "g": "g"}


def test_long_chains_and_cycles(spark):
    names = [f"n{k * 7919 % 1000:03}" for k in range(300)]
    cycle = graph(spark, names, [(names[k], names[(k + 1) % 300]) for k in range(300)] + [(names[0], "out")])
    assert {r.component for r in community.strong_components(cycle).collect()} == {min(names)}
    chain = graph(spark, names, [(names[k + 1], names[k]) for k in range(299)])
    assert {r.component for r in community.weak_components(chain).collect()} == {min(names)}
    assert community.strong_components(chain).where("id <> component").count() == 0


def test_long_walks(spark):
    names = [f"n{k * 7919 % 1000:03}" for k in range(111)]
    g = graph(spark, names, [(names[k], names[k + 1]) for k in range(110)])
    assert [r.id for r in traverse.shortest_path(g, names[0], names[110]).orderBy("step").collect()] == names


def brute_ranks(nodes, edges, iterations=100):
    out = {x: [t for s, t in edges if s == x] for x in nodes}
    ranks = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(iterations):
        lost = sum(ranks[x] for x in nodes if not out[x])
        new = dict.fromkeys(nodes, (0.15 + 0.85 * lost) / len(nodes))
        for x in nodes:
            for t in out[x]:
                new[t] += 0.85 * ranks[x] / len(out[x])
        ranks = new
    return ranks


def test_pagerank(spark):
    edges = ["ab", "ac", "bc", "ca", "ad", "ad"]
    for nodes, local, rounds in (("abcd", 10, 100), ("abcdef", 10, 100), ("abcdef", 0, 7)):
        g = graph(spark, list(nodes), edges)
        ranks = {r.id: r["rank"] for r in community.pagerank(g, iterations=rounds, local=local).collect()}
        assert sum(ranks.values()) == pytest.approx(1)
        assert ranks == pytest.approx(brute_ranks(nodes, edges, rounds), abs=1e-11)


def modularity(edges, of):
    m = len(edges)
    degree, inside = {}, {}
    for a, b in edges:
        for x in (a, b):
            degree[of[x]] = degree.get(of[x], 0) + 1
        inside[of[a]] = inside.get(of[a], 0) + (of[a] == of[b])
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def louvain(nodes, edges):
    """Plain sequential Louvain: communities of nodes."""
    of = {x: x for x in nodes}
    weights = {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            weights.setdefault(x, {})
            weights[x][y] = weights[x].get(y, 0) + 1
    whole = 2 * len(edges)
    while True:
        at, strength = {x: x for x in weights}, {x: sum(w.values()) for x, w in weights.items()}
        total, moved = dict(strength), True
        while moved:
            moved = False
            for x in sorted(weights):
                to = {at[x]: 0}
                for y, w in weights[x].items():
                    if y != x:
                        to[at[y]] = to.get(at[y], 0) + w
                total[at[x]] -= strength[x]
                best = max(sorted(to), key=lambda c: (to[c] - strength[x] * total[c] / whole, c == at[x]))
                moved |= best != at[x]
                at[x] = best
                total[best] += strength[x]
        if len(set(at.values())) == len(weights):
            return of
        of = {x: at.get(c, c) for x, c in of.items()}
        merged = {}
        for x, ws in weights.items():
            for y, w in ws.items():
                merged.setdefault(at[x], {})
                merged[at[x]][at[y]] = merged[at[x]].get(at[y], 0) + w
        weights = merged


def test_small_communities(spark):
    def of(nodes, edges):
        return {r.node_id: r.community_id for r in community.communities(graph(spark, nodes, edges)).collect()}

    assert len(set(of(["a", "b"], ["ab"]).values())) == 1
    assert len(set(of(["hub", "x", "y", "z"], [("hub", c) for c in "xyz"]).values())) == 1
    cliques = [f"{p}{k}" for p in "ab" for k in range(5)]
    by = of(cliques, [(f"{p}{i}", f"{p}{j}") for p in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")])
    assert {by[f"a{k}"] for k in range(5)} == {by["a0"]} != {by["b0"]} == {by[f"b{k}"] for k in range(5)}
    assert of(["a", "b"], []) == {"a": 0, "b": 0}
    assert len(set(of(["a", "b", "c"], ["ab", "aa"]).values())) == 2
    star = graph(spark, ["hub", "x", "y", "alone"], [("hub", "x"), ("hub", "y"), ("y", "x", "calls"), ("hub", "hub")])
    assert got(community.communities(star, local=0)) == got(community.communities(star))


@pytest.mark.parametrize("kind", ["ring", "blocks", "bipartite"])
def test_communities_are_as_good_as_louvain(spark, kind):
    import random

    r = random.Random(kind)
    if kind == "ring":
        edges = [(f"{p}_{i}", f"{p}_{j}") for p in range(8) for i in range(5) for j in range(i)] + [(f"{p}_0", f"{(p + 1) % 8}_1") for p in range(8)]
    elif kind == "blocks":
        names = [f"{k % 4}_{k}" for k in range(60)]
        edges = [(a, b) for i, a in enumerate(names) for b in names[:i] if r.random() < (0.4 if a[0] == b[0] else 0.03)]
    else:
        edges = [(f"l{k % 30}", f"r{(k % 30 * 2 + r.randrange(6)) % 40}") for k in range(120)]
        edges = sorted(set(edges))
    nodes = sorted({x for e in edges for x in e})
    g = graph(spark, nodes, edges)
    members = community.communities(g)
    of = {x.node_id: x.community_id for x in members.collect()}
    assert sorted(of) == nodes
    assert modularity(edges, of) >= modularity(edges, louvain(nodes, edges)) - 0.02
    assert sum(x.modularity for x in community.modularity(g, members).collect()) == pytest.approx(modularity(edges, of), abs=1e-4)


def test_merge_and_accumulate(spark):
    a, b = graph(spark, ["a", "b"], ["ab"]), graph(spark, ["x", "y"], ["xy", ("x", "gone")])
    m = build.merge(a, b, "repo2")
    assert got(m.nodes.select("id")) == [("a",), ("b",), ("repo2::x",), ("repo2::y",)]
    assert got(m.edges.select("source", "target")) == [("a", "b"), ("repo2::x", "repo2::y")]
    both = build.merge_all([("p/one", a), ("q/one", b), ("r/one", b)])
    assert both.nodes.count() == 6 and both.nodes.select("id").distinct().count() == 6
    once = build.accumulate(a, b, "p")
    assert build.accumulate(once, b, "p").nodes.count() == 4
    # A later version takes the place of what the project had; then the project is forgotten.
    later = build.accumulate(once, graph(spark, [("x", "new label", "class"), "w"], ["xw"]), "p")
    assert got(later.nodes.select("id", "label")) == [("a", "a"), ("b", "b"), ("p::w", "w"), ("p::x", "new label")]
    assert got(later.edges.select("source", "target")) == [("a", "b"), ("p::x", "p::w")]
    assert got(build.forget(later, "p").nodes.select("id")) == [("a",), ("b",)]


def test_dedupe_and_inference(spark):
    n = as_nodes(spark.createDataFrame([("a", "late", 2, None), ("a", "first", 1, None), ("a", "rich", 3, "f.py"), ("b", "b", 0, None)], "id string, label string, ord bigint, source_file string"))
    assert dict(got(build.dedupe_nodes(n).select("id", "label"))) == {"a": "first", "b": "b"}
    assert dict(got(build.dedupe_nodes_richest(n).select("id", "label"))) == {"a": "rich", "b": "b"}
    g = graph(spark, list("abc"), [("a", "b", "imports"), ("a", "b", "imports"), ("b", "c", "imports"), ("b", "a", "imports"), ("b", "zz", "imports_from")])
    assert got(build.infer_edges(g).select("source", "target", "relation", "weight")) == [("a", "c", "references", 0.3)] * 2


def test_resolution_scenarios(spark):
    def resolved(nodes, edges):
        g = graph(spark, nodes, edges)
        return g, got(resolve.candidates(g).select("source", "target", "weight"))

    f = ("f", "helper", "function", "b.py")
    me = ("me", "me", "file", "a.py")
    g, r = resolved([f, me], [("me", "helper", "imports")])
    assert r == [("me", "f", 0.6)]
    new = resolve.resolve(g).first()
    assert (new.context, new.confidence, new.relation) == ("cross_file_resolved", "INFERRED", "references")
    assert resolved([("p", "database::pool", "function", "b.rs"), me], [("me", "pool", "imports")])[1] == [("me", "p", 0.6)]
    assert resolved([("p", "x", "concept", "utils.py"), me], [("me", "utils.py", "imports")])[1] == [("me", "p", 0.5)]
    assert resolved([f, me], [("me", "./utils", "imports")])[1] == []
    assert len(resolved([f, me, ("you", "you", "file", "c.py")], [("me", "helper", "imports"), ("you", "helper", "imports")])[1]) == 2
    assert resolved([("f", "helper", "function", "a.py"), me], [("me", "helper", "imports")])[1] == []
    assert resolved([f, me], [("me", "numpy", "imports")])[1] == []
    assert resolved([f, me], [("me", "helper", "calls")])[1] == []
    assert len(resolved([("r", "readme.md", "file", "readme.md"), me], [("me", "readme.md", "imports")])[1]) == 2
    g, _ = resolved([f, me], [("me", "helper", "imports"), ("me", "f", "calls")])
    assert resolve.resolve(g).count() == 0
    assert resolve.resolve(empty_graph(spark)).count() == 0


def test_explain_ask_and_search(spark):
    g = graph(spark, [("a", "Alpha_One", "class"), ("b", "AlphaX", "function"), ("c", "Gamma", "file")], [("a", "b"), ("c", "a", "imports", "AMBIGUOUS"), ("a", "zz")])
    assert [r.id for r in verbs.find_nodes(g, "alpha_").collect()] == ["a"]
    assert got(verbs.find_nodes(g, "%").select("id")) == []
    assert [tuple(r) for r in verbs.keyword_search(g, "gamma alpha").collect()] == [(0, "c", "Gamma"), (1, "a", "Alpha_One"), (1, "b", "AlphaX")]
    assert verbs.keyword_search(g, "  ").count() == 0
    e = {(r.direction, r.other): (r.label, r.of) for r in verbs.explain(g, "a").collect()}
    assert e == {("out", "b"): ("AlphaX", 2), ("out", "zz"): ("zz", 2), ("in", "c"): ("Gamma", 1)}
    assert {r.id for r in verbs.ask(g, verbs.Question("gamma", min_confidence=0.5)).collect()} == {"c"}
    assert [r.id for r in verbs.ask(g, verbs.Question("gamma", budget=3)).collect()] == ["c"]
    assert [r.id for r in verbs.path(g, "gamma", "alphax").orderBy("step").collect()] == ["c", "a", "b"]
    assert verbs.path(g, "nothing", "gamma").count() == 0
    assert got(verbs.query(g, "no such, but gamma").select("id", "depth")) == [("a", 1), ("b", 2), ("c", 0)]
    summary, hit = verbs.impact(g, ["gamma"])
    assert summary.first().blast_radius == 2 and hit.count() == 2
    assert verbs.label_communities(spark.createDataFrame([(1, "x")], "community_id int, label string"), lambda s: s + "!").first().label == "x!"


def test_diff(spark):
    a, b = graph(spark, ["a", "b", ("c", "old", "file")], []), graph(spark, ["b", ("c", "new", "file"), "d"], [])
    assert got(quality.diff(a, b)) == [("a", "removed"), ("c", "changed"), ("d", "added")]
    assert quality.diff_risk(a, b).first().level == "HIGH"
    assert quality.diff_risk(a, a).first().level == "LOW"
    assert quality.diff_risk(empty_graph(spark), a).first().risk == 1.0
    s = quality.size_reduction(spark.createDataFrame([("x" * 1000,), (None,)], "content string"), 150).first()
    assert (s.source_bytes, s.reduction, s.tokens_saved, s.grade) == (1000, 85.0, 212, "good")


def test_incremental(spark):
    files = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "path string, content string")
    m = incremental.load(spark, "/nowhere/at/all")
    assert {r.status for r in incremental.status(files, m).collect()} == {"new"}
    entries = files.select("path", incremental.content_hash(files.content).alias("hash")).selectExpr("path", "hash", "'Python' as language", "case when path <> 'c' then 'x' end as cached_result")
    m = incremental.upsert(m, entries)
    assert len(m.first().hash) == 64
    later = spark.createDataFrame([("a", "one"), ("b", "changed"), ("c", "three")], "path string, content string")
    assert dict(got(incremental.status(later, m).select("path", "status"))) == {"a": "unchanged", "b": "changed", "c": "changed"}
    assert m.count() == incremental.upsert(m, entries.where("path = 'b'")).count()
    assert got(incremental.upsert(m, entries.where("false"), entries.where("path = 'a'")).select("path")) == [("b",), ("c",)]


def test_manifest_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("a", "h", "Python", "x")], incremental.MANIFEST)
    incremental.save(entries, str(tmp_path / "m"))
    assert got(incremental.load(spark, str(tmp_path / "m"))) == got(entries)


def test_exports(spark, tmp_path):
    g = graph(spark, [("n1", "UserService", "class", "a.py"), ("n.2", 'get"user', "function")], [("n1", "n.2", "contains", "INFERRED")])
    s = metrics.graph_stats(g).first()
    assert (s.node_count, s.edge_count, s.avg_degree, s.density) == (2, 1, 1.0, 0.5)
    text = export.mermaid(g, community.communities(g))
    assert '    n1(["UserService"])' in text and "    n1 -.- |contains| n_2" in text and "subgraph 0" in text
    assert export.svg(g).count("<circle") == 2 and export.svg(g).count("<line") == 1
    assert "UserService" in export.page(g)
    export.write_all(g, str(tmp_path / "out"), community.communities(g))
    assert (tmp_path / "out/vault/UserService.md").read_text().startswith("# UserService")
    assert "## God nodes" in (tmp_path / "out/GRAPH_REPORT.md").read_text()
    found = spark.read.option("header", True).csv(str(tmp_path / "out/neo4j_relationships")).first()
    assert (found[":START_ID"], found["confidence"]) == ("n1", "Inferred")
    document = json.loads(graph_json.document(g).first().json)
    assert document["schema_version"] == "2.0" and [n["id"] for n in document["nodes"]] == ["n1", "n.2"]
    again = graph_json.read(spark, str(tmp_path / "out/graph.json"))
    assert got(again.edges.select("source", "target", "weight")) == [("n1", "n.2", 1.0)]
    graph_json.write_tables(g, str(tmp_path / "t"))
    assert graph_json.read_tables(spark, str(tmp_path / "t")).nodes.count() == 2
    assert graph_json.json_lines(g).count() == 3
    assert (tmp_path / "out/vault/INDEX.md").read_text().count("[[") == 4
    export.write_vault_table(g, str(tmp_path / "vault"))
    assert spark.read.parquet(str(tmp_path / "vault")).count() == 2


def test_vault_names(spark, tmp_path):
    wide, long = "漢" * 150, "x" * 300
    labels = [wide, wide + "字", long, long + "y", "a/b", "a:b", "Same", "same", "INDEX", ".hidden", "plain", "plain"]
    g = graph(spark, [(f"n{k}", x, "class") for k, x in enumerate(labels)], [("n0", "n1"), ("n10", "gone")])
    export.write_vault(g, str(tmp_path / "v"))
    pages = {p.name: p.read_text().split("\n")[0] for p in (tmp_path / "v").iterdir() if p.stem not in ("INDEX", "GOD_NODES")}
    assert sorted(pages.values()) == sorted(f"# {x}" for x in set(labels))
    assert "plain.md" in pages and "_hidden.md" in pages and all(len(n.encode()) < 255 for n in pages)
    names = {r.id: r.name for r in export.page_names(g.nodes).collect()}
    assert f"- calls [[{names['n1']}]]" in (tmp_path / f"v/{names['n0']}.md").read_text()


def test_large_orders(spark):
    n = spark.createDataFrame([("a", "second", 10**18), ("a", "first", 10**18 - 1)], "id string, label string, ord bigint")
    assert build.dedupe_nodes(as_nodes(n)).first().label == "first"


def test_empty_graph(spark):
    g = empty_graph(spark)
    assert metrics.god_nodes(g).count() == 0
    assert metrics.graph_stats(g).first().node_count == 0
    assert metrics.graph_stats(g).first().density == 1.0
    assert community.communities(g).count() == 0
    assert community.local_moves(g).count() == 0 and community.strong_components(g).count() == 0
    assert community.pagerank(g, iterations=2).count() == 0
    assert community.weak_components(g).count() == 0
    assert traverse.all_paths(g, "a", "b", 4).count() == 0
    assert build.build_graph(g.nodes, g.edges).nodes.count() == 0
    assert build.build_stats(g).first().edge_count == 0
    assert spark.createDataFrame([], EDGE_SCHEMA).count() == 0


def test_tables_are_cleaned(spark):
    import os

    assert table(spark.range(3)).count() == 3
    folder = os.path.join(shared_dir(spark).removeprefix("file:"), "knotwork", spark.sparkContext.applicationId)
    assert os.path.isdir(folder)
    clean(spark)
    assert not os.path.exists(folder)

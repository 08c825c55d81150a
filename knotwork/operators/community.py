"""Components, PageRank and communities: rounds over written tables."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import Graph
from ..session import ship
from ..storage import bucketed, discard, spread, table
from .metrics import degree, degree_in_out, graph_stats, valid_edges


#: A graph of at most so many edges, by count, is finished in one task (some 200 MB): what comes out is the same, and rounds
#: cost no jobs. It is so for what is left of a larger graph, too.
LOCAL_EDGES = 2_000_000


#: A key of more rows than this is looked up in a broadcast table, so that no task gets all of them.
HOT_ROWS = 100_000


def _looked_up(df: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """df, a table, with what of, a table, has for its key, or nulls; keys of many rows don't meet in one task."""
    hot = df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS).select(key)
    hot = table(of.join(F.broadcast(hot), key).withColumn("__hot", F.lit(True)))  # no more than df's rows / HOT_ROWS
    marked = df.join(F.broadcast(hot), key, "left")
    return marked.where("__hot").drop("__hot").unionByName(marked.where("__hot is null").select(df.columns).join(of, key, "left"))


def _roots(parents: DataFrame) -> DataFrame:
    """(n, p) where the way from n by its parent (n, p), that one's parent and so on ends, by steps that double; not for
    nodes whose ways end nowhere."""
    parts = [table(parents.withColumn("done", F.lit(False)))]
    left = parts[0].count()
    while left:
        at = reduce(DataFrame.unionByName, [*(x.where("done") for x in parts[:-1]), parts[-1]])
        further = at.select(F.col("n").alias("p"), F.col("p").alias("q"), F.col("done").alias("d"))
        rest = _looked_up(parts[-1].where("not done"), "p", further)
        parts.append(table(rest.select("n", F.coalesce("q", "p").alias("p"), F.coalesce("d", F.lit(True)).alias("done"))))
        before, left = left, parts[-1].where("not done").count()
        if left == before:  # who is left leads to a cycle
            break
    return reduce(DataFrame.unionByName, [x.where("done").select("n", "p") for x in parts])


def _weak(source: np.ndarray, target: np.ndarray, _: np.ndarray, ids: list[str]) -> tuple[list, list]:
    """Each id with the least id of its weak component."""
    label = np.arange(len(ids))
    while True:
        a, b = label[source], label[target]
        if (a == b).all():
            return ids, [ids[k] for k in label]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # labels are roots here, and each takes a lesser one
        while (label != label[label]).any():
            label = label[label]


def weak_components(graph: Graph, local: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) of every node; a component is named by its least id.

    Nodes get numbers, and edges are pairs of those from then on. In each round a node is one with its parent, and with
    that one's parent, and so on; edges then join what is left, until at most local of them are left for one task. The first
    parent is a node that leads here, which takes no shuffle of its own and leaves only sources if there are no
    cycles. Later it is the least neighbour that is less than the node, so that at least half of the nodes go in a round.
    """
    numbers = table(spread(graph.nodes.select("id"), "id", like=graph.edges).distinct().select("id", F.monotonically_increasing_id().alias("n")))
    e = spread(graph.edges.select("source", "target"), "source", like=graph.edges).join(numbers.select(F.col("id").alias("source"), F.col("n").alias("u")), "source").select("u", "target")
    e = spread(e, "target", like=graph.edges).join(numbers.select(F.col("id").alias("target"), F.col("n").alias("v")), "target").select("u", "v")
    edges = table(e.where("u <> v"))
    parents = edges.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("p"))
    maps: list[DataFrame] = []
    while (size := edges.count()) > local:
        maps.append(table(_roots(parents)))
        at = lambda c: maps[-1].select(F.col("n").alias(c), F.col("p").alias(f"{c}_p"))
        moved = spread(edges, "u").join(at("u"), "u", "left").select(F.coalesce("u_p", "u").alias("u"), "v")
        moved = spread(moved, "v", like=edges).join(at("v"), "v", "left").select("u", F.coalesce("v_p", "v").alias("v"))
        edges = table(moved.where("u <> v").distinct())
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        parents = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("p")).where("p < n")
    if size:
        found = in_one_task(edges.select(F.col("u").cast("string").alias("source"), F.col("v").cast("string").alias("target"), F.lit(1.0).alias("w")), _weak, "id string, name string")
        maps.append(table(found.select(F.col("id").cast("bigint").alias("n"), F.col("name").cast("bigint").alias("p"))))
    members = numbers
    for k, to in enumerate(maps):
        members = (_looked_up(members, "n", to) if k else members.join(to, "n", "left")).select("id", F.coalesce("p", "n").alias("n"))
        members = table(members)
    least = table(members.groupBy("n").agg(F.min("id").alias("component")))
    return _looked_up(members, "n", least).select("id", "component")


def in_one_task(edges: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray, list[str]], Iterable[np.ndarray | list]], schema: str) -> DataFrame:
    """What run makes of all edges (source, target, w), a written table: ends as places in the sorted list of ids, which it
    gets as well. It returns columns of the schema."""
    ship(edges.sparkSession)
    fields = [c.strip().split(" ") for c in schema.split(",")]
    made = pa.schema([(name, {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}[kind]) for name, kind in fields])

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(stream)
        t = pa.Table.from_batches(batches) if batches else pa.schema([("source", pa.string()), ("target", pa.string()), ("w", pa.float64())]).empty_table()
        both = pa.chunked_array([*t["source"].chunks, *t["target"].chunks], pa.string()).combine_chunks().dictionary_encode()
        both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
        ids = both.dictionary.to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        at = place[both.indices.to_numpy(zero_copy_only=False)]
        columns = run(at[: t.num_rows], at[t.num_rows :], t["w"].to_numpy(), [ids[k] for k in order])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    return edges.select("source", "target", "w").coalesce(1).mapInArrow(task, schema)


def _strong(source: np.ndarray, target: np.ndarray, _: np.ndarray, ids: list[str]) -> tuple[list, list]:
    """Each id with the least id of its strong component."""
    order = np.argsort(source, kind="stable")
    to, first = target[order].tolist(), np.searchsorted(source[order], np.arange(len(ids) + 1)).tolist()
    seen, low, name = [-1] * len(ids), [0] * len(ids), [-1] * len(ids)
    stack: list[int] = []
    n = 0
    for start in range(len(ids)):
        if seen[start] >= 0:
            continue
        work = [[start, first[start]]]
        seen[start] = low[start] = n
        n += 1
        stack.append(start)
        while work:
            u, k = work[-1]
            if k < first[u + 1]:
                work[-1][1] += 1
                v = to[k]
                if seen[v] < 0:
                    seen[v] = low[v] = n
                    n += 1
                    stack.append(v)
                    work.append([v, first[v]])
                elif name[v] < 0:
                    low[u] = min(low[u], seen[v])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[u])
            if low[u] == seen[u]:
                found = []
                while not found or found[-1] != u:
                    found.append(stack.pop())
                least = min(found)  # places are in the order of ids
                for v in found:
                    name[v] = least
    return ids, [ids[k] for k in name]


def _cyclic(source: np.ndarray, target: np.ndarray, w: np.ndarray, ids: list[str]) -> tuple[list]:
    """The ids that a cycle goes through."""
    _, names = _strong(source, target, w, ids)
    size = Counter(names)
    own = {ids[k] for k in source[source == target].tolist()}
    return ([i for i, name in zip(ids, names, strict=True) if size[name] > 1 or i in own],)


def _mark(column: str) -> Column:
    """A number for an id. Ids may share one, which may only keep more edges."""
    return F.xxhash64(column)


def _on_cycles(edges: DataFrame, local: int) -> DataFrame:
    """edges, a table without self-loops, without those that are on no cycle: all of those if at most local are left for one
    task, else what can be trimmed away. edges itself if nothing goes.

    Edges are pairs of marks until the end. A round trims the edges to nodes without an edge out, or those from nodes without
    an edge in: one way as long as a quarter of the edges goes, else the other.
    """
    pairs, size = edges.select(_mark("source").alias("u"), _mark("target").alias("v")), edges.count()
    whole, like, made = size, edges, []
    at, other, idle = "v", "u", 0
    while size > local and idle < 2:
        ends = spread(pairs.select(F.col(other).alias(at)), at, like=like).distinct()
        # Joined, not left_semi: the optimizer would move that below the spreading.
        pairs = like = table(spread(pairs, at, like=like).join(ends, at).select("u", "v"))
        left = pairs.count()
        if made:
            discard(made.pop(), shuffles=True)
        made.append(pairs)
        idle = 0 if left < size else idle + 1
        if left > size * 3 / 4:
            at, other = other, at
        size = left
    if 0 < size <= local:
        text = pairs.select(F.col("u").cast("string").alias("source"), F.col("v").cast("string").alias("target"), F.lit(1.0).alias("w"))
        found = table(in_one_task(text, _cyclic, "id string").select(F.col("id").cast("bigint").alias("u")))
        pairs = table(pairs.join(found, "u").join(found.withColumnRenamed("u", "v"), "v").select("u", "v"))
        size = pairs.count()
    if size == whole:
        return edges
    if not size:
        return table(edges.limit(0))
    left, marked = pairs.distinct(), edges.withColumns({"u": _mark("source"), "v": _mark("target")})
    if size > HOT_ROWS:
        left, marked = (spread(df, "u", "v", like=edges) for df in (left, marked))
    else:
        left = F.broadcast(left)
    return table(marked.join(left, ["u", "v"]).select("source", "target"))


def strong_components(graph: Graph, local: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) of every node; a component is named by its least id.

    Edges that are on no cycle are trimmed first, again and again, before their ends are looked up among the nodes. In what
    is left each node takes the least id that leads to it; the nodes that lead back to that id, through nodes of the same
    name, are its component. They go, and the rest goes round again. Once at most local edges are left, one task
    finishes them: the components are the same either way.
    """
    nodes = spread(graph.nodes.select("id"), "id", like=graph.edges).distinct()
    edges = table(graph.edges.where("source <> target").select("source", "target"))
    if edges.count() > local:
        edges = _on_cycles(edges, local)
        if edges.isEmpty():
            return nodes.withColumn("component", F.col("id"))
    edges = table(valid_edges(Graph(nodes, edges), like=graph.edges).distinct())
    size = edges.count()
    done: list[DataFrame] = []
    while size > local:
        kept = _on_cycles(edges, local)
        if kept is not edges:
            edges, size = kept, kept.count()
            continue
        names = table(edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("name", F.col("id")))
        moved = 1
        while moved:
            said = edges.join(names.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("name").alias("said"))
            # The name of one's name leads here, too, which makes long ways short.
            # Left, as a node may have no edge in where marks are shared.
            names = names.join(said, "id", "left").select("id", F.least("name", "said").alias("name"), F.coalesce(F.col("said") < F.col("name"), F.lit(False)).alias("moved"))
            far = names.select(F.col("id").alias("name"), F.col("name").alias("further"))
            names = table(names.join(far, "name").select("id", F.least("name", "further").alias("name"), (F.col("moved") | (F.col("further") < F.col("name"))).alias("moved")))
            moved = names.where("moved").count()
            names = names.select("id", "name")
        inside = edges.join(names.select(F.col("id").alias("source"), F.col("name").alias("a")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("b")), "target")
        inside = table(inside.where("a = b").select("source", "target"))
        front = back = table(names.where("id = name"))
        while not front.isEmpty():
            said = inside.join(front.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id"), "name").distinct()
            front = table(said.join(back.select("id"), "id", "left_anti"))
            back = back.unionByName(front)
        back = table(back)
        done.append(back)
        gone = back.select("id")
        edges = table(edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target"))
        size = edges.count()
    if size:
        done.append(in_one_task(edges.withColumn("w", F.lit(1.0)), _strong, "id string, name string"))
    if not done:
        return nodes.withColumn("component", F.col("id"))
    found = reduce(DataFrame.unionByName, done)
    return nodes.join(found, "id", "left").select("id", F.coalesce("name", "id").alias("component"))


def _ranks(source: np.ndarray, target: np.ndarray, w: np.ndarray, ids: list[str], n: int, damping: float, iterations: int, tolerance: float) -> tuple[list, np.ndarray]:
    """Ranks by rounds over arrays; the last one, under no id, is that of a node without edges, of which the rest of n are."""
    out = np.bincount(source, w, len(ids))
    share, ends = w / out[source], out == 0
    rank, lone = np.full(len(ids), 1.0 / n), 1.0 / n
    for _ in range(iterations):
        base = (1 - damping + damping * (rank[ends].sum() + (n - len(ids)) * lone)) / n
        new = base + damping * np.bincount(target, rank[source] * share, len(ids))
        moved = np.abs(new - rank).sum() + (n - len(ids)) * abs(base - lone)
        rank, lone = new, base
        if moved < tolerance:
            break
    return [*ids, None], np.append(rank, lone)


def _flows(share: DataFrame, n: int, damping: float, iterations: int) -> tuple[list[DataFrame] | None, list[float]]:
    """What an even start sends along ways of 1, 2, ... edges, as (id, flow) of the nodes that it reaches, and the sums from 0 on.

    Whoever a way of some length reaches is reached by a shorter one, so fewer and fewer nodes are left, until none is, or until
    a cycle keeps the same nodes for good: then there are no flows, and rounds have to tell.
    """
    flows, masses, left = [], [1.0], n
    for _ in range(iterations):
        last = share.select("target", (F.col("share") / n).alias("x")) if not flows else share.join(flows[-1].withColumnRenamed("id", "source"), "source").select("target", (F.col("share") * F.col("flow")).alias("x"))
        flow = table(last.groupBy(F.col("target").alias("id")).agg((damping * F.sum("x")).alias("flow")))
        size, mass = flow.agg(F.count("*"), F.sum("flow")).first()
        if not size:
            break
        if size == left:
            return None, []
        flows.append(flow)
        masses.append(mass)
        left = size
    return flows, masses


def _series(ids: DataFrame, flows: list[DataFrame], masses: list[float], n: int, damping: float, iterations: int) -> DataFrame:
    """The ranks after all rounds from the flows: a round adds the same base to all nodes, which flows on as the start does, so
    ranks are flows times the bases of the rounds before. What ends hold of a flow is what the next one lacks."""
    ahead = [*masses[1:], 0.0]
    held = [m - a / damping for m, a in zip(masses, ahead, strict=True)]
    bases: list[float] = []
    at = lambda k, x: (bases[k - 1 - x] if x < k else 1.0) if x <= k else 0.0
    for k in range(iterations):
        bases.append(1 - damping + damping * sum(at(k, x) * h for x, h in enumerate(held)))
    parts = [f.select("id", (F.col("flow") * at(iterations, x)).alias("flow")) for x, f in enumerate(flows, 1)]
    base = F.lit(at(iterations, 0) / n)
    if not parts:
        return ids.select("id", base.alias("rank"))
    total = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("flow").alias("flow"))
    return ids.join(total, "id", "left").select("id", (base + F.coalesce("flow", F.lit(0.0))).alias("rank"))


def pagerank(graph: Graph, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-13, local: int = LOCAL_EDGES) -> DataFrame:
    """(id, rank), which sum to 1: even teleport, and what nodes without edges hold is spread evenly. Parallel edges count.

    Rounds end after iterations, or when all ranks together move by less than tolerance, so that later ones would change
    no digit that matters. Each round writes its ranks; the edges lie in buckets by source and are not shuffled again.
    Without cycles there are only as many rounds as the longest way has edges, and the ranks follow from those.
    """
    ids = table(graph.nodes.select("id").distinct())
    n = max(ids.count(), 1)
    links = table(valid_edges(graph).groupBy("source", "target").agg(F.count("*").cast("double").alias("w")))
    if links.count() <= local:
        found = in_one_task(links, partial(_ranks, n=n, damping=damping, iterations=iterations, tolerance=tolerance), "id string, rank double")
        # Nodes without edges all have the rank of what only teleports, which the task returns under no id.
        found = table(found)
        lone = found.where("id is null").select(F.col("rank").alias("lone"))
        return ids.join(found, "id", "left").crossJoin(F.broadcast(lone)).select("id", F.coalesce("rank", "lone").alias("rank"))  # one row
    degree = links.groupBy("source").agg(F.sum("w").alias("d"))
    share = bucketed(links.join(degree, "source").select("source", "target", (F.col("w") / F.col("d")).alias("share")), "source")
    flows, masses = _flows(share, n, damping, iterations) if damping else (None, [])
    if flows is not None:
        return _series(ids, flows, masses, n, damping, iterations)
    ranks = table(ids.join(degree.select(F.col("source").alias("id"), F.lit(True).alias("goes")), "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.col("goes").isNull().alias("ends")))
    lost = ranks.agg(F.sum(F.when(F.col("ends"), F.col("rank")))).first()[0] or 0.0
    for _ in range(iterations):
        flow = share.join(ranks.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        rank = F.lit((1 - damping + damping * lost) / n) + damping * F.coalesce("flow", F.lit(0.0))
        ranks = table(ranks.join(flow, "id", "left").select("id", rank.alias("rank"), "ends", F.abs(rank - F.col("rank")).alias("by")))
        moved, lost = ranks.agg(F.sum("by"), F.sum(F.when(F.col("ends"), F.col("rank")))).first()
        lost = lost or 0.0
        if (moved or 0.0) < tolerance:
            break
    return ranks.select("id", "rank")


def summary(graph: Graph) -> DataFrame:
    """One row: graph_stats with the number of strongly connected components, and whether there is at most one."""
    n = strong_components(graph).agg(F.count_distinct("component").alias("components"))
    return graph_stats(graph).crossJoin(n).withColumn("is_connected", F.col("components") <= 1)


def ranked_metrics(graph: Graph, iterations: int = 100) -> DataFrame:
    """Degrees of every node over valid edges with its PageRank; a god node has more than 50, a leaf none out."""
    valid = Graph(graph.nodes, valid_edges(graph).select(graph.edges.columns), None, graph.project)
    return degree_in_out(valid).join(pagerank(graph, iterations=iterations), "id").select(
        "id", "in_degree", "out_degree", "total_degree", F.col("rank").alias("pagerank"), (F.col("total_degree") > 50).alias("is_god_node"), (F.col("out_degree") == 0).alias("is_leaf")
    )


def _neighbours(graph: Graph) -> DataFrame:
    """(id, other, w): weighted undirected adjacency both ways; a self-loop counts twice."""
    e = valid_edges(graph).select("source", "target", "weight")
    both = e.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), F.col("weight").alias("w")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"), F.col("weight").alias("w")))).alias("e")).select("e.*")
    return spread(both, "id", "other", like=graph.edges).groupBy("id", "other").agg(F.sum("w").alias("w"))


def _moves(near: DataFrame, strength: DataFrame, labels: DataFrame, whole: float, k: int, large: bool) -> DataFrame:
    """labels after round k, with whether each moved, as a table.

    In an odd round about half of the nodes may move, by a hash of id and round; in the even one after it the others. A node
    goes where modularity gains most, of equal labels to the least, and stays unless it gains. What is compared is the
    gain times whole² / 2, in whole numbers if weights are.
    """
    coin = F.conv(F.substring(F.md5(F.concat(F.col("id"), F.lit(f":{(k + 1) // 2}"))), 1, 1), 16, 10).cast("int") < 8
    may = coin if k % 2 else ~coin
    placed = labels.join(strength, "id")
    total = placed.groupBy("label").agg(F.sum("k").alias("total"))
    known = placed.join(total, "label").select("id", "label", "k", "total")
    known = table(known) if large else known
    ready = known.where(may).select("id", F.col("label").alias("own"), "k", F.col("total").alias("own_total"))
    # Neighbours bring the total of their label along, so that offers are shuffled once, by who gets them.
    to = near.where(may).join(known.select(F.col("id").alias("other"), "label", "total"), "other").select("id", "label", "w", "total")
    to = spread(to, "id", like=near).groupBy("id", "label").agg(F.sum("w").alias("w"), F.first("total").alias("total"))
    offers = to.join(ready, "id")
    gain = F.col("w") * whole - F.col("k") * (F.col("total") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0))
    best = offers.groupBy("id").agg(
        F.min(F.when(F.col("label") != F.col("own"), F.struct((-gain).alias("loss"), "label"))).alias("b"), F.max(F.when(F.col("label") == F.col("own"), gain)).alias("stay"), F.first("k").alias("k"), F.first("own_total").alias("own_total"))
    # Without a neighbour in its own community, to stay gains nothing but what its other members cost.
    stay = F.coalesce("stay", -F.col("k") * (F.col("own_total") - F.col("k")))
    go = best.where(F.col("b").isNotNull() & (-F.col("b.loss") > stay)).select("id", F.col("b.label").alias("new"))
    new = table(labels.join(go, "id", "left").select("id", F.coalesce("new", "label").alias("label"), F.col("new").isNotNull().alias("moved")))
    if large:
        discard(known, shuffles=True)
    return new


def local_moves(graph: Graph, rounds: int = 100) -> DataFrame:
    """(id, label) after rounds of local moves by modularity gain, or fewer if no node gains any more; at first its own id."""
    near = table(_neighbours(graph))
    labels = table(graph.nodes.select("id").distinct().withColumn("label", F.col("id")))
    return _settle(near, _strength(near, labels), labels, rounds, last=True)


def _strength(near: DataFrame, nodes: DataFrame) -> DataFrame:
    return table(nodes.select("id").join(near.groupBy("id").agg(F.sum("w").alias("k")), "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k")))


#: Adjacencies that a bucket holds.
BUCKET_ROWS = 1_000_000


def _settle(near: DataFrame, strength: DataFrame, labels: DataFrame, rounds: int, last: bool = False) -> DataFrame:
    """labels after the rounds. With last, near goes once it lies in buckets; each round's labels go after the next."""
    whole = strength.agg(F.sum("k")).first()[0] or 0.0
    size = near.count()
    buckets = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_ROWS))
    apart = bucketed(near.where("id <> other"), "other", buckets)
    if last:
        discard(near)
    quiet, old = 0, None
    for k in range(1, rounds + 1):
        new = _moves(apart, strength, labels, whole, k, size > BUCKET_ROWS)
        quiet = quiet + 1 if new.where("moved").isEmpty() else 0
        labels = new.select("id", "label")
        if old is not None:
            discard(old)
        old = new
        if quiet == 2 and k % 2 == 0:  # neither half has moved
            break
    return labels


def number(df: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a column with whole numbers from 0 in their order, without a global window."""
    ranged = table(df.select(column).distinct().repartitionByRange(column).withColumn("__part", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in ranged.groupBy("__part").count().collect()}  # a row for each partition
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    s = df.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __start bigint")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return ranged.join(F.broadcast(s), "__part").select(column, (within + F.col("__start")).cast("bigint").alias(name))


def _levels(source: np.ndarray, target: np.ndarray, w: np.ndarray, ids: list[str], rounds: int) -> tuple[list, list]:
    """What communities does, over arrays: for each id the label that it ends in."""
    member = np.arange(len(ids))  # of each id, by place: its node at this level
    names = np.array(ids, object)
    while True:
        n = len(names)
        strength = np.bincount(source, w, n)
        whole, label = strength.sum(), np.arange(n)
        inner = source != target
        s, t, x = source[inner], target[inner], w[inner]
        quiet = 0
        for k in range(1, rounds + 1):
            turn = (k + 1) // 2
            if k % 2:
                coin = np.array([int(hashlib.md5(f"{i}:{turn}".encode()).hexdigest()[0], 16) < 8 for i in names], bool)
            may = coin if k % 2 else ~coin
            total = np.bincount(label, strength, n)
            use = may[s]
            cell, where = np.unique(s[use] * n + label[t[use]], return_inverse=True)
            weight = np.bincount(where, x[use], len(cell))
            node, to = cell // n, cell % n
            own = to == label[node]
            gain = weight * whole - strength[node] * (total[to] - np.where(own, strength[node], 0))
            stay = -strength * (total[label] - strength)
            stay[node[own]] = gain[own]
            node, to, gain = node[~own], to[~own], gain[~own]
            order = np.lexsort((to, -gain, node))  # places are in the order of labels
            first = np.append(True, node[order][1:] != node[order][:-1]) if len(order) else np.zeros(0, bool)
            best = order[first]
            best = best[gain[best] > stay[node[best]]]
            label[node[best]] = to[best]
            quiet = 0 if len(best) else quiet + 1
            if quiet == 2 and k % 2 == 0:
                break
        kept, place = np.unique(label, return_inverse=True)
        if len(kept) == n:
            return ids, names[member].tolist()
        member = place[member]
        names = names[kept]
        cell, where = np.unique(place[source] * len(kept) + place[target], return_inverse=True)
        source, target, w = cell // len(kept), cell % len(kept), np.bincount(where, w, len(cell))


def communities(graph: Graph, rounds: int = 100, local: int = LOCAL_EDGES) -> DataFrame:
    """membership (node_id, community_id) by local moves in levels: when no node gains any more, each community becomes a
    node and the moves begin again, until nothing joins. At most rounds at each level. Without edges all are community 0.

    The same graph has the same communities on every run, and however much of it one task finishes.
    """
    if valid_edges(graph).isEmpty():
        return graph.nodes.select(F.col("id").alias("node_id"), F.lit(0).cast("bigint").alias("community_id")).distinct()
    near = table(_neighbours(graph))
    members = table(graph.nodes.select("id").distinct().withColumn("label", F.col("id")))
    strength, size, links = _strength(near, members), members.count(), near.count()
    while links > 2 * local:
        labels = table(_settle(near, strength, strength.select("id", F.col("id").alias("label")), rounds))
        left = labels.select("label").distinct().count()
        if left == size:
            break
        members = table(members.withColumnRenamed("label", "at").join(labels.select(F.col("id").alias("at"), "label"), "at").select("id", "label"))
        a, b = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in ("id", "other"))
        near = table(near.join(a, "id").join(b, "other").groupBy(F.col("l_id").alias("id"), F.col("l_other").alias("other")).agg(F.sum("w").alias("w")))
        strength = table(strength.join(labels, "id").groupBy(F.col("label").alias("id")).agg(F.sum("k").alias("k")))
        size, links = left, near.count()
    else:
        found = in_one_task(near.select(F.col("id").alias("source"), F.col("other").alias("target"), "w"), partial(_levels, rounds=rounds), "label string, last string")
        members = table(members.join(table(found), "label", "left").select("id", F.coalesce("last", "label").alias("label")))
    return members.join(number(members, "label", "community_id"), "label").select(F.col("id").alias("node_id"), "community_id")


def modularity(graph: Graph, members: DataFrame) -> DataFrame:
    """(community_id, modularity) = e - a², with e the share of weight inside twice over, and a that of the ends in it."""
    # One pass: of every node the communities that it is in, looked up for either end, tell valid edges as well.
    near = lambda df, c: spread(df, c, like=graph.edges)
    of = near(members, "node_id").groupBy(F.col("node_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("community_id"))).alias("of"))
    ids = near(graph.nodes.select("id"), "id").distinct().join(of, "id", "left")
    e = near(graph.edges.select("source", "target", "weight"), "source").join(ids.select(F.col("id").alias("source"), F.col("of").alias("s")), "source").select("target", "s", "weight")
    e = near(e, "target").join(ids.select(F.col("id").alias("target"), F.col("of").alias("t")), "target")
    pairs = table(e.groupBy("s", "t").agg(F.sum("weight").alias("weight")))
    m = pairs.agg(F.sum("weight").alias("m"))
    both = pairs.select("weight", "t", F.explode("s").alias("sc")).select("weight", F.col("sc.community_id").alias("sc"), F.explode("t").alias("tc")).select("weight", "sc", F.col("tc.community_id").alias("tc"))
    inside = F.when(F.col("sc") == F.col("tc"), F.col("weight")).otherwise(0.0)
    ends = both.select(F.explode(F.array(F.struct(F.col("sc").alias("c"), F.col("weight").alias("w"), inside.alias("i")), F.struct(F.col("tc").alias("c"), F.col("weight").alias("w"), inside.alias("i")))).alias("x")).select("x.*")
    sums = ends.groupBy("c").agg(F.sum("w").alias("w"), F.sum("i").alias("i"))
    every = members.select("community_id").distinct().join(sums, F.col("community_id") == F.col("c"), "left").crossJoin(F.broadcast(m))  # m is one row
    twice = 2 * F.col("m")
    q = F.when(F.col("m") > 0, F.coalesce("i", F.lit(0.0)) / twice - F.pow(F.coalesce("w", F.lit(0.0)) / twice, 2)).otherwise(0.0)
    return every.select("community_id", F.round(q, 6).alias("modularity"))


def community_hubs(graph: Graph, members: DataFrame, k: int = 3) -> DataFrame:
    """(community_id, rank, node_id, degree): the k members of most edges, by degree, then id."""
    ends = degree(graph.edges).select(F.col("id").alias("node_id"), F.col("degree").alias("d"))
    d = members.join(ends, "node_id", "left").select("community_id", "node_id", F.coalesce("d", F.lit(0)).alias("degree"))
    rank = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("degree"), "node_id"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select("community_id", F.col("rank").cast("bigint").alias("rank"), "node_id", "degree")


def community_labels(graph: Graph, members: DataFrame) -> DataFrame:
    """(community_id, size, label): its commonest type, of equal ones the first by name, and its size."""
    types = members.join(graph.nodes.select(F.col("id").alias("node_id"), "type"), "node_id", "left")
    counts = types.groupBy("community_id", "type").agg(F.count("*").alias("n"))
    best = counts.groupBy("community_id").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), F.coalesce("type", F.lit("unknown")).alias("type"))).alias("b"))
    return best.select("community_id", "size", F.format_string("%s (%d elements)", "b.type", "size").alias("label"))


def surprising(graph: Graph, members: DataFrame) -> DataFrame:
    """Edges between communities that are not EXTRACTED, with a text that names the two."""
    a = members.select(F.col("node_id").alias("source"), F.col("community_id").alias("sc"))
    b = members.select(F.col("node_id").alias("target"), F.col("community_id").alias("tc"))
    e = graph.edges.where("confidence <> 'EXTRACTED'").select("source", "target", "relation", "confidence")
    text = F.format_string("Community %d ↔ Community %d", "sc", "tc")
    return e.join(a, "source").join(b, "target").where("sc <> tc").select("source", "target", "relation", "confidence", text.alias("reason"))

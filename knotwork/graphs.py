"""Property graphs projected from relational tables."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .model import Graph, as_edges, as_nodes
from .storage import spread


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


_NODES = (
    # table, key, label, type, language
    ("region", "r_regionkey", "r_name", "module", "Rust"),
    ("nation", "n_nationkey", "n_name", "module", "Rust"),
    ("supplier", "s_suppkey", "s_name", "class", "Python"),
    ("customer", "c_custkey", "c_name", "class", "Python"),
    ("part", "p_partkey", "p_name", "interface", "Go"),
    ("orders", "o_orderkey", None, "function", "Python"),
)


def star(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions contain nations, nations suppliers and customers; customers call orders, orders depend on parts, parts refer
    to suppliers."""
    nodes = []
    for rank, (name, key, label, type_, language) in enumerate(_NODES):
        nodes.append(
            _read(spark, sf_dir, name).select(
                _id(f"{name[0]}_", key).alias("id"), (F.col(label) if label else F.concat(F.lit("Order#"), F.col(key).cast("string"))).alias("label"),
                F.lit(type_).alias("type"), F.lit(f"{name}.tbl").alias("source_file"), F.lit(language).alias("language"),
                (F.lit(rank * 10**12) + F.col(key)).alias("ord"),
            )
        )
    nation, supplier, customer, orders = (_read(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "orders"))
    lines = _read(spark, sf_dir, "lineitem")

    def edge(df: DataFrame, rank: int, a: tuple[str, str], b: tuple[str, str], relation: str, confidence: Column) -> DataFrame:
        order = (F.lit(rank).cast("decimal(2,0)") * F.lit(Decimal(10**34)) + F.col(a[1]).cast("decimal(17,0)") * F.lit(Decimal(10**17)) + F.col(b[1])).cast("decimal(38,0)")
        return df.select(_id(*a).alias("source"), _id(*b).alias("target"), F.lit(relation).alias("relation"), confidence.alias("confidence"), order.alias("ord"))

    sure = F.lit("EXTRACTED")
    # The least flag, as its place among A and N: a whole number is grouped by hash, a text by sorting all lines.
    given, flag = F.col("l_returnflag"), F.col("flag")
    place = F.when(given < "A", 0).when(given == "A", 1).when(given < "N", 2).when(given == "N", 3).when(given > "N", 4)
    needs = spread(lines.select("l_orderkey", "l_partkey", place.alias("place")), "l_orderkey", like=lines).groupBy("l_orderkey", "l_partkey").agg(F.min("place").alias("flag"))
    level = F.when(flag == 3, "EXTRACTED").when(flag == 1, "INFERRED").otherwise("AMBIGUOUS")
    pairs = spread(lines.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", like=lines).distinct()
    edges = [
        edge(nation, 0, ("r_", "n_regionkey"), ("n_", "n_nationkey"), "contains", sure),
        edge(supplier, 1, ("n_", "s_nationkey"), ("s_", "s_suppkey"), "contains", sure),
        edge(customer, 2, ("n_", "c_nationkey"), ("c_", "c_custkey"), "contains", sure),
        edge(orders, 3, ("c_", "o_custkey"), ("o_", "o_orderkey"), "calls", sure),
        edge(needs, 4, ("o_", "l_orderkey"), ("p_", "l_partkey"), "depends_on", level),
        edge(pairs, 5, ("p_", "l_partkey"), ("s_", "l_suppkey"), "references", F.lit("INFERRED")),
    ]
    return Graph(as_nodes(reduce(DataFrame.unionByName, nodes)), as_edges(reduce(DataFrame.unionByName, edges)))


def event(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types, with an edge for each pair of types that follow one another for a user; weight counts them."""
    events = _read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    nodes = events.select(F.col("event_type").alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit("function").alias("type"))
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(F.col("event_type").alias("source"), after.alias("target")).where("target is not null")
    return Graph(as_nodes(nodes), as_edges(pairs.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight")).withColumn("relation", F.lit("calls"))))


HREF = r'href="([^"]*)"'


def web(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages and what they link to. Links are as often as pages have them, in the order of pages and places."""
    pages = _read(spark, sf_dir, "pages")
    nodes = pages.select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("label"), F.lit("document").alias("type"), F.col("url").alias("source_file"), F.col("page_id").alias("ord"))
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("at", "href"))
    edges = links.select(
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("source"), F.col("href").alias("target"), F.lit("references").alias("relation"),
        F.lit("INFERRED").alias("confidence"), F.lit(0.5).alias("weight"), F.col("page_id").cast("string").alias("source_file"), (F.col("page_id").cast("decimal(19,0)") * F.lit(Decimal(10**10)) + F.col("at")).alias("ord"),
    )
    return Graph(as_nodes(nodes), as_edges(edges))


def conversation(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations, each followed by the next: long thin chains."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    name = F.concat(F.lit("t_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    chain = turns.select("conv_id", name.alias("source"), after.alias("next")).where("next is not null")
    chain = chain.select("source", F.concat(F.lit("t_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("next").cast("string")).alias("target"), F.lit("calls").alias("relation"))
    return Graph(as_nodes(turns.select(name.alias("id"), F.col("role").alias("label"), F.lit("function").alias("type"))), as_edges(chain))

"""Resolution of imports across files: targets that name a symbol or a file become edges to its node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import last_segment, normalize_symbol
from ..model import Graph, as_edges, is_code
from .build import IMPORTS


def symbol_table(nodes: DataFrame) -> DataFrame:
    """(symbol, node_id, file): every name that a code node goes by: its label, what follows the last . or :: in it, and
    those normalised. Each name of a node once."""
    names = F.array("label", last_segment(F.col("label"), r"."), F.regexp_replace("label", r"^.*::", ""))
    both = F.array_distinct(F.concat(names, F.transform(names, normalize_symbol)))
    code = nodes.where(is_code(F.col("type")) & F.col("label").isNotNull())
    return code.select(F.explode(both).alias("symbol"), F.col("id").alias("node_id"), F.col("source_file").alias("file")).where("symbol <> ''").distinct()


def file_table(nodes: DataFrame) -> DataFrame:
    """(path, node_id): the first node of each source file."""
    first = F.row_number().over(Window.partitionBy("source_file").orderBy("ord", "id"))
    return nodes.where("source_file is not null").withColumn("rn", first).where("rn = 1").select(F.col("source_file").alias("path"), F.col("id").alias("node_id"))


def candidates(graph: Graph) -> DataFrame:
    """(source, target, weight, context) of what each import may mean, by symbol and by file; not deduplicated.

    By symbol, a target in the importer's own file is left out, as is the importer itself. By file, the lower-cased target
    is looked up among paths as they are.
    """
    imports = graph.edges.where(F.col("relation").isin(*IMPORTS)).select("source", "target")
    own = graph.nodes.groupBy("id").agg(F.min("source_file").alias("own_file")).withColumnRenamed("id", "source")
    imports = imports.join(own, "source", "left").withColumn("name", normalize_symbol(F.col("target")))
    symbols = symbol_table(graph.nodes)
    by_symbol = imports.join(symbols, F.col("name") == F.col("symbol")).where(
        (F.col("node_id") != F.col("source")) & (F.col("file").isNull() | F.col("own_file").isNull() | (F.col("file") != F.col("own_file")))
    )
    by_symbol = by_symbol.select("source", F.col("node_id").alias("target"), F.lit(0.6).alias("weight"), F.lit("cross_file_resolved").alias("context"))
    files = imports.join(file_table(graph.nodes), F.col("name") == F.col("path")).where(F.col("node_id") != F.col("source"))
    return by_symbol.unionByName(files.select("source", F.col("node_id").alias("target"), F.lit(0.5).alias("weight"), F.lit("cross_file_file").alias("context")))


def resolve(graph: Graph) -> DataFrame:
    """The new edges: candidates whose source and target no edge joins yet."""
    new = candidates(graph).join(graph.edges.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return as_edges(new.select("source", "target", "weight", "context", F.lit("references").alias("relation"), F.lit("INFERRED").alias("confidence")))

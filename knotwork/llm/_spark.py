"""Materialisation, size-checked joins and sampling shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import ship
from knotwork.storage import shared_dir, table

__all__ = ["hash_order", "keep_ids", "narrow_ids", "share", "shared_dir", "table"]

#: At most so many keys of 8 bytes are broadcast; beyond that the join shuffles. About 50 MB as a hashed relation.
BROADCAST_KEYS = 1_000_000


def narrow_ids(df: DataFrame, key: str, limit: int = BROADCAST_KEYS) -> tuple[DataFrame, bool]:
    """df's key column, and whether it is few enough to broadcast. df should be a written table: it is counted."""
    few = df.select(key).limit(limit + 1).count() <= limit
    ids = df.select(F.col(key).alias("__kw_id"))
    return (F.broadcast(ids) if few else ids), few


def keep_ids(docs: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", doc_key: str = "doc_id") -> DataFrame:
    """docs with (left_semi) or without (left_anti) the ids; docs' own columns are untouched, whatever their names."""
    narrow, _ = narrow_ids(ids, key)
    left = docs.alias("__kw_docs")
    return left.join(narrow, F.col(f"__kw_docs.{doc_key}") == F.col("__kw_id"), how)


def share(spark: SparkSession, value: object) -> Broadcast:
    """value, sent once to each executor that needs it, with the package that defines its class."""
    ship(spark)
    return spark.sparkContext.broadcast(value)


def hash_order(column: str, seed: int = 0) -> Column:
    """A text that orders rows at random but always alike; DuckDB's md5 gives the same."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}")))

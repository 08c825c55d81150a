"""What changed since the last build: content hashes, the manifest of extracted files, upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, hash string, language string, cached_result string"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The manifest at path; empty where there is none."""
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def save(manifest: DataFrame, path: str) -> None:
    """Writes a manifest. It must not be one that is read from the same path: write next to it and switch."""
    manifest.write.mode("overwrite").parquet(path)


def status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, hash, status): unchanged if path and hash are known with a result, otherwise changed or new; deleted if only
    the manifest has it."""
    now = files.select("path", content_hash(F.col("content")).alias("hash"))
    old = manifest.select("path", F.col("hash").alias("old"), F.col("cached_result").isNotNull().alias("cached"), F.lit(True).alias("known"))
    both = now.join(old, "path", "full_outer")
    word = F.when(F.col("hash").isNull(), "deleted").when(F.col("known").isNull(), "new").when((F.col("hash") == F.col("old")) & F.col("cached"), "unchanged").otherwise("changed")
    return both.select("path", F.coalesce("hash", "old").alias("hash"), word.alias("status"))


def upsert(manifest: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The manifest with changed in place of what it had of the same paths, and without the deleted paths."""
    kept = manifest.join(changed.select("path").distinct(), "path", "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select("path").distinct(), "path", "left_anti")
        changed = changed.join(deleted.select("path").distinct(), "path", "left_anti")
    return kept.select(manifest.columns).unionByName(changed.select(manifest.columns))

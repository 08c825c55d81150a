"""Written intermediate tables: computed once, without lineage, safe when executors go."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees.

    Where it is unset, a local session gets a temporary folder that goes with the process; a cluster gets an error,
    because a machine-local folder would not survive there.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="knotwork-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str = "") -> str:
    """A path for a table of this application, in the shared folder."""
    sc = spark.sparkContext
    if not getattr(sc, "_knotwork_tables", False):
        sc._knotwork_tables = True
        atexit.register(clean, spark)
    return f"{shared_dir(spark)}/knotwork/{sc.applicationId}/{name}{uuid.uuid4().hex}"


def table(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again. The table stays until clean() or the end of the application."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._knotwork_path = path
    return made


def discard(*tables: DataFrame, shuffles: bool = False) -> None:
    """Deletes tables of table() that nothing reads any more; with shuffles, Spark also deletes the shuffles that nobody holds,
    which takes collections of garbage."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._knotwork_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles:
        gc.collect()  # plans that Python still holds keep their shuffles
        tables[0].sparkSession.sparkContext._jvm.System.gc()


#: What spread() gives one task, by Spark's estimate, which is of bytes in files and of all columns: some quarter of a million edges.
#: A greater estimate than the other is none.
TASK_BYTES, KNOWN_BYTES = 8 << 20, 1 << 44


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """df by keys in as many tasks as its size, or that of like, asks for, before it is grouped or joined by them.

    What a task groups or sorts doesn't grow with the input, whatever spark.sql.shuffle.partitions is, and scans, whose splits
    do grow, group nothing.
    """
    size = int(str((df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > KNOWN_BYTES:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), *keys)


def bucketed(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """df as a table in buckets by a column, so that joins and groupings by it don't shuffle it again."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"knotwork_{uuid.uuid4().hex}"
    df.repartition(n, column).write.format("parquet").bucketBy(n, column).sortBy(column).option("path", new_path(spark)).saveAsTable(name)
    spark.sparkContext._knotwork_names = [*getattr(spark.sparkContext, "_knotwork_names", []), name]
    return spark.table(name)


def clean(spark: SparkSession) -> None:
    """Deletes the tables of this application; results that were not written elsewhere go with them."""
    sc = spark.sparkContext
    if sc._jsc is None:  # stopped
        return
    for name in getattr(sc, "_knotwork_names", []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    sc._knotwork_names = []
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/knotwork/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

"""Keeping a graph up to date with a stream of changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.text import extension
from ..model import EDGE_SCHEMA, NODE_SCHEMA, Graph, as_edges, as_nodes
from ..operators import build, extract, incremental
from ..sources import files
from ..storage import table

CHANGES = "path string, content string, deleted boolean, ts timestamp"
WATCHED = (
    "rs py pyi js jsx ts tsx go java kt kts swift rb php c h cpp cc hpp cs scala lua dart zig ex exs erl hs ml vue svelte astro sql tf sh bash ps1 jl r md toml json".split()
)


def is_watchable(path: Column) -> Column:
    return extension(path).isin(*WATCHED)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of changes (path, content, deleted, ts) that arrive as JSON files in a folder."""
    return spark.readStream.schema(CHANGES).json(folder)


class Store:
    """A graph kept by file, as a log of batches below path.

    A batch appends what it changes and no more: the files that it touched (path, hash, gone), and the nodes and edges of those that
    are still there. The last batch that touched a file holds what counts of it. When COMPACT batches have gathered, what
    counts is written as one and the older ones are deleted, so a file is rewritten once in that many batches. A batch counts
    once its done-mark is there: one that dies and runs again leaves no half.
    """

    COMPACT = 32
    TOUCHED = "path string, hash string, gone boolean, batch bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _path(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self) -> dict[int, str]:
        """The batches that count, oldest first, each with its folder: b-, or c- where it stands for all before it as well."""
        p, fs = self._path()
        if not fs.exists(p):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        every = sorted(int(n.removeprefix("done-")) for n in names if n.startswith("done-"))
        whole = max((int(n.removeprefix("whole-")) for n in names if n.startswith("whole-")), default=-1)
        return {b: f"{'c' if b == whole else 'b'}-{b}" for b in every if b >= whole}

    def version(self) -> int:
        return max(self.folders(), default=-1)

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{f}/{name}" for f in self.folders().values()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _last(self) -> DataFrame:
        """(path, hash, gone, batch): of each file what the last batch that touched it found."""
        return self._read("touched", self.TOUCHED).groupBy("path").agg(F.max_by(F.struct("hash", "gone", "batch"), "batch").alias("x")).select("path", "x.*")

    def _kept(self, name: str, schema: str) -> DataFrame:
        """The nodes or edges that count, with batch."""
        alive = self._last().where("not gone").select(F.col("path").alias("source_file"), "batch")
        return self._read(name, schema + ", batch bigint").join(alive, ["source_file", "batch"], "left_semi")

    def parts(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as extracted, of all files that are there."""
        return as_nodes(self._kept("nodes", NODE_SCHEMA)), as_edges(self._kept("edges", EDGE_SCHEMA))

    def graph(self) -> Graph:
        """The graph that a build of all files that are there makes."""
        return build.build_graph(*self.parts())

    def manifest(self) -> DataFrame:
        known = F.lit(None).cast("string").alias("language")
        return self._last().where("not gone").select("path", "hash", known, F.lit("tables").alias("cached_result"))

    def _mark(self, name: str) -> None:
        p, fs = self._path(name)
        fs.create(p, True).close()

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Applies a batch of changes: the last one of each path counts; only what really changed is extracted."""
        done = self.folders()
        if batch <= max(done, default=-1):
            return
        rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc_nulls_last("ts"), F.desc("deleted"), F.desc("content")))
        last = changes.where(is_watchable(F.col("path"))).withColumn("rank", rank).where("rank = 1")
        last = last.select("path", F.coalesce("deleted", F.lit(False)).alias("gone"), "content", F.when(~F.coalesce("deleted", F.lit(False)), incremental.content_hash(F.coalesce("content", F.lit("")))).alias("hash"))
        old = self._last().select("path", F.col("hash").alias("was"), F.col("gone").alias("was_gone"))
        both = last.join(old, "path", "left")
        new = both.where(F.when(F.col("gone"), F.coalesce(~F.col("was_gone"), F.lit(False))).otherwise(F.col("was").isNull() | F.col("was_gone") | (F.col("was") != F.col("hash"))))
        # Written first: the stream's batch is read once, whatever is made of it.
        new = table(new.select("path", "gone", "content", "hash"))
        to, mark = f"{self.path}/b-{batch}", F.lit(batch).cast("bigint").alias("batch")
        nodes, edges = extract.extract(new.where("not gone").select("path", "content"))
        as_nodes(nodes).withColumn("batch", mark).write.mode("overwrite").parquet(f"{to}/nodes")
        as_edges(edges).withColumn("batch", mark).write.mode("overwrite").parquet(f"{to}/edges")
        new.select("path", "hash", "gone", mark).write.mode("overwrite").parquet(f"{to}/touched")
        self._mark(f"done-{batch}")
        if len(done) + 1 >= self.COMPACT:
            self.compact()

    def compact(self) -> None:
        """Writes what counts in a folder of its own, marks it, and only then deletes the batches that it stands for. Whoever
        still reads those must have finished."""
        done = self.folders()
        if len(done) < 2:
            return
        last = max(done)
        to, mark = f"{self.path}/c-{last}", F.lit(last).cast("bigint")
        self._kept("nodes", NODE_SCHEMA).withColumn("batch", mark).write.mode("overwrite").parquet(f"{to}/nodes")
        self._kept("edges", EDGE_SCHEMA).withColumn("batch", mark).write.mode("overwrite").parquet(f"{to}/edges")
        self._last().where("not gone").withColumn("batch", mark).write.mode("overwrite").parquet(f"{to}/touched")
        self._mark(f"whole-{last}")
        for b, folder in done.items():
            for name in (folder, *(() if b == last else (f"done-{b}", f"whole-{b}"))):
                p, fs = self._path(name)
                fs.delete(p, True)


def keep_up(changes: DataFrame, store: Store, checkpoint: str, every: str | None = "500 milliseconds") -> StreamingQuery:
    """Applies a stream of changes to the store, a batch every so often; with None, once over what is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store.apply).trigger(**trigger).start()


def look(store: Store, root: str, max_mb: int = files.MAX_MB) -> bool:
    """Compares a folder of source files with the store and applies what changed; whether anything did.

    The files of the store that the folder no longer has are deleted. Called again and again, it watches the folder.
    """
    spark = store.spark
    there = files.read(spark, root, max_mb, ("Code", "Config", "Document", "Manifest")).where(is_watchable(F.col("path"))).select("path", "content")
    there = table(there)
    gone = store.manifest().select("path").join(there.select("path"), "path", "left_anti")
    now = F.current_timestamp().alias("ts")
    changes = there.select("path", "content", F.lit(False).alias("deleted"), now).unionByName(gone.select("path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("deleted"), now))
    status = incremental.status(there, store.manifest()).where("status <> 'unchanged'")
    if status.isEmpty():
        return False
    store.apply(changes, store.version() + 1)
    return True


def events_tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in windows of equal width, for streams and tables alike. An addition of this library."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def events_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's sessions: events with no gap of so long between them. An addition of this library."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")

"""Mixing sources to target weights by Pareto order sampling.

A source's share of the result is spread over its documents in proportion to their sizes. The whole part of a document's
expected copies is certain; for the rest, documents are ranked by their random odds divided by the odds of inclusion, and
as many of the first are taken as there are places, so the size of every source's sample is fixed. All arithmetic up to the
odds is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import BROADCAST_KEYS, table

#: Without weights, a source of n documents weighs n to this power: small sources are raised, large ones lowered.
TEMPERATURE = 0.7
CELLS = 4096
SEED = 3
_HEX = 13  # digits of the hash in a random number: 52 bits


def _units(docs: DataFrame, seed: int) -> DataFrame:
    """docs with source, size and the whole numbers of the random odds, under private names."""
    bits = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("bigint").cast("string"), F.lit(f":{seed}"))), 1, _HEX), 16, 10).cast("bigint")
    chars = F.coalesce(F.length("text"), F.lit(0))
    return docs.where("doc_id is not null").withColumns(
        {"__kw_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "__kw_size": F.when(chars > 0, F.length(F.bin(chars.cast("bigint")))).otherwise(0).cast("bigint"), "__kw_odd": 2 * bits + 1}
    )


def _odds(rest: Column, whole: Column, odd: Column) -> Column:
    """Random odds over odds of inclusion: three divisions, alike in every engine."""
    return (odd.cast("double") / (F.lit(2**53) - odd).cast("double")) / (rest.cast("double") / (whole - rest).cast("double"))


def _targets(units: DataFrame, weights: Mapping[str, float] | None, total: int | None) -> DataFrame:
    """A row for each source: its documents' total size and its target, by largest remainders."""
    s = units.groupBy("__kw_source").agg(F.sum("__kw_size").alias("whole"), F.sum((F.col("__kw_size") > 0).cast("bigint")).alias("n")).where("whole > 0")
    if weights is None:
        s = s.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = units.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()] or [("", 0.0)], "ws string, w double")
        s = s.join(given, F.col("__kw_source") == F.col("ws")).where("w > 0").drop("ws")
    every = Window.partitionBy()  # one row for each source
    size = F.sum("n").over(every) if total is None else F.lit(int(total))
    s = s.withColumn("size", size.cast("bigint")).withColumn("quota", F.col("size") * F.col("w") / F.sum("w").over(every))
    s = s.withColumn("low", F.floor("quota").cast("bigint"))
    left = F.col("size") - F.sum("low").over(every)
    rank = F.row_number().over(Window.orderBy((F.col("quota") - F.col("low")).desc(), "__kw_source"))
    return s.withColumn("target", F.col("low") + (rank <= left).cast("bigint")).select(F.col("__kw_source").alias("__kw_s"), F.col("whole").alias("__kw_whole"), F.col("target").alias("__kw_target"))


def _copies(docs: DataFrame, weights: Mapping[str, float] | None, total: int | None, seed: int) -> DataFrame:
    """docs with __kw_copies. Two passes over a few columns find each source's threshold; a third applies it in place."""
    units = _units(docs, seed)
    narrow = units.select("__kw_source", "__kw_size", "__kw_odd", F.col("doc_id").cast("bigint").alias("id"))
    targets = table(_targets(narrow, weights, total))
    few = targets.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS

    def shares(df: DataFrame, of: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(of) if few else of, F.col("__kw_source") == F.col("__kw_s"))
        df = df.withColumn("__kw_rest", F.pmod(F.col("__kw_target") * F.col("__kw_size"), F.col("__kw_whole")))
        df = df.withColumn("__kw_sure", F.expr("(__kw_target * __kw_size - __kw_rest) div __kw_whole"))
        q = F.when(F.col("__kw_rest") > 0, _odds(F.col("__kw_rest"), F.col("__kw_whole"), F.col("__kw_odd")))
        return df.withColumn("__kw_q", q)

    ranked = shares(narrow, targets).select(F.col("__kw_s").alias("s"), F.col("__kw_whole").alias("whole"), "id", F.col("__kw_size").alias("size"), "__kw_rest", F.col("__kw_q").alias("q"))
    ranked = ranked.withColumn("cell", F.least(F.floor(CELLS * (F.col("q") / (1 + F.col("q")))), F.lit(CELLS - 1)))
    # Places left = the remainders' sum over whole. Cells of the order narrow the search to one cell of each source.
    cells = ranked.groupBy("s", "whole", "cell").agg(F.sum("__kw_rest").alias("rest"), F.count("q").alias("n"))
    by_source = Window.partitionBy("s")
    cells = cells.withColumn("places", F.round(F.sum("rest").over(by_source) / F.col("whole")).cast("bigint"))
    before = F.coalesce(F.sum("n").over(by_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = table(cells.where("cell is not null").withColumn("before", before).where("before < places and before + n >= places").select(F.col("s").alias("cs"), F.col("cell").alias("cc"), (F.col("places") - F.col("before")).alias("take")))
    last = ranked.join(F.broadcast(cells) if few else cells, (F.col("s") == F.col("cs")) & (F.col("cell") == F.col("cc")))
    # Rows that tie in all of this are one row with their number, so a doc_id that repeats doesn't make a long window.
    last = last.groupBy("s", "q", "id", "size", "take").agg(F.count("*").alias("m"))
    last = last.withColumn("upto", F.sum("m").over(by_source.orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0))).where("upto >= take and upto - m < take")
    last = last.select(F.col("s").alias("__kw_ls"), F.col("q").alias("__kw_last_q"), F.col("id").alias("__kw_last_id"), F.col("size").alias("__kw_last_size"), F.col("m").alias("__kw_m"), (F.col("take") - F.col("upto") + F.col("m")).alias("__kw_r"))
    limits = table(targets.join(last, F.col("__kw_s") == F.col("__kw_ls"), "left").drop("__kw_ls"))
    done = shares(units, limits)
    here, there = (F.struct(q.alias("q"), i.alias("id"), z.alias("size")) for q, i, z in (
        (F.col("__kw_q"), F.col("doc_id").cast("bigint"), F.col("__kw_size")), (F.col("__kw_last_q"), F.col("__kw_last_id"), F.col("__kw_last_size"))))
    placed = F.col("__kw_q").isNotNull() & F.col("__kw_last_q").isNotNull()
    tie = placed & (here == there) & (F.col("__kw_r") < F.col("__kw_m"))
    whole = done.where(~tie).withColumn("__kw_copies", F.col("__kw_sure") + (placed & (here <= there)).cast("bigint"))
    if limits.where("__kw_r < __kw_m").isEmpty():
        return whole.where("__kw_copies > 0")
    # Of rows that tie at the last place, as many as there are places left: by their order in a written table.
    tied = table(done.where(tie)).withColumns({"__kw_file": F.input_file_name(), "__kw_at": F.monotonically_increasing_id()})
    tied = tied.withColumn("__kw_rn", F.row_number().over(Window.partitionBy("__kw_s", "__kw_file").orderBy("__kw_at")))
    files = tied.groupBy(F.col("__kw_s").alias("fs"), F.col("__kw_file").alias("ff")).agg(F.count("*").alias("fn"))
    files = files.withColumn("__kw_start", F.coalesce(F.sum("fn").over(Window.partitionBy("fs").orderBy("ff").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("fn")
    tied = tied.join(files, (F.col("__kw_s") == F.col("fs")) & (F.col("__kw_file") == F.col("ff")))
    tied = tied.withColumn("__kw_copies", F.col("__kw_sure") + (F.col("__kw_rn") + F.col("__kw_start") <= F.col("__kw_r")).cast("bigint"))
    return whole.unionByName(tied.select(whole.columns)).where("__kw_copies > 0")


def sample(docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copies) of the documents chosen, copies being 1 or more.

    weights maps sources to target weights; a source that it lacks gets nothing. Without it, TEMPERATURE applies. total is
    the number of documents in the result, copies included; by default as many as there are with text. A document's size
    is the number of binary digits of its length, so long texts are likelier, moderately. Null and empty texts have size 0
    and are never chosen; rows without doc_id neither. A null source is the source of empty name. Rows that repeat a
    doc_id share its random number: they are separate documents. Of those that tie at the last place in size too, as many
    are taken as there are places, so the size of the result is fixed whatever repeats.
    """
    return _copies(docs.select("doc_id", "text", "source"), weights, total, seed).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("__kw_source").alias("source"), F.col("__kw_copies").alias("copies"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """docs as sample() chooses, each row as often as it has copies; columns as they are, and texts are not shuffled."""
    chosen = _copies(docs, weights, total, seed)
    again = chosen.withColumn("__kw_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__kw_copies"))))
    return again.select(*(F.col(f"`{c}`") for c in docs.columns))


SQL = f"""
WITH units AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(source, '') AS source,
        CASE WHEN coalesce(length(text), 0) > 0 THEN CAST(length(bin(length(text))) AS BIGINT) ELSE 0 END AS size,
        2 * CAST('0x' || substring(md5(concat(doc_id, ':{SEED}')), 1, {_HEX}) AS BIGINT) + 1 AS odd FROM documents WHERE doc_id IS NOT NULL),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS whole, CAST(count(*) FILTER (size > 0) AS BIGINT) AS n FROM units GROUP BY source HAVING sum(size) > 0),
quotas AS (SELECT source, whole, sum(n) OVER () AS total, sum(n) OVER () * pow(n, {TEMPERATURE}) / sum(pow(n, {TEMPERATURE})) OVER () AS quota FROM sources),
targets AS (SELECT source, whole, CAST(floor(quota) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY quota - floor(quota) DESC, source)
        <= total - sum(floor(quota)) OVER () THEN 1 ELSE 0 END AS target FROM quotas),
shares AS (SELECT doc_id, source, size, (target * size) // whole AS sure, (target * size) % whole AS rest, whole, odd FROM units JOIN targets USING (source)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN rest > 0 THEN
        (odd::DOUBLE / (9007199254740992 - odd)::DOUBLE) / (rest::DOUBLE / (whole - rest)::DOUBLE) END NULLS LAST, doc_id, size) AS rn,
    sum(rest) OVER (PARTITION BY source) // whole AS places FROM shares)
SELECT doc_id, source, copies FROM (SELECT doc_id, source, CAST(sure + CASE WHEN rest > 0 AND rn <= places THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ranked) WHERE copies > 0
"""

"""Exact deduplication with a log-structured merge index of text digests.

Digests are spread over partitions by value. In each, a memtable takes entries until it is full and is then flushed as a
sorted run with a Bloom filter; runs of equal size are compacted, and wherever two entries meet, the smaller identifier
stays. Every hit is verified: the texts are compared byte by byte, and texts that only share a digest stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.session import ship

from ._spark import narrow_ids, table
from ._text import U64, lean, mix

MEMTABLE = 65_536
#: Rows to a partition's index, about; more partitions are made for more rows.
PARTITION = 4_000_000
FANOUT = 4
INDEX = "hi bigint, lo bigint, id bigint, keep_id bigint, hit boolean"
SQL = """
SELECT doc_id, coalesce(min(doc_id) OVER (PARTITION BY text), doc_id) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
UNION ALL SELECT doc_id, doc_id AS keep_id FROM documents WHERE text IS NULL AND doc_id IS NOT NULL
"""


class Filter:
    """Bloom filter over 128-bit digests, about ten bits and three probes a key."""

    def __init__(self, keys: np.ndarray):
        self.bits = 1 << max(6, int(len(keys) * 10).bit_length())
        self.field = np.zeros(self.bits >> 3, np.uint8)
        for at in self._places(keys):
            np.bitwise_or.at(self.field, (at >> U64(3)).astype(np.int64), (1 << (at & U64(7)).astype(np.uint8)).astype(np.uint8))

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a, b = keys["hi"], mix(keys["lo"]) | U64(1)
        for k in range(3):
            yield (a + b * U64(k)) & U64(self.bits - 1)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.field[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        return found


ENTRY = np.dtype([("hi", U64), ("lo", U64), ("id", np.int64)])


def _sorted(entries: np.ndarray) -> np.ndarray:
    return entries[np.lexsort((entries["id"], entries["lo"], entries["hi"]))]


def _firsts(entries: np.ndarray) -> np.ndarray:
    """Of sorted entries, which begin a digest."""
    new = np.ones(len(entries), bool)
    new[1:] = (entries["hi"][1:] != entries["hi"][:-1]) | (entries["lo"][1:] != entries["lo"][:-1])
    return new


class Run:
    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.filter = Filter(entries)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key's digest, or -1; only what the filter lets through is searched."""
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.filter.may_have(keys))
        e = self.entries
        lo = np.searchsorted(e["hi"], keys["hi"][maybe], "left")
        hi = np.searchsorted(e["hi"], keys["hi"][maybe], "right")
        one = hi - lo == 1
        same = one.copy()
        same[one] = e["lo"][lo[one]] == keys["lo"][maybe[one]]
        out[maybe[same]] = lo[same]
        for k in np.flatnonzero(hi - lo > 1):  # equal halves are rare
            at = lo[k] + np.flatnonzero(e["lo"][lo[k] : hi[k]] == keys["lo"][maybe[k]])
            if len(at):
                out[maybe[k]] = at[0]
        return out


class Index:
    """The log-structured merge index of one partition. add() and finish() return displaced entries: the hits."""

    def __init__(self, memtable: int = MEMTABLE, fanout: int = FANOUT):
        self.limit, self.fanout = memtable, fanout
        self.memtable: list[np.ndarray] = []
        self.held = 0
        self.levels: list[list[Run]] = []
        self.hits: list[np.ndarray] = []

    def _merge(self, parts: list[np.ndarray]) -> np.ndarray:
        entries = _sorted(np.concatenate(parts)) if parts else np.zeros(0, ENTRY)
        first = _firsts(entries)
        self.hits.append(entries[~first])
        return entries[first]

    def add(self, entries: np.ndarray) -> None:
        for k in range(0, len(entries), self.limit):
            part = entries[k : k + self.limit]
            self.memtable.append(part)
            self.held += len(part)
            if self.held >= self.limit:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        fresh = self._merge(self.memtable)
        self.memtable, self.held = [], 0
        for level in self.levels:
            for run in level:
                at = run.find(fresh)
                there = at >= 0
                if there.any():
                    # The run keeps the smaller identifier, whichever came first; the larger is the hit.
                    old = run.entries["id"][at[there]]
                    hit = fresh[there].copy()
                    hit["id"] = np.maximum(old, fresh["id"][there])
                    run.entries["id"][at[there]] = np.minimum(old, fresh["id"][there])
                    self.hits.append(hit)
                    fresh = fresh[~there]
        if len(fresh):
            self._push(0, fresh)

    def _push(self, k: int, entries: np.ndarray) -> None:
        if k == len(self.levels):
            self.levels.append([])
        self.levels[k].append(Run(entries))
        if len(self.levels[k]) >= self.fanout:
            runs, self.levels[k] = self.levels[k], []
            self._push(k + 1, self._merge([r.entries for r in runs]))

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kept entries, the hits, and the places of the entries that they hit."""
        self.flush()
        final = self._merge([r.entries for level in self.levels for r in level])
        hits = np.concatenate(self.hits) if self.hits else np.zeros(0, ENTRY)
        return final, hits, Run(final).find(hits) if len(hits) else np.zeros(0, np.int64)


def _index_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index()
    for b in batches:
        e = np.zeros(b.num_rows, ENTRY)
        for name, column in zip(("hi", "lo"), b.columns, strict=False):
            e[name] = column.to_numpy(zero_copy_only=False).view(U64)
        e["id"] = b.column(2).to_numpy(zero_copy_only=False)
        index.add(e)
    kept, hits, of = index.finish()
    grouped = np.zeros(len(kept), bool)
    grouped[of] = True
    for rows, keep, hit in ((kept, kept["id"], grouped), (hits, kept["id"][of], np.ones(len(hits), bool))):
        for k in range(0, len(rows), 100_000):
            part = slice(k, k + 100_000)
            columns = [rows["hi"][part].view(np.int64), rows["lo"][part].view(np.int64), rows["id"][part], keep[part], hit[part]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["hi", "lo", "id", "keep_id", "hit"])


def _digested(docs: DataFrame, bits: int) -> DataFrame:
    """docs with __kw_hi and __kw_lo, the halves of the text's digest."""
    hexed = F.md5(F.col("text").cast("binary"))
    hi, lo = (F.conv(F.substring(hexed, at, 16), 16, -10).cast("bigint") for at in (1, 17))
    if bits < 128:
        hi, lo = F.lit(0).cast("bigint"), F.conv(F.substring(hexed, 1, max(1, bits // 4)), 16, 10).cast("bigint")
    return docs.withColumns({"__kw_hi": hi, "__kw_lo": lo})


def _resolve(docs: DataFrame, bits: int) -> DataFrame:
    """(hi, lo, id, keep_id) of each row that has a doc_id and a text, as a written table."""
    ship(docs.sparkSession)
    d = _digested(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").where("id is not null and text is not null"), bits)
    digests = d.select(F.col("__kw_hi").alias("hi"), F.col("__kw_lo").alias("lo"), "id")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // PARTITION))
    index = table(digests.repartition(parts, "hi", "lo").mapInArrow(lean(_index_partition), INDEX))
    # Byte verification. Only texts whose digest was hit are moved, each to meet the text of the entry that it hit.
    groups = table(index.where("hit and id = keep_id").select("hi", "lo", "keep_id").distinct())
    _, few = narrow_ids(groups, "keep_id")
    g = (F.broadcast(groups) if few else groups).alias("g")
    texts = d.alias("d").join(g, (F.col("d.__kw_hi") == F.col("g.hi")) & (F.col("d.__kw_lo") == F.col("g.lo")))
    texts = texts.select("g.hi", "g.lo", "g.keep_id", "d.id", "d.text")
    kept = texts.where("id = keep_id").groupBy("hi", "lo").agg(F.min("text").alias("kept_text"))
    verified = texts.join(kept, ["hi", "lo"]).select("hi", "lo", "id", "keep_id", (F.col("text") == F.col("kept_text")).alias("same"), F.when(F.col("text") != F.col("kept_text"), F.col("text")).alias("other"))
    verified = table(verified)
    # Texts that only share the digest: settled by the text itself. There are none unless digests collide.
    apart = verified.where("not same").select("hi", "lo", "id", F.min("id").over(Window.partitionBy("hi", "lo", "other")).alias("keep_id"))
    return index.where("not hit").select("hi", "lo", "id", "keep_id").unionByName(verified.where("same").select("hi", "lo", "id", "keep_id")).unionByName(apart)


def find_duplicates(docs: DataFrame, digest_bits: int = 128) -> DataFrame:
    """(doc_id, keep_id) for each row of docs: the least doc_id of those with the same text, byte for byte.

    A null text equals no other, so it keeps itself; an empty text is a text. Rows without doc_id can't be named and have
    no row here. Repeated rows have a row each, keeping the same identifier; where one doc_id has several texts, each is
    looked up for itself. Other columns are not looked at. digest_bits below 128 makes digests meet, for tests.
    """
    without = docs.where("doc_id is not null and text is null").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    found = _resolve(docs, digest_bits).select(F.col("id").alias("doc_id"), "keep_id")
    return found.unionByName(without.select("doc_id", F.col("doc_id").alias("keep_id")))


def drop_duplicates(docs: DataFrame, digest_bits: int = 128) -> DataFrame:
    """docs with one row of each text: the one of least doc_id. Columns as they are.

    Of rows that repeat both doc_id and text one stays. Rows without doc_id or without text stay.
    """
    found = _resolve(docs, digest_bits)
    lost = table(found.where("id <> keep_id").select("hi", "lo", "id"))
    repeated = table(found.where("id = keep_id").groupBy("hi", "lo", "id").count().where("count > 1").select("hi", "lo", "id"))
    columns = docs.columns
    rows = _digested(docs, digest_bits)

    def there(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("hi").alias("__kw_khi"), F.col("lo").alias("__kw_klo"), F.col("id").alias("__kw_kid"))
        _, few = narrow_ids(keys, "id")
        same = (F.col("__kw_hi") == F.col("__kw_khi")) & (F.col("__kw_lo") == F.col("__kw_klo")) & (df["doc_id"] == F.col("__kw_kid"))
        return df.join(F.broadcast(k) if few else k, same, how)

    kept = there(rows, lost, "left_anti")
    if repeated.isEmpty():
        return kept.select(*(F.col(f"`{c}`") for c in columns))
    once = there(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return there(kept, repeated, "left_anti").unionByName(once).select(*(F.col(f"`{c}`") for c in columns))

"""N-gram Jaccard self-join of documents: MinHash banding finds candidate pairs, full n-gram sets verify them.

Band and row counts follow from the threshold and the recall wanted there. Documents with equal n-gram sets are joined
first, as a group, by a cryptographic digest of the whole set; a representative of each group is banded. A pair of
representatives is verified where its first common band hash brings it together, once, and large buckets are verified in
blocks. A verified pair holds for all members of the two groups; the result tells for each document what it is connected
with and how many links it has, so it grows with the documents and not with the pairs of a group of copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.session import ship

from ._classes import describe
from ._spark import keep_ids, narrow_ids, table
from ._text import U64, WORDS, Codes, batches, lean, mix, ngram_hashes

NGRAM = 3
THRESHOLD = 0.5
RECALL = 0.96
#: Buckets of more documents are cut into blocks of about so many, and every two blocks meet.
BLOCK = 256
SIGNED = "doc_id bigint, version bigint, size bigint, fp1 bigint, fp2 bigint, bands array<bigint>"
PAIRS = "ga bigint, gb bigint, jaccard double"


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest candidates, for which a pair at the threshold is found with
    probability recall within most hash functions. ValueError if no so many find it."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hash functions don't reach a recall of {recall} at {threshold}")
    return best


def ngram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text with the text's place, ordered by text, then hash. texts in lower case."""
    c = Codes(texts)
    starts, ends, doc = c.spans(WORDS)
    h, d = ngram_hashes(c.hashes(starts, ends), doc, n, len(texts))
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def _sign(bands: int, rows: int, n: int):
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=U64))
    a, b = seeds[: bands * rows] | U64(1), seeds[bands * rows :]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in batches(texts, 500_000):
                h, d = ngram_sets(texts[i:j], n)
                count = np.bincount(d, minlength=j - i)
                there = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[there]
                folded = np.zeros((bands, len(there)), U64)
                if len(there):
                    for band in range(bands):
                        key = np.full(len(there), band + 1, U64)
                        for r in range(band * rows, (band + 1) * rows):
                            key = mix(key ^ np.minimum.reduceat(h * a[r] + b[r], first))
                        folded[band] = key
                # Sets are sorted, so equal ones have equal bytes.
                digests = np.zeros((j - i, 2), np.int64)
                for k, at in zip(there.tolist(), first.tolist(), strict=True):
                    digests[k] = np.frombuffer(hashlib.blake2b(h[at : at + count[k]].tobytes(), digest_size=16).digest(), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((count > 0) * bands)).astype(np.int32)), pa.array(folded.T.reshape(-1).view(np.int64)))
                ids = [batch.column(k).slice(i, j - i) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(count), *(pa.array(np.ascontiguousarray(x)) for x in digests.T), lists], ["doc_id", "version", "size", "fp1", "fp2", "bands"])

    return run


def _verify_group(ids: np.ndarray, texts: list[str], partners: list[np.ndarray], n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, d = ngram_sets(texts, n)
    size = np.bincount(d, minlength=len(texts))
    order = np.argsort(ids, kind="stable")
    left = np.repeat(np.arange(len(ids)), [len(p) for p in partners])
    wanted = np.concatenate(partners) if len(left) else np.zeros(0, np.int64)
    right = order[np.searchsorted(ids[order], wanted)]
    # N-grams that only one text has add nothing to an intersection; the others become columns, some at a time.
    keys, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    row, column = d[use], place[column[use]]
    total = int(shared.sum())
    common = np.zeros(len(left), np.int64)
    if len(left) > len(texts):  # dense: a product of incidence matrices counts every pair at once
        counts = np.zeros((len(texts), len(texts)), np.float32)
        width = max(256, 4_000_000 // max(1, len(texts)))
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        for k in range(0, total, width):
            part = slice(*np.searchsorted(column, (k, k + width)))
            m = np.zeros((len(texts), min(width, total - k)), np.float32)
            m[row[part], column[part] - k] = 1
            counts += m @ m.T
        common = counts[left, right].astype(np.int64)
    else:
        at = np.searchsorted(d, np.arange(len(texts) + 1))
        for k in range(len(left)):
            x, y = (h[at[t] : at[t + 1]] for t in (left[k], right[k]))
            common[k] = len(np.intersect1d(x, y, assume_unique=True))
    either = size[left] + size[right] - common
    jaccard = common / np.maximum(either, 1)
    ok = (jaccard >= threshold) & (either > 0)
    return ids[left[ok]], ids[right[ok]], jaccard[ok]


def _verify(n: int, threshold: float):
    """Streams rows in order of key; all rows of a key are together, by id, and are verified when the next key begins."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, texts, partners = None, [], [], []

        def done() -> pa.RecordBatch:
            a, b, j = _verify_group(np.array(ids, np.int64), texts, partners, n, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(j)], ["ga", "gb", "jaccard"])

        for batch in stream:
            lists = batch.column(3)
            for k, (at, i, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if at != key and ids:
                    yield done()
                    ids, texts, partners = [], [], []
                if at == key and ids and i == ids[-1]:  # the row is repeated
                    continue
                key = at
                ids.append(i)
                texts.append(t)
                partners.append(lists[k].values.to_numpy(zero_copy_only=False) if len(lists[k]) else np.zeros(0, np.int64))
        if ids:
            yield done()

    return run


def _block(id_: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(id_), blocks)


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text in lower case) of the rows with a doc_id; version tells the texts of one doc_id apart."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.lower("text"), F.lit("")).alias("text")).where("doc_id is not null")
    return d.select("doc_id", F.xxhash64("text").alias("version"), "text")


def _groups(docs: DataFrame, n: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Groups of documents with equal n-gram sets: (gid, doc_id of the representative); (gid, id, version) of each member;
    the verified pairs of groups (ga, gb, jaccard); and the identifiers of documents without a word.

    A document with several texts is in several groups.
    """
    ship(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    d = _documents(docs)
    everything = table(d.mapInArrow(lean(_sign(bands, rows, n)), SIGNED))
    signed = everything.where("size > 0")
    same = ["size", "fp1", "fp2"]
    # A written table keeps the numbers that it is given.
    reps = table(signed.groupBy(*same).agg(F.min(F.struct("doc_id", "version", "bands")).alias("r")).select(F.monotonically_increasing_id().alias("gid"), *same, "r.doc_id", "r.version", "r.bands"))
    members = table(signed.select(*same, F.col("doc_id").alias("id"), "version").join(reps.select(*same, "gid"), same).select("gid", "id", "version").distinct())
    keyed = reps.select("gid", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / block).alias("blocks"))
    met = table(keyed.join(crowded, "key"))
    few = met.join(reps.select("gid", "bands"), "gid")
    # Each group meets its own block and every other one: (i, j) with i <= j.
    mine = _block(F.col("gid"), F.col("blocks"))
    spread = few.select("key", "gid", "bands", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"), mine.alias("mine"))
    spread = spread.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "gid", "bands")
    a, b = spread.alias("a"), spread.alias("b")
    together = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.gid") < F.col("b.gid"))
    # Of block (i, j), the pairs of i with j; within i itself only at (i, i).
    together &= (F.col("a.mine") != F.col("b.mine")) | (F.col("a.i") == F.col("a.j"))
    place = F.array_position("a.bands", F.col("a.key")).cast("int") - 1
    first = ~F.arrays_overlap(F.slice("a.bands", F.lit(1), place), F.slice("b.bands", F.lit(1), place))
    pairs = a.join(b, together).where(first).select("a.key", "a.i", "a.j", F.col("a.gid").alias("x"), F.col("b.gid").alias("y"))
    at = pairs.select("key", "i", "j", F.col("x").alias("gid"), F.col("y").alias("partner"))
    at = at.unionByName(pairs.select("key", "i", "j", F.col("y").alias("gid"), F.lit(None).cast("bigint").alias("partner")))
    places = at.groupBy("key", "i", "j", "gid").agg(F.collect_list("partner").alias("partners"))
    places = table(places.join(reps.select("gid", F.col("doc_id").alias("id"), F.col("version").alias("v")), "gid"))
    wanted = table(places.select("id").distinct())
    # A text comes to each place where its group has a pair to verify, and only there.
    texts = keep_ids(d, wanted, "id").alias("t").join(places, (F.col("t.doc_id") == F.col("id")) & (F.col("t.version") == F.col("v")))
    texts = texts.select(F.struct("key", "i", "j").alias("place"), "gid", F.col("t.text").alias("text"), "partners")
    texts = texts.repartition("place").sortWithinPartitions("place", "gid").select(F.to_json("place").alias("place"), "gid", "text", "partners")
    blank = everything.where("size = 0").select(F.col("doc_id").alias("id")).distinct()
    return reps.select("gid", "doc_id"), members, table(texts.mapInArrow(lean(_verify(n, threshold)), PAIRS)), blank


def near_duplicates(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, links): one row for each document, links being the number of others whose set of word n-grams has a
    Jaccard index of threshold or more with its own, and class_id the least doc_id that such links connect it with.

    Words are runs of letters and digits in lower case; a text of fewer than n words is one n-gram. Nothing is left out but
    what banding misses (about 1 - recall at the threshold, less above it); equal sets are never missed. Texts that are null
    or have no word match nothing, are classes of their own and have no links. Rows without doc_id are not looked at; repeated
    rows count once. A doc_id with several texts has a row, and counts, for each different n-gram set of them; if it is the
    least of several classes, they bear the same name. Other columns are not looked at.
    """
    _, members, pairs, blank = _groups(docs, n, threshold, recall, block)
    entries = table(members.select("gid", "id").distinct())
    told = entries.join(describe(pairs, entries), "gid").select(F.col("id").alias("doc_id"), "class_id", "links")
    return told.unionByName(blank.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))


def matches(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b, jaccard): the verified pairs of different n-gram sets, each named by the least doc_id that has it."""
    reps, _, pairs, _ = _groups(docs, n, threshold, recall, block)
    a, b = (reps.select(F.col("gid").alias(f"g{x}"), F.col("doc_id").alias(f"doc_{x}")) for x in "ab")
    return pairs.join(a, "ga").join(b, "gb").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")


def one_of_each(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs with one text of each class that near_duplicates finds: that of least doc_id. Columns and other rows as they are.

    Of several texts of that doc_id one stays; where a doc_id has texts in several classes, each is judged for itself. Rows
    that repeat both doc_id and text stay or go together. Rows without doc_id, and texts that are null or have no word, stay.
    """
    _, members, pairs, _ = _groups(docs, n, threshold, recall, block)
    told = members.join(describe(pairs, table(members.select("gid", "id").distinct())).select("gid", "root"), "gid")
    kept = told.groupBy("root").agg(F.min(F.struct("id", "version")).alias("k"), F.count("*").alias("m")).where("m > 1")
    lost = table(told.join(kept, "root").where("id <> k.id or version <> k.version").select("id", "version"))
    _, few = narrow_ids(lost, "id")
    gone = lost.select(F.col("id").alias("__kw_id"), F.col("version").alias("__kw_version"))
    left = docs.alias("__kw_docs")
    version = F.xxhash64(F.coalesce(F.lower("__kw_docs.text"), F.lit("")))
    return left.join(F.broadcast(gone) if few else gone, (F.col("__kw_docs.doc_id").cast("bigint") == F.col("__kw_id")) & (version == F.col("__kw_version")), "left_anti")

"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are rotated at random (signs and a fast Hadamard transform, three times over); the hash is the axis that a rotated
vector is nearest to, with its sign. A table's key joins some such hashes, and a vector also looks into the buckets that
come next for it (multiprobe). Pairs that meet are verified by their cosine. Of vectors equal after scaling, as a cryptographic
digest of them tells, one is hashed and verified, and its pairs hold for all of them. The result tells for each vector what it
is connected with and how many links it has, so it grows with the vectors and not with the pairs of a group of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import ship

from ._classes import describe
from ._spark import narrow_ids, table
from ._text import U64, mix

THRESHOLD = 0.95
TABLES = 8
#: With d axes a table has (2d)^HASHES buckets, so chance meetings grow with the square of the input over that number.
HASHES = 3
PROBES = 3
BLOCK = 512
SIGNED = "vec_id bigint, fp1 bigint, fp2 bigint, vector array<float>, own array<bigint>, probes array<bigint>"
PAIRS = "ga bigint, gb bigint, score double"


def _matrix(size: int) -> np.ndarray:
    m = np.ones((1, 1), np.float32)
    while len(m) < size:
        m = np.block([[m, m], [m, -m]])
    return m


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; up to eight places a step."""
    n, d = x.shape
    left = d
    while left > 1:
        r = min(8, left)
        # The first r-th part of the places goes last when it is done, so after all steps they are where they were.
        x = np.ascontiguousarray((x.reshape(n, r, d // r).transpose(0, 2, 1).reshape(-1, r) @ _matrix(r)).reshape(n, d))
        left //= r
    return x / np.float32(np.sqrt(d))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * r.choice(np.array([-1, 1], np.float32), x.shape[1]))
    return x


def keys(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, others): each vector's key in every table, and the keys of the next buckets, best first.

    A next bucket changes one hash to the axis that is second (or later) nearest; those of least loss come first.
    """
    n = len(x)
    rows = np.arange(n)
    own, others = [], []
    for t in range(tables):
        names, losses = [], []
        for h in range(hashes):
            y = rotate(x, seed + t * hashes + h)
            size = np.abs(y)
            k = min(probes + 1, size.shape[1])
            top = np.argpartition(size, size.shape[1] - k, axis=1)[:, size.shape[1] - k :]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
            names.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            best = np.take_along_axis(size, top, 1)
            losses.append(best[:, :1] - best)
        first = [a[:, 0] for a in names]

        def key(parts: list[np.ndarray], t: int = t) -> np.ndarray:
            k = np.full(n, t + 1, U64)
            for p in parts:
                k = mix(k ^ (p.astype(U64) + U64(1)))
            return k

        own.append(key(first))
        steps = [(h, j) for h in range(hashes) for j in range(1, min(probes, x.shape[1] - 1) + 1)]
        loss = np.stack([losses[h][:, j] for h, j in steps], 1)
        every = np.stack([key([names[h][:, j] if g == h else first[g] for g in range(hashes)]) for h, j in steps], 1)
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        others.append(every[rows[:, None], pick])
    return np.stack(own, 1), np.concatenate(others, 1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), kind))


def _sign(tables: int, hashes: int, probes: int, seed: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            vectors = [np.array(v, np.float32) for v in b.column(1).to_pylist()]
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for dim in sorted({len(v) for v in vectors}):
                here = np.array([k for k, v in enumerate(vectors) if len(v) == dim])
                x = np.stack([vectors[k] for k in here]) if dim else np.zeros((0, 0), np.float32)
                length = np.sqrt((x.astype(np.float64) ** 2).sum(1)) if dim else np.zeros(0)
                good = np.isfinite(length) & (length > 0)
                if not good.any():
                    continue
                here, x = here[good], (x[good] / length[good, None]).astype(np.float32)
                for i in range(0, len(x), 4096):
                    v = x[i : i + 4096]
                    wide = np.zeros((len(v), 1 << max(1, (dim - 1).bit_length())), np.float32)
                    wide[:, :dim] = v
                    own, others = keys(wide, tables, hashes, probes, seed)
                    salt = mix(np.array([dim], U64))  # vectors of different length don't meet
                    prints = np.array([np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64) for x in v + np.float32(0)])  # no negative zeros
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[here[i : i + 4096]]), *(pa.array(np.ascontiguousarray(p)) for p in prints.T), _lists(v, pa.float32()), _lists((own ^ salt).view(np.int64), pa.int64()), _lists((others ^ salt).view(np.int64), pa.int64())],
                        ["vec_id", "fp1", "fp2", "vector", "own", "probes"],
                    )

    return run


def _verify(threshold: float):
    """Rows in order of key: every vector of a bucket with every one of the bucket's own or that looks into it."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, owns = None, [], [], []

        def done() -> pa.RecordBatch:
            i, own = np.array(ids, np.int64), np.array(owns, bool)
            x = np.stack(vectors)
            cosine = x @ x.T
            a, b = np.nonzero((cosine >= threshold - 1e-4) & (i[:, None] < i[None, :]) & (own[:, None] | own[None, :]))
            exact = (x[a].astype(np.float64) * x[b]).sum(1)
            exact /= np.sqrt((x[a].astype(np.float64) ** 2).sum(1) * (x[b].astype(np.float64) ** 2).sum(1))
            ok = exact >= threshold
            return pa.RecordBatch.from_arrays([pa.array(i[a[ok]]), pa.array(i[b[ok]]), pa.array(np.round(exact[ok], 6))], ["ga", "gb", "score"])

        for batch in stream:
            lists = batch.column(3)
            for k, (at, i, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if at != key and ids:
                    yield done()
                    ids, vectors, owns = [], [], []
                key = at
                ids.append(i)
                owns.append(own)
                vectors.append(lists[k].values.to_numpy(zero_copy_only=False))
        if ids:
            yield done()

    return run


def _groups(vectors: DataFrame, threshold: float, tables: int, hashes: int, probes: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Groups of equal vectors: (gid, id) of each member, and the verified pairs of groups (ga, gb, score); written tables."""
    ship(vectors.sparkSession)
    d = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    d = d.where("vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)")
    signed = table(d.mapInArrow(_sign(tables, hashes, probes, seed), SIGNED))
    # A written table keeps the numbers that it is given.
    reps = table(signed.groupBy("fp1", "fp2").agg(F.min(F.struct("vec_id", "vector", "own", "probes")).alias("r")).select(F.monotonically_increasing_id().alias("gid"), "fp1", "fp2", "r.vector", "r.own", "r.probes"))
    members = table(signed.select("fp1", "fp2", F.col("vec_id").alias("id")).join(reps.select("fp1", "fp2", "gid"), ["fp1", "fp2"]).select("gid", "id").distinct())
    looks = reps.select("gid", F.explode("own").alias("key"), F.lit(True).alias("own")).unionByName(reps.select("gid", F.explode("probes").alias("key"), F.lit(False).alias("own")))
    # Buckets worth a visit: with an own member, and another vector. Large ones are met in blocks.
    crowded = looks.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("lived")).where("n > 1 and lived").select("key", F.ceil(F.col("n") / block).alias("blocks"))
    met = table(looks.join(crowded, "key"))
    mine = F.pmod(F.xxhash64("gid"), F.col("blocks"))
    spread = met.select("key", "gid", "own", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    spread = spread.select(F.struct("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).alias("place"), "gid", "own")
    ids, _ = narrow_ids(table(met.select("gid").distinct()), "gid")
    found = reps.select("gid", "vector").join(ids, F.col("gid") == F.col("__kw_id"), "left_semi")
    rows = spread.join(found, "gid").repartition("place").sortWithinPartitions("place", "gid")
    rows = rows.select(F.to_json("place").alias("place"), "gid", "own", "vector")
    pairs = rows.mapInArrow(_verify(threshold), PAIRS).groupBy("ga", "gb").agg(F.max("score").alias("score"))
    return members, table(pairs)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK, seed: int = 10) -> DataFrame:
    """(vec_id, class_id, links): one row for each vector, links being the number of others whose cosine with it is threshold
    or more, and class_id the least vec_id that such links connect it with.

    Nothing is left out but what hashing misses; vectors equal after scaling are never missed. Vectors that are null, empty,
    zero, or hold a null, NaN or infinity match nothing, are classes of their own and have no links; nor do vectors of
    different dimension match. Rows without vec_id are not looked at; repeated rows count once. A vec_id with several
    different vectors has a row, and counts, for each; if it is the least of several classes, they bear the same name. Other
    columns are not looked at.
    """
    members, pairs = _groups(vectors, threshold, tables, hashes, probes, block, seed)
    entries = members.select("gid", "id")
    told = entries.join(describe(pairs, entries), "gid").select(F.col("id").alias("vec_id"), "class_id", "links")
    every = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).where("vec_id is not null").distinct()
    lone = every.join(entries.select(F.col("id").alias("vec_id")), "vec_id", "left_anti")
    return told.unionByName(lone.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))


def matches(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK, seed: int = 10) -> DataFrame:
    """(vec_a, vec_b, cosine): the verified pairs of different vectors, each named by the least vec_id that has it; six digits."""
    members, pairs = _groups(vectors, threshold, tables, hashes, probes, block, seed)
    least = members.groupBy("gid").agg(F.min("id").alias("id"))
    a, b = (least.select(F.col("gid").alias(f"g{x}"), F.col("id").alias(f"v{x}")) for x in "ab")
    return pairs.join(a, "ga").join(b, "gb").select(F.least("va", "vb").alias("vec_a"), F.greatest("va", "vb").alias("vec_b"), F.col("score").alias("cosine"))

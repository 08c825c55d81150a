"""Best-fit packing of documents into training sequences by a configuration linear program.

The program runs over the histogram of lengths: how often is each configuration of lengths used so that all are covered by
the fewest sequences? Multiplicative weights price the lengths, a knapsack dynamic program finds the most valuable
configuration at those prices, and the fractional solution is rounded down; what is left is packed best-fit in whole
configurations. The histogram has at most as many rows as there are lengths, whatever the number of documents; documents
get their sequences from their rank within their length. Lengths are true token counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import narrow_ids, share, table
from ._text import lean
from .tokens import VOCABULARY, token_counts

CAPACITY = 2048
#: Lengths are rounded up to multiples of this in the program, and only there.
GRAIN = 8
#: Documents are ranked in shards of about so many, and in no fewer than SHARDS.
SHARD = 2_000_000
SHARDS = 64
#: Rows that a task makes at once.
BATCH = 200_000
RESULT = "doc_id bigint, piece bigint, tokens bigint, bin bigint"


def best_configuration(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each item fill a knapsack of the capacity with the most value; items may be used again."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(sizes, c, "right")
        if fits:
            total = best[c - sizes[:fits]] + values[:fits]
            k = int(total.argmax())
            if total[k] > best[c - 1]:
                best[c], choice[c] = total[k], k
                continue
        best[c] = best[c - 1]
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= sizes[choice[c]]
    return counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.01, rate: float = 0.5, most: int = 6_000) -> list[tuple[np.ndarray, float]]:
    """Fractional uses of configurations that cover the demand, as few as any could within gap, or the best after most rounds.

    Each round uses the configuration that covers most at the present weights some more; a length's weight falls
    exponentially with how often its demand has been covered. The configurations known are priced at once, and now and then
    a knapsack finds whether there is a better one. The weights also bound from below how few uses can do, which tells when to end.
    """
    if not len(sizes):
        return []
    # Each length alone: so that every demand can be covered from the start.
    known = [best_configuration(np.arange(len(sizes)) == k, sizes, capacity) for k in range(len(sizes))] if len(sizes) <= 16 else [np.where(np.arange(len(sizes)) == k, capacity // sizes[k], 0) for k in range(len(sizes))]
    seen = {c.tobytes() for c in known}
    share = [c / demand for c in known]
    matrix, uses, covered, bound = np.array(share), np.zeros(len(known)), np.zeros(len(sizes)), 0.0
    for turn in range(most):
        weight = np.exp(-rate * (covered - covered.min()))
        price = matrix @ weight
        best = int(price.argmax())
        if turn < 2 * len(sizes) or turn % 50 == 0:
            c = best_configuration(weight / demand, sizes, capacity)
            value = float((c / demand) @ weight)
            bound = max(bound, float(weight.sum()) / max(value, float(price[best])))
            if value > price[best] * (1 + 1e-9) and c.tobytes() not in seen:
                seen.add(c.tobytes())
                known.append(c)
                matrix, uses, best = np.vstack([matrix, c / demand]), np.append(uses, 0.0), len(known) - 1
            if covered.min() > 0 and uses.sum() / covered.min() <= bound * (1 + gap):
                break
        amount = 1.0 / float(matrix[best].max())
        uses[best] += amount
        covered += matrix[best] * amount
    return [(c, float(x)) for c, x in zip(known, uses / covered.min(), strict=True) if x > 0]


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole uses of configurations that take every item exactly once; sizes ascending, distinct, at most capacity."""
    left = demand.astype(np.int64).copy()
    out = []

    def use(c: np.ndarray, times: int) -> None:
        if times > 0:
            left[:] -= c * times
            out.append((c, times))

    found = solve(sizes, demand.astype(float), capacity)
    for c, x in sorted(found, key=lambda f: (-int(f[0] @ sizes), f[0].tobytes())):
        used = c > 0
        use(c, min(int(np.floor(x + 1e-9)), int((left[used] // c[used]).min())))
    while left.any():  # best fit: the largest item left, then again and again the largest that still fits
        c, room = np.zeros(len(sizes), np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            n = min(left[k], room // sizes[k])
            c[k], room = n, room - n * sizes[k]
        used = c > 0
        use(c, int((left[used] // c[used]).min()))
    return out


def _tables(uses: list[tuple[np.ndarray, int]], sizes: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each size, the ranks at which its configurations begin, their first sequences and items a sequence; the number of sequences."""
    by: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}
    at, first = dict.fromkeys(by, 0), 0
    for c, times in uses:
        for k in np.flatnonzero(c):
            s = int(sizes[k])
            by[s].append((at[s], first, int(c[k])))
            at[s] += int(c[k]) * times
        first += times
    return {s: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for s, rows in by.items() if rows}, first


def pack(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, tokens, bin): where each piece of each document goes; no bin holds more than capacity tokens.

    Tokens are those of token_counts by the vocabulary. A document of more than capacity tokens is cut: its whole pieces fill
    bins of their own, and the last piece is packed like a short document. Null and empty texts have no tokens and no row;
    rows without doc_id can't be placed by name and have none; repeated rows are packed each, and it doesn't matter which of
    the rows that tie in doc_id and length goes where. Other columns are not looked at. The program's solution ends after a
    bounded number of rounds, however large the histogram; a longer search could only save bins.
    """
    counted = token_counts(docs.where("doc_id is not null"), vocabulary).where("n_tokens > 0")
    rest = F.pmod(F.col("n_tokens"), F.lit(capacity))
    # Rows that tie are one row with their number, however often a doc_id repeats.
    d = table(counted.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("m")).select("doc_id", F.floor(F.col("n_tokens") / capacity).alias("full"), rest.alias("rest"), (F.ceil(rest / grain) * grain).alias("size"), "m"))
    shards = max(SHARDS, -(-d.count() // SHARD))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "full", "rest"), F.lit(shards)))
    short, long = d.where("rest > 0"), d.where("full > 0")
    # Ranks within a length: within a shard by a window, and shards end to end by their counts (lengths x shards rows).
    counts = table(short.groupBy("size", "shard").agg(F.sum("m").alias("n")))
    demand = counts.groupBy("size").agg(F.sum("n").alias("n")).toPandas().sort_values("size")
    fulls = long.groupBy("shard").agg(F.sum(F.col("full") * F.col("m")).alias("n")).toPandas().sort_values("shard")
    sizes = demand["size"].to_numpy(np.int64)
    tables, bins = _tables(plan(-(-sizes // grain), demand["n"].to_numpy(np.int64), capacity // grain), sizes)
    long_starts = docs.sparkSession.createDataFrame([(int(h), bins + int(v)) for h, v in zip(fulls["shard"], fulls["n"].cumsum() - fulls["n"], strict=True)] or [(0, bins)], "shard bigint, start bigint")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("size").alias("s"), F.col("shard").alias("h"), F.coalesce(F.sum("n").over(upto(Window.partitionBy("size").orderBy("shard"))), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if narrow_ids(counts, "shard")[1] else starts
    order = ["doc_id", "full", "rest"]
    before = F.coalesce(F.sum("m").over(upto(Window.partitionBy("size", "shard").orderBy(*order))), F.lit(0))
    ranked = short.withColumn("k", before).join(starts, (F.col("size") == F.col("s")) & (F.col("shard") == F.col("h"))).select(*order, "size", "m", (F.col("k") + F.col("start")).alias("k"))
    running = F.coalesce(F.sum(F.col("full") * F.col("m")).over(upto(Window.partitionBy("shard").orderBy(*order))), F.lit(0))
    # Size 0 marks the whole pieces, whose bins are their own.
    wide = long.withColumn("k", running).join(F.broadcast(long_starts), "shard").select(*order, F.lit(0).cast("bigint").alias("size"), "m", (F.col("k") + F.col("start")).alias("k"))  # a row for each shard
    shared = share(docs.sparkSession, tables)

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            doc, full, rest, size, m, k = (b.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            n = np.where(size == 0, full * m, m)
            end = np.cumsum(n)
            for lo in range(0, int(end[-1]) if len(end) else 0, BATCH):
                item = np.arange(lo, min(lo + BATCH, int(end[-1])))
                row = np.searchsorted(end, item, "right")
                nth = item - (end - n)[row]
                rank, w = k[row] + nth, size[row] == 0
                out = rank.copy()
                for s in np.unique(size[row][~w]):
                    here = size[row] == s
                    at, first, each = shared.value[int(s)]
                    j = np.searchsorted(at, rank[here], "right") - 1
                    out[here] = first[j] + (rank[here] - at[j]) // each[j]
                columns = [doc[row], np.where(w, nth % np.maximum(full[row], 1), full[row]), np.where(w, capacity, rest[row]), out]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "piece", "tokens", "bin"])

    return ranked.unionByName(wide).mapInArrow(lean(place), RESULT)

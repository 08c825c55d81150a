"""Language identification by word-first backoff.

A known word costs each language its rounded negative log relative frequency there; a word that no language knows falls
back to the longest order of character n-grams of which any is known, and costs the mean over those. A text's language is
the one of least total cost. Costs are whole thousandths of a nat, so sums don't depend on the order of addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import hash_order, share, table
from ._text import LETTERS, Codes, Memo, batches, distinct, give_back, kept, lean

WORD = r"[a-z\x{80}-\x{10FFFF}]+"
ORDERS = (5, 4, 3, 2, 1)
PENALTY = 16_000
PER_LANG = 500
MIN_COUNT = 2
MAX_LANGS = 300
#: A text that two languages fit within a tenth of a nat a word is undecided; a clean text's margin is some nats.
MIN_MARGIN = 100
SCHEMA = "doc_id bigint, predicted string, n_words bigint, cost bigint, margin bigint, accepted boolean"


def _cost(n: Column, total: Column) -> Column:
    return F.round(1000 * (F.log(total) - F.log(n))).cast("bigint")


def _grams(word: Column, order: int) -> Column:
    padded = word if order == 1 else F.concat(F.lit("_"), word, F.lit("_"))
    count = F.length(padded) - (order - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(padded, i, F.lit(order)))).otherwise(F.array().cast("array<string>"))


@dataclass
class Model:
    """Sorted hashes of words and of n-grams by order, with a cost for every language (PENALTY where it lacks the item)."""

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # 0: words

    def _find(self, order: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, costs = self.tables[order]
        if not len(keys) or not len(hashes):
            return np.zeros(len(hashes), bool), np.zeros((len(hashes), len(self.langs)), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, costs[at]

    def words(self, hashes: np.ndarray, strings: list[str]) -> np.ndarray:
        """A row of costs for each word; -1 where not even a character is known."""
        known, costs = self._find(0, hashes)
        out = np.where(known[:, None], costs, -1)
        left = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(left):
                break
            c = Codes([strings[k] if order == 1 else f"_{strings[k]}_" for k in left])
            counts = np.maximum(np.diff(c.offsets) - (order - 1), 0)
            word = np.repeat(np.arange(len(left)), counts)
            starts = np.repeat(c.offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            there, costs = self._find(order, c.hashes(starts, starts + order))
            n = np.bincount(word[there], minlength=len(left))
            found = n > 0
            for j in range(len(self.langs)):
                sums = np.bincount(word[there], weights=costs[there, j], minlength=len(left)).astype(np.int64)
                out[left[found], j] = sums[found] // n[found]
            left = left[~found]
        return out

    def texts(self, texts: list[str], memo: Memo) -> np.ndarray:
        """For each text: language's place (-1: none), words scored, least mean cost, margin to the next language."""
        out = np.zeros((len(texts), 4), np.int64)
        for i, j in batches(texts):
            c = Codes(texts[i:j])
            starts, ends, doc = c.spans(LETTERS)
            keys, first, inverse = distinct(c.hashes(starts, ends))
            joined = "".join(texts[i:j])
            costs = memo.get(keys, lambda new: self.words(keys[new], [joined[starts[f] : ends[f]] for f in first[new]]))
            scored = costs[:, 0] >= 0
            weight = scored[inverse]
            n = np.bincount(doc[weight], minlength=j - i)
            total = np.stack([np.bincount(doc[weight], weights=costs[inverse[weight], k], minlength=j - i) for k in range(len(self.langs))], 1).astype(np.int64)
            best = total.argmin(1)
            least = total.min(1)
            total[np.arange(j - i), best] = np.iinfo(np.int64).max
            m = np.maximum(n, 1)
            # With one language nothing competes: every word is as if another lacked it.
            second = total.min(1) if len(self.langs) > 1 else least + PENALTY * m
            out[i:j] = np.stack([np.where(n > 0, best, -1), n, np.where(n > 0, least // m, 0), np.where(n > 0, (second - least) // m, 0)], 1)
        return out


def train(docs: DataFrame, per_lang: int = PER_LANG, min_count: int = MIN_COUNT, seed: int = 5) -> Model:
    """Fits on at most per_lang (up to 1,000) documents of each value of lang, drawn by hash of doc_id; whole texts.

    Rows without doc_id, text or lang take no part. With none left, the model knows no language and accepts nothing. Of
    more than MAX_LANGS languages ValueError: a lang of free text would make a model without bounds.
    """
    labelled = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), F.col("text").alias("t")).where("id is not null and l is not null and t is not null")
    ranked = labelled.select("id", "l", F.row_number().over(Window.partitionBy("l").orderBy(hash_order("id", seed), "id")).alias("rn"))
    chosen = table(ranked.where(F.col("rn") <= per_lang).select(F.col("id").alias("cid"), F.col("l").alias("cl")).distinct())
    if chosen.select("cl").distinct().limit(MAX_LANGS + 1).count() > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    # At most per_lang x MAX_LANGS identifiers, at any size of docs.
    sample = labelled.join(F.broadcast(chosen), (F.col("id") == F.col("cid")) & (F.col("l") == F.col("cl")))
    words = table(sample.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0))).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n")))
    parts = [words.select(F.lit(0).alias("o"), "l", F.col("w").alias("g"), "n")]
    for order in ORDERS:
        parts.append(words.select(F.lit(order).alias("o"), "l", F.explode(_grams(F.col("w"), order)).alias("g"), "n"))
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    counts = items.groupBy("o", "l", "g").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("o", "l"))
    got = counts.withColumn("t", total).where(F.col("n") >= min_count).select("o", "l", "g", _cost(F.col("n"), F.col("t")).cast("int").alias("s")).toArrow()
    langs = sorted(set(got["l"].to_pylist()))
    o, lang, s = got["o"].to_numpy(), np.searchsorted(langs, got["l"].to_pylist()) if langs else np.zeros(0, int), got["s"].to_numpy()
    strings = np.array(got["g"].to_pylist(), object)
    tables = {}
    for order in (0, *ORDERS):
        here = np.flatnonzero(o == order)
        c = Codes(list(strings[here]))
        keys, inverse = np.unique(c.hashes(c.offsets[:-1], c.offsets[1:]), return_inverse=True)
        costs = np.full((len(keys), max(1, len(langs))), PENALTY, np.int64)
        if len(here):
            costs[inverse, lang[here]] = s[here]
        tables[order] = (keys, costs)
    return Model(langs or [""], tables)


def identify(docs: DataFrame, model: Model, min_margin: int = MIN_MARGIN) -> DataFrame:
    """One row for each row of docs: predicted language, words scored, mean cost, margin, and whether it is accepted.

    A text is rejected (predicted null) if it is null or empty or none of its characters is known to any language, or if
    its margin is below min_margin thousandths of a nat a word. Ties go to the first language by name. Where the model knows
    one language only, the margin is PENALTY, and whatever has a known word or character is accepted. Repeated rows and null
    ids are scored like any other; other columns are not looked at.
    """
    shared, name = share(docs.sparkSession, model), uuid.uuid4().hex

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, kept("langid", name, lambda: Memo(len(shared.value.langs), dtype=np.int64))
        for b in batches_in:
            r = m.texts([t or "" for t in b.column(1).to_pylist()], memo)
            ok = (r[:, 0] >= 0) & (r[:, 3] >= min_margin)
            names = [m.langs[k] if y else None for k, y in zip(r[:, 0], ok, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(r[:, 1]), pa.array(r[:, 2]), pa.array(r[:, 3]), pa.array(ok)], ["doc_id", "predicted", "n_words", "cost", "margin", "accepted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("t")).mapInArrow(lean(run), SCHEMA)


def accepted_only(docs: DataFrame, model: Model, min_margin: int = MIN_MARGIN) -> DataFrame:
    """docs without the rows that identify rejects; columns as they are, in one pass without a shuffle."""
    shared, name = share(docs.sparkSession, model), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def accept(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = kept("langid", name, lambda: Memo(len(shared.value.langs), dtype=np.int64))
        for s in texts:
            r = shared.value.texts([t or "" for t in s], memo)
            yield pd.Series((r[:, 0] >= 0) & (r[:, 3] >= min_margin))
        give_back()

    return docs.where(accept(F.lower(docs["text"])))


SQL = rf"""
WITH sample AS (SELECT lang, text FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(doc_id, ':5')), doc_id) AS rn
    FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL) WHERE rn <= {PER_LANG}),
words AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM sample) GROUP BY lang, w),
orders AS (SELECT unnest([1, 2, 3, 4, 5]) AS o),
pads AS (SELECT lang, n, o, CASE WHEN o = 1 THEN w ELSE '_' || w || '_' END AS p FROM words, orders),
grams AS (SELECT lang, o, n, unnest(list_transform(range(1, length(p) - o + 2), lambda i: substring(p, i, o))) AS g FROM pads),
counts AS (SELECT 0 AS o, lang, w AS g, n FROM words UNION ALL SELECT o, lang, g, sum(n) AS n FROM grams GROUP BY o, lang, g),
model AS (SELECT o, g, lang, CAST(round(1000 * (ln(t) - ln(n))) AS BIGINT) AS s
    FROM (SELECT *, sum(n) OVER (PARTITION BY o, lang) AS t FROM counts) WHERE n >= {MIN_COUNT}),
langs AS (SELECT DISTINCT lang FROM model),
items AS (SELECT DISTINCT o, g FROM model),
full_model AS (SELECT o, g, l.lang, coalesce(m.s, {PENALTY}) AS s FROM items CROSS JOIN langs l LEFT JOIN model m USING (o, g, lang)),
tokens AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS w FROM documents) GROUP BY doc_id, w),
seen AS (SELECT DISTINCT w FROM tokens),
new_grams AS (SELECT w, o, unnest(list_transform(range(1, length(p) - o + 2), lambda i: substring(p, i, o))) AS g
    FROM (SELECT w, o, CASE WHEN o = 1 THEN w ELSE '_' || w || '_' END AS p FROM (SELECT w FROM seen ANTI JOIN (SELECT g AS w FROM items WHERE o = 0) USING (w)), orders)),
hits AS (SELECT w, o, g FROM new_grams SEMI JOIN items USING (o, g)),
top AS (SELECT w, max(o) AS o FROM hits GROUP BY w),
back AS (SELECT h.w, f.lang, CAST(sum(f.s) AS BIGINT) // count(*) AS s FROM hits h JOIN top USING (w, o) JOIN full_model f ON f.o = h.o AND f.g = h.g GROUP BY h.w, f.lang),
costs AS (SELECT g AS w, lang, s FROM full_model WHERE o = 0 UNION ALL SELECT w, lang, s FROM back),
totals AS (SELECT doc_id, lang, sum(c * s) AS s, sum(c) AS n FROM tokens JOIN costs USING (w) GROUP BY doc_id, lang),
ranked AS (SELECT doc_id, lang, s, n, row_number() OVER w AS rn, CASE WHEN (SELECT count(*) FROM langs) > 1 THEN lead(s) OVER w ELSE s + {PENALTY} * n END AS s2 FROM totals WINDOW w AS (PARTITION BY doc_id ORDER BY s, lang))
SELECT d.doc_id, CASE WHEN r.s2 - r.s >= {MIN_MARGIN} * r.n THEN r.lang END AS predicted, CAST(coalesce(r.n, 0) AS BIGINT) AS n_words, CAST(coalesce(r.s // r.n, 0) AS BIGINT) AS cost,
    CAST(coalesce((r.s2 - r.s) // r.n, 0) AS BIGINT) AS margin, coalesce(r.s2 - r.s >= {MIN_MARGIN} * r.n, false) AS accepted
FROM documents d LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (doc_id)
"""

"""Quality classification with supervised subword embeddings.

A document is the average of learned vectors: of its words, its word pairs and the character n-grams of its words, all
hashed into one table. A softmax over classes sits on top, and both are fitted by stochastic gradient descent in numpy.
At prediction the table and the output layer fold into one number for each bucket, so a word costs a look-up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import hash_order, share, table
from ._text import CHUNKS, U64, Codes, Memo, batches, distinct, mix

BUCKETS = 1 << 18
DIM = 16
GRAMS = (3, 4, 5)
#: At most so many labelled documents of either class are learned from.
PER_CLASS = 1000
EPOCHS = 6
RATE = 0.5
RESULT = "doc_id bigint, p_high double, high boolean"


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U64(BUCKETS - 1)).astype(np.int64)


def _word_features(c: Codes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the given words and of their character n-grams, with the word's place. N-grams know if they touch an end."""
    buckets, words = [_bucket(c.hashes(starts, ends))], [np.arange(len(starts))]
    for n in GRAMS:
        count = np.maximum(ends - starts - (n - 1), 0)
        word = np.repeat(np.arange(len(starts)), count)
        at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
        edge = (at == starts[word]).astype(U64) + U64(2) * (at + n == ends[word]).astype(U64)
        buckets.append(_bucket(mix(c.hashes(at, at + n) ^ (edge + U64(1)))))
        words.append(word)
    return np.concatenate(buckets), np.concatenate(words)


def _pairs(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of word pairs; a word after itself is a feature of its own kind."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = docs[1:] == docs[:-1]
    h = np.where(hashes[1:] == hashes[:-1], U64(7), hashes[:-1] * U64(0xD6E8FEB86659FD93) + hashes[1:])
    return _bucket(mix(h[same])), docs[1:][same]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of all its features."""
    c = Codes([text])
    starts, ends, doc = c.spans(CHUNKS)
    words, _ = _word_features(c, starts, ends)
    pairs, _ = _pairs(c.hashes(starts, ends), doc)
    buckets, times = np.unique(np.concatenate([words, pairs]), return_counts=True)
    return buckets.astype(np.int32), (times / max(1, times.sum())).astype(np.float32)


@dataclass
class Model:
    """weight[b]: what a feature in bucket b adds to the log odds of the high class."""

    weight: np.ndarray
    bias: float

    def texts(self, texts: list[str], memo: Memo) -> np.ndarray:
        out = np.empty(len(texts))
        for i, j in batches(texts):
            c = Codes(texts[i:j])
            starts, ends, doc = c.spans(CHUNKS)
            h = c.hashes(starts, ends)
            keys, first, inverse = distinct(h)

            def compute(new: np.ndarray, c=c, s=starts[first], e=ends[first]) -> np.ndarray:
                buckets, word = _word_features(c, s[new], e[new])
                return np.stack([np.bincount(word, self.weight[buckets], len(new)), np.bincount(word, minlength=len(new))], 1)

            values = memo.get(keys, compute)[inverse] if len(keys) else np.zeros((0, 2))
            pairs, of = _pairs(h, doc)
            total = np.bincount(doc, values[:, 0], j - i) + np.bincount(of, self.weight[pairs], j - i)
            count = np.bincount(doc, values[:, 1], j - i) + np.bincount(of, minlength=j - i)
            out[i:j] = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(texts: list[str], labels: np.ndarray, seed: int = 9) -> Model:
    """labels: 1 high, 0 low. With one class only, everything is put in it; with none, everything is high."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -5.0 if len(labels) and labels[0] == 0 else 5.0)
    r = np.random.default_rng(seed)
    docs = [features(t) for t in texts]
    embedding = r.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in r.permutation(len(docs)):
            buckets, share_of = docs[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            hidden = share_of @ embedding[buckets]
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1  # gradient of the loss by z
            back = p @ output
            output -= rate * np.outer(p, hidden)
            bias -= rate * p * np.float32(0.1)
            # Shares are small; scaled by the number of features, a vector moves as far as it would for one word alone.
            embedding[buckets] -= (rate * share_of * np.float32(len(buckets) ** 0.5))[:, None] * back
    return Model((embedding @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """(text, y) of at most per_class (up to 1,000) documents of each label, drawn by hash of doc_id; whole texts.

    Rows of labels with a null take no part; a doc_id labelled both ways counts for both; rows of docs without doc_id or
    text are not drawn.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("lid"), F.col(label).cast("int").alias("y")).where("lid is not null and y is not null").distinct()
    ranked = known.withColumn("rn", F.row_number().over(Window.partitionBy("y").orderBy(hash_order("lid", seed), "lid")))
    chosen = table(ranked.where(F.col("rn") <= per_class).select("lid", "y"))
    d = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text")).where("id is not null and text is not null")
    return d.join(F.broadcast(chosen), F.col("id") == F.col("lid")).select("id", "text", "y")  # bounded by per_class


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 9) -> Model:
    """Fits on at most per_class (up to 1,000) labelled documents of either kind, drawn by hash of doc_id; whole texts.

    What takes no part is as in sample(); where that leaves one kind only, or none, the model is as in fit().
    """
    rows = sample(docs, labels, "quality", per_class, seed).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    return fit(rows["text"].to_pylist(), rows["y"].to_numpy().astype(np.int64), seed)


def classify(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_high, high) for each row of docs; high where p_high is threshold or more.

    A null, empty or blank text has no feature, so nothing speaks for it: p_high is 0. Rows without doc_id and repeated
    rows are classified like any other; other columns are not looked at.
    """
    shared = share(docs.sparkSession, model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(2)
        for b in stream:
            texts = [t or "" for t in b.column(1).to_pylist()]
            p = shared.value.texts(texts, memo)
            p[[not t.strip() for t in texts]] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= threshold)], ["doc_id", "p_high", "high"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, RESULT)

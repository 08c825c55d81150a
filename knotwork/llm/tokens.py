"""Token counts by byte-pair merging with a heap and a linked list.

A text is split into pieces by the vocabulary's pattern; within a piece the adjacent pair of lowest rank is merged again
and again. Only the number of tokens is computed: initial bytes minus merges. Texts are split a batch at a time, on arrays
of code points, and each different piece of a batch is counted once.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import share
from ._text import Codes, Memo, batches, distinct, kept, lean

#: The file of the vocabulary; the environment may name another.
VOCABULARY = os.environ.get("KNOTWORK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = "doc_id bigint, n_tokens bigint"
#: Texts that are Python objects at once.
ROWS = 1_000
OTHER, LETTER, NUMBER, SPACE = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> list[int | None]:
    """The rank of each two bytes, the first of which counts 256."""
    return [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]


def count_piece(piece: bytes, ranks: dict[bytes, int], pairs: list[int | None]) -> int:
    """Tokens of one piece. Of equal ranks the leftmost pair is merged first."""
    n = left = len(piece)
    if n < 2:
        return n
    get = ranks.get
    heap = [(r, i, i + 2) for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False)) if (r := pairs[a << 8 | b]) is not None]
    heapify(heap)
    end = list(range(1, n + 1))  # of the symbol that begins here, where the next one begins; 0: merged away
    previous = list(range(-1, n))
    while heap:
        _, i, e = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue  # one of the two has changed since
        end[i], end[j] = e, 0
        left -= 1
        previous[e] = i
        if e < n and (r := get(piece[i : end[e]])) is not None:
            heappush(heap, (r, i, end[e]))
        if i and (r := get(piece[previous[i] : e])) is not None:
            heappush(heap, (r, previous[i], e))
    return left


def character_classes() -> np.ndarray:
    """The class of every code point, as the pattern's library tells letters, numbers and white space."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def split(c: Codes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the pieces that PATTERN cuts the texts into, in no order.

    A piece is a run of one class. A run of white space that something follows leaves its last character: a plain space goes
    to the next run, another is a piece. A lone apostrophe takes one of its endings from the letters after it.
    """
    codes = c.codes
    if not len(codes):
        none = np.zeros(0, np.int64)
        return none, none, none
    kinds = classes[codes]
    new = np.ones(len(codes), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    at = c.offsets[:-1]
    new[at[at < len(codes)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(codes))
    kind = kinds[start]
    text = np.searchsorted(c.offsets, start, "right") - 1
    follows = np.zeros(len(start), bool)  # a run of the same text comes next
    follows[:-1] = text[1:] == text[:-1]
    space = kind == SPACE
    # White space before something: all but the last character, and the last.
    before = space & follows
    last_plain = codes[end - 1] == 32
    long = before & (end - start > 1)
    alone = before & ~last_plain
    prefixed = np.zeros(len(start), bool)
    prefixed[1:] = (before & last_plain)[:-1]
    starts, ends = start - prefixed, end.copy()
    # Endings: 's 't 'm 'd 're 've 'll, where the apostrophe begins a piece.
    quote = np.flatnonzero((kind == OTHER) & (end - start == 1) & (codes[start] == 39) & ~prefixed & follows)
    quote = quote[kind[quote + 1] == LETTER]
    a = codes[start[quote + 1]]
    there = start[quote + 1] + 1 < end[quote + 1]
    b = np.where(there, codes[np.minimum(start[quote + 1] + 1, len(codes) - 1)], 0)
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    taken = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, np.where(two, 2, 0))
    ends[quote] += taken
    starts[quote + 1] += taken
    whole = ~before & (starts < ends)
    return (
        np.concatenate([starts[whole], start[long], end[alone] - 1]),
        np.concatenate([ends[whole], end[long] - 1, end[alone]]),
        np.concatenate([text[whole], text[long], text[alone]]),
    )


class Counter:
    """Token counts of texts; counts of pieces are kept by hash, in bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, classes: np.ndarray | None):
        self.ranks, self.pairs = ranks, pair_ranks(ranks)
        self.find, self.classes = regex.compile(pattern).findall, classes
        self.memo = Memo(1, dtype=np.int64)

    def piece(self, piece: str) -> int:
        return count_piece(piece.encode("utf-8", "surrogatepass"), self.ranks, self.pairs)

    def texts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, j in batches(texts, 300_000):
            if self.classes is None:  # another pattern: the library splits
                pieces = [self.find(t) for t in texts[i:j]]
                text = np.repeat(np.arange(j - i), list(map(len, pieces)))
                c = Codes([p for each in pieces for p in each])
                starts, ends = c.offsets[:-1], c.offsets[1:]
                joined = "".join(p for each in pieces for p in each)
            else:
                c = Codes(texts[i:j])
                starts, ends, text = split(c, self.classes)
                joined = "".join(texts[i:j])
            if not len(starts):
                continue
            keys, first, inverse = distinct(c.hashes(starts, ends))
            n = self.memo.get(keys, lambda new: np.array([self.piece(joined[starts[f] : ends[f]]) for f in first[new]]))[:, 0]
            out[i:j] = np.bincount(text, weights=n[inverse], minlength=j - i).astype(np.int64)
        return out


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) for each row of docs; the vocabulary is a file of base64 tokens with ranks, read by the driver.

    Null and empty texts have 0 tokens. Rows without doc_id have their row, with a null doc_id; repeated rows have one
    each, and equal texts equal counts. Other columns are not looked at.
    """
    name = uuid.uuid4().hex
    shared = share(docs.sparkSession, (load_ranks(vocabulary), character_classes() if pattern == PATTERN else None))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept("tokens", name, lambda: Counter(shared.value[0], pattern, shared.value[1]))
        for b in stream:
            for part in (b.slice(k, ROWS) for k in range(0, b.num_rows, ROWS)):
                n = counter.texts([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(run), RESULT)

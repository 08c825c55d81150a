"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks, trained on labelled sentences.

The kernel of two strings counts the subsequences of four characters that they share; each occurrence weighs LAMBDA for
every character that it skips, and spans at most SPAN characters. So an insult with characters put between its own, or with
other endings, still resembles itself. Landmarks give strings coordinates in which a linear machine is trained.

Sentences bear the labels of their documents, so they are learned from as bags of parts (a multiple-instance machine): a part
is a word without its outer or without all its marks, or some short pieces joined, and the decision of a sentence is that of
its most toxic part. Of a clean sentence every part is an example; of a toxic one the part that the machine of the turn
before finds most toxic. A part is looked at in windows of WINDOW characters, half of that apart, and counts as its most toxic
window; most parts are one window. The decision of a window is a sum over its subsequences, so it folds into weights for the
subsequences of the landmarks, and scoring needs no kernel evaluation at all.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import share
from ._text import CHUNKS, U64, WORDS, Codes, Memo, batches, distinct, kept
from .quality import sample

ORDER = 4
SPAN = 8
LAMBDA = 0.6
LANDMARKS = 160
PER_CLASS = 1000
WINDOW = 32
#: Unknown words of at most so many characters may be pieces of one.
PIECE = 4
RESULT = "doc_id bigint, toxic boolean, score double, hits bigint"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

_OFFSETS = np.array([(0, *c) for c in combinations(range(1, SPAN), ORDER - 1)])
_DECAY = (LAMBDA ** (_OFFSETS[:, -1] + 1 - ORDER)).astype(np.float32)


@dataclass
class Alphabet:
    """Places of characters: 0 none, 1 start, 2 end, then each character of some strings; no other can be in what they share."""

    codes: np.ndarray  # sorted code points

    @property
    def size(self) -> int:
        return len(self.codes) + 3

    @classmethod
    def of(cls, strings: Iterable[str]) -> Alphabet:
        return cls(np.array(sorted({ord(c) for s in strings for c in s}), np.int64))

    def encode(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all strings end to end, each with its start, its end and SPAN zeros, and where each begins."""
        c = Codes(strings)
        lengths = np.diff(c.offsets)
        starts = np.cumsum(lengths + 2 + SPAN) - (lengths + 2 + SPAN)
        out = np.zeros(int((lengths + 2 + SPAN).sum()), np.int64)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, c.codes), len(self.codes) - 1)
            place = np.where(self.codes[at] == c.codes, at + 3, 0)
        else:
            place = np.zeros(len(c.codes), np.int64)
        out[np.arange(len(c.codes)) + np.repeat(starts + 1 - c.offsets[:-1], lengths)] = place
        out[starts] = 1
        out[starts + lengths + 1] = 2
        return out, starts


def _subsequences(places: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.float32]]:
    """For each pattern of gaps: where there is such a subsequence, its number, and its weight."""
    n = len(places) - SPAN + 1
    if n <= 0:
        return
    firsts = np.flatnonzero(places[:n] > 0)
    columns = [places[firsts + k] for k in range(SPAN)]
    there = [c > 0 for c in columns]
    for offsets, weight in zip(_OFFSETS, _DECAY, strict=True):
        ok = np.flatnonzero(there[offsets[1]] & there[offsets[2]] & there[offsets[3]])
        number = columns[0][ok]
        for o in offsets[1:]:
            number = number * size + columns[o][ok]
        yield firsts[ok], number, weight


class Keys:
    """A set of subsequence numbers; a filter keeps most that aren't in it from being searched for."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # sorted
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self._slots(keys)] = True

    @staticmethod
    def _slots(numbers: np.ndarray) -> np.ndarray:
        return ((numbers.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(44)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the numbers are in the set, and their places there."""
        maybe = np.flatnonzero(self.filter[self._slots(numbers)])
        at = np.minimum(np.searchsorted(self.keys, numbers[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == numbers[maybe] if len(self.keys) else np.zeros(0, bool)
        return maybe[ok], at[ok]


def _landmark_table(landmarks: list[str], alphabet: Alphabet) -> tuple[Keys, np.ndarray, np.ndarray]:
    """The landmarks' subsequences, the weight of each in each landmark, and the landmarks' norms."""
    places, starts = alphabet.encode(landmarks)
    rows, columns, values = [], [], []
    for at, number, weight in _subsequences(places, alphabet.size):
        rows.append(number)
        columns.append(np.searchsorted(starts, at, "right") - 1)
        values.append(np.full(len(number), weight))
    keys, inverse = np.unique(np.concatenate(rows), return_inverse=True) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    table = np.zeros((len(keys), len(landmarks)))
    if rows:
        np.add.at(table, (inverse, np.concatenate(columns)), np.concatenate(values))
    return Keys(keys), table, np.sqrt((table**2).sum(0)) + 1e-12


def kernel(strings: list[str], landmarks: list[str], alphabet: Alphabet) -> np.ndarray:
    """Subsequence kernel of each string with each landmark, landmarks scaled to a norm of 1."""
    keys, table, norms = _landmark_table(landmarks, alphabet)
    table = table / norms
    out = np.zeros((len(strings), len(landmarks)))
    for i in range(0, len(strings), 5_000):
        places, starts = alphabet.encode(strings[i : i + 5_000])
        for at, number, weight in _subsequences(places, alphabet.size):
            hit, k = keys.find(number)
            for j in range(0, len(hit), 100_000):
                part = slice(j, j + 100_000)
                np.add.at(out, i + np.searchsorted(starts, at[hit[part]], "right") - 1, weight * table[k[part]])
    return out


def fold(weights: np.ndarray, landmarks: list[str], alphabet: Alphabet) -> tuple[Keys, np.ndarray]:
    """What each subsequence adds to the decision sum_j weights[j] * kernel(., landmark j); others add nothing."""
    keys, table, norms = _landmark_table(landmarks, alphabet)
    return keys, (table @ (weights / norms)).astype(np.float32)


def windows(string: str) -> list[str]:
    return [string[k : k + WINDOW] for k in range(0, max(1, len(string) - WINDOW // 2), WINDOW // 2)]


_PUNCTUATION = re.compile(r"[\W_]+")


def variants(chunk: str) -> list[str]:
    """The strings that stand for a run of non-space characters: itself without outer marks, and without inner ones."""
    bare = _PUNCTUATION.sub("", chunk)
    if not bare:
        return []
    i, j = 0, len(chunk)
    while not chunk[i].isalnum():
        i += 1
    while not chunk[j - 1].isalnum():
        j -= 1
    inner = chunk[i:j]
    return windows(inner) if inner == bare else windows(inner) + windows(bare)


def sentence_starts(c: Codes, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the chunks begin a sentence: after a mark that ends one, a new line, or another text."""
    first = np.ones(len(starts), bool)
    lines = np.append(0, np.cumsum(c.codes == 10))
    first[1:] = (doc[1:] != doc[:-1]) | np.isin(c.codes[ends[:-1] - 1], [ord(x) for x in ".!?"]) | (lines[starts[1:]] > lines[ends[:-1]])
    return first


@dataclass
class Model:
    """known: sorted hashes of words that clean sentences have; these are not pieces of others."""

    alphabet: Alphabet
    keys: Keys
    values: np.ndarray
    bias: float
    known: np.ndarray

    def strings(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        for i in range(0, len(strings), 20_000):
            places, starts = self.alphabet.encode(strings[i : i + 20_000])
            sums = np.zeros(len(places) + 1, np.float64)
            for at, number, weight in _subsequences(places, self.alphabet.size):
                hit, k = self.keys.find(number)
                sums[at[hit] + 1] += weight * self.values[k]
            np.cumsum(sums, out=sums)
            out[i : i + 20_000] += sums[np.append(starts[1:], len(places))] - sums[starts]
        return out

    def chunks(self, chunks: list[str]) -> np.ndarray:
        """The greatest score of each chunk's variants; a chunk without letters or digits scores -inf."""
        owner, strings = [], []
        for k, c in enumerate(chunks):
            v = variants(c)
            strings += v
            owner += [k] * len(v)
        out = np.full(len(chunks), -np.inf)
        if strings:
            np.maximum.at(out, owner, self.strings(strings))
        return out

    def texts(self, texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Greatest score of a sentence and number of positive sentences of each text, in lower case."""
        best, hits = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        for i, j in batches(texts):
            c = Codes(texts[i:j])
            starts, ends, doc = c.spans(CHUNKS)
            if not len(starts):
                continue
            joined = "".join(texts[i:j])
            keys, first, inverse = distinct(c.hashes(starts, ends))
            score = memo.get(keys, lambda new: self.chunks([joined[starts[f] : ends[f]] for f in first[new]]))[:, 0][inverse]
            # Pieces of a word: single characters, and short words that clean sentences lack; two or more in a row are joined.
            letters = np.append(0, np.cumsum(c.member(WORDS)))
            bare = letters[ends] - letters[starts]
            at = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
            strange = (self.known[at] != keys)[inverse] if len(self.known) else np.ones(len(starts), bool)
            piece = (bare == 1) | ((bare > 0) & (bare <= PIECE) & strange)
            follows = np.zeros(len(piece) + 1, bool)
            follows[1:-1] = piece[1:] & piece[:-1] & (doc[1:] == doc[:-1])
            run, end = np.flatnonzero(~follows[:-1] & follows[1:]), np.flatnonzero(follows[:-1] & ~follows[1:])
            long = letters[ends[end]] - letters[starts[run]] >= ORDER
            run, end = run[long], end[long]
            if len(run):
                v = self.chunks([_PUNCTUATION.sub("", joined[starts[a] : ends[b]]) for a, b in zip(run, end, strict=True)])
                np.maximum.at(score, run, v)
            np.maximum.at(best, i + doc, score)
            sentence = np.cumsum(sentence_starts(c, starts, ends, doc)) - 1
            toxic, where = np.unique(sentence[score > 0], return_index=True)
            hits[i:j] += np.bincount(doc[score > 0][where], minlength=j - i)
        return best, hits


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Linear support vector machine, squared hinge loss, by Newton steps over the active set; x's last column is constant."""
    w, keep = np.zeros(x.shape[1]), np.ones(x.shape[1])
    keep[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        return float(keep @ v**2 / 2 + cost @ np.maximum(0, 1 - y * (x @ v)) ** 2)

    now = loss(w)
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, c = x[active], 2 * cost[active]
        step = np.linalg.solve((xa * c[:, None]).T @ xa + np.diag(keep), xa.T @ (c * y[active])) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) >= now:
            size /= 2
        new = loss(w + size * step)
        if new >= now * (1 - 1e-6):
            break
        w, now = w + size * step, new
    return w


def obfuscations(s: str, seed: int) -> list[str]:
    """s with a character put in at one place, and at every place."""
    r = np.random.default_rng(seed)
    k = 1 + int(r.integers(max(1, len(s) - 1)))
    return [s[:k] + "xqjz"[int(r.integers(4))] + s[k:], "-".join(s)]


def _sentences(texts: list[str]) -> list[list[set[str]]]:
    """The parts of each sentence of each text."""
    return [[{v for chunk in sentence.split() for v in variants(chunk)} for sentence in SENTENCE.split(t.lower())] for t in texts]


def fit(texts: list[str], labels: np.ndarray, turns: int = 3, seed: int = 2) -> Model:
    """labels: 1 toxic, 0 clean, of texts in any case; their sentences bear them.

    Which part of a toxic sentence witnesses its label is settled in turns. At first it is the part whose character runs are
    commonest in toxic sentences against clean ones, in the sentences where that is clear and in the one of each toxic text
    where it is most so; then it is what the machine of the turn before scores highest in every sentence that it finds toxic, and in the likeliest one
    of a text in which it finds none. A part that clean texts have is no witness, unless it is far commoner in toxic
    ones: labels err. Without both labels nothing is toxic.
    """
    y = np.asarray(labels) == 1
    bags = _sentences(texts)
    toxic_docs = [b for b, t in zip(bags, y, strict=True) if t]
    clean_docs = [b for b, t in zip(bags, y, strict=True) if not t]
    in_clean, in_toxic = (Counter(p for b in docs for p in set().union(*b)) for docs in (clean_docs, toxic_docs))
    chunks = Counter(c for t, toxic in zip(texts, y, strict=True) if not toxic for c in set(t.lower().split()))
    known = Codes(sorted(c for c, n in chunks.items() if n > 1))
    known = np.unique(known.hashes(known.offsets[:-1], known.offsets[1:]))
    none = Model(Alphabet.of(()), Keys(np.zeros(0, np.int64)), np.zeros(0, np.float32), -1.0, known)
    a, b = len(toxic_docs), len(clean_docs)
    if not a or not b:
        return none
    clean = {p for p, n in in_clean.items() if in_toxic[p] < 5 or in_toxic[p] * b < 8 * n * a}

    @lru_cache(maxsize=20_000)
    def runs(s: str) -> frozenset[str]:
        s = f"^{s}$"
        return frozenset(s[k : k + n] for n in (4, 5) for k in range(len(s) - n + 1))

    sentences = {True: [s for d in toxic_docs for s in d if s], False: [s for d in clean_docs for s in d if s]}
    times = {kind: Counter(g for s in of for g in set().union(*map(runs, s))) for kind, of in sentences.items()}
    share = {kind: max(1, len(of)) for kind, of in sentences.items()}
    # By how much a run's frequency among toxic sentences exceeds what clean ones make likely, and how sure that is.
    odds = {g: np.log((n + 0.1) / share[True]) - np.log((times[False][g] + 0.5) / share[False]) for g, n in times[True].items() if n >= 3}
    strength = {g: v * np.sqrt(times[True][g]) for g, v in odds.items() if v > 1.5}

    @cache
    def evidence(part: str) -> float:
        return max((strength.get(g, 0.0) for g in runs(part)), default=0.0)

    def most(parts: Iterable[str], score: Callable[[str], float]) -> tuple[float, str] | None:
        return max(((score(p), p) for p in parts if p not in clean), default=None)

    # What many toxic sentences and hardly any clean ones have tells of each sentence; otherwise of the text's likeliest one.
    telling = min((strength[g] for g, v in odds.items() if v > 4 and times[True][g] >= max(8, a // 50)), default=np.inf)
    witnesses: Counter = Counter()
    for doc in toxic_docs:
        found = [f for s in doc if (f := most(s, evidence)) and f[0] > 0]
        witnesses.update(p for v, p in found if v >= telling or v == max(found)[0])
    r = np.random.default_rng(seed)
    clean_parts = sorted(clean)
    # Hard clean parts: those that share the tell-tale runs, and a random lot.
    hard = sorted(clean_parts, key=lambda p: (-evidence(p), p))
    negatives = set(hard[:1500]) | {clean_parts[k] for k in r.permutation(len(clean_parts))[:4000]}
    toxic_parts = sorted(set(in_toxic) - clean)
    model = none
    for _ in range(turns):
        if not witnesses:
            return none
        order = sorted(witnesses, key=lambda p: (-witnesses[p], p))
        # Landmarks: the commonest witnesses, then the hardest clean parts.
        landmarks = order[: LANDMARKS * 2 // 3]
        landmarks += [p for p in hard if p not in witnesses][: LANDMARKS - len(landmarks)]
        alphabet = Alphabet.of(landmarks)
        variations = [(x, witnesses[p]) for k, p in enumerate(order) if len(p) >= 4 for x in obfuscations(p, seed + k)]
        strings = order + [x for x, _ in variations]
        often = np.sqrt([witnesses[p] for p in order] + [n for _, n in variations])
        n_toxic = len(strings)
        clean_ones = sorted(negatives - set(witnesses))
        strings += clean_ones
        # What many sentences vouch for weighs more than what one does; variations count less than what was seen.
        cost = np.concatenate([often * np.where(np.arange(n_toxic) < len(order), 2.0, 0.3), 4.0 * np.sqrt([in_clean[p] for p in clean_ones])])
        norms = _landmark_table(landmarks, alphabet)[2]
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks, alphabet) / norms[:, None])
        good = values > 1e-6 * values.max()
        project = vectors[:, good] / np.sqrt(values[good])
        x = np.hstack([kernel(strings, landmarks, alphabet) @ project, np.ones((len(strings), 1))])
        w = _svm(x, np.where(np.arange(len(strings)) < n_toxic, 1.0, -1.0), cost)
        model = Model(alphabet, *fold(project @ w[:-1], landmarks, alphabet), float(w[-1]), known)
        of_clean = model.strings(clean_parts)
        hard = [clean_parts[k] for k in np.argsort(-of_clean, kind="stable")]
        negatives |= set(hard[:1500])
        of_toxic = dict(zip(toxic_parts, model.strings(toxic_parts).tolist(), strict=True))
        witnesses = Counter()
        for doc in toxic_docs:
            found = [f for s in doc if (f := most(s, of_toxic.__getitem__))]
            toxic = [f for f in found if f[0] > 0] or [f for f in found if f == max(found) and f[0] > -0.5][:1]
            witnesses.update(p for _, p in toxic)
    # The threshold is where the fewest of the texts learned from are on the wrong side. Where a range does, it is a quarter up
    # from its lower end, since there are far more clean texts to come than were shown.
    parts = sorted(in_clean.keys() | in_toxic.keys())
    of = dict(zip(parts, model.strings(parts).tolist(), strict=True))
    score = np.array([max((of[p] for s in d for p in s), default=model.bias) for d in (*clean_docs, *toxic_docs)])
    order = np.argsort(score, kind="stable")
    toxic = order >= b
    wrong = np.cumsum(toxic) + (b - np.cumsum(~toxic))  # with the threshold above the k-th score
    ties = np.append(score[order][1:] == score[order][:-1], False)
    k = int(np.where(ties, len(order) + 1, wrong).argmin())
    low = float(score[order[k]])
    high = float(score[order[k + 1]]) if k + 1 < len(order) else low + 1.0
    model.bias -= low + (high - low) / 4
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 2) -> Model:
    """Fits on at most per_class (up to 1,000) labelled documents of either kind, drawn by hash of doc_id; whole texts."""
    rows = sample(docs, labels, "toxic", per_class, seed).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    return fit(rows["text"].to_pylist(), rows["y"].to_numpy(), seed=seed)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxic, score, hits) for each row of docs: toxic if some sentence of it is on the far side of the hyperplane.

    score is the greatest decision value of its sentences, hits the number of positive ones; 0 is not positive. A text that is
    null or has no letter or digit is clean, with a null score. Repeated rows and rows without doc_id are scored like any
    other; other columns are not looked at.
    """
    shared, name = share(docs.sparkSession, model), uuid.uuid4().hex

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept("toxicity", name, lambda: Memo(1, dtype=np.float32))
        for b in stream:
            best, hits = shared.value.texts([t or "" for t in b.column(1).to_pylist()], memo)
            value = pa.array(best, mask=np.isneginf(best))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best > 0), value, pa.array(hits)], ["doc_id", "toxic", "score", "hits"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("t")).mapInArrow(run, RESULT)

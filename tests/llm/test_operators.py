"""Operators against brute force, round trips and held-out labels."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import _classes, exact_dedup, langid, licenses, mixing, near_embeddings, ngram_join, packing, quality, queries, tokens, toxicity


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(names).collect())) == Counter(want.fetchall())


# 1. N-gram Jaccard join.
def ngrams(text, n=ngram_join.NGRAM):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_pairs(docs):
    """Pairs (least first) of different documents (doc_id, n-gram set) at the threshold, with their index."""
    want = {}
    for k, (a, x) in enumerate(docs):
        for b, y in docs[k + 1 :]:
            if x and y and min(len(x), len(y)) >= ngram_join.THRESHOLD * max(len(x), len(y)):
                j = len(x & y) / len(x | y)
                if j >= ngram_join.THRESHOLD:
                    want[min(a, b), max(a, b)] = j
    return want


def classes_of(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_ngram_join_recall(spark, sf):
    docs = [(r.doc_id, ngrams(r.text)) for r in documents(spark, sf).collect()]
    want = brute_pairs(docs)
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(documents(spark, sf)).collect()}
    assert sorted(rows) == sorted(i for i, _ in docs)
    links = Counter(i for p in want for i in p)
    assert want and all(r.links <= links[i] for i, r in rows.items())
    assert sum(r.links for r in rows.values()) >= 0.95 * sum(links.values())
    # Found pairs of different sets, and equal sets, make the classes.
    found = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.matches(documents(spark, sf)).collect()}
    assert all(want[p] == pytest.approx(j) for p, j in found.items())
    groups: dict = {}
    for i, x in docs:
        if x:
            groups.setdefault(frozenset(x), []).append(i)
    found |= {(min(g), i): 1.0 for g in groups.values() for i in g if i != min(g)}
    root = classes_of([i for i, _ in docs], found)
    assert {i: r.class_id for i, r in rows.items()} == root
    assert sorted(r.doc_id for r in ngram_join.one_of_each(documents(spark, sf)).collect()) == sorted(i for i, _ in docs if root[i] == i)


def test_ngram_join_counts_every_link_of_copies(spark):
    words = [f"w{k}" for k in range(40)]
    text = {0: " ".join(words), 1: " ".join([*words, "tail"]), 2: " ".join([*words[:38], "other", "end"])}
    rows = [(i, text[i % 3]) for i in range(30)]
    df = spark.createDataFrame([*rows, *rows[:7], (90, "alone in this"), (91, None), (92, " ,; ")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect())
    assert got == [*((i, 0, 29) for i in range(30)), (90, 90, 0), (91, 91, 0), (92, 92, 0)]
    assert sorted((r.doc_a, r.doc_b) for r in ngram_join.matches(df).collect()) == [(0, 1), (0, 2), (1, 2)]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(df).collect()) == [0, 0, 90, 91, 92]


def test_ngram_join_of_a_document_with_two_texts(spark):
    def text(k, tail):
        return " ".join([*(f"w{k}x{i}" for i in range(60)), *tail])

    # 5 is the lesser of a near pair by one text and the greater of another by its other text; its rows are repeated.
    rows = [(5, text(0, ["a"])), (5, text(1, ["a"])), (9, text(0, ["b"])), (2, text(1, ["b"])), (7, text(2, ["a"])), (7, text(3, ["a"])), (8, text(2, ["b"])), (8, text(3, ["b"]))]
    df = spark.createDataFrame([*rows, *rows[:3]], "doc_id bigint, text string")
    assert sorted((r.doc_a, r.doc_b, round(r.jaccard, 6)) for r in ngram_join.matches(df).collect()) == [(2, 5, j := round(58 / 60, 6)), (5, 9, j), (7, 8, j), (7, 8, j)]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(df).collect())
    assert got == [(2, 2, 1), (5, 2, 1), (5, 5, 1), (7, 7, 1), (7, 7, 1), (8, 7, 1), (8, 7, 1), (9, 5, 1)]
    # Each text is judged for itself: 5's first text stays, its second goes with 2's.
    kept = sorted((r.doc_id, r.text) for r in ngram_join.one_of_each(df).collect())
    assert kept == sorted([(2, text(1, ["b"])), (5, text(0, ["a"])), (5, text(0, ["a"])), (7, text(2, ["a"])), (7, text(3, ["a"]))])


def test_large_buckets_meet_in_blocks(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join([*words, f"tail{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(df, block=8).collect()) == [(i, 0, 59) for i in range(60)]
    pairs = ngram_join.matches(df, block=8).select("doc_a", "doc_b").collect()
    assert len(pairs) == len(set(pairs)) == 60 * 59 // 2


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101)], "a bigint, b bigint")
    assert {r.id: r.root for r in _classes.components(pairs).collect()} == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_bands():
    for t in (0.3, 0.5, 0.8):
        bands, rows = ngram_join.choose_bands(t, 0.95)
        assert 1 - (1 - t**rows) ** bands >= 0.95 and bands * rows <= 128
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.02, 0.96)


# 2. Toxicity.
INSULTS = ("idiot", "moron", "scumbag")


def sentences(n, seed):
    r = np.random.default_rng(seed)
    v = np.random.default_rng(0)
    vocabulary = ["".join(v.choice(list("abcdeghiklmnoprstu"), v.integers(3, 9))) for _ in range(400)]
    texts, y = [], []
    for k in range(n):
        words = list(r.choice(vocabulary, 40))
        if k % 4 == 0:
            for _ in range(2):
                words.insert(int(r.integers(len(words))), INSULTS[int(r.integers(3))])
        texts.append(" ".join(words) + ".")
        y.append(int(k % 4 == 0))
    return texts, np.array(y)


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.fit(*sentences(400, 1))


def test_toxicity_held_out(toxic_model):
    from knotwork.llm._text import Memo

    texts, y = sentences(400, 7)
    fresh = [re.sub("|".join(INSULTS), lambda m: m.group()[:2] + "x" + m.group()[2:], t) for t in texts]
    for version in (texts, fresh):
        score, _ = toxic_model.texts(version, Memo(1, dtype=np.float32))
        assert ((score > 0) == (y == 1)).mean() > 0.97
    for word in ("id-iot", "i.d.i.o.t", "mor*on", "i d i o t"):
        score, hits = toxic_model.texts([f"so you are such a {word} today"], Memo(1, dtype=np.float32))
        assert score[0] > 0 and hits[0] >= 1, word


def test_toxicity_of_pieces_and_long_runs(toxic_model):
    from knotwork.llm._text import Memo

    def hits(text):
        return int(toxic_model.texts([text], Memo(1, dtype=np.float32))[1][0])

    for word in ("i. d. i. o. t", "i, d, i, o, t", "id iot", "idi ot", "x" * 200 + "idiot" + "y" * 200):
        assert hits(f"so you are such a {word} today") >= 1, word
    assert hits("abcd " * 300 + "x" * 1000) == 0 and hits("a b c d e f g h i j k l m n") == 0
    # A hit is a sentence.
    assert hits("idiot idiot. fine here. moron\nscumbag") == 3


def test_toxicity_of_other_letters():
    texts, y = sentences(300, 3)
    swap = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")
    cyrillic = [t.translate(swap) for t in texts]
    from knotwork.llm._text import Memo

    model = toxicity.fit(texts + cyrillic, np.concatenate([y, y]))
    again, truth = sentences(200, 11)
    score, _ = model.texts([t.translate(swap) for t in again], Memo(1, dtype=np.float32))
    assert ((score > 0) == (truth == 1)).mean() > 0.97


def test_toxicity_folds_to_the_kernel():
    words = ["idiot", "morons", "plain", "x", "a-b-c-d", "idxiot", "идиот"]
    landmarks = ["idiot", "plain", "scum", "идиоты"]
    a = toxicity.Alphabet.of(landmarks)
    k = toxicity.kernel(words, landmarks, a)
    assert k == pytest.approx(toxicity.kernel(words, landmarks, toxicity.Alphabet.of(words + landmarks)))
    w = np.array([1.5, -2.0, 0.25, 1.0])
    model = toxicity.Model(a, *toxicity.fold(w, landmarks, a), 0.5, np.zeros(0, np.uint64))
    assert model.strings(words) == pytest.approx(k @ w + 0.5, abs=1e-4)

    def brute(s, t):  # every pair of subsequences
        from itertools import combinations

        def weights(x):
            x = f"^{x}$"
            out = Counter()
            for c in combinations(range(len(x)), toxicity.ORDER):
                if c[-1] - c[0] < toxicity.SPAN:
                    out["".join(x[i] for i in c)] += toxicity.LAMBDA ** (c[-1] - c[0] + 1 - toxicity.ORDER)
            return out

        p, q = weights(s), weights(t)
        return sum(v * q[g] for g, v in p.items()) / sum(v * v for v in q.values()) ** 0.5

    assert k == pytest.approx(np.array([[brute(x, t) for t in landmarks] for x in words]), rel=1e-4)


def test_toxicity_decides_as_its_parts_do(spark, sf):
    """The query's decisions against the scores of all parts of each text."""
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == docs.count()
    texts = {r.doc_id: [p for c in r.text.lower().split() for p in toxicity.variants(c)] for r in docs.collect()}
    every = sorted({p for parts in texts.values() for p in parts})
    score = dict(zip(every, model.strings(every), strict=True))
    for i, parts in texts.items():
        scores = [score[p] for p in parts]
        # A run of pieces can only add to what the chunks have.
        assert rows[i].score >= max(scores) - 1e-3 if scores else rows[i].score is None
        assert rows[i].toxic == ((rows[i].score or 0) > 0) == (rows[i].hits > 0)
        assert rows[i].toxic or max(scores, default=-1) <= 1e-3


def test_toxicity_on_held_out_labels(sf):
    sf = sf.replace("0.001", "0.1")
    rows = duckdb.sql(f"SELECT text, toxic FROM read_parquet('{sf}/documents.parquet') d JOIN read_parquet('{sf}/labels.parquet') l USING (doc_id) WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    from knotwork.llm._text import Memo

    texts, y = [r[0] for r in rows], np.array([r[1] for r in rows])
    fold = np.arange(len(y)) % 3
    chosen = np.concatenate([np.flatnonzero((fold > 0) & (y == c))[: toxicity.PER_CLASS] for c in (0, 1)])
    model = toxicity.fit([texts[k] for k in chosen], y[chosen])
    held = np.flatnonzero(fold == 0)
    score, _ = model.texts([texts[k].lower() for k in held], Memo(1, dtype=np.float32))
    said, true = score > 0, y[held] == 1
    precision, recall = (said & true).sum() / said.sum(), (said & true).sum() / true.sum()
    assert precision >= 0.75 and recall >= 0.9 and (said == true).mean() >= 0.95


# 3. Mixing.
def test_mixing_sizes(spark, sf):
    docs = documents(spark, sf)
    rows = mixing.sample(docs, {"src0": 3.0, "src1": 1.0}, 100).collect()
    copies = Counter()
    for r in rows:
        copies[r.source] += r.copies
    assert copies == {"src0": 75, "src1": 25}
    again = mixing.sample(docs.repartition(5), {"src0": 3.0, "src1": 1.0}, 100).collect()
    assert sorted(rows) == sorted(again)
    assert sorted(rows) != sorted(mixing.sample(docs, {"src0": 3.0, "src1": 1.0}, 100, seed=4).collect())


def test_mixing_inclusion(spark):
    # Sizes 1..: over many seeds, a document is chosen about as often as its share asks.
    df = spark.createDataFrame([(i, "x" * (2**i - 1), "s") for i in range(1, 8)], "doc_id bigint, text string, source string")
    count = Counter()
    for seed in range(6):
        rows = mixing.sample(df, {"s": 1.0}, 3, seed).collect()
        assert sum(r.copies for r in rows) == 3
        count.update({r.doc_id: r.copies for r in rows})
    assert count[7] > count[1] and count[7] <= 12


def test_mixing_is_of_fixed_size_whatever_repeats(spark):
    rows = [(1, "some text", "s")] * 9 + [(2, "other text", "s")] * 4 + [(3, "x", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    for total in range(1, 14):
        for seed in range(3):
            assert sum(r.copies for r in mixing.sample(df, {"s": 1.0}, total, seed).collect()) == total
    assert mixing.mixed(df, {"s": 1.0}, 5).count() == 5


# 4. Exact dedup.
def test_exact_dedup_with_meeting_digests(spark, sf):
    docs = documents(spark, sf)
    right = sorted(exact_dedup.find_duplicates(docs).collect())
    assert sorted(exact_dedup.find_duplicates(docs, digest_bits=4).collect()) == right
    kept = sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs, digest_bits=4).collect())
    assert kept == sorted(r.doc_id for r in right if r.doc_id == r.keep_id)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 1000)), max_size=300), st.integers(1, 20), st.integers(2, 4))
def test_index_keeps_the_least(entries, memtable, fanout):
    index = exact_dedup.Index(memtable, fanout)
    e = np.array([(k, k * 7, i) for k, i in entries], exact_dedup.ENTRY)
    for k in range(0, len(e), 13):
        index.add(e[k : k + 13])
    kept, hits, at = index.finish()
    least: dict = {}
    for k, i in entries:
        least[k] = min(i, least.get(k, i))
    assert {int(x["hi"]): int(x["id"]) for x in kept} == least
    assert len(kept) + len(hits) == len(entries) and (at >= 0).all()
    assert all(kept["hi"][a] == h["hi"] for a, h in zip(at, hits, strict=True))


# 5. Language ID.
def test_language_accuracy(spark, sf):
    docs = documents(spark, sf)
    model = langid.train(docs, per_lang=20)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs, model).collect()
    sure = [r for r in rows if r.accepted]
    assert len(sure) > 0.9 * len(rows)
    assert np.mean([truth[r.doc_id] == r.predicted for r in sure]) > 0.97


def test_one_language(spark):
    df = spark.createDataFrame([(1, "the one word", "en"), (2, "word the the", "en"), (3, "12 34", "en"), (4, "the 12", None)], "doc_id bigint, text string, lang string")
    rows = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    assert {i: r.accepted for i, r in rows.items()} == {1: True, 2: True, 3: False, 4: True} and rows[1].margin == langid.PENALTY
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert sorted(tuple(r[c] for c in r.__fields__) for r in rows.values()) == sorted(con.execute(langid.SQL).fetchall())
    many = spark.createDataFrame([(i, "word", f"l{i}") for i in range(langid.MAX_LANGS + 1)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(many)


# 6. Packing.
def encoder():
    ranks = tokens.load_ranks(tokens.VOCABULARY)
    return tiktoken.Encoding("test", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_packing_is_whole_and_tight(spark, sf):
    docs = documents(spark, sf)
    encode = encoder().encode_ordinary
    want = {r.doc_id: len(encode(r.text)) for r in docs.collect()}
    for capacity in (512, packing.CAPACITY):
        rows = packing.pack(docs, capacity=capacity).collect()
        size: Counter = Counter()
        of: Counter = Counter()
        for r in rows:
            size[r.bin] += r.tokens
            of[r.doc_id] += r.tokens
        assert of == Counter(want) and max(size.values()) <= capacity
        assert len(rows) == len({(r.doc_id, r.piece) for r in rows}) == sum(-(-t // capacity) for t in want.values())
        # Sizes are rounded up by less than GRAIN each, and the program's rounding leaves few bins more.
        least = sum(-(-t // packing.GRAIN) * packing.GRAIN for t in want.values()) / capacity
        assert len(size) <= 1.05 * least + 12
        assert sorted(size) == list(range(len(size)))


def test_packing_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BATCH", 7)
    df = spark.createDataFrame([(1, "a b c d e " * 9)] * 50 + [(2, "x " * 400)] * 3 + [(2, "y")], "doc_id bigint, text string")
    n = {1: tokens.token_counts(df).where("doc_id = 1").first().n_tokens, 2: 401}
    rows = packing.pack(df, capacity=64).collect()
    fill: Counter = Counter()
    for r in rows:
        fill[r.bin] += r.tokens
    assert max(fill.values()) <= 64 and sorted(fill) == list(range(len(fill)))
    assert sum(r.tokens for r in rows if r.doc_id == 1) == 50 * n[1]
    assert Counter(r.piece for r in rows if r.doc_id == 2 and r.tokens == 64) == {k: 3 for k in range(6)}


def test_plan_against_the_fewest_bins():
    from functools import cache

    r = np.random.default_rng(1)
    for _ in range(25):
        capacity = int(r.integers(8, 14))
        sizes = np.unique(r.integers(2, capacity, 3))
        demand = r.integers(1, 6, len(sizes))

        @cache
        def fewest(left, room, sizes=tuple(sizes.tolist()), capacity=capacity):
            if not any(left):
                return 0
            takes = [fewest(left[:k] + (left[k] - 1,) + left[k + 1 :], room - s) for k, s in enumerate(sizes) if left[k] and s <= room]
            return min([*takes, 1 + fewest(left, capacity)] if room < capacity else takes)

        exact = 1 + fewest(tuple(demand.tolist()), capacity)
        uses = packing.plan(sizes, demand, capacity)
        assert sum(c * times for c, times in uses).tolist() == demand.tolist()
        assert all(c @ sizes <= capacity for c, _ in uses)
        assert exact <= sum(times for _, times in uses) <= exact + 1
        # The fractional program is within two hundredths of the exact one when demands are large: bins of whole configurations.
        big = demand * 1000
        assert sum(times for _, times in packing.plan(sizes, big, capacity)) <= 1.02 * 1000 * exact + 1


def test_knapsack_against_brute_force():
    r = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.unique(r.integers(2, 9, 4))
        values, capacity = r.random(len(sizes)), int(r.integers(8, 20))

        def best(room, values=values, sizes=sizes):
            return max([0.0] + [values[k] + best(room - s) for k, s in enumerate(sizes) if s <= room])

        c = packing.best_configuration(values, sizes, capacity)
        assert c @ sizes <= capacity and c @ values == pytest.approx(best(capacity))


# 7. Tokens.
def test_tokens_against_an_encoder(spark, sf):
    encode = encoder().encode_ordinary
    docs = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(documents(spark, sf)).collect()}
    assert got == {i: len(encode(t)) for i, t in docs.items()}


CLASSES = tokens.character_classes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t'streveldmSX09.-é日\u00a0\u3000\u0301😀²") | st.characters(codec="utf-8"), max_size=14), max_size=6))
def test_split_against_the_pattern(texts):
    import regex

    from knotwork.llm._text import Codes

    start, end, text = tokens.split(Codes(texts), CLASSES)
    joined = "".join(texts)
    found: list = [[] for _ in texts]
    for a, b, k in sorted(zip(start.tolist(), end.tolist(), text.tolist(), strict=True)):
        found[k].append(joined[a:b])
    assert found == [regex.findall(tokens.PATTERN, t) for t in texts]


def test_tokens_with_another_pattern(spark):
    df = spark.createDataFrame([(1, "one two"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(df, pattern=r"\S|\s").collect()} == {1: 7, 2: 0, 3: 0}


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=0, max_size=30))
def test_piece_against_plain_merging(piece):
    ranks = test_piece_against_plain_merging.__dict__.setdefault("ranks", tokens.load_ranks(tokens.VOCABULARY))
    table = test_piece_against_plain_merging.__dict__.setdefault("table", tokens.pair_ranks(ranks))
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            break
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert tokens.count_piece(piece, ranks, table) == len(parts)


# 8. Licenses.
def edit_distance_in(text, notice):
    """Least edits between the notice and any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(licenses.NOTICES)), st.lists(st.tuples(st.sampled_from("isd"), st.integers(0, 200)), max_size=6), st.text("abc \n", max_size=40))
def test_licenses_with_edits(name, edits, around):
    notice = licenses.NOTICES[name].lower()
    text = notice
    for kind, at in edits:
        at %= max(1, len(text))
        text = text[:at] + ("" if kind == "d" else "#") + text[at + (kind != "i") :]
    text = f"{around} {text} {around}"
    found = {n: e for n, _, _, e in licenses.Scanner({name: licenses.NOTICES[name]}).scan(text)}
    d = edit_distance_in(text, notice)
    assert (name in found) == (d <= licenses.edits_allowed(notice))
    if found:
        assert found[name] == d


def test_license_spans(spark, sf):
    docs = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    rows = licenses.scan_licenses(documents(spark, sf)).collect()
    assert all(docs[r.doc_id][r.start : r.end] == r.matched for r in rows)
    for name, notice in licenses.NOTICES.items():
        for i, t in docs.items():
            if notice.lower() in t.lower():
                assert any(r.doc_id == i for r in rows), name


# 9. Quality.
def test_quality_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")  # labels are few
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    rows = sorted(docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect())
    texts, y = [r.text for r in rows], np.array([r.quality for r in rows])
    train, test = np.arange(len(y)) % 3 > 0, np.arange(len(y)) % 3 == 0
    from knotwork.llm._text import Memo

    model = quality.fit([t for t, k in zip(texts, train, strict=True) if k], y[train])
    p = model.texts([t for t, k in zip(texts, test, strict=True) if k], Memo(2))
    assert ((p >= 0.5) == (y[test] == 1)).mean() >= max(0.9, np.mean(y[test]) + 0.05)


def test_quality_folding():
    texts = ["good words here", "bad bad bad spam", "", "ünïcode text ok"]
    from knotwork.llm._text import Memo

    model = quality.fit(texts[:2] * 40, np.array([1, 0] * 40))
    p = model.texts(texts, Memo(2))
    for t, got in zip(texts, p, strict=True):
        buckets, share = quality.features(t)
        z = float(model.weight[buckets] @ share) + model.bias
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)
    assert p[0] > 0.5 > p[1]


# 10. Embeddings.
def test_embeddings_recall(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = r.normal(size=(400, 64))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = r.uniform(0.95, 0.97, (400, 1))
    x = np.vstack([base, cosine * base + np.sqrt(1 - cosine**2) * noise]).astype(np.float32)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T, 1) >= 0.9501), strict=True)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    rows = near_embeddings.matches(df).collect()
    got = {(r.vec_a, r.vec_b) for r in rows}
    assert len(want) >= 380 and len(got & want) >= 0.93 * len(want)
    assert all(float(x[r.vec_a] @ x[r.vec_b]) == pytest.approx(r.cosine, abs=1e-4) and r.cosine >= 0.95 for r in rows)


def test_embeddings_count_every_link_of_copies(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 32)).astype(np.float32)
    near = base + 0.02 * r.normal(size=base.shape).astype(np.float32)
    x = np.vstack([base, 2 * base, base, 4 * base, near, near])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    got = sorted(tuple(r) for r in near_embeddings.near_duplicates(df).collect())
    assert got == [(i, i % 12, int(links[i])) for i in range(72)] and set(links.tolist()) == {5}


def test_embeddings_of_the_table(spark, sf):
    """Every link and class of the tables' vectors, by brute force."""
    for folder in (sf, sf.replace("0.001", "0.01")):
        df = spark.read.parquet(f"{folder}/embeddings.parquet")
        rows = sorted(df.collect())
        x = np.array([r.embedding for r in rows], np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = np.argwhere(np.triu(unit @ unit.T >= near_embeddings.THRESHOLD, 1))
        ids = [r.vec_id for r in rows]
        root = classes_of(ids, [(ids[a], ids[b]) for a, b in near])
        links = Counter(ids[k] for p in near for k in p)
        assert sorted(tuple(r) for r in near_embeddings.near_duplicates(df).collect()) == [(i, root[i], links[i]) for i in sorted(ids)]


def test_embedding_blocks(spark):
    r = np.random.default_rng(4)
    x = np.array([1.0] * 16) + r.normal(size=(60, 16)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    pairs = near_embeddings.matches(df, block=8).collect()
    assert len(pairs) == len({(p.vec_a, p.vec_b) for p in pairs}) >= 0.97 * 60 * 59 / 2
    rows = near_embeddings.near_duplicates(df, block=8).collect()
    assert sum(r.links for r in rows) == 2 * len(pairs) and {r.class_id for r in rows} == {0}


def test_hadamard():
    for d in (1, 2, 4, 8, 16, 32, 64, 128, 256):
        m = np.ones((1, 1))
        while len(m) < d:
            m = np.block([[m, m], [m, -m]])
        x = np.random.default_rng(d).normal(size=(7, d)).astype(np.float32)
        assert near_embeddings.hadamard(x) == pytest.approx(x @ m / np.sqrt(d), abs=1e-5)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    assert np.linalg.norm(near_embeddings.rotate(x, 1), axis=1) == pytest.approx(np.linalg.norm(x, axis=1), rel=1e-5)


# The pipeline.
def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = documents(spark, sf)
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf).cache()
        assert out.columns == docs.columns
        seen.append(name)
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, [(r.doc_id, r.text) for r in at.collect()]
        if name == "language":
            assert ids == {r.doc_id for r in langid.identify(at, langid.train(at)).collect() if r.accepted}
        if name == "exact":
            first: dict = {}
            for i, t in before:
                first[t] = min(i, first.get(t, i))
            assert ids == set(first.values())
        if name == "near":
            assert out.count() == len(ids)
        if name == "mixture":
            assert out.count() == sum(r.copies for r in mixing.sample(at).collect())
        at = out
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(rows) == sorted(packing.pack(at).collect())

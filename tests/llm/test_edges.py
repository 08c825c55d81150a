"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and pipeline stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from knotwork.llm import exact_dedup, langid, licenses, mixing, near_embeddings, ngram_join, packing, quality, tokens, toxicity

LONG = "word another third " * 20_000
TEXT = "the quick brown fox jumps over the lazy dog near the river bank today"
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, rep string, hi string, lo string, size string, bands string, s string, whole string, target string, q string, cell string, take string, rest string, full string, shard string, keep_id string, hit string, place string, partners string, t string, l string, y string, lid string, cid string, copies string"
ODD = [
    (1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, TEXT, "en", None), (3, None, None, "a"), (4, "", "en", "a"), (5, "   \n", "fr", "b"), (None, TEXT, "en", "a"), (None, None, None, None),
    (6, LONG, "en", "b"), (7, "x", "de", "b"), (8, "日本語 テキスト 🙂", "ja", "c"), (9, TEXT + " again", "en", "a"), (10, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "en", "a"), (3, TEXT, "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = CLASH.split(", ")[5:]
    rows = [(*r, None if r[1] is None else len(r[1]), *("!" for _ in extra)) for r in ODD]
    df = spark.createDataFrame(rows, CLASH).persist()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 0, 1), (9, None, None), (None, 1, 1), (99, 1, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))


EVERY = sorted((r[0] for r in ODD), key=lambda x: (x is None, x))


def test_ngram_join(odd, none):
    rows = Counter(tuple(r) for r in ngram_join.near_duplicates(odd).collect())
    # 3 has a null and a text, 10 no more than a symbol, which is a word.
    assert rows == Counter([(1, 1, 3), (2, 1, 3), (3, 1, 3), (9, 1, 3), *((i, i, 0) for i in (3, 4, 5, 6, 7, 8, 10))])
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert ids(kept) == [1, 1, 3, 4, 5, 6, 7, 8, 10, None, None]
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.one_of_each(none).count() == 0 and ngram_join.matches(none).count() == 0


def test_exact_dedup(odd, none):
    found = [(r.doc_id, r.keep_id) for r in exact_dedup.find_duplicates(odd).collect()]
    assert sorted(found) == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (9, 9), (10, 10)]
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert ids(kept) == [1, 3, 4, 5, 6, 7, 8, 9, 10, None, None]
    assert exact_dedup.find_duplicates(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_langid(odd, none):
    model = langid.train(odd)
    rows = langid.identify(odd, model).collect()
    assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == EVERY
    assert all(not r.accepted and r.predicted is None for r in rows if r.doc_id in (4, 5) or r.n_words == 0)
    assert langid.accepted_only(odd, model).columns == odd.columns
    empty = langid.train(none)
    assert not any(r.accepted for r in langid.identify(odd, empty).collect())
    assert langid.accepted_only(odd, empty).count() == 0 and langid.identify(none, model).count() == 0


def test_mixing(odd, none):
    rows = mixing.sample(odd).collect()
    assert all(r.copies > 0 for r in rows) and not {4, None} & {r.doc_id for r in rows}
    got = mixing.mixed(odd)
    assert got.columns == odd.columns and got.count() == sum(r.copies for r in rows)
    assert {r.source for r in mixing.sample(odd, {"a": 1.0, "absent": 5.0}, 30).collect()} == {"a"}
    assert mixing.sample(odd, {}).count() == 0
    assert mixing.sample(none).count() == 0 and mixing.mixed(none).count() == 0


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 5, 6, 7, 8, 9, 10}
    fill: dict = {}
    for r in rows:
        fill[r.bin] = fill.get(r.bin, 0) + r.tokens
    assert max(fill.values()) <= packing.CAPACITY
    n = tokens.token_counts(odd).where("doc_id = 6").first().n_tokens
    assert sum(r.tokens for r in rows if r.doc_id == 6) == n > 60_000
    assert sorted(r.piece for r in rows if r.doc_id == 6) == list(range(-(-n // packing.CAPACITY)))
    assert packing.pack(none).count() == 0


def test_tokens(odd, none):
    rows = tokens.token_counts(odd).collect()
    assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == EVERY
    assert {r.n_tokens for r in rows if r.doc_id == 4} == {0} and all(r.n_tokens > 0 for r in rows if r.doc_id in (5, 6, 8))
    assert tokens.token_counts(none).count() == 0


def test_licenses(odd, none):
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0
    noted = odd.withColumn("text", F.concat("text", F.lit(" Licensed under CC BY 4.0 now")))
    assert {r.license for r in licenses.scan_licenses(noted).collect()} == {"CC-BY-4.0"}
    assert licenses.scan_licenses(noted).count() == sum(r[1] is not None for r in ODD)
    assert licenses.scan_licenses(noted, {}).count() == 0 and licenses.scan_licenses(noted, {"blank": " ", "none": ""}).count() == 0


def test_classifiers(odd, none, labels):
    for train, use in ((quality.train, quality.classify), (toxicity.train, toxicity.score)):
        model = train(odd, labels)
        rows = use(odd, model).collect()
        assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == EVERY
        assert use(none, model).count() == 0
        blank = train(none, labels.where("false"))
        assert len(use(odd, blank).collect()) == len(ODD)
    assert not any(r.toxic for r in toxicity.score(odd, toxicity.train(none, labels)).collect())
    assert {r.p_high for r in quality.classify(odd, quality.train(odd, labels)).collect() if r.doc_id in (4, 5)} == {0.0}
    one_class = quality.classify(odd, quality.train(odd, labels.where("quality = 1")))
    assert all(r.high for r in one_class.collect() if r.doc_id in (1, 2, 6))


def test_embeddings(spark):
    unit = [1.0] + [0.0] * 7
    near = [1.0, 0.05] + [0.0] * 6
    rows = [(1, unit), (1, unit), (2, [2 * x for x in unit]), (3, near), (4, None), (5, []), (6, [0.0] * 8), (7, [float("nan")] * 8), (8, [None] * 8), (9, [1.0, 0.0]), (None, unit), (10, [-x for x in unit]), (11, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "vec_id bigint, embedding array<double>, key string, vector string, label int")
    got = sorted(tuple(r) for r in near_embeddings.near_duplicates(df).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 1, 2), *((i, i, 0) for i in (4, 5, 6, 7, 8, 9, 10, 11))]
    assert [(r.vec_a, r.vec_b, r.cosine) for r in near_embeddings.matches(df).collect()] == [(1, 3, pytest.approx(1 / (1 + 0.05**2) ** 0.5, abs=1e-6))]
    assert near_embeddings.near_duplicates(df.where("false")).count() == 0


def test_pipeline_stages(spark, odd, none):
    import corpus_pipeline

    docs, empty = odd, none
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, nothing = stage(spark, docs, ""), stage(spark, empty, "")
        assert nothing.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
    assert out.columns == ["doc_id", "piece", "tokens", "bin"]

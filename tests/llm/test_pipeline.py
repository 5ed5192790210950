"""The pipeline's stages on a small corpus with planted cases, and the whole run on the smallest tables."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from tests.llm.fixtures import alnum_words, words_of
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_substring_dedup import brute as deduplicated
from textpairs.llm import language_id, packing
from textpairs.session import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9000, None, "en", "s", 0), (9001, "", None, None, None), (9002, "12 34 !!", "en", "s", 8), (9003, "one two three", "en", "s", 13), (9003, "one two three", "en", "s", 13), (None, "the and of to in that is", "en", "s", 5)]
    return materialize(d.unionByName(spark.createDataFrame(odd, d.schema)), "pipeline-test")


def test_stages_are_the_five_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontaminate", "best_fit_packing"]


def test_language_stage(spark, docs):
    got = cp.keep_known_language(spark, docs, SF)
    assert got.columns == COLUMNS
    pred = language_id.predict(docs, language_id.train(docs)).collect()
    want = Counter((r.doc_id, r.text) for r in pred if r.lang_pred != "und" and r.lang_score >= cp.LANGUAGE_LEAST)
    assert rows(got) == want
    gone = rows(docs) - rows(got)
    assert {9000, 9001, 9002} <= {i for i, _ in gone} and sum(gone.values()) < 8


def test_near_duplicate_stage(spark, docs):
    got = cp.drop_near_duplicates(spark, docs, SF)
    assert got.columns == COLUMNS
    every = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    keep = Counter(c for _, n, c in set(components(every)) if n)
    left = rows(got)
    assert {i for i, t in left if shingles(t)} == set(keep) and all(n == 1 for (_, t), n in left.items() if shingles(t))
    assert sum(n for (_, t), n in left.items() if not shingles(t)) == sum(not shingles(t) for _, t in every)


def test_substring_stage(spark, docs):
    got = cp.cut_repeated_passages(spark, docs, SF)
    assert got.columns == COLUMNS
    every = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    text = {(i, len(words_of(t))): t for i, t in every}
    want = Counter((i, kept if gone else text[(i, n)]) for i, n, gone, kept in deduplicated(every) if not n or gone < n)
    assert rows(got) == want
    assert all(r.n_chars is None or r.n_chars == len(r.text or "") for r in got.collect() if r.text)


def test_decontamination_stage(spark, docs):
    got = cp.drop_contaminated(spark, docs, SF)
    assert got.columns == COLUMNS
    every = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {i for i, _, h, _ in contaminated(every, items, 10) if h}
    assert hit and rows(got) == Counter((i, t) for i, t in every if i not in hit)


def test_run(spark):
    got = cp.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "pipeline-test")
    want = packing.pack_documents(docs).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got)) == Counter(map(key, want)) and len(got) > 50
    assert len({r.sequence_id for r in got}) == len({r.sequence_id for r in want})
    assert all(alnum_words(r.text) for r in docs.collect())


CLASHING = ["lang_pred", "lang_score", "n_words", "n_removed", "kept_text", "tkey", "id", "n_hit", "items", "root", "component_id", "n_shingles", "rank", "sid", "a.b", "__spans"]


def test_columns_of_the_caller_stay_as_they_are(spark, docs):
    """Columns named like those that stages add come through with their own values."""
    wide = docs.selectExpr("*", *[f"concat('{c} of ', coalesce(doc_id, -1)) as `{c}`" for c in CLASHING])
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, wide, SF)
        assert got.columns == [*COLUMNS, *CLASHING] and got.schema[5:] == wide.schema[5:]
        assert rows(got) == rows(stage(spark, docs, SF))
        odd = " or ".join(f"`{c}` <> concat('{c} of ', coalesce(doc_id, -1)) or `{c}` is null" for c in CLASHING)
        assert got.count() and got.filter(odd).count() == 0


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    for name, stage in cp.STAGES:
        got = stage(spark, none, SF)
        assert got.count() == 0 and (name == "best_fit_packing" or got.columns == COLUMNS)


def test_short_clean_texts_stay(spark, docs):
    """Signs and digits go; short texts of known languages stay."""
    clean = [(9100 + i, t, None, None, None) for i, t in enumerate(["the and of to in that is", "der die und in den von zu das", "de la que el en y a los"])]
    got = cp.keep_known_language(spark, docs.unionByName(spark.createDataFrame(clean + [(9200, "?? 12 -- 99", None, None, None)], docs.schema)), SF)
    left = {i for i, _ in rows(got)}
    assert {9100, 9101, 9102} <= left and 9200 not in left

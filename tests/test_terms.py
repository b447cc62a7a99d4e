"""Terms found on Arrow batches of texts against those of the array functions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewise import constants as K
from pricewise.functions import terms as TE
from pricewise.operators import tfidf as TF

TEXTS = ["", None, "a", "ab", "ab", "x1 1x the ab", "cd é efK12 OF THE abcdefgh abcdefghi", "abcdefghi abcdefgh ab ab ab ab", "İstanbul-İ 9 99 999",
         "twelve2bytes twelve3bytes twelve2bytes", "the and of", "日本ab語 cd", "abcdefgh ab" * 40, "z" * 200 + " " + "z" * 201]


def frames(spark):
    df = spark.createDataFrame([(i, t, "End" if i % 3 else None) for i, t in enumerate(TEXTS * 2)], "train_id long, name string, item_description string")
    return TF.listing_terms(df), TF.listing_texts(df)


@pytest.mark.parametrize("ngram_range", [(1, 1), (1, 2), (2, 2), (1, 3)])
def test_counts_of_texts_are_those_of_terms(spark, ngram_range):
    df = spark.createDataFrame([(i, t, "End" if i % 3 else None) for i, t in enumerate(TEXTS * 2)], "train_id long, name string, item_description string").repartition(3)
    want = {tuple(r) for r in TF.term_statistics(TF.listing_terms(df, ngram_range=ngram_range)).collect()}
    assert want and {tuple(r) for r in TF.text_statistics(TF.listing_texts(df), ngram_range).collect()} == want


@pytest.mark.parametrize("limits", [{}, {"STRETCH_BYTES": 16}, {"HELD_GRAMS": 4}, {"HELD_WORDS": 3}, {"BITS": 4}, {"ROW_BITS": 43, "STRETCH_ROWS": 2}])
def test_stretches_and_limits_change_nothing(monkeypatch, limits):
    def counted():
        found = {}
        for b in TE.count_grams([pa.RecordBatch.from_arrays([pa.array([t and t.lower() for t in part])], names=["t"]) for part in (TEXTS[:5], TEXTS[5:])], "t", K.STOPWORDS, 1, 2):
            for term, n, tf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = found.get(term, (0, 0))
                found[term] = a[0] + n, a[1] + tf
        return found

    want = counted()
    assert want["ab"] == (6, 9) and want["ab ab"][1] == 3 and "the ab" not in want and want["1x ab"] == (1, 1)
    for name, value in limits.items():
        monkeypatch.setattr(TE, name, value)
    monkeypatch.setattr(TE.Words.__init__, "__defaults__", ((), TE.BITS))
    assert counted() == want


def test_vectors_of_texts_are_those_of_terms(spark):
    terms, texts = frames(spark)
    vocab = TF.fit_vocabulary(terms, 12, 1, 1.0)
    assert vocab.table.orderBy("idx").collect() == TF.fit_vocabulary(texts, 12, 1, 1.0).table.orderBy("idx").collect()
    a, b = (sorted(map(tuple, TF.tfidf_long(d, vocab).collect())) for d in (terms, texts))
    assert a == b and len(a) > 12


def test_vocabulary_of_texts_uses_no_pattern(spark, sf_dir):
    from pricewise.operators.features import ListingPreprocessor
    df = spark.createDataFrame([(i, f"ab cd{i % 3}", "ef", "a/b/c", "x", 1, 1, 1.0, "a", "b", "c", 1.0) for i in range(40)],
                               "train_id long, name string, item_description string, category_name string, brand_name string, item_condition_id int, shipping int, price double, cat_main string, cat_sub1 string, cat_sub2 string, label double")
    x = ListingPreprocessor().fit(df).transform(df)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "cd0" not in plan
    assert x.select(F.size(F.unwrap_udt("features")["indices"])).distinct().count() >= 1

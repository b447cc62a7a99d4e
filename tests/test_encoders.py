"""Encoders against hand-computed values (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from pricewise.operators import encoders as EN


def test_label_encoder(spark):
    fit = spark.createDataFrame([("a",), ("b",), ("unknown",)], "c string")
    enc = EN.fit_label_encoder(fit, "c")
    data = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, c string")
    got = {r.id: r.c_label for r in enc.transform(data).collect()}
    assert got == {1: 0, 2: -1, 3: 2}
    enc_max = EN.fit_label_encoder(fit, "c", unknown_value="max")
    got = {r.id: r.c_label for r in enc_max.transform(data).collect()}
    assert got == {1: 0, 2: 3, 3: 2}
    inv = enc.inverse_transform(spark.createDataFrame([(0,), (5,), (-1,)], "code int"), "code", "v")
    assert sorted(r.v for r in inv.collect()) == ["a", "unknown", "unknown"]


def test_one_hot(spark):
    fit = spark.createDataFrame([("a",), ("b",), ("unknown",)], "c string")
    enc = EN.fit_one_hot(fit, "c")
    data = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, "unknown")], "id int, c string")
    got = {r.id: r.c_idx for r in enc.transform_index(data).collect()}
    assert got == {1: 0, 2: None, 3: 2}
    assert enc.n_categories == 3


def _target_fixture(spark):
    return spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0), (1, 12.0), (1, 14.0)], "c int, label double")


def test_target_encoder_min1(spark):
    te = EN.fit_target_encoder(_target_fixture(spark), "c", "label", smoothing=10, min_samples=1)
    data = spark.createDataFrame([(0,), (1,), (7,)], "c int")
    got = {r.c: round(r.c_encoded, 6) for r in te.transform(data).collect()}
    assert got == {0: 7.0, 1: 8.923077, 7: 8.0}


def test_target_encoder_min5(spark):
    te = EN.fit_target_encoder(_target_fixture(spark), "c", "label", smoothing=10, min_samples=5)
    data = spark.createDataFrame([(0,), (1,)], "c int")
    assert {r.c: r.c_encoded for r in te.transform(data).collect()} == {0: 8.0, 1: 8.0}


def test_unknown_values(spark):
    data = spark.createDataFrame([("a",), ("x",), (None,)], "c string")
    fitted = spark.createDataFrame([("a",), ("unknown",)], "value string")
    assert EN.unknown_values(data, "c", fitted).first().n_unknown == 1


def test_sorted_index_across_partitions(spark):
    import random
    vals = [f"v{i:05d}" for i in range(3000)]
    random.Random(3).shuffle(vals)
    df = spark.createDataFrame([(v,) for v in vals], "value string").repartition(7)
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.value: r.idx for r in EN.sorted_index(df, "value").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)
    assert got == {v: i for i, v in enumerate(sorted(vals))}


def test_preprocessor_unknown_category(spark, tmp_path):
    from pricewise.operators.features import FittedPreprocessor, ListingPreprocessor
    schema = "train_id long, name string, item_description string, brand_name string, cat_main string, cat_sub1 string, cat_sub2 string, category_name string, shipping int, item_condition_id int, price double, label double"
    row = lambda i, main: (i, "a b", "good c", "x", main, "s", "t", f"{main}/s/t", 1, 2, 10.0, 2.3)
    fit, new = (spark.createDataFrame([row(i, m) for i, m in enumerate(mains)], schema) for mains in (["p", "q", None], ["q", "z"]))
    options = {"include_tfidf": False, "include_keywords": False, "onehot_columns": ["cat_main"], "target_columns": [], "passthrough_columns": ["shipping"]}
    slots = lambda pre, df: {r.train_id: r.features.toArray()[:3].tolist() for r in pre.transform(df).collect()}
    assert slots(ListingPreprocessor(**options).fit(fit), new) == {0: [0, 1, 0], 1: [0, 0, 0]}
    strict = ListingPreprocessor(**options, onehot_handle_unknown="error").fit(fit)
    strict.save(str(tmp_path))
    for pre in (strict, FittedPreprocessor.load(spark, str(tmp_path))):
        assert slots(pre, fit) == {0: [1, 0, 0], 1: [0, 1, 0], 2: [0, 0, 1]}
        with pytest.raises(Exception, match="unknown value in cat_main: z"):
            pre.transform(new).collect()
    with pytest.raises(ValueError):
        ListingPreprocessor(**options, onehot_handle_unknown="skip")

"""Property checks: split sizes, folds, ranks, medians, top-k, TF-IDF norms,
preprocessor persistence, batch = stream scoring."""

import math
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise import session as S
from pricewise.operators import cleaning as CL
from pricewise.operators import profiling as PR
from pricewise.operators import sampling as SP
from pricewise.operators import tfidf as TF
from pricewise.plans import jobs as J
from pricewise.sources import listings as SRC


@pytest.fixture(scope="module")
def cleaned(spark, sf_dir):
    return CL.clean_listings(SRC.listings(spark, sf_dir)).cache()


def test_split_sizes(cleaned):
    s = SP.train_val_split(cleaned, 0.2, 42, "cat_main")
    n = cleaned.count()
    counts = {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts["val"] == math.ceil(0.2 * n) and counts["train"] + counts["val"] == n
    # strata proportions: every stratum's train share is within one row of the exact share
    per = s.groupBy("cat_main").agg(F.count("*").alias("c"), F.sum((F.col("split") == "train").cast("int")).alias("t"))
    n_train = counts["train"]
    for r in per.collect():
        assert abs(r.t - r.c * n_train / n) < 1.0 + 1e-9
    # unstratified when the column is absent
    u = SP.train_val_split(cleaned, 0.2, 42, "no_such_column")
    assert u.filter(F.col("split") == "val").count() == math.ceil(0.2 * n)


def test_folds_partition(cleaned):
    f = SP.kfold_assign(cleaned, 5)
    sizes = [r.n for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and sum(sizes) == cleaned.count() and max(sizes) - min(sizes) <= 1


def test_split_parts_with_repeated_and_null_keys(spark):
    rows = [(i % 700 if i % 11 else None, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "train_id long, price double")
    for digits in (1, 2, 4):
        for n in (0, 1, 37, 1500, 2999, 3000):
            lab = SP.label_by_rank(df, [n], digits=digits)
            assert lab.count() == 3000 and lab.filter("_label = 0").count() == n
        assert sorted(tuple(r) for r in SP.label_by_rank(df, [5, 900], digits=digits).drop("_label").collect() if r[0] is not None) == sorted(r for r in rows if r[0] is not None)
    assert SP.exact_sample(df, 1234).count() == 1234
    sizes = sorted(r["count"] for r in SP.kfold_assign(df, 7).groupBy("fold").count().collect())
    assert sum(sizes) == 3000 and sizes[-1] - sizes[0] <= 1
    null_group = df.withColumn("g", F.when(F.col("price") % 3 == 0, F.lit("a")))
    cuts = spark.createDataFrame([("a", [10]), (None, [20])], "g string, _t array<long>")
    got = SP.label_by_rank(null_group, cuts, by=["g"]).filter("_label = 0").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 10, None: 20}


def test_exact_sample(cleaned):
    assert SP.exact_sample(cleaned, 100).count() == 100
    assert SP.exact_sample(cleaned, 10**9).count() == cleaned.count()


def test_exact_median(spark, cleaned):
    prices = np.array([r.price for r in cleaned.select("price").collect()])
    assert PR.exact_median(cleaned, "price", accuracy=100) == pytest.approx(float(np.median(prices)), abs=1e-12)
    # coarse sketches force several bracketing rounds
    assert PR.exact_median(cleaned, "price", accuracy=50) == pytest.approx(float(np.median(prices)), abs=1e-12)
    ks = [0, 7, len(prices) // 3, len(prices) - 1]
    assert PR.kth_smallest(cleaned, "price", ks, accuracy=50) == [float(x) for x in np.sort(prices)[ks]]
    ties = spark.createDataFrame([(float(x % 3),) for x in range(1000)], "v double")
    assert PR.exact_median(ties, "v", accuracy=50) == 1.0
    odd = spark.createDataFrame([(float(x),) for x in [5, 1, 3]], "v double")
    assert PR.exact_median(odd, "v") == 3.0


def test_top_k_per_group_matches_pandas(cleaned):
    counts = PR.value_counts(cleaned)
    got = PR.top_k_per_group(counts, "column", [F.desc("n"), F.asc("value")], 3, salt_buckets=4).toPandas()
    pdf = counts.toPandas().sort_values(["column", "n", "value"], ascending=[True, False, True])
    want = pdf.groupby("column").head(3)
    assert sorted(map(tuple, got[["column", "value", "n"]].values)) == sorted(map(tuple, want[["column", "value", "n"]].values))


def test_tfidf_rows_have_unit_norm(cleaned):
    terms = TF.listing_terms(cleaned)
    vocab = TF.fit_vocabulary(terms, max_features=500)
    assert vocab.size <= 500
    w = TF.tfidf_long(terms, vocab).groupBy("train_id").agg(F.sum(F.col("weight") ** 2).alias("n2"))
    assert all(abs(r.n2 - 1.0) < 1e-9 for r in w.collect())


def test_preprocessor_save_load_and_stream(spark, sf_dir):
    from pricewise.operators.features import FittedPreprocessor
    from pricewise.operators.models import GBTConfig
    from pricewise.streaming.score_stream import score_stream, scored
    res = J.train_pipeline(spark, SRC.listings(spark, sf_dir), J.TrainConfig(model_type="ridge", cv=0, tfidf_max_features=300,
                                                        gbt=GBTConfig(n_estimators=5, max_depth=3)))
    pre = res.preprocessor
    assert pre.n_features == len(pre.feature_names())
    base = os.path.join(S.checkpoint_dir(spark), "t-" + uuid.uuid4().hex[:6])
    pre.save(os.path.join(base, "pre"))
    pre2 = FittedPreprocessor.load(spark, os.path.join(base, "pre"))
    assert pre2.feature_names() == pre.feature_names()
    _, val = J.prepare(SRC.listings(spark, sf_dir), J.TrainConfig())
    a = {r.train_id: r.features for r in pre.transform(val).collect()}
    b = {r.train_id: r.features for r in pre2.transform(val).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k].toArray(), b[k].toArray()) for k in a)
    # unseen one-hot category -> all-zero block
    odd = val.limit(1).withColumn("cat_main", F.lit("NOT_A_CATEGORY"))
    v = pre.transform(odd).first().features.toArray()
    k0 = len(pre.vocab_terms)
    assert np.all(v[k0:k0 + len(pre.onehot["cat_main"])] == 0)
    # batch and stream scoring agree
    batch = {r.train_id: r.predicted_price for r in scored(pre, res.model, val).collect()}
    src = os.path.join(base, "incoming")
    val.select(*SRC.RAW_COLUMNS, "cat_main", "cat_sub1", "cat_sub2").repartition(3).write.parquet(src)
    streamed = score_stream(spark, pre, res.model, src, os.path.join(base, "scored"), os.path.join(base, "ck"))
    stream = {r.train_id: r.predicted_price for r in streamed.collect()}
    assert batch.keys() == stream.keys()
    assert all(abs(batch[k] - stream[k]) < 1e-9 for k in batch)


def test_stream_resumes_from_checkpoint(spark, sf_dir):
    """Files landing in two batches: the second run of the same query (same
    checkpoint) scores only the new files."""
    from pricewise.operators.models import GBTConfig
    from pricewise.streaming.score_stream import score_stream
    res = J.train_pipeline(spark, SRC.listings(spark, sf_dir), J.TrainConfig(model_type="ridge", cv=0, tfidf_max_features=100,
                                                        gbt=GBTConfig(n_estimators=2, max_depth=2)))
    _, val = J.prepare(SRC.listings(spark, sf_dir), J.TrainConfig())
    cols = [*SRC.RAW_COLUMNS, "cat_main", "cat_sub1", "cat_sub2"]
    base = os.path.join(S.checkpoint_dir(spark), "resume-" + uuid.uuid4().hex[:6])
    src, ck = os.path.join(base, "incoming"), os.path.join(base, "ck")
    first = val.filter(F.col("train_id") % 2 == 0).select(*cols)
    second = val.filter(F.col("train_id") % 2 == 1).select(*cols)
    first.write.parquet(os.path.join(src, "batch=1"))
    schema = val.select(*cols).schema
    sink = os.path.join(base, "scored")
    out1 = score_stream(spark, res.preprocessor, res.model, src + "/*", sink, ck, schema)
    assert out1.count() == first.count()
    second.write.parquet(os.path.join(src, "batch=2"))
    out2 = score_stream(spark, res.preprocessor, res.model, src + "/*", sink, ck, schema)
    ids = [r.train_id for r in out2.collect()]
    assert len(ids) == len(set(ids)) == val.count()        # each listing scored exactly once

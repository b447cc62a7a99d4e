"""Label dictionary, taxonomy, target separation, ETL persistence, model
persistence and the reference's hand-written scoring requests."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from pricewise import constants as K
from pricewise import session as S
from pricewise.operators import cleaning as CL
from pricewise.operators import i18n as I18N
from pricewise.plans import jobs as J
from pricewise.sources import listings as SRC


def test_labels_table(spark):
    lbl = I18N.labels(spark)
    assert lbl.count() == 121
    fr = {r.key: r.label for r in lbl.filter((F.col("lang") == "fr") & (F.col("section") == "conditions")).collect()}
    assert set(fr) == {"1", "2", "3", "4", "5"}
    assert lbl.filter((F.col("lang") == "en") & (F.col("section") == "categories")).count() == 0


def test_localize_fallbacks(spark):
    df = spark.createDataFrame([("Women", "Dresses", 1), ("Nope", "Other", 9)],
                               "cat_main string, cat_sub1 string, item_condition_id int")
    fr = {r.cat_main: r for r in I18N.localize_labels(df, "fr", I18N.labels(spark)).collect()}
    assert fr["Women"].cat_main_label == "Femmes" and fr["Women"].cat_sub1_label == "Robes"
    assert fr["Nope"].cat_main_label == "Nope" and fr["Nope"].cat_sub1_label == "Autre"
    assert fr["Nope"].condition_label == "9"
    en = {r.cat_main: r for r in I18N.localize_labels(df, "en", I18N.labels(spark)).collect()}
    assert en["Women"].cat_main_label == "Women" and en["Women"].condition_label.endswith("New with tags")


def test_taxonomy(spark):
    tax = I18N.taxonomy(spark)
    assert tax.count() == sum(len(v) for v in K.SUB_CATEGORIES.values())
    mains = spark.createDataFrame([("Men",), ("Nope",)], "cat_main string")
    got = {r.cat_main: r.sub_categories for r in I18N.subcategories_for(spark, mains).collect()}
    assert got["Men"] == K.SUB_CATEGORIES["Men"] and got["Nope"] == ["Other"]
    pairs = spark.createDataFrame([("Men", "Suits"), ("Men", "Dresses"), ("Nope", "Other"), ("Nope", "X")],
                                  "cat_main string, cat_sub1 string")
    assert [r.conforms for r in I18N.taxonomy_conformity(pairs, spark).orderBy("cat_main", "cat_sub1").collect()] \
        == [0, 1, 1, 0]


def test_required_columns_and_target(spark):
    df = spark.createDataFrame([(1, "n", 2.0)], "train_id int, name string, price double")
    with pytest.raises(ValueError):
        CL.required_columns(df)
    assert "label" in CL.split_target(df).columns
    with pytest.raises(ValueError):
        CL.split_target(df.drop("price"))


def test_etl_snapshot_and_latest(spark, sf_dir):
    out = os.path.join(S.checkpoint_dir(spark), "etl-" + uuid.uuid4().hex[:6])
    raw = SRC.listings(spark, sf_dir)
    summary = J.etl_pipeline(spark, raw, out_dir=out, snapshot="t1").first()
    latest = spark.read.parquet(os.path.join(out, "latest"))
    assert latest.count() == summary.n_rows_final == spark.read.parquet(os.path.join(out, "snapshot=t1")).count()
    assert summary.n_rows_initial == raw.count()
    with pytest.raises(Exception):
        J.etl_pipeline(spark, raw, out_dir=out, snapshot="t1")      # snapshots are immutable


def test_unknown_model_type(spark, sf_dir):
    with pytest.raises(ValueError):
        J.train_pipeline(spark, SRC.listings(spark, sf_dir), J.TrainConfig(model_type="xgboost"))


def test_ensemble_and_hand_written_requests(spark, sf_dir):
    from pricewise.operators.models import Ensemble, GBTConfig
    from pricewise.operators.scoring import scoring_request
    from pricewise.streaming.score_stream import scored
    out = os.path.join(S.checkpoint_dir(spark), "models-" + uuid.uuid4().hex[:6])
    res = J.train_pipeline(spark, SRC.listings(spark, sf_dir), J.TrainConfig(
        model_type="ensemble", tfidf_max_features=200, feature_selection=True, top_n_features=50, cv=0, save_dir=out,
        gbt=GBTConfig(n_estimators=4, max_depth=3, early_stopping_rounds=2)))
    assert res.metrics["n_trees"] >= 1 and res.metrics["val_rmsle"] > 0
    version = res.metrics["version"]
    loaded = Ensemble.load(spark, os.path.join(out, version, "model"))
    assert loaded.selected == res.model.selected and loaded.weights == res.model.weights
    meta = spark.read.json(os.path.join(out, "metadata")).first()
    assert meta.version == version and meta.model_type == "ensemble"
    # The three request shapes of the reference's manual prediction script.
    reqs = spark.createDataFrame([
        (1, "iphone x 64gb unlocked mint condition", 2, "Electronics", "Cell Phones & Accessories", "Apple", 1,
         "iphone x 64gb space gray unlocked works perfectly no scratches"),
        (2, "apple iphone", 2, "Electronics", "Cell Phones & Accessories", "Apple", 1, ""),
        (3, "apple iphone 64gb unlocked", 2, "Electronics", "Cell Phones & Accessories", "Apple", 1,
         "apple iphone 64gb unlocked smartphone cell phone excellent condition works perfectly"),
    ], "train_id long, name string, item_condition_id int, cat_main string, cat_sub1 string, brand_name string, "
       "shipping int, item_description string")
    assert scoring_request(reqs).filter(F.col("category_name") == "Electronics/Cell Phones & Accessories/").count() == 3
    out_rows = scored(res.preprocessor, loaded, reqs).collect()
    assert len(out_rows) == 3 and all(r.predicted_price >= 1 and r.price_high > 0 for r in out_rows)


def test_gbt_folds_fit_gbt(spark, sf_dir):
    """Fold scores of 'gbt' come from the boosted trees alone, on all features, and
    equal a fold run by hand."""
    from pricewise.operators import models as M
    from pricewise.operators import sampling as SP
    raw = SRC.head_n(SRC.listings(spark, sf_dir), 400)
    base = dict(tfidf_max_features=40, cv=2, nrows=300, gbt=M.GBTConfig(n_estimators=3, max_depth=2, early_stopping_rounds=None))
    gbt = J.train_pipeline(spark, raw, J.TrainConfig(model_type="gbt", **base))
    blend = J.train_pipeline(spark, raw, J.TrainConfig(model_type="ensemble", **base))
    assert gbt.model.selected is None and gbt.metrics["cv_scores"] != blend.metrics["cv_scores"]
    folds = SP.kfold_assign(gbt.train, 2)
    rest = folds.filter("fold <> 0")
    bundles = M.fit_bundles(rest)
    model, _ = M.train_gbt(bundles.transform(rest), None, base["gbt"], "bundled")
    assert bundles.size <= len(bundles.place) == gbt.metrics["n_features"]
    assert abs(M.rmsle(model.transform(bundles.transform(folds.filter("fold = 0")))) - gbt.metrics["cv_scores"][0]) < 1e-9


def test_first_trees_equal_a_short_fit(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from pricewise.operators import models as M
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4))
    df = spark.createDataFrame([(Vectors.dense(v), float(v[0] * 2 + v[1] ** 2)) for v in x], ["features", "label"]).coalesce(1)
    long = M.GBTConfig(n_estimators=8, max_depth=2).estimator("features", "label").fit(df)
    short = M.GBTConfig(n_estimators=3, max_depth=2).estimator("features", "label").fit(df)
    a = [q.prediction for q in M.first_trees(long, 3).transform(df).collect()]
    assert np.allclose(a, [q.prediction for q in short.transform(df).collect()])


def test_missing_versions(spark):
    from pricewise.operators import models as M
    from pricewise.operators.features import load_preprocessor
    out = os.path.join(S.checkpoint_dir(spark), "none-" + uuid.uuid4().hex[:6])
    for load in (load_preprocessor, M.load_model):
        with pytest.raises(FileNotFoundError):
            load(spark, out, "v0")
    with pytest.raises(FileNotFoundError):
        SRC.read_listings_tsv(spark, out)

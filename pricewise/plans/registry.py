"""Registered Spark queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query starts from the whole test tables (through the listings view)
and returns columns named exactly like its oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cleaning as CL
from ..functions import text as TX
from ..operators import encoders as EN
from ..operators import i18n as I18N
from ..operators import models as MD
from ..operators import scoring as SC
from ..operators import tfidf as TF
from ..operators import profiling as PR
from ..operators import sampling as SP
from ..sources import listings as SRC
from . import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def view(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The listings view with the key and the columns that a query needs."""
    return SRC.listings(spark, sf_dir, columns=["train_id", *columns])


def cleaned(spark: SparkSession, sf_dir: str, *columns: str, **kw) -> DataFrame:
    """Cleaned listings; with ``columns``, a narrow view of them (and the price).
    The top brands are counted without texts."""
    raw = view(spark, sf_dir, "price", *columns) if columns else SRC.listings(spark, sf_dir)
    return CL.clean_listings(raw, brands=view(spark, sf_dir, "price", "brand_name"), **kw)


NARROW = {"add_features": False}
CATEGORIES = ("category_name", "brand_name", "item_condition_id", "shipping")
TEXTS = ("category_name", "name", "item_description")


@query("listing_brand_encoding")
def listing_brand_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: clean listings, add text features and the top-10 brand flag,
    then target-encode brand on log1p(price)."""
    df = cleaned(spark, sf_dir, top_n=10).withColumn("label", F.log1p("price"))
    enc = EN.fit_target_encoder(df, "brand_name", "label")
    return (enc.transform(df)
              .select("train_id", "cat_main", "brand_name", "name_len", "desc_len", "is_top_brand",
                      F.round("brand_name_encoded", 6).alias("brand_encoded")))


# ------------------------------------------------------------ sources ------

@query("scan_head_n")
def scan_head_n(spark, sf_dir):
    """nrows=100: the first 100 listings in key order."""
    return SRC.listings(spark, sf_dir, nrows=100)


# ------------------------------------------------- projections/filters -----

@query("price_range_filter")
def price_range_filter(spark, sf_dir):
    return CL.price_range_filter(view(spark, sf_dir, "price")).select("train_id", "price")


@query("fill_missing_brand")
def fill_missing_brand(spark, sf_dir):
    return CL.fill_missing_brand(view(spark, sf_dir, "brand_name")).select("train_id", "brand_name")


@query("split_category")
def split_category(spark, sf_dir):
    return CL.split_category(view(spark, sf_dir, "category_name")).select(
        "train_id", "category_name", "cat_main", "cat_sub1", "cat_sub2")


@query("clean_name")
def clean_name(spark, sf_dir):
    return CL.clean_name(view(spark, sf_dir, "name")).select("train_id", "name")


@query("clean_description")
def clean_description(spark, sf_dir):
    return CL.clean_description(view(spark, sf_dir, "item_description")).select("train_id", "item_description")


@query("clean_listings")
def clean_listings(spark, sf_dir):
    """The full cleaning chain with default parameters (top 100 brands)."""
    return cleaned(spark, sf_dir)


@query("listing_text_features")
def listing_text_features(spark, sf_dir):
    return cleaned(spark, sf_dir, "name", "item_description", **NARROW).transform(CL.add_text_features).select(
        "train_id", "name_len", "desc_len", "has_description")


@query("top_brand_flag")
def top_brand_flag(spark, sf_dir):
    return cleaned(spark, sf_dir, "brand_name", top_n=10).select("train_id", "brand_name", "is_top_brand")


@query("passthrough_numeric")
def passthrough_numeric(spark, sf_dir):
    return cleaned(spark, sf_dir, "item_condition_id", "shipping", **NARROW).select("train_id", "item_condition_id", "shipping")


# --------------------------------------------------------- aggregates ------

@query("table_profile")
def table_profile(spark, sf_dir):
    return PR.table_profile(SRC.listings(spark, sf_dir))


@query("clean_stats")
def clean_stats(spark, sf_dir):
    s = PR.clean_stats(cleaned(spark, sf_dir), prices=cleaned(spark, sf_dir, "price", **NARROW))
    return s.select("n_rows", "n_cols", "price_min", "price_max", F.round("price_mean", 6).alias("price_mean"),
                    F.round("price_median", 6).alias("price_median"), "n_categories_main", "n_brands",
                    F.round("pct_unknown_brand", 6).alias("pct_unknown_brand"),
                    F.round("avg_name_len", 6).alias("avg_name_len"), F.round("avg_desc_len", 6).alias("avg_desc_len"))


@query("category_level_counts")
def category_level_counts(spark, sf_dir):
    return PR.category_level_counts(cleaned(spark, sf_dir, "category_name", **NARROW))


@query("category_stats")
def category_stats(spark, sf_dir):
    return PR.category_stats(cleaned(spark, sf_dir, *CATEGORIES, **NARROW))


@query("top_k_values")
def top_k_values(spark, sf_dir):
    return PR.top_k_values(cleaned(spark, sf_dir, *CATEGORIES, **NARROW), 5)


@query("brand_value_counts")
def brand_value_counts(spark, sf_dir):
    return CL.brand_counts(cleaned(spark, sf_dir, "brand_name", **NARROW))


@query("top_k_brands")
def top_k_brands(spark, sf_dir):
    top = CL.top_brands(cleaned(spark, sf_dir, "brand_name", **NARROW), 10)
    return top.select("brand_name", "n_listings",
                      F.row_number().over(Window.orderBy(F.desc("n_listings"), F.asc("brand_name"))).cast("int").alias("rank"))


@query("removal_report")
def removal_report(spark, sf_dir):
    return PR.removal_report(view(spark, sf_dir, "brand_name"), cleaned(spark, sf_dir))


# ------------------------------------------------ sampling and splits ------

def split_listings(spark, sf_dir, *columns):
    """Texts are cleaned after the split, whose plan reads its input more than once."""
    rows = CL.clean_rows(view(spark, sf_dir, "price", "category_name", *columns))
    return CL.clean_texts(SP.train_val_split(rows, stratify_col="cat_main"))


@query("exact_sample")
def exact_sample(spark, sf_dir):
    return SP.exact_sample(view(spark, sf_dir, "price"), 10000, seed=42).select("train_id", "price")


@query("train_val_split")
def train_val_split(spark, sf_dir):
    return split_listings(spark, sf_dir).select("train_id", "cat_main", "split")


@query("kfold_assign")
def kfold_assign(spark, sf_dir):
    train = split_listings(spark, sf_dir).filter(F.col("split") == "train")
    return SP.kfold_assign(train, 5).select("train_id", "fold")


@query("target_summary")
def target_summary(spark, sf_dir):
    train = split_listings(spark, sf_dir).filter(F.col("split") == "train")
    s = PR.target_summary(train)
    return s.select("price_min", "price_max", F.round("price_median", 6).alias("price_median"),
                    F.round("log_price_min", 6).alias("log_price_min"), F.round("log_price_max", 6).alias("log_price_max"))


# ------------------------------------------------------------ scalars ------

@query("combine_text")
def combine_text(spark, sf_dir):
    return view(spark, sf_dir, "name", "item_description").select("train_id", TX.combine_text("name", "item_description").alias("text"))


@query("normalize_text")
def normalize_text(spark, sf_dir):
    return cleaned(spark, sf_dir, "name", "item_description", **NARROW).select(
        "train_id", TX.normalize_text(TX.combine_text("name", "item_description")).alias("text"))



@query("keyword_count")
def keyword_count(spark, sf_dir):
    """Substring keyword count of the 'poor' list over the raw description."""
    from .. import constants as K
    return view(spark, sf_dir, "item_description").select(
        "train_id", TX.keyword_count("item_description", K.QUALITY_KEYWORDS["poor"]).alias("kw_poor"))


@query("keyword_features")
def keyword_features(spark, sf_dir):
    kw = TX.keyword_features("item_description")
    return cleaned(spark, sf_dir, "item_description", **NARROW).select("train_id", *[c.alias(n) for n, c in kw.items()])


@query("tokenize_ngrams")
def tokenize_ngrams(spark, sf_dir):
    terms = TF.listing_terms(cleaned(spark, sf_dir, "name", "item_description", **NARROW))
    return terms.select("train_id", F.size("terms").alias("n_terms"), F.array_join("terms", "|").alias("terms"))


@query("log_target")
def log_target(spark, sf_dir):
    lp = F.log1p("price")
    return cleaned(spark, sf_dir, "price", **NARROW).select(
        "train_id", F.round(lp, 6).alias("log_price"), F.round(F.expm1(lp), 6).alias("price_back"))


def scoring_requests(spark, sf_dir):
    return SC.scoring_request(cleaned(spark, sf_dir, add_features=False), cleaned=True)


@query("enrich_listing")
def enrich_listing(spark, sf_dir):
    return scoring_requests(spark, sf_dir).select("train_id", "name", "item_description")


@query("scoring_request")
def scoring_request(spark, sf_dir):
    return scoring_requests(spark, sf_dir)


@query("meaningful_words")
def meaningful_words(spark, sf_dir):
    from .. import constants as K
    d = cleaned(spark, sf_dir, "name", "item_description", **NARROW).select(
        "train_id", TX.meaningful_words("name", "item_description", cleaned=True).alias("n_meaningful"))
    return d.withColumn("low_confidence", (F.col("n_meaningful") < K.MIN_WORDS_FOR_RELIABLE_ESTIMATE).cast("int"))


# ------------------------------------------------------------ lookups ------

@query("localize_labels")
def localize_labels(spark, sf_dir):
    d = cleaned(spark, sf_dir, "category_name", "item_condition_id", **NARROW).select("train_id", "cat_main", "cat_sub1", "item_condition_id")
    return I18N.localize_labels(d, "fr", I18N.labels(spark)).select(
        "train_id", "condition_label", "cat_main_label", "cat_sub1_label")


@query("taxonomy_conformity")
def taxonomy_conformity(spark, sf_dir):
    d = cleaned(spark, sf_dir, "category_name", **NARROW).select("train_id", "cat_main", "cat_sub1")
    return I18N.taxonomy_conformity(d, spark).select("train_id", "conforms")


# ----------------------------------------------------------- encoders ------

def split_frames(spark, sf_dir, *columns):
    """Train and validation listings with label = log1p(price). The split is
    read by several passes (fits, transforms, counts) that each need a few
    columns, so it is written once as a Parquet table in the shared
    checkpoint folder (column pruning on every re-read)."""
    from ..session import materialize
    s = materialize(split_listings(spark, sf_dir, *columns).withColumn("label", F.log1p("price")), "split")
    return s.filter(F.col("split") == "train"), s.filter(F.col("split") == "val")


@query("label_encode")
def label_encode(spark, sf_dir):
    train, val = split_frames(spark, sf_dir)
    enc = EN.fit_label_encoder(train, "cat_sub2", unknown_value=-1)
    return enc.transform(val).select("train_id", "cat_sub2_label")


@query("one_hot_encode")
def one_hot_encode(spark, sf_dir):
    train, val = split_frames(spark, sf_dir)
    enc = EN.fit_one_hot(train, "cat_main")
    return enc.transform_index(val).select("train_id", F.col("cat_main_idx").cast("int").alias("cat_main_idx"),
                                           F.lit(enc.n_categories).cast("int").alias("n_categories"))


@query("target_encode")
def target_encode(spark, sf_dir):
    train, val = split_frames(spark, sf_dir, "brand_name")
    out = val
    for c in ("brand_name", "cat_sub1", "cat_sub2"):
        out = EN.fit_target_encoder(train, c, "label").transform(out)
    return out.select("train_id", *[F.round(f"{c}_encoded", 6).alias(f"{c}_encoded")
                                    for c in ("brand_name", "cat_sub1", "cat_sub2")])


@query("unknown_values")
def unknown_values(spark, sf_dir):
    train, val = split_frames(spark, sf_dir, "brand_name")
    parts = [EN.unknown_values(val, c, train.select(EN.filled(c).alias("value")).distinct())
             for c in ("brand_name", "cat_sub1", "cat_sub2")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------- tf-idf ------

def tfidf_parts(spark, sf_dir, max_features=10000):
    train, val = split_frames(spark, sf_dir, *TEXTS)
    vocab = TF.fit_vocabulary(TF.listing_texts(train), max_features=max_features)
    return vocab, TF.listing_texts(val)


@query("tfidf_document_frequency")
def tfidf_document_frequency(spark, sf_dir):
    vocab, _ = tfidf_parts(spark, sf_dir)
    return vocab.table.select("term", "idx", "df", "tf_total", F.round("idf", 6).alias("idf"))


@query("tfidf_weights")
def tfidf_weights(spark, sf_dir):
    vocab, val_terms = tfidf_parts(spark, sf_dir)
    return TF.tfidf_long(val_terms, vocab).select("train_id", "term", F.round("weight", 6).alias("weight"))


# ------------------------------------------- metrics on a baseline model ----

def baseline_predictions(spark, sf_dir):
    """Validation listings with a category-mean prediction: cat_sub1 target
    encoding fitted on the training split (log1p price)."""
    train, val = split_frames(spark, sf_dir)
    enc = EN.fit_target_encoder(train, "cat_sub1", "label")
    return enc.transform(val, "prediction")


@query("rmsle")
def rmsle(spark, sf_dir):
    p = baseline_predictions(spark, sf_dir)
    return SC.rmsle(p).select(F.round("rmsle", 6).alias("rmsle"), "n")


@query("price_band")
def price_band(spark, sf_dir):
    p = SC.with_price_band(baseline_predictions(spark, sf_dir))
    return p.select("train_id", *[F.round(c, 6).alias(c) for c in ("predicted_price", "price_low", "price_high")])


@query("abs_error_example")
def abs_error_example(spark, sf_dir):
    p = baseline_predictions(spark, sf_dir).withColumn("abs_error", F.abs(F.col("price") - F.expm1("prediction")))
    return p.select("train_id", F.round("abs_error", 6).alias("abs_error"))


# ---------------------------------------------------------------- jobs -----

@query("etl_pipeline")
def etl_pipeline(spark, sf_dir):
    return J.etl_pipeline(spark, SRC.listings(spark, sf_dir), counted=view(spark, sf_dir))


@query("etl_steps")
def etl_steps(spark, sf_dir):
    """The summaries of the ETL job after its first one, two and three steps; the
    last counts its rows while it writes."""
    import os
    import uuid
    from .. import session as S
    raw, out = SRC.listings(spark, sf_dir), os.path.join(S.checkpoint_dir(spark), "steps-" + uuid.uuid4().hex[:8])
    parts = [J.etl_pipeline(spark, raw, out if n == 3 else None, counted=view(spark, sf_dir), steps=J.ETL_STEPS[:n]).withColumn("n_steps", F.lit(n)) for n in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("feature_names")
def feature_names(spark, sf_dir):
    """(idx, name) of the assembled feature vector, built from the fitted
    vocabulary and one-hot categories (training split)."""
    from .. import constants as K
    train, _ = split_frames(spark, sf_dir, *TEXTS)
    vocab = TF.fit_vocabulary(TF.listing_texts(train))
    oh = EN.fit_one_hot(train, "cat_main")
    v, k = vocab.size, oh.n_categories
    tail = ([f"{c}_encoded" for c in K.DEFAULT_TARGET_COLUMNS] + list(K.DEFAULT_PASSTHROUGH_COLUMNS)
            + list(K.NUMERIC_FEATURE_COLUMNS) + list(K.KEYWORD_FEATURE_COLUMNS))
    fixed = spark.createDataFrame([(i, n) for i, n in enumerate(tail)], "pos int, name string")
    return (vocab.table.select("idx", F.concat(F.lit("tfidf_"), "term").alias("name"))
            .unionByName(oh.categories.select((F.col("idx") + F.lit(v)).cast("int").alias("idx"),
                                              F.concat(F.lit("cat_main_"), "value").alias("name")))
            .unionByName(fixed.select((F.col("pos") + F.lit(v + k)).cast("int").alias("idx"), "name")))


def _train(spark, sf_dir, model_type, cv=0, save_dir=None):
    """The training job with its default settings (but without cross-validation)."""
    return J.train_pipeline(spark, SRC.listings(spark, sf_dir), J.TrainConfig(model_type=model_type, cv=cv, save_dir=save_dir))


def _counts(r) -> list:
    return [r.metrics["model_type"], r.metrics["n_train"], r.metrics["n_val"], r.metrics["n_features"]]


_COUNTS = "model_type string, n_train long, n_val long, n_features long"


@query("train_ridge")
def train_ridge(spark, sf_dir):
    """Ridge through the training job. ``stationary``: the residuals meet the normal
    equations X'r = alpha w (within 1 % of X'y); ``error_recomputed``: the
    recorded validation error follows from the saved coefficients."""
    import numpy as np
    from .. import constants as K
    r = _train(spark, sf_dir, "ridge")
    gap, scale = MD.ridge_stationarity(r.train, r.model, K.RIDGE_ALPHA)
    return spark.createDataFrame([(*_counts(r), bool(gap <= 0.01 * scale), bool(np.isclose(MD.rmsle(J.predict(r.model, r.val)), r.metrics["val_rmsle"], rtol=1e-9)))],
                                 _COUNTS + ", stationary boolean, error_recomputed boolean")


def _trees(spark, r, weights):
    from .. import constants as K
    p = r.model.predict(r.val)
    off = p.select(F.max(F.abs(F.col("prediction") - (weights[0] * F.col("_p_ridge") + weights[1] * F.col("_p_gbt")))).alias("d")).first()["d"]
    spread = r.val.agg(F.stddev_pop("label")).first()[0]
    return spark.createDataFrame([(*_counts(r), 1 <= r.metrics["n_trees"] <= K.GBT_PARAMS["n_estimators"] and r.model.gbt.getNumTrees == r.metrics["n_trees"],
                                   bool(off < 1e-9), bool(MD.rmsle(p, pred="_p_gbt") <= 1.05 * spread))],
                                 _COUNTS + ", trees_kept boolean, blend_exact boolean, no_worse_than_mean boolean")


@query("train_gbt")
def train_gbt(spark, sf_dir):
    return _trees(spark, _train(spark, sf_dir, "gbt"), (0.0, 1.0))


@query("train_ensemble")
def train_ensemble(spark, sf_dir):
    from .. import constants as K
    return _trees(spark, _train(spark, sf_dir, "ensemble"), K.ENSEMBLE_WEIGHTS)


@query("cross_validate")
def cross_validate(spark, sf_dir):
    """Five folds of the category-mean predictor: the target encoding of cat_sub1,
    fitted on the other folds (ridge folds run inside the training job)."""
    from ..session import materialize
    train, _ = split_frames(spark, sf_dir)
    folds = materialize(SP.kfold_assign(train, 5), "folds")
    scores = MD.cross_validate(folds, lambda tr, te: EN.fit_target_encoder(tr, "cat_sub1", "label").transform(te, "prediction"), 5)
    s = MD.cv_summary(scores)
    return s.select(F.round("rmsle_mean", 6).alias("rmsle_mean"), F.round("rmsle_std", 6).alias("rmsle_std"), F.size("scores").cast("long").alias("n_folds"))


#: Effects planted on the terms with these ranks by document frequency, and on the shipping column.
PLANTED, PLANTED_SHIPPING = {60: 6.0, 90: 4.0}, 2.0


@query("select_top_features")
def select_top_features(spark, sf_dir):
    """The top features by importance among all columns, on a target with known
    causes: log price plus an effect of two terms (by their rank in document
    frequency) and of shipping. Returned with their rank by importance, and the number of training
    listings in which the selected vector holds a value other than the whole one."""
    from ..operators.features import ListingPreprocessor
    from ..session import drop_table, materialize
    train, _ = split_frames(spark, sf_dir, *SRC.RAW_COLUMNS)
    pre = ListingPreprocessor().fit(train)
    by_df = sorted(range(len(pre.vocab_terms)), key=lambda i: (pre.idf[i], pre.vocab_terms[i]))
    causes = {by_df[rank - 1]: effect for rank, effect in PLANTED.items()}
    x = pre.transform(train, keep=["label", "shipping"])
    found = F.unwrap_udt("features")["indices"]
    effect = sum((F.when(F.array_contains(found, i), e).otherwise(0.0) for i, e in causes.items()), F.col("shipping") * PLANTED_SHIPPING)
    x = materialize(x.withColumn("label", F.col("label") + effect), "planted")
    importances, names = MD.ranked_importances(x, MD.GBTConfig(n_estimators=5)), pre.feature_names()
    top = MD.top_features_by_importance(importances, len(PLANTED) + 1)
    ranks = {i: k for k, i in enumerate(sorted(top, key=lambda i: (-importances[i], i)), 1)}
    both = MD.select_features(x, top).select(vector_to_array("features_sel").alias("s"), vector_to_array("features").alias("v"))
    off = both.filter(F.col("s") != F.array(*[F.get("v", i) for i in top])).count()
    drop_table(x)
    return spark.createDataFrame([(i, names[i], ranks[i], off) for i in top], "idx int, name string, importance_rank int, n_different long")


def _band_checks() -> list:
    """Whether a band is ordered around the price, and floored, and follows from the prediction; false without a band."""
    checks = {"band_ordered": (F.col("price_low") <= F.col("predicted_price")) & (F.col("predicted_price") <= F.greatest("price_high", F.lit(1.0))),
              "floored": (F.col("predicted_price") >= 1) & (F.col("price_low") >= 1),
              "priced": F.abs(F.col("predicted_price") - F.greatest(F.lit(1.0), F.expm1("prediction") * 1.3)) < 1e-9}
    return [F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]


@query("score_listings")
def score_listings(spark, sf_dir):
    """All cleaned listings as scoring requests, some of them made faulty (no title,
    condition 0, shipping 2): every request has a result, faulty ones their errors,
    the others a price band that is checked."""
    from ..streaming.score_stream import scored_results
    r = _train(spark, sf_dir, "ridge")
    every = r.train_listings.unionByName(r.val_listings)
    faulty = (every.withColumn("name", F.when(F.col("train_id") % 97 == 0, F.lit("  ")).otherwise(F.col("name")))
              .withColumn("item_condition_id", F.when(F.col("train_id") % 89 == 0, F.lit(0)).otherwise(F.col("item_condition_id")))
              .withColumn("shipping", F.when(F.col("train_id") % 83 == 0, F.lit(2)).otherwise(F.col("shipping"))))
    results = scored_results(r.preprocessor, r.model, faulty)
    return results.select("train_id", "success", "error", *_band_checks())


@query("score_stream")
def score_stream(spark, sf_dir):
    """Validation listings landed as files in the shared checkpoint folder,
    then scored by a streaming query (availableNow); every row is compared
    with the batch score."""
    import os
    import uuid
    from .. import session as S
    from ..streaming.score_stream import score_stream as run
    from ..streaming.score_stream import scored
    r = _train(spark, sf_dir, "ridge")
    base = os.path.join(S.checkpoint_dir(spark), "stream-" + uuid.uuid4().hex[:8])
    src = os.path.join(base, "incoming")
    r.val_listings.select(*SRC.RAW_COLUMNS, "cat_main", "cat_sub1", "cat_sub2").write.parquet(src)
    streamed = run(spark, r.preprocessor, r.model, src, os.path.join(base, "scored"), os.path.join(base, "checkpoint"))
    batch = scored(r.preprocessor, r.model, r.val_listings).select("train_id", F.col("prediction").alias("batch"))
    return streamed.join(batch, "train_id", "full").select("train_id", F.coalesce(F.abs(F.col("prediction") - F.col("batch")) < 1e-9, F.lit(False)).alias("stream_equals_batch"))


@query("feature_nonzeros")
def feature_nonzeros(spark, sf_dir):
    """Non-zero features per validation listing (hand-checked scoring cases
    in the reference print the same count)."""
    from ..operators.features import ListingPreprocessor
    train, val = split_frames(spark, sf_dir, *SRC.RAW_COLUMNS)
    x = ListingPreprocessor().fit(train).transform(val)
    values = F.unwrap_udt("features")["values"]
    return x.select("train_id", F.size(F.filter(values, lambda v: v != 0)).alias("n_nonzero"))


@query("model_metadata")
def model_metadata(spark, sf_dir):
    """A saved run, found again by its version: the recorded counts, and that the
    loaded preprocessor and model give the recorded validation error."""
    import json
    import os
    import uuid
    from .. import session as S
    from ..operators.features import load_preprocessor
    out = os.path.join(S.checkpoint_dir(spark), "models-" + uuid.uuid4().hex[:8])
    r = _train(spark, sf_dir, "ridge", save_dir=out)
    row = spark.read.json(os.path.join(out, "metadata")).filter(F.col("version") == r.metrics["version"]).first()
    m = json.loads(row["metrics"])
    pre, model = load_preprocessor(spark, out, row["version"]), MD.load_model(spark, out, row["version"])
    again = MD.rmsle(J.predict(model, pre.transform(r.val_listings, keep=["label"])))
    return spark.createDataFrame([(row["model_type"], m["n_train"], m["n_val"], m["n_features"], abs(again - m["val_rmsle"]) < 1e-9)],
                                 "model_type string, n_train long, n_val long, n_features long, same_error boolean")


@query("encode_categoricals")
def encode_categoricals(spark, sf_dir):
    """The default categorical block for validation listings: one-hot slot
    of cat_main, smoothed target encodings of brand, cat_sub1 and cat_sub2
    (fitted on the training split), passthrough condition and shipping."""
    train, val = split_frames(spark, sf_dir, "brand_name", "item_condition_id", "shipping")
    oh = EN.fit_one_hot(train, "cat_main")
    out = oh.transform_index(val)
    for c in ("brand_name", "cat_sub1", "cat_sub2"):
        out = EN.fit_target_encoder(train, c, "label").transform(out)
    return out.select("train_id", F.col("cat_main_idx").cast("int").alias("cat_main_idx"),
                      *[F.round(f"{c}_encoded", 6).alias(f"{c}_encoded") for c in ("brand_name", "cat_sub1", "cat_sub2")],
                      F.col("item_condition_id").cast("double").alias("item_condition_id"),
                      F.col("shipping").cast("double").alias("shipping"))


@query("write_cleaned")
def write_cleaned(spark, sf_dir):
    """ETL with persistence: the cleaned table is written as an immutable
    snapshot and as 'latest' in the shared checkpoint folder, then the
    latest copy is read back (the cleaned-table scan)."""
    import os
    import uuid
    from .. import session as S
    out = os.path.join(S.checkpoint_dir(spark), "cleaned-" + uuid.uuid4().hex[:8])
    J.etl_pipeline(spark, SRC.listings(spark, sf_dir), out_dir=out, counted=view(spark, sf_dir))
    latest = spark.read.parquet(os.path.join(out, "latest"))
    return latest.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                      F.countDistinct("train_id").cast("long").alias("n_ids"),
                      F.lit(len(latest.columns)).cast("long").alias("n_cols"))


@query("fit_preprocessor")
def fit_preprocessor(spark, sf_dir):
    """Fit the default preprocessor on the training split and report its
    blocks (10,000 TF-IDF terms + one-hot + 3 + 2 + 3 + 9)."""
    from ..operators.features import ListingPreprocessor
    train, _ = split_frames(spark, sf_dir, *SRC.RAW_COLUMNS)
    pre = ListingPreprocessor().fit(train)
    names = pre.feature_names()
    return spark.createDataFrame(
        [(len(names), len(pre.vocab_terms), len(pre.onehot["cat_main"]), names[0], names[-1])],
        "n_features int, n_tfidf int, n_onehot int, first_name string, last_name string")


@query("scan_listings_tsv")
def scan_listings_tsv(spark, sf_dir):
    """The TSV scan: the whole listings view written as TSV to the shared
    checkpoint folder (gzip files; texts with newlines and quotes), read back with
    the listing reader (schema, quoting, missing-value tokens)."""
    import os
    import uuid
    from .. import session as S
    path = os.path.join(S.checkpoint_dir(spark), "tsv-" + uuid.uuid4().hex[:8])
    SRC.write_listings_tsv(SRC.listings(spark, sf_dir), path, compression="gzip")
    return SRC.read_listings_tsv(spark, path)


@query("train_cross_validation")
def train_cross_validation(spark, sf_dir):
    """The training job's own cross-validation (five ridge folds, as configured by
    default): the number of folds, and that mean and deviation follow from the
    fold scores."""
    import numpy as np
    r = J.train_pipeline(spark, SRC.listings(spark, sf_dir), J.TrainConfig(model_type="ridge"))
    c = r.metrics["cv_scores"]
    ok = bool(np.isclose(np.mean(c), r.metrics["cv_rmsle_mean"]) and np.isclose(np.std(c), r.metrics["cv_rmsle_std"]) and min(c) > 0)
    return spark.createDataFrame([(len(c), r.metrics["n_train"], ok)], "n_folds long, n_train long, summary_follows boolean")


@query("cv_summary")
def cv_summary(spark, sf_dir):
    """Mean, deviation and number of per-fold errors of the training mean."""
    from ..session import materialize
    train, _ = split_frames(spark, sf_dir)
    folds = materialize(SP.kfold_assign(train, 5), "folds")
    scores = MD.cross_validate(folds, lambda tr, te: te.withColumn("prediction", F.lit(tr.agg(F.avg("label")).first()[0])), 5)
    s = MD.cv_summary(scores)
    return s.select(F.round("rmsle_mean", 6).alias("rmsle_mean"), F.round("rmsle_std", 6).alias("rmsle_std"), F.size("scores").cast("long").alias("n_folds"))


@query("split_target")
def split_target(spark, sf_dir):
    """Target and features apart: the price becomes the label of the same row."""
    return CL.split_target(cleaned(spark, sf_dir, "item_condition_id", **NARROW)).select("train_id", "item_condition_id", "label")


@query("required_columns")
def required_columns(spark, sf_dir):
    """Which narrow views pass the check for required columns."""
    rows = []
    for name, columns in (("all", SRC.RAW_COLUMNS), ("no_price", [c for c in SRC.RAW_COLUMNS if c != "price"]), ("no_name", [c for c in SRC.RAW_COLUMNS if c != "name"])):
        df = cleaned(spark, sf_dir, **NARROW) if name == "all" else CL.split_category(view(spark, sf_dir, *columns))
        try:
            CL.required_columns(df)
            rows.append((name, True, df.count()))
        except ValueError:
            rows.append((name, False, 0))
    return spark.createDataFrame(rows, "view string, passes boolean, n_rows long")


@query("i18n_labels")
def i18n_labels(spark, sf_dir):
    """Listings by category and condition with their labels in every language."""
    d = cleaned(spark, sf_dir, "category_name", "item_condition_id", **NARROW).groupBy("cat_main", "cat_sub1", "item_condition_id").agg(F.count(F.lit(1)).alias("n_listings"))
    parts = [I18N.localize_labels(d, lang, I18N.labels(spark)).select(F.lit(lang).alias("lang"), "cat_main", "cat_sub1", "item_condition_id", "cat_main_label", "cat_sub1_label", "condition_label", "n_listings")
             for lang in ("fr", "en", "es")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("label_sections")
def label_sections(spark, sf_dir):
    """Labels of the dictionary that the listings use, by language and section:
    entries, and the listings that each section has a label for."""
    lbl = I18N.labels(spark)
    d = cleaned(spark, sf_dir, "category_name", "item_condition_id", **NARROW)
    used = d.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).cast("string").alias("key"))
                                        for s, c in (("categories", "cat_main"), ("sub_categories", "cat_sub1"), ("conditions", "item_condition_id"))])).alias("u")).select("u.*")
    counts = used.groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))
    return (lbl.join(counts, ["section", "key"], "left").groupBy("lang", "section")
            .agg(F.count(F.lit(1)).alias("n_labels"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_listings")))


@query("preprocessor_round_trip")
def preprocessor_round_trip(spark, sf_dir):
    """Validation listings whose feature vector is the same after the fitted
    preprocessor was saved and loaded."""
    import os
    import uuid
    from .. import session as S
    from ..operators.features import FittedPreprocessor, ListingPreprocessor
    train, val = split_frames(spark, sf_dir, *SRC.RAW_COLUMNS)
    pre = ListingPreprocessor().fit(train)
    again = FittedPreprocessor.load(spark, pre.save(os.path.join(S.checkpoint_dir(spark), "pre-" + uuid.uuid4().hex[:8])))
    a = pre.transform(val).select("train_id", F.unwrap_udt("features").alias("a"))
    b = again.transform(val).select("train_id", F.unwrap_udt("features").alias("b"))
    return a.join(b, "train_id").select("train_id", F.coalesce(F.col("a").eqNullSafe(F.col("b")), F.lit(False)).alias("same"))


@query("assembled_features")
def assembled_features(spark, sf_dir):
    """The assembled vector in long form: (listing, slot, value) of the non-zero
    slots after the TF-IDF and one-hot blocks."""
    from ..operators.features import ListingPreprocessor
    train, val = split_frames(spark, sf_dir, *SRC.RAW_COLUMNS)
    pre = ListingPreprocessor().fit(train)
    first = len(pre.vocab_terms) + len(pre.onehot["cat_main"])
    v = pre.transform(val).select("train_id", vector_to_array("features").alias("v"))
    tail = F.slice("v", first + 1, pre.n_features - first)
    return (v.select("train_id", F.posexplode(tail).alias("slot", "value")).filter("value <> 0")
             .select("train_id", "slot", F.round("value", 6).alias("value")))

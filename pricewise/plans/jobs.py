"""End-to-end jobs: the ETL run and the training run.

Both are a single Spark application: one lazy plan per step, actions only
where a fitted state or a metric is needed. Frames read several times are
written once to the shared checkpoint folder, so a lost executor re-reads
them instead of recomputing the text pipeline: the split listings as a
Parquet table (``materialize``: later fits read only the columns they need),
the feature vectors fed to iterative optimisers as reliable checkpoints
(``cut_lineage``).
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import session as S
from ..operators import cleaning as CL
from ..operators import features as FE
from ..operators import models as M
from ..operators import sampling as SP
from ..sources import listings as SRC


# ------------------------------------------------------------------ ETL ----

ETL_STEPS = ("load", "clean", "save")


def etl_pipeline(spark: SparkSession, raw: DataFrame, out_dir: str | None = None,
                 min_price: float = K.DEFAULT_MIN_PRICE, max_price: float = K.DEFAULT_MAX_PRICE,
                 snapshot: str | None = None, counted: DataFrame | None = None, steps: tuple[str, ...] | None = None) -> DataFrame:
    """The ``steps`` (by default load, clean and, with ``out_dir``, save). Returns the
    summary row: initial rows and columns, then final rows and columns, which are
    null without the cleaning step. ``counted``: the raw rows with fewer columns, if
    the caller can count them without a join.

    Saving writes the cleaned table twice, an immutable snapshot and the latest, and
    counts the raw and the cleaned rows while the snapshot is written (``observe``),
    so that nothing is scanned for the counts alone."""
    steps = (ETL_STEPS if out_dir else ETL_STEPS[:2]) if steps is None else tuple(steps)
    if not steps or steps != ETL_STEPS[: len(steps)]:
        raise ValueError(f"steps must be the first ones of {ETL_STEPS}: {steps}")
    if ("save" in steps) != bool(out_dir):
        raise ValueError("saving needs an out_dir, and an out_dir the step 'save'")
    rows = F.count(F.lit(1))
    schema = "n_rows_initial long, n_rows_final long, n_cols_initial long, n_cols_final long"
    if "save" in steps:
        before, after = Observation("rows read"), Observation("rows cleaned")
        cleaned = CL.clean_listings(raw.observe(before, rows.alias("n")), min_price, max_price, brands=raw.select("price", "brand_name"))
        path = os.path.join(out_dir, f"snapshot={snapshot or M.new_version()}")
        cleaned.observe(after, rows.alias("n")).write.mode("errorifexists").parquet(path)
        spark.read.parquet(path).write.mode("overwrite").parquet(os.path.join(out_dir, "latest"))
        return spark.createDataFrame([(before.get["n"], after.get["n"], len(raw.columns), len(cleaned.columns))], schema)
    initial = (raw.select(raw.columns[0]) if counted is None else counted).agg(rows.alias("n_rows_initial"))
    if "clean" not in steps:
        return initial.select("n_rows_initial", F.lit(None).cast("long").alias("n_rows_final"), F.lit(len(raw.columns)).cast("long").alias("n_cols_initial"), F.lit(None).cast("long").alias("n_cols_final"))
    cleaned = CL.clean_listings(raw, min_price, max_price)
    both = initial.unionByName(cleaned.agg(rows.alias("n_rows_final")), allowMissingColumns=True)
    return (both.agg(F.max("n_rows_initial").alias("n_rows_initial"), F.max("n_rows_final").alias("n_rows_final"))
                .withColumn("n_cols_initial", F.lit(len(raw.columns)).cast("long"))
                .withColumn("n_cols_final", F.lit(len(cleaned.columns)).cast("long")))


# ------------------------------------------------------------- training ----

@dataclass
class TrainConfig:
    model_type: str = "ensemble"            # ridge | gbt | ensemble
    tfidf_max_features: int = K.TFIDF_MAX_FEATURES
    alpha: float = K.RIDGE_ALPHA
    gbt: M.GBTConfig = field(default_factory=M.GBTConfig)
    feature_selection: bool = False         # trees on the top_n_features only
    top_n_features: int = K.TOP_N_FEATURES
    cv: int = K.CV_FOLDS                     # 0: no cross-validation
    nrows: int | None = None
    test_size: float = K.SPLIT_TEST_SIZE
    seed: int = K.SPLIT_SEED
    save_dir: str | None = None


@dataclass
class TrainResult:
    preprocessor: FE.FittedPreprocessor
    model: object
    metrics: dict
    train: DataFrame
    val: DataFrame
    val_listings: DataFrame
    train_listings: DataFrame


def prepare(raw: DataFrame, cfg: TrainConfig):
    """Clean the raw listings (the first ``nrows`` in key order), split them
    (stratified by cat_main) and add label = log1p(price)."""
    if cfg.nrows is not None:
        raw = SRC.head_n(raw, cfg.nrows)
    # The split's plan reads its input more than once, so texts are cleaned after it.
    split = CL.clean_texts(SP.train_val_split(CL.clean_rows(raw), cfg.test_size, cfg.seed, "cat_main"))
    split = S.materialize(split.withColumn("label", F.log1p("price")), "split")
    return split.filter(F.col("split") == "train"), split.filter(F.col("split") == "val")


def predict(model, df: DataFrame, features: str = "features") -> DataFrame:
    if isinstance(model, M.Ensemble):
        return model.predict(df, features)
    return model.setFeaturesCol(features).setPredictionCol("prediction").transform(df)


def fit_model(train: DataFrame, val: DataFrame | None, cfg: TrainConfig):
    """The model of ``cfg.model_type`` on a feature frame."""
    if cfg.model_type == "ridge":
        return M.train_ridge(train, cfg.alpha)
    weights = (0.0, 1.0) if cfg.model_type == "gbt" else K.ENSEMBLE_WEIGHTS
    return M.train_ensemble(train, val, cfg.alpha, cfg.gbt, cfg.top_n_features if cfg.feature_selection else None, weights, cfg.model_type)


def train_pipeline(spark: SparkSession, raw: DataFrame, cfg: TrainConfig | None = None) -> TrainResult:
    """Train on any raw listings (``RAW_SCHEMA``): clean, split, fit the
    preprocessor and the model, validate, cross-validate, save."""
    cfg = cfg or TrainConfig()
    if cfg.model_type not in ("ridge", "gbt", "ensemble"):
        raise ValueError(f"unknown model type: {cfg.model_type}")
    train, val = prepare(raw, cfg)
    pre = FE.ListingPreprocessor(tfidf_max_features=cfg.tfidf_max_features).fit(train)
    xtr = S.cut_lineage(pre.transform(train, keep=["label", "price"]))
    xva = S.cut_lineage(pre.transform(val, keep=["label", "price"]))
    metrics: dict = {"model_type": cfg.model_type, "n_features": pre.n_features}
    folds = SP.kfold_assign(xtr, cfg.cv, cfg.seed) if cfg.cv and cfg.cv > 1 else None
    if folds is not None and cfg.model_type == "ridge":
        # The model of all rows and those of the folds are fitted together.
        model, scores = M.train_ridge_folds(folds, cfg.alpha, cfg.cv)
    else:
        model = fit_model(xtr, xva, cfg)
    if isinstance(model, M.Ensemble):
        metrics["n_trees"] = model.n_trees
    pred = predict(model, xva)
    metrics["val_rmsle"] = M.rmsle(pred)
    if isinstance(model, M.Ensemble) and model.kind == "ensemble":
        metrics["ridge_rmsle"] = M.rmsle(pred, pred="_p_ridge")
        metrics["gbt_rmsle"] = M.rmsle(pred, pred="_p_gbt")
    if folds is not None:
        if cfg.model_type != "ridge":
            # Fold labels are fixed once; every fold fits the configured model type.
            folds = S.cut_lineage(folds)
            scores = M.cross_validate(folds, lambda tr, te: predict(fit_model(tr, None, cfg), te), cfg.cv)
        metrics["cv_scores"] = [r["rmsle"] for r in scores.orderBy("fold").collect()]
        s = M.cv_summary(scores).first()
        metrics["cv_rmsle_mean"], metrics["cv_rmsle_std"] = s["rmsle_mean"], s["rmsle_std"]
    counts = xtr.agg(F.count(F.lit(1)).alias("n")).first()["n"], xva.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    metrics["n_train"], metrics["n_val"] = int(counts[0]), int(counts[1])
    if cfg.save_dir:
        version = M.new_version()
        base = os.path.join(cfg.save_dir, version)
        pre.save(os.path.join(base, "preprocessor"))
        if isinstance(model, M.Ensemble):
            model.save(os.path.join(base, "model"))
        else:
            model.write().overwrite().save(os.path.join(base, "model"))
        M.run_metadata(spark, version, cfg.model_type, metrics, cfg.__dict__) \
            .write.mode("append").json(os.path.join(cfg.save_dir, "metadata"))
        metrics["version"] = version
    return TrainResult(pre, model, metrics, xtr, xva, val, train)


def metrics_frame(spark: SparkSession, metrics: dict) -> DataFrame:
    cols = ["model_type", "n_train", "n_val", "n_features", "n_trees", "val_rmsle", "ridge_rmsle", "gbt_rmsle",
            "cv_rmsle_mean", "cv_rmsle_std"]
    row = [metrics.get(c) for c in cols]
    return spark.createDataFrame(
        [row], "model_type string, n_train long, n_val long, n_features long, n_trees long, val_rmsle double, "
               "ridge_rmsle double, gbt_rmsle double, cv_rmsle_mean double, cv_rmsle_std double")

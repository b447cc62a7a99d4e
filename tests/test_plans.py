"""Plan checks for scale: no cross products anywhere, splits avoid a full
sort, bounded tables are the only explicit broadcasts."""

import contextlib
import io

import pytest

import __spark_entry__ as E

MODEL_QUERIES = {"train_ridge", "train_gbt", "train_ensemble", "cross_validate", "select_top_features",
                 "score_listings", "score_stream", "feature_nonzeros", "model_metadata", "fit_preprocessor",
                 "write_cleaned", "scan_listings_tsv", "pipeline"} | {n for n in E.queries() if n.startswith("op")}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - MODEL_QUERIES))
def test_no_cross_products(spark, sf_dir, name):
    plan = _plan(E.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_documents_join_is_sort_merge(spark, sf_dir):
    from pricewise.sources import listings as SRC
    plan = _plan(SRC.listings(spark, sf_dir))
    assert "SortMergeJoin" in plan


@pytest.mark.parametrize("name", ["price_range_filter", "fill_missing_brand", "split_category", "top_brand_flag", "category_stats", "brand_value_counts", "exact_sample", "train_val_split"])
def test_narrow_queries_read_no_text(spark, sf_dir, name):
    assert "documents.parquet" not in _plan(E.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["clean_listings", "top_k_values"])
def test_texts_are_scanned_once_at_most(spark, sf_dir, name):
    assert _plan(E.queries()[name](spark, sf_dir)).count("documents.parquet") <= 1


def test_tfidf_weights_shuffle_no_pairs(spark, sf_dir):
    plan = _plan(E.queries()["tfidf_weights"](spark, sf_dir))
    assert plan.split("Subquer")[0].count("Exchange") == 0

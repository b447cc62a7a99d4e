"""Per-request results with their errors, in batch and as a stream, and the steps of the ETL job."""

import pytest
from pyspark.sql import functions as F

from pricewise.operators import scoring as SC
from pricewise.plans import jobs as J
from pricewise.sources import listings as SRC
from pricewise.streaming import score_stream as ST

REQUESTS = "train_id long, name string, item_condition_id int, category_name string, brand_name string, price double, shipping int, item_description string, cat_main string, cat_sub1 string, cat_sub2 string"


def requests(spark):
    good = ("Women/Tops/T", "nike", 10.0)
    rows = [(1, "red shirt", 1, *good, 0, "new red shirt"), (2, " \t", 1, *good, 1, "x"), (3, None, 9, *good, 0, None), (4, "bag", 5, *good, 7, ""),
            (5, "bag", None, None, None, None, 1, None), (6, "bag", 3, None, None, None, 1, None)]
    return spark.createDataFrame([(*r, "Women", "Tops", "T") for r in rows], REQUESTS)


FAULTS = {1: None, 2: "name is empty", 3: "name is empty; item_condition_id is not 1 to 5", 4: "shipping is not 0 or 1", 5: "item_condition_id is not 1 to 5", 6: None}


def test_request_errors(spark):
    df = requests(spark)
    assert {r[0]: r[1] for r in df.select("train_id", SC.request_error(df.columns)).collect()} == FAULTS


@pytest.fixture
def fake_scores(monkeypatch):
    def scored(pre, model, listings, key="train_id"):
        return listings.select(key, F.lit(1.0).alias("prediction"), F.lit(2.0).alias("predicted_price"), F.lit(1.0).alias("price_low"), F.lit(3.0).alias("price_high"))
    monkeypatch.setattr(ST, "scored", scored)


def test_results_of_good_and_faulty_requests(spark, fake_scores):
    got = {r["train_id"]: r for r in ST.scored_results(None, None, requests(spark)).collect()}
    assert {k: r["error"] for k, r in got.items()} == FAULTS
    assert all(r["success"] == (r["error"] is None) == (r["predicted_price"] is not None) for r in got.values())


def test_stream_sets_faulty_requests_apart_once(spark, fake_scores, tmp_path):
    src, sink, bad, ckpt = (str(tmp_path / n) for n in ("src", "sink", "bad", "ckpt"))
    requests(spark).write.parquet(src)
    for _ in range(2):  # a second run finds nothing new
        ST.score_stream_results(spark, None, None, src, sink, bad, ckpt)
    assert sorted(r[0] for r in spark.read.parquet(sink).select("train_id").collect()) == [1, 6]
    assert {r["train_id"]: r["error"] for r in spark.read.parquet(bad).collect()} == {k: v for k, v in FAULTS.items() if v}


def test_etl_steps(spark, sf_dir, tmp_path):
    raw = SRC.listings(spark, sf_dir)
    n = raw.count()
    one = J.etl_pipeline(spark, raw, steps=("load",)).first()
    assert (one.n_rows_initial, one.n_rows_final, one.n_cols_final) == (n, None, None)
    two = J.etl_pipeline(spark, raw, steps=("load", "clean")).first()
    three = J.etl_pipeline(spark, raw, str(tmp_path / "out"), steps=J.ETL_STEPS).first()
    assert two == three and two.n_rows_final == spark.read.parquet(str(tmp_path / "out" / "latest")).count() < n
    for steps, out in ((("clean",), None), ((), None), (("load", "save"), "x"), (("load",), "x"), (J.ETL_STEPS, None)):
        with pytest.raises(ValueError):
            J.etl_pipeline(spark, raw, out, steps=steps)

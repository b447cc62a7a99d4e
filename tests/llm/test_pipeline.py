"""The pipeline's stages, and the SQL of the operators that have one."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from pricewise.llm import registry

TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.ORACLE[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got) == len(want)
    as_text = lambda df: df[columns].astype(object).where(df[columns].notna(), None).map(lambda x: str(int(x)) if isinstance(x, float) else str(x)).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(as_text(got), as_text(want))


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dup", "decontaminate", "secrets", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] >= seen[3] == seen[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == seen[-1] and last.filter("NOT parity OR NOT round_trip").count() == 0
    again = corpus_pipeline.run(spark, SF)
    assert sorted(again.select("doc_id", "ids_sha256").collect()) == sorted(last.select("doc_id", "ids_sha256").collect())


def test_stages_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_tokens_stage_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    extra = docs.selectExpr("*", "'x' AS ids", "1 AS Parity", "2 AS n_tokens", "3 AS other")
    got = corpus_pipeline.written(corpus_pipeline.tokens_stage(spark, extra, SF), "test-clash")
    plain = corpus_pipeline.tokens_stage(spark, docs, SF)
    assert sorted(got.columns) == sorted([*plain.columns, "other"])
    assert got.filter("NOT parity OR other <> 3").count() == 0 and got.count() == 3

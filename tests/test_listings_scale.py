"""The listings view at scale: partitions of the documents join, and text work that is done once."""

from pyspark.sql import functions as F

from pricewise.plans import registry as R
from pricewise.sources import listings as SRC


def test_documents_join_has_partitions_by_listings(spark, sf_dir, monkeypatch):
    orders = SRC.table(spark, sf_dir, "orders").count()
    monkeypatch.setattr(SRC, "LISTINGS_PER_TASK", -(-orders // 8))
    rows = SRC.listings(spark, sf_dir, columns=["train_id", "item_description"])
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert rows.count() == orders


def test_texts_are_cleaned_after_the_split(spark, sf_dir):
    def below_joins(node, inside=False):
        found = inside and "\\[rm\\]" in node.simpleString(100000)
        children = node.children()
        return found or any(below_joins(children.apply(i), inside or node.nodeName() == "Join") for i in range(children.size()))

    plan = R.split_listings(spark, sf_dir, *R.TEXTS)._jdf.queryExecution().optimizedPlan()
    assert "\\[rm\\]" in plan.toString()
    assert not below_joins(plan)


def test_compressed_tsv_is_small_and_read_back_whole(spark, tmp_path):
    text = "line one\nsaid \"hi\"\tand " + "more words " * 200
    rows = spark.createDataFrame([(i, "n", 1, None, "", 2.0, 0, text) for i in range(500)], SRC.RAW_SCHEMA)
    sizes = []
    for codec in ("none", "gzip"):
        path = SRC.write_listings_tsv(rows, str(tmp_path / codec), 1, compression=codec)
        sizes.append(sum(f.stat().st_size for f in (tmp_path / codec).glob("part-*")))
        back = SRC.read_listings_tsv(spark, path)
        assert back.count() == 500 and back.filter(F.col("item_description") == text).count() == 500
    assert sizes[1] * 10 < sizes[0]

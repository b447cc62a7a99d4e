"""The reference's own loader and cleaner checks, on the listings view, and
the TSV scan edge cases."""

from pyspark.sql import functions as F

from pricewise.operators import cleaning as CL
from pricewise.operators import profiling as PR
from pricewise.sources import listings as SRC

EXPECTED = ["train_id", "name", "item_condition_id", "category_name", "brand_name", "price", "shipping",
            "item_description"]


def test_loader_nrows(spark, sf_dir):
    df = SRC.head_n(SRC.listings(spark, sf_dir), 100)
    assert df.count() == 100 and "price" in df.columns and "name" in df.columns


def test_loader_columns(spark, sf_dir):
    assert SRC.listings(spark, sf_dir).columns == EXPECTED


def test_profile(spark, sf_dir):
    prof = PR.table_profile(SRC.head_n(SRC.listings(spark, sf_dir), 100)).collect()
    assert {r.n_rows for r in prof} == {100} and {r.column for r in prof} == set(EXPECTED)


def test_cleaner_checks(spark, sf_dir):
    raw = SRC.head_n(SRC.listings(spark, sf_dir), 1000)
    clean = CL.clean_listings(raw)
    assert clean.count() <= raw.count() and "cat_main" in clean.columns
    narrow = CL.clean_listings(raw, min_price=5, max_price=500)
    r = narrow.agg(F.min("price").alias("lo"), F.max("price").alias("hi")).first()
    assert r.lo >= 5 and r.hi <= 500
    assert clean.filter(F.col("brand_name").isNull()).count() == 0
    assert {"cat_main", "cat_sub1", "cat_sub2"} <= set(clean.columns)
    assert {"name_len", "desc_len", "has_description", "is_top_brand"} <= set(clean.columns)
    assert clean.filter(F.col("item_description").contains("[rm]")).count() == 0


def test_tsv_scan(spark, tmp_path):
    p = tmp_path / "listings.tsv"
    header = "\t".join(EXPECTED)
    rows = [
        ["1", "None", "1", "NA", "nan", "10", "0", ""],
        ["2", '"x\ty"', "2", "A/B/C", "Nike", "12.5", "1", '"l1\nl2"'],
        ["3", '"he said ""hi"""', "3", "A/B", "", "7", "0", '5" tv'],
    ]
    p.write_text(header + "\n" + "\n".join("\t".join(r) for r in rows) + "\n", encoding="utf-8")
    df = SRC.read_listings_tsv(spark, str(p)).orderBy("train_id").collect()
    assert df[0].name is None and df[0].category_name is None and df[0].brand_name is None
    assert df[0].item_description is None
    assert df[1].name == "x\ty" and df[1].item_description == "l1\nl2" and df[1].price == 12.5
    assert df[2].name == 'he said "hi"' and df[2].item_description == '5" tv' and df[2].brand_name is None


def test_tsv_missing_file(spark, tmp_path):
    import pytest
    with pytest.raises(FileNotFoundError):
        SRC.read_listings_tsv(spark, str(tmp_path / "nope.tsv"))


def test_fixed_lists_are_pinned():
    """The oracle reads the fixed lists from the same module as the Spark side, so a
    changed list would pass there; here it does not."""
    import hashlib
    import json
    from pricewise import constants as K
    from pricewise.operators.i18n import label_rows
    lists = [K.QUALITY_KEYWORDS, sorted(K.STOPWORDS), {str(k): v for k, v in K.CONDITION_PHRASES.items()}, K.SUB_CATEGORIES, [list(r) for r in label_rows()]]
    got = [hashlib.sha256(json.dumps(x, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12] for x in lists]
    assert got == PINNED


PINNED = ["4164e93b8239", "a1f3ec396923", "787356d597df", "94f12a0c329d", "e4040ce3cc3b"]

"""Edge rows with hand-computed results (FIXTURES.md section 4)."""

import math

from pyspark.sql import functions as F

from pricewise.functions import text as TX
from pricewise.operators import cleaning as CL


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_split_category(spark):
    df = spark.createDataFrame([("A/B/C/D/E",), ("A/B/",), ("A",), (None,)], "category_name string")
    out = CL.split_category(df).collect()
    got = [(r.category_name, r.cat_main, r.cat_sub1, r.cat_sub2) for r in out]
    assert got == [("A/B/C/D/E", "A", "B", "C/D/E"), ("A/B/", "A", "B", ""), ("A", "A", "unknown", "unknown"),
                   ("unknown/unknown/unknown", "unknown", "unknown", "unknown")]


def test_clean_description(spark):
    df = spark.createDataFrame([("No description yet",), ("no description yet",), ("A [rm] B [RM]",), (None,)],
                               "item_description string")
    got = [r.item_description for r in CL.clean_description(df).collect()]
    assert got == ["", "no description yet", "a b [rm]", ""]


def test_clean_name_unicode_whitespace(spark):
    assert _one(spark, TX.clean_name("x"), "x  y") == "x y"
    assert _one(spark, TX.clean_name("x"), "  [rm]Hello\t\nWorld [rm] ") == "hello world"


def test_word_count(spark):
    assert _one(spark, TX.word_count("x"), "") == 0
    assert _one(spark, TX.word_count("x"), "  x y ") == 2
    assert _one(spark, TX.word_count("x"), None) == 0
    assert _one(spark, TX.word_count_clean("x"), "a b c") == 3


def test_price_filter(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2000.0,), (2000.01,), (float("nan"),), (None,)], "price double")
    assert sorted(r.price for r in CL.price_range_filter(df).collect()) == [1.0, 2000.0]


def test_keyword_count_is_substring(spark):
    assert _one(spark, TX.keyword_count("x", ["ok", "new", "used"]), "unused book") == 2
    assert _one(spark, TX.keyword_count("x", ["ok"]), None) == 0


def test_keyword_features_score(spark):
    kw = TX.keyword_features("x")
    r = spark.createDataFrame([("Brand NEW, some wear, broken",)], "x string").select(
        *[c.alias(n) for n, c in kw.items()]).first()
    # excellent: "new", "brand new"; fair: "some wear" and "ok" (inside "broken"); poor: "broken"
    assert r.kw_excellent == 2 and r.kw_fair == 2 and r.kw_poor == 1
    assert r.quality_score == 2.0 - 1.0 - 1.0
    assert r.has_quality_keywords == 1 and r.has_luxury_keywords == 0


def test_normalize_and_tokens(spark):
    assert _one(spark, TX.normalize_text("x"), "  Héllo, World!! 42 ") == "h llo world 42"
    toks = _one(spark, TX.raw_tokens("x"), "The iPhone-X is a 64GB phone")
    assert toks == ["the", "iphone", "is", "64gb", "phone"]


def test_enrich_listing(spark):
    df = spark.createDataFrame([("iPhone", "", "Apple", "Electronics", "TV & Audio", 2)],
                               "n string, d string, b string, m string, s string, c int")
    name, desc = TX.enrich_listing("n", "d", "b", "m", "s", "c")
    r = df.select(name.alias("name"), desc.alias("desc")).first()
    assert r.name == "apple iphone"
    assert r.desc == "apple iphone electronics tv & audio apple brand new without tags nwot unused mint condition"


def test_enrich_unknown_condition_trailing_space(spark):
    df = spark.createDataFrame([("Lamp", "nice lamp home decor", "unknown", "Home", "Decor", 9)],
                               "n string, d string, b string, m string, s string, c int")
    _, desc = TX.enrich_listing("n", "d", "b", "m", "s", "c")
    assert df.select(desc.alias("d")).first().d == "nice lamp home decor "


def test_price_band(spark):
    from pricewise.operators import scoring as SC
    df = spark.createDataFrame([(math.log(1.5),)], "prediction double")
    r = SC.with_price_band(df).first()
    assert r.predicted_price == 1.0 and r.price_low == 1.0
    assert abs(r.price_high - 1.0075) < 1e-12


def test_meaningful_words(spark):
    df = spark.createDataFrame([("an iPhone", "is ok and works")], "n string, d string")
    assert df.select(TX.meaningful_words("n", "d").alias("m")).first().m == 3


def test_meaningful_words_of_cleaned_texts(spark):
    rows = [("İİ ab", "a\u3000bcd\x1fxyz  q"), (None, None), ("", "  "), ("\U0001f600\U0001f600 \U0001f600ab", "[rm] No")]
    df = spark.createDataFrame(rows, "n string, d string").select(TX.clean_name("n").alias("n"), TX.clean_description("d").alias("d"))
    got = df.select(TX.meaningful_words("n", "d").alias("a"), TX.meaningful_words("n", "d", cleaned=True).alias("b")).collect()
    assert [r.b for r in got] == [r.a for r in got] and max(r.b for r in got) == 3


def test_ngrams_are_array_functions(spark):
    """Up to three words, short and empty rows, stop words taken out first; no function that decodes every string."""
    from pricewise.operators import tfidf as TF
    df = spark.createDataFrame([(1, "red the wool a coat new"), (2, "the of"), (3, None), (4, "coat"), (5, "coat coat")], "train_id long, t string")
    grams = lambda lo, hi: {r.train_id: r.terms for r in TF.listing_terms(df, ("t",), ngram_range=(lo, hi)).collect()}
    assert grams(1, 2) == {1: ["red", "wool", "coat", "new", "red wool", "wool coat", "coat new"], 2: [], 3: [], 4: ["coat"], 5: ["coat", "coat", "coat coat"]}
    assert grams(3, 3) == {1: ["red wool coat", "wool coat new"], 2: [], 3: [], 4: [], 5: []}
    assert "UDF" not in TF.listing_terms(df, ("t",))._jdf.queryExecution().executedPlan().toString()

"""Listing cleaning: price range filter, brand fill, category split, text
cleaning, text-length features and the top-brand flag.

The whole chain is narrow (one codegen stage) except the top-brand flag,
which needs one partial+final aggregate over brands and a broadcast of at
most ``top_n`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX


def price_range_filter(df: DataFrame, min_price: float = K.DEFAULT_MIN_PRICE,
                       max_price: float = K.DEFAULT_MAX_PRICE) -> DataFrame:
    """Keep min <= price <= max; null and NaN prices are dropped (NaN fails the
    upper bound). Pushed down to the Parquet scan as a range predicate."""
    p = F.col("price")
    return df.filter(p.isNotNull() & ~F.isnan(p) & (p >= F.lit(float(min_price))) & (p <= F.lit(float(max_price))))


def fill_missing_brand(df: DataFrame, fill_value: str = K.UNKNOWN) -> DataFrame:
    return df.withColumn("brand_name", F.coalesce(F.col("brand_name"), F.lit(fill_value)))


def split_category(df: DataFrame) -> DataFrame:
    filled, main, sub1, sub2 = TX.split_category("category_name")
    return (df.withColumn("category_name", filled)
              .withColumn("cat_main", main).withColumn("cat_sub1", sub1).withColumn("cat_sub2", sub2))


def clean_name(df: DataFrame) -> DataFrame:
    return df.withColumn("name", TX.clean_name("name"))


def clean_description(df: DataFrame) -> DataFrame:
    return df.withColumn("item_description", TX.clean_description("item_description"))


def add_text_features(df: DataFrame, cleaned: bool = True) -> DataFrame:
    """name_len / desc_len = whitespace word counts; has_description.
    On cleaned text (single spaces, trimmed) a plain split is exact."""
    wc = TX.word_count_clean if cleaned else TX.word_count
    return (df.withColumn("name_len", wc("name"))
              .withColumn("desc_len", wc("item_description"))
              .withColumn("has_description", (F.col("desc_len") > 0).cast("int")))


def brand_counts(df: DataFrame) -> DataFrame:
    """Listings per known brand (excludes 'unknown'). Partial aggregation
    collapses a hot brand on the map side before the shuffle."""
    return (df.filter(F.col("brand_name") != F.lit(K.UNKNOWN))
              .groupBy("brand_name").agg(F.count(F.lit(1)).alias("n_listings")))


def top_brands(df: DataFrame, top_n: int = K.TOP_BRANDS_N) -> DataFrame:
    """The ``top_n`` most frequent known brands; ties by brand name.
    TakeOrderedAndProject keeps at most ``top_n`` rows per partition."""
    return brand_counts(df).orderBy(F.desc("n_listings"), F.asc("brand_name")).limit(top_n)


def add_brand_features(df: DataFrame, top_n: int = K.TOP_BRANDS_N, brands: DataFrame | None = None) -> DataFrame:
    """is_top_brand = brand among the ``top_n`` most frequent known brands.
    The top table has at most ``top_n`` rows, so it is broadcast. ``brands``:
    the same rows with fewer columns, if the caller has them without a join."""
    top = F.broadcast(top_brands(df if brands is None else brands, top_n).select(F.col("brand_name").alias("_tb"), F.lit(1).alias("_is_top")))
    return (df.join(top, df["brand_name"] == top["_tb"], "left")
              .withColumn("is_top_brand", F.coalesce(F.col("_is_top"), F.lit(0)).cast("int"))
              .drop("_tb", "_is_top"))


def clean_rows(df: DataFrame, min_price: float = K.DEFAULT_MIN_PRICE, max_price: float = K.DEFAULT_MAX_PRICE) -> DataFrame:
    """The cleaning steps before the texts: price filter, brands, categories."""
    out = price_range_filter(df, min_price, max_price)
    for column, step in (("brand_name", fill_missing_brand), ("category_name", split_category)):
        if column in df.columns:
            out = step(out)
    return out


def clean_texts(df: DataFrame) -> DataFrame:
    """The cleaning steps of name and description."""
    for column, step in (("name", clean_name), ("item_description", clean_description)):
        if column in df.columns:
            df = step(df)
    return df


def clean_listings(df: DataFrame, min_price: float = K.DEFAULT_MIN_PRICE,
                   max_price: float = K.DEFAULT_MAX_PRICE, add_features: bool = True,
                   top_n: int = K.TOP_BRANDS_N, brands: DataFrame | None = None) -> DataFrame:
    """Filter prices, fill brands, split categories, clean name and
    description, then (optionally) add text features and the top-brand flag.
    Steps for columns that a narrow view lacks are left out. ``brands``: the
    raw rows with price and brand only, for the top-brand counts."""
    out = clean_texts(clean_rows(df, min_price, max_price))
    if add_features:
        if {"name", "item_description"} <= set(df.columns):
            out = add_text_features(out)
        if brands is not None:
            brands = fill_missing_brand(price_range_filter(brands, min_price, max_price))
        out = add_brand_features(out, top_n, brands)
    return out


def required_columns(df: DataFrame, required=K.REQUIRED_COLUMNS) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def split_target(df: DataFrame, key: str = "train_id") -> DataFrame:
    """Target/feature separation: ``price`` becomes ``label`` in the same row
    (no index alignment); the key is kept for joins but is never a feature."""
    if "price" not in df.columns:
        raise ValueError("missing column 'price'")
    return df.withColumnRenamed("price", "label")

"""Table profiles and statistics.

Every statistic is one aggregate pass with partial (map-side) aggregation.
Exact medians avoid the single-buffer ``percentile`` aggregate: approximate
brackets narrow the candidates round by round, and only a bounded number of
values is ever fetched (see :func:`kth_smallest`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import text as TX

FIXED_WIDTH = {"bigint": 8, "double": 8, "int": 4, "smallint": 2, "tinyint": 1, "boolean": 1, "float": 4}


def table_profile(df: DataFrame) -> DataFrame:
    """Long form: column, position, dtype, n_rows, n_missing, pct_missing
    (rounded to 2), approx_bytes (UTF-8 bytes of strings, fixed widths
    otherwise). One aggregate pass over the table."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        miss = c.isNull() | (F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.lit(False))
        aggs.append(F.sum(miss.cast("long")).alias(f"m{i}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.sum(F.octet_length(c)).cast("long").alias(f"b{i}"))
    row = df.agg(*aggs)
    n = F.col("__n")
    structs = []
    for i, f in enumerate(df.schema.fields):
        dtype = f.dataType.simpleString()
        b = F.coalesce(F.col(f"b{i}"), F.lit(0)) if isinstance(f.dataType, T.StringType) \
            else (n - F.col(f"m{i}")) * F.lit(FIXED_WIDTH.get(dtype, 8))
        structs.append(F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(dtype).alias("dtype"),
                                F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("long").alias("n_missing"),
                                b.cast("long").alias("approx_bytes")))
    long = row.select(n.cast("long").alias("n_rows"), F.explode(F.array(*structs)).alias("p")).select("n_rows", "p.*")
    return long.select("column", "position", "dtype", "n_rows", "n_missing",
                       F.round(F.when(F.col("n_rows") > 0, F.col("n_missing") * 100.0 / F.col("n_rows")), 2).alias("pct_missing"),
                       "approx_bytes")


def kth_smallest(df: DataFrame, col: str, ranks: list[int], accuracy: int = 10_000) -> list[float]:
    """Exact values at 0-based ``ranks`` of a numeric column (nulls and NaN
    excluded), without sorting the column or holding it in one buffer.

    Each round brackets the wanted ranks with ``percentile_approx`` (rank
    error about n/accuracy) on the rows still in play, then counts the rows
    below the bracket, equal to either end and strictly inside. Ranks that
    fall on an end are answered at once; the rest continue with the strict
    interior, which shrinks every round (an end is always a data value). The
    driver sees counts and bracket ends only, at every size. ``df`` is read in
    every round: pass a narrow, written table."""
    v = F.col("v")
    base = df.select(F.col(col).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    answers: dict[int, float] = {}
    pending = sorted(set(ranks))
    below, sub = 0, base
    m = sub.count()
    while pending:
        eps = 2.0 / accuracy
        while True:
            f_lo = max(0.0, (min(pending) - below) / m - eps)
            f_hi = min(1.0, (max(pending) - below) / m + eps)
            q0, q1 = sub.agg(F.percentile_approx("v", [f_lo, f_hi], accuracy).alias("q")).first()["q"]
            st = sub.agg(F.sum((v < F.lit(q0)).cast("long")).alias("nb"),
                         F.sum((v == F.lit(q0)).cast("long")).alias("c0"),
                         F.sum(((v > F.lit(q0)) & (v < F.lit(q1))).cast("long")).alias("cm"),
                         F.sum(((v == F.lit(q1)) & F.lit(q1 > q0)).cast("long")).alias("c1")).first()
            nb, c0, cm, c1 = (int(st[x] or 0) for x in ("nb", "c0", "cm", "c1"))
            if below + nb <= min(pending) and max(pending) < below + nb + c0 + cm + c1:
                break
            eps *= 4                         # the bracket missed: widen and retry
        rest = []
        for k in pending:
            r = k - below - nb
            if r < c0:
                answers[k] = q0
            elif r >= c0 + cm:
                answers[k] = q1
            else:
                rest.append(k)
        pending, below, m = rest, below + nb + c0, cm
        sub = base.filter((v > F.lit(q0)) & (v < F.lit(q1)))
    return [answers[k] for k in ranks]


def exact_median(df: DataFrame, col: str, accuracy: int = 10_000) -> float | None:
    """Exact median (mean of the two middle values for even counts). The
    column is written once, so its plan is not evaluated in every round."""
    from ..session import materialize
    v = F.col("v")
    one = materialize(df.select(F.col(col).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v)), "median")
    n = one.count()
    if n == 0:
        return None
    a, b = kth_smallest(one, "v", [(n - 1) // 2, n // 2], accuracy)
    return (a + b) / 2.0


def clean_stats(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """One row: n_rows, n_cols, price min/max/mean/median, distinct main
    categories and brands, % unknown brand, mean name/desc length.
    ``prices``: the same rows' prices, if the caller has them without a join."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).cast("long").alias("n_rows"),
            F.min("price").alias("price_min"), F.max("price").alias("price_max"),
            F.avg("price").alias("price_mean"),
            (F.countDistinct("cat_main").cast("long") if "cat_main" in cols else F.lit(None).cast("long")).alias("n_categories_main"),
            F.countDistinct("brand_name").cast("long").alias("n_brands"),
            (F.avg((F.col("brand_name") == F.lit(K.UNKNOWN)).cast("double")) * 100.0).alias("pct_unknown_brand"),
            (F.avg("name_len") if "name_len" in cols else F.lit(None).cast("double")).alias("avg_name_len"),
            (F.avg("desc_len") if "desc_len" in cols else F.lit(None).cast("double")).alias("avg_desc_len")]
    med = exact_median(df if prices is None else prices, "price")
    return df.agg(*aggs).select("n_rows", F.lit(len(cols)).cast("long").alias("n_cols"), "price_min", "price_max",
                                "price_mean", F.lit(med).cast("double").alias("price_median"), "n_categories_main",
                                "n_brands", "pct_unknown_brand", "avg_name_len", "avg_desc_len")


def category_level_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("cat_main").cast("long").alias("n_cat_main"),
                  F.countDistinct("cat_sub1").cast("long").alias("n_cat_sub1"),
                  F.countDistinct("cat_sub2").cast("long").alias("n_cat_sub2"))


def _long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def value_counts(df: DataFrame, columns: list[str] = K.CATEGORY_STATS_COLUMNS) -> DataFrame:
    """(column, value, n) for non-null values; partial aggregation first."""
    return (_long_values(df, columns).filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).cast("long").alias("n")))


def category_stats(df: DataFrame, columns: list[str] = K.CATEGORY_STATS_COLUMNS) -> DataFrame:
    """Per column: distinct non-null values and missing count."""
    lv = _long_values(df, columns)
    return (lv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("column")
              .agg(F.sum(F.when(F.col("value").isNotNull(), 1).otherwise(0)).cast("long").alias("n_unique"),
                   F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("n_missing")))


def top_k_per_group(counts: DataFrame, group: str, order: list, k: int, salt_buckets: int = 64,
                    salt_on: str = "value") -> DataFrame:
    """Exact top-k per group in two rounds: top-k inside (group, salt)
    buckets, then top-k over at most k*salt_buckets survivors per group.
    A group with many distinct values is never ranked in one task."""
    salted = counts.withColumn("_salt", F.pmod(F.hash(F.col(salt_on)), F.lit(salt_buckets)))
    first = (salted.withColumn("_r1", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order)))
             .filter(F.col("_r1") <= k).drop("_r1", "_salt"))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("int"))
            .filter(F.col("rank") <= k))


def top_k_values(df: DataFrame, k: int = 5, columns: list[str] = K.CATEGORY_STATS_COLUMNS) -> DataFrame:
    """Top-k values per column by count (ties by value)."""
    return top_k_per_group(value_counts(df, columns), "column", [F.desc("n"), F.asc("value")], k)


def removal_report(raw: DataFrame, cleaned: DataFrame, kw_text: str = "item_description") -> DataFrame:
    """Before/after counts of the cleaning chain and the logged counters."""
    before = raw.agg(F.count(F.lit(1)).cast("long").alias("n_before"),
                     F.sum(F.col("brand_name").isNull().cast("long")).alias("n_missing_brand_raw"))
    kw = TX.keyword_features(kw_text)
    after = cleaned.agg(
        F.count(F.lit(1)).cast("long").alias("n_after"),
        F.sum((F.col("brand_name") == F.lit(K.UNKNOWN)).cast("long")).alias("n_unknown_brand"),
        F.sum("is_top_brand").cast("long").alias("n_top_brand"),
        F.sum(kw["has_quality_keywords"]).cast("long").alias("n_quality_keywords"),
        F.sum(kw["has_luxury_keywords"]).cast("long").alias("n_luxury_keywords"),
        F.avg("name_len").alias("avg_name_len"), F.avg("desc_len").alias("avg_desc_len"))
    # Two one-row aggregates become one row: union them and take max per column.
    j = before.unionByName(after, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ["n_before", "n_missing_brand_raw", "n_after", "n_unknown_brand", "n_top_brand",
                                             "n_quality_keywords", "n_luxury_keywords", "avg_name_len", "avg_desc_len"]])
    return j.select(
        "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"),
        F.when(F.col("n_before") > 0, F.round((F.col("n_before") - F.col("n_after")) * 100.0 / F.col("n_before"), 4))
         .otherwise(F.lit(0.0)).alias("pct_removed"),
        "n_unknown_brand", "n_top_brand", "n_quality_keywords", "n_luxury_keywords",
        F.round("avg_name_len", 6).alias("avg_name_len"), F.round("avg_desc_len", 6).alias("avg_desc_len"))


def target_summary(df: DataFrame, price: str = "price") -> DataFrame:
    """min/max/median of the target and min/max of log1p(target)."""
    med = exact_median(df, price)
    return df.agg(F.min(price).alias("price_min"), F.max(price).alias("price_max"),
                  F.min(F.log1p(price)).alias("log_price_min"), F.max(F.log1p(price)).alias("log_price_max")) \
        .select("price_min", "price_max", F.lit(med).cast("double").alias("price_median"),
                "log_price_min", "log_price_max")

"""Categorical encoders in relational form.

Fitted state is a small DataFrame (category -> code/value) plus at most a
scalar; it stays distributed. Transform is a left equi-join with a default:
AQE broadcasts the table when its measured size is small and otherwise keeps
a sort-merge join with skew splitting, so a category that holds a third of
the rows (e.g. 'unknown' brands) does not land in one task.

Nulls are encoded as the ordinary category 'unknown' everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def filled(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(K.UNKNOWN))


# ---------------------------------------------------------------- label ----

@dataclass
class LabelEncoding:
    column: str
    classes: DataFrame          # (value string, idx int), idx by sorted value
    n_classes: int
    unknown_value: int | str = -1

    @property
    def unknown_code(self) -> int:
        return self.n_classes if self.unknown_value == "max" else int(self.unknown_value)

    def transform(self, df: DataFrame, out_col: str | None = None) -> DataFrame:
        out = out_col or f"{self.column}_label"
        cls = self.classes.select(F.col("value").alias("_lv"), F.col("idx").alias("_li"))
        return (df.join(cls, filled(self.column) == F.col("_lv"), "left")
                  .withColumn(out, F.coalesce(F.col("_li"), F.lit(self.unknown_code)).cast("int"))
                  .drop("_lv", "_li"))

    def inverse_transform(self, df: DataFrame, code_col: str, out_col: str) -> DataFrame:
        """Codes outside [0, k) or equal to the unknown code -> 'unknown'."""
        cls = self.classes.select(F.col("value").alias("_iv"), F.col("idx").alias("_ii"))
        return (df.join(cls, F.col(code_col) == F.col("_ii"), "left")
                  .withColumn(out_col, F.coalesce(F.col("_iv"), F.lit(K.UNKNOWN))).drop("_iv", "_ii"))


def fit_label_encoder(df: DataFrame, column: str, unknown_value: int | str = -1) -> LabelEncoding:
    """Sorted distinct values -> 0..k-1. The distinct is a partial+final
    aggregate; the index is a distributed dense rank (:func:`sorted_index`)."""
    values = df.select(filled(column).alias("value")).distinct()
    classes = sorted_index(values, "value")
    n = classes.count()
    return LabelEncoding(column, classes, n, unknown_value)


def sorted_index(values: DataFrame, col: str, idx_col: str = "idx") -> DataFrame:
    """(col, idx) with idx = 0-based position in ascending order, without a
    single-partition window.

    The values are range-sorted and tagged with their partition position,
    then checkpointed into the shared folder, so the partition contents are
    fixed. Each partition's offset (rows in earlier partitions) comes from a
    table with one row per partition, which is broadcast."""
    from ..session import cut_lineage
    s = cut_lineage(values.orderBy(col).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    counts = s.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offs = counts.withColumn("_o", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (s.join(F.broadcast(offs), part == F.col("_p"), "inner")
             .select(col, (F.col("_o") + F.col("_mid") - F.shiftleft(F.col("_p"), 33)).cast("int").alias(idx_col)))


# -------------------------------------------------------------- one-hot ----

@dataclass
class OneHotEncoding:
    column: str
    categories: DataFrame       # (value, idx)
    n_categories: int
    handle_unknown: str = "ignore"

    def feature_names(self, names: list[str]) -> list[str]:
        return [f"{self.column}_{v}" for v in names]

    def transform_index(self, df: DataFrame, out_col: str | None = None) -> DataFrame:
        """Column index of the hot slot, null when unseen (all zeros)."""
        out = out_col or f"{self.column}_idx"
        cats = self.categories.select(F.col("value").alias("_ov"), F.col("idx").alias("_oi"))
        res = df.join(cats, filled(self.column) == F.col("_ov"), "left").withColumnRenamed("_oi", out).drop("_ov")
        if self.handle_unknown == "error":
            res = res.withColumn(out, F.when(F.col(out).isNull(), F.raise_error(F.lit("unknown category"))).otherwise(F.col(out)))
        return res


def fit_one_hot(df: DataFrame, column: str, handle_unknown: str = "ignore") -> OneHotEncoding:
    enc = fit_label_encoder(df, column)
    return OneHotEncoding(column, enc.classes, enc.n_classes, handle_unknown)


# --------------------------------------------------------------- target ----

@dataclass
class TargetEncoding:
    column: str
    table: DataFrame            # (category, n, mean, encoded)
    global_mean: float
    fill_value: float | None = None

    @property
    def default(self) -> float:
        return self.global_mean if self.fill_value is None else float(self.fill_value)

    def transform(self, df: DataFrame, out_col: str | None = None) -> DataFrame:
        out = out_col or f"{self.column}_encoded"
        enc = self.table.select(F.col("category").alias("_tc"), F.col("encoded").alias("_te"))
        return (df.join(enc, filled(self.column) == F.col("_tc"), "left")
                  .withColumn(out, F.coalesce(F.col("_te"), F.lit(self.default)).cast("double"))
                  .drop("_tc", "_te"))

    def unknown_count(self, df: DataFrame) -> DataFrame:
        return unknown_values(df, self.column, self.table.select(F.col("category").alias("value")))


def fit_target_encoder(df: DataFrame, column: str, label: str = "label",
                       smoothing: float = K.TARGET_SMOOTHING, min_samples: int = K.TARGET_MIN_SAMPLES,
                       fill_value: float | None = None) -> TargetEncoding:
    """Smoothed category mean: (n*mean + s*global)/(n + s); categories with
    fewer than ``min_samples`` rows get exactly the global mean.

    One partial+final hash aggregate per column (a hot category is combined
    map-side); the global mean is a scalar derived from the same aggregate.
    """
    stats = (df.groupBy(filled(column).alias("category"))
               .agg(F.count(F.col(label)).alias("n"), F.sum(F.col(label)).alias("s")))
    from ..session import materialize
    stats = materialize(stats, "target-statistics")
    tot = stats.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    g = float(tot["s"]) / float(tot["n"]) if tot["n"] else float("nan")
    sm = float(smoothing)
    table = stats.select(
        "category", "n", (F.col("s") / F.col("n")).alias("mean"),
        F.when(F.col("n") < F.lit(min_samples), F.lit(g))
         .otherwise((F.col("s") + F.lit(sm * g)) / (F.col("n") + F.lit(sm))).alias("encoded"))
    return TargetEncoding(column, table, g, fill_value)


# -------------------------------------------------------------- unknown ----

def unknown_values(df: DataFrame, column: str, fitted_values: DataFrame) -> DataFrame:
    """Rows whose value is not in the fitted map (anti-join), as one count."""
    fv = fitted_values.select(F.col("value").alias("_fv"))
    return (df.select(filled(column).alias("_v"))
              .join(fv, F.col("_v") == F.col("_fv"), "left_anti")
              .agg(F.count(F.lit(1)).cast("long").alias("n_unknown"))
              .select(F.lit(column).alias("column"), "n_unknown"))

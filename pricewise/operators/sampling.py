"""Deterministic sampling, splits and folds.

Randomness is a hash: ``h = md5(key || '|' || seed)``; rows are ordered by
(h, key). Exact ranks in that order need no single-partition window: rows are
bucketed by the first hex characters of ``h``, and a bucket's rows start at
the number of rows in earlier buckets. Splits, samples and folds only need to
know on which side of a cut a row falls: whole buckets are labelled from the
table of bucket counts, and only the rows of the few buckets that straddle a
cut are ranked, by a window inside their bucket. The two parts are put
together by a union, so repeated and null keys neither multiply nor drop rows
(which of several rows with one key lies before a cut is arbitrary, how many
is exact). A stratum that holds a third of the rows is still spread over all
of its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K

DIGITS = 4                     # 65,536 buckets for each stratum, at every size
BROADCAST_BUCKETS = 1_000_000  # rows of the bucket table (about 40 bytes each) up to which it is broadcast


def hash_col(key: str = "train_id", seed: int = K.SPLIT_SEED):
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("\u0000null")), F.lit(f"|{seed}")))


def bucket_offsets(df: DataFrame, key: str, seed: int, by: list[str], digits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with _h/_b, per-(group, bucket) table with _nb rows and _off
    rows in earlier buckets)."""
    d = df.withColumn("_h", hash_col(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    # Offsets in two steps, so that no task orders more than one prefix's buckets.
    counts = counts.withColumn("_p", F.substring("_b", 1, digits // 2))
    inside = Window.partitionBy(*by, "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = counts.groupBy(*by, "_p").agg(F.sum("_nb").alias("_np")).withColumn("_po", F.coalesce(F.sum("_np").over(before), F.lit(0)))
    prefixes = prefixes.select(*[F.col(c).alias(f"_x_{c}") for c in by], F.col("_p").alias("_xp"), "_po")
    j = counts.join(prefixes, _same(counts, by, "_x_") & (F.col("_p") == F.col("_xp")))
    offsets = j.select(*by, "_b", "_nb", (F.col("_po") + F.coalesce(F.sum("_nb").over(inside), F.lit(0))).alias("_off"))
    return d, offsets


def _same(df: DataFrame, by: list[str], prefix: str):
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return cond


def label_by_rank(df: DataFrame, thresholds: DataFrame | list[int], key: str = "train_id",
                  seed: int = K.SPLIT_SEED, by: list[str] | None = None, digits: int = DIGITS,
                  label_col: str = "_label") -> DataFrame:
    """label = number of thresholds <= the row's rank in (h, key) order
    (per ``by`` group; ``thresholds`` is a list, or a DataFrame of
    (by..., _t array<long>) with one row per group).

    The bucket table is written once; it is broadcast up to
    ``BROADCAST_BUCKETS`` rows and joined by a shuffle beyond."""
    from ..session import materialize
    by = list(by or [])
    d, offs = bucket_offsets(df, key, seed, by, digits)
    if isinstance(thresholds, list):
        offs = offs.withColumn("_t", F.array(*[F.lit(int(t)).cast("long") for t in thresholds]))
    else:
        t = thresholds.select(*[F.col(c).alias(f"_x_{c}") for c in by], "_t")
        offs = offs.join(t, _same(offs, by, "_x_")).drop(*[f"_x_{c}" for c in by])
    below = lambda x: F.size(F.filter("_t", lambda t: t <= x))
    offs = offs.withColumn("_lo", below(F.col("_off"))).withColumn("_hi", below(F.col("_off") + F.col("_nb") - 1))
    offs = offs.select(*[F.col(c).alias(f"_x_{c}") for c in by], F.col("_b").alias("_xb"), "_off", "_t", "_lo", "_hi")
    offs = materialize(offs, "buckets")
    side = F.broadcast if offs.count() <= BROADCAST_BUCKETS else (lambda x: x)
    own = (F.col("_b") == F.col("_xb")) & _same(d, by, "_x_")
    whole = d.join(side(offs.filter("_lo = _hi").drop("_off", "_t")), own).withColumn(label_col, F.col("_lo"))
    w = Window.partitionBy(*by, "_b").orderBy("_h", key)
    cut = (d.join(side(offs.filter("_lo <> _hi")), own).withColumn("_r", F.col("_off") + F.row_number().over(w) - 1)
            .withColumn(label_col, below(F.col("_r"))))
    return whole.select(*df.columns, label_col).unionByName(cut.select(*df.columns, label_col))


def exact_sample(df: DataFrame, n: int = K.SAMPLE_SIZE, seed: int = 42, key: str = "train_id") -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows when n >= count):
    the first n rows in hash order. No row cap on a single task."""
    return label_by_rank(df, [n], key, seed).filter(F.col("_label") == 0).drop("_label")


def stratum_quotas(df: DataFrame, stratify_col: str | None, test_size: float = K.SPLIT_TEST_SIZE) -> DataFrame:
    """Train seats per stratum: n_test = ceil(test_size * N); each stratum
    gets floor(c_i * n_train / N) train seats, and the leftover seats go to
    the largest remainders (ties by stratum name). One row per stratum."""
    s = F.col(stratify_col).cast("string") if stratify_col else F.lit("")
    counts = df.groupBy(F.coalesce(s, F.lit("\u0000null")).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    tot = Window.partitionBy()  # over the strata table only (one row per stratum)
    n = F.sum("_c").over(tot)
    n_train = n - F.ceil(F.lit(float(test_size)) * n)
    q = counts.withColumn("_N", n).withColumn("_ntr", n_train.cast("long"))
    q = q.withColumn("_base", F.floor(F.col("_c") * F.col("_ntr") / F.col("_N")).cast("long"))
    q = q.withColumn("_rem", F.col("_c") * F.col("_ntr") - F.col("_base") * F.col("_N"))
    left = F.col("_ntr") - F.sum("_base").over(tot)
    q = q.withColumn("_left", left).withColumn(
        "_order", F.row_number().over(Window.partitionBy().orderBy(F.desc("_rem"), F.asc("_s"))))
    return q.select("_s", (F.col("_base") + (F.col("_order") <= F.col("_left")).cast("long")).alias("_quota"))


def train_val_split(df: DataFrame, test_size: float = K.SPLIT_TEST_SIZE, seed: int = K.SPLIT_SEED,
                    stratify_col: str | None = "cat_main", key: str = "train_id") -> DataFrame:
    """Add ``split`` = 'train' / 'val' with exact sizes (stratified when the
    column exists; an absent column means unstratified, as in the reference).
    Within each stratum the first ``quota`` rows in hash order are train.

    The quotas are computed on a table of one row per stratum.
    """
    if "price" not in df.columns and "label" not in df.columns:
        raise ValueError("missing column 'price'")
    strat = stratify_col if stratify_col and stratify_col in df.columns else None
    s = F.coalesce(F.col(strat).cast("string"), F.lit("\u0000null")) if strat else F.lit("")
    d = df.withColumn("_s", s)
    quotas = stratum_quotas(df, strat, test_size).select("_s", F.array(F.col("_quota")).alias("_t"))
    r = label_by_rank(d, quotas, key, seed, by=["_s"])
    return (r.withColumn("split", F.when(F.col("_label") == 0, F.lit("train")).otherwise(F.lit("val")))
             .drop("_s", "_label"))


def kfold_assign(df: DataFrame, k: int = K.CV_FOLDS, seed: int = K.SPLIT_SEED, key: str = "train_id",
                 fold_col: str = "fold") -> DataFrame:
    """Shuffled k-fold: the hash order cut into k contiguous chunks; the
    first n mod k folds hold one row more (sizes differ by <= 1)."""
    n = df.count()
    q, rem = divmod(n, k)
    sizes = [q + 1 if i < rem else q for i in range(k)]
    cuts = [sum(sizes[:i + 1]) for i in range(k - 1)]
    return (label_by_rank(df, cuts, key, seed)
            .withColumn(fold_col, F.col("_label").cast("int")).drop("_label"))


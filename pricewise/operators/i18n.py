"""Label dictionary and category taxonomy as dimension tables, and the
lookups that use them.

Both tables are fixed and tiny (121 labels, 61 taxonomy pairs), so they are
broadcast; the listings side is never shuffled for these joins.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

LABELS_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "sources", "labels.json")
LABEL_SCHEMA = T.StructType([T.StructField(n, T.StringType(), False) for n in ("lang", "section", "key", "label")])
TAXONOMY_SCHEMA = T.StructType([T.StructField("main", T.StringType(), False),
                                T.StructField("sub", T.StringType(), False),
                                T.StructField("position", T.IntegerType(), False)])


def label_rows(path: str = LABELS_PATH) -> list[tuple[str, str, str, str]]:
    with open(path, encoding="utf-8") as f:
        nested = json.load(f)
    return [(lang, sec, key, label) for lang, secs in nested.items()
            for sec, entries in secs.items() for key, label in entries.items()]


def labels(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(lang, section, key, label) from a nested label dictionary: one JSON document
    at a path that Spark reads, or by default the package's own (which only the
    driver is sure to have). Plain texts beside the sections of a language become
    the section ``texts``."""
    if path is None:
        with open(LABELS_PATH, encoding="utf-8") as f:
            document = spark.createDataFrame([(f.read(),)], "value string")
    else:
        document = spark.read.text(path, wholetext=True)
    by_lang = document.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("lang", "sections"))
    parts = by_lang.select("lang", F.explode("sections").alias("section", "value"))
    entries = F.from_json("value", "map<string, string>")
    nested = parts.filter(F.col("value").startswith("{")).select("lang", "section", F.explode(entries).alias("key", "label"))
    plain = parts.filter(~F.col("value").startswith("{")).select("lang", F.lit("texts").alias("section"), F.col("section").alias("key"), F.col("value").alias("label"))
    return nested.unionByName(plain)


def taxonomy(spark: SparkSession) -> DataFrame:
    """(main, sub, position) pairs of the two-level category taxonomy."""
    rows = [(m, s, i) for m, subs in K.SUB_CATEGORIES.items() for i, s in enumerate(subs)]
    return spark.createDataFrame(rows, TAXONOMY_SCHEMA)


def subcategories_for(spark: SparkSession, mains: DataFrame, main_col: str = "cat_main") -> DataFrame:
    """Allowed sub-categories per main; an unknown main gets ['Other']."""
    tax = taxonomy(spark).groupBy("main").agg(F.array_sort(F.collect_list(F.struct("position", "sub"))).alias("_p"))
    tax = tax.select("main", F.transform("_p", lambda x: x["sub"]).alias("_subs"))
    fallback = F.array(*[F.lit(s) for s in K.TAXONOMY_FALLBACK])
    return (mains.join(F.broadcast(tax), mains[main_col] == tax["main"], "left")
                 .withColumn("sub_categories", F.coalesce("_subs", fallback)).drop("main", "_subs"))


def _section(lbl: DataFrame, section: str, lang: str, alias: str) -> DataFrame:
    return F.broadcast(lbl.filter((F.col("section") == section) & (F.col("lang") == lang))
                       .select(F.col("key").alias(f"_{alias}_k"), F.nullif(F.col("label"), F.lit("")).alias(f"_{alias}")))


def localize_labels(df: DataFrame, lang: str, labels_df: DataFrame,
                    main_col: str = "cat_main", sub_col: str = "cat_sub1",
                    cond_col: str = "item_condition_id") -> DataFrame:
    """Add display labels in ``lang``.

    condition: lang -> en -> id as text; main and sub category: the key
    itself in English, otherwise the translation or the key. Empty labels
    count as missing.
    """
    out = df
    cond_key = F.col(cond_col).cast("string")
    out = (out.join(_section(labels_df, "conditions", lang, "cl"), cond_key == F.col("_cl_k"), "left")
              .join(_section(labels_df, "conditions", "en", "ce"), cond_key == F.col("_ce_k"), "left"))
    out = out.withColumn("condition_label", F.coalesce("_cl", "_ce", cond_key))
    if lang == "en":
        out = out.withColumn("cat_main_label", F.col(main_col)).withColumn("cat_sub1_label", F.col(sub_col))
    else:
        out = (out.join(_section(labels_df, "categories", lang, "mc"), F.col(main_col) == F.col("_mc_k"), "left")
                  .join(_section(labels_df, "sub_categories", lang, "sc"), F.col(sub_col) == F.col("_sc_k"), "left")
                  .withColumn("cat_main_label", F.coalesce("_mc", main_col))
                  .withColumn("cat_sub1_label", F.coalesce("_sc", sub_col)))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in df.columns])


def taxonomy_conformity(df: DataFrame, spark: SparkSession, main_col: str = "cat_main",
                        sub_col: str = "cat_sub1") -> DataFrame:
    """conforms = 1 when (main, sub) is an allowed taxonomy choice; a main
    outside the taxonomy allows only 'Other'."""
    tax = F.broadcast(taxonomy(spark).select(F.col("main").alias("_tm"), F.col("sub").alias("_ts")))
    mains = F.broadcast(taxonomy(spark).select(F.col("main").alias("_km")).distinct())
    j = (df.join(tax, (F.col(main_col) == F.col("_tm")) & (F.col(sub_col) == F.col("_ts")), "left")
           .join(mains, F.col(main_col) == F.col("_km"), "left"))
    ok = F.col("_tm").isNotNull() | (F.col("_km").isNull() & F.col(sub_col).isin(*K.TAXONOMY_FALLBACK))
    return j.withColumn("conforms", ok.cast("int")).drop("_tm", "_ts", "_km")

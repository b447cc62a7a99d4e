"""Listing tables: the derived listings view over the test tables, the raw
TSV reader, and cleaned-table persistence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from .. import constants as K

RAW_SCHEMA = T.StructType([
    T.StructField("train_id", T.LongType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("item_condition_id", T.IntegerType(), False),
    T.StructField("category_name", T.StringType(), True),
    T.StructField("brand_name", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("shipping", T.IntegerType(), False),
    T.StructField("item_description", T.StringType(), True),
])
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]


#: Main categories of the fixed taxonomy for some customer segments.
TAXONOMY_OF_SEGMENT = {"AUTOMOBILE": "Men", "HOUSEHOLD": "Home", "FURNITURE": "Women"}

#: Listings with their texts in one partition of the documents join.
LISTINGS_PER_TASK = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str, nrows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """One raw listing per order, derived from whole tables and whole texts.

    Every order becomes a listing. Its item is part ``k mod |part|`` and its
    description is document ``k mod |documents|`` (part and document ids are
    dense), so every part and every document is used and no row is dropped.
    Both table sizes are parquet-footer counts. The joins are equi-joins on
    a computed key; AQE decides between broadcast and sort-merge for part and
    customer from the real sizes. Documents carry the whole texts (the
    largest table), so that join is always a sort-merge join: the text is
    never broadcast, and the per-row text work downstream runs in the join's
    shuffle partitions. Their number follows the listings (``LISTINGS_PER_TASK``):
    every listing carries a text, so the joined rows may be many times as large as
    the shuffled tables, from whose size AQE would choose far too few partitions.

    ``columns`` (default: all) are the columns that the caller needs; a table is
    joined only if one of them comes from it, so a query without descriptions
    neither reads nor shuffles a text.

    ``nrows`` reads only the first n listings (in key order): the top-n is
    taken on the orders before any join, since every join keeps one row per
    order, so no text of later listings is read.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    if nrows is not None:
        orders = orders.orderBy("o_orderkey").limit(int(nrows))
    columns = [c for c in RAW_COLUMNS if columns is None or c in columns]
    k = F.col("o_orderkey")
    j = orders
    if {"name", "brand_name", "category_name"} & set(columns):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
        j = j.join(part, F.pmod(k, F.lit(part.count())) == part["p_partkey"], "left")
    if "category_name" in columns:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        j = j.join(customer, j["o_custkey"] == customer["c_custkey"], "left")
    if "item_description" in columns:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        parts = max(1, -(-orders.count() // LISTINGS_PER_TASK))
        j = j.withColumn("_doc", F.pmod(k, F.lit(docs.count())).cast(docs.schema["doc_id"].dataType)).repartition(parts, "_doc")
        j = j.join(docs.repartition(parts, "doc_id").hint("merge"), F.col("_doc") == F.col("doc_id"), "left")
    seg, text = F.col("c_mktsegment"), F.col("text")
    # Listings in the fixed taxonomy: main category by segment, a fitting or a
    # foreign second level, and a third level that no other listing has.
    main = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TAXONOMY_OF_SEGMENT.items() for x in pair]), seg), F.lit("Other"))
    in_taxonomy = F.concat_ws("/", main, F.when(k % 2 == 0, F.when(main == "Home", "Bedding").otherwise("Jeans")).otherwise(F.col("p_type")), F.concat(F.lit("lot "), k.cast("string")))
    made = {
        "train_id": lambda: k,
        "name": lambda: F.when(k % 11 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit("  [rm]"))).otherwise(F.col("p_name")),
        "item_condition_id": lambda: F.substring("o_orderpriority", 1, 1).cast("int"),
        "category_name": lambda: (
            F.when(k % 97 == 0, F.lit(None).cast("string"))
             .when(k % 13 == 0, seg)
             .when(k % 23 == 5, in_taxonomy)
             .when(k % 17 == 0, F.concat_ws("/", seg, F.col("p_type"), F.col("p_brand"), F.lit("Extra")))
             .otherwise(F.concat_ws("/", seg, F.col("p_type"), F.col("p_name")))),
        "brand_name": lambda: F.when(k % 5 < 2, F.lit(None).cast("string")).otherwise(F.col("p_brand")),
        "price": lambda: F.when(k % 50 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 200.0),
        "shipping": lambda: (k % 2).cast("int"),
        "item_description": lambda: (
            F.when(k % 29 == 0, F.lit(None).cast("string"))
             .when(k % 19 == 0, F.lit(K.NO_DESCRIPTION))
             .when(k % 7 == 0, F.concat(F.lit("NWT  Brand New [rm] "), text))
             .when(k % 7 == 1, F.concat(F.lit("gently used, minor wear. "), text))
             .when(k % 7 == 2, F.concat(F.lit("Authentic vintage; small STAIN. "), text))
             .otherwise(text)),
    }
    return j.select(*[made[c]().alias(c) for c in columns])


def null_tokens_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Map the reader's missing-value tokens to null in string columns."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    toks = F.array(*[F.lit(t) for t in K.NULL_TOKENS])
    return df.select(*[
        F.when(F.array_contains(toks, F.col(c)), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns])


def read_listings_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Tab-separated listings with a header; quoted cells may hold tabs,
    newlines and doubled quotes. Missing-value tokens become null.

    ``multi_line`` makes each file a single split; without it files are split,
    and no cell may hold a newline. A missing path is a FileNotFoundError, as
    Spark sees the path (not the driver's disk).
    """
    string_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = (spark.read.schema(string_schema)
           .option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", multi_line).option("mode", "FAILFAST").option("nullValue", None)
           .option("emptyValue", "")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           )
    try:
        raw = raw.csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    raw = null_tokens_to_null(raw)
    return raw.select(*[
        (F.col(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def head_n(df: DataFrame, n: int, key: str = "train_id") -> DataFrame:
    """First ``n`` rows in key order (deterministic ``nrows``)."""
    return df.orderBy(key).limit(n)


def write_listings_tsv(df: DataFrame, path: str, n_files: int | None = None, compression: str = "none") -> str:
    """Write listings as header + tab-separated cells, quoting every cell
    that needs it (tabs, newlines, quotes doubled). By default one file for
    each partition, so the multi-line reader gets as many splits as the data
    has partitions. With ``compression`` (such as gzip) the files are compressed;
    the reader knows them by their names, and reads each as a single split."""
    out = df.repartition(n_files) if n_files else df
    (out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", '"')
        .option("escape", '"').option("quoteAll", False)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("compression", compression).csv(path))
    return path

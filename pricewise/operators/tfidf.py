"""TF-IDF over listing text: tokens, 1-2-grams, vocabulary and weights.

Words and pairs of words are found and counted on Arrow batches of whole texts
(``functions/terms.py``); longer grams, and terms asked for as such, come from array
functions in the JVM. The vocabulary is one aggregate by term: the counts of a task
are combined by map-side partial aggregation, so only per-partition partial counts are
shuffled. The kept
vocabulary has at most ``max_features`` rows, which is the bound that lets its
terms and idf values travel to the executors. Weights and their norm are computed
inside the row, on Arrow batches.

Weights: (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), L2-normalised per row;
terms outside the vocabulary are ignored and an empty row stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import terms as TE
from ..functions import text as TX
from .bundles import entries

#: Terms that are counted at a time (a row's terms are never parted).
COUNTED_TERMS = 2_000_000


def listing_terms(df: DataFrame, text_cols=("name", "item_description"), key: str = "train_id",
                  ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """(key, terms): n-grams (unigrams and bigrams by default) of the combined
    normalised text with stop words removed."""
    d = df.select(key, TX.raw_tokens(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])).alias("_raw"))
    return with_terms(d, ngram_range).select(key, "terms")


def lowered_text(text_cols=("name", "item_description")):
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols]))


def listing_texts(df: DataFrame, text_cols=("name", "item_description"), key: str = "train_id") -> DataFrame:
    """(key, text): the combined lowered text, whose terms are those of :func:`listing_terms`."""
    return df.select(key, lowered_text(text_cols).alias("text"))


def with_terms(d: DataFrame, ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """Replace the raw tokens ``_raw`` by the column ``terms``."""
    lo, hi = ngram_range
    if not 1 <= lo <= hi:
        raise ValueError(f"bad ngram_range: {ngram_range}")
    d = d.withColumn("_g1", F.filter("_raw", lambda t: ~t.isin(list(K.STOPWORDS))))
    for n in range(2, hi + 1):  # the shorter grams, each with the word after it
        left = F.greatest(F.size("_g1") - (n - 1), F.lit(0))
        d = d.withColumn(f"_g{n}", F.zip_with(F.slice(f"_g{n - 1}", F.lit(1), left), F.slice("_g1", F.lit(n), left), lambda gram, word: F.concat(gram, F.lit(" "), word)))
    grams = [f"_g{n}" for n in range(lo, hi + 1)]
    return d.withColumn("terms", F.concat(*grams)).drop("_raw", *[f"_g{n}" for n in range(1, hi + 1)])


@dataclass
class Vocabulary:
    table: DataFrame     # (term, idx, df, tf_total, idf)
    n_docs: int
    size: int

    def rows(self) -> list[tuple[str, float]]:
        """(term, idf) in index order; at most ``max_features`` rows."""
        return [(r["term"], float(r["idf"])) for r in self.table.orderBy("idx").select("term", "idf").collect()]


def _count_terms(batches):
    """(term, n, tf) of every stretch of rows: the rows with the term, and its occurrences."""
    for batch in batches:
        lists = batch.column("terms")
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + COUNTED_TERMS, "right")))
            some = lists.slice(at, to - at)
            terms = some.flatten().dictionary_encode(null_encoding="encode")
            code, size = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary)
            rows = np.repeat(np.arange(to - at), np.diff(ends[at:to], prepend=start))
            n = np.bincount(np.unique(rows * size + code) % size, minlength=size) if size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(n, pa.int64()), pa.array(np.bincount(code, minlength=size), pa.int64())], names=["term", "n", "tf"])
            at = to


def term_statistics(terms: DataFrame) -> DataFrame:
    """(term, df, tf_total) over all rows: every occurrence counts for tf_total
    and a row's distinct terms for df. Stretches of rows are counted on Arrow
    batches; one aggregate by term adds the counts up, combining every term inside
    each partition before the shuffle."""
    pairs = terms.select("terms").mapInArrow(_count_terms, "term string, n long, tf long")
    return pairs.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("tf").cast("long").alias("tf_total"))


def text_statistics(texts: DataFrame, ngram_range: tuple[int, int] = (1, 2), text: str = "text") -> DataFrame:
    """As :func:`term_statistics`, from lowered texts."""
    lo, hi = ngram_range
    if not 1 <= lo <= hi:
        raise ValueError(f"bad ngram_range: {ngram_range}")
    if hi > 2:
        return term_statistics(with_terms(texts.select(TX.raw_tokens(text).alias("_raw")), ngram_range))

    def count(batches):
        yield from TE.count_grams(batches, text, K.STOPWORDS, lo, hi)

    pairs = texts.select(text).mapInArrow(count, "term string, n long, tf long")
    return pairs.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("tf").cast("long").alias("tf_total"))


def text_vectors(d: DataFrame, text: str, out: str, terms: list[str], idf: list[float], ngram_range: tuple[int, int] = (1, 2), sublinear_tf: bool = True) -> DataFrame:
    """Replace the lowered ``text`` by the sparse vector ``out`` of the L2-normalised
    weights of its ``terms``, on Arrow batches of texts; the vocabulary travels with
    the function."""
    lo, hi = ngram_range
    if hi > 2:
        d = with_terms(d.withColumn("_raw", TX.raw_tokens(text)).drop(text), ngram_range)
        counted = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="_tf").transform(d).drop("terms")
        return weight_vectors(counted, "_tf", out, idf, sublinear_tf)

    def counts(batches):
        vocabulary = TE.Vocabulary(terms, K.STOPWORDS, lo, hi)
        for b in batches:
            yield b, *vocabulary.counts(b.column(text))

    return _weighted(d, text, out, idf, sublinear_tf, counts)


def weight_vectors(d: DataFrame, counts: str, out: str, idf: list[float], sublinear_tf: bool = True) -> DataFrame:
    """Replace the sparse term ``counts`` by the sparse vector ``out`` of their
    L2-normalised weights, on Arrow batches: the idf values travel with the function,
    not with every row."""
    def stored(batches):
        for b in batches:
            rows, index, count, _ = entries(b.column(counts))
            yield b, rows, index, count

    return _weighted(d, counts, out, idf, sublinear_tf, stored)


def _weighted(d: DataFrame, gone: str, out: str, idf: list[float], sublinear_tf: bool, counts) -> DataFrame:
    """The column ``gone`` replaced by the weights of the (batch, row, index, count) that
    ``counts(batches)`` gives."""
    kept = [f for f in d.schema.fields if f.name != gone]
    schema, size = T.StructType([*kept, T.StructField(out, VectorUDT())]), len(idf)

    def run(batches):
        scale = np.array(idf, np.float64)
        for b, rows, index, count in counts(batches):
            n = b.num_rows
            w = (1.0 + np.log(count) if sublinear_tf else count) * scale[index]
            w /= np.sqrt(np.bincount(rows, w * w, n))[rows]
            offsets = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
            v = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                                            pa.ListArray.from_arrays(offsets, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(w))],
                                           names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), v], names=schema.names)

    return d.mapInArrow(run, schema)


def fit_vocabulary(terms: DataFrame, max_features: int | None = K.TFIDF_MAX_FEATURES,
                   min_df: int | float = K.TFIDF_MIN_DF, max_df: int | float = K.TFIDF_MAX_DF,
                   key: str = "train_id", use_idf: bool = True, ngram_range: tuple[int, int] = (1, 2)) -> Vocabulary:
    """The vocabulary of ``terms``, or of the lowered texts in a column ``text``. Keep min_df <= df <= max_df (a float bound is a fraction of the
    rows), then the ``max_features`` most frequent terms (ties by term);
    index terms alphabetically."""
    n_docs = terms.select(key).count()
    lo = min_df if isinstance(min_df, int) else min_df * n_docs
    hi = max_df if isinstance(max_df, int) else max_df * n_docs
    counted = term_statistics(terms) if "terms" in terms.columns else text_statistics(terms, ngram_range)
    kept = counted.filter((F.col("df") >= F.lit(lo)) & (F.col("df") <= F.lit(hi)))
    if max_features is not None:
        kept = kept.orderBy(F.desc("tf_total"), F.asc("term")).limit(int(max_features))
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0) if use_idf else F.lit(1.0)
    from ..session import materialize
    kept = materialize(kept, "vocabulary-terms")
    # The alphabetical index: a rank over at most max_features rows, or the
    # distributed sorted index when there is no bound.
    if max_features is not None:
        ranked = kept.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    else:
        from .encoders import sorted_index
        index = sorted_index(kept.select(F.col("term").alias("value")))
        ranked = kept.join(index.withColumnRenamed("value", "term"), "term").withColumn("idx", F.col("idx").cast("int"))
    table = materialize(ranked.select("term", "idx", "df", "tf_total", idf.alias("idf")), "vocabulary")
    size = table.count()
    if size == 0:
        raise ValueError("empty vocabulary: no term is within the document-frequency bounds")
    return Vocabulary(table, n_docs, size)


def tfidf_long(terms: DataFrame, vocab: Vocabulary, key: str = "train_id", sublinear_tf: bool = True) -> DataFrame:
    """(key, term, idx, weight) for vocabulary terms, L2-normalised per row, of ``terms``
    or of the lowered texts in a column ``text``.

    Row-local: a sparse count vector against the vocabulary, then its weights, then
    one explode; nothing is shuffled. Terms come in as one small row (a scalar
    subquery), looked up after the explode, so that no row carries them."""
    rows = vocab.rows()
    by_index = vocab.table.agg(F.array_sort(F.collect_list(F.struct("idx", "term"))).alias("v"))
    names, idf = [t for t, _ in rows], [w for _, w in rows]
    if "terms" in terms.columns:
        cv = CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="_tf")
        d = weight_vectors(cv.transform(terms).select(key, "_tf"), "_tf", "_w", idf, sublinear_tf)
    else:
        d = text_vectors(terms.select(key, "text"), "text", "_w", names, idf, sublinear_tf=sublinear_tf)
    d = d.select(key, F.unwrap_udt("_w").alias("_w")).select(key, F.explode(F.arrays_zip("_w.indices", "_w.values")).alias("x"))
    names = by_index.select(F.transform("v", lambda x: x["term"])).scalar()
    return d.select(key, F.get(names, F.col("x.indices")).alias("term"), F.col("x.indices").alias("idx"), F.col("x.values").alias("weight"))

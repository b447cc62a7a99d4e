"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import posixpath
import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricewise.session import checkpoint_dir

#: The six characters that separate words: space and U+0009 to U+000D.
WHITESPACE = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A-Z to a-z, nothing else (``lower`` also changes letters outside ASCII).
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path in the shared checkpoint folder."""
    return posixpath.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str, rows: int | None = None, rows_per_file: int = 20_000) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read
    back: later steps neither recompute it nor depend on its executors. ``rows``:
    about how many rows there are, so that a small table gets few files."""
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // rows_per_file)))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame, shuffles: bool = True) -> None:
    """Delete written tables whose readers have been written themselves, and (with
    ``shuffles``) let Spark drop the shuffle files of plans that nothing refers to any
    more (otherwise they stay until the driver happens to collect its garbage)."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles:
        gc.collect()
        spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows per Arrow batch: texts may be long, so a batch stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sql_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in the JVM; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\x09-\\x0D]+", -1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once per row (a lambda variable), however
    often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8 byte strings; null as empty."""
    import pyarrow as pa
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# Rolling hashes of words: one random 64-bit value per byte, weighted by the
# powers of an odd number modulo 2**64, then mixed.
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHasher:
    """64-bit hashes of all words of a byte string, computed with numpy.

    ``separator`` marks the bytes between words; ``fold`` lower-cases A-Z."""

    def __init__(self, fold: bool = False, separators: bytes = WHITESPACE.encode()):
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.table = _TABLE.copy()
        if fold:
            self.table[65:91] = self.table[97:123]
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 16)
            inv = pow(_BASE, -1, 2**64)
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inv, np.uint64)]), dtype=np.uint64)

    def spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, byte starts, byte ends) of the words of ``text``."""
        b = np.frombuffer(text, np.uint8)
        sep = np.ones(len(b) + 2, bool)
        sep[1:-1] = self.sep[b]
        edge = np.flatnonzero(sep[1:] != sep[:-1])
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64), starts, ends
        self._grow(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.powers[: len(b)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts]), starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing, so that every bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` (at most 64) word hashes, in order; with fewer
    words (but not none) the whole sequence is one run."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = words[: n - k + 1] * _FACTORS[0]
    for j in range(1, k):
        h += words[j : n - k + 1 + j] * _FACTORS[j]
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])

"""Hard-negative mining: exact integer scores by a residue-number-system GEMM.

Vectors become integers (``floor(SCALE * x)``). Their inner products with the
anchors are computed modulo several small primes: the component matrices hold
balanced residues in float32, and a prime is small enough that every partial sum
of a block of ``DEPTH`` components stays below 2**24, so that the products are
exact whatever order they are added in. Balanced mixed-radix digits (the Chinese
remainder theorem by Garner's scheme) give the signed score; the number of primes
follows from the greatest squared length in the table, which bounds every score.

The anchors are a stated query set. They come in shards of bounded size
(``SHARD_BYTES``), one broadcast at a time, and every shard is scored against all
rows in blocks, twice: the first pass keeps the best rows of an anchor's label
(each task its own, then one ranking by anchor), the second selects, for each
positive, the best rows of other labels inside the window that the positive's
score opens. Rows are never shuffled; only the few kept by a task are.

Rows without an id, label or vector, or with a null or non-finite component, take
no part. Rows that repeat (same id, label and vector) count once. Vectors of
unequal length are padded with zeros. Equal scores are ranked by the smaller id.
An anchor without positives, or a positive without negatives in its window, gives
no rows, and so does an empty table. Scores that cannot be held in 64 bits are an
error. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricewise.llm.common import read, release, written

ANCHOR_EVERY, SCALE = 50, 256.0
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
WINDOW = (50, 95)
#: Anchors' components of one broadcast (8 bytes each).
SHARD_BYTES = 16 << 20
#: Components added up before a reduction; anchors and rows of one block.
DEPTH, ANCHOR_BLOCK, ROW_BLOCK = 4096, 512, 4096
#: float32 holds every integer up to here.
EXACT = 1 << 24


def _is_prime(n: int) -> bool:
    return n > 2 and n % 2 == 1 and all(n % d for d in range(3, isqrt(n) + 1, 2))


def moduli(dim: int, bound: int) -> list[int]:
    """The largest primes whose residues' products add up exactly over
    ``min(dim, DEPTH)`` components, as many as scores within ``bound`` need."""
    half = isqrt((EXACT - 4096) // max(1, min(dim, DEPTH)))
    primes, product, p = [], 1, min(2 * half + 1, 2047)
    while product <= 4 * bound + 4096:
        if p < 3:
            raise ValueError("scores are too large for the primes of this dimension")
        if _is_prime(p):
            primes.append(p)
            product *= p
        p -= 1
    return primes


def _reduce(x: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues of integers below 2**24, in place."""
    x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    return x


@dataclass
class Residues:
    """An integer matrix as float32 residues modulo each prime."""
    parts: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray, primes: list[int]) -> Residues:
        return cls([(np.mod(x + p // 2, p) - p // 2).astype(np.float32) for p in primes])

    def rows(self, which) -> Residues:
        return Residues([m[which] for m in self.parts])


def products(a: Residues, b: Residues, primes: list[int]) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, in the
    narrowest type that holds them."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        left, right = a.parts[k], b.parts[k]
        r = _reduce(left[:, :DEPTH] @ right[:, :DEPTH].T, p)
        for at in range(DEPTH, left.shape[1], DEPTH):
            r = _reduce(r + _reduce(left[:, at : at + DEPTH] @ right[:, at : at + DEPTH].T, p), p)
        for q, d in zip(primes[:k], digits, strict=True):  # divide out the digits that are known
            inverse = pow(q, -1, p)
            r = _reduce((r - d) * np.float32(inverse - p if inverse > p // 2 else inverse), p)
        digits.append(r)
    size = 1
    for p in primes:
        size *= p
    kind = np.float32 if size < EXACT else np.float64 if size < 1 << 53 else np.int64
    out, base = digits[0].astype(kind), 1
    for p, d in zip(primes, digits[1:], strict=False):
        base *= p
        out += d.astype(kind) * kind(base)
    return out


class Best:
    """The ``k`` best (score, id) of every slot: higher scores, then smaller ids."""

    NONE = np.iinfo(np.int64).min

    def __init__(self, slots: int, k: int):
        self.k = k
        self.scores = np.full((slots, k), self.NONE, np.int64)
        self.ids = np.full((slots, k), np.iinfo(np.int64).max, np.int64)

    def floor(self) -> np.ndarray:
        """The score a row needs at least to be among the best."""
        return self.scores[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = score.astype(np.int64)
        last = self.scores[slot, -1]
        better = (score > last) | ((score == last) & (ids < self.ids[slot, -1]))
        slot, score, ids = slot[better], score[better], ids[better]
        if not len(slot):
            return
        touched = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, -np.maximum(score, self.NONE + 1), slot))
        slot, score, ids = slot[order], score[order], ids[order]
        new = np.ones(len(slot), bool)  # a repeated row counts once
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        slot, score, ids = slot[new], score[new], ids[new]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        self.scores[touched], self.ids[touched] = self.NONE, np.iinfo(np.int64).max
        self.scores[slot[keep], rank[keep]] = score[keep]
        self.ids[slot[keep], rank[keep]] = ids[keep]

    def batch(self) -> pa.RecordBatch:
        slot, _ = np.nonzero(self.scores != self.NONE)
        found = self.scores != self.NONE
        return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(self.scores[found]), pa.array(self.ids[found])], names=["slot", "score", "vec_id"])


_KEPT = "slot int, score long, vec_id long"


@dataclass
class Shard:
    """Anchors in order of their labels, and the windows of their positives."""
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    primes: list[int]
    low: np.ndarray | None = None   # (anchors, POSITIVES)
    high: np.ndarray | None = None


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of a matrix, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _blocks(batches, dim: int):
    """(ids, labels, matrix) of about ``ROW_BLOCK`` rows each."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROW_BLOCK:
            yield _joined(held, dim)
            held, n = [], 0
    if n:
        yield _joined(held, dim)


def _joined(held: list[pa.RecordBatch], dim: int):
    t = pa.Table.from_batches(held).combine_chunks()
    return t["vec_id"].to_numpy(), t["label"].to_numpy(), _matrix(t["x"].chunk(0), dim)


def _positives(shared, dim: int):
    def run(batches):
        s = shared.value
        best, anchors = Best(len(s.ids), POSITIVES), Residues.of(s.x, s.primes)
        for ids, labels, x in _blocks(batches, dim):
            rows = Residues.of(x, s.primes)
            for label in np.unique(labels):
                mine = np.flatnonzero(labels == label)
                first, last = np.searchsorted(s.labels, [label, label + 1])
                for at in range(first, last, ANCHOR_BLOCK):
                    to = min(at + ANCHOR_BLOCK, last)
                    scores = products(anchors.rows(slice(at, to)), rows.rows(mine), s.primes)
                    a, r = np.nonzero((scores >= best.floor()[at:to, None].astype(scores.dtype)) & (s.ids[at:to, None] != ids[mine]))
                    best.add(at + a, scores[a, r], ids[mine][r])
        yield best.batch()
    return run


def _negatives(shared, dim: int):
    def run(batches):
        s = shared.value
        best, anchors = Best(len(s.ids) * POSITIVES, NEGATIVES), Residues.of(s.x, s.primes)
        for ids, labels, x in _blocks(batches, dim):
            rows = Residues.of(x, s.primes)
            for at in range(0, len(s.ids), ANCHOR_BLOCK):
                to = min(at + ANCHOR_BLOCK, len(s.ids))
                scores = products(anchors.rows(slice(at, to)), rows, s.primes)
                # What a row needs to enter some window of the anchor, then window by window.
                low, high = np.maximum(s.low[at:to], best.floor().reshape(-1, POSITIVES)[at:to]), s.high[at:to]
                open_ = low <= high
                least = np.where(open_, low, np.iinfo(np.int64).max).min(1).astype(scores.dtype)
                most = np.where(open_, high, np.iinfo(np.int64).min).max(1).astype(scores.dtype)
                a, r = np.nonzero((scores >= least[:, None]) & (scores <= most[:, None]) & (s.labels[at:to, None] != labels))
                value, row = scores[a, r].astype(np.int64), ids[r]
                for j in range(POSITIVES):
                    inside = (value >= low[a, j]) & (value <= high[a, j])
                    best.add((at + a[inside]) * POSITIVES + j, value[inside], row[inside])
        yield best.batch()
    return run


def prepared(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, x) of the rows that take part: integer components, labels shifted where the id is divisible by 7."""
    shift = F.when(F.col(key) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(SCALE))
    return (vectors.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(whole)
            .select(F.col(key).cast("long").alias("vec_id"), shift.cast("long").alias("label"), scaled.alias("x")))


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per anchor (an id divisible by ``ANCHOR_EVERY``) and positive: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    raw = prepared(vectors, key, vector, label)
    # The greatest squared length after flooring bounds every score (Cauchy and Schwarz).
    length = F.aggregate("x", F.lit(0.0), lambda a, c: a + (F.abs(c) + 1.0) * (F.abs(c) + 1.0))
    stats = raw.agg(F.max(length).alias("bound"), F.max(F.size("x")).alias("dim"), F.count_if(F.col("vec_id") % ANCHOR_EVERY == 0).alias("n")).first()
    if stats["bound"] is not None and not stats["bound"] < 2.0**60:
        raise ValueError("scores do not fit into 64 bits")
    dim, bound = max(1, stats["dim"] or 0), int(stats["bound"] or 0)
    rows = written(raw.withColumn("x", F.transform("x", lambda c: F.floor(c).cast("double"))), "integer-vectors")
    anchors = written(rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0).dropDuplicates(), "anchors")
    n = max(1, -(-stats["n"] * dim * 8 // shard_bytes))
    out = [_mined(spark, rows, anchors.filter(F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(n)) == k), dim, moduli(dim, bound)) for k in range(n)]
    if n == 1:
        return out[0]
    done = [written(t, "hard-negatives") for t in out]
    release(spark, rows, anchors)
    whole = done[0]
    for t in done[1:]:
        whole = whole.unionByName(t)
    return whole


_SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _ranked(kept: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every slot over all tasks; rows that repeat in several tasks count once."""
    rank = F.dense_rank().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).dropDuplicates(["slot", "rank"])


def _mined(spark: SparkSession, rows: DataFrame, anchors: DataFrame, dim: int, primes: list[int]) -> DataFrame:
    """The negatives of one shard of anchors (their number is bounded by the shard's bytes)."""
    held = anchors.orderBy("label", "vec_id").toArrow().combine_chunks()
    if not held.num_rows:
        return spark.createDataFrame([], _SCHEMA)
    s = Shard(held["vec_id"].to_numpy(), held["label"].to_numpy(), _matrix(held["x"].chunk(0), dim), primes)
    kept = _ranked(rows.mapInArrow(_positives(spark.sparkContext.broadcast(s), dim), _KEPT), POSITIVES)
    found = kept.toArrow()  # at most POSITIVES rows an anchor
    slot, rank = found["slot"].to_numpy(), found["rank"].to_numpy() - 1
    score = np.zeros((len(s.ids), POSITIVES), np.int64)
    positive = np.zeros((len(s.ids), POSITIVES), np.int64)
    there = np.zeros((len(s.ids), POSITIVES), bool)
    score[slot, rank], positive[slot, rank], there[slot, rank] = found["score"].to_numpy(), found["vec_id"].to_numpy(), True
    s.low = np.where(there, -(-WINDOW[0] * score // 100), 1)   # an empty window where there is no positive
    s.high = np.where(there, WINDOW[1] * score // 100, 0)
    kept = _ranked(rows.mapInArrow(_negatives(spark.sparkContext.broadcast(s), dim), _KEPT), NEGATIVES)
    flat = pa.table({"slot": pa.array(np.flatnonzero(there.ravel()), pa.int32()), "anchor_id": np.repeat(s.ids, POSITIVES)[there.ravel()],
                     "positive_id": positive[there], "positive_score": score[there]})
    pairs = spark.createDataFrame(flat)  # POSITIVES rows an anchor of this shard
    return kept.join(pairs, "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                                           F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
      FROM v a, v WHERE a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
        row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
c AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND k <= 5
       AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM c WHERE rank <= 3
"""

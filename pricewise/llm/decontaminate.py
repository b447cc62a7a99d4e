"""Benchmark decontamination by Wu-Manber multi-pattern search.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a text is
normalised to its words with one space between and around them. Every window
of 10 item words (an item of fewer, but not none, is one window) becomes one
pattern, spaces included, so that an occurrence of the pattern is an
occurrence of the words. The search keeps three tables per pattern class:

* ``shift``: for the hash of a block of B bytes, how far the search may move
  on without missing a pattern; most positions are never looked at;
* suffix-hash buckets: where the shift is 0, the patterns whose first m bytes
  end in that block;
* the patterns themselves, compared directly, so hash collisions never count.

The cursors of many stretches of text move together in numpy; the text is
scanned once per shard of patterns.

The benchmark is a fixed test set. Its shards hold at most ``SHARD_BYTES`` of
patterns each and are read one after the other, so neither the driver nor a
task ever holds more than one shard; the documents are never shuffled.

Null and empty texts have no words: no hit, no items. Items without words
never occur. Equal windows of several items count for each of them. Repeated
rows are judged row by row. Empty tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.common import byte_texts, read, small_batches, written

WINDOW = 10
#: Pattern bytes of one shard of benchmark items.
SHARD_BYTES = 32 << 20
#: Length of the stretches whose cursors move together, and bytes searched at once.
STRETCH, CHUNK = 2048, 4 << 20

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class PatternClass:
    """Wu-Manber tables of patterns that have at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes], ids: list[int], block: int):
        self.patterns, self.block = patterns, block
        self.m = m = min(map(len, patterns))
        self.bits = min(22, max(12, int(np.ceil(np.log2(len(patterns) * (m - block + 1)))) + 3))
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        self.shift = np.full(1 << self.bits, m - block + 1, np.uint8 if m < 256 else np.int32)
        for j in range(m - block + 1):  # block that starts at j ends m - block - j bytes before the head's end
            keys = self._hash(self._pack(heads[:, j : j + block]))
            np.minimum.at(self.shift, keys, m - block - j)
        last = self._hash(self._pack(heads[:, m - block :]))
        order = np.argsort(last, kind="stable")
        self.ids = np.asarray(ids)[order]
        self.patterns = [patterns[k] for k in order]
        self.keys, self.first = np.unique(last[order], return_index=True)
        self.after = np.append(self.first[1:], len(order))
        self.prefix = self._pack(heads[order, :block])

    def _pack(self, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(blocks), np.uint64)
        for j in range(blocks.shape[1]):
            out |= blocks[:, j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, pattern id) of all occurrences in ``text``."""
        n, m, b = len(text), self.m, self.block
        if n < m:
            return
        padded = text + b"\0" * 8
        at8 = np.ndarray(n, "<u8", padded, strides=(1,))
        mask = np.uint64((1 << (8 * b)) - 1)
        # A cursor stands on the last byte of the block that ends a head.
        cursor = np.arange(m - 1, n, STRETCH)
        end = np.minimum(cursor + STRETCH, n)
        hits = []
        while len(cursor):
            blocks = at8[cursor - b + 1] & mask
            step = self.shift[self._hash(blocks)]
            if (zero := step == 0).any():
                hits.append(cursor[zero])
                step = np.where(zero, 1, step)
            cursor = cursor + step
            if not (going := cursor < end).all():
                cursor, end = cursor[going], end[going]
        if not hits:
            return
        hits = np.concatenate(hits)
        keys = self._hash(at8[hits - b + 1] & mask)
        where = np.searchsorted(self.keys, keys)
        where[where == len(self.keys)] = 0
        fits = self.keys[where] == keys
        hits, where = hits[fits], where[fits]
        head = at8[hits - m + 1] & mask
        for s, p, f, a in zip((hits - m + 1).tolist(), head, self.first[where].tolist(), self.after[where].tolist(), strict=True):
            for k in range(f, a):
                if self.prefix[k] == p and text.startswith(self.patterns[k], s):
                    yield s, int(self.ids[k])


class Searcher:
    """All windows of one shard of items."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        owners: dict[bytes, list] = {}
        self.width: list[int] = []
        for item, text in items:
            w = words((text or "").encode())
            for i in range(max(1, len(w) - window + 1) if w else 0):
                p = b" " + b" ".join(w[i : i + window]) + b" "
                own = owners.setdefault(p, [])
                if not own:
                    self.width.append(min(window, len(w)))
                if not own or own[-1] != item:
                    own.append(item)
        self.owners = list(owners.values())
        found = list(owners)
        groups = [[i for i, p in enumerate(found) if len(p) < 16], [i for i, p in enumerate(found) if len(p) >= 16]]
        self.classes = [PatternClass([found[i] for i in g], g, b) for g, b in zip(groups, (3, 8), strict=True) if g]

    def search(self, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """For each text (normalised) with occurrences, its (byte start, pattern) pairs."""
        found: dict[int, list[tuple[int, int]]] = {}
        joined = b"\n".join(texts)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for c in self.classes:
            for s, p in c.find(joined):
                k = int(np.searchsorted(bounds, s, "right")) - 1
                found.setdefault(k, []).append((s - int(bounds[k]), p))
        return found


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK or k == len(texts) - 1:
            yield first, texts[first : k + 1]
            first, size = k + 1, 0


def search_batch(texts: list[bytes], searcher: Searcher) -> tuple[list[int], list[np.ndarray | None], list[list]]:
    """Per text: word count, sorted indices of hit words (None for none) and occurring items."""
    n_words, plain = [], []
    for t in texts:
        w = words(t)
        n_words.append(len(w))
        plain.append(b" " + b" ".join(w) + b" " if w else b"")
    covered: list[np.ndarray | None] = [None] * len(texts)
    items: list[list] = [[] for _ in texts]
    marks: dict[int, tuple[np.ndarray, set]] = {}
    for first, part in _chunks(plain):
        for k, pairs in searcher.search(part).items():
            k += first
            starts, widths = zip(*((a, searcher.width[p]) for a, p in pairs), strict=True)
            spaces = np.flatnonzero(np.frombuffer(plain[k], np.uint8) == 32)
            begin = np.searchsorted(spaces, starts)
            diff, own = marks.setdefault(k, (np.zeros(n_words[k] + 1, np.int64), set()))
            np.add.at(diff, begin, 1)
            np.add.at(diff, begin + np.asarray(widths), -1)
            for p in {p for _, p in pairs}:
                own.update(searcher.owners[p])
    for k, (diff, own) in marks.items():
        covered[k] = np.flatnonzero(np.cumsum(diff[:-1]))
        items[k] = sorted(map(str, own))
    return n_words, covered, items


def shards(benchmark: DataFrame, item: str = "item_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[list[tuple]]:
    """The benchmark's items in lists of bounded size, one list at a time. A
    window repeats a word up to ten times, hence the factor."""
    size = benchmark.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))))).first()[0] or 0
    n = max(1, -(-size * WINDOW // shard_bytes))
    for k in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64(item, text), F.lit(n)) == k) if n > 1 else benchmark
        if rows := [tuple(r) for r in part.select(item, text).collect()]:
            yield rows


_FOUND = "__n_words long, __hit array<int>, __items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", keep_all: bool = False) -> DataFrame:
    """Per row of ``docs``: its key (or all its columns), ``__n_words``, ``__hit``
    (ascending indices of the words inside an occurrence, null for none) and
    ``__items`` (occurring item ids as sorted strings).

    With several shards of items, the rows and what was found so far are
    written between two passes; nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = docs.columns if keep_all else [key]
    through = list(dict.fromkeys([*columns, text]))
    cur = docs.select(*[F.col(f"`{c}`") for c in through], F.lit(0).cast("long").alias("__n_words"),
                      F.lit(None).cast("array<int>").alias("__hit"), F.array().cast("array<string>").alias("__items"))
    parts = shards(benchmark)
    rows, more = next(parts, []), next(parts, None)
    while True:
        out = through if more else columns
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)
        cur = cur.mapInArrow(_pass(spark.sparkContext.broadcast(rows), text, out), f"{schema}, {_FOUND}")
        if not more:
            return cur
        cur = written(cur, "decontaminate")
        rows, more = more, next(parts, None)


def _pass(shared, text: str, out: list[str]):
    def run(batches):
        searcher = Searcher(shared.value)
        for b in batches:
            n, hit, items = search_batch(byte_texts(b.column(text)), searcher)
            hit = [old if new is None else new if old is None else np.union1d(old, new) for old, new in zip(b.column("__hit").to_pylist(), hit, strict=True)]
            items = [sorted({*old, *new}) for old, new in zip(b.column("__items").to_pylist(), items, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in out), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=[*out, "__n_words", "__hit", "__items"])
    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns."""
    kept = contamination(docs, benchmark, text=text, keep_all=True).filter(F.col("__hit").isNull())
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(F.size("__hit"), F.lit(0)).cast("long")
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.when(F.col("__hit").isNull(), F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        F.col("__hit").isNotNull().alias("contaminated"))


OP1_SQL = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS rid, doc_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(list_slice(ws, i, i + 9), ' ') AS g
        FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
       FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, lens WHERE len(ws) >= k)),
occ AS (SELECT rid, i, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

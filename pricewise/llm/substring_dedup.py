"""Substring dedup: suffix automata of reference shards, matching statistics.

A window is ``WINDOW`` consecutive words. It is removed from a document if the
same words also start in a document with a smaller id. Suffix automata over
earlier text give, for every word of a streamed passage, the length of the
longest earlier match that ends there (matching statistics); maximal spans at
or above the window length are removed.

One automaton over all documents would grow with the corpus, and streaming
every document through the automata of all shards would cost the square of
it. So the work is cut down first, without losing a window:

1. Every window names an anchor, its smallest hash of ``GRAM`` words (a
   minimizer), so equal windows have equal anchors. Anchors that occur in one
   document only are dropped, by an aggregation that combines before it moves.
2. Documents without a shared anchor are finished there. Of documents with
   equal words the smallest is the reference, the others are covered by it.
3. The stretch of windows around a shared anchor is a segment. A shard is the
   set of anchors that one task gets; its segments stream through the shard's
   automata in the order of the ids: first the segment's matching statistics
   against the segments of smaller documents, then it is added itself.

Hot groups: a segment that occurs ``HOT`` times or more is resolved by its
smallest document, found by an aggregation, so its copies never meet in a
task; an anchor with still ``WIDE`` different segments or more is split into its
single windows, which are shards of their own.

Words are compared by 64-bit hashes. Null and empty texts have no words; texts
below the window length lose nothing. Rows with equal ids never remove each
other's words; rows with a null id neither remove nor lose any. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.bloom import may_hold
from pricewise.llm.common import WordHasher, byte_texts, read, release, shingle_hashes, sliding_min, small_batches, written

WINDOW = 13
GRAM = 4
#: Equal segments from which on an aggregation resolves them, and different
#: segments of an anchor from which on it is split into single windows. The
#: automaton of a group below takes a second or two and about 100 MB.
HOT, WIDE = 2000, 20_000
#: Documents of one file of a written table.
DOCS_PER_FILE = 5000
#: Largest table of hot groups that is broadcast (rows of about 20 bytes).
BROADCAST_ROWS = 200_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of tokens, built online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state of the longest context of ``p`` followed by ``c``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: list) -> None:
        last = 0
        for c in tokens:
            if (q := self.next[last].get(c)) is not None:
                last = self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def statistics(self, tokens: list) -> list[int]:
        """Length of the longest substring seen so far that ends at each token."""
        out, v, n = [], 0, 0
        for c in tokens:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if (q := self.next[v].get(c)) is not None:
                v, n = q, n + 1
            out.append(n)
        return out


def window_anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of every run of windows with one anchor."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_min(shingle_hashes(words, gram), window - gram + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[first], first, np.append(first[1:], len(least)) - 1


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, same, anchors) of every document with a window: the digest of its word
    sequence and its distinct anchors."""
    import xxhash
    small_batches(docs.sparkSession)

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            rows, same, found = [], [], []
            for k, t in enumerate(byte_texts(b.column("t"))):
                words = hasher.spans(t)[0]
                if len(words) >= WINDOW:
                    rows.append(k)
                    same.append(xxhash.xxh3_128_digest(words.tobytes()))
                    found.append(np.unique(window_anchors(words)[0]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), pa.array(same, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["id", "same", "anchors"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
            .mapInArrow(run, f"id {kind}, same binary, anchors array<long>"))


def _shared(sketch: DataFrame, n: int) -> DataFrame:
    """Anchors of two documents or more."""
    one = sketch.select("id", F.explode("anchors").alias("anchor"))
    return written(one.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("anchor"), "shared-anchors", n, DOCS_PER_FILE)


def _touched(sketch: DataFrame, shared: DataFrame, n: int) -> DataFrame:
    """(id, copies, shared): documents with shared anchors; ``copies``: digests of
    word sequences of this id that a smaller document has too."""
    classes = sketch.groupBy("same").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last")
    copies = sketch.select("id", "same").join(classes, "same").filter("id <> first").groupBy("id").agg(F.collect_set("same").alias("copies"))
    own = sketch.select("id", F.explode("anchors").alias("anchor")).join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("shared"))
    return written(own.join(copies, "id", "left").select("id", "copies", "shared"), "touched", n, DOCS_PER_FILE)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _finished(docs: DataFrame, touched: DataFrame, n: int, columns: list[str], key: str, text: str) -> DataFrame:
    """All documents: those without shared anchors and copies are finished (``__sha``),
    the others keep their text (``__t``) and shared anchors.

    Only documents that pass a filter of the touched ids go through the join.
    ``__row`` numbers the written rows, so that repeated ids do no harm."""
    import xxhash
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(key).alias("__key"), F.col(text).alias("__t"))
    rows = may_hold(rows, "__key", touched.select("id"), "__maybe")
    alone = rows.filter("NOT __maybe").drop("__maybe").withColumns({"__copies": F.lit(None).cast("array<binary>"), "__shared": F.lit(None).cast("array<long>")})
    joined = rows.filter("__maybe").drop("__maybe").join(touched.select(F.col("id").alias("__id"), F.col("copies").alias("__copies"), F.col("shared").alias("__shared")), F.col("__key") == F.col("__id"), "left").drop("__id")

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            n, removed, sha, left = [], [], [], []
            for t, copies, some in zip(byte_texts(b.column("__t")), b.column("__copies").to_pylist(), b.column("__shared").is_valid().to_pylist(), strict=True):
                words = t.split()
                copy = bool(copies) and xxhash.xxh3_128_digest(hasher.spans(t)[0].tobytes()) in copies
                n.append(len(words))
                removed.append(len(words) if copy else 0)
                sha.append(_sha([]) if copy else None if some else _sha(words))
                left.append(b"" if copy else t if some else None)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in [*columns, "__key"]), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary()).cast(pa.string()),
                 b.column("__shared")], names=[*columns, "__key", "__n", "__removed", "__sha", "__t", "__shared"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{schema}__key {kind}, __n long, __removed long, __sha string, __t string, __shared array<long>"
    every = alone.mapInArrow(run, schema).unionByName(joined.mapInArrow(run, schema))
    return written(every.withColumn("__row", F.monotonically_increasing_id()), "substring-first", n, DOCS_PER_FILE)


def _segments(rows: DataFrame, with_tokens: bool) -> DataFrame:
    """(anchor, id, digest), with tokens also (row, start, tokens): the windows around
    each shared anchor."""
    import xxhash
    names = ["anchor", "id", "digest", *(["row", "start", "tokens"] if with_tokens else [])]

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for i, r, t, shared in zip(b.column("__key").to_pylist(), b.column("__row").to_pylist(), byte_texts(b.column("__t")), b.column("__shared"), strict=True):
                words = hasher.spans(t)[0]
                anchor, first, last = window_anchors(words)
                anchor = anchor.view(np.int64)
                raw = words.tobytes()
                own = np.flatnonzero(np.isin(anchor, shared.values.to_numpy()))
                tokens = [raw[8 * f : 8 * (e + WINDOW)] for f, e in zip(first[own].tolist(), last[own].tolist(), strict=True)]
                out[0] += anchor[own].tolist()
                out[1] += [i] * len(own)
                out[2] += [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in tokens]
                out[3] += [r] * len(own)
                out[4] += first[own].tolist()
                out[5] += tokens if with_tokens else []
            kinds = (pa.int64(), b.column("__key").type, pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out[: len(names)], kinds, strict=False)], names=names)

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.select("__key", "__row", "__t", "__shared").mapInArrow(run, f"anchor long, id {kind}, digest long" + ", row long, start int, tokens binary" * with_tokens)


def _checked(small: DataFrame) -> DataFrame:
    small = written(small, "substring-hot", BROADCAST_ROWS)
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _single_windows(rows: DataFrame) -> DataFrame:
    """Segments of hot anchors cut into windows, each with an anchor of its own."""
    import xxhash

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, r, start, tokens in zip(*(b.column(c).to_pylist() for c in ("id", "row", "start", "tokens")), strict=True):
                for j in range(len(tokens) // 8 - WINDOW + 1):
                    w = tokens[8 * j : 8 * (j + WINDOW)]
                    for o, x in zip(out, (xxhash.xxh3_64_intdigest(w) - (1 << 63), i, r, start + j, w), strict=True):
                        o.append(x)
            kinds = (pa.int64(), b.column("id").type, pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["anchor", "id", "row", "start", "tokens"])

    return rows.select("id", "row", "start", "tokens").mapInArrow(run, f"anchor long, id {rows.schema['id'].dataType.simpleString()}, row long, start int, tokens binary")


def _matched(segments: DataFrame) -> DataFrame:
    """(row, start, end) word spans covered by a window of a smaller document."""

    def run(batches):
        shard, seen, waiting, automaton = None, {}, [], None
        for b in batches:
            out: list[list] = [[], [], []]
            for anchor, i, row, start, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "id", "row", "start", "tokens")), strict=True):
                if anchor != shard:
                    shard, seen, waiting, automaton = anchor, {}, [], None
                while waiting and waiting[0][0] < i:
                    owner, r = waiting.pop(0)
                    if r not in seen:
                        seen[r] = owner
                        if automaton is None:
                            automaton = SuffixAutomaton()
                        automaton.add(np.frombuffer(r, np.uint64).tolist())
                if raw in seen:
                    spans = [(start, start + len(raw) // 8)]
                elif automaton is not None:
                    spans = _spans(automaton.statistics(np.frombuffer(raw, np.uint64).tolist()), start)
                else:
                    spans = []
                for s, e in spans:
                    out[0].append(row)
                    out[1].append(s)
                    out[2].append(e)
                if raw not in seen:
                    waiting.append((i, raw))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["row", "start", "end"])

    shards = segments.repartition("anchor").sortWithinPartitions("anchor", "id")
    return shards.mapInArrow(run, "row long, start int, end int")


def _spans(statistics: list[int], start: int) -> list[tuple[int, int]]:
    """Maximal unions of matches of at least the window's length."""
    out: list[tuple[int, int]] = []
    for e, n in enumerate(statistics):
        if n >= WINDOW:
            s, e = start + e + 1 - n, start + e + 1
            out.append((min(s, out.pop()[0]), e)) if out and s <= out[-1][1] else out.append((s, e))
    return out


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: the key) of every row, with ``__n`` words, ``__removed``
    words and the kept words' SHA-256 ``__sha``, and, for rows that lose words,
    their ``__kept`` text."""
    spark = docs.sparkSession
    columns = columns or [key]
    n = docs.count()
    sketch = written(sketches(docs, key, text), "substring-sketches", n, DOCS_PER_FILE)
    shared = _shared(sketch, n)
    release(spark)
    touched = _touched(sketch, shared, n)
    release(spark, sketch, shared)
    first = _finished(docs, touched, n, columns, key, text)
    release(spark, touched)
    rows = first.filter("__sha IS NULL")

    narrow = written(_segments(rows, False), "segments", n, DOCS_PER_FILE)
    hot = _checked(narrow.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")).filter(F.col("c") >= HOT).select("digest", "least"))
    rare = narrow.join(hot, "digest", "left").filter("least IS NULL OR id = least")
    wide = _checked(rare.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= WIDE).select("anchor", F.lit(True).alias("wide")))
    release(spark, narrow)

    known = _segments(rows, True).join(hot, "digest", "left").join(wide, "anchor", "left")
    copies = known.filter("id > least").select("row", "start", (F.col("start") + F.octet_length("tokens") / 8).cast("int").alias("end"))
    rest = known.filter("least IS NULL OR id = least")
    units = rest.filter("wide IS NULL").select("anchor", "id", "row", "start", "tokens").unionByName(_single_windows(rest.filter("wide")))
    spans = _matched(units).unionByName(copies)
    spans = written(spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("__spans")), "substring-spans", n, DOCS_PER_FILE)
    release(spark)

    def run(batches):
        for b in batches:
            removed, sha, kept = [], [], []
            for t, spans in zip(byte_texts(b.column("__t")), b.column("__spans").to_pylist(), strict=True):
                words = t.split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                left = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                removed.append(len(words) - len(left))
                sha.append(_sha(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), b.column("__n"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=[*columns, "__n", "__removed", "__sha", "__kept"])

    small_batches(spark)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    every = [F.col(f"`{c}`") for c in columns]
    changed = rows.join(spans.withColumnRenamed("row", "__row"), "__row", "left").select(*every, "__n", "__t", "__spans").mapInArrow(
        run, f"{schema}__n long, __removed long, __sha string, __kept string")
    same = first.filter("__sha IS NOT NULL").select(*every, "__n", "__removed", "__sha", F.col("__t").alias("__kept"))
    return same.unionByName(changed)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__n").alias("n_words"), F.col("__removed").alias("n_removed"), F.col("__sha").alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g
      FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
c AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (g) WHERE first < doc_id) GROUP BY rid),
k AS (SELECT doc_id, len(ws) AS n, coalesce(len(ps), 0) AS m, list_filter(ws, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)) AS left_ws FROM d LEFT JOIN c USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(array_to_string(left_ws, ' ')) AS kept_sha256 FROM k
"""

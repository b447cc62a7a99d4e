"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges.

A document's set holds the 64-bit hashes of its distinct shingles. One
permutation splits the hash range into ``BINS`` bins and keeps the smallest
hash of each; an empty bin copies the bin that a universal hash of (bin,
attempt) names first among the non-empty ones (optimal densification). The
bins form ``BANDS`` bands; documents that agree in a band share a bucket.

Documents with equal sets form one class, represented by its smallest id, so
copies never meet again. Within a bucket only star edges are made, from its
hub to the other members: at most one pair per member and band, however large
the bucket. The hub is the member with the most company over all bands - in a
family of edited copies the one nearest to their common origin. Candidate
pairs are confirmed on the full sets. Further rounds go over finer buckets, on
which two or three bands agree, wherever such a bucket still holds more than
one component: a random member is the hub and meets the members of the other
components, its closest relatives. The last pass tries every pair of different
components that still share a bucket: the members outside a bucket's largest
component meet all others, in blocks of at most ``BLOCK`` members, and a bound
on the sets' overlap that never drops a true pair (``overlap_allows``) leaves
few of them to confirm.

All groups are aggregated before they move, joins on ids and buckets are
shuffle joins that Spark may split, and no task ever holds a bucket.

Two documents with similarity 0.8 share none of the 32 bands with probability
(1 - 0.8**4)**32 < 1e-7.

Null and empty texts have an empty set and are linked with nothing. Rows with
the same id and text are one document and get the same result; an id with
several texts is compared by the greatest of them, and all its rows get that
text's component. A null id gets its class's component if there is another id in it, else null. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.bloom import may_hold
from pricewise.llm.common import WordHasher, byte_texts, mix, read, release, shingle_hashes, small_batches, written

SHINGLE = 4
PERCENT = 80
BINS, BANDS = 128, 32
#: Further rounds of star edges: the bands that must agree, as steps from one of them.
ROUNDS = (((0, 1), (0, 3, 7)), ((0, 5), (0, 2, 9)))
#: 64-bit words of a set's bitmap, and members of a block of the last pass.
WORDS, BLOCK = 16, 1000

_STARTS = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - (BINS - 1).bit_length()))


def _attempts(n: int = 4096) -> np.ndarray:
    """Row t: the bin that each bin asks at attempt t; fixed for all documents."""
    x = np.arange(n * BINS, dtype=np.uint64) + np.uint64(0x51ED270B)
    return (mix(x) % np.uint64(BINS)).astype(np.int64).reshape(n, BINS)


_ATTEMPTS = _attempts()


def signature(shingles: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of sorted, distinct, non-empty hashes."""
    at = np.searchsorted(shingles, _STARTS)
    after = np.append(at[1:], len(shingles))
    full = after > at
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    some = int(np.argmax(full))
    for ask in _ATTEMPTS:
        if not len(empty):
            return out
        source = ask[empty]
        got = full[source]
        out[empty[got]] = out[source[got]]
        empty = empty[~got]
    out[empty] = out[some]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number is part of it."""
    rows = sig.reshape(BANDS, -1)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
    return h.view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Which of ``64 * WORDS`` parts of the hash range hold a shingle."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[mix(shingles) >> np.uint64(64 - (64 * WORDS - 1).bit_length())] = 1
    return np.packbits(bits).view(np.int64)


def shingle_set(hasher: WordHasher, text: bytes, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(hasher.spans(text)[0], k))


def sketches(docs: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(id, n, class, bands) of every row: set size, a 128-bit digest of the
    whole set and the bucket keys (null for an empty set)."""
    import xxhash
    small_batches(docs.sparkSession)

    def run(batches):
        hasher = WordHasher(fold=True)
        for b in batches:
            n, same, keys = [], [], []
            for t in byte_texts(b.column("t")):
                s = shingle_set(hasher, t, k)
                n.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(bands(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["id", "n", "class", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, n long, class binary, bands array<long>")


def star_edges(members: DataFrame) -> DataFrame:
    """Distinct (u, n_u, hub, n_hub) from (bucket, u, n, weight, part): per bucket the
    heaviest member is the hub, and edges go to members of other parts whose
    size allows the similarity."""
    hub = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("u")).alias("m"), "n", "part")).alias("h"))
    hub = hub.select("bucket", (-F.col("h.m")).alias("hub"), F.col("h.n").alias("n_hub"), F.col("h.part").alias("hub_part"))
    pairs = members.join(hub, "bucket").filter("u <> hub AND part <> hub_part")
    pairs = pairs.filter(100 * F.least("n", "n_hub") >= PERCENT * F.greatest("n", "n_hub"))
    return pairs.select("u", F.col("n").alias("n_u"), "hub", "n_hub").distinct()


def shared_buckets(members: DataFrame) -> DataFrame:
    return members.select("u", "n", "weight", F.col("u").alias("part"), F.explode(F.map_values("own")).alias("bucket"))


def finer(members: DataFrame, found: DataFrame, combinations: tuple[tuple[int, ...], ...]) -> DataFrame:
    """Members of the buckets that several bands agree on (those a combination's
    steps after one another, in a circle), as far as they hold more than one
    component. In such a bucket the hub is a random member, so that each
    combination tries others."""
    part = members.join(found.withColumnRenamed("id", "u"), "u", "left").withColumn("part", F.coalesce("component", "u"))

    def keys(steps: tuple[int, ...]):
        bands = lambda b: [F.pmod(b + s, F.lit(BANDS)) for s in steps]
        return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.when(
            reduce(and_, [F.map_contains_key("own", x) for x in bands(b)]), F.xxhash64(b, *[F.lit(x) for x in steps], *[F.element_at("own", x) for x in bands(b)])))

    every = F.filter(F.flatten(F.array(*[keys(c) for c in combinations])), lambda x: x.isNotNull())
    rows = part.select("u", "n", "part", F.explode(every).alias("bucket"))
    mixed = rows.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("bucket")
    return rows.join(mixed, "bucket").withColumn("weight", F.xxhash64("u", "bucket"))


def overlap_allows(u: str, hub: str):
    """Whether two sets can reach the similarity by their sizes and bitmaps. A part
    of the hash range that only one of them uses holds a shingle that the other lacks."""
    n, m = F.col(f"{u}.n"), F.col(f"{hub}.n")
    common = F.ceil(F.lit(PERCENT) * (n + m) / F.lit(100.0 + PERCENT) - F.lit(1e-6))
    lacks = lambda a, b: reduce(add, [F.bit_count(F.col(f"{a}.b{i}").bitwiseAND(F.bitwise_not(f"{b}.b{i}"))) for i in range(WORDS)])
    return (F.least(n, m) >= common) & (lacks(u, hub) <= n - common) & (lacks(hub, u) <= m - common)


def remaining(members: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct (u, n_u, hub, n_hub) of all pairs of different components that share
    a bucket, as far as ``overlap_allows``."""
    part = members.join(found.withColumnRenamed("id", "u"), "u", "left").withColumn("part", F.coalesce("component", "u"))
    rows = part.select("u", "n", "part", F.explode(F.map_values("own")).alias("bucket"))
    sizes = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size")).groupBy("bucket").agg(F.max(F.struct("size", "part")).alias("most"), F.sum("size").alias("size"))
    sizes = sizes.filter("most.size < size").select("bucket", F.col("most.part").alias("largest"), F.ceil((F.col("size") - F.col("most.size")) / BLOCK).alias("less"), F.ceil(F.col("size") / BLOCK).alias("all"))
    rows = rows.join(sizes, "bucket").join(sets.select(F.col("id").alias("u"), *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(WORDS)]), "u")
    block = lambda n: F.pmod(F.xxhash64("u", "bucket"), F.col(n))
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = rows.filter("part <> largest").withColumn("i", block("less")).withColumn("j", others("all")).alias("a")
    b = rows.withColumn("i", others("less")).withColumn("j", block("all")).alias("b")
    once = F.expr("a.part <> b.part AND (b.part = b.largest OR a.u < b.u)")
    pairs = a.join(b, F.expr("a.bucket = b.bucket AND a.i = b.i AND a.j = b.j") & once & overlap_allows("a", "b"))
    return pairs.select(F.col("a.u").alias("u"), F.col("a.n").alias("n_u"), F.col("b.u").alias("hub"), F.col("b.n").alias("n_hub")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, hub) whose sets reach the similarity."""
    a = sets.select(F.col("id").alias("u"), F.col("s").alias("a"))
    b = sets.select(F.col("id").alias("hub"), F.col("s").alias("b"))
    common = F.size(F.array_intersect("a", "b")).cast("long")
    return (pairs.join(a, "u").join(b, "hub").withColumn("common", common)
            .filter(100 * F.col("common") >= PERCENT * (F.col("n_u") + F.col("n_hub") - F.col("common"))).select("u", "hub"))


def components(links: DataFrame, rows: int, u: str = "u", v: str = "hub") -> DataFrame:
    """(id, component): the smallest id reachable over the links, by alternating
    large-star and small-star steps until nothing changes. ``rows``: about how many
    links there are."""
    e = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    e = written(e, "links", rows, 200_000)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old, e = e, written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
                            .filter("u <> v").distinct(), "links", rows, 200_000)
        release(e.sparkSession, old, shuffles=False)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


def merged(found: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """``found`` after more links: components are joined, not documents."""
    own = lambda name: F.coalesce(F.col(f"{name}_c"), F.col(name)).alias(name)
    for name in ("u", "hub"):
        links = links.join(found.select(F.col("id").alias(name), F.col("component").alias(f"{name}_c")), name, "left")
    between = written(links.select(own("u"), own("hub")).filter("u <> hub"), "links", rows, 200_000)
    if not between.limit(1).count():
        return found
    joined = components(between, rows)
    labels = found.select("id", "component").join(joined.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left")
    labels = labels.select("id", F.coalesce("least", "component").alias("component"))
    return labels.unionByName(joined.join(found.select("id"), "id", "left_anti"))


def shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, s, bits): the sets of the documents named by ``ids`` and their bitmaps, each id once."""
    small_batches(docs.sparkSession)

    def run(batches):
        hasher = WordHasher(fold=True)
        for b in batches:
            some = [shingle_set(hasher, t, k) for t in byte_texts(b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.view(np.int64) for s in some], pa.list_(pa.int64())), pa.array([bitmap(s) for s in some], pa.list_(pa.int64()))],
                                             names=["id", "s", "bits"])

    kind = docs.schema[key].dataType.simpleString()
    # A filter of bounded size keeps most other texts out of the join's shuffle.
    some = may_hold(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), "id", ids, "__maybe").filter("__maybe").drop("__maybe")
    return some.join(ids, "id", "left_semi").groupBy("id").agg(F.max("t").alias("t")).mapInArrow(run, f"id {kind}, s array<long>, bits array<long>")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, log: Callable[[str], None] = lambda _: None) -> DataFrame:
    """(id, n, component) of every row of ``docs``; ids are integers.

    A table is deleted as soon as what was made from it has been written."""
    spark = docs.sparkSession
    n_rows = docs.count()
    first = written(sketches(docs, key, text, k), "sketches", n_rows)
    named = first.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.count("class").alias("full"), F.min("class").alias("a"), F.max("class").alias("b"))
    several = written(named.filter("a <> b OR full > 0 AND full < rows").select("id"), "repeated-ids", n_rows, 200_000)
    chosen, sketch, done = first, first.select("id", "n", "class"), [first]
    if several.limit(1).count():
        texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(several, "id", "left_semi").groupBy("id").agg(F.max("t").alias("t"))
        one = written(sketches(texts, "id", "t", k), "sketches", several.count())
        chosen = first.join(several, "id", "left_anti").unionByName(one)
        sketch = sketch.drop("class").join(one.select("id", "class"), "id").unionByName(sketch.join(several, "id", "left_anti"))
        done.append(one)
    sketch = written(sketch, "classes", n_rows, 200_000)
    classes = (chosen.filter("n > 0").groupBy("class").agg(F.min("id").alias("u"), F.first("n").alias("n"), F.first("bands").alias("bands")).filter("u IS NOT NULL"))
    reps = written(classes, "classes", n_rows, 50_000)
    release(spark, several, *done)
    one = reps.select("u", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = one.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(one.join(shared, "bucket").groupBy("u", "n")
                      .agg(F.sum(F.log2("size")).alias("weight"), F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("own")), "bucket-members", n_rows, 50_000)  # at most BANDS entries
    m = members.count()
    wide, reps = reps, written(reps.select("class", "u"), "classes", n_rows, 200_000)
    del one, shared, classes, chosen, named
    release(spark, wide)

    sets = written(shingle_sets(docs, members.select(F.col("u").alias("id")), key, text, k), "shingle-sets", m, 5000)
    tried = [written(star_edges(shared_buckets(members)), "pairs", m, 10_000)]
    release(spark)
    links = written(confirmed(tried[0], sets), "links", m, 10_000)
    found = components(links, links.count())
    found = written(found, "components", m, 200_000)
    release(spark, links)
    for combinations in ROUNDS:
        pairs = reduce(DataFrame.unionByName, tried)
        new = written(star_edges(finer(members, found, combinations)).join(pairs, ["u", "n_u", "hub", "n_hub"], "left_anti"), "pairs", m, 10_000)
        release(spark)
        more = written(confirmed(new, sets), "links", m, 10_000)
        log(f"{new.count()} pairs, {more.count()} links")
        tried.append(new)
        old, found = found, written(merged(found, more, more.count()), "components", m, 200_000)
        release(spark, old, more)
    release(spark, *tried)
    new = written(remaining(members, found, sets), "pairs")
    release(spark, members)
    more = written(confirmed(new, sets), "links")
    log(f"remaining: {new.count()} pairs, {more.count()} links")
    old, found = found, written(merged(found, more, more.count()), "components", m, 200_000)
    release(spark, sets, new, more, old)

    label = reps.select("class", "u").join(found.withColumnRenamed("id", "u"), "u", "left").select("class", F.coalesce("component", "u").alias("component"))
    return sketch.select("id", "n", "class").join(label, "class", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row of each component, that with the smallest id, with all columns.

    Repeated rows count once; rows without an id cannot be named and stay."""
    found = near_duplicates(docs, key, text, k)
    found = written(found, "near-duplicates", docs.count(), 100_000)
    named = found.filter("id IS NOT NULL")
    if named.groupBy("id").count().filter("count > 1").limit(1).count():
        docs = docs.dropDuplicates()
    gone = named.filter("id <> component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""

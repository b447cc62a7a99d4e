"""Language model: hashed maximum entropy with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class of a word
comes from its last two bytes; endings are dealt to ``CLASSES`` classes of
about equal mass by their counts in the training texts. The first factor is a
maximum-entropy model whose features are the hashed bigram context (previous
word), trigram context (previous two words) and skip context (the word before
the previous one); each names a bucket with one weight per class. The second
factor is its unigram part, (c + 1) / (N_class + V_class + 1), where the last 1
stands for all unseen words of the class.

Training: one pass counts words, a second writes the texts as combined histories
(buckets) with the counts of the classes after them. The observed (bucket, class)
counts come from that table; then each further pass over it sums the expected
counts and the log likelihood, and the driver moves every weight by (observed - expected) / the greater
of them, shared between the features (every history has exactly three). Weights
have a Gaussian prior (``PRIOR``). Every move carries on a part of the last one; one that
lowers the penalised likelihood is taken back and made smaller. Training ends when a
pass raises it by less than ``SETTLED`` a token. Tasks send fixed-size blocks
that are added up on the executors, so the driver sees one array of the
model's size, whatever the number of tasks.

Scoring: numpy over batches of texts. Counts of the ``TOP`` most frequent words
travel with the model; the others are looked up by a shuffle join on the
word's hash. They are rare by construction, so no key of that join is hot.

Tokens are the words of the lower-cased (A-Z) text, then one end. Null counts
as empty text and has the end only. Rows are scored one by one, so repeated
rows and ids do no harm; a row with a null id is never held out. Without
training texts all counts are zero. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.common import LOWER_BYTES, WordHasher, byte_texts, mix, read, release, small_batches, written

FOLDS, HELD_OUT = 7, 2
CLASSES, BUCKETS, FEATURES = 32, 1 << 14, 3
#: Words whose counts travel with the model (12 bytes each).
TOP = 200_000
#: Change of the natural log likelihood a token below which training has settled,
#: and the inverse variance of the weights' prior.
SETTLED, PRIOR = 0.001, 3.0
#: Pseudo-counts of a bucket, and the largest move of a weight in one update.
SMOOTHING, STEP = 30.0, 2.0
#: Length of an update, and the part of the last one that it carries on.
RATE, MOMENTUM = 2.5, 0.4
#: Tokens of one numpy batch, and rows of counts that a task holds.
BATCH, HELD_COUNTS = 40_000, 1_000_000
#: Tokens whose equal histories a task combines, and histories in a row of their table.
COMBINED, ROW = 4_000_000, 1 << 15
#: Histories whose class probabilities are computed at a time.
SLICE = 2048

_END = np.uint64(0x2545F4914F6CDD1D)
_BEGIN = np.uint64(0x9E6C63D0876A9A47)
_SALTS = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
_PACKED = ["bigram", "trigram", "skip", "classes_each", "classes", "counts"]


@dataclass
class Tokens:
    """The tokens of some texts, flat: hashes, ending codes, the two words before, and the first token of each text."""
    hashes: np.ndarray
    endings: np.ndarray
    before: np.ndarray
    before2: np.ndarray
    first: np.ndarray

    def buckets(self, j: int) -> np.ndarray:
        key = (self.before, self.before * np.uint64(0xD6E8FEB86659FD93) + self.before2, self.before2)[j]
        return (mix(key + _SALTS[j]) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.intp)


def tokens(hasher: WordHasher, texts: list[bytes]) -> Tokens:
    parts: list[list[np.ndarray]] = [[], [], [], []]
    sizes = []
    for t in texts:
        h, s, e = hasher.spans(t)
        b = np.frombuffer(t, np.uint8)
        ending = np.zeros(len(h) + 1, np.int32)
        if len(h):
            ending[:-1] = _LOWER[b[e - 1]]
            long = np.flatnonzero(e - s > 1)
            ending[long] += _LOWER[b[e[long] - 2]].astype(np.int32) << 8
        h = np.append(h, _END)
        before = np.concatenate([[_BEGIN], h[:-1]])
        for p, x in zip(parts, (h, ending, before, np.concatenate([[_BEGIN], before[:-1]])), strict=True):
            p.append(x)
        sizes.append(len(h))
    flat = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts]
    return Tokens(*flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _groups(texts: list[bytes]):
    """Slices of about ``BATCH`` tokens (six bytes each)."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 6
        if size >= 6 * BATCH or k == len(texts) - 1:
            yield slice(first, k + 1)
            first, size = k + 1, 0


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, e, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    h, at, back = np.unique(h, return_index=True, return_inverse=True)
    return h, e[at], np.bincount(back, c, len(h)).astype(np.int64)


def word_counts(training: DataFrame) -> DataFrame:
    """(hash, ending, c) of every distinct token; tasks combine before they send."""
    def run(batches):
        hasher, parts, held = WordHasher(fold=True), [], 0

        def rows(merged):
            h, e, c = merged
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e, pa.int32()), pa.array(c)], names=["hash", "ending", "c"])

        for b in batches:
            texts = byte_texts(b.column("t"))
            for g in _groups(texts):
                x = tokens(hasher, texts[g])
                parts.append(_merged([(x.hashes, x.endings, np.ones(len(x.hashes)))]))
                held += len(parts[-1][0])
            if held > HELD_COUNTS:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > HELD_COUNTS // 2:
                    yield rows(parts[0])
                    parts, held = [], 0
        if parts:
            yield rows(_merged(parts))

    found = training.select(F.col("text").alias("t")).mapInArrow(run, "hash long, ending int, c long")
    return written(found.groupBy("hash").agg(F.first("ending").alias("ending"), F.sum("c").alias("c")), "word-counts")


def _classes(endings: list[tuple[int, int, int]]) -> np.ndarray:
    """Class of each ending code: in descending order of tokens, each goes to the lightest class."""
    out, load = np.zeros(1 << 16, np.uint8), np.zeros(CLASSES, np.int64)
    for code, n, _ in sorted(endings, key=lambda x: (-x[1], x[0])):
        k = int(load.argmin())
        out[code] = k
        load[k] += n
    known = {code for code, _, _ in endings}
    for code in range(1 << 16):
        if code not in known:
            out[code] = code % CLASSES
    return out


class Lookup:
    """Counts of frequent words by hash: open addressing, four places for each key."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(hashes)) * 4))))
        self.keys, self.counts = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        left_h, left_c = hashes.astype(np.uint64), counts
        for j in range(4):
            at = self._place(left_h, j)
            free = self.counts[at] == 0
            _, one = np.unique(at, return_index=True)
            put = np.zeros(len(at), bool)
            put[one] = True
            put &= free
            self.keys[at[put]], self.counts[at[put]] = left_h[put], left_c[put]
            left_h, left_c = left_h[~put], left_c[~put]
        order = np.argsort(left_h)
        self.rest_keys, self.rest_counts = left_h[order], left_c[order]

    def _place(self, h: np.ndarray, j: int) -> np.ndarray:
        return (((h >> np.uint64(64 - self.bits)) + np.uint64(j * j * 7)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The counts; 0 for words that are not among the frequent ones."""
        out = np.zeros(len(h), np.int64)
        left = np.arange(len(h))
        for j in range(4):
            at = self._place(h[left], j)
            hit = self.keys[at] == h[left]
            out[left[hit]] = self.counts[at[hit]]
            left = left[~hit]
        if len(self.rest_keys) and len(left):
            at = np.minimum(np.searchsorted(self.rest_keys, h[left]), len(self.rest_keys) - 1)
            hit = self.rest_keys[at] == h[left]
            out[left[hit]] = self.rest_counts[at[hit]]
        return out


@dataclass
class MaxEnt:
    classes: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def probabilities(self, buckets: list[np.ndarray]) -> np.ndarray:
        """P(class | history) of each token, in slices that stay in the processor's
        cache. Only large weights need a shift of the exponents."""
        out, one = np.empty((len(buckets[0]), CLASSES), np.float32), np.ones(CLASSES, np.float32)
        more = np.empty((min(SLICE, len(out)), CLASSES), np.float32)
        for i in range(0, len(out), SLICE):
            z = out[i : i + SLICE]
            self.weights[0].take(buckets[0][i : i + SLICE], axis=0, out=z, mode="clip")
            for j in range(1, FEATURES):
                z += self.weights[j].take(buckets[j][i : i + SLICE], axis=0, out=more[: len(z)], mode="clip")
            z += self.prior
            if z.max() > 80:
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            z /= (z @ one)[:, None]
        return out


def histories(training: DataFrame, classes: np.ndarray) -> DataFrame:
    """The training tokens as a written table that every update reads: each row holds
    some distinct histories (one bucket a feature, ascending) and the classes seen
    after them with their counts. A task combines ``COMBINED`` tokens at a time;
    equal histories of other tasks are further rows, which changes no sum."""
    shared = training.sparkSession.sparkContext.broadcast(classes)
    bits = (BUCKETS - 1).bit_length()
    shifts = [5 + bits * (FEATURES - 1 - j) for j in range(FEATURES)]

    def run(batches):
        classes, hasher = shared.value, WordHasher(fold=True)
        held, size = [], 0

        def rows():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] >> 5 != keys[:-1] >> 5]))
            ends = np.append(first[1:], len(keys))
            for i in range(0, len(first), ROW):
                f, e = first[i : i + ROW], ends[i : i + ROW]
                part = keys[f[0] : e[-1]]
                packed = [*((keys[f] >> s & BUCKETS - 1).astype(np.uint16) for s in shifts), (e - f).astype(np.uint8), (part & 31).astype(np.uint8), n[f[0] : e[-1]].astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=_PACKED)

        for b in batches:
            texts = byte_texts(b.column("t"))
            for g in _groups(texts):
                x = tokens(hasher, texts[g])
                key = classes[x.endings].astype(np.int64)
                for j, s in enumerate(shifts):
                    key |= x.buckets(j) << s
                held.append(key)
                size += len(key)
                if size >= COMBINED:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()

    return written(training.select(F.col("text").alias("t")).mapInArrow(run, ", ".join(f"{c} binary" for c in _PACKED)), "lm-histories")


def _unpacked(batch: pa.RecordBatch):
    """For each row: buckets by feature, the history of each (history, class) entry, its class and its count."""
    for *buckets, classes_each, k, n in zip(*(batch.column(c).to_pylist() for c in _PACKED), strict=True):
        each = np.frombuffer(classes_each, np.uint8)
        yield [np.frombuffer(x, np.uint16).astype(np.intp) for x in buckets], np.repeat(np.arange(len(each)), each), np.frombuffer(k, np.uint8), np.frombuffer(n, np.uint32).astype(float)


def _summed(packed: DataFrame, model: MaxEnt, expected: bool) -> tuple[np.ndarray, float]:
    """Observed or expected (feature, bucket, class) counts over all training tokens,
    and with the expected ones the log likelihood of the classes. One softmax serves
    all tokens of a row that share a history."""
    spark = packed.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows_per_block = 512
    blocks = FEATURES * BUCKETS // rows_per_block

    def run(batches):
        model = shared.value
        out, expect = np.zeros((FEATURES, BUCKETS, CLASSES)), np.zeros((FEATURES, CLASSES, BUCKETS))
        seen, likelihood = False, 0.0
        for b in batches:
            for buckets, at, k, n in _unpacked(b):
                seen = True
                if not expected:
                    for j, bk in enumerate(buckets):
                        out[j] += np.bincount(bk[at] * CLASSES + k, n, BUCKETS * CLASSES).reshape(BUCKETS, CLASSES)
                    continue
                p = model.probabilities(buckets)
                likelihood += float(np.log(np.maximum(p[at, k], 1e-37)).astype(float) @ n)
                times = np.bincount(at, n, len(p)).astype(np.float32)
                by_class = np.empty((CLASSES, len(p)))
                for i in range(0, len(p), SLICE):
                    by_class[:, i : i + SLICE] = (p[i : i + SLICE] * times[i : i + SLICE, None]).T
                # The first feature's buckets ascend, so a row touches only a short range of them.
                for j, bk in enumerate(buckets):
                    low, end = (int(bk[0]), int(bk[-1]) + 1) if j == 0 else (0, BUCKETS)
                    shifted = bk - low
                    for c in range(CLASSES):
                        expect[j, c, low:end] += np.bincount(shifted, by_class[c], end - low)
        if seen:
            flat = (out + expect.transpose(0, 2, 1)).reshape(blocks, -1).astype(np.float32)
            some = [*(x.tobytes() for x in flat), np.array([likelihood]).tobytes()]  # the last block is the likelihood
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks + 1), pa.int32()), pa.array(some, pa.binary())], names=["block", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("block").to_pylist(), b.column("v").to_pylist(), strict=True):
                v = np.frombuffer(v, np.float32 if k < blocks else np.float64)
                total[k] = total[k] + v if k in total else v.astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "v"])

    small_batches(spark, 16)  # a row holds up to ROW histories
    sent = packed.mapInArrow(run, "block int, v binary")
    out, likelihood = np.zeros((blocks, rows_per_block * CLASSES)), 0.0
    for r in sent.repartition(min(blocks, 24), "block").mapInArrow(add, "block int, v binary").collect():  # the model's size
        v = np.frombuffer(r["v"])
        if r["block"] < blocks:
            out[r["block"]] = v
        else:
            likelihood = float(v[0])
    shared.destroy()
    release(spark)
    return out.reshape(FEATURES, BUCKETS, CLASSES), likelihood


def train(training: DataFrame, endings: list[tuple[int, int, int]], log: Callable[[str], None] = lambda _: None) -> MaxEnt:
    classes = _classes(endings)
    mass = np.zeros(CLASSES)
    for code, n, _ in endings:
        mass[classes[code]] += n
    share = (mass + 1) / (mass + 1).sum()
    model = MaxEnt(classes, np.log(share).astype(np.float32), np.zeros((FEATURES, BUCKETS, CLASSES), np.float32))
    if not mass.sum():
        return model
    spark = training.sparkSession
    packed = histories(training, classes)
    observed, _ = _summed(packed, model, False)
    smooth = SMOOTHING * share
    expected = observed.sum(axis=2, keepdims=True) * share  # of the model without weights
    move = np.clip(np.log((observed + smooth) / (expected + smooth)), -STEP, STEP) / (FEATURES / 1.5)
    best, kept, rate = None, model.weights, RATE
    while True:
        model.weights = (kept + move).astype(np.float32)
        expected, now = _summed(packed, model, True)
        now -= PRIOR / 2 * float(np.square(model.weights, dtype=float).sum())
        gain = float("inf") if best is None else (now - best) / mass.sum()
        log(f"log likelihood a token {now / mass.sum():.5f}, rate {rate}")
        if 0 <= gain < SETTLED or rate < 0.01:
            model.weights = model.weights if gain >= 0 else kept
            release(spark, packed)
            return model
        if gain >= 0:
            step = (observed - expected - PRIOR * model.weights) / (np.maximum(observed, expected) + smooth + PRIOR) / FEATURES
            move = rate * step + (0.0 if best is None else MOMENTUM * move)
            best, kept = now, model.weights
        else:
            rate, move = rate / 3, move / 3


def _least_frequent(counts: DataFrame) -> float:
    """The count from which on at most ``TOP`` words remain: one small histogram of
    the counts' logarithms instead of an order of all words."""
    step = F.floor(F.log2("c") * 16)
    left, least = TOP, float("inf")
    for k, n in sorted((tuple(r) for r in counts.groupBy(step).count().collect()), reverse=True):  # 16 rows for each power of two
        left -= n
        if left < 0:
            break
        least = 2 ** (k / 16) * (1 - 1e-9)
    return least


def scores(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    counts = word_counts(training)
    endings = [tuple(r) for r in counts.groupBy("ending").agg(F.sum("c"), F.count(F.lit(1))).collect()]  # at most 65,536
    n, v = sum(x[1] for x in endings), sum(x[2] for x in endings)
    model = train(training, endings)
    small_batches(spark)
    size = np.zeros(CLASSES)
    for code, a, b in endings:
        size[model.classes[code]] += a + b
    inside = np.log10(size + 1)
    top = counts.filter(F.col("c") >= _least_frequent(counts)).select("hash", "c").collect()
    top_h, top_c = np.array([r["hash"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)
    shared = spark.sparkContext.broadcast((model, inside, top_h, top_c))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        model, inside, top_h, top_c = shared.value
        lookup, hasher = Lookup(top_h.view(np.uint64), top_c), WordHasher(fold=True)
        log_count = np.log10(np.arange(1 << 16) + 1.0)
        for b in batches:
            texts = byte_texts(b.column("text"))
            n, known, count_sum, class_sum, rare, times = [], [], [], [], [], []
            for g in _groups(texts):
                x = tokens(hasher, texts[g])
                c = lookup(x.hashes)
                k = model.classes[x.endings]
                p = model.probabilities([x.buckets(j) for j in range(FEATURES)])[np.arange(len(k)), k]
                lc = np.where(c < len(log_count), log_count[np.minimum(c, len(log_count) - 1)], np.log10(c + 1.0))
                for out, values in ((known, c > 0), (count_sum, lc), (class_sum, np.log10(p.astype(float)) - inside[k])):
                    out.extend(np.add.reduceat(values.astype(float), x.first[:-1]).tolist())
                n.extend(np.diff(x.first).tolist())
                for s, e in zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True):
                    h, m = np.unique(x.hashes[s:e][c[s:e] == 0], return_counts=True)
                    rare.append(h.view(np.int64))
                    times.append(m.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.float64()), pa.array(count_sum, pa.float64()), pa.array(class_sum, pa.float64()),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], names=[key, "held_out", "n", "known", "count_sum", "class_sum", "rare", "times"])

    part = docs.mapInArrow(run, f"`{key}` {kind}, held_out boolean, n long, known double, count_sum double, class_sum double, rare array<long>, times array<int>")
    part = written(part.withColumn("rid", F.monotonically_increasing_id()), "lm-scores")
    words = part.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("rid", F.col("w.rare").alias("hash"), F.col("w.times").alias("m"))
    late = (words.join(counts.select("hash", "c"), "hash").groupBy("rid")
            .agg(F.sum("m").alias("late_known"), F.sum(F.col("m") * F.log10(F.col("c") + F.lit(1.0))).alias("late_sum")))
    every = part.drop("rare", "times").join(late, "rid", "left")
    logs = F.col("count_sum") + F.coalesce("late_sum", F.lit(0.0))
    return every.select(key, "held_out", F.col("n").alias("n_tokens"), (F.col("known").cast("long") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                        (logs - F.col("n") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (logs + F.col("class_sum")).alias("score"))


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return scores(read(spark, sf_dir, "documents"), held_out)

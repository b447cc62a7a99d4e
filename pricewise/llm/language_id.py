"""Language identification with spans of mixed-language text.

Words are runs of letters, lower-cased. The script of a word's first letter
narrows the candidates to the languages that were seen in that script; the word's
score for each of them is a log likelihood over its hashed character n-grams. A
Viterbi pass over a text's words, with a penalty for every change of language,
labels spans. The predicted language holds the most letters (ties: the smaller
name); its ``score`` is its share of the letters, times the probability of that
language against all others over the words of its spans.

Learning takes at most about ``SAMPLE`` labelled texts a language, chosen by a hash
of the id, in whole. The counts are summed on the executors; buckets shrink with
the number of languages, so that the model stays within ``MODEL_BYTES``.

A text that is null or has no letter is ``und`` with score 0, and so is every text
when there is nothing to learn from. Words in a script that no language was seen
in say nothing. Rows are judged one by one, so repeated rows and ids do no harm; a
row with a null id is neither held out nor learned from. An empty table gives an empty result. Of
other columns only those asked for are kept. Texts are read whole; long ones are
labelled word by word in time proportional to their length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.common import mix, read, small_batches, written

FOLDS, HELD_OUT = 5, 0
UNDETERMINED = "und"
#: Texts learned from for each language (whole texts, chosen by a hash of the id).
SAMPLE = 4000
#: Lengths of the character n-grams (a word has a mark at both ends), their weight in
#: a word's score (they overlap), and the pseudo-count of a bucket.
ORDERS, WEIGHT, SMOOTHING = (2, 3, 4), 0.4, 0.5
MODEL_BYTES, MOST_BUCKETS = 64 << 20, 1 << 18
#: Natural-log penalty of a change of language between two words.
SWITCH = 12.0
#: A language is a candidate in a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
#: Words kept with their scores in a task; texts that the vector pass labels together at least.
CACHE_WORDS, TOGETHER = 200_000, 8

# Scripts and the code point ranges of their letters.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
OTHER = len(SCRIPTS)
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")

_RANGES = sorted((low, high, k) for k, ranges in enumerate(SCRIPTS.values()) for low, high in ranges)
_LOW, _HIGH, _KIND = (np.array(x) for x in zip(*_RANGES, strict=True))


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point, ``OTHER`` outside all ranges."""
    k = np.maximum(np.searchsorted(_LOW, points, "right") - 1, 0)
    return np.where((points >= _LOW[k]) & (points <= _HIGH[k]), _KIND[k], OTHER)


# -------------------------------------------------------------------- features --

@dataclass
class Features:
    """Hashed n-grams of some words, flat, with the first one of each word, and scripts and letters by word."""
    buckets: np.ndarray
    first: np.ndarray
    scripts: np.ndarray
    letters: np.ndarray


def features(words: list[str], buckets: int) -> Features:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer(("^" + "^^".join(words) + "^").encode("utf-32-le"), "<u4").astype(np.int64)
    starts = np.cumsum(sizes + 2) - sizes - 2      # of each word's first mark
    word = np.repeat(np.arange(len(words)), sizes + 2)
    left = np.repeat(sizes + 2, sizes + 2) - (np.arange(len(points)) - starts[word])
    found, owner = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h[: len(points) - n + 1] = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :].astype(np.uint64)
        if n in ORDERS:
            whole = left >= n
            found.append((mix(h[whole] + np.uint64(n)) >> np.uint64(33)).astype(np.int64) % buckets)
            owner.append(word[whole])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(words)))
    return Features(np.concatenate(found)[order], first, scripts_of(points[starts + 1]), sizes)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray          # (buckets, languages) float32
    candidates: np.ndarray    # (scripts, languages)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score of every language, letters) of each word."""
        f = features(words, len(self.logs))
        s = WEIGHT * np.add.reduceat(self.logs[f.buckets], f.first, axis=0)
        s -= s.max(1, keepdims=True)
        open_ = self.candidates[f.scripts]
        s = np.where(open_, s, np.float32(-1e4))
        s[~open_.any(1)] = 0
        return s.astype(np.float32), f.letters


# --------------------------------------------------------------------- Viterbi --

def _label_one(s: list[list[float]], state: list[float], penalty: float) -> tuple[list[float], list[tuple[int, int]]]:
    """The rest of one text word by word: the last state, and per word a bit set of the languages that were switched to, and from which."""
    back = []
    n = range(len(state))
    for row in s:
        top = max(state)
        best = state.index(top)
        jump = top - penalty
        bits = 0
        for j in n:
            if jump > state[j]:
                state[j] = jump
                bits |= 1 << j
            state[j] += row[j] - top
        back.append((bits, best))
    return state, back


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The language of every word: the path of the greatest sum of scores less
    ``penalty`` for each change. ``scores`` (words, languages) of texts one after the
    other, ``sizes`` words of each. Texts of similar length advance together, the
    last few (longest) one by one."""
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return labels
    start, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    jumped, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int64)
    state = scores[start].astype(np.float64)
    # Texts that go on alone from step ``alone`` on.
    alone = max(1, int(size[TOGETHER - 1])) if len(size) >= TOGETHER else 1
    for t in range(1, min(alone, int(size[0]))):
        k = int(np.searchsorted(-size, -t))       # texts with more than t words
        v, row = state[:k], start[:k] + t
        b = v.argmax(1)
        top = v[np.arange(k), b][:, None]
        j = top - penalty > v
        jumped[row], best[row] = j, b
        state[:k] = np.where(j, top - penalty, v) - top + scores[row]
    for d in np.flatnonzero(size > alone).tolist():
        at, to = int(start[d]), int(start[d] + size[d])
        last, back = _label_one(scores[at + alone : to].tolist(), state[d].tolist(), penalty)
        lang = last.index(max(last))
        for w in range(to - 1, at + alone - 1, -1):
            labels[w] = lang
            bits, b = back[w - at - alone]
            if bits >> lang & 1:
                lang = b
        labels[at + alone - 1] = lang
    lang = state.argmax(1)
    long = size > alone
    lang[long] = labels[start[long] + alone - 1]
    for t in range(min(alone, int(size[0])) - 1, -1, -1):
        k = int(np.searchsorted(-size, -t))
        row, now = start[:k] + t, lang[:k]
        labels[row] = now
        if t:
            lang[:k] = np.where(jumped[row, now], best[row], now)
    return labels


# ---------------------------------------------------------------------- judging --

class Judge:
    """Labels texts; each distinct word is scored once a task."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def words(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word in the tables, words of each text)."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        new = list({w for ws in found for w in ws} - self.index.keys())
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            s, n = self.model.scores(new)
            self.scores, self.letters = np.concatenate([self.scores, s]), np.concatenate([self.letters, n])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        numbers = np.fromiter((self.index[w] for ws in found for w in ws), np.int64, int(sizes.sum()))
        return numbers, sizes

    def judge(self, found: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score) of each text, and the language of every word."""
        langs = self.model.languages
        if not langs:
            return [UNDETERMINED] * len(found), np.zeros(len(found)), np.zeros(0, np.int64)
        numbers, sizes = self.words(found)
        s, letters = self.scores[numbers], self.letters[numbers]
        labels = viterbi(s, sizes)
        text, n = np.repeat(np.arange(len(sizes)), sizes), len(langs)
        held = np.bincount(text * n + labels, letters, len(sizes) * n).reshape(-1, n)
        winner = held.argmax(1)
        mine = labels == winner[text]
        evidence = np.stack([np.bincount(text[mine], s[mine, j], len(sizes)) for j in range(n)], 1)
        against = np.exp(np.minimum(evidence - evidence[np.arange(len(sizes)), winner][:, None], 500))
        score = held.max(1) / np.maximum(held.sum(1), 1) / against.sum(1)
        return [langs[w] if c else UNDETERMINED for w, c in zip(winner.tolist(), sizes.tolist(), strict=True)], np.where(sizes > 0, score, 0.0), labels


def found_words(texts: list[str | None]) -> list[list[str]]:
    return [WORDS.findall(t.lower()) if t else [] for t in texts]


# --------------------------------------------------------------------- learning --

def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(lang, text) to learn from: rows that are not held out, with text and language,
    about ``sample`` a language by a hash of the id."""
    rows = docs.filter((_remainder(key) != HELD_OUT) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = rows.groupBy(F.col(lang).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["__l"]: r["__n"] for r in share.collect()}  # one row a language
    if all(n <= sample for n in counts.values()):
        return rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    part = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, sample / n))])
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < 1_000_003 * F.element_at(part, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def _remainder(key: str):
    return F.crc32(F.col(key).cast("string")) % FOLDS


def held_out(key: str = "doc_id"):
    return F.coalesce(_remainder(key) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Bucket and script counts by language, summed over the sample."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = written(training_rows(docs, key, text, lang, sample), "language-sample")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    buckets = MOST_BUCKETS
    while buckets > 256 and buckets * 4 * len(languages) > MODEL_BYTES:
        buckets //= 2
    number = {name: k for k, name in enumerate(languages)}
    slots = buckets + OTHER + 1

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            by: dict[int, dict[str, int]] = {}
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = by.setdefault(number[name], {})
                for w in found_words([t])[0]:
                    own[w] = own.get(w, 0) + 1
            for k, own in by.items():
                if not own:
                    continue
                f, times = features(list(own), buckets), np.fromiter(own.values(), np.int64, len(own))
                each = np.repeat(times, np.diff(np.append(f.first, len(f.buckets))))
                v = held.setdefault(k, np.zeros(slots))
                v[:buckets] += np.bincount(f.buckets, each, buckets)
                v[buckets:] += np.bincount(f.scripts, f.letters * times, OTHER + 1)
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(v.astype(np.float32).tobytes(), 1)], pa.binary())], names=["k", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(v), np.float32).astype(np.float64) for v in table["v"].to_pylist())
        return pa.table({"k": table["k"][:1], "v": pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary())})

    # The sample is bounded, and so is the number of tasks over it.
    parts = rows.coalesce(16).mapInArrow(count, "k int, v binary").groupBy("k").applyInArrow(add, "k int, v binary")
    counts = np.zeros((len(languages), slots))
    for k, v in parts.collect():  # MODEL_BYTES at most
        counts[k] = np.frombuffer(zlib.decompress(v), np.float32)
    grams, letters = counts[:, :buckets], counts[:, buckets:]
    used = np.maximum((grams.sum(0) > 0).sum(), 1)
    logs = np.log(grams + SMOOTHING) - np.log(grams.sum(1, keepdims=True) + SMOOTHING * used)
    candidates = (letters > SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)).T
    return Model(languages, np.ascontiguousarray(logs.T.astype(np.float32)), candidates)


def identified(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", with_spans: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``__lang``, ``__score`` and, if asked for,
    ``__spans``: (start, end, lang) of each run of words of one language, in code points."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    shared = spark.sparkContext.broadcast(model)  # MODEL_BYTES at most
    keep = docs.columns if keep is None else keep
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def spans(texts, labels):
        at = 0
        for t in texts:
            out = []
            for m in WORDS.finditer(t or ""):
                lang = shared.value.languages[labels[at]] if len(labels) else UNDETERMINED
                if out and out[-1]["lang"] == lang:
                    out[-1]["end"] = m.end()
                else:
                    out.append({"start": m.start(), "end": m.end(), "lang": lang})
                at += 1
            yield out

    def run(batches):
        judge = Judge(shared.value)
        for b in batches:
            texts = b.column(text).to_pylist()
            # With spans, words are found in the text itself, so that the places are its own.
            found = [[w.lower() for w in WORDS.findall(t or "")] for t in texts] if with_spans else found_words(texts)
            lang, score, labels = judge.judge(found)
            more = [pa.array(list(spans(texts, labels)), kind)] if with_spans else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *more],
                                             names=[*keep, "__lang", "__score", *(["__spans"] if with_spans else [])])

    through = list(dict.fromkeys([*keep, text]))
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "__lang string, __score double"
    schema += ", __spans array<struct<start: int, end: int, lang: string>>" if with_spans else ""
    return docs.select(*[F.col(f"`{c}`") for c in through]).mapInArrow(run, schema)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), learn(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))

"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A text is encoded by a byte-level BPE (A, on a space and the text) and by a
SentencePiece BPE (B, which adds the space itself). Byte offsets where tokens of
both end cut them into groups; tokens whose byte ranges overlap are linked. An id
pair counts in as many documents as hold it linked.

Counts over the corpus:

1. Every task encodes and aligns its documents, writes their token ids and adds up
   its own distinct pairs.
2. The distinct pairs of all tasks get a minimal perfect hash: pairs are dealt by
   hash into shards, each shard builds its levels of a bit table (a pair lies on
   the first level where no other falls on its place), and the rank of a pair's
   bit is its index. The keys are held in index order and verified at every look-up.
3. The tasks' counts become dense vectors indexed by that hash and are summed in
   a tree, blockwise.
4. A second pass aligns every document again, from its written token ids, and looks
   up the counts.

A hash covers at most ``RANGE`` pairs, so that what is broadcast is bounded (about
25 bytes a pair); more pairs are split by hash into several ranges, which the
second pass takes one after the other (ids and sums so far are written between).

Both tokenizers treat what a single space between two other characters divides
independently (checked on the tokenizers' own tables, else texts are encoded
whole), so that a task encodes each distinct stretch once; the cache of stretches
is bounded by ``CACHE_CHARS``. Bytes are verified for every stretch.

Null and empty texts, and texts whose joined token bytes of A or B are not the
space and the text, have no tokens: zeros, and an empty digest. Rows are aligned
one by one: a row that repeats counts as another document, whatever its id. An
empty table gives an empty result. Of other columns only those asked for are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm.common import mix, read, release, small_batches, written

#: The public files of the two tokenizers.
FOLDER = "/opt/tokenizers"
MODEL_A, MODEL_B = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Characters of cached stretches in a task, and of one call to a tokenizer.
CACHE_CHARS, CALL_CHARS = 3_000_000, 200_000
#: Pairs of one hash, of one of its shards, and of one block of a dense vector.
RANGE, SHARD, BLOCK = 4_000_000, 1 << 17, 1 << 15
#: Pairs a task holds before it sends their counts.
HELD = 2_000_000
#: Vectors that one task of the tree adds up.
FAN = 16

MARK = "▁"
#: A space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")


# ---------------------------------------------------------------- tokenizers --

def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the other bytes follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their entries, and whether texts may be cut at single spaces."""

    def __init__(self, model_a: bytes, model_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(model_a.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        chars, spec = byte_characters(), json.loads(model_a)
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
        vocab = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [added[i] if i in added else bytes(chars[c] for c in vocab[i]) if i in vocab else b"" for i in range(max(vocab) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        before = spec.get("pre_tokenizer") or {}
        plain = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", False)
                 and not spec.get("normalizer"))
        # B divides at a marker if none follows another character inside a piece, and changes no text.
        inside = any(re.search(f"[^{MARK}]{MARK}", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        probe = " Ä  ﬁ\t①é "
        self.separable = plain and not inside and self.b.decode(self.b.encode(probe)) == probe

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [np.asarray(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return a, [np.asarray(i, np.int64) for i in self.b.encode(texts, num_threads=1)]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal numbers below ``n`` as left-justified characters with room for a separator, and their lengths."""
    width = len(str(max(1, n - 1)))
    text = np.array([str(i).encode() for i in range(n)], f"S{width + 1}")
    return text.view(np.uint8).reshape(n, width + 1), np.char.str_len(text).astype(np.int64)


class Alignment:
    """Tokens of both kinds over the same bytes: groups, links and their pairs."""

    def __init__(self, a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray):
        self.a, self.b = a, b
        self.ends_a, self.ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        # Each end of a token closes one link; ends of both kinds close a group.
        ends = np.sort(np.concatenate([self.ends_a, self.ends_b]), kind="stable")
        twice = np.zeros(len(ends), bool)
        twice[1:] = ends[1:] == ends[:-1]
        self.both, self.every = ends[twice], ends[~twice]
        linked_a, linked_b = a[np.searchsorted(self.ends_a, self.every)], b[np.searchsorted(self.ends_b, self.every)]
        self.pairs = (linked_a.astype(np.uint64) << np.uint64(32)) | linked_b.astype(np.uint64)

    def cut(self, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """How many A tokens, B tokens, groups and links lie before each byte offset (ends of groups)."""
        return tuple(np.searchsorted(e, ends, "right") for e in (self.ends_a, self.ends_b, self.both, self.every))

    def written(self, digits) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` and the offset after each group's semicolon."""
        a, b = self.a, self.b
        group_a, group_b = np.searchsorted(self.both, self.ends_a), np.searchsorted(self.both, self.ends_b)
        done_a, done_b = np.searchsorted(self.ends_a, self.both, "right"), np.searchsorted(self.ends_b, self.both, "right")
        # The A tokens of a group come before its B tokens.
        place_a = np.arange(len(a)) + np.concatenate([[0], done_b])[group_a]
        place_b = np.arange(len(b)) + done_a[group_b]
        width = max(d.shape[1] for d, _ in digits)
        chars, sizes = np.zeros((len(a) + len(b), width), np.uint8), np.zeros(len(a) + len(b), np.int64)
        for place, ids, (text, lengths), last, end in ((place_a, a, digits[0], done_a - 1, ord("|")), (place_b, b, digits[1], done_b - 1, ord(";"))):
            chars[place, : text.shape[1]] = text[ids]
            sizes[place] = lengths[ids]
            mark = np.full(len(ids), ord(","), np.uint8)
            mark[last] = end
            chars[place, lengths[ids]] = mark
        return chars[np.arange(width) <= sizes[:, None]].tobytes(), np.cumsum(sizes + 1)[place_b[done_b - 1]]


class Flat:
    """Arrays one after the other, taken out by their numbers."""

    def __init__(self, kind):
        self.values, self.offsets = np.zeros(0, kind), np.zeros(1, np.int64)

    def extend(self, values: list[np.ndarray], sizes: np.ndarray) -> None:
        self.values = np.concatenate([self.values, *(v.astype(self.values.dtype) for v in values)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])

    def take(self, k: np.ndarray) -> np.ndarray:
        first, size = self.offsets[k], self.offsets[k + 1] - self.offsets[k]
        return self.values[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Encoder:
    """Token ids of texts, and the pairs that they link; each stretch is worked out once and kept in flat arrays."""

    def __init__(self, tokenizers: Pair):
        self.t = tokenizers
        self.len_a = np.array([len(x) for x in tokenizers.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in tokenizers.bytes_b], np.int64)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ok = np.zeros(0, bool)
        self.a, self.b, self.pairs = Flat(np.uint32), Flat(np.uint32), Flat(np.uint64)

    def learn(self, stretches: list[str]) -> None:
        """Encode and align new stretches. Those that a single space may join are encoded as one text."""
        together, alone, bad, size = [[]], [], [], 0
        for s in stretches:
            if not self.t.separable:
                alone.append(s)
            elif MARK in s:
                bad.append(s)  # B takes its marker for a space
            elif s[0].isspace() or s[-1].isspace():
                alone.append(s)
            else:
                together[-1].append(s)
                size += len(s) + 1
                if size > CALL_CHARS:
                    together.append([])
                    size = 0
        found: list[tuple[list[str], list]] = []
        for group in filter(None, together):
            parts = self._encoded(group)
            if parts:
                found.append((group, parts))
            else:
                alone += group
        for s in alone:
            parts = self._encoded([s])
            if parts:
                found.append(([s], parts))
            else:
                bad.append(s)
        names = [s for group, _ in found for s in group] + bad
        for j, flat in enumerate((self.a, self.b, self.pairs)):
            flat.extend([parts[j][0] for _, parts in found], np.concatenate([*(parts[j][1] for _, parts in found), np.zeros(len(bad), np.int64)]))
        self.index.update(zip(names, range(len(self.index), len(self.index) + len(names)), strict=True))
        self.chars += sum(map(len, names))
        self.ok = np.concatenate([self.ok, np.arange(len(names)) < len(names) - len(bad)])

    def _encoded(self, stretches: list[str]) -> list | None:
        """(A ids, B ids, linked pairs) of stretches joined by single spaces, each with its number by stretch; None if the bytes differ or a stretch does not end a group."""
        joined = " ".join(stretches)
        (a,), (b,) = self.t.encode([joined])
        whole = b" " + joined.encode()
        if b"".join(map(self.t.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(self.t.bytes_b.__getitem__, b.tolist())) != whole:
            return None
        al = Alignment(a, b, self.len_a, self.len_b)
        cuts = np.cumsum([1 + len(s.encode()) for s in stretches])
        if not (al.both[np.minimum(np.searchsorted(al.both, cuts), len(al.both) - 1)] == cuts).all():
            return None
        to_a, to_b, _, to_link = (np.diff(t, prepend=0) for t in al.cut(cuts))
        return [(a, to_a), (b, to_b), (al.pairs, to_link)]

    def stretches(self, texts: list[str]) -> list[np.ndarray | None]:
        """The numbers of each text's stretches (new ones are learned first), None for a text without tokens."""
        cut = [CUT.split(t) if self.t.separable else [t] for t in texts]
        if self.chars > CACHE_CHARS:
            self.forget()
        self.learn(list({s for c in cut for s in c} - self.index.keys()))
        found = [np.fromiter(map(self.index.__getitem__, c), np.int64, len(c)) for c in cut]
        return [k if self.ok[k].all() else None for k in found]


_PAIRS: dict[bytes, Pair] = {}


def _pair(shared) -> Pair:
    """One pair of tokenizers per worker and model files."""
    k = hashlib.sha256(shared.value[0] + shared.value[1]).digest()
    if k not in _PAIRS:
        _PAIRS[k] = Pair(*shared.value)
    return _PAIRS[k]


# ------------------------------------------------------ minimal perfect hash --

def _places(keys: np.ndarray, level: int, sizes: np.ndarray) -> np.ndarray:
    """The place of each key on a level of its shard (``sizes``: of that shard's level)."""
    salted = mix(keys + mix(np.array([level + 1], np.uint64)))
    return ((salted >> np.uint64(32)) * sizes.astype(np.uint64)) >> np.uint64(32)


def build_levels(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bits, keys in order of their bits) of each level over distinct keys: a key
    stays on the first level where it is alone on its place."""
    levels = []
    while len(keys):
        size = np.full(len(keys), 2 * len(keys) + 8)
        place = _places(keys, len(levels), size).astype(np.int64)
        alone = np.bincount(place, minlength=size[0]) == 1
        stay = alone[place]
        bits = np.zeros(size[0], bool)
        bits[place[stay]] = True
        levels.append((bits, keys[stay][np.argsort(place[stay])]))
        keys = keys[~stay]
    return levels


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x14057B7EF767814F)) % np.uint64(ranges)).astype(np.int64)


@dataclass
class PerfectHash:
    """Distinct keys to 0 ... n - 1 in the order levels, shards, places."""
    shards: int
    sizes: list[np.ndarray]     # per level: places of each shard
    starts: list[np.ndarray]    # per level: where each shard's places start
    bits: list[np.ndarray]      # per level: packed bits of all shards
    before: list[np.ndarray]    # per level: set bits before each byte, over all levels
    keys: np.ndarray

    @classmethod
    def of(cls, shards: int, parts: list[tuple[int, int, bytes, int, bytes]]) -> PerfectHash:
        """From rows (shard, level, packed bits, places, keys)."""
        found = {(s, level): (bits, n, keys) for s, level, bits, n, keys in parts}
        out, total = cls(shards, [], [], [], [], np.zeros(0, np.uint64)), 0
        keys = []
        for level in range(1 + max((level for _, level in found), default=-1)):
            sizes = np.array([found.get((s, level), (b"", 0, b""))[1] for s in range(shards)], np.int64)
            packed = [np.frombuffer(found.get((s, level), (b"", 0, b""))[0], np.uint8) for s in range(shards)]
            starts = 8 * np.concatenate([[0], np.cumsum([len(p) for p in packed])[:-1]])
            bits = np.concatenate(packed)
            ones = np.bitwise_count(bits).astype(np.int64)
            out.sizes.append(sizes)
            out.starts.append(starts)
            out.bits.append(bits)
            out.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
            keys += [np.frombuffer(found[s, level][2], np.uint64) for s in range(shards) if (s, level) in found]
        out.keys = np.concatenate([out.keys, *keys])
        return out

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether the key there is this one) of each key."""
        index = np.zeros(len(keys), np.int64)
        left, shard = np.arange(len(keys)), shard_of(keys, self.shards)
        for level, (sizes, starts, bits, before) in enumerate(zip(self.sizes, self.starts, self.bits, self.before, strict=True)):
            if not len(left) or not len(bits):
                break
            size = sizes[shard[left]]
            at = starts[shard[left]] + np.minimum(_places(keys[left], level, size).astype(np.int64), np.maximum(size - 1, 0))
            at = np.minimum(at, 8 * len(bits) - 1)
            byte, bit = at >> 3, (7 - (at & 7)).astype(np.uint8)
            here = ((bits[byte] >> bit) & 1).astype(bool) & (size > 0)
            above = bits[byte[here]] >> (bit[here] + 1).astype(np.uint16) if here.any() else np.zeros(0, np.uint8)
            index[left[here]] = before[byte[here]] + np.bitwise_count(above.astype(np.uint8))
            left = left[~here]
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[index] == keys
        return index, known


class Lookup:
    """Per pair: whether it has its A id's highest count, its count, and whether it is in the table."""

    def __init__(self, hash_: PerfectHash, counts: np.ndarray, best: np.ndarray):
        self.hash, self.counts, self.best = hash_, counts, best

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index, known = self.hash(pairs)
        count = np.where(known, self.counts[index] if len(self.counts) else 0, 0)
        return known & (count == self.best[(pairs >> np.uint64(32)).astype(np.int64)]), count, known


# -------------------------------------------------------------- Spark passes --

def _encode(shared, text: str, out: list[str], fields: list[pa.Field]):
    """The first pass: per document its token ids (null without tokens), and, in rows
    of their own, the distinct pairs of the task with their numbers of documents."""
    def counted(held, schema):
        pairs, n = _merged(held)
        for at in range(0, len(pairs), 100_000):
            p, c = pairs[at : at + 100_000], n[at : at + 100_000]
            empty = [pa.nulls(len(p), f.type) for f in schema][:-2]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(p.view(np.int64)), pa.array(c)], schema=schema)

    def run(batches):
        schema = pa.schema([*fields, ("__a", pa.binary()), ("__b", pa.binary()), ("__pair", pa.int64()), ("__n", pa.int64())])
        encoder, held, size = Encoder(_pair(shared)), [], 0
        for b in batches:
            texts = b.column(text).to_pylist()
            ids: list[list] = [[None] * len(texts), [None] * len(texts)]
            some = [i for i, t in enumerate(texts) if t]
            for i, k in zip(some, encoder.stretches([texts[i] for i in some]), strict=True):
                if k is not None:
                    ids[0][i], ids[1][i] = (f.take(k).tobytes() for f in (encoder.a, encoder.b))
                    p = distinct(encoder.pairs.take(k))
                    held.append((p, np.ones(len(p), np.int64)))
                    size += len(p)
            if size > HELD:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from counted(held, schema)
                    held, size = [], 0
            columns = [b.column(c).cast(f.type) for c, f in zip(out, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[0], pa.binary()), pa.array(ids[1], pa.binary()), pa.nulls(len(texts), pa.int64()), pa.nulls(len(texts), pa.int64())], schema=schema)
        if held:
            yield from counted(held, schema)
    return run


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held])
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, bool))
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


def _build(shards: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table["pair"].to_numpy().view(np.uint64)
        shard = table["shard"][0].as_py()
        rows = [(shard, level, np.packbits(bits).tobytes(), len(bits), keys.tobytes()) for level, (bits, keys) in enumerate(build_levels(keys))]
        return pa.table(dict(zip(("shard", "level", "bits", "places", "keys"), zip(*rows, strict=True), strict=True)),
                        pa.schema([("shard", pa.int32()), ("level", pa.int32()), ("bits", pa.binary()), ("places", pa.int64()), ("keys", pa.binary())]))
    return run


def _dense(shared):
    """Counts of a task as dense vectors, in blocks that it touched."""
    def run(batches):
        hash_ = shared.value
        vector = np.zeros(len(hash_.keys), np.int64)
        for b in batches:
            index, known = hash_(b.column("pair").to_numpy().view(np.uint64))
            np.add.at(vector, index[known], b.column("n").to_numpy()[known])
        for k in range(0, len(vector), BLOCK):
            part = vector[k : k + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["block", "vector"])
    return run


def _packed(vector: np.ndarray) -> bytes:
    """A count vector in its narrowest type, compressed."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if vector.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(vector.astype(kind).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[data[0]]
    return np.frombuffer(zlib.decompress(data[1:]), kind).astype(np.int64)


def _add(table: pa.Table) -> pa.Table:
    total = None
    for v in table["vector"].to_pylist():
        total = _unpacked(v) if total is None else total + _unpacked(v)
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "vector": pa.array([_packed(total)], pa.binary())})


def tree_sum(vectors: DataFrame, parts: int) -> DataFrame:
    """(block, vector) summed by block; no task adds more than about ``FAN`` vectors of a block."""
    while parts > 1:
        parts = -(-parts // FAN)
        salt = F.pmod(F.xxhash64("vector", F.monotonically_increasing_id()), F.lit(parts)) if parts > 1 else F.lit(0)
        vectors = vectors.withColumn("salt", salt).groupBy("block", "salt").applyInArrow(_add, "block int, vector binary")
    return vectors


def pair_counts(partial: DataFrame, vocabulary: int, range_pairs: int) -> tuple[list[tuple], np.ndarray]:
    """From the tasks' (pair, n): per range its shards, a table of its hash (shard, level,
    bits, places, keys) and one of its counts (block, vector); and the highest count of each A id."""
    spark = partial.sparkSession
    keys = written(partial.select("pair").distinct(), "pairs")
    n = keys.count()
    ranges, best, out = max(1, -(-n // range_pairs)), np.zeros(vocabulary, np.int64), []
    for r in range(ranges):
        def mine(df, r=r):
            if ranges == 1:
                return df
            return df.mapInArrow(lambda bs: (b.filter(pa.array(range_of(b.column("pair").to_numpy().view(np.uint64), ranges) == r)) for b in bs), df.schema)
        shards = max(1, -(-n // ranges // SHARD))
        sharded = mine(keys).mapInArrow(lambda bs, s=shards: (pa.RecordBatch.from_arrays([pa.array(shard_of(b.column("pair").to_numpy().view(np.uint64), s).astype(np.int32)), b.column("pair")], names=["shard", "pair"]) for b in bs), "shard int, pair long")
        levels = written(sharded.groupBy("shard").applyInArrow(_build(shards), "shard int, level int, bits binary, places long, keys binary"), "perfect-hash")
        hash_ = PerfectHash.of(shards, [tuple(x) for x in levels.collect()])  # at most range_pairs keys
        dense = mine(partial).mapInArrow(_dense(spark.sparkContext.broadcast(hash_)), "block int, vector binary")
        counts = written(tree_sum(dense, len(partial.inputFiles())), "pair-vectors")
        vector = _vector(counts, len(hash_.keys))
        np.maximum.at(best, (hash_.keys >> np.uint64(32)).astype(np.int64), vector)
        out.append((shards, levels, counts))
    release(spark, keys)
    return out, best


def _vector(counts: DataFrame, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for block, data in counts.collect():  # 8 bytes a pair of one range
        part = _unpacked(data)
        out[block * BLOCK : block * BLOCK + len(part)] = part
    return out


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _look_up(shared, lookup, out: list[str], with_groups: bool, last: bool, every: bool):
    """The second pass; with ``every`` all pairs must be in the table."""
    def run(batches):
        t = _pair(shared)
        lengths = [np.array([len(x) for x in table], np.int64) for table in (t.bytes_a, t.bytes_b)]
        digits = [_digits(len(x)) for x in lengths]
        for b in batches:
            rows = b.num_rows
            numbers, digests, groups = np.zeros((rows, 6), np.int64), [""] * rows, [""] * rows
            some = np.flatnonzero(b.column("__a").is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                ids = [[np.frombuffer(x, np.uint32) for x in b.column(c).to_pylist() if x is not None] for c in ("__a", "__b")]
                al = Alignment(*(np.concatenate(x).astype(np.int64) for x in ids), *lengths)
                ends = al.ends_a[np.cumsum([len(x) for x in ids[0]]) - 1]
                cuts = al.cut(ends)
                best, count, known = lookup.value(al.pairs)
                if every and not known.all():
                    raise RuntimeError("a pair of the second pass is not in the table of the first")
                sums = [np.concatenate([[0], np.cumsum(x)])[cuts[3]] for x in (best, count)]
                numbers[some] = np.diff(np.stack([*cuts, *sums], 1), axis=0, prepend=0)
                if last:
                    text, ends = al.written(digits)
                    at = 0
                    for i, to in zip(some.tolist(), ends[cuts[2] - 1].tolist(), strict=True):
                        digests[i] = hashlib.sha256(text[at : to - 1]).hexdigest()
                        if with_groups:
                            groups[i] = text[at : to - 1].decode()
                        at = to
            for j, c in ((4, "__n_best"), (5, "__count_sum")):
                numbers[:, j] += b.column(c).to_numpy()
            columns = {c: b.column(c) for c in out} | {f"__{c}": pa.array(numbers[:, j]) for j, c in enumerate(_NUMBERS)}
            if last:
                columns |= {"__groups_sha256": pa.array(digests)} | ({"__groups": pa.array(groups)} if with_groups else {})
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def aligned(docs: DataFrame, keep: list[str] | None = None, text: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B,
            with_groups: bool = False, range_pairs: int = RANGE) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``__n_a``, ``__n_b``, ``__n_groups``,
    ``__n_links``, ``__n_best``, ``__count_sum``, ``__groups_sha256`` and, if asked
    for, ``__groups`` (``a1,a2|b1;a3|b2,b3``)."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    small_batches(spark, 500)
    with open(model_a, "rb") as a, open(model_b, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))  # two vocabulary files, a few MB
    keep = docs.columns if keep is None else keep
    fields = [pa.field(c, to_arrow_type(docs.schema[c].dataType)) for c in keep]
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    first = written(source.mapInArrow(_encode(shared, text, keep, fields), kept + "__a binary, __b binary, __pair long, __n long"), "token-ids")
    pairs = first.filter("__pair IS NOT NULL").select(F.col("__pair").alias("pair"), F.col("__n").alias("n"))
    ranges, best = pair_counts(pairs, len(_pair(shared).bytes_a), range_pairs)
    zero = [F.lit(0).cast("long").alias(c) for c in ("__n_best", "__count_sum")]
    cur, done = first.filter("__pair IS NULL").select(*[F.col(f"`{c}`") for c in keep], "__a", "__b", *zero), []
    for i, (shards, levels, counts) in enumerate(ranges):
        hash_ = PerfectHash.of(shards, [tuple(x) for x in levels.collect()])
        lookup = spark.sparkContext.broadcast(Lookup(hash_, _vector(counts, len(hash_.keys)), best))
        last = i == len(ranges) - 1
        out = keep if last else [*keep, "__a", "__b"]
        schema = kept + ("" if last else "__a binary, __b binary, ") + ", ".join(f"__{c} long" for c in _NUMBERS)
        schema += (", __groups_sha256 string" + (", __groups string" if with_groups else "")) if last else ""
        cur = cur.select(*[F.col(f"`{c}`") for c in keep], "__a", "__b", "__n_best", "__count_sum")
        cur = cur.mapInArrow(_look_up(shared, lookup, out, with_groups, last, len(ranges) == 1), schema)
        release(spark, levels, counts)
        if not last:
            cur = written(cur, "aligned")
            release(spark, *done)
            done = [cur]
    return cur


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", *[F.col(f"__{c}").alias(c) for c in (*_NUMBERS, "groups_sha256")])

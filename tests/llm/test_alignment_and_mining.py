"""Hard negatives, cross-tokenizer alignment and language identification against
brute force, on tables with nulls, empty and long texts, ties, repeated rows and
clashing column names."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest

from pricewise.llm import hard_negatives as H
from pricewise.llm import language_id as L
from pricewise.llm import token_align as T

VECTORS = "vec_id long, embedding array<float>, label int, score long, slot string"


# ------------------------------------------------------------ hard negatives --

@pytest.mark.parametrize(("dim", "size"), [(3, 20), (64, 300), (700, 40000), (9000, 50), (16, 2**27)])
def test_products_are_exact(dim, size):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-size, size, (5, dim)), rng.integers(-size, size, (7, dim))
    b[:5] = a  # the greatest possible scores
    primes = H.moduli(dim, int(max((a.astype(object) ** 2).sum(1).max(), (b.astype(object) ** 2).sum(1).max())))
    got = H.products(H.Residues.of(a.astype(float), primes), H.Residues.of(b.astype(float), primes), primes)
    assert got.astype(np.int64).tolist() == (a.astype(object) @ b.astype(object).T).tolist()


def mined(rows):
    """Plain Python over (vec_id, vector, label)."""
    rows = sorted({(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(int(np.floor(256.0 * float(np.float32(c)))) for c in v)) for i, v, y in rows
                   if None not in (i, v, y) and all(c is not None and np.isfinite(c) for c in v)})
    out = []
    for a, label, x in rows:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, z)), i, y) for i, y, z in rows if i != a)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            good = [t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a, p, k, t[1], -s, -t[0]) for k, t in enumerate(good, 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * 0.6).astype(np.float32).tolist(), int(i % 4)) for i in range(420)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(150)]  # one common vector: ties
    rows += rows[100:110] + [(50, rows[50][1], rows[50][2])]      # repeated rows, an anchor too
    rows += [(2000, None, 1), (2001, rows[1][1], None), (None, rows[2][1], 2), (2050, [float("nan")] * 8, 1), (2051, [None] * 8, 1), (2052, [float("inf")] + [0.0] * 7, 1)]
    return rows


@pytest.mark.parametrize("shard_bytes", [H.SHARD_BYTES, 400])
def test_mining_matches_brute_force(spark, shard_bytes):
    rows = vectors()
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], VECTORS).repartition(5)
    got = sorted(tuple(r) for r in H.mine(df, shard_bytes=shard_bytes).collect())
    want = mined(rows)
    assert len(want) > 40 and got == want


def test_mining_of_odd_tables(spark):
    assert H.mine(spark.createDataFrame([], VECTORS)).count() == 0
    alone = [(50, [1.0, 2.0], 1), (51, [1.0], 1), (52, [0.6], 2)]  # unequal lengths: padded with zeros
    got = [tuple(r) for r in H.mine(spark.createDataFrame([(*r, 0, "") for r in alone], VECTORS)).collect()]
    assert got == [(50, 51, 1, 52, 65536, 256 * 153)]
    with pytest.raises(ValueError, match="64 bits"):
        H.mine(spark.createDataFrame([(50, [1e30], 1, 0, "")], VECTORS))


# ----------------------------------------------------------- token alignment --

ODD = [None, "", " ", "a", "  a  b ", "foo ▁bar", "x▁", "tab\tand\nnew line \n y", "<|endoftext|> <s> </s> <unk> <0x41>", "Ä ß 😀 \x00 x", "\u0085 a b   c",
       "ﬁ ① é é", "日本語 テスト", "a" * 3000, "e " * 500, "\x1c a \x1d", "don't we'll", "\n", "a\r\nb", "foo bar", "foo bar", "It was 12,345.67 in naïve cafés."]


@pytest.fixture(scope="module")
def tokenizers():
    with open(T.MODEL_A, "rb") as a, open(T.MODEL_B, "rb") as b:
        return T.Pair(a.read(), b.read())


def spans(ids, table):
    ends = list(itertools.accumulate(len(table[i]) for i in ids))
    return list(zip([0, *ends], ends, ids))


def alignments(texts, t):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of whole texts, each encoded at once."""
    docs = []
    for text in texts:
        docs.append(None)
        if not text:
            continue
        (a,), (b,) = t.encode([text])
        whole = (" " + text).encode()
        if any(b"".join(table[i] for i in ids.tolist()) != whole for ids, table in ((a, t.bytes_a), (b, t.bytes_b))):
            continue
        a, b = spans(a.tolist(), t.bytes_a), spans(b.tolist(), t.bytes_b)
        groups, i, j = [], 0, 0
        for end in sorted({x[1] for x in a} & {x[1] for x in b}):
            of_a = [x[2] for x in a[i:] if x[1] <= end]
            of_b = [x[2] for x in b[j:] if x[1] <= end]
            i, j = i + len(of_a), j + len(of_b)
            groups.append(",".join(map(str, of_a)) + "|" + ",".join(map(str, of_b)))
        links, at = [], 0
        for s, e, x in a:
            while b[at][1] <= s:
                at += 1
            links += [(x, y) for p, q, y in itertools.takewhile(lambda z, e=e: z[0] < e, b[at:])]
        docs[-1] = (len(a), len(b), len(groups), links, ";".join(groups))
    counts = Counter(p for d in docs if d for p in set(d[3]))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[p] == best[p[0]] for p in d[3]), sum(counts[p] for p in d[3]), d[4]) for d in docs]


@pytest.mark.parametrize("range_pairs", [T.RANGE, 40])
def test_alignment_matches_brute_force(spark, sf_dir, tokenizers, range_pairs):
    texts = ODD + ([r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(30).collect()] if range_pairs == T.RANGE else [])
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in enumerate(texts)], "doc_id long, text string, __n_a long, groups string").repartition(3)
    got = {r["doc_id"]: r for r in T.aligned(df, ["doc_id"], with_groups=True, range_pairs=range_pairs).collect()}
    for i, want in enumerate(alignments(texts, tokenizers)):
        r = got[i]
        assert tuple(r[f"__{c}"] for c in T._NUMBERS) + (r["__groups"],) == want, texts[i]
        assert r["__groups_sha256"] == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")


def test_alignment_of_an_empty_table(spark):
    assert T.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_bytes(tokenizers):
    assert tokenizers.separable and sorted(T.byte_characters().values()) == list(range(256))
    a, b = tokenizers.encode(["é ▁"])
    assert b"".join(tokenizers.bytes_a[i] for i in a[0]).decode() == " é ▁"
    assert b"".join(tokenizers.bytes_b[i] for i in b[0]).decode() == " é  "


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_perfect_hash_is_minimal_and_verifies(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**62, n, dtype=np.uint64))
    shards = 3
    parts = [(s, level, np.packbits(bits).tobytes(), len(bits), k.tobytes())
             for s in range(shards) for level, (bits, k) in enumerate(T.build_levels(keys[T.shard_of(keys, shards) == s]))]
    h = T.PerfectHash.of(shards, parts)
    index, known = h(keys)
    assert known.all() and sorted(index.tolist()) == list(range(len(keys)))
    assert not h(keys + np.uint64(1 << 63))[1].any()


def test_tree_sum(spark):
    rows = [(k % 2, T._packed(np.array([k, 70000 * k, 0]))) for k in range(100)]
    got = {r[0]: T._unpacked(r[1]).tolist() for r in T.tree_sum(spark.createDataFrame(rows, "block int, vector binary").repartition(7), 50).collect()}
    assert got == {0: [2450, 2450 * 70000, 0], 1: [2500, 2500 * 70000, 0]}


# ---------------------------------------------------------- language identity --

@pytest.mark.parametrize("together", [1, 3, 8])
def test_viterbi_finds_the_best_path(monkeypatch, together):
    monkeypatch.setattr(L, "TOGETHER", together)
    rng = np.random.default_rng(together)
    for _ in range(25):
        n, sizes = int(rng.integers(1, 4)), rng.integers(0, 7, int(rng.integers(1, 14)))
        scores = (-5 * rng.random((sizes.sum(), n))).astype(np.float32)
        labels, at = L.viterbi(scores, sizes, 1.5), 0
        for z in sizes.tolist():
            s, own = scores[at : at + z].tolist(), labels[at : at + z].tolist()
            at += z

            def value(path, s=s):
                return sum(s[i][j] for i, j in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))
            assert abs(value(own) - max(map(value, itertools.product(range(n), repeat=z)))) < 1e-4


SAMPLES = {"en": "the house and the river are not far from the old mill where we were", "de": "das haus und der fluss sind nicht weit von der alten mühle wo wir waren",
           "ru": "дом и река недалеко от старой мельницы где мы были"}
DOCS = "doc_id long, text string, lang string, __lang long, spans string"


def learned(spark):
    rows = [(i, SAMPLES[l], l, 1, "x") for i, l in enumerate(itertools.islice(itertools.cycle(SAMPLES), 60))]
    return L.learn(spark.createDataFrame([*rows, (100, None, "en", 1, ""), (101, "text without language", None, 1, ""), (None, "the", "xx", 1, "")], DOCS))


def test_features_of_words():
    f = L.features(["ab", "日"], 1 << 10)
    # ^ab^ has three bigrams, two trigrams and one of four; ^日^ has two and one.
    assert np.diff([*f.first, len(f.buckets)]).tolist() == [6, 3]
    assert f.scripts.tolist() == [list(L.SCRIPTS).index("latin"), list(L.SCRIPTS).index("han")] and f.letters.tolist() == [2, 1]
    alone = L.features(["日"], 1 << 10)
    assert sorted(alone.buckets) == sorted(f.buckets[6:])


def test_languages_and_spans(spark):
    model = learned(spark)
    assert model.languages == ["de", "en", "ru"]  # no held-out or null id, no null language
    mixed = "The river and the mill. Das Haus und der Fluss von der Mühle. Дом и река"
    texts = [None, "", "12 ?!", mixed, SAMPLES["de"], SAMPLES["ru"] * 300, "the " * 20000, "日本", "дом"]
    df = spark.createDataFrame([(i, t, "zz", 5, "y") for i, t in enumerate(texts)] + [(3, mixed, None, 5, "y")], DOCS)
    got = {r["doc_id"]: r for r in L.identified(df.drop("__lang"), model, ["doc_id"], with_spans=True).collect()}
    assert [got[i]["__lang"] for i in range(3)] == ["und"] * 3 and [got[i]["__score"] for i in range(3)] == [0.0] * 3
    s = got[3]["__spans"]
    assert [x["lang"] for x in s] == ["en", "de", "ru"] and mixed[s[1]["start"] : s[1]["end"]] == "Das Haus und der Fluss von der Mühle"
    assert got[3]["__lang"] == "de" and 0.4 < got[3]["__score"] < 0.6
    assert [got[i]["__lang"] for i in (4, 5, 6, 8)] == ["de", "ru", "en", "ru"] and got[4]["__score"] > 0.95
    assert got[7]["__lang"] in model.languages
    plain = {r["doc_id"]: r["__lang"] for r in L.identified(df.drop("__lang"), model, ["doc_id"]).collect()}
    assert plain == {i: r["__lang"] for i, r in got.items()}


def test_languages_without_training(spark):
    empty = spark.createDataFrame([], DOCS)
    model = L.learn(empty)
    assert [r["__lang"] for r in L.identified(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).collect()] == ["und"]
    assert L.identified(empty.drop("__lang"), learned(spark)).count() == 0


def test_language_accuracy_on_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    held = L.op13_language_id(spark, sf).join(docs, "doc_id").filter("held_out and lang is not null").toPandas()
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() >= 0.97 and held.score.between(0, 1).all()

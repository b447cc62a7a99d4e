"""Spark text expressions equal plain-Python versions of the reference's
string semantics on seeded random strings (Unicode whitespace, accents,
brackets, slashes)."""

import random
import re

import pytest

from pricewise import constants as K
from pricewise.functions import text as TX

ALPHABET = (list("abcXYZ019 /[]rm.,;!-'\"&") + ["[rm]", "[RM]", "No description yet", "é", "Ü", "ß", "ñ"]
            + ["\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", " "]
            + ["new", "used", "brand new", "ok", "vintage", "lot"])


def _strings(n=300, seed=11):
    rng = random.Random(seed)
    out = [None, "", " ", "No description yet", "no description yet"]
    while len(out) < n:
        out.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))))
    return out


def py_clean(s):
    s = "" if s is None else s
    s = re.sub(r"\[rm\]", "", s).lower()
    return re.sub(r"\s+", " ", s).strip()


def py_clean_desc(s):
    s = "" if s is None else s
    return py_clean("" if s == K.NO_DESCRIPTION else s)


def py_normalize(s):
    if s is None:
        return ""
    s = re.sub(r"[^a-z0-9\s]", " ", s.lower())
    return re.sub(r"\s+", " ", s).strip()


def py_tokens(s):
    return re.findall(r"(?u)\b\w\w+\b", py_normalize(s))


def py_split(s):
    s = "unknown/unknown/unknown" if s is None else s
    p = s.split("/", 2)
    return [p[0], p[1] if len(p) > 1 else "unknown", p[2] if len(p) > 2 else "unknown"]


@pytest.fixture(scope="module")
def rows(spark):
    vals = _strings()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    cat, m, s1, s2 = TX.split_category("s")
    kw = K.QUALITY_KEYWORDS["excellent"] + K.QUALITY_KEYWORDS["poor"]
    out = df.select("i", "s", TX.clean_name("s").alias("cn"), TX.clean_description("s").alias("cd"),
                    TX.word_count("s").alias("wc"), TX.normalize_text("s").alias("nt"),
                    TX.raw_tokens("s").alias("tok"), TX.keyword_count("s", kw).alias("kc"),
                    TX.py_strip("s").alias("st"), m.alias("m"), s1.alias("s1"), s2.alias("s2"),
                    TX.meaningful_words("s", "s").alias("mw")).orderBy("i").collect()
    return out, kw


def test_cleaning_matches_python(rows):
    out, _ = rows
    for r in out:
        assert r.cn == py_clean(r.s), repr(r.s)
        assert r.cd == py_clean_desc(r.s), repr(r.s)
        assert r.wc == len((r.s or "").split()), repr(r.s)
        assert r.st == (r.s.strip() if r.s is not None else None), repr(r.s)


def test_normalize_and_tokens_match_python(rows):
    out, _ = rows
    for r in out:
        assert r.nt == py_normalize(r.s), repr(r.s)
        assert list(r.tok) == py_tokens(r.s), repr(r.s)


def test_keywords_split_words_match_python(rows):
    out, kw = rows
    for r in out:
        low = (r.s or "").lower()
        assert r.kc == sum(1 for k in kw if k in low), repr(r.s)
        assert [r.m, r.s1, r.s2] == py_split(r.s), repr(r.s)
        text = f"{r.s or ''} {r.s or ''}".lower()
        assert r.mw == len([w for w in text.split() if len(w) > 2]), repr(r.s)

"""Text steps that looked at a text many times, or moved more than the row: their
results on odd texts, and plans without the costly steps."""

import contextlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pricewise import constants as K
from pricewise.functions import keywords as KW
from pricewise.functions import text as TX
from pricewise.operators import tfidf as TF
from pricewise.operators.features import FittedPreprocessor, PreprocessorParams

ODD = [None, "", "o", "ok", "k", "USED once", "stai", "stained", "scratchedhole", "İnew K", "kein oké", "mint" * 5, "like new", "like", " new",
       "\x85 a b 　", "\x1f x", "​x ", "a b", "[rm]a [RM] [rm][rm]", "  two  spaces "]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_keyword_features_read_a_text_once(spark):
    df = spark.createDataFrame([(s,) for s in ODD], "s string")
    kw = df.select(*[c.alias(n) for n, c in TX.keyword_features("s").items()])
    plan = _plan(kw)
    assert plan.count("ArrowEvalPython") == 1 and "Contains" not in plan
    words = K.QUALITY_KEYWORDS | K.VALUE_KEYWORDS
    plain = [[sum(w in t for w in words[g]) for g in ("excellent", "good", "fair", "poor", "luxury", "budget")] for t in [(s or "").lower() for s in ODD]]
    assert [list(r)[:6] for r in kw.collect()] == plain


def test_keywords_of_any_length_inside_their_text(monkeypatch):
    monkeypatch.setattr(KW, "SEARCHED_BYTES", 4)  # several stretches
    texts = ["", "a", "ab", "b", "abcdef", "éé", "xabcde", "abcd", "efab", "ab" * 9]
    words = ["", "a", "ab", "abc", "abcde", "é", "fab", "ba"]
    counts, = KW.count_keywords(pa.array(["zz", *texts]).slice(1), [[w.encode() for w in words]])
    assert counts.tolist() == [sum(w in t for w in words) for t in texts]
    assert KW.count_keywords(pa.array([], pa.string()), [[b"a"]])[0].tolist() == []


def test_strip_and_word_count(spark):
    rows = spark.createDataFrame([(s,) for s in ODD if s is not None], "s string").select("s", TX.py_strip("s").alias("p"), TX.clean_name("s").alias("c"), TX.word_count_clean(TX.clean_name("s")).alias("n"))
    assert "regexp_replace" not in _plan(rows.select("p"))
    for r in rows.collect():
        assert r.p == r.s.strip() and r.n == len(r.c.split())
        assert r.c == " ".join(r.s.replace("[rm]", "").lower().split())


def test_terms_are_counted_in_stretches(monkeypatch):
    monkeypatch.setattr(TF, "COUNTED_TERMS", 3)
    lists = pa.array([["a", "b", "a"], None, [], ["a"], ["c", "c", "c", "c"], ["b"]], pa.list_(pa.string()))
    total: dict = {}
    parts = list(TF._count_terms([pa.record_batch([lists], names=["terms"])]))
    for p in parts:
        for r in p.to_pylist():
            n, tf = total.get(r["term"], (0, 0))
            total[r["term"]] = (n + r["n"], tf + r["tf"])
    assert len(parts) > 1 and total == {"a": (2, 3), "b": (2, 2), "c": (1, 4)}


def test_weights_carry_no_table_in_the_rows(spark):
    """The idf values were a column of every row, 80 KB each with 10,000 terms."""
    terms, idf = ["blue", "red", "red shoe", "shoe"], [1.5, 1.0, 2.0, 1.25]
    pre = FittedPreprocessor(spark, PreprocessorParams(onehot_columns=[], target_columns=[]), terms, idf, {}, {}, {})
    df = spark.createDataFrame([(1, "Red shoe", "red RED", 1, 1, "a", "b", 2.0), (2, "nothing", None, 1, 1, "a", "b", 2.0)],
                               "train_id long, name string, item_description string, item_condition_id int, shipping int, category_name string, brand_name string, price double")
    out = pre.transform(df)
    assert "ubquery" not in _plan(out)
    got = {r["train_id"]: r["features"].toArray()[:4] for r in out.collect()}
    w = np.array([0.0, (1 + np.log(3)) * 1.0, 2.0, 1.25])
    assert np.allclose(got[1], w / np.linalg.norm(w), rtol=1e-14) and not got[2].any()

"""Whitespace runs are collapsed for many texts at once, and cleaned texts are not
lowered and stripped again for a scoring request."""

import numpy as np
import pyarrow as pa
import pytest

from pricewise.functions import text as TX
from pricewise.functions import whitespace as WS
from pricewise.operators import cleaning as CL
from pricewise.operators import scoring as SC
from pricewise.plans import registry as R
from pricewise.sources import listings as SRC

ALL = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x11000)]))
ODD = [None, "", " ", "a", " \t\n ", "a  b", " [rm] A　 B [rm][RM]", "x\xa0\x85y  z", "no​ne ⁠ ﻿", "é  É",
       "İ ΑΣ\x1fΣ\x1c", "\U0001f600 \U0001f600  ", "日本　語、、 ", "\x00 \x08\x0e\x1b!", "tail ", " head", "No description yet", "[r[rm]m]"]


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_runs_are_those_of_python(monkeypatch, stretch, kind):
    monkeypatch.setattr(WS, "STRETCH_BYTES", stretch)
    rng = np.random.default_rng(3)
    drawn = ["".join(rng.choice(list(WS.WS_CHARS + "aé日​\U0001f600"), n)) for n in rng.integers(0, 9, 200)]
    texts = ["cut off ", *ODD, *drawn, " x".join(ALL)]
    got = WS.collapse_runs(pa.array(texts, kind).slice(1))
    got.validate(full=True)
    assert got.type == kind
    assert [None if t is None else t.strip(" ") for t in got.to_pylist()] == [None if t is None else " ".join(t.split()) for t in texts[1:]]


def test_nothing_to_collapse():
    for texts in ([], [None, None], ["", ""], [None, ""]):
        assert WS.collapse_runs(pa.array(texts, pa.string())).to_pylist() == texts


def test_whitespace_characters_are_those_of_python():
    assert set(WS.WS_CHARS) == {c for c in map(chr, range(0x110000)) if c.isspace()}


def test_cleaning_takes_no_pattern_for_whitespace(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string").repartition(3)
    out = df.select("i", "s", TX.clean_name("s").alias("n"), TX.clean_description("s").alias("d"), TX.collapse_ws("s").alias("w"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "(?U)" not in plan and plan.count("ArrowEvalPython") == 1
    for r in out.collect():
        want = " ".join((r.s or "").replace("[rm]", "").lower().split())
        assert r.n == want and r.d == ("" if r.s == "No description yet" else want)
        assert r.w == (None if r.s is None else " ".join(r.s.split()))


def test_requests_of_cleaned_listings_are_the_same(spark):
    rows = [(i, a, b, "ΑΣ" if i % 3 else None, "Home/Décor/x" if i % 2 else None, i % 7, i % 2, 5.0)
            for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD)]
    df = spark.createDataFrame(rows, "train_id long, name string, item_description string, brand_name string, category_name string, "
                                     "item_condition_id int, shipping int, price double")
    listings = CL.clean_listings(df, add_features=False)
    short, long = SC.scoring_request(listings, cleaned=True), SC.scoring_request(listings)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, long.collect()))


def test_cleaned_texts_are_lowered_once(spark, sf_dir):
    def again(df):
        return "lower(trim(coalesce(" in df._jdf.queryExecution().analyzed().toString()

    listings = CL.clean_listings(SRC.listings(spark, sf_dir), add_features=False)
    assert again(SC.scoring_request(listings))
    assert not again(R.QUERIES["scoring_request"](spark, sf_dir)) and not again(R.QUERIES["enrich_listing"](spark, sf_dir))

"""Analyzers and synonyms on texts made here."""

import pytest
from pyspark.sql import functions as F

from cairnmap.functions import text


def forms(spark, value, analyzer):
    return spark.createDataFrame([(value,)], "t string").select(text.analyzed(F.col("t"), analyzer)).first()[0]


@pytest.mark.parametrize(
    ("value", "analyzer", "want"),
    [
        ("Zürich,  Bahnhof", "index", [["zürich", "zurich"], ["bahnhof"]]),
        ("ﬁne Ⅳ", "index", [["fine"], ["iv"]]),  # a ligature and a Roman numeral in one character each
        ("Zürich", "admin", [["zürich", "zurich"]]),  # a mark of its own
        ("Äb", "grams", [["ä", "äb", "a", "ab"]]),
        ("Main St.", "query", [["main"], ["st."]]),
        ("Main St", "query", [["main"], ["st", "street", "str"]]),
        ("22nd Rd", "street", [["22"], ["road", "rd"]]),
        ("AB-1 ２", "zip", [["ab1"]]),
        (" ", "zip", []),
        ("", "index", []),
        (None, "index", None),
    ],
)
def test_analyzers(spark, value, analyzer, want):
    assert forms(spark, value, analyzer) == want


def test_ordinals(spark):
    pairs = {"1st": "1", "2nd": "2", "3rd": "3", "4th": "4", "11th": "11", "22nd": "22", "113th": "113", "21st": "21", "100th": "100", "north": "north", "1": "1", "22": "22"}
    got = spark.createDataFrame(list(pairs.items()), "t string, want string").select("t", text.without_ordinal(F.col("t")).alias("got"), "want").collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got]


@pytest.mark.parametrize("limit", [5000, 1])
def test_canonical(spark, monkeypatch, limit):
    monkeypatch.setattr(text, "MAX_SYNONYMS", limit)
    synonyms = spark.createDataFrame([("st", "street"), ("n", "north"), ("new york", "ny"), (None, "x")], "token string, canonical string")
    rows = [(1, "Main (St.)  N"), (2, ""), (3, None), (4, "new york"), (1, "Main (St.)  N"), (5, "Öst st")]
    got = text.with_canonical(spark.createDataFrame(rows, "id int, t string"), "t", synonyms)
    want = {(1, "Main street north"), (2, ""), (3, None), (4, "new york"), (5, "Öst street")}
    assert {(r["id"], r["normalized"]) for r in got.collect()} == want and got.count() == 6

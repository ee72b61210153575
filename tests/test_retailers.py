"""Retailers of stated names that were read by hand."""

import pytest
from pyspark.sql import functions as F

from noticeworks.operators import retailers as R

CATALOG = [("walmart", "Walmart", ["wal-mart", "walmart supercenter"]), ("sams", "Sam's Club", ["sams"]), ("ap", "Stop & Shop", None), ("trader", "Trader Joe's", ["trader joe"]), ("smith", "Smith", [])]
SAID = {
    "Wal-Mart Stores": ["walmart"], "SAM’S CLUB": ["sams"], "Sam's": ["sams"], "Stop and Shop supermarkets": ["ap"], "Walmart and Sam's Club": ["walmart", "sams"], "Trader Joe's, Walmart, Walmart Supercenter locations": ["trader", "walmart"],
    "Smith's": ["smith"], "Walmart and Elsewhere": [], "Stop & Shop and Smith": ["ap", "smith"], "stores": [], "": [], None: [],
}


def test_names(spark, monkeypatch):
    names = spark.createDataFrame(CATALOG, "id string, name string, aliases array<string>")
    df = spark.createDataFrame([(str(t), t) for t in SAID], "retailers string, said string")
    for most in (R.BROADCAST_ALIASES, 1):
        monkeypatch.setattr(R, "BROADCAST_ALIASES", most)
        got = {r.key: r.retailers for r in R.retailers_of(df, "retailers", "said", R.catalog(names, "id", "name", "aliases")).collect()}
        assert got == {str(t): w for t, w in SAID.items()}


def test_an_alias_of_two_is_an_error(spark):
    names = spark.createDataFrame([("a", "One", None), ("b", "ONE.", None)], "id string, name string, aliases array<string>")
    with pytest.raises(Exception, match="two retailers"):
        R.catalog(names, "id", "name", "aliases").agg(F.max("alias")).collect()

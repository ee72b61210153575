"""Destinations of sentences that were read by hand."""

from pyspark.sql import functions as F

from noticeworks.operators import distribution as D

SAID = {
    "Product was distributed (CA, TX, OR).": ("California|Oregon|Texas", "", False),
    "It was distributed to stores located in Alabama, Georgia and Florida, except for stores in Ohio.": ("Alabama|Florida|Georgia", "Ohio", False),
    "Angelicae was distributed in the following states.\nArizona, California.\nNevada.\nThe firm is sorry.\nUtah.": ("Arizona|California|Nevada", "", False),
    "LAKELAND, Fla., Oct. 15, 2025 - Acme of Milford, Ohio, is recalling soup shipped to retailers in Utah.": ("Utah", "", False),
    "Spinach grown by its supplier Element Farms in their Pompton Plains, New Jersey farm was sold in Texas.": ("Texas", "", False),
    "It was shipped from our facility in Idaho, to stores in Utah.": ("Utah", "", False),
    "Stores in Maine are not affected.": ("", "Maine", False),
    "Listeria was found in a sample in Ohio.": ("", "", False),
    "The product can be found at markets in Washington and in Florida.": ("Florida|Washington", "", False),
    "This recall extends only to Sun stores in Florida.": ("Florida", "", False),
    "It was sold in the frozen section of stores in Texas.": ("", "", False),
    "Products were distributed nationwide.": ("", "", True),
    "The firm has store locations in Ohio.": ("", "", False),
    "": ("", "", False),
    None: ("", "", False),
}


def test_sentences(spark):
    df = spark.createDataFrame([(str(t), t, "x") for t in SAID], "key string, text string, states string")
    got = {r.key: ("|".join(r.states), "|".join(r.excluded), r.nationwide is not None) for r in D.distribution_prose(df, "key", "text").collect()}
    assert {t: (got[str(t)], w) for t, w in SAID.items() if got[str(t)] != w} == {}


def test_geography_after_evidence(spark):
    rows = [("nationwide", None, ["Ohio"], [], None, None), ("unknown", None, [], [], "nationwide", None), ("unknown", None, [], [], "nationwide", ["Utah"]), ("states", ["Ohio", "Maine"], ["Utah", "Maine"], ["Maine"], None, None), ("states", ["Maine"], [], ["Maine"], None, None)]
    df = spark.createDataFrame([(s, st, (a, e, n), t) for s, st, a, e, n, t in rows], "scope string, states array<string>, said struct<states:array<string>,excluded:array<string>,nationwide:string>, t array<string>")
    got = [tuple(r[0]) for r in df.select(D.geography(F.col("scope"), F.col("states"), F.col("said"), F.col("t"))).collect()]
    assert got == [("nationwide", [], [], [], []), ("nationwide", [], [], [], []), ("states", ["Utah"], ["Utah"], [], []), ("states", ["Ohio", "Utah"], ["Utah"], ["Maine"], ["Maine"]), ("unknown", [], [], ["Maine"], [])]

"""Identifiers of sentences and list items that were read by hand."""

from noticeworks.operators import prose

SAID = {
    "Basil Leaves 2 oz, UPC: 6 28634 44216 6, Lot codes: A12 and A13, Best By 12/04/2024.": [("Basil Leaves 2 oz", "upc", "628634442166", None), ("Basil Leaves 2 oz", "lot", "A12", "12/04/2024"), ("Basil Leaves 2 oz", "lot", "A13", "12/04/2024"), ("Basil Leaves 2 oz", "best_by", "12/04/2024", None)],
    "Consumers can find lot number 24TJ0055 printed on the back.": [(None, "lot", "24TJ0055", None)],
    "The expiration dates are Jan 5, 2025 and Feb 6, 2025, located on top": [(None, "expiration", "Jan 5 2025", None), (None, "expiration", "Feb 6 2025", None)],
    "UPC Code is 12345": [(None, "product_code", "12345", None)],
    "The lot was clean. A lot of people like it.": [],
    "No best by date is printed. Lot numbers: none": [],
    "This follows a supplier recall of lot 77.": [],
    "Lot 9 Lot 9 lot 9": [(None, "lot", "9", None)],
    "": [],
    None: [],
}


def test_sentences(spark):
    df = spark.createDataFrame([(str(t), t, 1) for t in SAID], "key string, text string, value int")
    rows = prose.prose_identifiers(df, "key", "text").collect()
    got = {str(t): [(r.owner, r.concept, r.value, r.paired_date) for r in sorted(rows, key=lambda r: r.place) if r.key == str(t)] for t in SAID}
    assert {t: (g, SAID[None if t == "None" else t]) for t, g in got.items() if g != SAID[None if t == "None" else t]} == {}


def test_lists_and_no_owner(spark):
    html = "<p>Lot 1</p><ul><li>Oat Bars, lot 22<ul><li>UPC 071279309066</li></ul></li><li>Rye Bread lot 33</ul>"
    df = spark.createDataFrame([("a", html), ("b", None), ("a", html)], "key string, html string")
    rows = sorted((r.key, r.place, r.owner, r.concept, r.value) for r in prose.listed_identifiers(df, "key", "html").collect() if r.owner)
    assert rows == [("a", 1, "Oat Bars", "lot", "22")] * 2 + [("a", 3, "Rye Bread", "lot", "33")] * 2
    assert prose.identifiers_in(df.where("false").selectExpr("key", "array(html) AS x"), "key", "x").collect() == []

"""Precedence of tables, lists and prose over small pages."""

from noticeworks.operators import case_facts as C

TABLE = "<table><tr><th>Product</th><th>UPC</th><th>Best By</th><th>Lot</th></tr><tr><td>Oat Bars</td><td>071279309066</td><td>12/04/2024</td><td>A1</td></tr></table>"
LIST = "<ul><li>Rye Bread, lot 22</li><li>Oat Bars, lot A1</li></ul>"
PROSE = "<p>Jam Jars, lot 33. The packages bear lot number Z9. Lots A1 and Z9.</p>"
PAGES = {"all": TABLE + LIST + PROSE, "lists": LIST + PROSE, "prose": PROSE, "none": "<p>Nothing.</p>", "null": None}


def test_precedence(spark):
    df = spark.createDataFrame(list(PAGES.items()), "product string, value string")
    got = {}
    for r in C.case_facts(df, "product", "value").collect():
        got.setdefault(r.key, set()).add((r.product, r.concept, r.value, r.source, r.paired_date))
    assert got["all"] == {
        ("Oat Bars", "variant", "Oat Bars", "table", None), ("Oat Bars", "upc", "071279309066", "table", None), ("Oat Bars", "best_by", "12/04/2024", "table", None), ("Oat Bars", "lot", "A1", "table", "12/04/2024"),
        (None, "lot", "22", "list", None), (None, "lot", "33", "prose", None), (None, "lot", "Z9", "prose", None),
    }
    assert got["lists"] == {("Rye Bread", "lot", "22", "list", None), ("Oat Bars", "lot", "A1", "list", None), (None, "lot", "33", "prose", None), (None, "lot", "Z9", "prose", None)}
    assert got["prose"] == {("Jam Jars", "lot", "33", "prose", None), (None, "lot", "Z9", "prose", None), (None, "lot", "A1", "prose", None)}
    assert set(got) == {"all", "lists", "prose"}

"""Hazard words and relevance, case by case."""

from pyspark.sql import functions as F

from noticeworks.functions import relevance as R


def column(spark, expr, values, schema="x string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.coalesce(1).select(expr).collect()]


def test_hazard_words(spark):
    texts = ["Possible LISTERIA monocytogenes", "listeria and Salmonella", "E. coli O157:H7 found", "Salmonellae", "", None]
    assert column(spark, R.pathogen(F.col("x")), texts) == ["Listeria monocytogenes", "Listeria", "E. coli O157:H7", None, None, None]
    texts = ["high lead levels", "leading brand", "asbestos is a mineral", "potential to be contaminated with asbestos", "may contain elevated levels of thallium", "asbestos or lead contamination", "asbestos and talc contamination", None]
    assert column(spark, R.chemical_agent(F.col("x")), texts) == ["lead", None, None, "asbestos", "thallium", "lead", None, None]


def test_allergens(spark):
    texts = ["Undeclared milk and sesame.", "undeclared soybeans, almonds, and/or pecans", "milk", "undeclared zinc", "", None]
    assert column(spark, R.allergen_tokens(F.col("x")), texts) == [["milk", "sesame"], ["soy", "tree nuts"], [], [], [], []]


def test_categories_and_illness(spark):
    assert column(spark, R.in_display_order(F.col("x")), [(["other", "seafood", "zzz", "seafood"],), ([],), (None,)], "x array<string>") == [["seafood", "other"], [], []]
    kinds = [(["unknown", "explicit_none", "reported_count"],), (["reported_count", "explicit_none"],), (["explicit_none", "unknown"],), (["unknown"],), ([],), (None,)]
    assert column(spark, R.resolve_illness(F.col("x")), kinds, "x array<string>") == ["reported_unspecified", "reported_count", "explicit_none", "unknown", "unknown", "unknown"]


def test_affects(spark):
    rows = [
        ("nationwide", [], ["Ohio"], False, False),
        ("nationwide", [], [], False, False),
        ("states", ["Iowa"], ["Ohio"], True, False),
        ("states", ["Iowa", "Ohio"], ["Ohio"], False, False),
        ("states", ["Ohio"], ["Ohio"], True, True),
        ("unknown", None, ["Ohio"], True, False),
        ("unknown", None, ["Ohio"], False, False),
        (None, None, None, None, None),
    ]
    c = [F.col(n) for n in "scope states chosen signal mismatch".split()]
    got = column(spark, R.affects(*c), rows, "scope string, states array<string>, chosen array<string>, signal boolean, mismatch boolean")
    assert got == [True, False, False, True, False, True, False, False]


def test_mismatch_and_open(spark):
    rows = [("allergen", "label", "undeclared milk", ["egg"]), ("allergen", "label", "undeclared milk", ["milk"]), ("allergen", "Salmonella", "undeclared milk", []), ("allergen", None, "undeclared", []), ("microbial", None, "undeclared milk", []), (None, None, None, None)]
    got = column(spark, R.allergen_mismatch(*[F.col(n) for n in "abcd"]), rows, "a string, b string, c string, d array<string>")
    assert got == [True, False, False, False, False, False]
    rows = [("FSIS", "recall", "active", None), ("FSIS", "alert", "active", None), ("FDA", "recall", "closed", "2024-01-09"), ("FDA", "recall", "active", "2024-01-08"), ("FDA", "recall", "active", None), (None, None, None, None)]
    e = R.confirmed_open(F.col("a"), F.col("b"), F.col("c"), F.col("d").cast("date"), F.lit("2024-01-30").cast("timestamp"))
    assert column(spark, e, rows, "a string, b string, c string, d string") == [True, False, True, False, False, False]


def test_report_draft(spark):
    e = R.report_problem(*[F.col(n) for n in ("active", "scope", "states", "retailers", "state", "retailer", "window")], windows=("week", "month"))
    rows = [
        (True, "nationwide", None, None, "OH", None, "week"),
        (False, "nationwide", None, None, "OH", None, "week"),
        (True, "states", [], None, "OH", None, "week"),
        (True, "states", ["IA"], None, "OH", "x", "never"),
        (True, "states", ["OH"], ["a", " "], "OH", " ", "week"),
        (True, "states", ["OH"], ["a"], "OH", "a", None),
        (None, None, None, None, None, None, None),
    ]
    got = column(spark, e, rows, "active boolean, scope string, states array<string>, retailers array<string>, state string, retailer string, window string")
    assert got == [None, "case_not_active", "geography_unusable", "state_not_allowed", "retailer_not_offered", "purchase_window_invalid", "case_not_active"]


def test_hazard_category(spark):
    rows = [
        (["Unreported Allergens"], "Salmonella", False, False),
        (["Product Contamination"], "with Listeria", True, True),
        (["Product Contamination"], "with plastic", True, True),
        (["Product Contamination"], "with anchovy", True, False),
        (["Product Contamination"], "with lead", True, False),
        (["Insanitary Conditions", "Misbranding"], "", True, False),
        (["Processing Defect"], "", False, False),
        (["Misbranding"], "", True, False),
        (["Misbranding", "Import Violation"], "", True, False),
        ([], "", True, False),
        (None, None, None, None),
        (["Other"], "", True, False),
    ]
    got = column(spark, R.hazard_category(*[F.col(n) for n in "abcd"]), rows, "a array<string>, b string, c boolean, d boolean")
    assert got == ["allergen", "microbial_contamination", "foreign_material", "allergen", "unknown", "other_regulatory", "product_integrity", "allergen", "other_regulatory", "allergen", "unknown", "unknown"]

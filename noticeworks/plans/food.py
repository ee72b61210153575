"""Food categories of product texts, and the text that names a product."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import food as W
from noticeworks.operators import food as O
from noticeworks.plans.decided import pick
from noticeworks.session import table

#: Foods of the query with their categories; a fruit, a protein, a staple, and two that take fruits for flavours.
FRUITS = ("apple", "cherry", "peaches", "grapes", "mango")
PROTEINS = (("beef", "meat_poultry"), ("chicken", "meat_poultry"), ("shrimp", "seafood"), ("salmon", "seafood"))
STAPLES = ("rice", "noodles", "pies", "pastry", "tortillas")
SWEETS = (("cookies", "bakery_grains"), ("popcorn", "snacks_sweets"), ("ice cream bars", "dairy_eggs"), ("iced tea", "beverages"))


def _said(spark, sf):
    """A product text a part, in one of the shapes that announcements have."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    fruit, staple = pick(k, *FRUITS), pick(k, *STAPLES)
    protein, sweet = pick(k, *[x for x, _ in PROTEINS]), pick(k, *[x for x, _ in SWEETS])
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    texts = (
        say("Frozen ", protein, " ", staple, " Products"),
        say("Organic ", F.initcap(fruit), ", Whole ", sweet, " 12 oz"),
        say(fruit, " flavored ", sweet, " with ", protein),
        say("Cheese and ", fruit, " ", sweet),
        say(sweet, " and turkey sausage"),
        say(F.upper(sweet), " for baby"),
        say("Vegan ", protein, "-free soup; plant-based ", protein),
        say("Bags containing ", protein, " ", F.col("p_name")),
        say("Multiple items with ", fruit),
        say(F.col("p_name"), " ", F.col("p_type")),
        say("Jelly Handbag and ", protein),
    )
    return p.select("p_partkey", pick(k, *texts, None).alias("said"))


def c15_categories(spark, sf):
    found = O.match(_said(spark, sf), "p_partkey", "said", W.lexicon(spark))
    return found.select(F.col("key").alias("p_partkey"), F.array_join("categories", "|").alias("categories"))


def c15_product_text(spark, sf):
    p, k = _said(spark, sf), F.col("p_partkey")
    title = F.concat(pick(k, "Acme Recalls ", "FSIS Issues Public Health Alert for ", "Acme Note on "), pick(k, "Raw Pork and Beef", "Products", "Soup"), pick(k, " Due to Milk", " Because of It", ""))
    lines = F.when(k % 5 < 4, F.array(F.concat(F.coalesce("said", F.lit("")), F.lit(" | UPC: 1")), F.lit(" | x"), F.lit("Bread")))
    summary = F.when(k % 2 == 0, F.concat(F.lit("News. The beef tamales number "), k.cast("string"), F.lit(" were produced on Monday.")))
    out = p.select("p_partkey", W.product_text(title, F.when(k % 7 == 0, F.col("said")), lines, summary).alias("t"))
    return out.select("p_partkey", "t.text", "t.basis")


QUERIES = {f.__name__: f for f in (c15_categories, c15_product_text)}


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SAID = f"""
WITH p AS (SELECT p_partkey AS k, p_name, p_type, {_list(FRUITS)}[(p_partkey % 5 + 1)::INT] AS fruit, {_list(STAPLES)}[(p_partkey % 5 + 1)::INT] AS staple, {_list(x for x, _ in PROTEINS)}[(p_partkey % 4 + 1)::INT] AS protein,
  {_list(x for x, _ in SWEETS)}[(p_partkey % 4 + 1)::INT] AS sweet, {_list(c for _, c in PROTEINS)}[(p_partkey % 4 + 1)::INT] AS pc, {_list(c for _, c in SWEETS)}[(p_partkey % 4 + 1)::INT] AS sc FROM part),
s AS (SELECT *, CASE k % 12 WHEN 0 THEN 'Frozen ' || protein || ' ' || staple || ' Products' WHEN 1 THEN 'Organic ' || upper(fruit[1]) || substr(fruit, 2) || ', Whole ' || sweet || ' 12 oz' WHEN 2 THEN fruit || ' flavored ' || sweet || ' with ' || protein
  WHEN 3 THEN 'Cheese and ' || fruit || ' ' || sweet WHEN 4 THEN sweet || ' and turkey sausage' WHEN 5 THEN upper(sweet) || ' for baby' WHEN 6 THEN 'Vegan ' || protein || '-free soup; plant-based ' || protein WHEN 7 THEN 'Bags containing ' || protein || ' ' || p_name
  WHEN 8 THEN 'Multiple items with ' || fruit WHEN 9 THEN p_name || ' ' || p_type WHEN 10 THEN 'Jelly Handbag and ' || protein END AS said FROM p)"""

ORACLES = {
    "c15_categories": f"""{_SAID}, c AS (SELECT k, CASE k % 12 WHEN 0 THEN ['prepared_foods'] WHEN 1 THEN [sc] WHEN 2 THEN [sc] WHEN 3 THEN [sc] WHEN 4 THEN [sc, 'meat_poultry'] WHEN 5 THEN ['baby_food_formula'] WHEN 6 THEN ['prepared_foods']
  WHEN 7 THEN [pc] WHEN 8 THEN ['produce'] WHEN 10 THEN [pc] ELSE ['other'] END AS c FROM s)
SELECT k AS p_partkey, array_to_string(list_filter({_list(W.CATEGORIES)}, lambda x: list_contains(c, x)), '|') AS categories FROM c""",
    "c15_product_text": f"""{_SAID}
SELECT k AS p_partkey, CASE WHEN k % 7 = 0 AND said IS NOT NULL THEN said WHEN k % 3 = 0 AND k % 2 = 0 THEN 'beef tamales number ' || k WHEN k % 3 = 0 THEN 'Raw Pork and Beef'
    WHEN k % 5 < 4 THEN CASE WHEN said IS NULL THEN 'Bread' ELSE said || '; Bread' END ELSE CASE k % 3 WHEN 1 THEN 'FSIS Issues Public Health Alert for Products Because of It' ELSE 'Acme Note on Soup' END END AS text,
  CASE WHEN k % 7 = 0 AND said IS NOT NULL THEN 'product_description' WHEN k % 3 = 0 AND k % 2 = 0 THEN 'summary_grammar' WHEN k % 3 = 0 THEN 'title_grammar' WHEN k % 5 < 4 THEN 'product_lines' ELSE 'title_raw' END AS basis FROM s""",
}

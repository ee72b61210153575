"""Allergens, foreign materials and hazards that texts state."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import hazard as H
from noticeworks.plans.decided import pick
from noticeworks.session import table

FIRST = ("milk", "eggs", "tree nuts", "soy", "crustacean shellfish")
SECOND = ("wheat", "sesame", "sulfites", "almonds")
OBJECTS = ("metal", "plastic", "glass", "wood", "rubber", "bone")


def _said(spark, sf):
    """A reason a part: lists of allergens and a material, stated, denied or only mentioned."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    a, b, m = pick(k, *FIRST), pick(k, *SECOND), pick(k, *OBJECTS)
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    texts = (
        say("The ", F.col("p_name"), " may contain undeclared ", a, " (casein, not named), ", b, ", and gluten. Pieces of hard ", m, " were seen."),
        say("The product contains ", a, " and ", b, " (natural), known allergens, in ", F.col("p_name"), " in a ", m, " bowl."),
        say("The reformulated product contains no ", a, ", a known allergen. It is a metal found in soil, in ", m, "-in packs."),
        say("The label does not declare ", F.upper(a), "/", b, "; foreign matter was found, specifically clear ", m, "."),
        say("Made in a facility that processes ", a, ", a known allergen; ", m, " found in ", F.col("p_name")),
        say("Undeclared allergens, including ", b, ", ", a, " and ", a, "s; possible extraneous material"),
        say("Not undeclared ", a, ". It could contain some ", m),
        say("Ingredients: ", a, ", ", b, " with Salmonella and heavy metal pieces"),
    )
    return p.select("p_partkey", pick(k, *texts, None).alias("said"))


def c4_allergens(spark, sf):
    p = _said(spark, sf)
    return p.select("p_partkey", F.array_join(H.allergen_evidence(F.col("said")), "|").alias("allergens"), H.pathogen_or_allergen(F.col("said")).alias("agent"))


def c6_materials(spark, sf):
    return _said(spark, sf).select("p_partkey", H.foreign_material(F.col("said")).alias("f")).select("p_partkey", "f.stated", "f.material")


def c8_agency_hazard(spark, sf):
    p, k = _said(spark, sf), F.col("p_partkey")
    cats = ("Milk, Food &amp; Beverages", "Potential or Undeclared Allergen", "Salmonella", "Potential Foreign Material", "Potential Metal or Chemical Contaminant", "Lead", "Defect", "Mislabeling", "Other", None)
    return p.select("p_partkey", H.agency_hazard(pick(k, *cats), F.col("said")).alias("h")).select("p_partkey", "h.hazard", "h.agent")


QUERIES = {f.__name__: f for f in (c4_allergens, c6_materials, c8_agency_hazard)}


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FOUND = f"""
WITH p AS (SELECT p_partkey AS k, (p_partkey % 9)::INT AS w, {_list(FIRST)}[(p_partkey % 5 + 1)::INT] AS a, {_list(SECOND)}[(p_partkey % 4 + 1)::INT] AS b, {_list(OBJECTS)}[(p_partkey % 6 + 1)::INT] AS m FROM part),
f AS (SELECT *, CASE w WHEN 0 THEN [a, b, 'gluten'] WHEN 1 THEN [a, b] WHEN 5 THEN [b, a] ELSE [] END AS f FROM p),
g AS (SELECT *, CASE WHEN w = 7 THEN 'Salmonella' WHEN len(f) = 1 THEN 'undeclared ' || f[1] WHEN len(f) = 2 THEN 'undeclared ' || f[1] || ' and ' || f[2] WHEN len(f) > 2 THEN 'undeclared ' || f[1] || ', ' || f[2] || ', and ' || f[3] END AS agent,
  CASE w WHEN 0 THEN m WHEN 3 THEN m WHEN 4 THEN m WHEN 6 THEN m END AS material FROM f)"""

ORACLES = {
    "c4_allergens": f"{_FOUND} SELECT k AS p_partkey, array_to_string(f, '|') AS allergens, agent FROM g",
    "c6_materials": f"{_FOUND} SELECT k AS p_partkey, material IS NOT NULL OR w IN (3, 5) AS stated, material FROM g",
    "c8_agency_hazard": f"""{_FOUND}, c AS (SELECT *, (k % 10)::INT AS c FROM g),
l AS (SELECT k, c, w, agent, material, CASE WHEN c = 0 THEN ['milk'] || list_filter(f, lambda v: v <> 'milk') WHEN c = 1 AND len(f) > 0 THEN CASE WHEN list_contains(f, 'tree nuts') THEN list_filter(f, lambda v, i: v NOT IN ('tree nuts', 'almonds') OR i = list_position(list_transform(f, lambda q: q IN ('tree nuts', 'almonds')), true)) ELSE f END
    WHEN c = 1 AND w = 6 THEN [split_part(a, ' ', 1)] ELSE [] END AS n FROM c)
SELECT k AS p_partkey, CASE c WHEN 0 THEN 'allergen' WHEN 1 THEN 'allergen' WHEN 2 THEN 'microbial_contamination' WHEN 3 THEN 'foreign_material' WHEN 4 THEN CASE WHEN material IS NOT NULL OR w IN (3, 5) THEN 'foreign_material' ELSE 'chemical_contamination' END
    WHEN 5 THEN 'chemical_contamination' WHEN 6 THEN 'product_integrity' WHEN 7 THEN 'other_regulatory' ELSE 'unknown' END AS hazard,
  CASE WHEN c = 2 THEN 'Salmonella' WHEN c IN (0, 1) THEN CASE len(n) WHEN 0 THEN agent WHEN 1 THEN 'undeclared ' || n[1] WHEN 2 THEN 'undeclared ' || n[1] || ' and ' || n[2] ELSE 'undeclared ' || n[1] || ', ' || n[2] || ', and ' || n[3] END
    WHEN c IN (8, 9) THEN agent END AS agent FROM l""",
}

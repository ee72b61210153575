"""Allergens, materials and hazards of sentences that were read by hand."""

from pyspark.sql import functions as F

from noticeworks.functions import hazard as H

AGENTS = {
    "The product contains egg, a known allergen, which is not declared on the product label.": "undeclared egg",
    "It may contain chicken salad, which contains egg and milk, known allergens, that are not declared.": "undeclared egg and milk",
    "The dressing packet contains fish (anchovies), a known allergen, which is not declared.": "undeclared fish",
    "In addition, the products may contain soy, a known allergen, and Monosodium Glutamate (MSG).": "undeclared soy",
    "recalled due to an undeclared allergen, specifically peanut residue.": "undeclared peanut",
    "because it may contain undeclared milk, wheat, and soy.": "undeclared milk, wheat, and soy",
    "Allergy Alert on Undeclared Allergen (Milk and Shrimp) in Stewed Kimchi": "undeclared milk and shrimp",
    "Alert on Undeclared Sesame in Steam Buns with Egg Custard Added": "undeclared sesame",
    "undeclared milk (casein) and egg": "undeclared milk and egg",
    "undeclared tree nuts (hazelnut/filbert), wheat (does not contain egg)": "undeclared tree nuts, hazelnut, and wheat",
    "the label does not declare wheat.": "undeclared wheat",
    "This product contains no milk.": None,
    "The reformulated product contains no milk, a known allergen.": None,
    "Ingredients: enriched flour (wheat), sugar, eggs, milk.": None,
    "recalled due to misbranding and an undeclared allergen.": None,
    "Made in a facility that also processes peanuts, a known allergen.": None,
    "may contain undeclared allergens, harmful bacteria, or others": None,
    "contained undeclared allergens, including eggs, milk, and wheat, the agency said.": "undeclared eggs, milk, and wheat",
    "made with undeclared ingredients, including milk": None,
    "not undeclared milk": None,
    "undeclared peanut; it contains peanuts and almonds, known allergens": "undeclared peanut and almonds",
    "recalled for Listeria monocytogenes; the label also omits undeclared milk": "Listeria monocytogenes",
    "": None,
    None: None,
}
MATERIALS = {
    "Due to Possible Foreign Matter Contamination": (True, None), "10-oz. plastic bowl packages": (False, None), "pieces of hard plastic in it": (True, "plastic"), "may be contaminated with glass": (True, "glass"),
    "possible plastic foreign contaminant": (True, "plastic"), "Potential Metal or Chemical Contaminant": (False, None), "glass found in product": (True, "glass"), "Thallium is a naturally occurring metal found in soil": (False, None),
    "heavy metal fragments": (False, None), "extraneous materials, specifically clear flexible and hard plastic": (True, "plastic"), "packages containing a plastic bag": (False, None), "bone-in chicken was found at retail": (False, None),
    "The dressing may contain hard plastic": (True, "plastic"), "wood splinters and metal shavings": (True, "wood"), None: (False, None),
}
HAZARDS = {
    ("Salmonella, Food", "nothing named"): ("microbial_contamination", "Salmonella"), ("Milk, Eggs", "undeclared soybeans and milk"): ("allergen", "undeclared milk, eggs, and soybeans"),
    ("Potential or Undeclared Allergen", "undeclared quinoa and hemp"): ("allergen", "undeclared quinoa and hemp"), ("Potential Metal or Chemical Contaminant", "metal fragments"): ("foreign_material", None),
    ("Potential Metal or Chemical Contaminant", "with lead in it"): ("chemical_contamination", "lead"), ("Defect", ""): ("product_integrity", None), ("A Defect", ""): ("unknown", None), ("Mislabeling", ""): ("other_regulatory", None),
    (None, "undeclared milk"): ("unknown", "undeclared milk"), ("Elevated Levels of Lead", None): ("chemical_contamination", None),
}


def test_allergens(spark):
    df = spark.createDataFrame([(t,) for t in AGENTS], "t string")
    got = [r[0] for r in df.select(H.pathogen_or_allergen(F.col("t"))).collect()]
    assert {t: (g, w) for (t, w), g in zip(AGENTS.items(), got, strict=True) if g != w} == {}


def test_materials(spark):
    df = spark.createDataFrame([(t,) for t in MATERIALS], "t string")
    got = [tuple(r[0]) for r in df.select(H.foreign_material(F.col("t"))).collect()]
    assert {t: (g, w) for (t, w), g in zip(MATERIALS.items(), got, strict=True) if g != w} == {}


def test_hazards(spark):
    df = spark.createDataFrame(list(HAZARDS), "c string, t string")
    got = [tuple(r[0]) for r in df.select(H.agency_hazard(F.col("c"), F.col("t"))).collect()]
    assert {t: (g, w) for (t, w), g in zip(HAZARDS.items(), got, strict=True) if g != w} == {}

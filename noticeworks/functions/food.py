"""Words of food products, and the text of a notice that names its product."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.functions.phrases import any_phrase, says

#: The categories in their order of display, and how many a notice has at most.
CATEGORIES = ("produce", "meat_poultry", "seafood", "dairy_eggs", "prepared_foods", "bakery_grains", "snacks_sweets", "beverages", "pantry_condiments", "baby_food_formula", "supplements", "other")
MOST = 4
#: A small lexicon; callers pass their own for more (see `lexicon`). A term of several words claims them before single words do.
TERMS = {
    "produce": "apple, arugula, baby arugula, baby carrot, banana, berry, broccoli, cabbage, cantaloupe, carrot, cherry, cucumber, grape, kale, kiwi, lemon, lettuce, mango, melon, mushroom, nectarine, onion, orange, pea, peach, pear, pepper, plum, potato, raspberry, salad kit, spinach, sprout, strawberry, tomato, vegetable",
    "meat_poultry": "baby back rib, bacon, beef, bologna, chicken, corn dog, duck, frank, ground beef, ham, hot dog, jerky, lamb, meat, patty, pork, poultry, salami, sausage, turkey, veal",
    "seafood": "crab, crab cake, fish, fish ball, fish stick, lobster, oyster, salmon, salmon burger, shrimp, shrimp cocktail, smoked salmon, tuna",
    "dairy_eggs": "butter, cheese, cottage cheese, cream cheese, dairy, egg, ice cream, ice cream bar, ice cream sandwich, milk, sour cream, yogurt",
    "prepared_foods": "burrito, chef salad, chicken salad, dumpling, enchilada, entree, hummus dip, lasagna, macaroni and cheese, meal, meatball, pizza, potsticker, risotto, salad, samosa, sandwich, slider, soup, spaghetti and meatball, sushi, taco, tamale",
    "bakery_grains": "bagel, biscuit, bread, brownie, bun, cake, cookie, crouton, dough, kringle, muffin, pastry, pie, roll, shortbread cookie, shortcake, tart, tortilla, waffle",
    "snacks_sweets": "bar, candy, chip, chocolate, chocolate bar, chocolate raisin, confection, cracker, cracker sandwich, frozen confection pop, granola bar, gummy, jelly bar, milk chocolate raisin, popcorn, pork rind, pretzel, snack",
    "beverages": "almond milk, coconut milk, coconut water, coffee, drink, fruit punch, iced tea, juice, lemonade, soda, tea, water",
    "pantry_condiments": "almond, apple sauce, base, cereal, flour, granola, honey, lard, noodle, nut, oil, pasta, peanut butter, rice, salsa, sauce, seasoning, spaghetti, spice, sunflower seed, tallow",
    "baby_food_formula": "baby food, infant formula, teething stick",
    "supplements": "capsule, dietary supplement, herbal supplement, supplement, vitamin",
    "": "backpack, cookware, handbag, lotion, saucepan",
}
#: Signs that a word before them is a flavour, or is missing; and words that only describe.
FLAVOUR_MARKS = "flavored flavoured flavor flavour flavors flavours style styled scented infused inspired taste tasting substitute alternative imitation based".split()
NEGATIONS = ("free", "less")
DESCRIPTORS = "frozen fresh raw cooked fully ready to eat rte heat serve whole ground sliced diced organic natural canned dried smoked product products item items multiple various certain assorted bottle bottles pouch pouches pack packs bag bags box boxes can cans carton cartons cup cups jar jars tray trays count ct oz lb lbs original".split()
#: Staples that a protein makes a dish, words that make the name of a dish, categories that take fruits for
#: flavours, that a dish or a following head takes in, proteins, and words of plant-based goods and infants.
DISHABLE = "rice noodle pasta spaghetti macaroni vermicelli ravioli tortellini pie pastry turnover tortilla biscuit".split()
DISH_WORDS = "entree meal dinner bowl kit platter tray".split()
FLAVOURABLE = ("bakery_grains", "snacks_sweets", "dairy_eggs", "seafood", "supplements", "baby_food_formula", "beverages")
COMPONENTS = ("meat_poultry", "seafood", "dairy_eggs", "pantry_condiments")
ABSORBED = ("meat_poultry", "seafood", "dairy_eggs")
PROTEINS = ("meat_poultry", "seafood")
ANALOGUES = ("plant based", "meatless", "meat less", "meat free", "vegan", "veggie", "vegetarian")
INFANTS = ("for baby", "for babies", "for infants", "for infant", "for toddlers")
#: Packages that hold a product, and what begins a list of ingredients or of products.
PACKAGES = "bag package case carton box pouch tray container jar can bottle tub pack clamshell sleeve unit handbag backpack".split()
INGREDIENT_WORDS = ("with", "w/", "containing", "contains", "made with", "made from", "in")
LIST_WORDS = ("such as", "e.g.", "including", "includes")
#: What ends the product in a title, what says nothing, and words of what an agency regulates.
TITLE_ENDS = ("due to", "because", "produced", "containing", "that", "imported from", "imported without", "imported with", "illegally imported from", "illegally imported without", "served", "associated with")
EMPTY = ("product", "products", "item", "items", "ineligible", "various", "certain", "specific", "multiple")
REGULATED = "beef pork poultry chicken turkey meat meats lamb veal goat mutton bison buffalo duck rabbit siluriformes fish catfish egg eggs".split()
LINES = 12


@dataclass(frozen=True)
class Roles:
    """What kinds of words and categories do in a product's name."""

    flavour_marks: tuple[str, ...] = (*FLAVOUR_MARKS, *NEGATIONS)
    descriptors: tuple[str, ...] = tuple(DESCRIPTORS)
    dishable: tuple[str, ...] = tuple(DISHABLE)
    dish_words: tuple[str, ...] = tuple(DISH_WORDS)


def stem(word: Column) -> Column:
    """One form for a word and its plural."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "(?<=.)(?:ies|ie|y)$", "i"), "(?<=sh|ch|x|ss|z|o)es$", ""), "(?<=[^su])s$", "")


def stems(text: Column) -> Column:
    """The words of a plain text, each as its stem, joined by blanks."""
    return F.array_join(F.transform(F.split(text, " "), stem), " ")


def lexicon(spark: SparkSession, terms: dict[str, str] | None = None) -> DataFrame:
    """(gram, width, category): a lexicon from terms by category; the category "" marks what is no food."""
    rows = [(t.strip(), c) for c, names in (terms or TERMS).items() for t in names.split(",")]
    df = spark.createDataFrame(rows, "term string, category string")
    return df.select(stems(F.lower("term")).alias("gram"), F.size(F.split("term", " ")).alias("width"), "category").dropDuplicates(["gram"])


def plain_product(text: Column) -> Column:
    """Lower case, plain quotes, dashes and letters, single blanks."""
    t = F.lower(F.regexp_replace(F.regexp_replace(text, "&(?:rsquo|lsquo|apos|#39);|[‘’]", "'"), "&(?:rdquo|ldquo|quot);|[“”]", '"'))
    t = F.regexp_replace(F.replace(F.replace(t, F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" ")), "[‐-―]", "-")
    return F.trim(F.regexp_replace(F.translate(t, "éèêç", "eeee"), r"\s+", " "))


def title_product(title: Column) -> Column:
    """The product that a title names after `recalls`, or after what an alert is for, up to the reason; empty without one."""
    t = F.regexp_replace(title, r"\s+", " ")
    alert = F.get(F.split(t, r"(?i)^FSIS Issues (?:a )?Public Health Alert (?:for|Regarding) ", 2), 1)
    recalled = F.get(F.split(t, r"(?i)\bRecalls? ", 2), 1)
    found = F.coalesce(alert, recalled, F.lit(""))
    return F.trim(F.get(F.split(found, r"(?i)\s" + any_phrase(TITLE_ENDS), 2), 0))


def product_text(title: Column, description: Column, lines: Column, summary: Column) -> Column:
    """Struct (text, basis): the description; else the title's product, or what the summary says was produced where the title names only
    what is regulated; else the names of the first product lines; else the title (C15)."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = title_product(clean(title))
    words = F.filter(F.split(F.lower(named), "[^A-Za-z]+"), lambda w: (w != "") & ~w.isin("and", "or", *EMPTY, *DESCRIPTORS))
    regulated = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*REGULATED))
    said = F.regexp_extract(clean(summary), r"(?i)(?:^|[.\n]\s*)The\s+([^.\n]{3,200}?)\s+(?:was|were)\s+produced\b", 1)
    firsts = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(F.split(x, r"\|")[0])), lambda x: x != "")
    give = lambda text, basis: F.struct(text.alias("text"), F.lit(basis).alias("basis"))
    return (
        F.when(clean(description) != "", give(clean(description), "product_description"))
        .when((named != "") & ~F.lower(named).isin(*EMPTY) & regulated & (said != ""), give(said, "summary_grammar"))
        .when((named != "") & ~F.lower(named).isin(*EMPTY), give(named, "title_grammar"))
        .when(F.size(firsts) > 0, give(F.array_join(F.slice(firsts, 1, LINES), "; "), "product_lines"))
        .otherwise(give(clean(title), "title_raw"))
    )


def for_infants(plain: Column) -> Column:
    return says(plain, INFANTS)

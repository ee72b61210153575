"""Facts of a case from its tables, lists and prose by precedence, and where it was sold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.geography import STATES, state_of
from noticeworks.functions.text import strip_html
from noticeworks.operators.prose import listed_identifiers, prose_identifiers
from noticeworks.operators.tables import interpret

#: Sources of facts in their order of precedence.
SOURCES = ("table", "list", "prose")
#: Channels that are shown.
CHANNELS = ("retail stores", "grocery stores", "convenience stores", "online", "restaurants", "food service", "wholesale", "direct delivery", "farmers markets", "vending machines")


def outside(html: Column) -> Column:
    """The text of a page outside of its tables and list items."""
    cut = F.regexp_replace(html, r"(?i)</table\s*>", "\u0003")
    cut = F.regexp_replace(cut, "(?i)<table\\b[^\u0003]*\u0003", "\n")
    items = F.regexp_replace(F.regexp_replace(cut, r"(?i)</(?:ul|ol)\s*>", "\u0004"), "(?i)<(?:ul|ol)\\b[^\u0004]*\u0004", "\n")
    return strip_html(F.regexp_replace(F.regexp_replace(items, "[\u0003\u0004]", " "), r"(?i)</?(?:p|div|h[1-6])\b[^>]*>", "\n"))


def case_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, product, concept, value, source, paired_date) of each page of `pages`: the facts that are shown.

    Tables, then lists, then prose: the first of them that names a product says which products there are, and its facts keep
    their product. Facts of a product by a later source, and facts without a product, are the notice's (product null), unless
    the same value of that concept stands with a product already. Each fact counts once, from its first source. Only the prose
    outside of tables and lists is read as prose. The key is the unit: it must be one page's, repeated keys are read together.
    """
    none = lambda t: F.lit(None).cast(t)
    t = interpret(pages, key, html)
    rows = Window.partitionBy("key", "tab", "variant")
    named = F.first_value(F.when(F.col("concept") == "variant", F.col("value")), ignoreNulls=True).over(rows.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tables = t.withColumn("product", named).where("concept <> 'variant'").select("key", F.lit(0).alias("rank"), "product", "concept", "value", "paired_date")
    # a product that only has a name is a fact of its own
    alone = t.where("concept = 'variant'").select("key", F.lit(0).alias("rank"), F.col("value").alias("product"), F.lit("variant").alias("concept"), "value", none("string").alias("paired_date"))
    listed = listed_identifiers(pages, key, html).select("key", F.lit(1).alias("rank"), F.col("owner").alias("product"), "concept", "value", "paired_date")
    told = prose_identifiers(pages.select(F.col(key).alias("key"), outside(F.coalesce(F.col(html), F.lit(""))).alias("_text")), "key", "_text")
    prose = told.select("key", F.lit(2).alias("rank"), F.col("owner").alias("product"), "concept", "value", "paired_date")
    facts = tables.unionByName(alone).unionByName(listed).unionByName(prose)
    page = Window.partitionBy("key")
    stage = F.min(F.when(F.col("product").isNotNull(), F.col("rank"))).over(page)
    facts = facts.withColumn("product", F.when(F.col("rank") == stage, F.col("product")))
    held = F.max(F.col("product").isNotNull()).over(Window.partitionBy("key", "concept", "value"))
    facts = facts.withColumn("held", held).where(F.col("product").isNotNull() | ~F.col("held"))
    best = facts.groupBy("key", "product", "concept", "value").agg(F.min("rank").alias("rank"), F.min_by("paired_date", F.when(F.col("paired_date").isNotNull(), F.col("rank"))).alias("paired_date"))
    return best.select("key", "product", "concept", "value", F.get(F.array(*[F.lit(s) for s in SOURCES]), F.col("rank")).alias("source"), "paired_date")


def place_key(name: Column) -> Column:
    """What names are compared by: letters and digits in lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def sold_at(retailers: Column, platforms: Column, areas: Column, channels: Column, scope: Column, states: Column) -> Column:
    """Struct (retailers, platforms, channels, states, scope) of where a case was sold.

    Retailers count once, by their key, first named first, without those that are a platform, an area, a state of the case, or any state
    by name or code. Channels are those that are shown. The scope is nationwide, states, areas or unspecified. Null lists are empty.
    """
    none = F.array().cast("array<string>")
    some = lambda c: F.filter(F.coalesce(c, none), lambda x: F.coalesce(x, F.lit("")) != "")
    once = lambda c: F.aggregate(c, none, lambda acc, x: F.when(F.exists(acc, lambda y: place_key(y) == place_key(x)), acc).otherwise(F.concat(acc, F.array(x))))
    online, where = once(some(platforms)), some(areas)
    barred = F.transform(F.concat(online, where, some(states), F.array(*[F.lit(s) for s in STATES.values()])), place_key)
    shops = F.filter(once(some(retailers)), lambda x: ~F.array_contains(barred, place_key(x)) & state_of(x).isNull())
    kind = F.when(scope == "nationwide", "nationwide").when(F.size(some(states)) > 0, "states").when(F.size(where) > 0, "areas").otherwise("unspecified")
    shown = F.filter(F.array(*[F.lit(c) for c in CHANNELS]), lambda c: F.array_contains(F.transform(some(channels), lambda x: F.lower(x)), c))
    return F.struct(shops.alias("retailers"), online.alias("platforms"), shown.alias("channels"), F.array_sort(F.array_distinct(some(states))).alias("states"), kind.alias("scope"))

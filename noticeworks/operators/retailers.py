"""Retailers that a stated name stands for, by a catalog of aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a venue that may follow a name, and how many of them go at most.
VENUES = "store stores market markets supermarket supermarkets location locations club clubs retail grocery convenience drugstore drugstores".split()
TAILS = 3
#: Aliases that are broadcast at most; a larger catalog is joined by a shuffle.
BROADCAST_ALIASES = 100_000


def plain_name(raw: Column) -> Column:
    """Lower case; quotes and periods go, `&` is `and`, other signs but hyphens are blanks."""
    low = F.translate(F.lower(raw), "’‘.'", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), "[^a-z0-9 -]", " "), " +", " "))


def catalog(names: DataFrame, retailer: str, name: str, aliases: str) -> DataFrame:
    """(alias, retailer) of every name and alias; an alias of two retailers is an error."""
    rows = names.select(F.col(retailer).alias("retailer"), F.explode(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))).alias("a"))
    one = rows.select(plain_name(F.col("a")).alias("alias"), "retailer").where("alias <> ''").groupBy("alias").agg(F.min("retailer").alias("retailer"), F.count_distinct("retailer").alias("n"))
    clash = F.raise_error(F.concat(F.lit("one alias, two retailers: "), F.col("alias")))
    return one.select(F.when(F.col("n") > 1, clash).otherwise(F.col("alias")).alias("alias"), "retailer")


def _forms(text: Column) -> Column:
    """The readings of a plain name in their order: as it is, without up to TAILS venues at its end, the last without its final s."""
    words = F.split(text, " ")
    # venues at the end, at most TAILS, and never the whole name
    last = F.filter(F.sequence(F.lit(0), F.lit(TAILS)), lambda k: (k < F.size(words)) & F.forall(F.slice(words, F.size(words) - k + 1, k), lambda w: w.isin(*VENUES)))
    forms = F.transform(last, lambda k: F.array_join(F.slice(words, F.lit(1), F.size(words) - k), " "))
    end = F.get(forms, F.size(forms) - 1)
    return F.when(F.endswith(end, F.lit("s")), F.concat(forms, F.array(F.regexp_replace(end, "s$", "")))).otherwise(forms)


def retailers_of(rows: DataFrame, key: str, stated: str, aliases: DataFrame) -> DataFrame:
    """(key, retailers): the catalog's retailers that a stated name means, first named first.

    A list is cut at its commas. A part is looked up whole; if that fails, at each `and` in turn, where both sides must be known.
    A lookup tries the name, then the name without venues at its end, then without a final s. Unknown parts give nothing. `aliases` is
    a `catalog`. Null and blank texts have none; rows may repeat.
    """
    one = rows.select(F.monotonically_increasing_id().alias("_p"), F.col(key).alias("key"), F.split(F.coalesce(F.col(stated), F.lit("")), ",").alias("parts"))
    part = one.select("_p", F.posexplode("parts").alias("part", "raw")).select("_p", "part", F.split(plain_name(F.col("raw")), " ").alias("w"))
    at = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i > 1) & (i < F.size("w")) & (F.get("w", i - 1) == "and")))
    cuts = part.select("_p", "part", "w", F.explode(at).alias("cut"))
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    sides = F.when(F.col("cut") == 0, F.array(join(F.lit(1), F.size("w")))).otherwise(F.array(join(F.lit(1), F.col("cut") - 1), join(F.col("cut") + 1, F.size("w") - F.col("cut"))))
    side = cuts.select("_p", "part", "cut", F.posexplode(sides).alias("side", "t"))
    form = side.select("_p", "part", "cut", "side", F.posexplode(_forms(F.col("t"))).alias("k", "alias"))
    small = aliases.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    hit = form.join(F.broadcast(aliases) if small else aliases, "alias").groupBy("_p", "part", "cut", "side").agg(F.min_by("retailer", "k").alias("retailer"))
    whole = hit.groupBy("_p", "part", "cut").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "retailer"))), lambda x: x["retailer"]).alias("r"))
    whole = whole.where(F.size("r") == F.when(F.col("cut") == 0, 1).otherwise(2)).groupBy("_p", "part").agg(F.min_by("r", "cut").alias("r"))
    found = whole.groupBy("_p").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "r"))), lambda x: x["r"]))).alias("retailers"))
    kind = f"array<{aliases.schema['retailer'].dataType.simpleString()}>"
    return one.select("_p", "key").join(found, "_p", "left").select("key", F.coalesce("retailers", F.array().cast(kind)).alias("retailers"))

"""Food categories of product texts by a lexicon join with longest claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import food as W
from noticeworks.functions.phrases import any_phrase, says

#: Terms of a lexicon that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST_TERMS = 100_000
CONJUNCTIONS = ("and", "&", "+")
HIT = "struct<rank:int,wide:int,i:int,n:int,category:string,gram:string>"


def _segments(plain: Column) -> Column:
    """Struct (named, tail, by_with): the lists of what is named, and of what comes with it or behind a dash, and whether it may stand for the product."""
    packed = F.get(F.split(plain, any_phrase([f"{p}{s} {o}" for p in W.PACKAGES for s in ("", "s", "es") for o in ("containing", "of")]) + " ", 2), 1)
    whole = F.coalesce(packed, plain)
    t, variant = F.get(F.split(whole, r"\s-\s", 2), 0), F.get(F.split(whole, r"\s-\s", 2), 1)
    cut = r"\s(?:" + "|".join(w.replace(" ", r"\s") for w in sorted(W.INGREDIENT_WORDS, key=len, reverse=True)) + r")\s"
    parts = F.split(t, cut, 2)
    lists = lambda x: F.split(x, r"[;,]\s|\s(?:" + "|".join(w.replace(".", r"\.").replace(" ", r"\s") for w in W.LIST_WORDS) + r")\s")
    return F.struct(lists(parts[0]).alias("named"), lists(F.concat_ws(", ", F.get(parts, 1), variant)).alias("tail"), (F.regexp_extract(t, cut, 0).rlike("with") | variant.isNotNull()).alias("by_with"))


def _claimed(hits: Column) -> Column:
    """The hits that stand, in order of place: wider terms first claim their words, then those to the left."""
    free = lambda acc, h: ~F.exists(acc, lambda a: (a["i"] < h["i"] + h["n"]) & (h["i"] < a["i"] + a["n"]))
    kept = F.aggregate(F.array_sort(hits), F.array().cast(f"array<{HIT}>"), lambda acc, h: F.when(free(acc, h), F.concat(acc, F.array(h))).otherwise(acc))
    return F.array_sort(F.transform(kept, lambda h: F.struct(h["i"].alias("i"), h["n"].alias("n"), h["category"].alias("category"), h["gram"].alias("gram"))))


def match(products: DataFrame, key: str, text: str, lexicon: DataFrame, roles: W.Roles | None = None) -> DataFrame:
    """(key, categories) for each row of `products`: its categories in order of display, four at most, `other` if none.

    A text is cut into what is named and what it comes with; named products into list entries, and those at conjunctions. All word
    runs up to the widest term of the `lexicon` (gram, width, category; see `functions.food.lexicon`) are joined to it, so that the
    lexicon may be large. In an entry wider terms claim their words first; a word before a mark of flavour or absence does not count.
    The last term left is the head of its conjunct. A bare component before a later head with words of its own, and a bare
    component beside a dish, are no products. A staple is a dish with a protein in the text; a fruit behind a product is its
    flavour, as are bare fruits in a list of such products; plant-based meat is a prepared food; a name for infants is baby food.
    In a list, entries whose last word is unknown say nothing. If nothing named is known, what it comes with is read.
    Null and blank texts: `other`. Rows may repeat; a text with a non-food term in a conjunct says nothing there.
    """
    roles = roles or W.Roles()
    widest = lexicon.agg(F.coalesce(F.max("width"), F.lit(1))).first()[0]
    p = products.select(F.monotonically_increasing_id().alias("_p"), F.col(key).alias("key"), W.plain_product(F.coalesce(F.col(text), F.lit(""))).alias("plain"))
    cut = p.select("_p", _segments(F.col("plain")).alias("s"))
    tag = lambda c, tail: F.transform(c, lambda x: F.struct(x.alias("text"), F.lit(tail).alias("tail")))
    seg = cut.select("_p", "s.by_with", F.posexplode(F.concat(tag(F.col("s.named"), False), tag(F.col("s.tail"), True))).alias("seg", "x"))
    bare = F.filter(F.transform(F.split(F.translate("x.text", "-()\"", "    "), " +"), lambda w: F.regexp_replace(w, r"^[^a-z0-9$'&+]+|[^a-z0-9$'&+]+$", "")), lambda w: w != "")
    seg = seg.select("_p", "seg", "by_with", F.col("x.tail").alias("tail"), bare.alias("words")).where(F.size("words") > 0)
    seg = seg.withColumn("stems", F.transform("words", W.stem))
    runs = seg.select("_p", "seg", "stems", "words", F.explode(F.sequence(F.lit(0), F.size("stems") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(1), F.lit(widest))).alias("n"))
    runs = runs.where(F.col("i") + F.col("n") <= F.size("stems")).where(~F.coalesce(F.get("words", F.col("i") + F.col("n")), F.lit("")).isin(*roles.flavour_marks))
    runs = runs.select("_p", "seg", "i", "n", F.array_join(F.slice("stems", F.col("i") + 1, F.col("n")), " ").alias("gram"))
    small = lexicon.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hits = runs.join(F.broadcast(lexicon) if small else lexicon, "gram")
    hit = F.struct(F.when(F.col("n") > 1, 0).otherwise(1).alias("rank"), (-F.col("n")).alias("wide"), "i", "n", "category", "gram")
    hits = hits.groupBy("_p", "seg").agg(_claimed(F.collect_list(hit)).alias("hits"))
    s = seg.join(hits, ["_p", "seg"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<i:int,n:int,category:string,gram:string>>")))

    # conjuncts: the words between conjunctions that no term covers
    inside = lambda i: F.exists("hits", lambda h: (h["i"] <= i) & (i < h["i"] + h["n"]))
    ends = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(*CONJUNCTIONS) & ~inside(i))
    s = s.withColumn("ends", F.concat(ends, F.array(F.size("words")))).withColumn("conj", F.transform("ends", lambda e, k: F.struct(F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1).alias("a"), e.alias("z"))))
    described = lambda i: F.get("words", i).isin(*roles.descriptors) | F.get("words", i).rlike(r"\d")

    def read(c: Column) -> Column:
        own = F.filter("hits", lambda h: (h["i"] >= c["a"]) & (h["i"] < c["z"]))

        def of(hs: Column) -> Column:
            head = F.get(hs, F.size(hs) - 1)
            food = F.forall(hs, lambda h: h["category"] != "")
            at = F.when(c["z"] > c["a"], F.sequence(c["a"], c["z"] - 1)).otherwise(F.array().cast("array<int>"))
            covered = lambda i: F.exists(hs, lambda h: (h["i"] <= i) & (i < h["i"] + h["n"]))
            told = F.filter(at, lambda i: ~described(i))
            before = F.filter(at, lambda i: (i < head["i"]) & ~described(i))
            return F.struct(
                F.when(food, head["category"]).alias("category"),
                F.coalesce(head["gram"], F.lit("")).alias("gram"),
                F.transform(hs, lambda h: h["category"]).alias("all"),
                F.coalesce(F.size(before) > 0, F.lit(False)).alias("modified"),
                F.forall(told, covered).alias("bare"),
                F.coalesce(covered(F.get(told, F.size(told) - 1)), F.lit(True)).alias("ends_known"),
            )

        return F.transform(F.array(own), of)[0]

    s = s.withColumn("read", F.transform("conj", read))
    n = F.sequence(F.lit(0), F.size("read") - 1)
    target = F.array_max(F.filter(n, lambda k: F.get("read", k)["category"].isNotNull() & F.get("read", k)["modified"]))
    dish = F.array_min(F.filter(n, lambda k: F.get("read", k)["category"] == "prepared_foods"))
    s = s.withColumn("target", target).withColumn("dish", dish)
    to = F.get("read", F.col("target"))["category"]

    def stays(r: Column, k: Column) -> Column:
        fruit = (r["category"] == "produce") & ((to == "prepared_foods") | to.isin(*W.FLAVOURABLE))
        modifies = (k < F.col("target")) & r["bare"] & (r["category"].isin(*W.COMPONENTS) | fruit)
        absorbed = (k != F.col("dish")) & r["category"].isin(*W.ABSORBED) & (r["bare"] | r["category"].isin(*W.PROTEINS))
        return r["category"].isNotNull() & ~F.coalesce(modifies, F.lit(False)) & ~F.coalesce(absorbed, F.lit(False))

    s = s.withColumn("kept", F.filter("read", stays)).withColumn("protein", F.exists("hits", lambda h: h["category"].isin(*W.PROTEINS)))
    tails = F.transform("kept", lambda r: F.struct(r["category"].alias("category"), r["gram"].alias("gram"), r["all"].alias("all"), r["ends_known"].alias("ends_known"), F.col("tail").alias("tail"), F.col("by_with").alias("by_with")))
    one = s.groupBy("_p").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg", tails.alias("k")))), lambda x: x["k"])).alias("found"), F.bool_or("protein").alias("protein"))
    one = p.join(one, "_p", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<category:string,gram:string,all:array<string>,ends_known:boolean,tail:boolean,by_with:boolean>>")))
    named, tail = F.filter("found", lambda r: ~r["tail"]), F.filter("found", lambda r: r["tail"] & r["by_with"])
    last_tail = F.get(tail, F.size(tail) - 1)
    dish_tail = (last_tail["category"] == "prepared_foods") & F.substring_index(last_tail["gram"], " ", -1).isin(*roles.dish_words)
    one = one.withColumn("use", F.when(F.coalesce(dish_tail, F.lit(False)), F.array(last_tail)).when(F.size(named) > 0, named).otherwise(tail))
    one = one.withColumn("use", F.filter("use", lambda r: r["ends_known"] | (F.size("use") <= 1)))
    analogue = says(F.translate("plain", "-", " "), W.ANALOGUES)
    one = one.withColumn("analogue", analogue)

    def category(r: Column) -> Column:
        others = F.filter(r["all"], lambda c: c != "produce")
        flavoured = (r["category"] == "produce") & ~F.contains(r["gram"], F.lit(" ")) & F.get(others, F.size(others) - 1).isin(*W.FLAVOURABLE)
        dish_head = F.array_contains(F.transform(F.array(*[F.lit(w) for w in roles.dishable]), W.stem), r["gram"]) & F.coalesce(F.col("protein"), F.lit(False))
        return F.when(dish_head, "prepared_foods").when(flavoured, F.get(others, F.size(others) - 1)).when(F.col("analogue") & r["category"].isin(*W.PROTEINS), "prepared_foods").otherwise(r["category"])

    one = one.withColumn("said", F.transform("use", lambda r: F.struct(category(r).alias("category"), F.forall(r["all"], lambda c: c == "produce").alias("fruit"))))
    listed = F.exists("said", lambda r: r["category"].isin(*W.FLAVOURABLE))
    left = F.filter("said", lambda r: ~(listed & r["fruit"] & (r["category"] == "produce")))
    infants = (F.size(left) > 0) & W.for_infants(F.col("plain"))
    chosen = F.when(infants, F.array(F.lit("baby_food_formula"))).otherwise(F.transform(left, lambda r: r["category"]))
    ordered = F.slice(F.filter(F.array(*[F.lit(c) for c in W.CATEGORIES]), lambda c: F.array_contains(chosen, c)), 1, W.MOST)
    return one.select("key", F.when(F.size(ordered) > 0, ordered).otherwise(F.array(F.lit("other"))).alias("categories"))

"""Where a notice's prose says that a product went, and the geography that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.geography import states_in
from noticeworks.functions.phrases import any_phrase, chain, each, says
from noticeworks.functions.text import sentences

#: Verbs of distribution with the words that name a place behind them and the characters between at most.
TO = ("to", "at", "in", "into", "through", "throughout", "across", "within", "via")
FRAMES = (
    (("distributed", "distributes", "distributing", "distribution"), 80, TO[:8]),
    (("distributed", "distribution", "distributor", "distributors", "sold", "shipped", "available"), 60, ("nationwide",)),
    (("sold",), 80, ("at", "in", "to", "through", "throughout", "via", "within", "across")),
    (("ship", "shipped", "shipping", "shipment", "shipments"), 80, ("to", "in", "into", "through", "throughout", "across", "within")),
    (("delivered", "delivery", "deliveries"), 80, ("to", "in", "throughout", "across")),
    (("available",), 80, ("at", "in", "through", "via")),
    (("recall extends", "recall applies"), 24, ("to",)),
)
STATED = ("sent to", "sent out to", "nationwide distribution", "states involved", *each(("can", "could", "may", "might", "will", "would"), "be found", ("at", "in")))
COHORT = each(("has", "have"), ("", "store"), ("location", "locations"), "in") + each(("subscribers", "customers", "members", "stores", "locations"), ("are", "is"), "located in")
NATIONWIDE = ("nationwide", "nationally", "across the country", "across the united states", "all 50 states")
#: What a sentence about something else says.
SHELVES = each(("frozen", "refrigerated", "dairy", "deli", "produce", "bakery", "meat", "freezer", "cooler", "chilled"), ("section", "case", "aisle", "department", "counter", "display"))
CONTACT = ("call", "contact", "questions")
INVESTIGATION = ("sample", "samples", "sampled", "sampling", "tested positive", "testing positive", "test positive", "test result", "test results", "laboratory", "laboratories", "inspection agency", *each("department of", ("agriculture", "health", "public health")))
ACTION = ("return it to", "return them to", "return the product", "return to the place of purchase", "throw away", "throw it away", "discard", "refund", "urged not to consume", "should not consume")
NEGATED = (
    *each(("are", "is", "was", "were", "has", "have"), "not", ("", "been"), ("impacted", "affected", "included", "involved", "distributed", "sold", "shipped", "part")),
    *each("does not", ("apply", "include", "affect", "impact")),
    *each("no", ("product", "products"), ("were", "was", "are", "is"), ("impacted", "affected", "distributed", "sold", "shipped")),
)
EXCEPT = ("except for", "except", "excluding", "other than", "apart from")
#: Sites that a product comes from, and how their clause begins.
SITES = ("farm", "farms", "facility", "facilities", "plant", "plants", "warehouse", "warehouses", "manufacturer", "processing", "production", "supplier", "suppliers", "kitchen", "kitchens")
MADE = each(("grown", "produced", "packed", "processed", "manufactured", "supplied"), "by")
#: Fixed value: units that a declared list may go on for.
LIST_UNITS = 40


def affirms(s: Column) -> Column:
    """The sentence says that a product went somewhere."""
    c = F.regexp_replace(s, "[;:]", ".")  # a frame does not reach past either
    said = says(s, STATED) | F.coalesce(s.rlike(r"(?i)\bdistribut(?:ed|es|ing|ion)\s*[:(]"), F.lit(False))
    for verbs, gap, places in FRAMES:
        said = said | chain(c, verbs, gap, places)
    return said


def destinations(s: Column) -> Column:
    """The sentence without its dateline, the seat of a firm, and the sites where something was made or shipped from."""
    seat = r"[A-Z][A-Za-z.' -]{1,30},\s*[A-Z][A-Za-z.]{1,20}"
    s = F.regexp_replace(s, rf"^\({seat}\)\s*|^{seat}\s*\([^)]*\)\s*[–—-]*\s*|^(?:\d{{1,2}}/\d{{1,2}}/\d{{2,4}},\s*)?{seat}(?:,?\s*[A-Z][a-z]{{2,8}}\.?\s+\d{{1,2}},?\s*\d{{4}})?\s*[–—-]{{1,3}}\s", " ")
    s = F.regexp_replace(s, rf"(?i)\bof\s+(?-i:{seat}),?\s+(?=(?:is|are|has|have|which)\b)", " ")
    s = F.regexp_replace(s, r"(?i)\bheadquarter\w*\b[^.;]{0,60}", " ")
    s = F.regexp_replace(s, "(?i)" + any_phrase(MADE) + r"(?:(?!\b(?:distribut|sold|shipped|sent|deliver))[^.;]){0,130}" + any_phrase(("farm", "farms", "facility", "facilities", "plant", "plants")), " ")
    return F.regexp_replace(s, r"(?i)\bfrom\s+(?:(?:its|our|their|the|a)\s+)?" + any_phrase(SITES) + "[^,.;]{0,60}", " ")


def distribution_prose(notices: DataFrame, key: str, text: str) -> DataFrame:
    """(key, states, excluded, sentences, nationwide) of each row of `notices`.

    A sentence that denies puts its states among the excluded. One about shelves, contacts, tests or what to do says nothing. One that
    says where a product went adds its states, those behind an exception to the excluded; so does one about stores and customers in
    a paragraph with such a sentence. A sentence that ends as the head of a list is gone on from, as long as each next one
    names states and says nothing else. `nationwide` is the first sentence that says so. Null and silent texts have none.
    """
    one = notices.select(F.monotonically_increasing_id().alias("_p"), F.col(key).alias("key"), F.split(F.coalesce(F.col(text), F.lit("")), r"\n+").alias("lines"))
    # a silent text keeps its row, so that nothing is joined back
    units = one.select("_p", "key", F.posexplode("lines").alias("line", "t")).select("_p", "key", "line", F.posexplode_outer(sentences(F.col("t"))).alias("n", "s"))
    s = F.col("s")
    units = units.withColumn("negated", says(s, NEGATED))
    vetoed = says(s, (*SHELVES, *CONTACT, *INVESTIGATION, *ACTION)) | s.rlike(r"(?i)@|\b\d{3}-\d{3}-\d{4}\b|\baisle\s+\d")
    units = units.withColumn("vetoed", vetoed).withColumn("primary", affirms(s) & ~F.col("vetoed") & ~F.col("negated"))
    units = units.withColumn("halves", F.split(s, "(?i)" + any_phrase(EXCEPT), 2))
    first, behind = F.get("halves", 0), F.get("halves", 1)
    units = units.withColumn("named", states_in(destinations(first))).withColumn("other", F.when(F.col("negated"), states_in(s)).otherwise(F.coalesce(states_in(behind), F.array().cast("array<string>"))))
    units = units.withColumn("heads", F.col("primary") & (says(s, ("the following",)) | s.rlike(r":\s*$"))).withColumn("everywhere", says(first, NATIONWIDE)).withColumn("store", says(s, COHORT)).drop("halves").repartition("_p")
    told = F.bool_or("primary").over(Window.partitionBy("_p", "line"))
    units = units.withColumn("cohort", F.col("store") & told & ~F.col("vetoed") & ~F.col("negated") & ~F.col("primary"))
    by = units.groupBy("_p").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.when(s.isNotNull(), F.struct("line", "n", "s", "negated", "vetoed", "primary", "cohort", "named", "other", "heads", "everywhere")))).alias("u"))
    none = F.array().cast("array<string>")
    names = ("states", "excluded", "sentences", "nationwide", "open")
    make = lambda a, **new: F.struct(*[new.get(n, a[n]).alias(n) for n in names])

    def step(a: Column, u: Column) -> Column:
        listed = (a["open"] > 0) & (F.size(u["named"]) > 0)
        speaks = u["primary"] | u["cohort"]
        taken = make(
            a,
            states=F.concat(a["states"], u["named"]),
            excluded=F.concat(a["excluded"], u["other"]),
            sentences=F.when(speaks, F.concat(a["sentences"], F.array(u["s"]))).otherwise(a["sentences"]),
            nationwide=F.coalesce(a["nationwide"], F.when(u["everywhere"], u["s"])),
            open=F.when(u["heads"], F.lit(LIST_UNITS)).otherwise(F.when(listed, a["open"] - 1).otherwise(0)),
        )
        shut = make(a, open=F.lit(0))
        return F.when(u["negated"], make(a, excluded=F.concat(a["excluded"], u["other"]), open=F.lit(0))).when(u["vetoed"], shut).when(speaks | listed, taken).otherwise(shut)

    start = F.struct(none.alias("states"), none.alias("excluded"), none.alias("sentences"), F.lit(None).cast("string").alias("nationwide"), F.lit(0).alias("open"))
    out = by.select("key", F.aggregate("u", start, step).alias("r"))
    tidy = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    return out.select("key", tidy(F.col("r.states")).alias("states"), tidy(F.col("r.excluded")).alias("excluded"), F.coalesce("r.sentences", none).alias("sentences"), F.col("r.nationwide").alias("nationwide"))


def geography(scope: Column, states: Column, said: Column, tables: Column) -> Column:
    """Struct (scope, states, added, removed, contradicted) of a carried geography after its prose and tables.

    Nationwide stays. An unknown scope becomes nationwide if the prose says so and no table names states. Otherwise the carried
    states that the prose excludes go, and the states that prose or tables affirm and the prose does not exclude are added; states that
    are both are contradicted. None left: unknown. `said` is a struct of states, excluded and nationwide; null tables have none.
    """
    none = F.array().cast("array<string>")
    own, by_table = F.coalesce(states, none), F.coalesce(tables, none)
    affirmed, excluded = F.array_union(F.coalesce(said["states"], none), by_table), F.coalesce(said["excluded"], none)
    kept = F.array_except(own, excluded)
    after = F.array_sort(F.array_union(kept, F.array_except(affirmed, excluded)))
    give = lambda s, new, more, less, both: F.struct(s.alias("scope"), new.alias("states"), more.alias("added"), less.alias("removed"), both.alias("contradicted"))
    everywhere = (scope == "unknown") & (F.size(by_table) == 0) & said["nationwide"].isNotNull()
    found = give(F.when(F.size(after) > 0, "states").otherwise("unknown"), after, F.array_except(after, own), F.array_intersect(own, excluded), F.array_sort(F.array_intersect(affirmed, excluded)))
    return F.when(scope == "nationwide", give(scope, own, none, none, none)).when(F.coalesce(everywhere, F.lit(False)), give(F.lit("nationwide"), none, none, none, none)).otherwise(found)

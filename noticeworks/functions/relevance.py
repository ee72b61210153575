"""Hazard words, personal relevance and report rules as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pathogens, the first found wins.
PATHOGENS = (
    "Listeria monocytogenes",
    "Listeria",
    "Salmonella",
    "E. coli O157:H7",
    "E. coli",
    "Clostridium botulinum",
    "Campylobacter",
    "Cyclospora",
    "Hepatitis A",
    "Norovirus",
)
#: Agents that a bare mention states, and those that need a statement of contamination.
CHEMICALS = ("lead", "cadmium", "arsenic", "mercury", "Cesium-137")
GATED_CHEMICALS = ("asbestos", "thallium")
#: Family of allergens -> words for it.
ALLERGEN_FAMILIES = {
    "milk": ("milk", "dairy"),
    "egg": ("egg", "eggs"),
    "peanut": ("peanut", "peanuts"),
    "soy": ("soy", "soybean", "soybeans"),
    "wheat": ("wheat",),
    "gluten": ("gluten",),
    "sesame": ("sesame",),
    "fish": ("fish",),
    "shellfish": ("shellfish", "shrimp", "crustacean shellfish"),
    "tree nuts": ("tree nut", "tree nuts", "almond", "almonds", "cashew", "cashews", "pistachio", "pistachios", "hazelnut", "hazelnuts", "walnut", "walnuts", "pecan", "pecans"),
    "sulfites": ("sulfite", "sulfites"),
}
#: Food categories in display order.
CATEGORIES = ("produce", "meat_poultry", "seafood", "dairy_eggs", "prepared_foods", "bakery_grains", "snacks_sweets", "beverages", "pantry_condiments", "baby_food_formula", "supplements", "other")


def first_named(text: Column, names: tuple[str, ...]) -> Column:
    """The first of `names`, in their order, that `text` has as whole words in any case; null without one."""
    return F.coalesce(*[F.when(text.rlike(rf"(?i)\b{re.escape(n)}\b"), n) for n in names])


def pathogen(text: Column) -> Column:
    return first_named(text, PATHOGENS)


#: Word pairs that announce a contaminant a few words on, and words that part two things named.
ANNOUNCING = ("contaminated with", "contaminated by", "contamination with", "contamination by", *(f"{may} {has}" for may in ("may", "might", "could", "possibly") for has in ("contain", "contains")))
PARTING = ("or", "and")
#: Words that may stand between the announcement and the agent, and between the agent and its contamination.
WORDS_AFTER, WORDS_BEFORE = 3, 2


def _announced(words: Column, agent: str) -> Column:
    """Whether the words of one clause call `agent` the contaminant: an announcing pair shortly before it, or a form of `contaminate` shortly after it and nothing else named between."""

    def at(i: Column) -> Column:
        lead = F.slice(words, F.greatest(i - WORDS_AFTER - 2, F.lit(0)) + 1, F.least(i, F.lit(WORDS_AFTER + 2)))
        pairs = F.zip_with(lead, F.slice(lead, F.lit(2), F.greatest(F.size(lead) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        after = F.slice(words, i + 2, F.lit(WORDS_BEFORE + 1))
        first = F.array_position(F.transform(after, lambda w: F.when(w.startswith("contamin"), "c").when(w.isin(*PARTING), "p").otherwise("")), F.lit("c")).cast("int")
        open_ = ~F.arrays_overlap(F.slice(after, F.lit(1), F.greatest(first - 1, F.lit(0))), F.array(*[F.lit(w) for w in PARTING]))
        return F.arrays_overlap(pairs, F.array(*[F.lit(p) for p in ANNOUNCING])) | ((first > 0) & open_)

    places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.get(words, i) == agent)
    return F.exists(places, lambda i: F.coalesce(at(i), F.lit(False)))


def chemical_agent(text: Column) -> Column:
    """A named chemical, else a gated one that a clause of the text calls the contaminant."""
    clauses = F.transform(F.split(F.lower(text), r"[^a-z0-9_\s,-]+"), lambda c: F.regexp_extract_all(c, F.lit(r"[a-z0-9_-]+"), F.lit(0)))
    stated = lambda agent: F.exists(clauses, lambda words: _announced(words, agent))
    return F.coalesce(first_named(text, CHEMICALS), *[F.when(stated(a), a) for a in GATED_CHEMICALS])


def allergen_tokens(agent: Column) -> Column:
    """Sorted families named after `undeclared`; empty for any other statement, for null and for unknown words.

    The words are a list whose items end at a comma, a slash, `and` or `or`; an item counts if all of it is a word of a family.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(agent), "[,/]", " | ")), r"\s+")
    stops = F.transform(words, lambda w: F.when(w.isin(*PARTING), "|").otherwise(w))
    items = F.transform(F.split(F.array_join(F.slice(stops, F.lit(2), F.greatest(F.size(stops) - 1, F.lit(0))), " "), "[|]"), lambda w: F.rtrim(F.trim(w), F.lit(". ")))
    families = [F.when(F.arrays_overlap(items, F.array(*[F.lit(w) for w in ws])), name) for name, ws in sorted(ALLERGEN_FAMILIES.items())]
    return F.coalesce(F.when(words[0] == "undeclared", F.array_compact(F.array(*families))), F.array().cast("array<string>"))


def in_display_order(categories: Column, order: tuple[str, ...] = CATEGORIES) -> Column:
    """The known categories, once each, in display order; null is empty."""
    return F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.coalesce(F.array_contains(categories, c), F.lit(False)))


def resolve_illness(kinds: Column) -> Column:
    """One status of statuses, newest first (C11).

    The newest that is not `unknown` holds, but `explicit_none` over an older report is `reported_unspecified`;
    without any, unknown.
    """
    said = F.filter(kinds, lambda k: F.coalesce(k != "unknown", F.lit(False)))
    newest = F.get(said, F.lit(0))
    denied = (newest == "explicit_none") & F.exists(said, lambda k: k != "explicit_none")
    return F.when(F.coalesce(denied, F.lit(False)), "reported_unspecified").otherwise(F.coalesce(newest, F.lit("unknown")))


def newest_illness(kind: Column, order: Column) -> tuple[Column, Column]:
    """Two aggregates for `settled_illness`: the newest kind that says something, by `order`, and the number of reports (C11)."""
    said = kind != "unknown"
    return F.max_by(kind, F.when(said, order)), F.count_if(said & (kind != "explicit_none"))


def settled_illness(newest: Column, reports: Column) -> Column:
    """The status that `resolve_illness` gives, from the aggregates of `newest_illness`: nothing is listed (C11)."""
    return F.when((newest == "explicit_none") & (reports > 0), "reported_unspecified").otherwise(F.coalesce(newest, F.lit("unknown")))


def geographic(scope: Column, states: Column, chosen: Column) -> Column:
    """matches, does_not_match or unknown: nationwide matches all; an unknown scope or no choice is unknown (C17)."""
    hit = F.coalesce(F.arrays_overlap(states, chosen), F.lit(False))
    return F.when(scope == "nationwide", "matches").when(F.coalesce(scope, F.lit("unknown")) == "unknown", "unknown").when(F.coalesce(F.size(chosen), F.lit(0)) <= 0, "unknown").when(hit, "matches").otherwise("does_not_match")


def affects(scope: Column, states: Column, chosen: Column, signal: Column, mismatch: Column) -> Column:
    """Whether a case affects a person (C17).

    An exclusion by place or a known allergen mismatch is final; else a chosen state that matches is enough, or any
    allergen or retailer signal.
    """
    geo = geographic(scope, states, chosen)
    by_place = (geo == "matches") & (F.coalesce(F.size(chosen), F.lit(0)) > 0)
    return (geo != "does_not_match") & ~F.coalesce(mismatch, F.lit(False)) & (by_place | F.coalesce(signal, F.lit(False)))


def allergen_mismatch(category: Column, reason: Column, agent: Column, selected: Column, other_labels: tuple[str, ...] = ()) -> Column:
    """An allergen-only case, its families known, none of them selected."""
    text = F.concat_ws("\n", F.coalesce(reason, F.lit("")), F.coalesce(agent, F.lit("")))
    only = (category == "allergen") & pathogen(text).isNull()
    for label in other_labels:
        only = only & ~F.contains(F.coalesce(reason, F.lit("")), F.lit(label))
    families = allergen_tokens(agent)
    return F.coalesce(only & (F.size(families) > 0) & ~F.coalesce(F.arrays_overlap(families, selected), F.lit(False)), F.lit(False))


def confirmed_open(agency: Column, kind: Column, state: Column, as_of: Column, now: Column, days: int = 21) -> Column:
    """An active recall of FSIS, or FDA evidence of at most `days` days; null evidence is none (C20)."""
    fresh = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(as_of.cast("timestamp")) <= days * 86400, F.lit(False))
    return F.coalesce(((agency == "FSIS") & (kind == "recall") & (state == "active")) | ((agency == "FDA") & fresh), F.lit(False))


def report_problem(active: Column, scope: Column, states: Column, retailers: Column, state: Column, retailer: Column, window: Column, windows: tuple[str, ...]) -> Column:
    """The first rule that a shopper's draft breaks, null if none: case, geography, state, retailer, window."""
    has = lambda a, x: F.coalesce(F.array_contains(a, x), F.lit(False))
    usable = (scope == "nationwide") | ((scope == "states") & (F.coalesce(F.size(states), F.lit(0)) > 0))
    return F.coalesce(
        F.when(~F.coalesce(active, F.lit(False)), "case_not_active"),
        F.when(~F.coalesce(usable, F.lit(False)), "geography_unusable"),
        F.when((scope == "states") & ~has(states, state), "state_not_allowed"),
        F.when(retailer.isNotNull() & ~has(F.filter(retailers, lambda r: F.trim(r) != ""), retailer), "retailer_not_offered"),
        F.when(~F.coalesce(window.isin(*windows), F.lit(False)), "purchase_window_invalid"),
    )


#: Official reasons, the evidence that a row asks for besides, and the hazard; the first row that holds decides.
#: Reasons: any of them; none: the notice states no reason. Evidence: all of it; `-` before a name: not so.
HAZARD_TABLE = (
    (("Unreported Allergens",), (), "allergen"),
    (("Product Contamination",), ("pathogen",), "microbial_contamination"),
    (("Product Contamination",), ("foreign",), "foreign_material"),
    (("Product Contamination",), ("allergen", "-chemical"), "allergen"),
    (("Product Contamination",), (), "unknown"),
    (("Insanitary Conditions",), (), "other_regulatory"),
    (("Processing Defect", "Unfit for Human Consumption"), (), "product_integrity"),
    (("Misbranding", "Mislabeling"), ("labels_only", "allergen"), "allergen"),
    (("Misbranding", "Mislabeling", "Import Violation", "Produced Without Benefit of Inspection"), (), "other_regulatory"),
    ((), ("allergen",), "allergen"),
)
#: Reasons that name a label and nothing else.
LABEL_REASONS = ("Misbranding", "Mislabeling")


def hazard_category(reasons: Column, text: Column, undeclared: Column, foreign: Column) -> Column:
    """Hazard of a notice by HAZARD_TABLE, unknown where no row holds.

    `undeclared` and `foreign`: whether the text states an undeclared allergen, and foreign material; null is false.
    """
    why = F.coalesce(reasons, F.array().cast("array<string>"))
    named = lambda names: F.array(*[F.lit(n) for n in names])
    evidence = {
        "pathogen": pathogen(text).isNotNull(),
        "chemical": chemical_agent(text).isNotNull(),
        "allergen": F.coalesce(undeclared, F.lit(False)),
        "foreign": F.coalesce(foreign, F.lit(False)),
        "labels_only": F.size(F.array_except(why, named(LABEL_REASONS))) == 0,
    }
    out = F.lit("unknown")
    for names, asked, hazard in reversed(HAZARD_TABLE):
        holds = F.arrays_overlap(why, named(names)) if names else F.size(why) == 0
        for a in asked:
            holds = holds & (~evidence[a[1:]] if a.startswith("-") else evidence[a])
        out = F.when(holds, hazard).otherwise(out)
    return out

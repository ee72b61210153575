"""Allergens and foreign materials that a text states as the reason of a notice, and an agency's hazard."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.phrases import any_phrase, beside, chain, each, says
from noticeworks.functions.relevance import ALLERGEN_FAMILIES, _announced, chemical_agent, pathogen
from noticeworks.functions.text import decode_entities

WORDS = tuple(w for ws in ALLERGEN_FAMILIES.values() for w in ws)
#: What may stand between the items of a list, words that govern a list of allergens, and words that deny.
CONNECTORS = (",", "and", "or", "and/or", "&", "specifically")
GOVERNORS = ("allergen", "allergens")
DENIALS = ("no", "not", "without")
#: Characters of a list after its trigger, and of a clause before `known allergen`.
LIST_CHARS, CLAUSE_CHARS = 100, 160
SHARED_LINES = ("facilit", "equipment", "processes", "processed in", "processed on", "shared")

#: Materials, the shapes of what is found, and the agency's words for it in general.
MATERIALS = ("metal", "plastic", "glass", "wood", "rubber", "bone")
SHAPES = tuple(w + s for w in "piece fragment shard shaving sliver particle chip bit chunk splinter flake speck strand filament".split() for s in ("", "s"))
GENERIC = each(("foreign", "extraneous"), ("material", "materials", "matter", "matters", "object", "objects", "substance", "substances", "contaminant", "contaminants", "body", "bodies"))

#: Words of an agency's categories that give the hazard, tried in this order after allergens.
MICROBIAL = ("salmonella", "listeria", "e. coli", "e.coli", "botulism", "microbial contamination", "pathogenic microorganism", "potential foodborne illness", "bacteria", "mold", "insufficient pasteurization", "potential lack of sterility", "hepatitis", "cyclospora", "norovirus")
ALLERGEN_TOKENS = ("milk", "eggs", "fish", "crustacean shellfish", "tree nuts", "peanuts", "wheat", "soybean", "sesame", "sulfites", "gluten")
GENERIC_ALLERGEN = "potential or undeclared allergen"
CHEMICAL = ("pesticide", "radionuclides", "impurity", "elevated levels")
INTEGRITY = ("packaging defect", "potential packaging issue", "choking threats", "discoloration")
REGULATORY = ("mislabeling", "incorrect instructions", "unapproved", "prohibited ingredient", "ingredient level")

_STATE = "struct<found:array<string>,inner:array<string>,deep:boolean,bad:boolean,governed:boolean,done:boolean>"


def _tokens(phrase: Column) -> Column:
    """Words and signs of a phrase; words of two parts that name one allergen are one token."""
    low = F.lower(phrase)
    for pair in sorted((w for w in WORDS if " " in w), key=len, reverse=True):
        low = F.regexp_replace(low, rf"\b{pair.replace(' ', ' +')}\b", pair.replace(" ", "_"))
    return F.regexp_extract_all(low, F.lit(r"[a-z_]+(?:/[a-z_]+)?|[,()&]"), F.lit(0))


def _known(t: Column) -> Column:
    return t.isin(*[w.replace(" ", "_") for w in WORDS])


def _walk(tokens: Column, back: bool = False) -> Column:
    """The allergens of a list, in order: items joined by connectors, until another word ends it.

    What stands in parentheses only adds to the word before it: allergens in it count, other words in it end nothing, and a denial
    in it drops it. `including` goes on only in a list that `allergen` governs. From behind (`back`), a denial at the front
    of the list drops all of it.
    """
    opens, closes = (")", "(") if back else ("(", ")")
    make = lambda a, **new: F.struct(*[new.get(k, a[k]).alias(k) for k in ("found", "inner", "deep", "bad", "governed", "done")])
    none, yes, no = F.array().cast("array<string>"), F.lit(True), F.lit(False)

    def close(a: Column) -> Column:
        return make(a, found=F.when(a["bad"], a["found"]).otherwise(F.concat(a["found"], a["inner"])), inner=none, deep=no, bad=no)

    def step(a: Column, t: Column) -> Column:
        halves = F.filter(F.split(t, "/"), _known)
        inside = make(a, inner=F.concat(a["inner"], halves), bad=a["bad"] | t.isin(*DENIALS, "free"))
        held = t.isin(*CONNECTORS) | t.isin(*GOVERNORS) | ((t == "including") & a["governed"] & F.lit(not back))
        other = make(a, found=F.when(t.isin(*DENIALS) & F.lit(back), none).otherwise(a["found"]), done=yes)
        return (
            F.when(a["done"], a)
            .when(a["deep"] & (t == closes), close(a))
            .when(a["deep"], inside)
            .when(t == opens, make(a, deep=yes))
            .when(_known(t), make(a, found=F.concat(a["found"], F.array(t))))
            .when(held, make(a, governed=a["governed"] | t.isin(*GOVERNORS)))
            .otherwise(other)
        )

    start = F.struct(none.alias("found"), none.alias("inner"), no.alias("deep"), no.alias("bad"), no.alias("governed"), no.alias("done")).cast(_STATE)
    run = F.aggregate(F.reverse(tokens) if back else tokens, start, step, lambda a: F.when(a["deep"], close(a)["found"]).otherwise(a["found"]))
    return F.reverse(run) if back else run


def _triggered(low: Column, trigger: str, refuse: bool) -> Column:
    """The lists behind each `trigger`; with `refuse`, not behind a denial right before it."""
    parts = F.split(low, rf"\b{trigger}\s+")

    def one(part: Column, k: Column) -> Column:
        denied = F.get(parts, k - 1).rlike(r"\b(?:" + "|".join(DENIALS) + r")\s+$") if refuse else F.lit(False)
        phrase = F.substring(F.regexp_extract(part, r"^[^.;\n]*", 0), 1, LIST_CHARS)
        return F.when((k > 0) & ~denied, _walk(_tokens(phrase))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(parts, one))


def allergen_evidence(text: Column) -> Column:
    """The allergens that a text gives as the reason of a notice, as it words them, first seen first (C4).

    Three statements count: `undeclared` and a list, a clause that says that something contains a list, `a known allergen`, and a label
    that `does not declare` a list. Denials, ingredient lists, shared lines of production and general talk of allergens never do.
    A word and its plural are one. Null has none.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    clauses = F.split(low, r",\s*(?:an?\s+)?known\s+allergens?\b")

    def known(part: Column, k: Column) -> Column:
        phrase = F.right(F.regexp_extract(part, r"[^.;\n]*$", 0), F.lit(CLAUSE_CHARS))
        phrase = F.regexp_replace(phrase, r"(?:\s*\([^)]*\))+\s*$", "")
        fits = says(phrase, ("contain", "contains", "contained", "containing")) & ~says(phrase, SHARED_LINES, open_end=True) & (F.length(phrase) >= 2)
        return F.when(fits & (k < F.size(clauses) - 1), _walk(_tokens(phrase), back=True)).otherwise(F.array().cast("array<string>"))

    found = F.concat(_triggered(low, "undeclared", True), F.flatten(F.transform(clauses, known)), _triggered(low, r"does\s+not\s+declare", False))
    single = lambda w: F.regexp_replace(w, "s$", "")
    first = F.aggregate(found, F.array().cast("array<string>"), lambda acc, w: F.when(F.exists(acc, lambda x: single(x) == single(w)), acc).otherwise(F.concat(acc, F.array(w))))
    return F.transform(first, lambda w: F.replace(w, F.lit("_"), F.lit(" ")))


def listed(words: Column) -> Column:
    """`a`, `a and b`, or `a, b, and c`."""
    n = F.size(words)
    many = F.concat(F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(words, n - 1))
    return F.when(n == 1, F.get(words, 0)).when(n == 2, F.array_join(words, " and ")).when(n > 2, many)


def pathogen_or_allergen(text: Column) -> Column:
    """A named pathogen, else the allergens given as the reason; null without either (C4)."""
    words = allergen_evidence(text)
    return F.coalesce(pathogen(F.coalesce(text, F.lit(""))), F.concat(F.lit("undeclared "), listed(words)))


def foreign_material(text: Column) -> Column:
    """Struct (stated, material): whether a text states foreign material, and the one it names first as what was found.

    A material counts only where it is what contaminates: pieces of it, it in pieces, contamination with it or by it, it found in
    something, a product that may contain it, foreign objects of it, or what an agency specifies. What describes a package, heavy
    metal, and an element explained in passing (`a metal found in soil`) are nothing.
    """
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\bheavy[\s-]+metal", "heavymetal")
    clauses = F.transform(F.split(low, r"[^a-z0-9_\s,-]+"), lambda c: F.regexp_extract_all(c, F.lit(r"[a-z0-9_-]+"), F.lit(0)))

    def named(m: str) -> Column:
        in_passing = F.regexp_replace(low, r"\b(?:a|an)\s+(?:[\w-]+\s+){0,3}" + m + r"\b", " ")
        return (
            beside(low, each(SHAPES, "of"), 2, (m,))
            | says(low, each(m, SHAPES))
            | F.exists(clauses, lambda words: _announced(words, m))
            | chain(in_passing, (m,), 15, ("found in",))
            | beside(low, ("found",), 2, (m,))
            | says(low, each(m, GENERIC))
            | chain(low, GENERIC, 40, ("specifically",), 60, (m,))
        )

    hits = F.array_compact(F.array(*[F.when(named(m), F.struct(F.instr(low, m).alias("at"), F.lit(k).alias("k"), F.lit(m).alias("m"))) for k, m in enumerate(MATERIALS)]))
    first = F.get(F.array_sort(hits), 0)["m"]
    return F.struct((first.isNotNull() | says(low, GENERIC)).alias("stated"), first.alias("material"))


def agency_hazard(category: Column, text: Column) -> Column:
    """Struct (hazard, agent): the hazard of a listing by its category, and the agent by its category and text.

    Microbes come first, then allergens: those of the category, then others of the text whose family is not among them; failing
    both, the words behind `undeclared`. Foreign material, metal or chemicals (by what the text states), chemicals, integrity and
    regulation follow; any other category is unknown, its agent read from the text.
    """
    cat = F.lower(F.trim(decode_entities(F.coalesce(category, F.lit("")))))
    tokens = F.filter(F.transform(F.split(cat, ","), lambda t: F.trim(t)), lambda t: t != "")
    holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(cat, w))
    own = F.filter(tokens, lambda t: t.isin(*ALLERGEN_TOKENS))
    family = F.create_map(*[F.lit(x) for f, ws in ALLERGEN_FAMILIES.items() for w in ws for x in (w, f)])
    of = lambda w: F.coalesce(F.try_element_at(family, w), w)
    add = lambda acc, w: F.when(F.exists(acc, lambda x: of(x) == of(w)), acc).otherwise(F.concat(acc, F.array(w)))
    named = F.aggregate(allergen_evidence(text), own, add)
    plain = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"undeclared\s+([a-z]+(?:,? and [a-z]+)*)", 1)
    words = F.when(F.size(named) > 0, named).when(plain != "", F.split(plain, ",? and ")).otherwise(F.array().cast("array<string>"))
    allergen = F.coalesce(F.concat(F.lit("undeclared "), listed(words)), pathogen_or_allergen(text))
    germ = F.get(F.filter(tokens, lambda t: t.rlike(r"^(?:salmonella|listeria|e\. ?coli)$")), 0)
    microbe = F.coalesce(pathogen(F.coalesce(text, F.lit(""))), F.concat(F.upper(F.substring(germ, 1, 1)), F.substring(germ, 2, 100)))
    give = lambda hazard, agent=None: F.struct(F.lit(hazard).alias("hazard"), (F.lit(None).cast("string") if agent is None else agent).alias("agent"))
    chemical = give("chemical_contamination", chemical_agent(F.coalesce(text, F.lit(""))))
    return (
        F.when(holds(MICROBIAL), give("microbial_contamination", microbe))
        .when((F.size(own) > 0) | F.array_contains(tokens, GENERIC_ALLERGEN), give("allergen", allergen))
        .when(F.contains(cat, F.lit("potential foreign material")), give("foreign_material"))
        .when(F.contains(cat, F.lit("potential metal or chemical contaminant")), F.when(foreign_material(text)["stated"], give("foreign_material")).otherwise(chemical))
        .when(holds(CHEMICAL) | cat.rlike(any_phrase(("lead",))), chemical)
        .when(holds(INTEGRITY) | (cat == "defect"), give("product_integrity"))
        .when(holds(REGULATORY), give("other_regulatory"))
        .otherwise(give("unknown", pathogen_or_allergen(text)))
    )

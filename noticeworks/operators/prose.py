"""Identifiers in prose and in lists, each with the product that owns it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.concepts import concept_of
from noticeworks.functions.identifiers import barcode, printed_date, split_identifiers
from noticeworks.functions.phrases import any_phrase, each, says
from noticeworks.functions.text import _once, sentences, strip_html

#: Labels of identifiers, in any case; their concepts are those of table headers.
LABELS = (
    *each("upc", ("", "code", "codes", "number", "numbers")), "barcode", "bar code",
    *each(("lot", "batch"), ("", "code", "codes", "number", "numbers")), "lots", "batches",
    *each(("best by", "best before", "best if used by", "best used by", "use by", "sell by", "freeze by", "expiration", "exp", "production", "pack"), ("", "date", "dates")),
    *each(("item", "case", "product", "production"), ("code", "codes", "number", "numbers")), "establishment number", "est number",
)
BARE_PRODUCTION = ("production", "pack", "exp")
#: Words between a label and its value, words that end a value, and words that make a leading clause no product.
FILLERS = "is are of the a any all following these listed with date dates code codes number numbers and no".split()
ENDS = "which that can may located printed stamped marked found because due after with was were on in from sold".split()
NO_OWNER = "recalling recalled recalls recall affected affects is are was were has have include includes including bearing bear bears consumers following all only products product can may".split()
DATES = ("best_by", "use_by", "sell_by", "freeze_by", "expiration", "production_date")
CODES = ("lot", "production_code", "case_code")
#: Words of a value, and of an owner, at most; what says that a sentence is about another firm's recall.
VALUE_WORDS, OWNER_WORDS = 4, 14
ELSEWHERE = ("supplier recall", "supplier's recall", "recalled by its supplier", "recall initiated by")


def list_items(html: Column) -> Column:
    """The texts of the items of a page's lists, in order, without the lists inside of them."""
    parts = F.split(html, r"(?i)<li\b[^>]*>")
    inner = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.regexp_replace(p, r"(?is)</?(?:li|ul|ol)\b.*$", ""))
    return F.filter(F.transform(inner, lambda p: F.trim(F.regexp_replace(strip_html(p), r"\s+", " "))), lambda x: x != "")


#: A label in a line, and what stands for it while the line is cut.
LABEL = "(?i)" + any_phrase([x for x in LABELS if x not in BARE_PRODUCTION]) + r"(?:\(s\)|s)?(?![\w-])"
CUT = "\u0001"


def _labelled(line: Column) -> Column:
    """(label, rest) of each label of a line with the text up to the next one, and the text before the first; null without a label."""
    # cut at one character: a split compiles its pattern for each line
    rests = F.when(F.contains(line, F.lit(CUT)), F.split(line, LABEL)).otherwise(F.split(F.regexp_replace(line, LABEL, CUT), CUT))
    pairs = lambda labels, r: F.zip_with(labels, F.slice(r, F.lit(2), F.size(r)), lambda x, rest: F.struct(x.alias("label"), rest.alias("rest")))
    cut = lambda labels: F.when(F.size(labels) > 0, _once(rests, lambda r: F.struct(F.trim(r[0]).alias("before"), pairs(labels, r).alias("pairs"))))
    return _once(F.regexp_extract_all(line, F.lit(LABEL), F.lit(0)), cut)


def _values(rest: Column) -> Column:
    """The values that stand right behind a label: after fillers, up to a sign or word that ends them."""
    t = F.regexp_replace(rest, r"^[\s:#=–—\"”’'.-]*(?:(?:" + "|".join(FILLERS) + r")\b[\s:#=-]*)*", "")
    t = F.regexp_extract(t, r"^(?:[^;():\n.]|\.(?!\s|$))*", 0)
    t = F.regexp_replace(t, r"(?i)\b(?:" + "|".join(ENDS) + r")\b[\s\S]*\z", "")
    return F.filter(F.transform(split_identifiers(F.regexp_replace(t, r"(?<=[A-Za-z]{3} \d{1,2}), (?=\d{4})", " ")), lambda v: F.rtrim(v, F.lit(" ,.-"))), lambda v: v != "")


def _owner(before: Column) -> Column:
    """The text before the first label of a line, if it reads as a product; else null."""
    lead = F.regexp_replace(before, r"[\s:;,(–—|-]+$|^[\s•*–—-]+", "")

    def product(lead: Column) -> Column:
        named = lambda words: (F.size(words) <= OWNER_WORDS) & ~F.exists(words, lambda w: w.isin(*NO_OWNER)) & ~F.forall(words, lambda w: w.isin(*FILLERS, "this", "these", "those", "an"))
        return F.when(lead.rlike("[A-Za-z]{3}") & _once(F.split(F.lower(lead), r"\s+"), named), lead)

    return _once(lead, product)


def _read(x: Column, line: Column, owned: bool) -> Column:
    """The values of a labelled line that count, in order, each with its place, owner and paired date."""
    concept = lambda p: concept_of(F.regexp_replace(p["label"], r"(?i)^(lot|batch)(?:e?s)\b", "$1"))
    each_ = F.transform(x["pairs"], lambda p, k: F.struct(k.alias("k"), p["label"].alias("label"), concept(p).alias("concept"), _values(p["rest"]).alias("values")))
    some = F.filter(each_, lambda p: F.size(p["values"]) > 0)
    coded = lambda p, v: F.when(p["concept"] == "upc", barcode(v))
    found = F.flatten(F.transform(some, lambda p: F.transform(p["values"], lambda v, n: F.struct(p["k"].alias("k"), n.alias("n"), p["label"].alias("label"), p["concept"].alias("concept"), v.alias("value"), coded(p, v).alias("code")))))
    dated = lambda v: v["concept"].isin(*DATES)
    day = lambda v: ~dated(v) | v["value"].rlike(r"^\d{1,2}/\d{4}$") | printed_date(v["value"]).isNotNull()
    fits = F.filter(found, lambda v: v["value"].rlike(r"\d") & (F.size(F.split(v["value"], " ")) <= VALUE_WORDS) & day(v))
    uncoded = lambda v: (v["concept"] == "upc") & v["code"].isNull()
    owner = _owner(x["before"]) if owned else F.lit(None).cast("string")

    def placed(vals: Column, owner: Column) -> Column:
        days = F.filter(vals, dated)
        only = F.when(F.size(days) == 1, F.get(days, 0)["value"])
        concept = lambda v: F.when(uncoded(v), "product_code").otherwise(v["concept"])
        make = lambda v, only: F.struct(owner.alias("owner"), concept(v).alias("concept"), F.coalesce(v["code"], v["value"]).alias("value"), line.alias("line"), v["k"].alias("k"), v["n"].alias("n"), v["label"].alias("label"), F.when(concept(v).isin(*CODES), only).alias("paired_date"))
        return _once(only, lambda only: F.transform(vals, lambda v: make(v, only)))

    return _once(fits, lambda vals: _once(owner, lambda owner: placed(vals, owner)))


def identifiers_in(rows: DataFrame, key: str, lines: str, owned: bool = True) -> DataFrame:
    """(key, line, place, owner, concept, label, value, paired_date) for the labelled identifiers of `rows` (key, array of lines).

    A line is scanned for labels; what follows one, up to the next label or the end of the value, is its list of values. A value counts
    if it has a digit and few words; a date must be one; a barcode becomes its digits, and is a product code if it is none. The text
    before the first label owns the values if it reads as a product; else, and without `owned`, they belong to the notice (null).
    One date in a line is paired with its codes. Lines about another firm's recall say nothing. The same value of a concept and owner
    counts once in a notice, at its first place. Null lines are none; repeated keys are rows of their own.
    A notice is read inside of its row, without a shuffle; its values are sorted, not compared pair by pair.
    """
    scanned = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda t, i: F.struct(i.alias("line"), F.when(~says(t, ELSEWHERE), _labelled(t)).alias("x")))
    found = F.flatten(F.transform(F.filter(scanned, lambda s: s["x"].isNotNull()), lambda s: _read(s["x"], s["line"], owned)))
    same = lambda a, b: a["owner"].eqNullSafe(b["owner"]) & (a["concept"] == b["concept"]) & (a["value"] == b["value"])
    first = _once(F.array_sort(found), lambda vals: F.filter(vals, lambda v, i: (i == 0) | ~same(v, F.get(vals, i - 1))))
    names = ("line", "k", "n", "owner", "concept", "label", "value", "paired_date")
    ordered = F.array_sort(F.transform(first, lambda v: F.struct(*[v[n].alias(n) for n in names])))
    vals = rows.select(F.col(key).alias("key"), F.posexplode(ordered).alias("place", "v"))
    return vals.select("key", "v.line", (F.col("place") + 1).alias("place"), *[f"v.{n}" for n in names[3:]])


def prose_identifiers(notices: DataFrame, key: str, text: str) -> DataFrame:
    """`identifiers_in` the sentences of a text: those without a product before them belong to the notice."""
    return identifiers_in(notices.withColumn("_lines", sentences(F.col(text))), key, "_lines")


def listed_identifiers(pages: DataFrame, key: str, html: str) -> DataFrame:
    """`identifiers_in` the items of a page's lists: an item is a product with its identifiers."""
    return identifiers_in(pages.withColumn("_lines", list_items(F.col(html))), key, "_lines")

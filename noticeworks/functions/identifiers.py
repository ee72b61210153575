"""Identifiers and dates as Column expressions (I*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.text import _once

#: Units of package sizes.
SIZE_UNITS = ("floz", "oz", "lb", "lbs", "kg", "g", "ml", "l", "ct", "count", "pk", "pack")
#: Forms of a notice's number with and without its expansion, and of a slug with a number at its end.
NUMBER_FORM = r"^(PHA-\d{6,9}(?:-\d{1,2})?|\d{1,3}-\d{4})"
SLUG_FORM = r"^(.{20,})-\d{1,2}$"

def gtin_check_digit(body: Column) -> Column:
    """The last digit that makes `body` a GTIN: weights 3, 1, 3, ... from the right."""

    def of(body: Column) -> Column:
        n = F.length(body)
        total = F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda a, i: a + F.substr(body, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 3).otherwise(1),
        )
        return ((10 - total % 10) % 10).cast("int")

    return _once(body, of)


#: Fixed value: digits of a GTIN.
GTIN_DIGITS = (8, 12, 13, 14)


def gtin(code: Column) -> Column:
    """Struct (key, digits, ambiguous, reason) of a printed identifier.

    Digits with blanks and hyphens, 8, 12, 13 or 14 of them, whose last one is the check digit, have a key of 14 digits; eight digits
    are ambiguous. Others have a reason: not-a-digit-run, unsupported-length or check-digit.
    """
    def read(t: Column, digits: Column) -> Column:
        run = t.rlike(r"^[\d\s-]+$") & (digits != "")
        fits = F.length(digits).isin(*GTIN_DIGITS)
        checked = gtin_check_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1)).cast("int")
        return F.when(~F.coalesce(run, F.lit(False)), "not-a-digit-run").when(~fits, "unsupported-length").when(F.when(run & fits, ~checked), "check-digit")

    def told(digits: Column, reason: Column) -> Column:
        ok = reason.isNull()
        return F.struct(F.when(ok, F.lpad(digits, 14, "0")).alias("key"), F.when(ok, digits).alias("digits"), (ok & (F.length(digits) == 8)).alias("ambiguous"), reason.alias("reason"))

    # the text, its digits and the reason are computed once each, however often they are named
    return _once(F.trim(code), lambda t: _once(F.regexp_replace(t, r"[\s-]", ""), lambda digits: _once(read(t, digits), lambda reason: told(digits, reason))))


def gtin_key(code: Column) -> Column:
    """The 14-digit key of a valid 12, 13 or 14-digit GTIN; null for others, 8 digits included."""
    return _once(gtin(code), lambda g: F.when(~g["ambiguous"], g["key"]))


def exact_gtins(codes: Column) -> Column:
    """The keys of an array of printed identifiers that can be looked up: valid, not ambiguous, once each, first seen first."""
    return F.array_distinct(F.array_compact(F.transform(codes, gtin_key)))


#: Forms of a printed date, as patterns and as formats; a code beside it, and what joins the two.
PRINTED_DATES = (r"\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{2,4}", r"[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{2,4}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{2}-\d{2}")
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "d MMM yyyy", "d MMMM yyyy", "d MMM yy", "MMM d yyyy", "MMMM d yyyy", "MMM d yy")
PRINTED_CODE = r"[A-Z0-9][A-Z0-9-]{2,20}"
PAIRS = "array<struct<code:string,date:string>>"
JOINED = (r"\s+-\s*", r"\s*-\s+", r"\s*[–—]\s*", r"\s*\(\s*")


def printed_date(c: Column) -> Column:
    """The day that a printed date gives, in any of DATE_FORMATS; null for none, and for days that do not exist (I4)."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), "[.,]", " "), r"\s+", " "), r"(?i)\bsept\b", "Sep")
    year = lambda t, n: t.rlike(rf"(?:^|[^0-9])\d{{{n}}}$") | t.rlike(rf"^\d{{{n}}}-")

    def shaped(t: Column, f: str) -> Column:
        """The text has what the format needs, so that few formats fail, which costs the most."""
        if "-" in f or "/" in f:
            return F.contains(t, F.lit("-" if "-" in f else "/"))
        return t.rlike("^[A-Za-z]" if f[0] == "M" else "^[^A-Za-z]*[A-Za-z]")

    # the text is prepared once, not once for each format; formats take names of months in any case
    parsed = lambda t: F.coalesce(*[F.when(shaped(t, f) & year(t, 4 if "yyyy" in f else 2), F.try_to_date(t, f)) for f in DATE_FORMATS])
    return _once(t, parsed)


def code_date_pairs(text: Column) -> Column:
    """Structs (code, date) of the codes that stand right before a date, joined to it by a spaced hyphen, a dash or a bracket.

    A hyphen without blanks is part of a code. Codes that are dates themselves, and dates that do not exist, make no pair; a code
    counts once, with its first date, those joined by a dash before those in brackets.
    """
    date = "(?:" + "|".join(PRINTED_DATES) + ")"

    def pair_by(pattern: str):
        return lambda hit: F.struct(F.regexp_extract(hit, pattern, 1).alias("code"), F.regexp_extract(hit, pattern, 2).alias("date"))

    def found(text: Column) -> Column:
        out = []
        for joins, close, signs in ((JOINED[:3], "", "-–—"), (JOINED[3:], r"\s*\)", "(")):
            pattern = rf"\b({PRINTED_CODE}?)(?:{'|'.join(joins)})({date}){close}"
            # one scan for the pairs, and only if a sign is there that joins them; a pair gives its parts by itself
            joined = F.translate(text, signs, "") != text
            out.append(F.when(joined, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pair_by(pattern))).otherwise(F.array().cast(PAIRS)))
        return F.concat(*out)

    real = F.filter(_once(F.coalesce(text, F.lit("")), found), lambda p: ~p["code"].rlike(f"^{date}$") & printed_date(p["date"]).isNotNull())
    return F.aggregate(real, F.array().cast(PAIRS), lambda acc, p: F.when(F.exists(acc, lambda x: x["code"] == p["code"]), acc).otherwise(F.concat(acc, F.array(p))))


def aligned_pairs(codes: Column, dates: Column) -> Column:
    """Structs (code, date) of two cells that list codes and their dates in the same order; lists of unequal length give none."""

    def pairs(c: Column, d: Column) -> Column:
        same = (F.size(c) == F.size(d)) & (F.size(c) > 0) & F.forall(d, lambda x: printed_date(x).isNotNull())
        return F.when(F.coalesce(same, F.lit(False)), F.zip_with(c, d, lambda x, y: F.struct(x.alias("code"), y.alias("date")))).otherwise(F.array().cast(PAIRS))

    return _once(split_identifiers(codes), lambda c: _once(split_identifiers(dates), lambda d: pairs(c, d)))


def notice_date(c: Column) -> Column:
    """The first form that parses: yyyy-MM-dd, MM/dd/yyyy, yyyyMMdd; null for impossible dates."""
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substr(c, F.lit(1), F.lit(10)), "yyyy-MM-dd"))
    us = F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(c, "MM/dd/yyyy"))
    flat = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
    return F.coalesce(iso, us, flat)


def recall_number(c: Column) -> Column:
    """Struct (native_id, base_id): trimmed upper case, and the base of an expansion; null if it is the base or has none."""
    native = F.upper(F.trim(c))
    base = F.regexp_extract(native, NUMBER_FORM, 1)
    return F.struct(native.alias("native_id"), F.when((base != "") & (base != native), base).alias("base_id"))


def collision_base(slug: Column) -> Column:
    """A slug of 20 characters or more without the number that sets it apart from an equal one; null without a number."""
    base = F.regexp_extract(slug, SLUG_FORM, 1)
    return F.when(base != "", base)


def size_tokens(c: Column) -> Column:
    """Distinct package sizes, in lower case without what joins number and unit: `12 oz.` -> `12oz` (I8).

    A size is a number and the word after it, if that is a unit; `fl oz` is one word.
    """
    t = F.regexp_replace(F.lower(c), r"\bfl[. ]*oz\b", "floz")
    pair = r"(?<![0-9a-z_.])([0-9]+(?:\.[0-9]+)?)[ -]{0,2}([a-z]+)(?![0-9_])"
    numbers, units = (F.regexp_extract_all(t, F.lit(pair), F.lit(k)) for k in (1, 2))
    sizes = F.filter(F.arrays_zip(numbers.alias("n"), units.alias("u")), lambda p: p["u"].isin(*SIZE_UNITS))
    return F.array_distinct(F.transform(sizes, lambda p: F.concat(p["n"], p["u"])))


def unverified_sizes(claim: Column, printed: Column) -> Column:
    """The sizes of a claim that a text does not print; empty if it prints all."""
    none = F.array().cast("array<string>")
    return F.array_except(F.coalesce(size_tokens(claim), none), F.coalesce(size_tokens(printed), none))


#: Digits of a barcode; signs and words that stand between two identifiers of a list.
BARCODE_DIGITS = (8, 12, 13, 14)
LIST_SIGNS, LIST_WORDS = ",;&•·\n", ("and", "or")
CUT = "\u0001"


def split_identifiers(c: Column) -> Column:
    """The identifiers of one field in their order.

    Signs of a list, two or more blanks, the words of a list and a plus sign at the edge of a word end an identifier;
    the words between two ends are one, joined by a blank. Empty ones go.
    """
    marked = F.translate(F.regexp_replace(c, r"[^\S\n]{2,}|\s*\n\s*", CUT), LIST_SIGNS, CUT * len(LIST_SIGNS))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(marked, r"\s", " "), CUT, f" {CUT} ")), " +")

    def word(w: Column) -> Column:
        core = F.ltrim(F.rtrim(w, F.lit("+")), F.lit("+"))
        edge = lambda there: F.when(there, F.lit(f" {CUT} ")).otherwise(F.lit(""))
        kept = F.when(F.lower(core).isin(*LIST_WORDS), F.lit(CUT)).otherwise(core)
        return F.concat(edge(F.startswith(w, F.lit("+"))), kept, edge(F.endswith(w, F.lit("+"))))

    parts = F.split(F.array_join(F.transform(words, word), " "), CUT)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def barcode(c: Column) -> Column:
    """The digits of a barcode printed with blanks and hyphens; null for anything else.

    The first of its blank-separated groups that has the digits of a barcode, else all of them together if they have.
    """
    def read(groups: Column) -> Column:
        readings = F.transform(F.concat(groups, F.array(F.array_join(groups, ""))), lambda g: F.translate(g, "-", ""))
        only = F.forall(groups, lambda g: g.rlike("^[0-9-]+$"))
        return F.when(only, F.get(F.filter(readings, lambda d: F.length(d).isin(*BARCODE_DIGITS)), 0))

    return _once(F.split(F.trim(c), r"\s+"), read)


def barcodes(c: Column) -> Column:
    """The distinct barcodes of a cell, first seen first; a slash before a blank separates too.

    Words without a digit at the ends of an identifier, such as its label, are left out.
    """
    parts = split_identifiers(F.regexp_replace(c, r"/\s", ", "))

    def digits_only(p: Column) -> Column:
        first = F.regexp_instr(p, F.lit("[0-9]"))
        tail = F.regexp_extract(p, r"[^0-9\s-]*$", 0)
        return F.substring(p, first, F.length(p) - first + 1 - F.length(tail))

    return F.array_distinct(F.array_compact(F.transform(parts, lambda p: barcode(digits_only(p)))))

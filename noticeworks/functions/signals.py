"""Signals that two notices are one event, product words and scope, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.phrases import each, followed, says
from noticeworks.functions.text import decode_entities

#: Characters of two titles that must agree, of a body in which a declaration counts, of a product's
#: name at least; digits of a bar code.
TITLE_PREFIX = 48
OPENING = 600
PRODUCT_CHARS = 8
UPC_DIGITS = (12, 14)
#: What a title may begin with, before a dash or colon, when it is only updated.
UPDATE_MARKS = each(("update", "updated"), ("", "release"))
#: Words that widen a recall, and those that change an announcement.
WIDEN = ("expand", "expands", "expanded", "expanding")
CHANGED = ("updated", "revised", "corrected")
#: What ends the product's name in a title.
TAILS = ("due to", "because", "to include", "for possible", "over")


def plain_title(title: Column) -> Column:
    """Lower case, single blanks, without a mark of an update and the dashes or colons behind it."""
    t = F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))
    head = F.trim(F.regexp_extract(t, "^[^–—:-]*", 0))
    rest = F.regexp_replace(F.substr(t, F.length(F.regexp_extract(t, "^[^–—:-]*", 0)) + 1), "^[–—:-]+", "")
    return F.when(head.isin(*UPDATE_MARKS) & t.rlike("[–—:-]"), F.trim(rest)).otherwise(t)


def titles_relate(a: Column, b: Column) -> Column:
    """The shorter title's first characters, 48 at most, begin the other one too; blank titles relate to none."""
    return begin_alike(plain_title(a), plain_title(b))


def begin_alike(x: Column, y: Column) -> Column:
    """`titles_relate` of two plain titles."""
    n = F.least(F.length(x), F.length(y), F.lit(TITLE_PREFIX))
    return F.coalesce((n > 0) & (F.substr(x, F.lit(1), n) == F.substr(y, F.lit(1), n)), F.lit(False))


def upc_digits(c: Column) -> Column:
    """Distinct codes of bar code length.

    Digits that only blanks and hyphens part are one code if they have the length together; else each group of them that
    has it is one. Digits that touch a letter are none. Null has none.
    """
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![\w-])\d+(?:[\s-]+\d+)*(?!\w)"), F.lit(0))
    fits = lambda d: F.length(d).between(*UPC_DIGITS)

    def codes(run: Column) -> Column:
        groups = F.split(run, r"[\s-]+")
        whole = F.array_join(groups, "")
        return F.when(fits(whole), F.array(whole)).otherwise(F.filter(groups, fits))

    return F.array_distinct(F.flatten(F.transform(runs, codes)))


def declares_expansion(title: Column, body: Column) -> Column:
    """The title, or the opening of the body, says that an earlier recall is widened.

    In a title, a widening word has a word of recall behind it in its clause, 60 characters at most, or it speaks
    of a recall expansion. A body says that someone is expanding its recall (120 characters at most), expands this
    recall, with three words between at most, or that the recall is being expanded.
    """
    opening = F.substring(F.coalesce(body, F.lit("")), 1, OPENING)
    plain = lambda w: F.regexp_replace(w, r"^\W+", "")

    def widens(words: Column, i: Column) -> Column:
        named = F.get(words, i + 1).isin("its", "the", "this")
        between = lambda n: F.forall(F.slice(words, i + 3, F.lit(n)), lambda w: w.rlike(r"^\w+$")) if n else F.lit(True)
        recall = [F.startswith(F.coalesce(F.get(words, i + 2 + n), F.lit("")), F.lit("recall")) & between(n) for n in range(4)]
        return named & plain(F.get(words, i)).isin(*WIDEN[1:]) & (recall[0] | recall[1] | recall[2] | recall[3])

    # the words are split once, not once for each of them
    widened = F.transform(F.array(F.split(F.lower(opening), r"\s+")), lambda w: F.exists(F.sequence(F.lit(0), F.size(w) - 1), lambda i: widens(w, i)))[0]
    passive = each("recall", ("was", "is being"), ("", "initiated and later", "initiated, and later"), "expanded")
    by_title = followed(title, WIDEN, ("recall",), 60, open_end=True) | says(title, ("recall expansion",))
    by_body = followed(opening, ("is expanding its",), ("recall",), 120, open_end=True) | says(opening, passive) | F.coalesce(widened, F.lit(False))
    # all wordings hold these letters, which costs less to see
    low = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("expan"))
    return F.when(low(title) | low(opening), by_title | by_body).otherwise(False)


def declares_revision(body: Column) -> Column:
    """The opening of the body says that it changes or replaces an earlier press release."""
    opening = F.substring(F.coalesce(body, F.lit("")), 1, OPENING)
    own = ("their", "its", "the", "the company's", "the company’s")
    phrases = ("press release is an update", *each(CHANGED, own, "press release"), *each("this", CHANGED, "press release"), *each("replaces an earlier", ("version", "release")))
    low = F.lower(opening)
    said = says(opening, phrases) | followed(opening, ("press release",), each(("was", "has been", "is being"), CHANGED), 80, r"[.\n]")
    return F.when(F.contains(low, F.lit("release")) | F.contains(low, F.lit("replaces")), said).otherwise(False)


def plain_words(c: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def expansion_product(title: Column) -> Column:
    """Normalised product name after `recall of` up to the reason; empty without one, or if it is short."""
    low = F.lower(F.regexp_replace(title, r"\s+", " "))
    name = F.get(F.split(low, r"\brecall of ", 2), 1)
    for tail in TAILS:
        name = F.get(F.split(name, f" {tail} ", 2), 0)
    name = plain_words(name)
    return F.coalesce(F.when(F.length(name) >= PRODUCT_CHARS, name), F.lit(""))


def product_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of four letters or more, without stop words (X11)."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*stop) if stop else F.length(w) >= 4))


def food_scope(tags: Column) -> Column:
    """food, excluded_nonfood or excluded_animal by the agency's product tags."""
    t = decode_entities(F.coalesce(tags, F.lit("")))
    return F.when(~t.rlike(r"(?i)\bFood & Beverages\b"), "excluded_nonfood").when(t.rlike(r"(?i)\bAnimal & Veterinary\b"), "excluded_animal").otherwise("food")

"""Search: code candidates, queries and matching."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.text import plain_text, search_text

#: Label words that people type before a code.
LABELS = ("upc", "gtin", "ean", "sku", "lot", "lots", "batch", "batches", "case", "code", "codes", "est", "establishment", "item", "number", "no")
#: What may stand behind a label, and inside of a code; digits that make a candidate.
LABEL_SIGNS = " \t\r\n#:.=-"
CODE_SIGNS = "-./#"
CODE_DIGITS = 4


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^0-9]", ""))


def code_candidates(c: Column) -> Column:
    """Upper-case words with four digits or more, and such runs of neighbouring words with digits, joined.

    Words are runs of 0-9 and A-Z. A regular expression takes the runs of two words or more; null has none.
    """
    up = F.upper(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(up, F.lit(r"[0-9A-Z]+"), F.lit(0))
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    runs = F.regexp_extract_all(spaced, F.lit(r"(?<= )[A-Z]*[0-9][0-9A-Z]*(?: [A-Z]*[0-9][0-9A-Z]*)+(?= )"), F.lit(0))
    joined = F.transform(runs, lambda r: F.regexp_replace(r, " ", ""))
    return F.array_distinct(F.filter(F.concat(words, joined), lambda w: _digits(w) >= CODE_DIGITS))


@dataclass(frozen=True)
class Query:
    """What a search asks for: all of `tokens` in the text, or `identifier` in a code."""

    tokens: tuple[str, ...]
    identifier: str | None


def parse_query(raw: str) -> Query | None:
    """A query literal, read on the driver; None for a blank one, which searches nothing.

    Words that only label a code are passed over, with the blanks and signs behind them, as long as they come first.
    What is left is an identifier if it begins with a letter or digit, has four digits, and only signs that
    codes are printed with.
    """
    raw = raw.strip()
    if not raw:
        return None
    rest = raw
    for word in re.finditer(r"\w+", raw):
        between = raw[len(raw) - len(rest) : word.start()]
        if word[0].lower() not in LABELS or between.strip(LABEL_SIGNS):
            break
        rest = raw[word.end() :].lstrip(LABEL_SIGNS)
        if not rest or not rest[0].isalnum():
            break
    plain = [ch for ch in rest if ch.isascii() and ch.isalnum()]
    coded = bool(plain) and rest[0] == plain[0] and sum(ch.isdigit() for ch in plain) >= CODE_DIGITS and all(ch in plain or ch.isspace() or ch in CODE_SIGNS for ch in rest)
    return Query(tuple(plain_text(rest).split()), "".join(plain).upper() if coded else None)


def matches(text: Column, codes: Column, query: Query) -> Column:
    """A code holds the identifier, or the normalised text holds every token; no tokens match nothing."""
    by_code = F.exists(codes, lambda c: F.contains(c, F.lit(query.identifier))) if query.identifier is not None else F.lit(False)
    by_text = F.forall(F.array(*[F.lit(t) for t in query.tokens]), lambda t: F.contains(text, t)) if query.tokens else F.lit(False)
    return F.coalesce(by_code, F.lit(False)) | F.coalesce(by_text, F.lit(False))


def entry(parts: list[Column], coded: list[Column]) -> tuple[Column, Column]:
    """(text, codes) by which a row is found: all `parts` normalised, the candidates of the `coded` ones."""
    return search_text(F.concat_ws(" ", *parts)), F.array_distinct(F.flatten(F.array(*[code_candidates(c) for c in coded])))

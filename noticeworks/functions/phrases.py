"""Wording rules over texts as Column expressions: plain phrases, and words that follow each other in a clause."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def each(*parts: str | tuple[str, ...]) -> tuple[str, ...]:
    """Every phrase that takes one wording of each part in turn; an empty wording drops out."""
    options = [(p,) if isinstance(p, str) else p for p in parts]
    return tuple(" ".join(w for w in words if w) for words in product(*options))


def _tree(words: list[str]) -> str:
    """A pattern for any of the words, which share their beginnings, the longest one first; a blank is any white space."""
    ends, rest = "" in words, {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    forms = [(r"\s+" if c == " " else re.escape(c)) + _tree(more) for c, more in sorted(rest.items())]
    if not forms:
        return ""
    return "(?:" + "|".join(forms) + ")?" if ends else forms[0] if len(forms) == 1 else "(?:" + "|".join(forms) + ")"


def any_phrase(phrases: tuple[str, ...] | list[str], open_end: bool = False) -> str:
    """A pattern for any of the phrases as whole words, whatever white space is between them; `open_end`: the last word may go on.

    Phrases that match at one place begin one another, so that a tree of letters tries them in the order of a list from the longest
    to the shortest, and leaves a place where none begins at its first letter.
    """
    plain = sorted({" ".join(p.split()) for p in phrases})
    if any(p != p.lower() or not p for p in plain):  # letters of either case are not told apart under (?i)
        longest = sorted(set(phrases), key=lambda p: (-len(p), p))
        return r"\b(?:" + "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in longest) + ")" + ("" if open_end else r"\b")
    return r"\b(?:" + _tree(plain) + ")" + ("" if open_end else r"\b")


def says(text: Column, phrases: tuple[str, ...] | list[str], open_end: bool = False) -> Column:
    """The text holds one of the phrases, in any case; null says nothing."""
    return F.coalesce(text.rlike("(?i)" + any_phrase(phrases, open_end)), F.lit(False))


def followed(text: Column, first: tuple[str, ...], then: tuple[str, ...], within: int, ends: str = r"\.", open_end: bool = False) -> Column:
    """In one clause, a phrase of `first` has one of `then` at most `within` characters behind it. `ends` splits clauses."""
    clauses = F.split(F.lower(F.coalesce(text, F.lit(""))), ends)
    begin = any_phrase(then, open_end)

    def near(clause: Column) -> Column:
        after = F.split(clause, any_phrase(first))
        return F.exists(F.slice(after, F.lit(2), F.size(after)), lambda rest: F.regexp_instr(rest, F.lit(begin)).between(1, within + 1))

    return F.exists(clauses, near)


def chain(text: Column, *steps: tuple[str, ...] | int, open_end: bool = False) -> Column:
    """Phrases in their order inside of one clause: tuples of wordings, between them the characters that may lie between at most."""
    groups = [s for s in steps if not isinstance(s, int)]
    pattern = any_phrase(groups[0])
    for gap, group in zip([s for s in steps if isinstance(s, int)], groups[1:], strict=True):
        pattern += rf"[^.]{{0,{gap}}}?" + any_phrase(group, open_end and group is groups[-1])
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def beside(text: Column, first: tuple[str, ...], words: int, then: tuple[str, ...]) -> Column:
    """A phrase of `then` at most `words` words behind one of `first`, nothing but white space between them."""
    return F.coalesce(text.rlike("(?i)" + any_phrase(first) + rf"\s+(?:\w+\s+){{0,{words}}}?" + any_phrase(then)), F.lit(False))

"""Scalar text functions as Column expressions (X*)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: The named entities that are decoded.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
    "ndash": "–", "mdash": "—", "hellip": "…", "deg": "°", "amp": "&",
}
#: White space as the reference's engine has it; the first part lets most characters fail at once.
SPACE = r"[[^!-~]&&[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
#: Abbreviations whose period ends no sentence.
ABBREVIATIONS = (
    "Inc Corp Co Ltd LLC L.L.C LLP No Nos vs etc Mr Mrs Ms Dr St Mt Ave Blvd U.S U.S.A D.C Ala Ariz Ark Calif Colo Conn Del Fla Ga Ill Ind Kan Ky La Mass Md "
    "Mich Minn Miss Mo Mont Neb Nev Okla Ore Pa Tenn Tex Va Vt Wash Wis Wyo"
).split()
#: Marks that a decomposed letter carries.
MARKS = "".join(map(chr, range(0x300, 0x370)))


def _decomposed() -> tuple[str, str]:
    """Letters that decompose into one of a-z or 0-9 and marks, and what stays of each; all of them, by Unicode's own rule."""
    found = [(c, d[0]) for c in map(chr, range(0x80, 0x10000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii() and d[0].isalnum() and all(m in MARKS for m in d[1:])]
    return "".join(c for c, _ in found), "".join(p for _, p in found)


MARKED, PLAIN = _decomposed()
#: Corporate endings of firm names.
FIRM_ENDINGS = ("incorporated", "inc", "llc", "corporation", "corp", "company", "co", "ltd", "limited")


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """`f(c)` with `c` computed once, however often `f` names it."""
    return F.transform(F.array(c), f)[0]


def _replace_each(c: Column, mark: str, pattern: str, f: Callable[[Column], Column]) -> Column:
    """`c` with every match of `pattern`, which holds `mark`, replaced by `f(match)`."""

    def replaced(x: Column) -> Column:
        hits = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        parts = F.zip_with(F.split(x, pattern), hits, lambda part, hit: F.concat(part, F.coalesce(f(hit), F.lit(""))))
        return F.when(F.contains(x, F.lit(mark)), F.array_join(parts, "")).otherwise(x)

    return _once(c, replaced)


def _character(base: int) -> Callable[[Column], Column]:
    """What a numeric entity stands for; numbers that are no character stay."""

    def decoded(whole: Column) -> Column:
        code = F.regexp_replace(whole, r"^&#[xX]?0*|;$", "")
        code = F.when(code == "", 0).when(F.length(code) <= 7, F.conv(code, base, 10).cast("int"))
        char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")
        return F.when((code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char).otherwise(whole)

    return decoded


def decode_entities(c: Column) -> Column:
    """Decimal, then hex, then named entities in any case, each in one pass; unknown names stay."""
    names = F.create_map(*[F.lit(x) for name, value in ENTITIES.items() for x in (f"&{name};", value)])
    c = _replace_each(c, "&#", r"&#\d+;", _character(10))
    c = _replace_each(c, "&#", r"(?i)&#x[0-9a-f]+;", _character(16))
    return _replace_each(c, "&", r"&[a-zA-Z]+;", lambda hit: F.coalesce(F.try_element_at(names, F.lower(hit)), hit))


def strip_html(c: Column) -> Column:
    """Block ends become line feeds, other tags spaces; entities are decoded, runs of blanks collapse."""
    c = F.regexp_replace(c, r"(?i)<(?:br|/p|/li|/h[1-6])[^>]*>", "\n")
    c = decode_entities(F.regexp_replace(c, r"<[^>]+>", " "))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), rf"{SPACE}*\n{SPACE}*", "\n")
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def sentences(c: Column) -> Column:
    """Sentences: cut at line feeds, after `.`, `!` or `?` before white space unless an abbreviation ends there, and before glued openers; empty ones go."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    marked = F.regexp_replace(c, rf"([.!?])(?<!(?<![A-Za-z0-9_])(?:{short})\.){SPACE}+", "$1\n")
    marked = F.regexp_replace(marked, rf"([a-z]){SPACE}+(?=(?:There (?:have|has) been|Anyone concerned about)(?![A-Za-z0-9_]))", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.regexp_replace(s, rf"\A{SPACE}+|{SPACE}+\z", "")), lambda s: s != "")


def search_text(c: Column) -> Column:
    """Lower case without marks; anything but a-z and 0-9 becomes one blank."""
    low = F.lower(F.translate(c, MARKED + MARKS, PLAIN))
    return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def plain_text(s: str) -> str:
    """What `search_text` makes of a literal."""
    low = s.translate(str.maketrans(MARKED, PLAIN, MARKS)).lower()
    return " ".join(re.findall("[a-z0-9]+", low))


def ensure_sentence(c: Column) -> Column:
    """Trimmed, with a full stop unless a closing mark ends it; blank stays blank."""
    t = F.trim(c)
    return F.when((t == "") | t.rlike("[.!?\"”')\\]]$"), t).otherwise(F.concat(t, F.lit(".")))


def join_sentences(c: Column) -> Column:
    """An array of sentences as one text, blank ones left out."""
    return F.array_join(F.filter(F.transform(c, ensure_sentence), lambda s: s != ""), " ")


def clean_display(c: Column) -> Column:
    """Blanks collapsed, none before punctuation, repeated full stops once."""
    c = F.regexp_replace(c, rf"(?:{SPACE})+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r" +([.,;:!?])", "$1"), r"\.{2,}", "."))


def firm_name(c: Column) -> Column:
    """Lower case, signs as blanks, corporate endings off the end."""
    c = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    return F.regexp_replace(c, rf"( (?:{'|'.join(FIRM_ENDINGS)}))+$", "")


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct tokens of at least `least` characters."""
    return F.array_distinct(F.filter(F.split(search_text(c), " "), lambda t: F.length(t) >= least))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units in 8 hex digits."""
    units = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(F.hex(F.encode(c, "UTF-16BE"))) / 4 - 1, F.lit(0)).cast("int")),
        lambda i: F.conv(F.substr(F.hex(F.encode(c, "UTF-16BE")), i * 4 + 1, F.lit(4)), 16, 10).cast("long"),
    )
    step = lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step)), 8, "0"))


def in_key_order(c: Column, kind: DataType) -> Column:
    """`c`, of type `kind`, with the fields of all structs inside of it, and the entries of maps, in the order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: (f.name.lower(), f.name))
        return F.when(c.isNotNull(), F.struct(*[in_key_order(c[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: in_key_order(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.struct(e["key"].alias("key"), in_key_order(e["value"], kind.valueType).alias("value"))))
    return c


def canonical_json(rows: DataFrame, column: str) -> Column:
    """JSON of a struct column of `rows` with all keys in order, nulls kept."""
    return F.to_json(in_key_order(F.col(column), rows.schema[column].dataType), {"ignoreNullFields": "false"})


def content_hash(rows: DataFrame, column: str) -> Column:
    """The sha256 of `canonical_json` in hex."""
    return F.sha2(canonical_json(rows, column), 256)


def canonical_url(c: Column) -> Column:
    """Host in lower case without `www.`, path without query, fragment and a final slash."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[a-zA-Z]+://", ""), r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"/+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), r"^www\.", "")
    return F.concat(host, F.regexp_extract(bare, r"/.*$", 0))


def version_at_least(c: Column, least: str) -> Column:
    """Dotted versions by number."""
    want = [int(x) for x in least.split(".")]
    have = F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    have = [F.coalesce(F.get(have, i), F.lit(0)) for i in range(len(want))]
    return F.struct(*[h.alias(f"v{i}") for i, h in enumerate(have)]) >= F.struct(*[F.lit(w).alias(f"v{i}") for i, w in enumerate(want)])

"""What a notice says about illnesses, hospitalisations and deaths.

Sentences are read one by one: which of them speak of harm, whether they assert or deny it, whose illnesses they report, and which
number counts what. Word groups below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions.phrases import any_phrase, chain, each, says
from noticeworks.functions.text import _once, sentences

DISEASES = ("salmonellosis", "listeriosis", "botulism", "infant botulism")
ILL = ("illness", "illnesses", "sickness", "sicknesses", "sickened", "ill")
CASES = ("illness", "illnesses", "case-patient", "case-patients")
OTHER_HARMS = each(("adverse", "allergic"), ("reaction", "reactions", "event", "events")) + ("injury", "injuries", "reaction", "reactions")
PEOPLE = "case-patient case-patients case cases people person persons individual individuals patient patients infant infants babies children consumer consumers customer customers".split()
NUMBERS = {w: n for n, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
BEEN = each(("have", "has"), "been", ("reported", "confirmed", "identified", "received"))

ADVICE = each("concerned about", ("", "a", "an"), ("illness", "injury", "reaction")) + ("contact a healthcare provider", "contact a health care provider", "seek medical", "seek emergency")
DISCOVERY = each(("problem", "issue"), "was", ("discovered", "identified", "found")) + each("discovered", ("during", "by", "when", "through"))
GENERAL = ("is", "are", "can", "may", "usually", "typically", "often", "generally")
EDUCATION = (
    "can cause", "may cause", "symptom", "symptoms", "incubation", *each("infection", ("can", "may", "is")), *each(DISEASES, GENERAL), "older adults", "pregnant", "pregnant women", "weakened immune", "young children",
    *each("serious", ("", "and sometimes"), ("illness", "illnesses", "infection", "infections")), "invasive infection", "wound infection",
)
NEGATED = each(("does", "do", "will", "would", "can"), "not") + ("cannot", "can't not")
PRECAUTION = ("prevent", "kill", "destroy", "eliminate", "cure", "treat", "inactivate")
HARM = (
    *ILL, "sick", "case-patient", "case-patients", "infected", *each("adverse", ("", "health"), ("reaction", "reactions", "event", "events", "effect", "effects")), "allergic reaction", "allergic reactions", "injury", "injuries",
    "death", "deaths", "fatality", "fatalities", *DISEASES,
)
HOSPITAL, DEATH = ("hospitalization", "hospitalizations", "hospitalized", "hospitalisation", "hospitalisations", "hospitalised"), ("death", "deaths", "died", "fatality", "fatalities")
QUALIFIED = each("no", ("other", "additional", "further"))
DENYING = ("no", "not", "never", "without", "neither")
HEDGES = each(("may", "might", "could"), ("", "be"), ("associated", "linked", "related", "connected")) + each("possibly", ("associated", "linked", "related")) + ("potential link", "potentially link", "potentially linked")
SUPPLIERS = ("supplied by", "its supplier", "supplier lot", "supplier of", "supplier's lot", "supplier's of")
ATE = ("consumed", "ate", "became ill", "fell ill", "were sickened", "sickened", "reported eating", "reported consuming")
NOT_SHOWN = each(("has", "have", "had"), "not", ("", "yet"), ("", "been"), ("identified", "established", "found", "determined", "confirmed", "linked"))
LINKS = ("link", "linked", "association", "associated", "connection")
TIES = ("linked to", "associated with", "attributed to", "traced to", "traced back to", "in connection with")
OWN = ("this", "these", "the recalled", "the affected", "our")
MODALS, LEADS = ("can", "could", "may", "might", "would"), ("lead to", "result in", "cause", "causes", "include", "includes", "be")
HEDGED_FIGURE = ("approximately", "around", "at least", "more than", "over", "nearly", "roughly", "some")
ABOUT_NOT = "information informed informing notified notify notice notices detail details data report reports reported reporting learned told concern concerns question questions complaint complaints inquiry inquiries".split()
GOES_ON = ("which", "who", "whom", "whose", "that", "and", "but", "or", "nor")

#: Shapes of the words behind a number that make it count illnesses, hospitalisations or deaths. `~` is up to two words, `~~` up
#: to three, `..` anything in the clause.
COUNTS_ILLNESS = (
    "~ (illness|illnesses|case-patient|case-patients)",
    "~ (instance|instances|report|reports|case|cases) of ~~ (illness|illnesses)",
    "(people|person|persons|individual|individuals) .. (infected|sickened|ill|illness|illnesses)",
    "(sick|sickened) (people|person|persons|individual|individuals) .. (infected|sickened|ill|illness|illnesses)",
    "sick (people|person|persons|individual|individuals)",
    "~ (case|cases) of ~ (salmonellosis|listeriosis|botulism)",
)
COUNTS_HOSPITAL = ("~ (hospitalization|hospitalizations|hospitalisation|hospitalisations)", "~ (was|were|has been|have been) (hospitalized|hospitalised)")
COUNTS_DEATH = ("~ (death|deaths|fatality|fatalities)", "~ (has|have) died")
#: What disowns a number: it counts what data are at hand, or those who came to further harm.
DISOWNED = (".. (information|data) available", ".. (information|data) (is|was|are) available", ".. available ~ (information|data)", ".. for whom data", "[a-z-]+ (was|were|has been|have been) (hospitalized|hospitalised|died)")
TOKEN = r"[a-z0-9]+(?:[-,'’][a-z0-9]+)*|[.;(),]"


def _shape(shape: str) -> str:
    return "^" + shape.replace("~~ ", "(?:[a-z0-9]+ ){0,3}").replace("~ ", "(?:[a-z0-9-]+ ){0,2}").replace(".. ", "(?:[^. ]+ ){0,14}?") + r"(?![a-z0-9-])"


def figures(sentence: Column, shapes: tuple[str, ...]) -> Column:
    """The distinct numbers of a sentence that count what `shapes` say; years are none, nor what is disowned."""
    all_tokens = F.regexp_extract_all(F.lower(sentence), F.lit(TOKEN), F.lit(0))
    words = F.create_map(*[F.lit(x) for w, n in NUMBERS.items() for x in (w, n)])

    def number(t: Column) -> Column:
        digits = F.when(t.rlike(r"^\d{1,4}(?:,\d{3})?$") & ~(t.rlike(r"^\d{4}$") & t.between("1900", "2100")), F.replace(t, F.lit(","), F.lit("")).cast("int"))
        return F.coalesce(F.try_element_at(words, t), F.when(digits > 0, digits))

    def counts(rest: Column) -> Column:
        hit = F.lit(False)
        for s in shapes:
            hit = hit | rest.rlike(_shape(s))
        own = F.lit(False)
        for s in DISOWNED[:4]:
            own = own | rest.rlike(_shape(s))
        harmed = rest.rlike("^(?:[a-z0-9-]+ ){0,4}(?:was|were|has been|have been) (?:hospitali[sz]ed|died)") if shapes is COUNTS_ILLNESS else F.lit(False)
        return hit & ~own & ~harmed

    def counted(tokens: Column) -> Column:
        def of(t: Column, i: Column) -> Column:
            rest = F.regexp_replace(F.array_join(F.slice(tokens, i + 2, 30), " "), r"^\( \d+ \) ", "")
            return F.when(number(t).isNotNull(), F.when(_once(rest, counts), number(t)))

        return F.array_distinct(F.array_compact(F.transform(tokens, of)))

    # what is named more than once is computed once: the tokens, and the words behind a number
    return _once(all_tokens, counted)


def no_report(s: Column) -> Column:
    """Advice, education, or how the problem was found: no report of harm."""
    return says(s, ADVICE) | says(s, EDUCATION) | chain(s, NEGATED, 24, PRECAUTION) | says(s, DISCOVERY) | says(s, ("surveillance activit",), open_end=True)


def approximate(s: Column) -> Column:
    """The sentence hedges a figure of its own."""
    figure = tuple(NUMBERS)
    hedged = F.coalesce(s.rlike("(?i)" + any_phrase(HEDGED_FIGURE) + r"\s+(?:\d|" + any_phrase(figure) + ")"), F.lit(False))
    about = F.coalesce(s.rlike(r"(?i)(?<!\b(?:" + "|".join(ABOUT_NOT) + r")\s)\babout\s+(?:\d|" + any_phrase(figure) + ")"), F.lit(False))
    return hedged | about


def _joined(s: Column) -> Column:
    """Illness and another harm in one breath."""
    link = (", or", ", and", "or", "and", "and/or")
    ill, other = ("illness", "illnesses", "sick"), OTHER_HARMS
    low = F.regexp_replace(F.lower(s), r"\s*,\s*", " , ")
    near = lambda a, b: chain(low, each(a, tuple(x.replace(",", ", ").replace("  ", " ") for x in link)), 24, b)
    return near(ill, other) | near(other, ill)


def _affirmed(s: Column, words: tuple[str, ...]) -> Column:
    """A mention of the harm that is neither what could happen nor denied."""
    pattern = any_phrase(words)
    tail = lambda c, n: F.right(c, F.lit(n))

    def mentioned(parts: Column) -> Column:
        before = lambda k: F.substring_index(F.substring_index(F.array_join(F.slice(parts, F.lit(1), k + 1), " "), ".", -1), ";", -1)
        real = lambda b: ~chain(tail(b, 140), MODALS, 30, LEADS) & ~says(tail(b, 43), ("no", "not", "never", "neither", "nor", "without"))
        return F.exists(F.sequence(F.lit(0), F.size(parts) - 2), lambda k: _once(before(k), real))

    some = F.when(F.lower(s).rlike(pattern), _once(F.split(F.lower(s), pattern), mentioned)).otherwise(F.lit(False))
    return some & ~says(s, ("in case of", "in cases of", "in severe cases", "in rare cases"))


def _framed(text: Column) -> Column:
    """The sentences of a text, each with the clause that it goes on from."""
    goes_on = lambda s: s.rlike("^[a-z]") | s.rlike("(?i)^" + any_phrase(GOES_ON))
    pair = lambda s, f: F.struct(s.alias("s"), f.alias("frame"))
    empty = F.array().cast("array<struct<s:string,frame:string>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)["frame"]
        return F.concat(acc, F.array(pair(s, F.when(goes_on(s) & last.isNotNull(), F.concat(last, F.lit(" "), s)).otherwise(s))))

    return F.aggregate(sentences(F.coalesce(text, F.lit(""))), empty, step)


def _seen(x: Column) -> Column:
    """A framed sentence, whether it is read, and whether it says that no link was shown."""
    c = x["s"]
    read = (says(c, HARM) | says(c, ("hospitaliz", "hospitalis"), open_end=True)) & ~no_report(c)
    unlinked = chain(c, NOT_SHOWN, 60, LINKS) | says(c, each("no", ("", "direct", "confirmed", "established"), "link"))
    low = F.lower(c)
    linked = F.contains(low, F.lit("link")) | F.contains(low, F.lit("associat")) | F.contains(low, F.lit("connection"))
    return F.struct(c.alias("s"), x["frame"].alias("frame"), read.alias("read"), F.when(linked, unlinked).otherwise(F.lit(False)).alias("unlinked"))


def _counted(x: Column) -> Column:
    """The figure of illnesses of a sentence that is read, and what it denies."""
    c = x["s"]
    plain = F.regexp_replace(c, "(?i)" + any_phrase(QUALIFIED), "qualified")
    qualified = chain(c, QUALIFIED, 60, ("illness", "illnesses", "sick", "case-patient", "case-patients"))
    return F.struct(c.alias("s"), x["frame"].alias("frame"), x["unlinked"].alias("unlinked"), figures(c, COUNTS_ILLNESS).alias("figures"), qualified.alias("qualified"), chain(plain, DENYING, 80, ILL).alias("denied"))


def _judged(x: Column) -> Column:
    """What a sentence says of illness: whether it asserts or denies it, and of which product."""
    c, f, one = x["s"], x["frame"], F.size(x["figures"]) == 1
    in_words = (
        chain(c, (*CASES, "sick people"), 60, BEEN)
        | chain(c, ("several", "multiple", "numerous"), 24, ("illness", "illnesses"))
        | chain(c, ("associated with", "linked to"), 40, ("reported",), 40, ("illness", "illnesses", "salmonellosis", "listeriosis"))
        | chain(c, each(("outbreak", "outbreaks", "cluster", "clusters"), "of"), 60, ("illness", "illnesses", "infection", "infections"))
        | chain(c, ("receive", "receives", "received", "there have been", "there has been"), 40, ("report of", "reports of"), 30, ("illness", "illnesses", "sick"))
        | chain(c, tuple(PEOPLE), 60, DISEASES, 120, each(("have", "has"), "been", ("reported", "confirmed", "identified")))
    )
    silent = x["unlinked"] | (one & _joined(c))
    elsewhere = says(c, ("nationwide", "nationally")) | says(f, SUPPLIERS) | chain(f, ("may contain",), 80, ("recalled",)) | says(f, HEDGES)
    parts = {
        "s": c,
        "asserts": ~x["denied"] & ~(x["qualified"] & ~one) & ~silent & (one | in_words),
        "denies": x["denied"] & ~x["qualified"] & ~silent,
        "sure": chain(c, tuple(PEOPLE), 80, ATE) | chain(c, TIES, 80, OWN) | says(c, each("consumption of", ("these", "this", "the recalled", "the affected"))),
        "ours": says(c, ("exposure to",)) | ~elsewhere,
        "figures": x["figures"],
        "about": approximate(c),
        "h_said": _affirmed(c, HOSPITAL),
        "d_said": _affirmed(c, DEATH),
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _harmed(x: Column) -> Column:
    """The figures of hospitalisations and deaths of a sentence that affirms them."""
    held = [x[k].alias(k) for k in ("s", "asserts", "denies", "sure", "ours", "figures", "about", "h_said", "d_said")]
    return F.struct(*held, *[F.when(x[f"{k}_said"], figures(x["s"], shapes)).alias(f"{k}_figures") for k, shapes in (("h", COUNTS_HOSPITAL), ("d", COUNTS_DEATH))])


def illness_status(notices: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, illnesses, approximate, statements, hospitalizations, deaths) for each row of `notices` (C10), with its columns `keep`.

    kind is reported_count, reported_unspecified, explicit_none or unknown; hospitalizations and deaths are structs of kind, count and
    approximate, and never explicit_none. A sentence is read if it speaks of harm and is no advice, education or discovery. It asserts
    illness by a figure or in words, unless it denies it, shares its figure with another harm, says only that there are no
    more, or that no link was shown. It is about another product if it, or the clause that it goes on from, speaks of a supplier
    or hedges the link, or counts a country's cases, or the notice says that no link was shown; but not if people are
    said to have eaten the product or the sentence draws the link itself. One distinct figure is a count, several are none.
    Denials count wherever they stand, if nothing is asserted. Silence, null and empty texts are unknown. Rows may repeat.
    """
    # a notice is read inside of its row, in steps: what is unread is not looked at again, and no step computes a part twice
    by = notices.select(*keep, F.col(key).alias("key"), F.transform(_framed(F.col(text)), _seen).alias("x"))
    by = by.select(*keep, "key", F.exists("x", lambda x: x["unlinked"]).alias("unlinked"), F.transform(F.transform(F.transform(F.filter("x", lambda x: x["read"]), _counted), _judged), _harmed).alias("all"))
    own = lambda x: x["sure"] | (~F.col("unlinked") & x["ours"])
    by = by.withColumn("own", F.filter("all", own)).withColumn("asserted", F.filter("own", lambda x: x["asserts"])).withColumn("denials", F.filter("all", lambda x: x["denies"]))
    single = lambda rows, name: F.array_distinct(F.flatten(F.transform(rows, lambda x: x[name])))

    def harm(name: str) -> Column:
        said = F.filter("own", lambda x: x[f"{name}_said"])
        found = single(said, f"{name}_figures")
        count = F.when(F.size(found) == 1, F.get(found, 0))
        kind = F.when(F.size(said) == 0, "unknown").when(count.isNull(), "reported_unspecified").otherwise("reported_count")
        return F.struct(kind.alias("kind"), F.when(F.size(said) > 0, count).alias("count"), (count.isNotNull() & (F.size(said) > 0) & F.exists(said, lambda x: x["about"])).alias("approximate"))

    found = single(F.col("asserted"), "figures")
    some, none = F.size("asserted") > 0, F.size("denials") > 0
    count = F.when(some & (F.size(found) == 1), F.get(found, 0))
    kind = F.when(some, F.when(count.isNull(), "reported_unspecified").otherwise("reported_count")).when(none, "explicit_none").otherwise("unknown")
    texts = lambda rows, n: F.slice(F.transform(rows, lambda x: x["s"]), 1, n)
    statements = F.when(some, texts(F.col("asserted"), 3)).otherwise(texts(F.col("denials"), 2))
    return by.select(*keep, "key", kind.alias("kind"), count.alias("illnesses"), (count.isNotNull() & F.exists("asserted", lambda x: x["about"])).alias("approximate"), statements.alias("statements"), harm("h").alias("hospitalizations"), harm("d").alias("deaths"))


NONE_BEGINS = ("there have been no", "there has been no", *each("no", ("", "other", "additional", "further"), ("", "confirmed"), ("report", "reports", "illness", "illnesses", "adverse reaction", "adverse reactions", "injuries")), "not received any", "not aware of any")
NONE_ENDS = ("report", "confirm", "illness", "adverse", "injur", "associat", "received", "aware")


def illness_report(text: Column) -> Column:
    """Struct (status, statements): reported, none_reported or unknown, with up to three, one or no sentences behind it.

    A sentence reports harm if a number or several people are said to be ill, in hospital or dead, or harm has been reported, or
    reports of it are received; advice and discovery never do, nor does a sentence that says that there are none.
    """
    none = lambda s: chain(s, NONE_BEGINS, 200, NONE_ENDS, open_end=True)
    several = (*NUMBERS, "several", "multiple")
    harmed = ("sick people", "sick person", "sick persons", "ill", "illness", "illnesses", *HOSPITAL, *DEATH[:2], "case-patient", "case-patients")
    told = ("identified", "reported", "confirmed", "linked", "occurred")
    got = ("illness", "illnesses", "adverse", "injur", "sick")

    def reports(s: Column) -> Column:
        digits = F.regexp_replace(s, r"\b\d+\b", "several")
        said = (
            chain(digits, several, 120, harmed, 120, told, open_end=True)
            | chain(s, ("illness", "illnesses", "adverse reaction", "adverse reactions", "injury", "injuries", "hospitalization", "hospitalizations", "death", "deaths"), 80, BEEN)
            | chain(s, each(("received", "there are", "there have been"), ("report of", "reports of", "confirmed")), 60, got, open_end=True)
            | chain(digits, ("several",), 60, ("people", "person", "persons", "individuals"), 80, ("infected", "sickened"), 120, ("reported", "confirmed"))
            | chain(s, ("associated with",), 40, ("reported",), 60, ("illness", "illnesses", "salmonellosis", "listeriosis", "infection", "infections"))
            | chain(s, ("receive", "receives", "continues to receive"), 50, each(("adverse event", "illness", "injury"), "reports"))
            | chain(s, ("consumer", "consumers", "customer", "customers", "person", "persons", "individual", "individuals"), 60, ("reported",), 60, ("allergic reaction", "illness", "injur", "adverse"), open_end=True)
        )
        harm = says(s, (*ILL, "sick", *OTHER_HARMS, "adverse event", "adverse events", "death", "deaths", "case-patient", "case-patients", "infected", *each("infections", ("have", "has"), "been"))) | says(s, ("hospitaliz",), open_end=True)
        return harm & said & ~none(s)

    plain = F.filter(sentences(F.coalesce(text, F.lit(""))), lambda s: ~says(s, ADVICE) & ~says(s, DISCOVERY) & ~says(s, ("surveillance activit",), open_end=True))
    reported, denied = F.filter(plain, reports), F.filter(plain, none)
    give = lambda status, rows, n: F.struct(F.lit(status).alias("status"), F.slice(rows, 1, n).alias("statements"))
    return F.when(F.size(reported) > 0, give("reported", reported, 3)).when(F.size(denied) > 0, give("none_reported", denied, 1)).otherwise(give("unknown", denied, 1))


def case_status(statuses: DataFrame, case: str, newest: list[Column]) -> DataFrame:
    """(case, kind, illnesses, approximate, statements, hospitalizations, deaths) of each case from the statuses of its notices (C11).

    The newest notice that says something wins, in the order `newest`; hospitalisations and deaths go each by themselves. A denial over
    an older report is reported_unspecified with the statements of both; silence takes nothing back.
    """
    w = Window.partitionBy(case).orderBy(*newest)
    n = F.row_number().over(w)
    all_ = statuses.withColumn("_n", n)
    first = lambda value, when: F.min_by(value, F.when(when, F.col("_n")))
    told, reported = F.col("kind") != "unknown", F.col("kind").isin("reported_count", "reported_unspecified")
    row = F.struct("kind", "illnesses", "approximate", "statements")
    by = all_.groupBy(case).agg(first(row, told).alias("new"), first(F.col("statements"), reported).alias("old"), *[first(F.col(h), F.col(f"{h}.kind") != "unknown").alias(h) for h in ("hospitalizations", "deaths")])
    over = (F.col("new.kind") == "explicit_none") & F.col("old").isNotNull()
    nothing = F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("int").alias("count"), F.lit(False).alias("approximate"))
    return by.select(
        case,
        F.when(over, "reported_unspecified").otherwise(F.coalesce("new.kind", F.lit("unknown"))).alias("kind"),
        F.when(~F.coalesce(over, F.lit(False)), F.col("new.illnesses")).alias("illnesses"),
        F.coalesce(F.when(over, F.lit(False)).otherwise(F.col("new.approximate")), F.lit(False)).alias("approximate"),
        F.when(over, F.slice(F.concat("old", "new.statements"), 1, 3)).otherwise(F.coalesce("new.statements", F.array().cast("array<string>"))).alias("statements"),
        F.coalesce("hospitalizations", nothing).alias("hospitalizations"),
        F.coalesce("deaths", nothing).alias("deaths"),
    )

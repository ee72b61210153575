"""States in texts and lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.text import SPACE, _once

#: Postal codes and the names of the states.
STATES = dict(
    line.split(" ", 1)
    for line in """AL Alabama
AK Alaska
AZ Arizona
AR Arkansas
CA California
CO Colorado
CT Connecticut
DE Delaware
FL Florida
GA Georgia
HI Hawaii
ID Idaho
IL Illinois
IN Indiana
IA Iowa
KS Kansas
KY Kentucky
LA Louisiana
ME Maine
MD Maryland
MA Massachusetts
MI Michigan
MN Minnesota
MS Mississippi
MO Missouri
MT Montana
NE Nebraska
NV Nevada
NH New Hampshire
NJ New Jersey
NM New Mexico
NY New York
NC North Carolina
ND North Dakota
OH Ohio
OK Oklahoma
OR Oregon
PA Pennsylvania
RI Rhode Island
SC South Carolina
SD South Dakota
TN Tennessee
TX Texas
UT Utah
VT Vermont
VA Virginia
WA Washington
WV West Virginia
WI Wisconsin
WY Wyoming
DC District of Columbia
PR Puerto Rico""".split("\n")
)

#: What may link two codes of a list; a second "and" may follow.
LINKS = (",", "and", "or", "&")
#: Words of place before a code that stands alone.
PLACING = ("in", "to", "throughout", "across", "within")
#: Words that two names share, as in "North and South Carolina".
SIDES, SHARED = ("North", "South"), ("Carolina", "Dakota")


def _names() -> Column:
    return F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])


def state_of(token: Column) -> Column:
    """The state that a name in any case or a postal code in capitals stands for; null for anything else."""
    t = F.regexp_replace(F.regexp_replace(token, rf"\A{SPACE}+|{SPACE}+\z", ""), r"[.,;]+\z", "")
    full = F.create_map(*[F.lit(x) for n in STATES.values() for x in (n.lower(), n)])
    return F.coalesce(F.try_element_at(_names(), t), F.try_element_at(full, F.lower(t)))


def ordered_codes(codes: Column) -> Column:
    """The supported codes of an array, each once, in the order of the states' names."""
    by_name = F.array(*[F.lit(c) for c in sorted(STATES, key=STATES.get)])
    return F.filter(by_name, lambda c: F.array_contains(F.filter(codes, lambda x: x.isNotNull()), c))


def state_names(codes: Column) -> Column:
    """Names of the supported codes of an array, in order."""
    return F.transform(ordered_codes(codes), lambda c: F.try_element_at(_names(), c))


def states_in(text: Column) -> Column:
    """The states that a text names, in order; empty where it names none, null for a null text.

    The text is read as tokens: words (with the periods inside of D.C.), commas and other signs. A name is the longest
    run of up to three tokens that is one, so that no shorter name inside of it counts; "North and South Carolina" and
    "Washington, D.C." are read whole. A code is a token of two capitals that stands behind a comma, in a list of codes
    that are all states, or alone behind a word of place; before a capitalised word it is a direction or a name.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(text, SPACE, " "), F.lit(r"D\. ?C\.?(?![A-Za-z])|[A-Za-z]+|[0-9]+|[^A-Za-z0-9 ]"), F.lit(0))
    # the tokens are made once; each step names them for every token
    return _once(tokens, _states_of)


def _states_of(t: Column) -> Column:
    """`states_in` of the tokens of a text."""
    names = F.create_map(*[F.lit(x) for n in STATES.values() for x in (n, n)])
    at = F.sequence(F.lit(0), F.size(t) - 1)
    tok = lambda i: F.coalesce(F.get(t, i), F.lit(""))
    joined = lambda i, n: F.array_join(F.slice(t, i + 1, F.lit(n)), " ")
    code = lambda i: tok(i).rlike("^[A-Z]{2}$")
    capital = lambda i: tok(i).rlike("^[A-Z][a-z]")
    state = lambda i: F.try_element_at(_names(), tok(i))
    none = F.array().cast("array<string>")

    def longest(i: Column) -> Column:
        # a name begins with a capital
        return F.when(~tok(i).rlike("^[A-Z]"), 0).when(F.try_element_at(names, joined(i, 3)).isNotNull(), 3).when(F.try_element_at(names, joined(i, 2)).isNotNull(), 2).when(F.try_element_at(names, tok(i)).isNotNull(), 1).otherwise(0)

    def named(i: Column) -> Column:
        held = (F.when(i >= 1, longest(i - 1)).otherwise(0) > 1) | (F.when(i >= 2, longest(i - 2)).otherwise(0) > 2)
        after = F.when(tok(i + 1) == ",", tok(i + 2)).otherwise(tok(i + 1))
        capital_city = (tok(i) == "Washington") & F.regexp_replace(after, "[. ]", "").isin("DC")
        pair = tok(i).isin(*SIDES) & (tok(i + 1) == "and") & tok(i + 2).isin(*SIDES) & tok(i + 3).isin(*SHARED)
        both = F.array(F.concat_ws(" ", tok(i), tok(i + 3)), F.concat_ws(" ", tok(i + 2), tok(i + 3)))
        one = _once(longest(i), lambda n: F.when((n > 0) & ~held, F.array(F.try_element_at(names, joined(i, n)))))
        return F.when(capital_city, F.array(F.lit("District of Columbia"))).when(pair, both).otherwise(F.coalesce(one, none))

    def linked(i: Column) -> Column:
        """How many tokens stand between the code at i and the one that a link joins to it; 0: none does."""
        two = tok(i + 1).isin(*LINKS) & (tok(i + 2) == "and") & code(i + 3)
        return F.when(tok(i + 1).isin(*LINKS) & code(i + 2), 2).when(two, 3).otherwise(0)

    def step(acc: Column, i: Column) -> Column:
        """Codes of the run that goes on, and of the runs that have ended."""
        run = F.concat(acc["run"], F.array(i))
        more = F.struct(acc["done"].alias("done"), run.alias("run"))
        over = F.struct(F.concat(acc["done"], F.array(run)).alias("done"), F.array().cast("array<int>").alias("run"))
        return F.when(~code(i), acc).when(linked(i) > 0, more).otherwise(over)

    empty = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("run"))
    runs = F.aggregate(at, empty, step, lambda acc: acc["done"])

    def of_run(run: Column) -> Column:
        found = F.transform(run, state)
        first = F.get(run, 0)
        alone = F.when(tok(first - 1).isin(*PLACING) & ~capital(first + 1), F.array_compact(found)).otherwise(none)
        return F.when(F.size(run) > 1, F.when(F.forall(found, lambda x: x.isNotNull()), found).otherwise(none)).otherwise(alone)

    address = F.transform(F.filter(at, lambda i: code(i) & (tok(i - 1) == ",") & ~capital(i + 1)), state)
    some = F.when(F.exists(t, lambda x: x.rlike("^[A-Z]{2}$")), F.concat(F.flatten(F.transform(runs, of_run)), F.array_compact(address))).otherwise(none)
    found = F.concat(F.flatten(F.transform(at, named)), some)
    return F.when(F.size(t) == 0, none).otherwise(F.array_sort(F.array_distinct(found)))

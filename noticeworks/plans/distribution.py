"""Where products went by prose and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import geography as G
from noticeworks.operators import distribution as D
from noticeworks.plans.decided import pick
from noticeworks.plans.notices import CODES_BY_NAME, PLACES_SQL, _nth
from noticeworks.session import spread, table


def _notices(spark, sf):
    """A notice a part with three states in one of the wordings of announcements."""
    p, k = spread(table(spark, sf, "part").select("p_partkey", "p_name")), F.col("p_partkey")
    names = [G.STATES[c] for c in CODES_BY_NAME]
    a, b, c = _nth(names, k), _nth(names, k * 7 + 3), _nth(names, k * 11 + 5)
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    texts = (
        say("The ", F.col("p_name"), " was distributed to stores in ", a, " and ", b, ". It was found in ", c, "."),
        say("Products were sold nationwide at retail. Contact the firm in ", a, "."),
        say("It was shipped to the following states:\n", a, ", ", b, ".\n", c, ".\nCall 555-123-4567 for ", b, "."),
        say("It was sold at stores in ", a, ", except stores in ", b, "."),
        say("Products in ", a, " are not affected. The recall applies to stores in ", b, " and ", a, "."),
        say("Acme of Springfield, ", a, " is recalling it. A sample tested positive at a plant in ", b, "."),
        say("It was distributed through retailers. The firm has store locations in ", a, ".\nThe firm has store locations in ", b, "."),
        say("Made in ", a, "."),
    )
    return p.select("p_partkey", pick(k, *texts, None).alias("text"))


def c12_prose(spark, sf):
    d = D.distribution_prose(_notices(spark, sf), "p_partkey", "text")
    return d.select(F.col("key").alias("p_partkey"), F.array_join("states", "|").alias("states"), F.array_join("excluded", "|").alias("excluded"), F.size("sentences").alias("sentences"), F.col("nationwide").isNotNull().alias("nationwide"))


def c12_geography(spark, sf):
    k = F.col("key")
    said = D.distribution_prose(_notices(spark, sf), "p_partkey", "text").withColumn("said", F.struct("states", "excluded", "nationwide"))
    scope = pick(k, "unknown", "states", "nationwide")
    own = F.when(scope == "states", F.array(F.lit("Ohio"), _nth([G.STATES[c] for c in CODES_BY_NAME], k)))
    g = said.select(k.alias("p_partkey"), D.geography(scope, own, F.col("said"), F.when(k % 4 == 0, F.array(F.lit("Texas")))).alias("g"))
    return g.select("p_partkey", "g.scope", *[F.array_join(f"g.{c}", "|").alias(c) for c in ("states", "added", "removed", "contradicted")])


QUERIES = {f.__name__: f for f in (c12_prose, c12_geography)}

_SAID = f"""{PLACES_SQL},
w AS (SELECT *, p_partkey % 9 AS w FROM s),
d AS (SELECT p_partkey, n0, list_sort(list_distinct(CASE w WHEN 0 THEN [n0, n1] WHEN 2 THEN [n0, n1, n2] WHEN 3 THEN [n0] WHEN 4 THEN [n0, n1] WHEN 6 THEN [n0] ELSE [] END)) AS st,
  CASE w WHEN 3 THEN [n1] WHEN 4 THEN [n0] ELSE [] END AS ex, (CASE w WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 2 ELSE 0 END)::INTEGER AS sentences, w = 1 AS nationwide FROM w)"""

ORACLES = {
    "c12_prose": f"{_SAID} SELECT p_partkey, array_to_string(st, '|') AS states, array_to_string(ex, '|') AS excluded, sentences, nationwide FROM d",
    "c12_geography": f"""{_SAID},
g AS (SELECT *, p_partkey % 3 AS c, CASE WHEN p_partkey % 4 = 0 THEN ['Texas'] ELSE [] END AS t, CASE WHEN p_partkey % 3 = 1 THEN list_distinct(['Ohio', n0]) ELSE [] END AS own FROM d),
h AS (SELECT *, list_sort(list_distinct(list_filter(own || st || t, lambda x: NOT list_contains(ex, x)))) AS af, c = 2 AS nw, c = 0 AND len(t) = 0 AND nationwide AS ev FROM g)
SELECT p_partkey, CASE WHEN nw OR ev THEN 'nationwide' WHEN len(af) > 0 THEN 'states' ELSE 'unknown' END AS scope, CASE WHEN nw OR ev THEN '' ELSE array_to_string(af, '|') END AS states,
  CASE WHEN nw OR ev THEN '' ELSE array_to_string(list_filter(af, lambda x: NOT list_contains(own, x)), '|') END AS added, CASE WHEN nw OR ev THEN '' ELSE array_to_string(list_filter(list_distinct(own), lambda x: list_contains(ex, x)), '|') END AS removed,
  CASE WHEN nw OR ev THEN '' ELSE array_to_string(list_sort(list_filter(list_distinct(st || t), lambda x: list_contains(ex, x))), '|') END AS contradicted FROM h""",
}

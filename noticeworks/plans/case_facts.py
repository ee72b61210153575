"""Facts of cases and where they were sold."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import geography as G
from noticeworks.operators import case_facts as C
from noticeworks.plans.decided import pick
from noticeworks.plans.notices import CODES_BY_NAME, _nth
from noticeworks.session import table


def _pages(spark, sf):
    """A page an order: a table, a list or neither with the order's products, then prose with codes of its own and of the first product."""
    x = table(spark, sf, "lineitem").where("l_linenumber <= 3")
    one = F.struct("l_linenumber", F.concat(F.lit("Item "), F.col("l_partkey").cast("string"), F.lit(" Soup")).alias("p"), F.concat(F.lit("L"), F.col("l_partkey").cast("string"), F.lit("B")).alias("lot"))
    o = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(one)).alias("x"))
    k = F.col("l_orderkey")
    each = lambda f: F.array_join(F.transform("x", f), "")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    tab = say("<table><tr><th>Product</th><th>Lot Code</th></tr>", each(lambda s: say("<tr><td>", s["p"], "</td><td>", s["lot"], "</td></tr>")), "</table>")
    items = say("<ul>", each(lambda s: say("<li>", s["p"], ", lot ", s["lot"], "</li>")), "</ul>")
    prose = say("<p>", F.col("x")[0]["p"], ", lot ", F.col("x")[0]["lot"], ". Packages bear lot number Q", k.cast("string"), ".</p>")
    page = F.concat(F.when(k % 4 < 2, tab).otherwise(F.lit("")), F.when(k % 2 == 0, items).otherwise(F.lit("")), prose)
    return o.select("l_orderkey", page.alias("html"))


def x34_case_facts(spark, sf):
    return C.case_facts(_pages(spark, sf), "l_orderkey", "html").withColumnRenamed("key", "l_orderkey")


def x35_sold_at(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    names = [G.STATES[c] for c in CODES_BY_NAME]
    a, b = _nth(names, k), _nth(names, k * 7 + 3)
    shop = F.initcap("p_name")
    retailers = F.when(k % 5 > 0, F.array(shop, F.upper(a), F.lit("Web Shop"), F.upper(shop), F.lit("TX"), F.lit("Springfield"), F.lit(None), F.concat(shop, F.lit(" 2"))))
    s = C.sold_at(retailers, F.when(k % 2 == 0, F.array(F.lit("web-shop"))), F.when(k % 3 == 0, F.array(F.lit("Springfield"))), F.array(F.lit("Online"), F.lit("moon"), F.lit("Retail Stores")), pick(k, "nationwide", "states", "unknown"), F.when(k % 4 == 1, F.array(b, a, b)))
    return p.select("p_partkey", s.alias("s")).select("p_partkey", "s.scope", *[F.array_join(f"s.{c}", "|").alias(c) for c in ("retailers", "platforms", "channels", "states")])


QUERIES = {f.__name__: f for f in (x34_case_facts, x35_sold_at)}

ORACLES = {
    "x34_case_facts": """
WITH d AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, 'Item ' || l_partkey || ' Soup' AS p, 'L' || l_partkey || 'B' AS lot FROM lineitem WHERE l_linenumber <= 3),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, lot) AS r FROM d),
s AS (SELECT *, CASE WHEN k % 4 < 2 THEN 'table' WHEN k % 2 = 0 THEN 'list' ELSE 'prose' END AS source FROM x),
f AS (SELECT k, p AS product, 'lot' AS concept, lot AS value, source FROM s WHERE source <> 'prose' OR r = 1
  UNION ALL SELECT k, p, 'variant', p, source FROM s WHERE source = 'table'
  UNION ALL SELECT DISTINCT k, NULL, 'lot', 'Q' || k, 'prose' FROM s)
SELECT DISTINCT k AS l_orderkey, product, concept, value, source, NULL::VARCHAR AS paired_date FROM f""",
    "x35_sold_at": "WITH n AS (SELECT [" + ", ".join(f"'{G.STATES[c]}'" for c in CODES_BY_NAME) + """] AS n),
p AS (SELECT p_partkey AS k, list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) AS shop, n[(p_partkey % 52) + 1] AS a, n[((p_partkey * 7 + 3) % 52) + 1] AS b FROM part, n)
SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 'nationwide' WHEN k % 4 = 1 THEN 'states' ELSE 'unspecified' END AS scope,
  CASE WHEN k % 5 > 0 THEN shop || CASE WHEN k % 2 = 0 THEN '' ELSE '|Web Shop' END || CASE WHEN k % 3 = 0 THEN '' ELSE '|Springfield' END || '|' || shop || ' 2' ELSE '' END AS retailers,
  CASE WHEN k % 2 = 0 THEN 'web-shop' ELSE '' END AS platforms, 'retail stores|online' AS channels, CASE WHEN k % 4 = 1 THEN CASE WHEN a = b THEN a ELSE least(a, b) || '|' || greatest(a, b) END ELSE '' END AS states FROM p""",
}

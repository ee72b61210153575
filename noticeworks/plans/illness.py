"""Illness reports and statuses of notices, and of cases over their notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.functions import illness
from noticeworks.plans.decided import pick
from noticeworks.session import spread, table


def _notices(spark, sf):
    """A notice an order: one of several statements with numbers of the order, among sentences that say nothing of illness."""
    o, k = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")), F.col("o_orderkey")
    n, m = (k % 11 + 1).cast("string"), (k % 5 + 20).cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    said = pick(
        k,
        say("To date, ", n, " illnesses have been reported."),
        say("No illnesses have been reported to date by customer ", F.col("o_custkey").cast("string"), "."),
        say("Approximately ", m, " reports of illnesses were received, with ", n, " hospitalizations and no deaths."),
        say("FSIS has received no additional reports of injury or illness. The firm knows of ", m, " cases of product."),
        say("The lot was supplied by Acme, which was linked to ", n, " illnesses."),
        say("Several illnesses have been reported; ", m, " deaths have been confirmed in ", n, " states."),
        say("Salmonella can cause illness in ", m, " people of 100."),
        say(n, " illnesses were reported in May. ", m, " illnesses were reported in June."),
        None,
    )
    before = F.concat(F.lit("The firm recalls order "), k.cast("string"), F.lit(". The problem was discovered during a check of illness complaints. "))
    return o.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.concat(before, said).alias("text"))


def c10_illness_status(spark, sf):
    s = illness.illness_status(_notices(spark, sf), "o_orderkey", "text")
    return s.select(F.col("key").alias("o_orderkey"), "kind", "illnesses", "approximate", F.size("statements").alias("statements"), F.col("hospitalizations.kind").alias("hospital"), F.col("hospitalizations.count").alias("hospitalized"), F.col("deaths.kind").alias("death"), F.col("deaths.count").alias("died"))


def c9_illness_report(spark, sf):
    r = illness.illness_report(F.col("text"))
    return _notices(spark, sf).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.status", F.size("r.statements").alias("statements"))


def c10_case_status(spark, sf):
    """The status of a customer from the notices of its orders."""
    s = illness.illness_status(_notices(spark, sf), "o_orderkey", "text", ("o_custkey", "day")).withColumnRenamed("key", "o_orderkey")
    found = illness.case_status(s, "o_custkey", [F.desc("day"), F.desc("o_orderkey")])
    return found.select("o_custkey", "kind", "illnesses", F.col("hospitalizations.count").alias("hospitalized"), F.col("deaths.count").alias("died"))


QUERIES = {f.__name__: f for f in (c10_illness_status, c9_illness_report, c10_case_status)}

_STATUS = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS day, (o_orderkey % 11 + 1)::INT AS n, (o_orderkey % 5 + 20)::INT AS m, (o_orderkey % 9)::INT AS w FROM orders),
s AS (SELECT k, c, day, CASE w WHEN 0 THEN 'reported_count' WHEN 1 THEN 'explicit_none' WHEN 2 THEN 'reported_count' WHEN 5 THEN 'reported_unspecified' WHEN 7 THEN 'reported_unspecified' ELSE 'unknown' END AS kind,
  CASE w WHEN 0 THEN n WHEN 2 THEN m END AS illnesses, w = 2 AS approximate, CASE w WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS statements,
  CASE w WHEN 2 THEN 'reported_count' ELSE 'unknown' END AS hospital, CASE w WHEN 2 THEN n END AS hospitalized, CASE w WHEN 5 THEN 'reported_count' ELSE 'unknown' END AS death, CASE w WHEN 5 THEN m END AS died FROM o)"""

ORACLES = {
    "c10_illness_status": f"{_STATUS} SELECT k AS o_orderkey, kind, illnesses, approximate, statements, hospital, hospitalized, death, died FROM s",
    "c9_illness_report": """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'reported' WHEN 1 THEN 'none_reported' WHEN 3 THEN 'none_reported' WHEN 5 THEN 'reported' WHEN 7 THEN 'reported' ELSE 'unknown' END AS status,
  CASE o_orderkey % 9 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS statements FROM orders""",
    "c10_case_status": f"""{_STATUS},
a AS (SELECT c, first(kind ORDER BY day DESC, k DESC) FILTER (kind <> 'unknown') AS kind, first(illnesses ORDER BY day DESC, k DESC) FILTER (kind <> 'unknown') AS illnesses, count(*) FILTER (kind LIKE 'reported%') AS reports,
  first(hospitalized ORDER BY day DESC, k DESC) FILTER (hospital <> 'unknown') AS hospitalized, first(died ORDER BY day DESC, k DESC) FILTER (death <> 'unknown') AS died FROM s GROUP BY c)
SELECT c AS o_custkey, CASE WHEN kind IS NULL THEN 'unknown' WHEN kind = 'explicit_none' AND reports > 0 THEN 'reported_unspecified' ELSE kind END AS kind, CASE WHEN kind = 'reported_count' THEN illnesses END AS illnesses, hospitalized, died FROM a""",
}

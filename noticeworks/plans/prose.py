"""Identifiers in prose and lists with their owners, and the facts that they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.operators import notices as N
from noticeworks.operators import prose as P
from noticeworks.session import table


def _items(spark, sf):
    """An order's line items, each as a sentence and a list item in one of three wordings."""
    x, k = table(spark, sf, "lineitem"), F.col("l_partkey")
    part, upc = F.concat(F.lit("Part Number Nine "), k.cast("string")), F.lpad(k.cast("string"), 12, "0")
    lot, day = F.concat(F.lit("L"), F.col("l_suppkey").cast("string"), F.lit("A")), F.date_format("l_shipdate", "MM/dd/yyyy")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    said = F.when(k % 3 == 0, say(part, ", UPC: ", upc, ", Lot codes ", lot, " and ", lot, "2, Best By ", day, " printed on the box.")).when(
        k % 3 == 1, say("The recalled packages are marked with lot number ", lot, "; item code none.")
    ).otherwise(say(part, " (UPC ", F.substring(upc, 1, 6), " ", F.substring(upc, 7, 6), ") with Sell by dates of ", day, " or later"))
    return x.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", said.alias("s")))), lambda r: r["s"]).alias("said"))


def x27_prose(spark, sf):
    o = _items(spark, sf).select("l_orderkey", F.array_join("said", "\n").alias("text"))
    found = P.prose_identifiers(o, "l_orderkey", "text")
    return found.select(F.col("key").alias("l_orderkey"), "owner", "concept", "value", "paired_date")


def x26_lists(spark, sf):
    o = _items(spark, sf).select("l_orderkey", F.concat(F.lit("<p>Lots 1</p><ul>"), F.array_join(F.transform("said", lambda s: F.concat(F.lit("<li><b>"), s, F.lit("</b>"))), ""), F.lit("</ul>")).alias("html"))
    found = P.listed_identifiers(o, "l_orderkey", "html")
    facts = found.select("key", F.col("place").alias("pos"), "concept", F.col("value").alias("display"), F.col("value").alias("raw"), F.col("value").alias("canonical"), F.col("value").alias("sort_key"), F.col("label").alias("source_label"), F.lit(True).alias("valid"))
    out = N.aggregate_facts(facts.withColumnRenamed("key", "case_id"), ("upc", "lot", "best_by", "sell_by"), (), ())
    return out.select(F.col("case_id").alias("l_orderkey"), "concept", "place", F.array_join("shown", "|").alias("shown"))


QUERIES = {f.__name__: f for f in (x27_prose, x26_lists)}

_FOUND = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_suppkey, 'Part Number Nine ' || l_partkey AS owner, lpad(l_partkey::VARCHAR, 12, '0') AS upc, 'L' || l_suppkey || 'A' AS lot, strftime(l_shipdate, '%m/%d/%Y') AS day,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
v AS (SELECT l_orderkey, n, owner, unnest(['upc', 'lot', 'lot', 'best_by']) AS concept, unnest([upc, lot, lot || '2', day]) AS value, unnest([NULL, day, day, NULL]) AS paired_date, unnest([1, 2, 3, 4]) AS i FROM x WHERE k % 3 = 0
  UNION ALL SELECT l_orderkey, n, NULL, 'lot', lot, NULL, 1 FROM x WHERE k % 3 = 1
  UNION ALL SELECT l_orderkey, n, owner, unnest(['upc', 'sell_by']), unnest([upc, day]), NULL, unnest([1, 2]) FROM x WHERE k % 3 = 2),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, owner, concept, value ORDER BY n, i) AS r FROM v)"""

ORACLES = {
    "x27_prose": f"{_FOUND} SELECT l_orderkey, owner, concept, value, paired_date FROM f WHERE r = 1",
    "x26_lists": f"""{_FOUND}, g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, concept, value ORDER BY n, i) AS q FROM f WHERE r = 1)
SELECT l_orderkey, concept, CASE concept WHEN 'upc' THEN 1 WHEN 'lot' THEN 2 WHEN 'best_by' THEN 3 ELSE 4 END AS place, string_agg(value, '|' ORDER BY n, i) AS shown FROM g WHERE q = 1 GROUP BY l_orderkey, concept""",
}

"""Feed queries: filters, tiers, sections, pages, search (P*, C1, C2, C18, T*, W5, X5, X8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from noticeworks.functions import classify, search
from noticeworks.session import table

NOW = "2024-01-30"


def p7_location_filter(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    scope = F.when(F.col("c_mktsegment") == "BUILDING", "nationwide").otherwise("states")
    tier = classify.location_tier(F.array("n_name"), scope, ["FRANCE", "KENYA", "BRAZIL", "NATION_3", "NATION_7"])
    return j.select("c_custkey", "r_name", tier.alias("match_tier")).where("match_tier is not null")


def c1_risk_tier(spark, sf):
    o = table(spark, sf, "orders")
    cls = F.when(F.substr("o_orderpriority", F.lit(1), F.lit(1)) == "1", "I").when(F.substr("o_orderpriority", F.lit(1), F.lit(1)).isin("2", "3"), "II").when(F.substr("o_orderpriority", F.lit(1), F.lit(1)) == "4", "III")
    sets = o.groupBy("o_custkey").agg(F.collect_set(cls).alias("classes"), F.bool_or(F.col("o_orderstatus") == "P").alias("pending"))
    tier = classify.risk_tier(F.col("classes"), F.col("pending"))
    return sets.select("o_custkey", tier.alias("tier"), classify.tier_rank(tier).alias("tier_rank"), classify.class_set_key(F.col("classes")).alias("class_key"))


def w5_recency_sections(spark, sf):
    e = table(spark, sf, "events")
    day = F.max(F.when(F.col("event_type") != "view", F.to_date("ts")))
    first = e.groupBy("user_id").agg(day.alias("activity"), F.min(F.to_date("ts")).alias("published"))
    act = F.greatest("activity", "published")
    return first.select("user_id", F.date_format(act, "yyyy-MM-dd").alias("activity_day"), classify.activity_section(act, NOW, 10).alias("section"))


def t1_feed_rank(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def t3_keyset_page(spark, sf):
    o = table(spark, sf, "orders")
    return o.where("o_orderkey > 1000").orderBy("o_orderkey").limit(250).select("o_orderkey", "o_custkey", "o_orderstatus")


def t5_nulls_first(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last")), F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.orderBy(F.asc_nulls_first("last"), "c_custkey").limit(50).select("c_custkey", "last")


def x8_search(spark, sf):
    p = table(spark, sf, "part")
    body, codes = search.entry([F.col("p_name"), F.col("p_type")], [F.concat_ws(" ", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 8, "0"))])
    return p.where(search.matches(body, codes, search.parse_query("ring small"))).select("p_partkey", body.alias("search_text"))


def p9_category_filter(spark, sf):
    p = table(spark, sf, "part")
    cats = F.when(F.col("p_size") % 3 != 0, F.array("p_type", F.substring_index("p_name", " ", -1)))
    keep = F.coalesce(F.arrays_overlap(cats, F.array(F.lit("PROMO"), F.lit("ring"), F.lit("gone"))), F.lit(False))
    return p.where(keep).select("p_partkey", F.array_join(cats, "|").alias("categories"))


def w7_ready_preview(spark, sf):
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderstatus") == "O", 0).otherwise(1), "o_orderkey")
    r = o.withColumn("rn", F.row_number().over(w))
    return r.where("rn <= 4").select("o_custkey", "o_orderkey", F.when(F.col("rn") <= 3, "readable").otherwise("locked").alias("state"))


QUERIES = {f.__name__: f for f in (p7_location_filter, c1_risk_tier, w5_recency_sections, t1_feed_rank, t3_keyset_page, t5_nulls_first, x8_search, p9_category_filter, w7_ready_preview)}

ORACLES = {
    "p7_location_filter": """
SELECT c_custkey, r_name, CASE WHEN n_name IN ('FRANCE','KENYA','BRAZIL','NATION_3','NATION_7') THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 END AS match_tier
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE n_name IN ('FRANCE','KENYA','BRAZIL','NATION_3','NATION_7') OR c_mktsegment = 'BUILDING'""",
    "c1_risk_tier": """
WITH k AS (SELECT o_custkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'I' WHEN '2' THEN 'II' WHEN '3' THEN 'II' WHEN '4' THEN 'III' END AS cls, o_orderstatus FROM orders),
s AS (SELECT o_custkey, coalesce(list_distinct(list(cls) FILTER (cls IS NOT NULL)), []) AS c, bool_or(o_orderstatus = 'P') AS p FROM k GROUP BY o_custkey),
t AS (SELECT *, CASE WHEN list_contains(c, 'I') AND len(c) = 1 THEN 'critical' WHEN list_contains(c, 'I') THEN 'very_high'
  WHEN list_contains(c, 'II') AND list_contains(c, 'III') THEN 'moderate' WHEN list_contains(c, 'II') THEN 'high' WHEN list_contains(c, 'III') THEN 'low'
  WHEN p THEN 'pending' ELSE 'unknown' END AS tier FROM s)
SELECT o_custkey, tier, CASE tier WHEN 'critical' THEN 1 WHEN 'very_high' THEN 2 WHEN 'high' THEN 3 WHEN 'moderate' THEN 4 WHEN 'low' THEN 5 END AS tier_rank,
  array_to_string(list_filter(['I','II','III'], lambda x: list_contains(c, x)), '+') AS class_key FROM t""",
    "w5_recency_sections": """
WITH f AS (SELECT user_id, max(CASE WHEN event_type <> 'view' THEN ts::DATE END) AS a, min(ts::DATE) AS p FROM events GROUP BY user_id)
SELECT user_id, strftime(greatest(a, p), '%Y-%m-%d') AS activity_day,
  CASE WHEN date_diff('day', greatest(a, p), DATE '2024-01-30') <= 10 THEN 'recent' ELSE 'older' END AS section FROM f""",
    "t1_feed_rank": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "t3_keyset_page": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 250",
    "t5_nulls_first": """
SELECT c_custkey, last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
ORDER BY last ASC NULLS FIRST, c_custkey LIMIT 50""",
    "x8_search": """
WITH t AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS search_text FROM part)
SELECT p_partkey, search_text FROM t WHERE contains(search_text, 'ring') AND contains(search_text, 'small')""",
    "p9_category_filter": """
SELECT p_partkey, p_type || '|' || string_split(p_name, ' ')[-1] AS categories FROM part
WHERE p_size % 3 <> 0 AND (p_type = 'PROMO' OR string_split(p_name, ' ')[-1] = 'ring')""",
    "w7_ready_preview": """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN rn <= 3 THEN 'readable' ELSE 'locked' END AS state FROM r WHERE rn <= 4""",
}

"""Decisions and text readers over columns made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions import identifiers, relevance, text
from noticeworks.operators import decisions as D
from noticeworks.session import table

NOW = "2024-01-30"


def pick(key: Column, *values: str | None) -> Column:
    """`values` in turn by `key`."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))


def _turn(key: str, *values: str | None) -> str:
    """The same in SQL."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


AGENTS = ("undeclared milk", "Undeclared soybeans, almonds, and/or pecans", "milk", "undeclared zinc or wheat.", None)
FAMILIES = ("milk", "soy|tree nuts", "", "wheat", "")
HAZARDS = ("Possible LISTERIA found", "high lead levels", "asbestos is a mineral", "potential to be contaminated with asbestos", "may contain elevated levels of thallium", "asbestos or lead contamination", None)
NAMED = ("Listeria", "lead", None, "asbestos", "thallium", "lead", None)
SIZES = ("12 oz. bag, 1.5-lb tray; 12oz cup of 4 grams", "6 fl. oz bottle", "no size", "2 kg and 2 kg")
SIZE_SETS = ("12oz|1.5lb", "6floz", "", "2kg")
DATES = ("2024-02-29", "02/30/2024", "12/31/2023", "20240115", "soon", None)
DAYS = ("2024-02-29", None, "2023-12-31", "2024-01-15", None, None)
VERSIONS = ("1.10.0", "1.9", "2", "x.1", "1.9.3")
AT_LEAST = ("true", "false", "true", "false", "true")


def c3_agents(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", pick(F.col("p_partkey"), *HAZARDS).alias("t"))
    return p.select("p_partkey", F.coalesce(relevance.pathogen(F.col("t")), relevance.chemical_agent(F.col("t"))).alias("agent"))


def c5_allergens(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(relevance.allergen_tokens(pick(F.col("p_partkey"), *AGENTS)), "|").alias("families"))


def c7_hazard(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    why = F.array_compact(F.array(pick(k, "Product Contamination", "Misbranding", None, "Insanitary Conditions", "Processing Defect"), F.when(k % 11 == 0, "Unreported Allergens"), F.when(k % 13 == 0, "Import Violation")))
    said = pick(k, *HAZARDS)
    return o.select("o_orderkey", relevance.hazard_category(why, said, k % 3 == 0, F.when(k % 4 != 0, k % 4 == 1)).alias("hazard"))


def c16_categories(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    given = F.array(pick(k, "other", "seafood", "gone"), pick(k, "produce", "other", None, "seafood"))
    return p.select("p_partkey", F.array_join(relevance.in_display_order(given), "|").alias("categories"))


def c20_open(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    return e.select("event_id", relevance.confirmed_open(pick(k, "FSIS", "FDA"), pick(k, "recall", "recall", "alert"), pick(k, "active", "active", "active", "closed"), F.when(k % 9 != 0, F.to_date("ts")), F.lit(NOW).cast("timestamp")).alias("open"))


def c22_entitlement(spark, sf):
    e = table(spark, sf, "events")
    k, now = F.col("event_id"), F.lit(NOW).cast("timestamp")
    status = pick(k, "active", "inactive", "active", None, "active", "unknown")
    expires = F.when(k % 4 != 0, F.col("ts") + F.expr("INTERVAL 20 DAYS"))
    checked = F.when(k % 17 != 0, F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    since = F.when(k % 19 != 0, F.lit("2024-01-10").cast("timestamp"))
    verdict = D.entitlement_verdict(status, expires, checked, since, F.col("ts"), now, 24 * 15)
    return e.select("event_id", verdict.alias("verdict"), D.needs_refresh(status, expires, checked, now, 24 * 12).alias("refresh"))


def c23_delivery(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    where = F.when(k % 10 != 0, F.when(k % 3 == 0, c + 1).otherwise(c))
    verdict = D.delivery_decision(pick(k, "initial", "update"), c, where, F.when(k % 23 == 0, c), k % 7 == 0, pick(k, "active", "active", "retracted", "active", None), k % 4 == 2)
    return o.select("o_orderkey", verdict.alias("decision"))


def v16_duplicates(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    names = ("slug", "hazard", "near", "body", "title", "expansion", "within", "upc", "product", "expansion_body", "revision", "revision_body")
    bits = [F.when(k % 29 != 0, F.shiftright((k * 2654435761) % 4294967296, i + 8) % 2 == 1).alias(n) for i, n in enumerate(names)]
    return o.select("o_orderkey", F.struct(*bits).alias("s")).select("o_orderkey", D.duplicate_verdict("s").alias("verdict"))


def a15_job_health(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "lease_skip").otherwise("partial").alias("outcome"))
    return D.job_health(e.where("user_id % 5 <> 0 or outcome <> 'success'"), "user_id", "ts", "outcome", F.lit("2024-01-31").cast("timestamp"), 72.0, 30.0)


def j13_candidates(spark, sf):
    """Even orders as notices that name a supplier, odd ones as cases of one."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    firm = F.concat(F.lit("supplier"), F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 2 == 0, " foods").otherwise(""))
    said = F.concat_ws(" ", F.lit("notice of"), firm, F.lit("foods ring bolt"))
    notices = o.where(k % 2 == 0).select(k.alias("notice_id"), F.to_date("o_orderdate").alias("notice_date"), said.alias("text"), F.array(F.lit("ring"), pick(F.col("o_custkey"), "bolt", "widget")).alias("products"))
    cases = o.where(k % 2 == 1).select(k.alias("case_id"), F.to_date("o_orderdate").alias("published"), firm.alias("firm"), F.array(pick(k, "widget", "ring", "nut")).alias("products"))
    return D.agency_candidates(notices, cases)


def w6_merged(spark, sf):
    e = table(spark, sf, "events")
    one = e.where("event_type = 'click'").select(F.to_date("ts").alias("day"), (F.col("event_id") % 7).alias("rank"), F.lit("case").alias("side"))
    two = e.where("event_type = 'view'").select(F.to_date("ts").alias("day"), (F.col("event_id") % 7).alias("rank"), F.lit("notice").alias("side"))
    both = D.merge_sections(one, two, [F.desc("day"), F.desc("rank")]).limit(50)
    return both.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "rank", "side").agg(F.count(F.lit(1)).alias("n"))


def p13_report(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    states = F.when(k % 7 != 0, F.array(pick(k, "OH", "IA"), F.lit("TX")))
    problem = relevance.report_problem(k % 10 != 0, pick(k, "nationwide", "states", "unknown", "states"), states, F.array(F.lit("Big Mart")), pick(k, "TX", "CA", "OH"), pick(k, "Big Mart", None, "Corner"), pick(k, "week", "month", "ever", None), ("week", "month"))
    return c.select("c_custkey", problem.alias("problem"))


def p17_mismatch(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    hit = relevance.allergen_mismatch(pick(k, "allergen", "allergen", "microbial"), pick(k, "label", "Salmonella", "label", None), pick(k, *AGENTS), F.array(pick(k, "egg", "milk", "soy")))
    return p.select("p_partkey", hit.alias("mismatch"))


def u3_names(spark, sf):
    p = table(spark, sf, "part")
    first = F.array(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" ")), F.col("p_name"))
    return p.select("p_partkey", F.array_join(D.merge_names(first, F.array(F.lower("p_type"), F.lit(""), F.lit("Ring"))), "|").alias("names"))


def i4_dates(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.date_format(identifiers.notice_date(pick(F.col("p_partkey"), *DATES)), "yyyy-MM-dd").alias("day"))


def i8_sizes(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(identifiers.size_tokens(pick(F.col("p_partkey"), *SIZES)), "|").alias("sizes"), F.size(identifiers.unverified_sizes(pick(F.col("p_partkey"), *SIZES), F.lit("12-oz bag, 2 kg"))).alias("unverified"))


def x32_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


def x33_versions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.version_at_least(pick(F.col("p_partkey"), *VERSIONS), "1.9.3").alias("enough"))


QUERIES = {f.__name__: f for f in (c3_agents, c5_allergens, c7_hazard, c16_categories, c20_open, c22_entitlement, c23_delivery, v16_duplicates, a15_job_health, j13_candidates, w6_merged, p13_report, p17_mismatch, u3_names, i4_dates, i8_sizes, x32_urls, x33_versions)}

_BITS = ("slug", "hazard", "near", "body", "title", "expansion", "within_", "upc", "product", "expansion_body", "revision", "revision_body")

ORACLES = {
    "c3_agents": f"SELECT p_partkey, {_turn('p_partkey', *NAMED)} AS agent FROM part",
    "c5_allergens": f"SELECT p_partkey, {_turn('p_partkey', *FAMILIES)} AS families FROM part",
    "c7_hazard": f"""
WITH o AS (SELECT o_orderkey AS k, {_turn('o_orderkey', 'Product Contamination', 'Misbranding', None, 'Insanitary Conditions', 'Processing Defect')} AS r, {_turn('o_orderkey', *NAMED)} AS agent FROM orders),
f AS (SELECT *, k % 11 = 0 AS unreported, k % 13 = 0 AS import, k % 3 = 0 AS allergen, k % 4 = 1 AS foreign_ FROM o)
SELECT k AS o_orderkey, CASE WHEN unreported THEN 'allergen' WHEN r = 'Product Contamination' THEN CASE WHEN agent = 'Listeria' THEN 'microbial_contamination' WHEN foreign_ THEN 'foreign_material'
    WHEN allergen AND (agent IS NULL OR agent = 'Listeria') THEN 'allergen' ELSE 'unknown' END
  WHEN r = 'Insanitary Conditions' THEN 'other_regulatory' WHEN r = 'Processing Defect' THEN 'product_integrity'
  WHEN r = 'Misbranding' AND NOT import AND allergen THEN 'allergen' WHEN r = 'Misbranding' OR import THEN 'other_regulatory' WHEN r IS NULL AND allergen THEN 'allergen' ELSE 'unknown' END AS hazard FROM f""",
    "c16_categories": f"""
WITH p AS (SELECT p_partkey, {_turn('p_partkey', 'other', 'seafood', 'gone')} AS a, {_turn('p_partkey', 'produce', 'other', None, 'seafood')} AS b FROM part)
SELECT p_partkey, array_to_string(list_filter(['produce', 'seafood', 'other'], lambda x: x = a OR coalesce(x = b, false)), '|') AS categories FROM p""",
    "c20_open": """
SELECT event_id, (event_id % 2 = 0 AND event_id % 3 <> 2 AND event_id % 4 <> 3) OR (event_id % 2 = 1 AND event_id % 9 <> 0 AND date_diff('day', ts::DATE, DATE '2024-01-30') <= 21) AS open FROM events""",
    "c22_entitlement": f"""
WITH e AS (SELECT event_id AS k, ts, {_turn('event_id', 'active', 'inactive', 'active', None, 'active', 'unknown')} AS st, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 20 DAY END AS ex,
  CASE WHEN event_id % 17 <> 0 THEN ts + INTERVAL 10 DAY END AS ch, CASE WHEN event_id % 19 <> 0 THEN TIMESTAMP '2024-01-10' END AS si FROM events),
a AS (SELECT *, epoch(TIMESTAMP '2024-01-30') - floor(epoch(ch)) AS age, floor(epoch(ex)) - epoch(TIMESTAMP '2024-01-30') AS rest FROM e)
SELECT k AS event_id, CASE WHEN st = 'active' AND ex <= TIMESTAMP '2024-01-30' THEN 'expired' WHEN st IS NULL OR st = 'unknown' OR ch IS NULL OR age > 1296000 THEN 'unverified' WHEN st = 'inactive' THEN 'inactive'
  WHEN si IS NULL OR ts < si THEN 'before_entitlement' ELSE 'entitled' END AS verdict,
  st IS NULL OR st = 'unknown' OR ch IS NULL OR age >= 1036800 OR coalesce(st = 'active' AND rest < 1036800, false) AS refresh FROM a""",
    "c23_delivery": f"""
WITH o AS (SELECT o_orderkey AS k, {_turn('o_orderkey', 'active', 'active', 'retracted', 'active', None)} AS st FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 10 = 0 OR k % 23 = 0 THEN 'unresolved' WHEN k % 3 = 0 AND (k % 2 = 0 OR k % 7 = 0) THEN 'merged_duplicate'
  WHEN st IS DISTINCT FROM CASE WHEN k % 4 = 2 THEN 'retracted' ELSE 'active' END THEN 'lifecycle' WHEN k % 3 = 0 THEN 'reroute' ELSE 'deliver' END AS decision FROM o""",
    "v16_duplicates": f"""
WITH b AS (SELECT o_orderkey AS k, {', '.join(f"o_orderkey % 29 <> 0 AND (((o_orderkey * 2654435761) % 4294967296) >> {i + 8}) % 2 = 1 AS {n}" for i, n in enumerate(_BITS))} FROM orders)
SELECT k AS o_orderkey, CASE WHEN hazard AND ((slug AND near AND body) OR (expansion AND within_ AND (upc OR product) AND expansion_body) OR (revision AND within_ AND upc AND revision_body)) THEN 'deterministic'
  WHEN hazard AND near AND (slug OR (expansion AND (product OR upc)) OR (revision AND upc) OR (title AND body)) THEN 'review' ELSE 'distinct' END AS verdict FROM b""",
    "a15_job_health": """
WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'lease_skip' ELSE 'partial' END AS o FROM events),
r AS (SELECT *, max(CASE WHEN o = 'success' THEN ts END) OVER (PARTITION BY user_id) AS ok, arg_max(o, ts) OVER (PARTITION BY user_id) AS last FROM e WHERE user_id % 5 <> 0 OR o <> 'success'),
g AS (SELECT user_id, ok, last, count(*) FILTER (ok IS NULL OR ts > ok) AS a, count(*) FILTER ((ok IS NULL OR ts > ok) AND o = 'lease_skip') AS s, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ok))) / 3600 AS h FROM r GROUP BY user_id, ok, last),
f AS (SELECT *, CASE WHEN ok IS NULL THEN 'never' WHEN h > 72 THEN 'stale' WHEN h > 30 THEN 'warning' ELSE 'fresh' END AS freshness FROM g)
SELECT user_id, CASE WHEN freshness IN ('never', 'stale') THEN 'UNHEALTHY' WHEN freshness = 'warning' OR last IN ('failed', 'partial') THEN 'degraded' ELSE 'healthy' END AS status, freshness, a AS attempts_since, s AS skips_since FROM f""",
    "j13_candidates": f"""
WITH n AS (SELECT o_orderkey AS notice_id, o_orderdate::DATE AS d, o_custkey AS f, ['ring', {_turn('o_custkey', 'bolt', 'widget')}] AS p FROM orders WHERE o_orderkey % 2 = 0),
c AS (SELECT o_orderkey AS case_id, o_orderdate::DATE AS d, o_custkey AS f, {_turn('o_orderkey', 'widget', 'ring', 'nut')} AS p FROM orders WHERE o_orderkey % 2 = 1)
SELECT notice_id, case_id, 1::INTEGER AS shared FROM n JOIN c ON n.f = c.f AND abs(date_diff('day', n.d, c.d)) <= 45 AND list_contains(n.p, c.p)""",
    "w6_merged": """
WITH u AS (SELECT ts::DATE AS d, event_id % 7 AS rank, CASE event_type WHEN 'click' THEN 'case' ELSE 'notice' END AS side FROM events WHERE event_type IN ('click', 'view') ORDER BY d DESC, rank DESC, side LIMIT 50)
SELECT strftime(d, '%Y-%m-%d') AS day, rank, side, count(*) AS n FROM u GROUP BY ALL""",
    "p13_report": f"""
WITH c AS (SELECT c_custkey AS k, {_turn('c_custkey', 'nationwide', 'states', 'unknown', 'states')} AS scope, CASE WHEN c_custkey % 7 <> 0 THEN [{_turn('c_custkey', 'OH', 'IA')}, 'TX'] END AS states,
  {_turn('c_custkey', 'TX', 'CA', 'OH')} AS state, {_turn('c_custkey', 'Big Mart', None, 'Corner')} AS shop, {_turn('c_custkey', 'week', 'month', 'ever', None)} AS w FROM customer)
SELECT k AS c_custkey, CASE WHEN k % 10 = 0 THEN 'case_not_active' WHEN scope = 'unknown' OR (scope = 'states' AND states IS NULL) THEN 'geography_unusable' WHEN scope = 'states' AND NOT list_contains(states, state) THEN 'state_not_allowed'
  WHEN shop = 'Corner' THEN 'retailer_not_offered' WHEN w IS NULL OR w = 'ever' THEN 'purchase_window_invalid' END AS problem FROM c""",
    "p17_mismatch": f"""
WITH p AS (SELECT p_partkey AS k, string_split({_turn('p_partkey', *FAMILIES)}, '|') AS f, {_turn('p_partkey', 'egg', 'milk', 'soy')} AS mine FROM part)
SELECT k AS p_partkey, k % 3 <> 2 AND k % 4 <> 1 AND f <> [''] AND NOT list_contains(f, mine) AS mismatch FROM p""",
    "u3_names": """
SELECT p_partkey, upper(p_type) || '|' || p_name || CASE WHEN lower(p_name) = 'ring' THEN '' ELSE '|Ring' END AS names FROM part""",
    "i4_dates": f"SELECT p_partkey, {_turn('p_partkey', *DAYS)} AS day FROM part",
    "i8_sizes": f"SELECT p_partkey, {_turn('p_partkey', *SIZE_SETS)} AS sizes, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END::INTEGER AS unverified FROM part",
    "x32_urls": r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/+$', '') AS u FROM pages)
SELECT page_id, regexp_replace(lower(regexp_extract(u, '^[^/]*')), '^www\.', '') || regexp_extract(u, '/.*$') AS url FROM b""",
    "x33_versions": f"SELECT p_partkey, ({_turn('p_partkey', *AT_LEAST)})::BOOLEAN AS enough FROM part",
}

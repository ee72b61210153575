"""Synchronisation and ingest gates over versions of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.operators import sync as S
from noticeworks.session import table


def _manifests(spark, sf, gone: int):
    o = table(spark, sf, "orders")
    cached = o.where(f"o_orderkey % {gone} <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderstatus")).alias("version"))
    manifest = o.where("o_orderkey % 89 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 53 == 0, "X").otherwise(F.col("o_orderstatus")).alias("version"))
    return cached, manifest


def v5_refresh_plan(spark, sf):
    return S.refresh_plan(*_manifests(spark, sf, 71), "o_orderkey", "version")


def v5_full_reload(spark, sf):
    cached, manifest = _manifests(spark, sf, 71)
    return S.refresh_plan(cached.where("o_orderkey % 3 = 0"), manifest, "o_orderkey", "version")


def v6_recovered(spark, sf):
    cached, manifest = _manifests(spark, sf, 71)
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.recover_missing(cached.join(o, "o_orderkey"), manifest, o, "o_orderkey", "version")


def x17_feed_hash(spark, sf):
    """Whether a feed in another order has the same fingerprint, and one with a row less another one."""
    e = table(spark, sf, "events").select("event_id", "event_type")
    a = S.feed_hash(e, ["event_type"], ["event_id"])
    b = S.feed_hash(e.orderBy(F.desc("event_id")), ["event_type"], ["event_id"]).select("event_type", F.col("feed_hash").alias("again"))
    c = S.feed_hash(e.where("event_id % 50 <> 7"), ["event_type"], ["event_id"]).select("event_type", F.col("feed_hash").alias("less"))
    return a.join(b, "event_type").join(c, "event_type").select("event_type", "items", (F.col("feed_hash") == F.col("again")).alias("same"), (F.col("feed_hash") != F.col("less")).alias("other"))


def v7_feed_gate(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "error").alias("errors"))
    items = F.when(F.col("user_id") % 11 == 0, 0).otherwise(F.col("views"))
    gate = S.feed_gate(items, F.col("items") / 2, F.col("views"), F.col("errors"))
    return e.select("user_id", gate.alias("gate"))


def v8_latest_metric(spark, sf):
    e = table(spark, sf, "events").withColumn("metric", F.when(F.col("value") > 5, F.floor("value")))
    return S.latest_metric(e, "user_id", "event_id", F.col("event_type").isin("view", "click"), F.col("metric"), "items_seen")


def v9_apply_gate(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    r = o.select(
        "o_orderkey",
        F.when(k % 4 == 0, "n").otherwise(F.col("o_orderstatus")).alias("digest"),
        F.col("o_orderpriority").alias("presentation"),
        (k % 5 != 0).alias("complete"),
        F.when(k % 3 == 0, "applied").when(k % 3 == 1, "applied_degraded").alias("state"),
        F.when(k % 7 != 0, k).alias("applied_seq"),
        F.col("o_orderstatus").alias("applied_digest"),
    )
    latest = o.where("o_orderkey % 13 <> 0").select("o_orderkey", k.alias("seq"), F.col("o_orderstatus").alias("digest"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("presentation"))
    return S.apply_gate(r, latest, "o_orderkey")


def v11_export_guard(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_shipdate").alias("last"))
    k = F.col("l_suppkey")
    day = F.when(k % 6 == 0, "soon").when(k % 6 == 1, None).otherwise(F.date_format("last", "yyyy-MM-dd"))
    listed = F.when(k % 5 == 0, F.lit(0)).when(k % 5 == 1, F.col("rows") + 1).otherwise(F.col("rows"))
    return d.select("l_suppkey", S.export_problem(day, listed, F.col("rows"), F.col("returned") * 6).alias("problem"))


def w8_worklist(spark, sf):
    o = table(spark, sf, "orders")
    cand = o.select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderdate").alias("at"), "o_orderkey")
    stored = cand.where("cast(substr(url, 2) as int) % 3 <> 0").select("url")
    failed = o.groupBy(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url")).agg((F.count(F.lit(1)) % 6).alias("attempts"), F.max("o_orderdate").alias("last")).where("attempts > 0")
    return S.worklist(cand, stored, failed, "url", "at", ["o_orderkey"], F.lit("2001-08-02").cast("timestamp"), True, F.lit("1998-01-01").cast("timestamp"), 40)


def r10_revalidate(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    minutes = F.when(F.col("user_id") % 10 != 0, F.floor((F.unix_timestamp(F.lit("2024-01-30 12:00:00").cast("timestamp")) - F.unix_timestamp("last")) / 60))
    return e.select("user_id", S.revalidate(minutes, 600).alias("sync"))


QUERIES = {f.__name__: f for f in (v5_refresh_plan, v5_full_reload, v6_recovered, x17_feed_hash, v7_feed_gate, v8_latest_metric, v9_apply_gate, v11_export_guard, w8_worklist, r10_revalidate)}

_MANIFESTS = """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderstatus END AS version FROM orders WHERE o_orderkey % 71 <> 0),
m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 53 = 0 THEN 'X' ELSE o_orderstatus END AS version FROM orders WHERE o_orderkey % 89 <> 1)"""


def _refresh(cached: str) -> str:
    return f"""{_MANIFESTS},
d AS (SELECT coalesce(h.o_orderkey, m.o_orderkey) AS o_orderkey, CASE WHEN h.o_orderkey IS NULL THEN 'add' WHEN m.o_orderkey IS NULL THEN 'remove'
  WHEN h.version IS NULL OR h.version <> m.version THEN 'change' ELSE 'keep' END AS action FROM (SELECT * FROM c WHERE {cached}) h FULL JOIN m ON h.o_orderkey = m.o_orderkey),
n AS (SELECT (SELECT count(*) FROM d WHERE action IN ('add', 'change')) AS need, (SELECT count(*) FROM m) AS listed, (SELECT count(*) FROM c WHERE {cached}) AS held)
SELECT o_orderkey, action, CASE WHEN held = 0 OR listed = 0 OR need > listed * 0.5 THEN 'full' ELSE 'incremental' END AS mode FROM d, n"""


ORACLES = {
    "v5_refresh_plan": _refresh("true"),
    "v5_full_reload": _refresh("o_orderkey % 3 = 0"),
    "v6_recovered": f"""{_MANIFESTS}
SELECT c.o_orderkey, c.version, o_custkey FROM c JOIN orders USING (o_orderkey)
UNION ALL SELECT m.o_orderkey, m.version, o_custkey FROM m JOIN orders USING (o_orderkey) WHERE m.o_orderkey NOT IN (SELECT o_orderkey FROM c)""",
    "x17_feed_hash": "SELECT event_type, count(*) AS items, true AS same, true AS other FROM events GROUP BY event_type",
    "v7_feed_gate": """
WITH g AS (SELECT user_id, count(*) AS items, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id),
n AS (SELECT *, CASE WHEN user_id % 11 = 0 THEN 0 ELSE v END AS seen FROM g)
SELECT user_id, CASE WHEN seen = 0 THEN 'no_items' WHEN seen < ceil(items / 4) THEN 'implausibly_few' WHEN v = e THEN 'unchanged' ELSE 'ingest' END AS gate FROM n""",
    "v8_latest_metric": """
WITH u AS (SELECT DISTINCT user_id FROM events),
r AS (SELECT user_id, floor(value)::BIGINT AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type IN ('view', 'click') AND value > 5)
SELECT u.user_id, m AS items_seen FROM u LEFT JOIN r ON u.user_id = r.user_id AND k = 1""",
    "v9_apply_gate": """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS p, CASE WHEN o_orderkey % 4 = 0 THEN 'n' ELSE o_orderstatus END AS digest,
  CASE o_orderkey % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'applied_degraded' END AS state FROM orders),
j AS (SELECT *, k % 13 <> 0 AS held, k % 13 <> 0 AND digest = st AS same, k % 13 <> 0 AND (state IS NULL OR (state = 'applied' AND k % 7 <> 0)) AS applied FROM r)
SELECT k AS o_orderkey, CASE WHEN same AND applied THEN 'unchanged' WHEN NOT same AND applied AND k % 5 <> 0 AND k % 2 = 0 THEN 'presentation_only'
  WHEN same AND state = 'applied_degraded' AND k % 5 <> 0 THEN 'degraded_completion' ELSE 'pending' END AS gate FROM j""",
    "v11_export_guard": """
WITH d AS (SELECT l_suppkey AS k, count(*) AS n, 6 * count(*) FILTER (l_returnflag = 'R') AS before FROM lineitem GROUP BY 1),
x AS (SELECT *, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN n + 1 ELSE n END AS listed FROM d)
SELECT k AS l_suppkey, CASE WHEN k % 6 IN (0, 1) THEN 'date_unknown' WHEN listed = 0 THEN 'empty' WHEN listed <> n THEN 'count_differs' WHEN listed < ceil(before / 2) THEN 'implausibly_small' END AS problem FROM x""",
    "w8_worklist": """
WITH c AS (SELECT o_custkey, min(o_orderkey) AS k, min_by(o_orderdate, o_orderkey) AS made, count(*) % 6 AS attempts, max(o_orderdate) AS last FROM orders GROUP BY o_custkey),
s AS (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN 'missing' WHEN made >= TIMESTAMP '1998-01-01' THEN 'reverify' END AS due FROM c),
w AS (SELECT *, CASE WHEN attempts > 0 AND epoch(TIMESTAMP '2001-08-02') - epoch(last) < least(6 * power(2, attempts - 1), 168) * 3600 THEN 'deferred' ELSE due END AS status FROM s WHERE due IS NOT NULL),
t AS (SELECT k FROM w WHERE status <> 'deferred' ORDER BY k LIMIT 40)
SELECT 'u' || o_custkey AS url, status, k IN (SELECT k FROM t) AS taken FROM w""",
    "r10_revalidate": """
WITH l AS (SELECT user_id, CASE WHEN user_id % 10 <> 0 THEN floor((epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(max(ts)))) / 60) END AS m FROM events GROUP BY user_id)
SELECT user_id, m IS NULL OR m < 0 OR m >= 600 AS sync FROM l""",
}

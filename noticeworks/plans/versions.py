"""Versioning queries over two deterministic versions of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.operators import versioning as V
from noticeworks.session import table


def _versions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    old = o.where("o_orderkey % 7 <> 0").withColumn("version", F.lit(1).cast("long"))
    new = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return old, new


def j5_latest_snapshot(spark, sf):
    e = V.latest_per_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(e, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "event_id", "event_type")


def v5_sync_plan(spark, sf):
    old, new = _versions(spark, sf)
    hashed = lambda d: d.select("o_orderkey", F.md5("o_orderstatus").alias("v"))
    return V.sync_plan(hashed(old), hashed(new), "o_orderkey", "v")


def v18_run_plan(spark, sf):
    old, new = _versions(spark, sf)
    return V.run_plan(old, new, "o_orderkey", ["o_orderstatus", "o_custkey"], "version")


def v12_field_drift(spark, sf):
    lines = table(spark, sf, "lineitem")
    derived = lines.groupBy("l_orderkey").agg(F.when(F.bool_and(F.col("l_linestatus") == "F"), "F").when(F.bool_and(F.col("l_linestatus") == "O"), "O").otherwise("P").alias("o_orderstatus"), F.count(F.lit(1)).alias("lines"))
    stored = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit(4).cast("long").alias("lines"))
    return V.field_drift(stored, derived.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["o_orderstatus", "lines"])


def k1_archive_status(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", F.md5("event_type").alias("digest"), "event_id")
    first = V.latest_per_key(e.where("event_id % 2 = 0"), "user_id", ["ts", "event_id"], ["ts", "digest"])
    out = V.archive_status(e.where("event_id % 2 = 1"), first, "user_id", "ts", "digest")
    return out.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"))


def k4_insert_absent(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("dedup_key"), "event_id")
    return V.insert_absent(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), "dedup_key").select("dedup_key")


def v22_audit_findings(spark, sf):
    o, li, c = table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "customer")
    has = li.select(F.col("l_orderkey").alias("k")).distinct()
    missing = o.join(has, F.col("o_orderkey") == F.col("k"), "left_anti").select(F.col("o_orderkey").alias("id"), F.lit("missing_children").alias("finding"))
    orphan = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("id"), F.lit("orphan_case").alias("finding"))
    bad = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("l_orderkey").alias("id"), F.lit("invalid_link").alias("finding")).distinct()
    return missing.union(orphan).union(bad)


QUERIES = {f.__name__: f for f in (j5_latest_snapshot, v5_sync_plan, v18_run_plan, v12_field_drift, k1_archive_status, k4_insert_absent, v22_audit_findings)}

TWO = """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders),
s AS (SELECT *, 1::BIGINT AS version FROM o WHERE o_orderkey % 7 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM o WHERE o_orderkey % 5 <> 0)
"""

ORACLES = {
    "j5_latest_snapshot": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT c_custkey, event_id, event_type FROM customer LEFT JOIN r ON c_custkey = user_id AND k = 1""",
    "v5_sync_plan": TWO
    + """SELECT coalesce(s.o_orderkey, n.o_orderkey) AS o_orderkey,
  CASE WHEN s.o_orderkey IS NULL THEN 'add' WHEN n.o_orderkey IS NULL THEN 'remove' WHEN s.o_orderstatus <> n.o_orderstatus THEN 'change' ELSE 'keep' END AS action
FROM s FULL JOIN n ON s.o_orderkey = n.o_orderkey""",
    "v18_run_plan": TWO
    + """SELECT n.o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderstatus IS DISTINCT FROM s.o_orderstatus OR n.o_custkey IS DISTINCT FROM s.o_custkey THEN 'update' ELSE 'touch' END AS action,
  CASE WHEN s.o_orderkey IS NULL THEN 1 WHEN n.o_orderstatus IS DISTINCT FROM s.o_orderstatus OR n.o_custkey IS DISTINCT FROM s.o_custkey THEN s.version + 1 ELSE s.version END::BIGINT AS version
FROM n LEFT JOIN s ON s.o_orderkey = n.o_orderkey""",
    "v12_field_drift": """
WITH d AS (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS st, count(*)::BIGINT AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS stored, st AS derived FROM orders JOIN d ON o_orderkey = l_orderkey WHERE o_orderstatus IS DISTINCT FROM st
UNION ALL SELECT o_orderkey, 'lines', '4', lines::VARCHAR FROM orders JOIN d ON o_orderkey = l_orderkey WHERE lines <> 4""",
    "k1_archive_status": """
WITH l AS (SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_type, (ts, event_id)) AS h FROM events WHERE event_id % 2 = 0 GROUP BY user_id)
SELECT e.user_id, CASE WHEN e.ts < l.ts THEN 'stale' WHEN e.event_type = l.h THEN 'duplicate' ELSE 'archived' END AS status, count(*) AS n
FROM events e LEFT JOIN l ON e.user_id = l.user_id WHERE event_id % 2 = 1 GROUP BY 1, 2""",
    "k4_insert_absent": """
SELECT DISTINCT user_id || ':' || event_type AS dedup_key FROM events WHERE event_id % 3 <> 0
  AND user_id || ':' || event_type NOT IN (SELECT user_id || ':' || event_type FROM events WHERE event_id % 3 = 0)""",
    "v22_audit_findings": """
SELECT o_orderkey AS id, 'missing_children' AS finding FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT c_custkey, 'orphan_case' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT l_orderkey, 'invalid_link' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
}

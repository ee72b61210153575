"""Audit classes of records, and the digest of the plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticeworks.operators import audit as A
from noticeworks.plans.decided import pick
from noticeworks.session import table


def _audited(spark, sf):
    """Orders as records of their customers, with up to two snapshots each; each kind of fault on some of them."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    digest = lambda *parts: F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    records = o.select(
        k.alias("record_id"), F.when(k % 37 > 0, F.col("o_custkey")).otherwise(F.lit(-1).cast("long")).alias("case_id"), F.when(k % 31 > 0, "FDA").otherwise("OTHER").alias("source_system"),
        digest("n", k, F.when(k % 29 > 0, F.lit(2)).otherwise(F.lit(1))).alias("normalized_hash"), pick(k, "applied", "pending", None, "applied", "degraded").alias("apply_state"),
        digest("c", k, F.when(k % 23 > 0, F.lit(2)).otherwise(F.lit(0))).alias("applied_hash"), F.when(k % 19 > 0, F.lit(2)).otherwise(F.lit(5)).cast("long").alias("applied_seq"),
    )
    each = o.where(k % 17 > 0).select(k.alias("record_id"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("seq"))
    i = F.col("record_id")
    snapshots = each.select("record_id", "seq", digest("c", i, F.col("seq")).alias("content_hash"), F.when((i % 41 > 0) | (F.col("seq") == 1), digest("n", i, F.col("seq"))).alias("derived_hash"))
    c, q = table(spark, sf, "customer"), F.col("c_custkey")
    cases = c.select(q.alias("case_id"), digest("p", q).alias("projection_hash"), digest("p", q, F.when(q % 13 > 0, None).otherwise(F.lit(1))).alias("derived_hash"), F.when(q % 2 == 0, F.md5(F.concat(F.lit("a"), F.lit("\u0002"), F.when(q % 11 > 0, "b").otherwise("x")))).alias("derived_products"))
    products = c.where(q % 2 == 0).select(q.alias("case_id"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("ordinal", "name"))
    events = c.where(q % 7 > 0).select(q.alias("case_id"), F.explode(F.array(F.lit("initial"), F.lit("update"), F.lit("initial"))).alias("kind"))
    return A.audit_records(records, snapshots, cases, products, events)


def v22_audit_classes(spark, sf):
    return _audited(spark, sf).select("record_id", "case_id", "classification")


def v12_plan_digest(spark, sf):
    """The digest of what is seedable, and of the same rows in another order and without one."""
    plan = _audited(spark, sf).where("classification <> 'already_applied_consistent'").select("record_id", "case_id", "classification")
    d = lambda df: A.plan_digest(df, "record_id", "case_id", "classification")
    one, two, less = d(plan), d(plan.orderBy(F.desc("case_id"), "record_id")), d(plan.where("coalesce(record_id, -1) % 50 <> 1"))
    return one.select("rows", "digest").crossJoin(two.select(F.col("digest").alias("again"))).crossJoin(less.select(F.col("digest").alias("less"))).select("rows", "digest", (F.col("digest") == F.col("again")).alias("same"), (F.col("digest") != F.col("less")).alias("changes"))


QUERIES = {f.__name__: f for f in (v22_audit_classes, v12_plan_digest)}

_CLASSES = """
WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 37 > 0 THEN o_custkey ELSE -1 END AS c, (o_orderkey % 5)::INT AS s FROM orders),
j AS (SELECT r.*, q.c_custkey AS q FROM r LEFT JOIN customer q ON r.c = q.c_custkey),
f AS (SELECT k, c, CASE WHEN k % 31 = 0 THEN 'unsupported_source_system' WHEN q IS NULL THEN 'invalid_case_link' WHEN k % 17 = 0 THEN 'missing_snapshot' WHEN k % 41 = 0 THEN 'snapshot_parse_failure' WHEN c % 7 = 0 THEN 'missing_initial_event'
  WHEN k % 29 = 0 THEN 'normalized_drift' WHEN c % 13 = 0 THEN 'case_projection_drift' WHEN c % 2 = 0 AND c % 11 = 0 THEN 'affected_products_drift' WHEN s IN (0, 3) AND (k % 23 = 0 OR k % 19 = 0) THEN 'applied_marker_inconsistent'
  WHEN s IN (0, 3) THEN 'already_applied_consistent' WHEN s = 1 THEN 'pending_current_version' WHEN s = 4 THEN 'applied_degraded' ELSE 'consistent_legacy_seedable' END AS f FROM j),
b AS (SELECT *, bool_or(f IN ('missing_snapshot', 'snapshot_parse_failure', 'missing_initial_event', 'normalized_drift', 'case_projection_drift', 'affected_products_drift', 'applied_marker_inconsistent')) OVER (PARTITION BY c) AS w FROM f),
a AS (SELECT k AS record_id, c AS case_id, CASE WHEN f = 'consistent_legacy_seedable' AND w THEN 'case_blocked_by_sibling' ELSE f END AS classification FROM b
  UNION ALL SELECT NULL, c_custkey, 'orphan_case' FROM customer WHERE c_custkey NOT IN (SELECT c FROM r))"""

ORACLES = {
    "v22_audit_classes": f"{_CLASSES} SELECT record_id, case_id, classification FROM a",
    "v12_plan_digest": f"""{_CLASSES},
p AS (SELECT md5('{{"record_id":' || coalesce(record_id::VARCHAR, 'null') || ',"case_id":' || case_id || ',"classification":"' || classification || '"}}') AS m FROM a WHERE classification <> 'already_applied_consistent')
SELECT count(*) AS rows, md5(sum(('0x' || substr(m, 1, 15))::BIGINT)::VARCHAR) AS digest, true AS same, true AS changes FROM p""",
}

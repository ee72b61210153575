"""Audit of applied state: how each source record stands to its snapshots, case, products and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Source systems that are audited; classes that can be seeded, and classes of a mismatch that blocks its case.
SYSTEMS = ("FSIS", "FDA", "FDA_ENFORCEMENT")
SEEDABLE = ("consistent_legacy_seedable",)
MISMATCHES = ("missing_snapshot", "snapshot_parse_failure", "missing_initial_event", "normalized_drift", "case_projection_drift", "affected_products_drift", "applied_marker_inconsistent")


def audit_records(records: DataFrame, snapshots: DataFrame, cases: DataFrame, products: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, case_id, classification, fingerprint) of each record, and of each case without one (record_id null, orphan_case).

    records: record_id, case_id, source_system, normalized_hash, apply_state, applied_hash, applied_seq. snapshots: record_id, seq,
    content_hash, derived_hash (null: it cannot be parsed). cases: case_id, projection_hash, and derived_hash and derived_products as a
    new derivation gives them. products: case_id, ordinal, name. events: case_id, kind. The first class that holds is a record's; one that
    could be seeded is case_blocked_by_sibling if another record of its case has a mismatch. The fingerprint hashes all that was compared,
    so that a plan can be held against what it was made for. A record's latest snapshot is that of the greatest seq. Children
    are reduced to one row a case or record before the joins.
    """
    last = snapshots.groupBy("record_id").agg(F.max(F.struct("seq", "content_hash", "derived_hash")).alias("s")).select("record_id", "s.*")
    named = products.groupBy("case_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: F.coalesce(x["name"], F.lit("\u0001"))), "\u0002")).alias("products_hash"))
    told = events.where("kind = 'initial'").select("case_id").distinct().withColumn("initial", F.lit(True))
    known = cases.select(F.col("case_id").alias("_case"), "projection_hash", F.col("derived_hash").alias("derived_projection"), "derived_products")
    j = records.join(known, F.col("case_id") == F.col("_case"), "left").join(last, "record_id", "left").join(named, "case_id", "left").join(told, "case_id", "left")
    none = F.md5(F.lit(""))
    applied = F.col("apply_state") == "applied"
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rules: list[tuple[str, Column]] = [
        ("unsupported_source_system", ~F.coalesce(F.col("source_system").isin(*SYSTEMS), F.lit(False))),
        ("invalid_case_link", F.col("_case").isNull()),
        ("missing_snapshot", F.col("seq").isNull()),
        ("snapshot_parse_failure", F.col("derived_hash").isNull()),
        ("missing_initial_event", F.col("initial").isNull()),
        ("normalized_drift", differs("normalized_hash", "derived_hash")),
        ("case_projection_drift", differs("projection_hash", "derived_projection")),
        ("affected_products_drift", ~F.coalesce("products_hash", none).eqNullSafe(F.coalesce("derived_products", none))),
        ("applied_marker_inconsistent", applied & (differs("applied_hash", "content_hash") | (F.col("applied_seq") > F.col("seq")))),
        ("already_applied_consistent", applied),
        ("pending_current_version", F.col("apply_state") == "pending"),
        ("applied_degraded", F.col("apply_state") == "degraded"),
    ]
    first = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules], F.lit(SEEDABLE[0]))
    seen = ("record_id", "case_id", "source_system", "normalized_hash", "apply_state", "applied_hash", "applied_seq", "seq", "content_hash", "derived_hash", "projection_hash", "derived_projection", "products_hash", "derived_products", "initial")
    j = j.withColumn("_class", first).withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(seen)), {"ignoreNullFields": "false"}), 256))
    wrong = F.bool_or(F.col("_class").isin(*MISMATCHES)).over(Window.partitionBy("case_id"))
    blocked = F.col("_class").isin(*SEEDABLE) & wrong & F.col("case_id").isNotNull()
    judged = j.select("record_id", "case_id", F.when(blocked, "case_blocked_by_sibling").otherwise(F.col("_class")).alias("classification"), "fingerprint")
    orphans = cases.join(records.select("case_id"), "case_id", "left_anti")
    alone = orphans.select(F.lit(None).cast(records.schema["record_id"].dataType).alias("record_id"), "case_id", F.lit("orphan_case").alias("classification"), F.sha2(F.concat_ws("|", F.lit("orphan"), F.col("case_id").cast("string"), "projection_hash"), 256).alias("fingerprint"))
    return judged.unionByName(alone)


def plan_digest(plan: DataFrame, *columns: str) -> DataFrame:
    """(rows, digest): one row that changes with any row of a plan, whatever their order (V12): the sum of the rows' hashes, in hex."""
    row = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return plan.agg(F.count(F.lit(1)).alias("rows"), F.md5(F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")).alias("digest"))

"""Approved notices, facts of a case by concept, events of expansions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.text import fnv1a


def approved_notices(approvals: DataFrame, notices: DataFrame) -> DataFrame:
    """Notices to show on their own: approved for the very document that the notice still has, and decided to be new.

    approvals: notice_id, document_content_hash, fields_version, approved_at, withdrawn_at, agency_case_id.
    notices: id, publisher, document_content_hash, decision, notice_kind, food_status, document_extraction,
    stated_notice_date. Both sides are filtered before the join; a null in a compared column keeps a row out.
    """
    a = approvals.where("withdrawn_at IS NULL AND agency_case_id IS NULL AND fields_version = 1")
    n = notices.where(
        "decision = 'new_candidate' AND notice_kind = 'recall' AND food_status = 'food' AND document_extraction = 'text' AND stated_notice_date IS NOT NULL"
    )
    a = a.select("approved_at", F.col("notice_id").alias("id"), "document_content_hash")
    return n.join(a, ["id", "document_content_hash"]).select("id", "publisher", F.col("stated_notice_date").alias("notice_date"), "approved_at")


def aggregate_facts(facts: DataFrame, priority: tuple[str, ...], dates: tuple[str, ...], suppressed: tuple[str, ...] = ()) -> DataFrame:
    """Values of each case and concept, first seen first, dates by their key with those without one last.

    facts: case_id, pos (order in the source), concept, display, raw, canonical, sort_key, source_label, valid.
    Facts of one canonical key are one value, the first one's (ties in pos by display, then raw). Empty displays and keys, and values that are not
    valid for their concept, are dropped; a concept without a value gives no row. `place` orders a case's concepts.
    Distinct values are made before they meet in a case's array, so copies of a fact do not widen it.
    """
    named = facts.where(~F.col("concept").isin(*suppressed)) if suppressed else facts.where("concept IS NOT NULL")
    batch = F.coalesce((F.col("concept") == "lot") & F.lower("source_label").contains("batch"), F.lit(False))
    good = F.coalesce((F.col("display") != "") & (F.col("canonical") != "") & F.col("valid"), F.lit(False))
    key = F.when(good, F.col("canonical"))  # what is dropped still tells whether the lot is a batch
    values = named.groupBy("case_id", "concept", key.alias("canonical")).agg(
        F.min("pos").alias("pos"), F.min_by(F.struct("display", "raw", "sort_key"), F.struct("pos", "display", "raw")).alias("v"), F.bool_or(batch).alias("batch")
    )
    late = F.when(F.col("concept").isin(*dates), F.coalesce(F.col("v.sort_key"), F.lit("￿"))).otherwise(F.lit(""))
    one = F.when(F.col("canonical").isNotNull(), F.struct(late.alias("late"), "pos", F.col("v.display").alias("display"), F.col("v.raw").alias("raw"), "canonical"))
    out = values.groupBy("case_id", "concept").agg(F.array_sort(F.collect_list(one)).alias("vs"), F.bool_or("batch").alias("is_batch")).where("size(vs) > 0")
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("concept")).cast("int")
    place = F.when(place > 0, place).otherwise(F.lit(len(priority) + 1))
    return out.select("case_id", "concept", place.alias("place"), F.col("vs.display").alias("shown"), F.col("vs.raw").alias("raw"), F.col("vs.canonical").alias("keys"), "is_batch")


def expansion_events(records: DataFrame, known: DataFrame, events: DataFrame) -> DataFrame:
    """The event that an expansion record brings where it gave none of its own (V3).

    records: case_id, native_id, expansion_of; known: case_id, native_id, the identifiers that the case has;
    events: case_id, native_id, rule_id, found for the records already. A record that the case knows, that expands
    nothing, or that has an event on products or places brings none. The fingerprint is the same at every retry.
    """
    at = ["case_id", "native_id"]
    told = events.where("rule_id IN ('expansion_products', 'expansion_geography')").select(*at)
    new = records.where("expansion_of IS NOT NULL AND expansion_of <> ''").join(known.select(*at), at, "left_anti").join(told, at, "left_anti")
    return new.select(
        *at,
        F.lit("expansion_products").alias("rule_id"),
        F.concat(F.lit("The agency expanded this recall (notice "), F.col("native_id").cast("string"), F.lit(").")).alias("summary"),
        fnv1a(F.concat(F.lit("expansion-record:"), F.col("native_id").cast("string"))).alias("fingerprint"),
    ).distinct()

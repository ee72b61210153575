"""Change detection and versioned merges (J5, K*, V*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The row of the greatest `order` for each key by max_by: partial aggregation, one shuffle, no sort."""
    top = F.max_by(F.struct(*fields), F.struct(*order))
    return log.groupBy(key).agg(top.alias("_top")).select(key, "_top.*")


def differs(fields: list[str], a: str, b: str):
    """Any field distinct, null-safe."""
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in fields])


def sync_plan(cached: DataFrame, manifest: DataFrame, key: str, version: str) -> DataFrame:
    """(key, action) of a full outer diff of two manifests: add, change (also a null version), remove or keep."""
    j = cached.alias("c").join(manifest.alias("m"), F.col(f"c.{key}") == F.col(f"m.{key}"), "full_outer")
    action = (
        F.when(F.col(f"c.{key}").isNull(), "add")
        .when(F.col(f"m.{key}").isNull(), "remove")
        .when(F.col(f"c.{version}").isNull() | (F.col(f"c.{version}") != F.col(f"m.{version}")), "change")
        .otherwise("keep")
    )
    return j.select(F.coalesce(f"c.{key}", f"m.{key}").alias(key), action.alias("action"))


def run_plan(stored: DataFrame, incoming: DataFrame, key: str, content: list[str], version: str) -> DataFrame:
    """(key, action, version): insert, touch or update by content without bookkeeping; the version grows on change alone."""
    j = incoming.alias("n").join(stored.alias("s"), F.col(f"n.{key}") == F.col(f"s.{key}"), "left")
    changed = differs(content, "n", "s")
    action = F.when(F.col(f"s.{key}").isNull(), "insert").when(changed, "update").otherwise("touch")
    grown = F.when(F.col(f"s.{key}").isNull(), F.lit(1)).when(changed, F.col(f"s.{version}") + 1).otherwise(F.col(f"s.{version}"))
    return j.select(F.col(f"n.{key}"), action.alias("action"), grown.cast("long").alias("version"))


def field_drift(stored: DataFrame, derived: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each field that differs: (key, field, stored, derived)."""
    j = stored.alias("s").join(derived.alias("d"), F.col(f"s.{key}") == F.col(f"d.{key}"))
    rows = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f"s.{f}").cast("string").alias("stored"), F.col(f"d.{f}").cast("string").alias("derived")) for f in fields]
    )
    kept = F.filter(rows, lambda r: ~r["stored"].eqNullSafe(r["derived"]))
    return j.select(F.col(f"s.{key}").alias(key), F.explode(kept).alias("_r")).select(key, "_r.*")


def archive_status(incoming: DataFrame, latest: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """(key, at, status): archived, stale (older than the latest) or duplicate (same hash) (K1, R2)."""
    j = incoming.alias("n").join(latest.alias("l"), F.col(f"n.{key}") == F.col(f"l.{key}"), "left")
    status = F.when(F.col(f"n.{at}") < F.col(f"l.{at}"), "stale").when(F.col(f"n.{digest}") == F.col(f"l.{digest}"), "duplicate").otherwise("archived")
    return j.select(F.col(f"n.{key}"), F.col(f"n.{at}"), status.alias("status"))


def insert_absent(ledger: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows to append: one a key, and none that the ledger has (K4)."""
    return incoming.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")

"""Incremental synchronisation and the gates before an ingest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.operators.versioning import sync_plan


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def refresh_plan(cached: DataFrame, manifest: DataFrame, key: str, version: str, fraction: float = 0.5) -> DataFrame:
    """(key, action, mode) of a refresh (V5): `sync_plan` with the way to carry it out.

    mode is `full` if nothing is cached, the manifest is empty, or more than `fraction` of it must be fetched; else
    `incremental`. The decision is one row of counts that the plan is joined to, never collected.
    """
    plan = sync_plan(cached, manifest, key, version)
    counts = plan.agg(F.count_if(F.col("action").isin("add", "change")).alias("need"), F.count_if(F.col("action") != "remove").alias("listed"), F.count_if(F.col("action") != "add").alias("held"))
    full = (F.col("held") == 0) | (F.col("listed") == 0) | (F.col("need") > F.col("listed") * fraction)
    return plan.join(F.broadcast(counts.select(F.when(full, "full").otherwise("incremental").alias("mode"))), F.lit(True))


def recover_missing(loaded: DataFrame, manifest: DataFrame, source: DataFrame, key: str, version: str) -> DataFrame:
    """`loaded` (key, version, ...) with the rows that a manifest lists and a paged load has missed, under the listed version (V6)."""
    behind = manifest.select(key, F.col(version).alias("_v")).join(loaded.select(key), key, "left_anti").dropDuplicates([key])
    found = source.drop(version).join(behind, key).withColumnRenamed("_v", version)
    return loaded.unionByName(found.select(*loaded.columns))


def feed_hash(items: DataFrame, by: list[str], rows: list[str]) -> DataFrame:
    """(*by, feed_hash, items): a fingerprint of the rows of each group that their order does not change.

    Each row is hashed, and the hashes are summed by 64-bit halves, so that no group is gathered: equal rows count.
    """
    digest = F.sha2(F.to_json(F.struct(*rows), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring("_d", at, 12), 16, 10).cast("decimal(38,0)"))
    sums = F.concat_ws("|", F.count(F.lit(1)), part(1), part(13), part(25), part(37))
    return items.withColumn("_d", digest).groupBy(*by).agg(F.sha2(sums, 256).alias("feed_hash"), F.count(F.lit(1)).alias("items"))


def latest_metric(runs: DataFrame, job: str, at: str, ok: Column, metric: Column, name: str) -> DataFrame:
    """(job, name): the newest non-null metric among the successful runs of each job, null without one (V8)."""
    return runs.groupBy(job).agg(F.max_by(metric, F.when(ok & metric.isNotNull(), F.col(at))).alias(name))


def feed_gate(items: Column, previous_items: Column, digest: Column, completed_digest: Column) -> Column:
    """no_items, implausibly_few (below half of the last run, rounded up), unchanged or ingest, in that order (V7)."""
    return (
        F.when(F.coalesce(items, F.lit(0)) == 0, "no_items")
        .when(_true(items < F.ceil(previous_items / 2)), "implausibly_few")
        .when(_true(digest == completed_digest), "unchanged")
        .otherwise("ingest")
    )


def export_problem(day: Column, listed: Column, rows: Column, previous: Column) -> Column:
    """Why an export is not complete, null if it is: date_unknown, empty, count_differs or implausibly_small."""
    return F.coalesce(
        F.when(~_true(day.rlike(r"^\d{4}-\d{2}-\d{2}$")), "date_unknown"),
        F.when(~_true((listed > 0) & (rows > 0)), "empty"),
        F.when(rows != listed, "count_differs"),
        F.when(_true(listed < F.ceil(previous / 2)), "implausibly_small"),
    )


def apply_gate(records: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """(key, gate) of fetched records against what is archived and applied (V9).

    `records`: key, digest, presentation, complete, state, applied_seq, applied_digest; `latest`: key, seq, digest,
    presentation of the newest snapshot. A record without a state is of old and counts as applied. unchanged: the
    newest snapshot has this content and is applied; presentation_only: other content, the same presentation, over an
    applied one; degraded_completion: the same content, applied without all evidence, now complete; else pending.
    """
    j = records.alias("r").join(latest.alias("l"), F.col(f"r.{key}") == F.col(f"l.{key}"), "left")
    f = F.col
    same = _true(f("r.digest") == f("l.digest"))
    applied = f("r.state").isNull() | _true((f("r.state") == "applied") & (f("r.applied_seq") == f("l.seq")) & (f("r.applied_digest") == f("l.digest")))
    applied = f("l.seq").isNotNull() & applied
    gate = (
        F.when(same & applied, "unchanged")
        .when(~same & applied & _true(f("r.complete")) & _true(f("r.presentation") == f("l.presentation")), "presentation_only")
        .when(same & _true(f("r.state") == "applied_degraded") & _true(f("r.complete")), "degraded_completion")
        .otherwise("pending")
    )
    return j.select(f(f"r.{key}").alias(key), gate.alias("gate"))


def backoff_hours(attempts: Column, base: int = 6, cap: int = 168) -> Column:
    """`base` hours doubled for each attempt after the first, `cap` at most."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0)).cast("double")), F.lit(float(cap)))


def worklist(candidates: DataFrame, stored: DataFrame, failures: DataFrame, url: str, at: str, order: list[str], now: Column, full: bool, since: Column, most: int) -> DataFrame:
    """(url, status, taken) of what a run has to fetch.

    `candidates` (url, at, *order): the first by `order` of each url counts. `stored` (url) is held already, `failures`
    (url, attempts, last) failed before. status: missing, reverify (held, recent, in a full run) or deferred (failed,
    and the back-off is not over). The first `most` by `order` that are not deferred are taken.
    """
    first = candidates.groupBy(url).agg(F.min_by(F.struct(at, *order), F.struct(*order)).alias("_c")).select(url, "_c.*")
    held = stored.select(url).distinct().withColumn("_held", F.lit(True))
    j = first.join(held, url, "left").join(failures.select(url, "attempts", "last"), url, "left")
    due = F.when(F.col("_held").isNull(), "missing").when(F.lit(full) & (F.col(at) >= since), "reverify")
    waits = _true(F.unix_timestamp(now) - F.unix_timestamp("last") < backoff_hours(F.col("attempts")) * 3600)
    j = j.withColumn("status", due).where("status is not null").withColumn("status", F.when(waits, "deferred").otherwise(F.col("status")))
    top = j.where("status <> 'deferred'").orderBy(*order).limit(most).select(url, F.lit(True).alias("_taken"))
    return j.join(top, url, "left").select(url, "status", F.coalesce("_taken", F.lit(False)).alias("taken"))


def revalidate(elapsed_minutes: Column, most: int = 15) -> Column:
    """Whether to sync again: never synced, `most` minutes ago or more, or a clock that went back."""
    return elapsed_minutes.isNull() | (elapsed_minutes < 0) | (elapsed_minutes >= most)

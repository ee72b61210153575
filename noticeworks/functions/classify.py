"""Domain classifiers as CASE expressions (C*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def risk_tier(classes: Column, pending: Column) -> Column:
    """Tier of a set of official classes; without any, pending or unknown."""
    has = lambda k: F.array_contains(classes, k)
    return (
        F.when(has("I") & (F.size(classes) == 1), "critical")
        .when(has("I"), "very_high")
        .when(has("II") & has("III"), "moderate")
        .when(has("II"), "high")
        .when(has("III"), "low")
        .when(pending, "pending")
        .otherwise("unknown")
    )


def tier_rank(tier: Column) -> Column:
    """Order of tiers; pending and unknown have no rank (1.4)."""
    out = F.lit(None).cast("int")
    for i, t in enumerate(("critical", "very_high", "high", "moderate", "low")):
        out = F.when(tier == t, i + 1).otherwise(out)
    return out


def class_set_key(classes: Column) -> Column:
    """Distinct classes in severity order, joined."""
    return F.array_join(F.filter(F.array(F.lit("I"), F.lit("II"), F.lit("III")), lambda k: F.array_contains(classes, k)), "+")


def activity_section(day: Column, now: str, days: int = 60) -> Column:
    """recent up to `days` before `now`, inclusive; older else."""
    return F.when(F.datediff(F.lit(now).cast("date"), day) <= days, "recent").otherwise("older")


def location_tier(states: Column, scope: Column, selected: list[str]) -> Column:
    """0 a selected state is named, 1 nationwide, null otherwise; unknown matches nothing."""
    named = F.coalesce(F.arrays_overlap(states, F.array(*[F.lit(s) for s in selected])), F.lit(False))
    return F.when(named, 0).when(scope == "nationwide", 1)


def sending_held(ts: Column, zone: str = "America/New_York") -> Column:
    """Between 22:00 and 10:00 local time."""
    h = F.hour(F.from_utc_timestamp(ts, zone))
    return (h >= 22) | (h < 10)


def backoff_minutes(failures: Column) -> Column:
    """30 minutes doubled for each failure after the first, six hours at most."""
    return F.least(F.lit(30) * F.pow(F.lit(2), failures - 1), F.lit(360)).cast("int")

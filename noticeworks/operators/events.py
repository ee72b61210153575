"""The event ledger: coalescing, eligibility and sequence gates (W3, J16, R*)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]], passed: str = "eligible") -> Column:
    """The name of the first check that fails, in order."""
    out = F.lit(passed)
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def coalesce_updates(updates: DataFrame, case: str, at: str, order: str, hours: int = 24, retraction: Column | None = None, activity: Column | None = None, backfill_days: int = 30) -> DataFrame:
    """`updates` (case, order, at) with suppressed and its reason, `backfill`, `coalesced` or null.

    An update whose public `activity` lies more than `backfill_days` before it is a backfill, always suppressed and
    never counted as delivered. Of the others, a `retraction` is always delivered; any other one is suppressed if one
    was delivered within `hours` (inclusive) before. Null retractions are none, null activities no backfill.

    Each decision hangs on the one before, so a case is walked in order, in one task, which holds a batch of rows
    and the last delivered time, however long the case is.
    """
    span = pd.Timedelta(hours=hours)
    late = F.lit(False) if activity is None else F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(activity.cast("timestamp")) > backfill_days * 86_400_000_000, F.lit(False))
    always = F.lit(False) if retraction is None else F.coalesce(retraction, F.lit(False))
    rows = updates.select(case, order, at, late.alias("_late"), always.alias("_always"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = object(), None
        for pdf in batches:
            out = []
            for c, t, is_late, is_always in zip(pdf[case], pdf[at], pdf["_late"], pdf["_always"]):
                c = None if pd.isna(c) else c
                if c != now:
                    now, last = c, None
                if is_late:
                    out.append("backfill")
                elif not is_always and last is not None and t - last <= span:
                    out.append("coalesced")
                else:
                    out.append(None)
                    last = last if pd.isna(t) else t
            yield pdf[[case, order, at]].assign(suppressed=[r is not None for r in out], reason=pd.Series(out, dtype=object, index=pdf.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.select(case, order, at).schema) + ", suppressed boolean, reason string"
    dealt = rows.repartition(F.col(case)).sortWithinPartitions(F.col(case), F.col(at).asc_nulls_last(), F.col(order).asc_nulls_last())
    return dealt.mapInPandas(walk, schema)


def latest_operation(ops: DataFrame, key: str, sequence: str, op: str) -> DataFrame:
    """The operation that holds after out-of-order delivery: the greatest sequence wins, the least op among equals."""
    return ops.groupBy(key).agg(F.max(sequence).alias(sequence), F.min_by(op, F.struct(-F.col(sequence), F.col(op))).alias(op))

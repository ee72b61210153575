"""Polled sources and deliveries as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Delivery states, and where each outcome leads from them; a pair that is not listed leaves the state.
MOVES = {
    ("pending", "claim"): "sending",
    ("retryable", "claim"): "sending",
    ("sending", "accepted"): "ticket_accepted",
    ("sending", "retry"): "retryable",
    ("sending", "reject"): "permanent",
    ("ticket_accepted", "receipt_ok"): "receipt_ok",
    ("ticket_accepted", "receipt_retry"): "retryable",
    ("ticket_accepted", "reject"): "permanent",
}


def last_of_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key of a poll: the last by `order`."""
    return batch.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("r.*")


def poll(spark: SparkSession, path: str, schema: str, key: str, order: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Take all JSON files that landed since the last call, dedup each micro-batch by key and write it to `sink`.

    A batch has its own folder, overwritten when it is run again, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, n: int) -> None:
        last_of_batch(batch, key, order).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, attempts = state.get if state.exists else ("pending", 0)
    events = pd.concat(list(batches)).sort_values(["at", "outcome"], kind="stable")
    for outcome in events["outcome"]:
        step = MOVES.get((now, outcome), now)
        attempts += int(step == "sending" and now != "sending")
        now = step
    state.update((now, attempts))
    yield pd.DataFrame({"delivery": [key[0]], "state": [now], "attempts": [attempts]})


def deliveries(outcomes: DataFrame) -> DataFrame:
    """(delivery, state, attempts) after each micro-batch of (delivery string, at timestamp, outcome string).

    A delivery's outcomes apply in the order of `at` within a batch; final states take no more. Works on streams
    in update mode and on tables.
    """
    return outcomes.groupBy("delivery").applyInPandasWithState(_advance, "delivery string, state string, attempts int", "state string, attempts int", "update", GroupStateTimeout.NoTimeout)

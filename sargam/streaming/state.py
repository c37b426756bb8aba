"""Structured Streaming forms of what grows by appending: recent lists, daily ledgers, resumable results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def recent_lists(events: DataFrame, user: str, item: str, at: str, most: int = 200) -> DataFrame:
    """(user, recent array<string>) updated with each batch: the last ``most`` items in order, oldest first; repeats count each.

    State is bounded by ``most`` for each user. Within a batch a user's events are ordered by time; events of an earlier time in a later batch
    go to the end, as they arrive.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(frames)).sort_values(at, kind="stable")
        kept = (kept + [str(x) for x in batch[item] if x is not None])[-most:]
        state.update((kept,))
        yield pd.DataFrame({user: [key[0]], "recent": [kept]})

    kind = events.schema[user].dataType.simpleString()
    return events.where(F.col(user).isNotNull()).select(user, item, at).groupBy(user).applyInPandasWithState(update, f"{user} {kind}, recent array<string>", "recent array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n) by tumbling windows; events later than ``late`` behind the newest are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def resumable_upsert(stream: DataFrame, path: str, key: str, version: str, checkpoint: str):
    """Writes each batch's latest row of every key beside the earlier ones, batch by batch, so that a batch written twice is the same.

    Readers take the latest version of a key (``latest_rows``). Returns the started query.
    """

    def write(batch: DataFrame, number: int) -> None:
        from ..operators.catalog import top_per_key

        latest = top_per_key(batch, key, [F.col(version).desc_nulls_last()], 1).drop("rank")
        latest.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(table: DataFrame, key: str, version: str) -> DataFrame:
    from ..operators.catalog import top_per_key

    return top_per_key(table, key, [F.col(version).desc_nulls_last(), F.col("batch").desc()], 1).drop("rank", "batch")

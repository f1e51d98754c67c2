"""Extensions for streams: upserts of arriving rows, and windowed counts with late data. The batch engine has neither."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.store import Store


def upsert_stream(rows: DataFrame, store: Store, table: str, keys: list[str], order_col: str, checkpoint: str):
    """A query that merges each micro-batch into a stored table: of one key's rows in a batch the last by ``order_col``
    counts. A batch that is run again gives the same table, so a restart does no harm."""

    def merge(batch: DataFrame, _: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order_col).alias("r")).select(*keys, "r.*")
        store.upsert(table, last, keys)  # of the stored table only the buckets of these keys are written anew

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time_col: str = "ts", width: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Events and values by tumbling window; events later than the watermark are left out, and state ends with it."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, time_col: str = "ts", gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    return events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), by).agg(F.count("*").alias("n"))

"""Extension: a stream of writes into a snapshot table, one version a micro-batch, and exact dedup inside a horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.kv import SnapshotTable
from ..operators.ordered import latest


def upsert_stream(log: DataFrame, table: SnapshotTable, version: list[str], checkpoint: str) -> StreamingQuery:
    """Applies log(key, ..., version columns) batch by batch, the last write of a key in a batch winning.

    A batch that runs again after a failure upserts the same rows, so the table doesn't change twice.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = latest(batch, [table.key], version).select(table.schema.names)
        with table.writer() as changes:
            changes.upsert(rows)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_within(stream: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """The first row of each key while its event time stays inside the horizon; older state is dropped by the watermark."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)

"""Structured Streaming into tables: each micro-batch is one atomic part, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lamina.engine import Engine


def stream_into(
    engine: Engine,
    stream: DataFrame,
    database: str,
    name: str,
    checkpoint: str,
    source: str | None = None,
    order: list[str] | None = None,
    compact_every: int = 0,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Starts a query that inserts every micro-batch of ``stream`` into the table.

    The manifest keeps the last batch of ``source`` (by default the checkpoint folder), so a
    batch that is replayed after a failure is not inserted twice. All parts are merged
    after every ``compact_every`` batches, if that is above 0.
    """
    source = source or checkpoint

    def add(batch: DataFrame, epoch: int) -> None:
        engine.insert_df(database, name, batch, order, source, epoch)
        if compact_every and (epoch + 1) % compact_every == 0:
            engine.compact(database, name)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()

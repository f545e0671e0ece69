"""Streams of edges merged into stored graphs, and windowed counts of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Graph
from ..operators.store import GraphStore


def merge_stream(nodes_of, edges: DataFrame, store: GraphStore, checkpoint: str, strategy: str = "update") -> StreamingQuery:  # noqa: ANN001
    """Each micro-batch of edges (and the nodes that nodes_of makes of it) is merged into the store. The batch number is
    published in the same manifest as its rows, so a batch that is replayed after a failure has no second effect."""
    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read by each table's merge
        store.merge(Graph(nodes_of(batch), batch), strategy, number)
        batch.unpersist()

    return edges.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per window and kind of a stream or a table; rows later than the watermark are dropped in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("period"), kind, "n")

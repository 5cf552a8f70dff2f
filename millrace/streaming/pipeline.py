"""Streams into cubes: micro-batches are aggregated and added to a table, each batch once."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..operators import cube
from ..operators.ordering import in_blocks
from ..operators.table import CubeTable

Parse = Callable[[DataFrame], DataFrame]


def batch_delta(rows: DataFrame, table: CubeTable, counts: dict[str, Column | int]) -> DataFrame:
    """The cube of a batch, in the table's partitions."""
    return cube.time_partitioned(rows, table.spec, counts, table.part_length)


def cube_writer(stream: DataFrame, table: CubeTable, counts: dict[str, Column | int], checkpoint: str, parse: Parse | None = None, writer: str = "stream") -> DataStreamWriter:
    """A writer that adds each micro-batch to the table. No record is too late: it is added to its old partition.

    What is in flight is one batch; a batch that is replayed after a failure is skipped if it was applied. Set a trigger and
    start it: processingTime="1 second" runs on, availableNow=True drains the source and stops.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = parse(batch) if parse else batch
        table.upsert(batch_delta(rows, table, counts), writer, batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def soft_stop(query: StreamingQuery) -> None:
    """Takes in what the source has, then stops."""
    query.processAllAvailable()
    query.stop()


def hard_stop(query: StreamingQuery) -> None:
    query.stop()


def fan_out_writer(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> DataStreamWriter:
    """Every sink gets every batch; the batch is held for them."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


@dataclass
class Metrics(StreamingQueryListener):
    """Counts what queries have done: batches, rows, errors, by the query's name. Add it with spark.streams.addListener."""

    batches: dict[str, int] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    errors: dict[str, int] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def _add(self, to: dict[str, int], name: str, n: int) -> None:
        with self._lock:
            to[name] = to.get(name, 0) + n

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        name = event.progress.name or str(event.progress.id)
        self._add(self.batches, name, 1)
        self._add(self.rows, name, event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.exception:
            self._add(self.errors, str(event.id), 1)

    def report(self) -> dict:
        with self._lock:
            return {"batches": dict(self.batches), "rows": dict(self.rows), "errors": dict(self.errors)}


def batches_of(rows: DataFrame, seq: str, size: int, *values: str) -> DataFrame:
    """batch, n, items: rows gathered into batches of size places each, in order; a batch is an array of size structs at most."""
    batch = F.floor(F.col(seq) / size).cast("bigint").alias("batch")
    items = F.array_sort(F.collect_list(F.struct(seq, *values)))
    return rows.groupBy(batch).agg(F.count("*").alias("n"), items.alias("items"))


def timing(rows: DataFrame, seconds: Column) -> DataFrame:
    """items, seconds, per_hour: how many rows came between the first and the last second."""
    out = rows.agg(F.count("*").alias("items"), (F.max(seconds) - F.min(seconds)).alias("seconds"))
    return out.withColumn("per_hour", F.floor(F.col("items") * 3600 / F.nullif("seconds", F.lit(0))).cast("bigint"))


def event_counts(rows: DataFrame, op: Column, error: Column) -> DataFrame:
    """op, events, errors, summed in each task first: rows for Report.merge."""
    return rows.groupBy(op.alias("op")).agg(F.count("*").alias("events"), F.count_if(error).alias("errors"))


def running_count(batches: DataFrame, order: str, n: str, floor: int = 1, span: int = 5, size: int = 10_000) -> DataFrame:
    """Adds mean: the whole part of the mean of the last span counts, floor at least. In blocks of so many batches, each with those before it
    that its first ones need, so that no task has them all. ``stateful.moving_mean`` is the same for a stream."""
    from pyspark.sql import Window

    rows, block, place, precedes = in_blocks(batches, [order], span - 1, size)
    last = Window.partitionBy(block).orderBy(place).rowsBetween(-(span - 1), Window.currentRow)
    mean = F.greatest(F.floor(F.sum(n).over(last) / F.count(n).over(last)), F.lit(floor)).cast("bigint")
    return rows.withColumn("mean", mean).where(~F.col(precedes)).drop(block, place, precedes)

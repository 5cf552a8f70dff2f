"""Streams that remember: partitions that close as time goes on, a branch for each key, batches by size and time, moving means.

State lies in Spark's state store (RocksDB, with a change log in the checkpoint), so it outlives executors and restarts, and is spread over
tasks by key. What a key keeps is bounded: counts, what a branch says, the rows of one batch that is not full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from ..operators.cube import WEEK_START, bucket
from ..operators.spec import CubeSpec, epoch_seconds
from ..session import ship_code

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400


def state_store(spark: SparkSession) -> None:
    """Chooses the state store that keyed state needs, and ships the code to the executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship_code(spark)


@contextmanager
def data_batches_only(spark: SparkSession) -> Iterator[None]:
    """Streams that are started meanwhile have no micro-batches without rows. A stream with timers by the clock has such ones without end
    else, so that availableNow, which drains a source and stops, would not stop."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# ---- partitions that close


def closed_partitions(stream: DataFrame, spec: CubeSpec, counts: dict[str, Column | int], length: int = 1, delay: str = "0 seconds") -> DataFrame:
    """part_start and the cube's columns of each partition, once: when the largest time seen, less the delay, has passed its end.

    For output mode append. Spark's own windowed aggregate: partial sums in each task, state by key, rows that come after their partition has
    closed are dropped and counted (numRowsDroppedByWatermark). ``closed_and_late`` gives these too.
    """
    state_store(stream.sparkSession)
    rows = stream.withColumn(spec.time_col, epoch_seconds(stream, spec.time_col)).withColumn("__time", F.timestamp_seconds(spec.time_col))
    start = f"{WEEK_START} seconds" if length % (7 * DAY) == 0 else "0 seconds"
    window = F.window("__time", f"{length} seconds", startTime=start).alias("__window")
    of = lambda c: F.lit(c) if isinstance(c, int) else c
    sums = [F.coalesce(F.sum(of(c)), F.lit(0)).cast("bigint").alias(k) for k, c in counts.items()]
    grouped = rows.withWatermark("__time", delay).groupBy(window, *spec.dims).agg(*sums)
    return grouped.select(F.unix_seconds("__window.start").alias("part_start"), *spec.dims, *counts)


#: Seconds of time whose open sums share an entry of the state, and with it the calls from Python to the state store.
BLOCK = 1 << 18


class _Closing(StatefulProcessor):
    """Sums by partition and time, of all that a block of time has of a key, until the watermark passes a partition's end; what comes then is
    late and goes on as it is. New sums are put behind those that are there; all are added up when they have doubled, or when a partition closes."""

    def __init__(self, names: list[str], time: str, counts: list[str], length: int) -> None:
        self.names, self.at, self.counts, self.length = names, ["part_start", time], counts, length

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.open = handle.getListState("open", ", ".join(f"c{i} array<bigint>" for i in range(2 + len(self.counts))))
        # how many sums there are, how many there were when they were last added up, and the first end of a partition among them
        self.extent = handle.getValueState("extent", "held bigint, merged bigint, first bigint")

    def _sums(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts)[[*self.at, *self.counts]].groupby(self.at, as_index=False).sum()

    def _held(self) -> list[pd.DataFrame]:
        return [pd.DataFrame(dict(zip([*self.at, *self.counts], part, strict=True))) for part in self.open.get()]

    def _split(self, sums: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Those of partitions that have closed, and the others."""
        closed = (sums["part_start"] + self.length) * 1000 <= now
        return sums[closed], sums[~closed]

    def _first(self, sums: pd.DataFrame) -> int:
        return (int(sums["part_start"].min()) + self.length) * 1000

    def _value(self, sums: pd.DataFrame) -> tuple:
        return tuple(sums[c].tolist() for c in (*self.at, *self.counts))

    def _keep(self, sums: pd.DataFrame) -> int:
        """Writes the sums in place of those that are there, and returns their first end."""
        self.open.put([self._value(sums)])
        self.extent.update((len(sums), len(sums), self._first(sums)))
        return self._first(sums)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        parts = [self._sums([part]) for part in rows]
        late, new = self._split(parts[0] if len(parts) == 1 else self._sums(parts), timerValues.getCurrentWatermarkInMs())
        if len(late):
            yield late.assign(**dict(zip(self.names, key[1:], strict=True)), late=True)
        if not len(new):
            return
        if not self.extent.exists():
            self.handle.registerTimer(self._keep(new))
            return
        held, merged, before = self.extent.get()
        first = min(before, self._first(new))
        if held + len(new) > 2 * merged:
            self._keep(self._sums([*self._held(), new]))
        else:
            self.open.appendValue(self._value(new))
            self.extent.update((held + len(new), merged, first))
        if first < before:
            self.handle.deleteTimer(before)
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        closed, rest = self._split(self._sums(self._held()), timerValues.getCurrentWatermarkInMs())
        if len(closed):
            yield closed.assign(**dict(zip(self.names, key[1:], strict=True)), late=False)
        if len(rest):
            self.handle.registerTimer(self._keep(rest))
        else:
            self.open.clear()
            self.extent.clear()


def _as_text(c: str, kind: T.DataType) -> Column:
    """A key as text, which pandas holds as it is: of numbers with nulls it makes floating ones."""
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    return (F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.col(c)).cast("string")


def _from_text(c: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unbase64(c)
    return F.timestamp_micros(F.col(c).cast("bigint")) if isinstance(kind, T.TimestampType) else F.col(c).cast(kind)


def closed_and_late(stream: DataFrame, spec: CubeSpec, counts: dict[str, Column | int], length: int = 1, delay: str = "0 seconds") -> DataFrame:
    """As closed_partitions, with late: the sums of rows that came after their partition had closed, a row for each key and micro-batch.
    No record is lost: closed and late rows add up to all of those that are not open. A row without a time is in no partition.

    Rows are grouped by their dimensions and the block of time that they lie in, so what Python does for each group is done for BLOCK seconds."""
    state_store(stream.sparkSession)
    of = lambda c: F.lit(c) if isinstance(c, int) else c
    rows = stream.withColumn(spec.time_col, epoch_seconds(stream, spec.time_col)).withColumn("__time", F.timestamp_seconds(spec.time_col)).withWatermark("__time", delay)
    # the event time itself does not go on, so that Spark leaves late rows to the processor
    keyed = rows.select(bucket(F.col(spec.time_col), length).alias("part_start"), *spec.dims, *[F.coalesce(of(c), F.lit(0)).cast("bigint").alias(k) for k, c in counts.items()])
    kinds = {d: keyed.schema[d].dataType for d in spec.dims if d != spec.time_col}
    texts = keyed.where(F.col("part_start").isNotNull()).withColumns({d: _as_text(d, kind) for d, kind in kinds.items()})
    schema = T.StructType([*texts.schema.fields, T.StructField("late", T.BooleanType())])
    grouped = texts.withColumn("__block", F.floor(F.col(spec.time_col) / BLOCK)).groupBy("__block", *kinds)
    out = grouped.transformWithStateInPandas(_Closing(list(kinds), spec.time_col, list(counts), length), schema, "Append", "EventTime")
    return out.withColumns({d: _from_text(d, kind) for d, kind in kinds.items()})


def split_writer(stream: DataFrame, closed: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Both outputs of closed_and_late, each to its own sink, with the number of the micro-batch, which comes again after a failure."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            closed(batch.where("not late").drop("late"), batch_id)
            late(batch.where("late").drop("late"), batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")


# ---- a branch for each key

Make = Callable[[tuple], tuple]
Step = Callable[[tuple, tuple, pd.DataFrame], tuple[tuple, pd.DataFrame | None]]
Final = Callable[[tuple, tuple], pd.DataFrame | None]


class _Branch(StatefulProcessor):
    def __init__(self, state: str, make: Make, step: Step, final: Final | None, idle_ms: int | None, together: bool) -> None:
        self.schema, self.make, self.step, self.final, self.idle_ms, self.together = state, make, step, final, idle_ms, together

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.state = handle.getValueState("branch", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = tuple(self.state.get()) if self.state.exists() else self.make(key)
        for part in [pd.concat(list(rows))] if self.together else rows:
            now, out = self.step(key, now, part)
            if out is not None and len(out):
                yield out
        self.state.update(tuple(now))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = self.final(key, tuple(self.state.get())) if self.final else None
        self.state.clear()
        if out is not None and len(out):
            yield out


def branches(stream: DataFrame, keys: list[str], state: str, make: Make, step: Step, schema: str, final: Final | None = None, idle_ms: int | None = None, together: bool = False) -> DataFrame:
    """A branch for each key, made when the key is first seen, that lives on over micro-batches and restarts.

    make(key) gives its first state, a tuple as the schema ``state`` says; step(key, state, rows) takes some of the key's rows in a micro-batch
    (in several parts, but for together) and gives the next state and rows of ``schema`` or None. With idle_ms, a branch that has had
    no row for so long ends: final(key, state) may give last rows, and the key begins anew when it comes again. A key's rows are
    one task's: give a key with very many rows a salt among ``keys``, and sum up after it.
    """
    state_store(stream.sparkSession)
    mode = "ProcessingTime" if idle_ms is not None else "None"
    return stream.groupBy(*keys).transformWithStateInPandas(_Branch(state, make, step, final, idle_ms, together), schema, "Update", mode)


# ---- batches by size and time


class _Batcher(StatefulProcessor):
    def __init__(self, keys: list[str], values: list[str], fields: str, size: int, wait_ms: int, credit: int | None) -> None:
        self.keys, self.values, self.fields, self.size, self.wait_ms, self.credit = keys, values, fields, size, wait_ms, credit

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.held = handle.getListState("held", self.fields)
        self.count = handle.getValueState("count", "batch bigint, n bigint")

    def _batches(self, key: tuple, number: int, rows: list[tuple], sizes: list[int], why: str) -> pd.DataFrame:
        out, at = {c: [] for c in (*self.keys, "batch", "n", "why", "items")}, 0
        for i, n in enumerate(sizes):
            for k, v in zip(self.keys, key, strict=True):
                out[k].append(v)
            out["batch"].append(number + i)
            out["n"].append(n)
            out["why"].append(why)
            out["items"].append([dict(zip(self.values, r, strict=True)) for r in rows[at : at + n]])
            at += n
        return pd.DataFrame(out)

    def _timer(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        number, n = self.count.get() if self.count.exists() else (0, 0)
        was, new = n, []
        for part in rows:
            new += list(part[self.values].astype(object).where(part[self.values].notna(), None).itertuples(index=False, name=None))
        n += len(new)
        full = n // self.size if self.credit is None else min(n // self.size, self.credit)
        if full:
            every = [tuple(r) for r in self.held.get()] + new if was else new
            yield self._batches(key, number, every, [self.size] * full, "size")
            number, n, new = number + full, n - full * self.size, every[full * self.size :]
            self.held.clear()
        if new:
            self.held.appendList(new) if self.held.exists() else self.held.put(new)
        self.count.update((number, n))
        if n and (full or not was):
            self._timer(timerValues.getCurrentProcessingTimeInMs() + (1 if n >= self.size else self.wait_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        number, n = self.count.get()
        if not n:
            return
        rows = [tuple(r) for r in self.held.get()]
        full = n // self.size if self.credit is None else min(n // self.size, self.credit)
        sizes = [self.size] * full if full else [n]
        yield self._batches(key, number, rows, sizes, "size" if full else "time")
        rest = rows[sum(sizes) :]
        self.held.clear()
        if rest:
            self.held.put(rest)
            self._timer(timerValues.getCurrentProcessingTimeInMs() + (1 if len(rest) >= self.size else self.wait_ms))
        self.count.update((number + len(sizes), len(rest)))


def batched(stream: DataFrame, keys: list[str], size: int, wait_ms: int, credit: int | None = None) -> DataFrame:
    """Rows gathered to batches of ``size`` for each key: keys, batch (0, 1, ...), n, why ("size" or "time"), items (array of the other columns).

    A batch goes on when it is full, or when its first row has waited for wait_ms. credit: full batches of a key that may go on in one
    micro-batch; the next one begins when those have been taken by the sink. Rows of a batch that is not full lie in the state
    store: at a stop nothing is lost, the next run goes on with them, and ``held`` reads them without a run. To drain a source and stop,
    start the stream in ``data_batches_only``.
    """
    if size < 1 or credit is not None and credit < 1:
        raise ValueError("size and credit must be 1 at least")
    state_store(stream.sparkSession)
    values = [f for f in stream.schema.fields if f.name not in keys]
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in values])
    fields = [*[T.StructField(k, stream.schema[k].dataType) for k in keys], T.StructField("batch", T.LongType()), T.StructField("n", T.LongType()), T.StructField("why", T.StringType()), T.StructField("items", T.ArrayType(kept))]
    names = [f.name for f in values]
    return stream.groupBy(*keys).transformWithStateInPandas(_Batcher(keys, names, kept, size, wait_ms, credit), T.StructType(fields), "Append", "ProcessingTime")


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that ``batched`` holds in the state under a checkpoint: its keys, and the rows' columns."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").option("flattenCollectionTypes", True).load()
    return state.select("key.*", "list_element.*")


# ---- moving means


def moving_mean(stream: DataFrame, keys: list[str], order: str, n: str, floor: int = 1, span: int = 5) -> DataFrame:
    """keys, order, n, mean: the whole part of the mean of the key's last span counts, floor at least. What is kept is these span counts. A
    micro-batch's rows of a key are taken in their order."""

    def step(key: tuple, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame | None]:
        rows, last, means = rows.sort_values(order), list(state[0]), []
        for count in rows[n].tolist():
            last = [*last, int(count)][-span:]
            means.append(max(floor, sum(last) // len(last)))
        out = {k: [v] * len(rows) for k, v in zip(keys, key, strict=True)} | {order: rows[order].tolist(), n: rows[n].tolist(), "mean": means}
        return (last,), pd.DataFrame(out)

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", f"{n} bigint", "mean bigint"])
    return branches(stream.select(*keys, order, n), keys, "last array<bigint>", lambda key: ([],), step, schema, together=True)

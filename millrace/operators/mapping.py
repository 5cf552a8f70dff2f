"""Maps from a row to any number of rows, chains, fan-out and routing.

A map that built-in expressions can say is a projection, a filter or an explode. A Python callback runs over Arrow batches,
with state for each worker task, and may give more rows when its task ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship_code

Rows = Iterable[dict]


def identity(df: DataFrame) -> DataFrame:
    """Every row as it is."""
    return df.select("*")


def project(df: DataFrame, **columns: Column) -> DataFrame:
    """One row for each: these columns, by name."""
    return df.select(*[c.alias(name) for name, c in columns.items()])


def keep(df: DataFrame, condition: Column | str) -> DataFrame:
    """The row, or none."""
    return df.where(condition)


def cast_message(df: DataFrame, schema: str) -> DataFrame:
    """The same rows as messages of another schema: columns by name, cast; raises if a value can't be cast (ANSI mode)."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def observed(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, Observation]:
    """The rows as they are, and what passed: their count and other aggregates, to be had from the observation after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in aggregates.items()]), seen


def tail(df: DataFrame, say: Callable[[str], None]) -> DataFrame:
    """The rows as they are; each is said in the task that has it, as text."""
    from ..sources.sinks import shown

    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                say("\t".join(map(shown, row)))
            yield batch

    return df.mapInArrow(run, df.schema)


def first_items(df: DataFrame, n: int, *order: str) -> DataFrame:
    """At most n rows, the first in this order; 0 gives none. Each task keeps n rows, of which n are kept."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def flat_map(df: DataFrame, outputs: Column, name: str) -> DataFrame:
    """A row for each element of the array outputs: none drops the row, one projects it."""
    return df.select(*df.columns, F.explode(outputs).alias(name))


def ordered_flat_map(df: DataFrame, seq: str, outputs: Column, name: str) -> DataFrame:
    """Adds pos, and orders by (seq, pos): outputs come in the order of their inputs, those of one input together."""
    return df.select(*df.columns, F.posexplode(outputs).alias("pos", name)).orderBy(seq, "pos")


def ordered_in_place(rows: DataFrame, place: str, outputs: Column, name: str) -> DataFrame:
    """Adds pos: outputs of the rows of ``ordering.in_order`` with (place, pos) as their order, those of one input together. Rows stay in the
    tasks that have read them, in the order of the files; a reader that wants a range of the order asks for places, none is sorted."""
    return rows.select(*rows.columns, F.posexplode(outputs).alias("pos", name)).withColumn("pos", F.col("pos").cast("bigint"))


def map_workers(df: DataFrame, make: Callable[[], Callable[[dict], Rows]], schema: str, final: Callable[[Callable], Rows] | None = None, close: Callable[[Callable], None] | None = None) -> DataFrame:
    """Runs a callback that make() builds anew for each task, so its state is the task's own.

    final(callback) may give more rows when the task's input ends; close(callback) runs then too, and if the task fails.
    """
    ship_code(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        callback = make()

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        try:
            for batch in batches:
                rows = [out for row in batch.to_pylist() for out in callback(row)]
                if rows:
                    yield packed(rows)
            rows = list(final(callback)) if final else []
            if rows:
                yield packed(rows)
        finally:
            if close:
                close(callback)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, final: Callable[[Callable], pa.RecordBatch | None] | None = None) -> DataFrame:
    """As map_workers, for a callback from whole batches to whole batches (or None): no row becomes a Python object."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        callback = make()
        for batch in batches:
            out = callback(batch)
            if out is not None:
                yield out
        out = final(callback) if final else None
        if out is not None:
            yield out

    return df.mapInArrow(run, schema)


def with_exit(action: Callable[[], object], hook: Callable[[BaseException | None], None]) -> object:
    """Runs an action and then, when all its tasks have ended, well or not, the hook once. For streams there is sinks.OnExit."""
    try:
        out = action()
    except BaseException as e:
        hook(e)
        raise
    hook(None)
    return out


def serial(df: DataFrame) -> DataFrame:
    """One task does the rest of the stage."""
    return df.coalesce(1)


def drop_all(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def fan_out(df: DataFrame, branches: list[Callable[[DataFrame], DataFrame]]) -> list[DataFrame]:
    """Every branch gets every row."""
    return [df.transform(b) for b in branches]


def distribute(df: DataFrame, key: Column, branch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows go to the branch of their key; branch gets them with the key as __key, and groups by it."""
    return branch(df.withColumn("__key", key))


def branches(df: DataFrame, key: str, make: Callable[[object], Callable[[dict], Rows]], schema: str, final: Callable[[Callable], Rows] | None = None, salt: int = 1) -> DataFrame:
    """A branch for each key, which make(key) builds when the key is first seen; it gets the key's rows, and final(branch) ends it.

    Rows are dealt by key. A key with very many rows is spread over ``salt`` tasks, which have a branch of it each: what final gives
    is then to be summed up. What a group-by can say is better said by ``distribute``.
    """

    class Branches:
        def __init__(self) -> None:
            self.of: dict = {}

        def __call__(self, row: dict) -> Rows:
            k = row[key]
            if k not in self.of:
                self.of[k] = make(k)
            return self.of[k](row)

        def end(self) -> Iterator[dict]:
            for branch in self.of.values():
                yield from final(branch)

    dealt = df.repartition(F.col(key), F.pmod(F.monotonically_increasing_id(), F.lit(salt))) if salt > 1 else df.repartition(F.col(key))
    return map_workers(dealt, Branches, schema, Branches.end if final else None)


def branch_batches(df: DataFrame, key: str, make: Callable[[object], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, final: Callable[[Callable], pa.RecordBatch | None] | None = None, salt: int = 1) -> DataFrame:
    """As branches, for callbacks that take what a batch has of their key as a batch: no row becomes a Python object."""

    class Branches:
        def __init__(self) -> None:
            self.of: dict = {}

        def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
            column, out = batch.column(names.index(key)), []
            for k in column.unique():
                value = k.as_py()
                if value not in self.of:
                    self.of[value] = make(value)
                out.append(self.of[value](batch.filter(pc.is_null(column) if value is None else pc.equal(column, k))))
            return joined(out)

        def end(self) -> pa.RecordBatch | None:
            return joined([final(branch) for branch in self.of.values()])

    def joined(parts: list[pa.RecordBatch | None]) -> pa.RecordBatch | None:
        found = [p for p in parts if p is not None and p.num_rows]
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None

    names = df.columns
    dealt = df.repartition(F.col(key), F.pmod(F.monotonically_increasing_id(), F.lit(salt))) if salt > 1 else df.repartition(F.col(key))
    return map_batches(dealt, Branches, schema, Branches.end if final else None)


def ordered_chain(df: DataFrame, seq: str, *steps: Callable[[DataFrame], Column]) -> DataFrame:
    """A chain whose outputs come in the order of their inputs. Each step gives an array of structs for a row; the row's place is carried
    as an array of positions, and rows are sorted once, at the end."""
    rows = df.withColumn("__at", F.array(F.col(seq).cast("bigint")))
    for step in steps:
        rows = rows.select("__at", F.posexplode(step(rows.drop("__at"))).alias("__pos", "__out"))
        rows = rows.select(F.concat("__at", F.array(F.col("__pos").cast("bigint"))).alias("__at"), "__out.*")
    return rows.orderBy("__at").drop("__at")


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One plan of several steps; a chain is a step itself."""
    for step in steps:
        df = df.transform(step)
    return df

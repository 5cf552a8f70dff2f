"""Places of rows in an order, without a sort of everything in one task.

Rows are dealt to tasks by ranges of the order, so that a group with very many rows lies in many ranges. A task counts within its
range; what it has to add is what earlier ranges have of the group that goes on in it: one row for each range, which the driver
sums up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, new_folder, ship_code


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _runs(by: int, part: str, place: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the range's number and each row's place in the run of rows that have equal values in the first ``by`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for key in zip(*(batch.column(i).to_pylist() for i in range(by)), strict=True) if by else [()] * batch.num_rows:
                at = at + 1 if key == last else 0
                last = key
                places.append(at)
            columns = [*batch.columns, pa.array([number] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, part, place])

    return run


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "place", first: int = 0) -> DataFrame:
    """Adds each row's place, from ``first`` on, among the rows with equal values in ``by``; nulls are equal and come first.

    Rows that are equal in ``by`` and ``order`` get places in any order. The rows are written once, in the shared folder, dealt by
    range; what comes to the driver is a row for each range. An empty table gives none.
    """
    spark = df.sparkSession
    ship_code(spark)
    bound_batches(spark)
    part, place, carried, tie = fresh(df, "range", "run_place", "carried", "tie")
    rest = [c for c in df.columns if c not in by]
    rows = df.select(*by, *rest).withColumn(tie, F.monotonically_increasing_id())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(tasks, *by, *order, tie).sortWithinPartitions(*by, *order, tie).drop(tie)
    schema = T.StructType([*rows.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(place, T.LongType())])
    path = new_folder(spark, "ranges")
    rows.mapInArrow(_runs(len(by), part, place), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)

    # the last run of each range, and whether it is all that the range has
    whole = [F.count("*").alias("n"), F.max(place).alias("most")]
    keys = [F.max(F.struct(*by)).alias("key"), F.min(F.struct(*by)).alias("least")] if by else []
    ends = rows.groupBy(part).agg(*keys, *whole).alias("e")
    if by:
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.key.{c}")) for c in by]
        last = rows.alias("r").join(F.broadcast(ends), (F.col(f"r.{part}") == F.col(f"e.{part}")))
        for c in same:
            last = last.where(c)
        ends = last.groupBy(F.col(f"e.{part}").alias(part), F.col("e.key").alias("key"), F.col("e.least").alias("least")).agg(F.count("*").alias("n"))
    carry, total, key = [], 0, None
    for r in sorted(ends.collect(), key=lambda r: r[part]):
        least, most = (tuple(r["least"]), tuple(r["key"])) if by else ((), ())
        if key == least and total:
            carry.append((r[part], *least, total))
        total = total + r["n"] if key == most and least == most else r["n"]
        key = most
    fields = [T.StructField(part, T.IntegerType()), *[df.schema[c] for c in by], T.StructField(carried, T.LongType())]
    fields = [T.StructField(f.name, f.dataType) for f in fields]
    carries = F.broadcast(spark.createDataFrame(carry, T.StructType(fields)).coalesce(1)).alias("c")
    on = F.col(f"r.{part}") == F.col(f"c.{part}")
    for c in by:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    out = rows.alias("r").join(carries, on, "left")
    value = F.col(f"r.{place}") + F.coalesce(F.col(f"c.{carried}"), F.lit(0)) + first
    return out.select(*[F.col(f"r.{c}") for c in df.columns], value.alias(name))


def in_order(spark: SparkSession, path: str, name: str = "place", columns: list[str] | None = None) -> DataFrame:
    """Rows of Parquet files with their places from 0 on: files in order of their paths, rows as they stand in them. Nothing is moved or sorted:
    a row's place is what its file begins with, and its number in the file, however the file is split into tasks.

    Two passes: the first reads no column and counts the rows of each file, a row of which each comes to the driver.
    """
    files = spark.read.parquet(path)
    file, at, begins = fresh(files, "file", "at", "begins")
    rows = files.select(*(columns or files.columns), F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    counts = files.select(F.col("_metadata.file_path").alias(file)).groupBy(file).agg(F.count("*").alias("n")).collect()
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r[file]):
        starts.append((r[file], total))
        total += r["n"]
    known = F.broadcast(spark.createDataFrame(starts, f"`{file}` string, `{begins}` bigint").coalesce(1))
    return rows.join(known, file).withColumn(name, F.col(begins) + F.col(at)).drop(file, at, begins)


def in_blocks(df: DataFrame, order: list[str], before: int, size: int = 10_000) -> tuple[DataFrame, str, str, str]:
    """For windows over the last rows of a whole table: df in blocks of ``size`` rows of the order, each with the ``before`` rows that precede it
    as well. Also the names of the columns that say the block, the place, and whether a row only precedes (it is a block's own elsewhere)."""
    if not 0 <= before < size:
        raise ValueError("a block must be larger than what precedes it")
    block, place, precedes = fresh(df, "block", "place", "precedes")
    rows = numbered(df, [], order, place)
    rows = rows.withColumns({block: F.floor(F.col(place) / size), precedes: F.lit(False)})
    edge = rows.where(F.pmod(F.col(place), F.lit(size)) >= size - before).withColumns({block: F.col(block) + 1, precedes: F.lit(True)})
    return rows.unionByName(edge), block, place, precedes

"""A buffer of records in memory with a cursor, and a bounded replay buffer with acknowledgements."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class MemoryBuffer:
    """Records in order; None is never given out."""

    def __init__(self, records: list | None = None) -> None:
        self.records, self.at = list(records or []), 0

    def write(self, record: object) -> None:
        self.records.append(record)

    def scan(self, position: int) -> None:
        self.at = position

    def read_next(self) -> object:
        """The next record; raises StopIteration at the end."""
        while self.at < len(self.records):
            self.at += 1
            if self.records[self.at - 1] is not None:
                return self.records[self.at - 1]
        raise StopIteration

    def __iter__(self) -> Iterator:
        return (r for r in self.records[self.at :] if r is not None)

    def __len__(self) -> int:
        return len(self.records)

    def __getitem__(self, i: int) -> object:
        return self.records[i]

    def byte_size(self) -> int:
        return sum(len(r) for r in self.records if r is not None)

    def clear(self) -> None:
        self.records, self.at = [], 0

    def to_df(self, spark: SparkSession, schema: str = "value binary") -> DataFrame:
        return spark.createDataFrame([(r,) for r in self], schema)


def objects(spark: SparkSession, records: list, schema: str) -> DataFrame:
    """Objects (tuples, dicts or rows) of which None is skipped."""
    return spark.createDataFrame([r for r in records if r is not None], schema)


def present(df: DataFrame, value: str = "value") -> DataFrame:
    """The fields of a struct column, without the rows where it is null: objects that have been read by tasks."""
    return df.where(F.col(value).isNotNull()).select(f"{value}.*")


def stats(df: DataFrame, value: str) -> DataFrame:
    """n, bytes of a buffer that is spread over tasks: what len() and byte_size() say of a MemoryBuffer; null is no record's bytes."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).cast("bigint").alias("bytes"))


def acknowledged(df: DataFrame, sender: str, seq: str) -> DataFrame:
    """Adds newly_acked: what each cumulative acknowledgement makes a sender forget, as ReplayBuffer.ack counts it. An acknowledgement that
    is not above the largest one before it forgets nothing."""
    before = Window.partitionBy(sender).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("newly_acked", F.greatest(F.lit(0), F.col(seq) - F.coalesce(F.max(seq).over(before), F.lit(0))))


class ReplayBuffer:
    """Records that were sent and not acknowledged. Numbers begin with 1."""

    def __init__(self, bound: int = 20_000) -> None:
        self.bound, self.held, self.last, self.acked = bound, deque(), 0, 0

    def add(self, record: bytes) -> int:
        if len(self.held) >= self.bound:
            raise BufferError("too many records are not acknowledged")
        self.held.append(record)
        self.last += 1
        return self.last

    def ack(self, seq: int) -> int:
        """Forgets records up to seq; how many that were."""
        if seq > self.last:
            raise ValueError("acknowledges what was never sent")
        n = max(0, seq - self.acked)
        for _ in range(n):
            self.held.popleft()
        self.acked = max(self.acked, seq)
        return n

    def renumber(self) -> list[tuple[int, bytes]]:
        """After a reconnection: what is left, numbered from 1."""
        self.acked, self.last = 0, len(self.held)
        return list(enumerate(self.held, 1))

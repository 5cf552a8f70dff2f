"""Queries of streams that remember. Each writes the events as some files, which a stream takes one by one, and reads what it has written."""

from __future__ import annotations

from contextlib import nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from ..sources import framed
from ..streaming import stateful
from .cubes import COUNT, E_SQL, EVENTS, hourly, hourly_rows, query, read

#: Files that a stream of events has.
FILES = 4


def event_files(spark: SparkSession, sf_dir: str, files: int, *columns: str) -> str:
    """A folder with the events in this many files, each with some of all times."""
    path = new_folder(spark, "events")
    read(spark, sf_dir, "events").select(*columns).repartition(files, "event_id").write.parquet(path)
    return path


def stream_of(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return (source.option("maxFilesPerTrigger", per_trigger) if per_trigger else source).parquet(path)


def drained(out: DataFrame, name: str, mode: str = "append", timers: bool = False) -> tuple[DataFrame, str]:
    """What a stream gives until its source is empty, and its checkpoint. Files go by the micro-batch, and one that comes again is written once."""
    spark = out.sparkSession
    path, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    with stateful.data_batches_only(spark) if timers else nullcontext():
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/batch=*"), checkpoint


@query(f"""SELECT s AS part_start, s AS ts, event_type, count(*)::BIGINT AS n FROM {E_SQL} WHERE s < (SELECT max(s) FROM {E_SQL}) GROUP BY ALL""")
def cube_flush_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions that have closed in one pass over the events, in any order: all but the newest."""
    events = stream_of(spark, event_files(spark, sf_dir, FILES, "event_id", "ts", "event_type"))
    return drained(stateful.closed_partitions(events, EVENTS, COUNT), "closed")[0]


@query(f"""SELECT s AS part_start, s AS ts, event_type, count(*)::BIGINT AS n FROM {E_SQL} WHERE s < (SELECT max(s) FROM {E_SQL}) GROUP BY ALL""")
def cube_flush_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from files that come one by one, out of order: most rows are late, and closed and late ones add up to all."""
    events = stream_of(spark, event_files(spark, sf_dir, FILES, "event_id", "ts", "event_type"), 1)
    out = drained(stateful.closed_and_late(events, EVENTS, COUNT), "closed-late")[0]
    return out.groupBy("part_start", "ts", "event_type").agg(F.sum("n").alias("n"))


def _opened(key: tuple) -> tuple:
    return (0, 0)


def _counted(key: tuple, state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
    n, total = state[0] + len(rows), state[1] + int(rows["w"].sum())
    return (n, total), pd.DataFrame({"event_type": [key[0]], "salt": [key[1]], "n": [n], "total": [total]})


@query("""SELECT event_type, count(*)::BIGINT AS n, sum(user_id % 7)::BIGINT AS total FROM events GROUP BY ALL""")
def branch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch for each type and salt counts on from micro-batch to micro-batch; the last count of each is summed up."""
    path = event_files(spark, sf_dir, FILES, "event_id", "event_type", "user_id")
    events = stream_of(spark, path, 1).select("event_type", F.pmod("event_id", F.lit(16)).alias("salt"), F.pmod("user_id", F.lit(7)).alias("w"))
    out = stateful.branches(events, ["event_type", "salt"], "n bigint, total bigint", _opened, _counted, "event_type string, salt bigint, n bigint, total bigint")
    last = drained(out, "branches", "update")[0].groupBy("event_type", "salt").agg(F.max_by("total", "n").alias("total"), F.max("n").alias("n"))
    return last.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("""SELECT k AS shard, n // 50 AS full_batches, n % 50 AS held, total FROM (
  SELECT (event_id % 32)::BIGINT AS k, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL)""")
def batch_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 50 events for each of 32 shards, that go on when they are full; what a stop leaves is in the state. total: the ids of both."""
    rows = stream_of(spark, event_files(spark, sf_dir, FILES, "event_id"), 1).select(F.pmod("event_id", F.lit(32)).alias("shard"), "event_id")
    full, checkpoint = drained(stateful.batched(rows, ["shard"], 50, 3_600_000), "batches", timers=True)
    sums = full.select("shard", F.lit(1).alias("full"), F.lit(0).alias("held"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["event_id"]).alias("total"))
    rest = stateful.held(spark, checkpoint).select("shard", F.lit(0).alias("full"), F.lit(1).alias("held"), F.col("event_id").alias("total"))
    return sums.unionByName(rest).groupBy("shard").agg(F.sum("full").alias("full_batches"), F.sum("held").alias("held"), F.sum("total").alias("total"))


@query(f"""WITH h AS (SELECT event_type, hour, count(*) AS n FROM {E_SQL} GROUP BY ALL)
SELECT event_type, hour, n::BIGINT AS n, greatest(sum(n) OVER w // count(*) OVER w, 1)::BIGINT AS mean FROM h
WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def moving_mean_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a type's last five hourly counts, as a stream that keeps five counts of each type."""
    path = new_folder(spark, "hours")
    hourly(hourly_rows(spark, sf_dir)).select("event_type", "hour", "n").write.parquet(path)
    return drained(stateful.moving_mean(stream_of(spark, path), ["event_type"], "hour", "n"), "means", "update")[0]


@query("""SELECT event_id, props FROM events""")
def frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a stream writes as framed files, an epoch for each file that it takes, and that another stream reads back in parts."""
    framed.register(spark)
    path = new_folder(spark, "framed")
    record = F.concat(F.col("event_id").cast("string"), F.lit("\t"), F.coalesce("props", F.lit("")))
    events = stream_of(spark, event_files(spark, sf_dir, FILES, "event_id", "props"), 1).select(record.cast("binary").alias("value"))
    writer = events.writeStream.format("framed").option("checkpointLocation", new_folder(spark, "framed-checkpoint")).trigger(availableNow=True)
    writer.start(path).awaitTermination()
    back = spark.readStream.format("framed").option("splitBytes", 1 << 20).load(path).select(F.col("value").cast("string").alias("v"))
    parts = F.split("v", "\t", 2)
    return drained(back, "frames")[0].select(F.get(parts, F.lit(0)).cast("bigint").alias("event_id"), F.get(parts, F.lit(1)).alias("props"))

"""Queries about records: maps, topologies, sources and sinks, codecs, routing, batches."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import cube, mapping, ordering, routing
from ..operators.spec import epoch_seconds
from ..operators.table import CubeTable
from ..session import new_folder
from ..sources import framed, memory, sinks
from ..streaming import pipeline
from .cubes import COUNT, DAY, E_SQL, EVENTS, HOUR, query, read

# ---- maps


@query("""SELECT event_id, upper(event_type) AS kind, round(value * 100)::BIGINT AS cents FROM events""")
def map_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.project(read(spark, sf_dir, "events"), event_id=F.col("event_id"), kind=F.upper("event_type"), cents=F.round(F.col("value") * 100).cast("bigint"))


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 5""")
def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.keep(read(spark, sf_dir, "events"), (F.col("event_type") == "click") & (F.col("value") > 5)).select("event_id", "user_id")


@query(r"""SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word FROM documents""")
def map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mapping.flat_map(docs, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), "word").select("doc_id", "word")


@query("""SELECT * FROM nation""")
def map_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.observed(mapping.identity(read(spark, sf_dir, "nation")), "nations")[0]


@query("""SELECT event_id AS seq, unnest(range(0, user_id % 4))::BIGINT AS pos, event_type || '-' || unnest(range(0, user_id % 4)) AS item FROM events""")
def map_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type", "user_id")
    n = F.pmod("user_id", F.lit(4))
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.concat_ws("-", F.col("event_type"), i.cast("string"))))
    return mapping.ordered_flat_map(rows, "seq", items, "item").select("seq", F.col("pos").cast("bigint").alias("pos"), "item")


@query("""SELECT place, pos, part FROM (SELECT place, unnest(range(0, len(parts)))::BIGINT AS pos, unnest(parts) AS part
  FROM (SELECT row_number() OVER () - 1 AS place, string_split(event_type || '-' || user_id, '-') AS parts FROM events))""")
def map_ordered_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows as they stand in the files; nothing is sorted or moved."""
    rows = ordering.in_order(spark, f"{sf_dir}/events.parquet", columns=["event_type", "user_id"])
    parts = F.split(F.concat_ws("-", "event_type", F.col("user_id").cast("string")), "-")
    return mapping.ordered_in_place(rows, "place", parts, "part").select("place", "pos", "part")


class _Dedup:
    """A callback with state of its own: gives each type once in a task."""

    def __init__(self) -> None:
        self.seen: set[str | None] = set()

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        new = [x for x in batch.column(0).unique().to_pylist() if x not in self.seen]
        self.seen.update(new)
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string())], names=["event_type"]) if new else None


@query("""SELECT DISTINCT event_type FROM events""")
def map_worker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task gives a type once; what tasks have in common is made one afterwards, so their number doesn't matter."""
    return mapping.map_batches(read(spark, sf_dir, "events").select("event_type"), _Dedup, "event_type string").distinct()


@query("""SELECT event_id, row_number() OVER (ORDER BY event_id)::BIGINT - 1 AS place FROM events""")
def map_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that a single worker would give; here many do, each for a range."""
    return ordering.numbered(read(spark, sf_dir, "events").select("event_id"), [], ["event_id"])


class _Sums:
    """Keeps sums by type, and gives them at its end."""

    def __init__(self) -> None:
        self.sums: Counter = Counter()

    def __call__(self, batch: pa.RecordBatch) -> None:
        for found in batch.column(0).value_counts().to_pylist():
            self.sums[found["values"]] += found["counts"]

    def final(self) -> pa.RecordBatch | None:
        return pa.RecordBatch.from_arrays([pa.array(self.sums.keys(), pa.string()), pa.array(self.sums.values(), pa.int64())], names=["event_type", "n"]) if self.sums else None


@query("""SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def map_final_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type")
    partial = mapping.map_batches(rows, _Sums, "event_type string, n bigint", final=_Sums.final)
    return partial.groupBy("event_type").agg(F.sum("n").alias("n"))


# ---- topology


@query("""SELECT 'low' AS branch, event_id FROM events WHERE value < 10 UNION ALL SELECT 'all', event_id FROM events""")
def fanout_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, every = mapping.fan_out(read(spark, sf_dir, "events"), [lambda d: d.where("value < 10").select(F.lit("low").alias("branch"), "event_id"), lambda d: d.select(F.lit("all").alias("branch"), "event_id")])
    return low.unionByName(every)


@query("""SELECT user_id AS branch, count(*)::BIGINT AS n, min(event_id) AS first_event FROM events GROUP BY ALL""")
def distribute_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = lambda d: d.groupBy(F.col("__key").alias("branch")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return mapping.distribute(read(spark, sf_dir, "events"), F.col("user_id"), branch)


class _First:
    """A branch: counts its rows, and says at its end how many it had."""

    def __init__(self, kind: str | None) -> None:
        self.kind, self.n = kind, 0

    def __call__(self, batch: pa.RecordBatch) -> None:
        self.n += batch.num_rows

    def final(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.kind], pa.string()), pa.array([self.n], pa.int64()), pa.array([1], pa.int32())], names=["event_type", "n", "branches"])


@query("""SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def distribute_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch for each type in each of eight tasks, made when the type is first seen."""
    rows = read(spark, sf_dir, "events").select("event_type")
    return mapping.branch_batches(rows, "event_type", _First, "event_type string, n bigint, branches int", _First.final, salt=8).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("""SELECT event_id, pos, part || '!' AS part FROM (SELECT event_id, unnest(range(1, len(string_split(event_type, 'e')) + 1))::BIGINT - 1 AS pos, unnest(string_split(event_type, 'e')) AS part FROM events) WHERE part <> ''""")
def chain_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps that keep order: split each type, then drop empty parts and mark the others."""
    parts = lambda d: F.transform(F.split("event_type", "e"), lambda x, i: F.struct(F.col("event_id"), i.cast("bigint").alias("pos"), x.alias("part")))
    marked = lambda d: F.filter(F.array(F.struct("event_id", "pos", F.concat("part", F.lit("!")).alias("part"))), lambda s: s["part"] != "!")
    return mapping.ordered_chain(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", parts, marked)


@query("""SELECT event_type, count(*)::BIGINT AS n FROM events WHERE value > 1 GROUP BY ALL""")
def chain_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = lambda d: mapping.chain(d, lambda x: x.where("value > 1"), lambda x: x.select("event_type"))
    return mapping.chain(read(spark, sf_dir, "events"), inner, lambda d: cube.aggregate(d, ["event_type"], COUNT))


@query("""SELECT event_id FROM events WHERE false""")
def op_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.drop_all(read(spark, sf_dir, "events").select("event_id"))


# ---- sources and sinks


@query("""SELECT r_regionkey::BIGINT AS place, r_name AS value FROM region""")
def src_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded buffer of records (the regions) as a source."""
    rows = read(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # a fixed table of five rows
    buffer = memory.MemoryBuffer([(r["r_regionkey"], r["r_name"]) for r in rows])
    return spark.createDataFrame(list(buffer), "place bigint, value string")


@query("""SELECT event_id FROM events ORDER BY event_id LIMIT 100""")
def src_max_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.first_items(read(spark, sf_dir, "events").select("event_id"), 100, "event_id")


@query("""SELECT event_type || ' ' || user_id || chr(10) AS line, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines of text files, read again with their line ends."""
    path = new_folder(spark, "lines")
    read(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))).write.text(path)
    lines = spark.read.text(path, lineSep="\n").select(F.concat("value", F.lit("\n")).alias("line"))
    return cube.aggregate(lines, ["line"], COUNT)


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0""")
def src_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of which some are null; those are skipped."""
    rows = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.struct("c_custkey", "c_name")).alias("value"))
    return memory.present(rows)


@query("""SELECT (sum(strlen(n_name)))::BIGINT AS bytes FROM nation""")
def raw_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written one after another with nothing between; what the files hold together."""
    sinks.register(spark)
    path = new_folder(spark, "raw")
    read(spark, sf_dir, "nation").select(F.col("n_name").cast("binary").alias("value")).write.format("raw").mode("append").save(path)
    return spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes"))


@query("""SELECT n_nationkey::INT AS key, n_name AS name FROM nation""")
def message_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.project(read(spark, sf_dir, "nation"), key=F.col("n_nationkey").cast("string"), name=F.col("n_name"), more=F.lit(1))
    return mapping.cast_message(rows, "key int, name string")


@query("""SELECT event_type AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole batches, summed up."""
    rows = mapping.map_batches(read(spark, sf_dir, "events").select("event_type"), _BatchCounts, "k string, n bigint")
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


class _BatchCounts:
    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(0).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["k", "n"])


@query(r"""SELECT event_id, unnest(list_filter(string_split(event_type || chr(10) || chr(10) || props, chr(10)), lambda x: x <> '')) AS line FROM events""")
def src_datagram_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datagrams of lines, some empty: split, emptied of those, and unescaped."""
    sent = read(spark, sf_dir, "events").select("event_id", F.concat(F.col("event_type"), F.lit("\n\n"), F.replace("props", F.lit('"'), F.lit("\\x22"))).alias("value"))
    lines = mapping.flat_map(sent, F.filter(F.split("value", "\n"), lambda x: x != ""), "line")
    return lines.select("event_id", codecs.unescape(F.col("line")).alias("line"))


@query("""SELECT count(*)::BIGINT AS n, sum(strlen(props))::BIGINT AS bytes FROM events""")
def buffer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.stats(read(spark, sf_dir, "events"), "props")


@query("""SELECT p_name AS value, count(*)::BIGINT AS n FROM part WHERE p_name <> '' GROUP BY ALL""")
def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as length-framed files, read again."""
    framed.register(spark)
    path = new_folder(spark, "frames")
    rows = read(spark, sf_dir, "part").select(F.col("p_name").cast("binary").alias("value"))
    rows.write.format("framed").mode("append").save(path)
    back = spark.read.format("framed").load(path)
    return cube.aggregate(back.select(F.col("value").cast("string").alias("value")), ["value"], COUNT)


@query("""SELECT n_nationkey, lower(hex(n_name || '|' || n_nationkey)) AS payload, (strlen(n_name || '|' || n_nationkey))::BIGINT AS length FROM nation""")
def multipart_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(*[c.cast("binary") for c in (F.col("n_name"), F.lit("|"), F.col("n_nationkey").cast("string"))])
    frames = read(spark, sf_dir, "nation").select("n_nationkey", codecs.multipart(parts).alias("f"))
    return frames.select("n_nationkey", F.lower(F.hex(F.substring("f", 5, 1 << 20))).alias("payload"), codecs.from_u32(F.substring("f", 1, 4)).alias("length"))


# ---- codecs


@query("""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events""")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", codecs.json_decode(F.col("props"), "k bigint").alias("o")).select("event_id", "o.k")


@query("""SELECT event_id, event_type, user_id FROM events""")
def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded, and its fields read again."""
    text = read(spark, sf_dir, "events").select(codecs.json_encode("event_id", "event_type", "user_id").alias("j"))
    return text.select(F.from_json("j", "event_id bigint, event_type string, user_id bigint").alias("o")).select("o.*")


ESCAPED = [(1, r"a\x22b\x5Cx22\x22"), (2, r"\x5cZ"), (3, "plain"), (4, r"\x22"), (5, r"\x22 "), (6, r"\x5C\x5Cx")]


@query(r"""SELECT * FROM (VALUES (1, 'a"b\x22\x22'), (2, '\x5cZ'), (3, 'plain'), (4, '\x22'), (5, '" '), (6, '\\x')) AS v(id, line)""")
def nginx_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(ESCAPED, "id int, line string").select("id", codecs.unescape(F.col("line")).alias("line"))


@query("""SELECT event_id AS seq, 0::BIGINT AS command, (8 + strlen(props))::BIGINT AS length, props AS payload FROM events""")
def transport_frame_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = read(spark, sf_dir, "events").select(codecs.message(codecs.DATA, F.col("event_id"), F.col("props").cast("binary")).alias("m"))
    return sent.select(*codecs.message_fields(F.col("m"))).withColumn("payload", F.col("payload").cast("string"))


@query("""SELECT event_id, props AS value FROM events""")
def snappy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", codecs.snappy_encode(F.col("props").cast("binary")).alias("z"))
    return rows.select("event_id", codecs.snappy_decode("z").cast("string").alias("value"))


@query("""SELECT event_id, event_type AS value FROM events""")
def protobuf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", codecs.protobuf_encode("event_type").alias("z"))
    return rows.select("event_id", codecs.protobuf_decode("z").alias("value"))


@query("""SELECT s_suppkey, s_suppkey * 3 AS value FROM supplier""")
def binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", codecs.binary_encode(F.col("s_suppkey") * 3).alias("z"))
    return rows.select("s_suppkey", codecs.binary_decode_long("z").alias("value"))


# ---- batches, acknowledgements, metrics


@query("""SELECT event_id // 1000 AS batch, count(*)::BIGINT AS n, min(event_id) AS first_event, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events GROUP BY batch""")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events gathered into batches of a thousand, each with its items in order."""
    rows = pipeline.batches_of(read(spark, sf_dir, "events"), "event_id", 1000, "event_type")
    return rows.select("batch", "n", F.get("items", F.lit(0))["event_id"].alias("first_event"), F.array_join(F.transform("items", lambda x: x["event_type"]), ",").alias("kinds"))


@query(f"""SELECT hour, n, greatest(sum(n) OVER w // count(*) OVER w, 1)::BIGINT AS mean FROM (SELECT hour, count(*)::BIGINT AS n FROM {E_SQL} GROUP BY ALL)
WINDOW w AS (ORDER BY hour ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def running_count_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    hours = events.groupBy(cube.bucket(epoch_seconds(events, "ts"), HOUR).alias("hour")).agg(F.count("*").alias("n"))
    return pipeline.running_count(hours, "hour", "n")


@query(f"""SELECT count(*)::BIGINT AS items, (max(s) - min(s))::BIGINT AS seconds, floor(count(*) * 3600 / (max(s) - min(s)))::BIGINT AS per_hour FROM {E_SQL}""")
def timing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return pipeline.timing(events, epoch_seconds(events, "ts"))


@query("""SELECT user_id, event_id AS seq, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS newly_acked FROM events""")
def ack_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative acknowledgements of each sender (user): each forgets what came since the one before."""
    return memory.acknowledged(read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq")), "user_id", "seq")


@query("""SELECT event_type AS op, count(*)::BIGINT AS events, (count(*) FILTER (event_type = 'error'))::BIGINT AS errors FROM events GROUP BY ALL""")
def metrics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.event_counts(read(spark, sf_dir, "events"), F.col("event_type"), F.col("event_type") == "error")


@query(f"""SELECT s // 86400 * 86400 AS part_start, s AS ts, event_type, count(*)::BIGINT AS n FROM {E_SQL} GROUP BY ALL""")
def cube_batch_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files into the cube's table, drained; equal to the batch result."""
    table = CubeTable(spark, new_folder(spark, "stream-cube"), EVENTS, DAY)
    schema = read(spark, sf_dir, "events").schema
    feed = new_folder(spark, "feed")
    read(spark, sf_dir, "events").repartition(3, "event_id").write.parquet(feed)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(feed)
    writer = pipeline.cube_writer(stream, table, COUNT, new_folder(spark, "stream-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return table.read()


# ---- routing

NODE_SQL = "(SELECT r_name AS node, CASE WHEN r_regionkey / 2000.0 < 0.000809804 THEN 30 ELSE 50 END AS weight FROM region)"


def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes made of the regions, a table of fixed size, with a disk size."""
    return read(spark, sf_dir, "region").select(F.col("r_name").alias("node"), routing.node_weight(F.col("r_regionkey") / 2000.0).alias("weight"))


@query("""SELECT s_suppkey, CASE WHEN (s_suppkey % 10) / 10000.0 < 0.000809804 THEN 30 ELSE 50 END AS weight FROM supplier""")
def node_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", routing.node_weight((F.col("s_suppkey") % 10) / 10000.0).alias("weight"))


SLOT_SQL = f"""t AS (SELECT node, floor(weight * 100 / sum(weight) OVER ())::INT AS n FROM {NODE_SQL}),
u AS (SELECT node, n, coalesce(sum(n) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM t),
v AS (SELECT unnest(range(start, start + n))::INT AS slot, node FROM u)"""


@query(f"""WITH {SLOT_SQL} SELECT * FROM v""")
def node_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.slots(cluster(spark, sf_dir))


@query(f"""WITH {SLOT_SQL} SELECT event_id, v.node FROM events LEFT JOIN v ON v.slot = CASE WHEN user_id % 110 >= 100 THEN 0 ELSE user_id % 110 END""")
def node_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(read(spark, sf_dir, "events"), F.pmod("user_id", F.lit(110)), routing.slots(cluster(spark, sf_dir))).select("event_id", "node")


@query("""SELECT event_id AS t, coalesce(CASE WHEN event_id % 7 = 0 AND event_id < 700 THEN 'era-' || event_id END, 'era-693') AS era FROM events""")
def era_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    eras = spark.range(0, 700, 7).select(F.col("id").alias("t"), F.concat(F.lit("era-"), F.col("id").cast("string")).alias("era"))
    return routing.era_lookup(read(spark, sf_dir, "events").select(F.col("event_id").alias("t")), eras).select("t", "era")


@query("""SELECT o_orderkey AS t, 'era-' || o_orderkey AS era FROM orders ORDER BY o_orderkey DESC LIMIT 10""")
def era_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    eras = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), F.concat(F.lit("era-"), F.col("o_orderkey").cast("string")).alias("era"))
    return routing.retained(eras)

"""Recovery of the cube's table, texts for a database, eras that are polled, and specifications made from classes."""

import datetime
import json
import sqlite3
import threading
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.operators import cube, eras, mapping
from millrace.operators.spec import CubeSpec, Dimension, Measure
from millrace.operators.sqltext import SqlText, deliver
from millrace.operators.table import CubeTable, PublishedByOther

SPEC = CubeSpec("hits", (Dimension("ts", "time"), Dimension("kind")), (Measure("n"),))


def delta(spark, *rows):
    return spark.createDataFrame([(t - t % 3600, t, k, n) for t, k, n in rows], "part_start bigint, ts bigint, kind string, n bigint")


def content(table):
    return sorted((r["ts"], r["kind"], r["n"]) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    return CubeTable(spark, f"file://{tmp_path}/cube", SPEC)


def test_a_writer_that_dies_before_publishing_does_not_stop_others(spark, table, monkeypatch):
    table.upsert(delta(spark, (10, "a", 1)), "w", 0)

    def dies(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(CubeTable, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(delta(spark, (10, "a", 5)), "w", 1)
    assert content(table) == [(10, "a", 1)]
    assert table.upsert(delta(spark, (10, "a", 5)), "w", 1) and not table.upsert(delta(spark, (10, "a", 5)), "w", 1)
    assert content(table) == [(10, "a", 6)]
    gone = table.clean(older_than=-1)
    assert len([x for x in gone if not x.endswith(".json")]) == 1 and content(table) == [(10, "a", 6)]
    assert table.clean(older_than=-1) == []


def test_two_writers_at_once_both_count(spark, table):
    table.upsert(delta(spark, (10, "a", 1)))
    errors = []

    def add(k):
        try:
            for b in range(3):
                CubeTable(spark, table.root, SPEC).upsert(delta(spark, (10, "a", 1), (4000, k, 1)), k, b, tries=20)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add, args=(k,)) for k in ("x", "y")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and content(table) == [(10, "a", 7), (4000, "x", 3), (4000, "y", 3)]


def test_a_writer_that_loses_every_time_says_so(spark, table, monkeypatch):
    def loses(self, manifest):
        raise PublishedByOther("again")

    monkeypatch.setattr(CubeTable, "_publish", loses)
    with pytest.raises(PublishedByOther):
        table.upsert(delta(spark, (10, "a", 1)), tries=2)


def test_an_upsert_writes_the_delta_alone(spark, table):
    """However large a partition is, a late row adds a folder of its own, and reads add up."""
    many = spark.range(20_000).selectExpr("0L AS part_start", "id % 3600 AS ts", "concat('k', id) AS kind", "id AS n")
    table.upsert(many)
    (first,) = table.folders(0)
    table.upsert(delta(spark, (7, "k7", 100)))
    base, late = table.folders(0)
    assert base == first and late["bytes"] < first["bytes"] / 20 and late["level"] == 0
    assert table.read().count() == 20_000 and [r["n"] for r in table.read().where("kind = 'k7'").collect()] == [107]


def test_compaction_adds_up_levels(spark, table):
    for i in range(16):
        table.upsert(delta(spark, (10, "a", 1), (4000 if i % 2 else 10, f"b{i % 3}", i)), "w", i)
    levels = {p: [f["level"] for f in table.folders(p)] for p in table.partitions()}
    assert levels == {0: [2], 3600: [1, 1]}
    expected = {(10, "a"): 16}
    for i in range(16):
        key = (4000 if i % 2 else 10, f"b{i % 3}")
        expected[key] = expected.get(key, 0) + i
    assert {(t, k): n for t, k, n in content(table)} == expected
    assert table.compact(fan_in=2) == 1 and [f["level"] for f in table.folders(3600)] == [2] and {(t, k): n for t, k, n in content(table)} == expected
    table.clean(older_than=-1)
    assert {(t, k): n for t, k, n in content(table)} == expected and not table.upsert(delta(spark, (10, "a", 1)), "w", 15)


def test_compaction_leaves_what_others_have_changed(spark, table, monkeypatch):
    for i in range(3):
        table.upsert(delta(spark, (10, "a", 1), (4000, "b", 1)), compact=False)
    written = CubeTable._written

    def meanwhile(self, rows, level):
        out = written(self, rows, level)
        with monkeypatch.context() as m:
            m.setattr(CubeTable, "_written", written)
            CubeTable(spark, table.root, SPEC).drop_partition(0)
            CubeTable(spark, table.root, SPEC).upsert(delta(spark, (4000, "b", 10)), compact=False)
        return out

    monkeypatch.setattr(CubeTable, "_written", meanwhile)
    assert table.compact(fan_in=3) == 1
    assert content(table) == [(4000, "b", 13)] and [f["level"] for f in table.folders(3600)] == [1, 0]


def test_of_two_writers_at_the_gap_one_publishes(spark, table):
    """Both have read the same version and publish at once: the name is taken once."""
    table.create()
    won, lost, gate = [], [], threading.Barrier(4)

    def publish(k):
        other = CubeTable(spark, table.root, SPEC)
        gate.wait()
        try:
            other._publish({"version": 2, "applied": {k: 1}, "parts": {}})
            won.append(k)
        except PublishedByOther:
            lost.append(k)

    threads = [threading.Thread(target=publish, args=(str(k),)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 3 and table.manifest()["applied"] == {won[0]: 1}


def test_dropping_begins_again_when_another_writer_was_first(spark, table, monkeypatch):
    table.upsert(delta(spark, (10, "a", 1), (4000, "b", 2), (8000, "c", 3)))
    publish, times = CubeTable._publish, []

    def late(self, manifest):
        if not times:
            times.append(1)
            with monkeypatch.context() as m:
                m.setattr(CubeTable, "_publish", publish)
                CubeTable(spark, table.root, SPEC).upsert(delta(spark, (12_000, "d", 4)))
        publish(self, manifest)

    monkeypatch.setattr(CubeTable, "_publish", late)
    assert [r["kind"] for r in table.pop_top().collect()] == ["d"]
    times.clear()
    table.drop_partition(3600)
    assert table.partitions() == [0, 7200, 10_800]


def test_a_row_without_partition_is_refused(spark, table):
    with pytest.raises(ValueError, match="part_start"):
        table.upsert(spark.createDataFrame([(None, 1, "a", 1)], "part_start bigint, ts bigint, kind string, n bigint"))
    assert table.read().count() == 0


def test_bounds_choose_the_files_that_are_read(spark, table):
    from millrace.sources import cube as source

    rows = [(3600 * h + 60 * i, f"k{i}", 10 * h + i) for h in range(8) for i in range(3)]
    table.upsert(delta(spark, *rows[:14]))
    table.upsert(delta(spark, *rows[8:]))
    every = content(table)
    for where in ("ts >= 7200 AND ts < 10800", "part_start = 3600", "part_start IN (0, 25200)", "ts = 7260 AND kind = 'k1'", "kind = 'k2'", "kind <> 'k2'", "NOT kind LIKE 'k1%'", "n > 30", "ts > 100000", "kind IS NULL", "ts <= 3700", "ts IN (60, 25200)"):
        found = sorted((r["ts"], r["kind"], r["n"]) for r in table.scan().where(where).collect())
        plain = sorted((r["ts"], r["kind"], r["n"]) for r in table.read().where(where).collect())
        assert found == plain, where
    assert sorted((r["ts"], r["kind"], r["n"]) for r in table.scan().collect()) == every
    assert [r["ts"] for r in table.page(["ts"], "ts >= 7200", limit=2, offset=1).collect()] == [7260, 7320]

    def folders(*filters):
        reader = source.CubeReader(table.root, spark.createDataFrame([], table._schema()).schema, "ts", 3600, ["ts", "kind"])
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sorted({int(p.rsplit("=", 1)[1]) for p in reader.chosen()})

    hours = [3600 * h for h in range(8)]
    assert folders() == hours
    assert folders(source.GreaterThanOrEqual(("ts",), 7200), source.LessThanOrEqual(("ts",), 10_799)) == [7200]
    assert folders(source.EqualTo(("ts",), 7260)) == [7200] and folders(source.EqualTo(("part_start",), 3600)) == [3600]
    assert folders(source.In(("part_start",), (0, 25_200, 5))) == [0, 25_200] and folders(source.EqualTo(("kind",), "k1")) == hours and folders(source.EqualTo(("n",), 1)) == hours


def test_popping_the_newest_partition(spark, table):
    table.upsert(delta(spark, (10, "a", 1), (4000, "b", 2), (4100, "c", 3)))
    assert sorted(r["kind"] for r in table.pop_top().collect()) == ["b", "c"] and table.partitions() == [0]
    assert [r["kind"] for r in table.pop_top().collect()] == ["a"] and table.pop_top() is None


def test_the_cutoff_moves(spark):
    rows = delta(spark, (10, "a", 1), (4000, "b", 2), (8000, "c", 3))
    out = cube.Cutoff()
    assert out.late(rows).count() == 0
    assert [r["kind"] for r in out.flush(rows, 3600).collect()] == ["a"]
    assert [r["kind"] for r in out.flush(rows, 7200).collect()] == ["b"] and out.at == 7200
    assert sorted(r["kind"] for r in out.late(rows).collect()) == ["a", "b"] and out.flush(rows, 7200).count() == 0


# ---- text


TEXT = SqlText(CubeSpec("hits", (Dimension("ts", "time"), Dimension("kind"), Dimension("code", "int", "SMALLINT")), (Measure("n"), Measure("users", "hll"))))


def test_texts():
    columns = "ts INT, kind VARCHAR(255), code SMALLINT, n INT, users HLL"
    assert TEXT.create() == f"CREATE TABLE IF NOT EXISTS hits ({columns}, PRIMARY KEY(ts, kind, code)) PARTITION BY RANGE (ts)" and TEXT.drop() == "DROP TABLE IF EXISTS hits CASCADE"
    assert TEXT.create_partition(7200) == "CREATE TABLE IF NOT EXISTS hits_7200 PARTITION OF hits FOR VALUES FROM (7200) TO (10800)"
    assert TEXT.drop_partition(7200) == "DROP TABLE IF EXISTS hits_7200"
    assert TEXT.create_foreign("b") == f"CREATE FOREIGN TABLE IF NOT EXISTS hits_ft_b ({columns}) SERVER b OPTIONS (table_name 'hits')"
    assert TEXT.drop_foreign("b") == "DROP FOREIGN TABLE IF EXISTS hits_ft_b CASCADE"
    one = "SELECT ts, kind, code, n, users FROM"
    assert TEXT.create_view(["a", "b"], "a") == f"CREATE OR REPLACE VIEW hits_view AS {one} hits_ft_b UNION {one} hits" and TEXT.create_view(["a"]).endswith(f"AS {one} hits_ft_a")
    assert TEXT.drop_view() == "DROP VIEW IF EXISTS hits_view" and TEXT.select("n > 1") == f"{one} hits_view WHERE n > 1"
    assert TEXT.select(limit=5, offset=2) == f"{one} hits_view ORDER BY ts, kind, code LIMIT 5 OFFSET 2"
    assert TEXT.upsert("7") == (
        "INSERT INTO hits (ts, kind, code, n, users) SELECT ts, kind, code, n, users FROM hits_copy_t_7 WHERE TRUE "
        "ON CONFLICT (ts, kind, code) DO UPDATE SET n = hits.n + EXCLUDED.n, users = hits.users || EXCLUDED.users"
    )
    with pytest.raises(ValueError, match="plain name"):
        TEXT.create_foreign("x; DROP TABLE hits")


class Database:
    """A database file that tasks open too. Its statements are PostgreSQL's, but for partitions."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self):
        return sqlite3.connect(self.path, timeout=60)

    def run(self, *statements):
        with self() as connection:
            return [connection.execute(s).fetchall() for s in statements][-1]


def test_delivery_adds_and_replaces_its_own_attempts(spark, tmp_path):
    text, base = SqlText(SPEC), Database(tmp_path / "base")
    base.run(SPEC.create_sql("hits"))
    cubes = [delta(spark, (10, "a", 1), (4000, "b", 2), (4100, "c", 3)), delta(spark, (10, "a", 5), (4000, "b", 7), (9000, "d", 1))]
    for batch in ("0", "1"):
        deliver(cubes[int(batch)].repartition(3), text, base, batch, partitions=False)
    assert base.run("SELECT * FROM hits ORDER BY ts") == [(10, "a", 6), (4000, "b", 9), (4100, "c", 3), (9000, "d", 1)]
    # a run that ended while its tasks staged leaves rows, which the next run of the batch replaces
    base.run(text.create_staging("2"), "INSERT INTO hits_copy_t_2 VALUES (0, 10, 'a', 100), (77, 10, 'z', 100)")
    deliver(cubes[0], text, base, "2", partitions=False)
    assert base.run("SELECT * FROM hits ORDER BY ts") == [(10, "a", 7), (4000, "b", 11), (4100, "c", 6), (9000, "d", 1)]
    assert base.run("SELECT count(*) FROM sqlite_master WHERE name LIKE 'hits_copy%'") == [(0,)]


def test_delivery_is_all_or_nothing(spark, tmp_path):
    text, base = SqlText(SPEC), Database(tmp_path / "base")
    base.run("CREATE TABLE hits (ts INT, kind TEXT, n INT CHECK (n < 100), PRIMARY KEY(ts, kind))")
    with pytest.raises(sqlite3.IntegrityError):
        deliver(delta(spark, (10, "a", 1), (4000, "b", 200)), text, base, "0", partitions=False)
    assert base.run("SELECT count(*) FROM hits") == [(0,)]


def test_the_view_adds_equal_keys_if_asked(tmp_path):
    base = Database(tmp_path / "base")
    base.run(SPEC.create_sql("hits"), SPEC.create_sql("hits_ft_b"), "INSERT INTO hits VALUES (1, 'a', 2), (2, 'x', 5)", "INSERT INTO hits_ft_b VALUES (1, 'a', 2), (3, 'y', 1)")
    for added, expected in ((False, [(1, "a", 2), (2, "x", 5), (3, "y", 1)]), (True, [(1, "a", 4), (2, "x", 5), (3, "y", 1)])):
        base.run("DROP VIEW IF EXISTS hits_view", SqlText(SPEC).create_view(["b", "me"], "me", added).replace("OR REPLACE ", ""))
        assert base.run(SqlText(SPEC).select(limit=9)) == expected


def test_copy_files_by_partition(spark, tmp_path):
    SqlText(SPEC).write_copy(delta(spark, (10, "a", 1), (4000, "b", 2)), f"file://{tmp_path}/copy")
    assert [(r["part_start"], r["value"]) for r in spark.read.text(f"file://{tmp_path}/copy").orderBy("part_start").collect()] == [(0, "10\ta\t1"), (3600, "4000\tb\t2")]


@dataclass
class Where:
    country: str
    city: str = field(metadata={"name": "town", "sql_type": "TEXT"})


@dataclass
class Dims:
    ts: datetime.datetime
    where: Where
    code: int


@dataclass
class Sums:
    n: int
    users: bytes


def test_specification_from_classes():
    spec = CubeSpec.of("hits", Dims, Sums)
    assert spec == CubeSpec("hits", (Dimension("ts", "time"), Dimension("country"), Dimension("town", "string", "TEXT"), Dimension("code", "int")), (Measure("n"), Measure("users", "hll")))

    @dataclass
    class Bad:
        ts: datetime.datetime
        x: float

    with pytest.raises(ValueError):
        CubeSpec.of("hits", Bad, Sums)


# ---- eras


def answer(*names):
    return json.dumps({"Nodes": [{"Name": n, "Ip": "10.0.0.1", "Port": 80, "Disk_free": 0.5, "Load": 0.1} for n in names]})


def test_polled_eras(spark):
    now, answers = [100.0], {"a": "no json", "b": answer("x", "y")}

    def fetch(url):
        if answers[url] is None:
            raise OSError("down")
        return answers[url]

    held = eras.PolledEras(["a", "b"], kept=2, fetch=fetch, clock=lambda: now[0])
    assert [n.name for n in held.current().nodes] == ["x", "y"] and len(held.errors) == 1
    now[0], answers["a"] = 160.0, answer("z")
    assert held.poll() and [n.name for n in held.at(100).nodes] == ["x", "y"] and [n.name for n in held.at(101).nodes] == ["z"]
    assert held.to_df(spark).groupBy("era", "node").count().count() == 3
    now[0] = 220.0
    held.poll()
    assert sorted(held.eras) == [160, 220]
    answers.update(a=None, b=None)
    assert not held.poll() and [n.name for n in held.current().nodes] == ["z"]
    with pytest.raises(ConnectionError):
        eras.PolledEras(["a"], fetch=fetch)
    assert eras.StaticEras(held.current()).at(5) == held.current()


# ---- maps and codecs


class _Numbered:
    def __init__(self, key):
        self.key, self.n = key, 0

    def __call__(self, row):
        self.n += 1
        return [{"k": self.key, "n": self.n}]


def test_a_branch_for_each_key(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"))
    out = mapping.branches(rows, "k", _Numbered, "k bigint, n bigint").collect()
    assert {k: sorted(r["n"] for r in out if r["k"] == k) for k in range(3)} == {0: list(range(1, 35)), 1: list(range(1, 34)), 2: list(range(1, 34))}


def test_ordered_chain_keeps_the_order_of_inputs(spark):
    rows = spark.range(500).repartition(7)
    twice = lambda d: F.array(F.struct("id", F.lit("a").alias("x")), F.struct("id", F.lit("b").alias("x")))
    even = lambda d: F.when(F.col("id") % 2 == 0, F.array(F.struct("id", "x")))
    assert [(r["id"], r["x"]) for r in mapping.ordered_chain(rows, "id", twice, even).collect()] == [(i, x) for i in range(0, 500, 2) for x in "ab"]


def test_any_protobuf_message(spark):
    encode, decode = codecs.protobuf_codec("google.protobuf.timestamp_pb2:Timestamp")
    rows = spark.createDataFrame([('"2024-05-01T00:00:01Z"',), (None,)], "j string").select(encode("j").alias("b"))
    assert [r[0] for r in rows.select(decode("b")).collect()] == ['"2024-05-01T00:00:01Z"', None]
    from google.protobuf.timestamp_pb2 import Timestamp

    assert [None if r["b"] is None else bytes(r["b"]) for r in rows.collect()] == [Timestamp(seconds=1714521601).SerializeToString(), None]


def test_binary_values_of_any_type(spark):
    from pyspark.sql import types as T

    rows = spark.createDataFrame([("a",), (None,)], "v string").select(codecs.binary_encode("v").alias("b"))
    assert [r[0] for r in rows.select(codecs.binary_decode(T.StringType())("b")).collect()] == ["a", None]

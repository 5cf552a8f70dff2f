"""An additive cube table in Parquet, partitioned by time, whose upserts cost what their batch costs.

The table is a log of levels. An upsert writes the delta alone, in a folder that no other attempt uses, and publishes a manifest that names
for each partition the folders that make it up, each with its level and size, and the last batch that each writer has applied. A
reader sees one manifest, so it sees a batch wholly or not at all, and adds up the folders of a partition that has several. When a
partition has FAN_IN folders of one level or below, they are added up to one of the level above (compaction): so a row is written again
once for each level, of which there are as many as the logarithm of the number of upserts, and a partition has few folders to read.

A writer that dies leaves a folder that nothing reads, which ``clean`` removes with those of older versions; of two writers of one version one
begins again; a batch that comes again is skipped. Files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hll
from .spec import CubeSpec


#: Folders of a level that are added up to one of the next.
FAN_IN = 4


class PublishedByOther(RuntimeError):
    """Another writer has published this version meanwhile."""


class CubeTable:
    def __init__(self, spark: SparkSession, root: str, spec: CubeSpec, part_length: int = 3600) -> None:
        self.spark, self.root, self.spec, self.part_length = spark, root.rstrip("/"), spec, part_length

    # ---- manifests

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _manifests(self) -> list[tuple[int, str]]:
        fs, path = self._fs()
        folder = path(f"{self.root}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted((int(n.removesuffix(".json")), f"{self.root}/manifests/{n}") for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        found = self._manifests()
        if not found:
            return {"version": 0, "applied": {}, "parts": {}}
        fs, path = self._fs()
        stream = fs.open(path(found[-1][1]))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Fails if another writer has published this version. The manifest appears whole, under a name that is taken once: by a hard link on
        a local disk, elsewhere by a rename, which does not replace a file in HDFS."""
        fs, path = self._fs()
        jvm = self.spark.sparkContext._jvm
        fs.mkdirs(path(f"{self.root}/manifests"))
        final = path(f"{self.root}/manifests/{manifest['version']:012d}.json")
        draft = path(f"{self.root}/manifests/{manifest['version']:012d}-{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                jvm.java.nio.file.Files.createLink(local(final), local(draft))
                taken = True
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                    raise
                taken = False
            fs.delete(draft, False)
        else:
            taken = not fs.exists(final) and fs.rename(draft, final)
            if not taken:
                fs.delete(draft, False)
        if not taken:
            raise PublishedByOther(f"version {manifest['version']} has been published by another writer")

    def _change(self, change: Callable[[dict], dict | None], tries: int = 5) -> dict | None:
        """Publishes what change makes of the manifest, from the newest one again if another writer was first; nothing if it makes None."""
        for tried in range(1, tries + 1):
            now = self.manifest()
            new = change({**now, "version": now["version"] + 1, "applied": dict(now["applied"]), "parts": dict(now["parts"])})
            if new is None:
                return None
            try:
                self._publish(new)
                return new
            except PublishedByOther:
                if tried == tries:
                    raise
        return None

    # ---- reading

    def create(self) -> None:
        if not self._manifests():
            self._publish({"version": 1, "applied": {}, "parts": {}})

    def read(self, start: int | None = None, stop: int | None = None, parts: dict[str, list[dict]] | None = None) -> DataFrame:
        """Rows of the partitions that begin in [start, stop), one for each key; only their files are listed. Partitions of one folder are
        read as they are, the others are added up."""
        parts = self.manifest()["parts"] if parts is None else parts
        chosen = [v for k, v in sorted(parts.items(), key=lambda p: int(p[0])) if (start is None or int(k) >= start) and (stop is None or int(k) < stop)]
        single = [f["path"] for v in chosen if len(v) == 1 for f in v]
        several = [f["path"] for v in chosen if len(v) > 1 for f in v]
        rows = [self._files(single)] if single else []
        rows += [self.merged([self._files(several)])] if several else []
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], self._schema())

    def _files(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(*paths)

    def _schema(self) -> str:
        return "part_start bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spec.schema().fields)

    def partitions(self) -> list[int]:
        return sorted(int(k) for k in self.manifest()["parts"])

    # ---- writing

    def merged(self, frames: list[DataFrame]) -> DataFrame:
        """Counts added and sketches united over equal keys."""
        s = self.spec
        rows, keys = reduce(DataFrame.unionByName, frames), ["part_start", *s.dims]
        if s.sketches:
            return hll.union_agg(rows, keys, s.sketches, s.counts).select("part_start", *s.columns)
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in s.counts]
        return rows.groupBy(*keys).agg(*sums).select("part_start", *s.columns)

    def upsert(self, delta: DataFrame, writer: str = "default", batch: int | None = None, tries: int = 5, compact: bool = True) -> bool:
        """Adds a delta (part_start and the cube's columns, one row a key). False if the writer has applied the batch already.

        Late rows go to the old partition that they belong to. Stored rows are not read, but for compaction, which comes after the batch
        has been published and may be left to others. If another writer publishes first, only the publishing is done again.
        """
        applied = lambda m: batch is not None and m["applied"].get(writer, -1) >= batch
        if applied(self.manifest()):
            return False
        found = self._written(delta.select("part_start", *self.spec.columns), 0)

        def add(m: dict) -> dict | None:
            if applied(m):
                return None
            if batch is not None:
                m["applied"][writer] = batch
            for part, folder in found.items():
                m["parts"][part] = [*m["parts"].get(part, []), folder]
            return m

        new = self._change(add, tries)
        if new and compact:
            self.compact()
        return new is not None

    def _written(self, rows: DataFrame, level: int) -> dict[str, dict]:
        """A new folder with the rows; for each partition what the manifest says of it. A file for each partition, or several for a large one."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.withColumn("part", F.col("part_start")).hint("rebalance", "part").write.partitionBy("part").parquet(folder)
        fs, path = self._fs()
        out = {}
        for status in fs.listStatus(path(folder)):  # a folder for each hour in a batch
            name = status.getPath().getName()
            if name == "part=__HIVE_DEFAULT_PARTITION__":
                raise ValueError("a row without part_start")
            if name.startswith("part="):
                out[name[5:]] = {"path": f"{folder}/{name}", "level": level, "bytes": fs.getContentSummary(status.getPath()).getLength()}
        return out

    def compact(self, fan_in: int = FAN_IN, part_starts: list[int] | None = None) -> int:
        """Adds up, in each partition, the folders of the lowest level that has fan_in of them, with those of lower levels, and those of the
        next level if it has fan_in with the new one, and so on; how many partitions it has changed. If another writer has meanwhile changed one of these folders, that partition is left as it is."""
        due = {}
        for part, folders in self.manifest()["parts"].items():
            if part_starts is not None and int(part) not in part_starts:
                continue
            counts, level, full = Counter(f["level"] for f in folders), min((f["level"] for f in folders), default=0), None
            while counts[level] + (full is not None) >= fan_in or full is None and level < max(counts, default=0):
                full = level if counts[level] + (full is not None) >= fan_in else None
                level += 1
            if full is not None:
                due[part] = [f for f in folders if f["level"] <= full]
        by_level: dict[int, dict[str, list[dict]]] = {}
        for part, folders in due.items():
            by_level.setdefault(max(f["level"] for f in folders) + 1, {})[part] = folders
        changed = 0
        for level, parts in by_level.items():
            new = self._written(self.merged([self._files([f["path"] for v in parts.values() for f in v])]), level)

            def swap(m: dict, parts: dict = parts, new: dict = new) -> dict | None:
                nonlocal swapped
                swapped = 0
                for part, old in parts.items():
                    gone, here = {f["path"] for f in old}, m["parts"].get(part, [])
                    if gone <= {f["path"] for f in here} and part in new:
                        m["parts"][part] = [new[part], *(f for f in here if f["path"] not in gone)]
                        swapped += 1
                return m if swapped else None

            swapped = 0
            self._change(swap, tries=20)
            changed += swapped
        return changed

    def folders(self, part_start: int) -> list[dict]:
        """What a partition is made of: path, level and bytes of each folder."""
        return self.manifest()["parts"].get(str(part_start), [])

    def drop_partition(self, part_start: int) -> None:
        def drop(m: dict) -> dict:
            m["parts"].pop(str(part_start), None)
            return m

        self._change(drop)

    def pop_top(self) -> DataFrame | None:
        """Removes the newest partition and gives its rows; None if there is none. Its files stay until they are cleaned away."""
        taken: dict[str, list[dict]] = {}

        def take(m: dict) -> dict | None:
            taken.clear()
            if not m["parts"]:
                return None
            top = max(m["parts"], key=int)
            taken[top] = m["parts"].pop(top)
            return m

        return self.read(parts=taken) if self._change(take) else None

    def clean(self, older_than: float = 3600.0, keep: int = 1) -> list[str]:
        """Removes data folders that none of the last ``keep`` manifests names, older manifests and drafts, all if they are older than this many
        seconds: an upsert that is still at work has younger ones, and a version's name must not be free again while a writer may
        want it. The names of what went."""
        fs, path = self._fs()
        found = self._manifests()
        if not found:
            return []
        named = set()
        for _, place in found[-keep:]:
            stream = fs.open(path(place))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            named |= {f["path"].rsplit("/", 1)[0].rsplit("/", 1)[1] for v in json.loads(text)["parts"].values() for f in v}
        kept = {p.rsplit("/", 1)[1] for _, p in found[-keep:]}
        gone = []
        for folder, stays in (("data", named), ("manifests", kept)):
            if not fs.exists(path(f"{self.root}/{folder}")):
                continue
            for status in fs.listStatus(path(f"{self.root}/{folder}")):
                name = status.getPath().getName()
                if name not in stays and time.time() - status.getModificationTime() / 1000 > older_than:
                    fs.delete(status.getPath(), True)
                    gone.append(name)
        return gone

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)

    def view(self, name: str, others: list[DataFrame] | None = None) -> str:
        """A temporary view <name>_view over this table and other nodes', equal rows once."""
        frames = [*(others or []), self.read()]
        reduce(DataFrame.unionByName, frames).distinct().createOrReplaceTempView(f"{name}_view")
        return f"{name}_view"

    def scan(self) -> DataFrame:
        """All rows, one for each key, of which a filter on part_start, the time or another dimension reads only the partitions and rows that it
        needs: it passes the sums, which are by these columns, and reaches the data source. For stores that tasks can open by their scheme."""
        from ..sources import cube as source

        source.register(self.spark)
        reader = self.spark.read.format("cube").option("time", self.spec.time_col).option("length", self.part_length).option("dims", ",".join(self.spec.dims))
        return self.merged([reader.schema(self._schema()).load(self.root)])

    def page(self, columns: list[str], where: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Some rows, in order of the dimensions; bounds in where choose the partitions that are read."""
        df = self.scan().where(where) if where else self.read()
        df = df.orderBy(*self.spec.dims).select(*columns).offset(offset)
        return df if limit is None else df.limit(limit)

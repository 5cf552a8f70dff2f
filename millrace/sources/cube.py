"""A cube table as a data source: filters choose the partitions whose files are listed and read.

    cube.register(spark)
    spark.read.format("cube").option("time", "hour").option("length", 86400).schema(table.row_schema()).load(root).where("hour >= 1704067200")

Filters on part_start and on the time dimension become bounds on the partitions that the manifest names; filters on these and on other
dimensions also go to the Parquet reader, which passes over row groups and rows; Spark evaluates them again. Rows come as they are stored: a
key may have one in each folder of its partition. ``CubeTable.scan`` adds them up; a filter on measures stays above that sum, as it must.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .framed import _place

#: Bytes of files that a task reads together.
TOGETHER = 64 << 20


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


def newest_manifest(root: str) -> dict:
    from pyarrow import fs

    place, path = _place(root)
    found = place.get_file_info(fs.FileSelector(f"{path}/manifests", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json"))
    if not names:
        return {"version": 0, "parts": {}}
    with place.open_input_stream(names[-1]) as stream:
        return json.loads(stream.read())


class CubeReader(DataSourceReader):
    def __init__(self, root: str, schema: StructType, time: str | None, length: int, dims: list[str]) -> None:
        self.root, self.schema, self.time, self.length, self.dims = root, schema, time, length, dims
        self.least, self.most = float("-inf"), float("inf")  # of part_start
        self.only: set | None = None
        self.row_filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            path = getattr(f, "attribute", ())  # Not has none
            column = path[0] if len(path) == 1 else None
            if column == "part_start":
                self._bound(f, 0)
            elif column == self.time:
                self._bound(f, self.length - 1)
            if column == "part_start" or column in self.dims:
                self.row_filters.append(f)
            yield f

    def _bound(self, f: Filter, span: int) -> None:
        """A value v of the column lies in partitions that begin from v - span to v."""
        v = getattr(f, "value", None)
        if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan) or isinstance(f, EqualNullSafe) and v is not None:
            self.least = max(self.least, v - span)
        if isinstance(f, EqualTo | LessThanOrEqual | LessThan) or isinstance(f, EqualNullSafe) and v is not None:
            self.most = min(self.most, v)
        if isinstance(f, In):
            self.least, self.most = max(self.least, min(v) - span), min(self.most, max(v))
            if not span:
                self.only = set(v) if self.only is None else self.only & set(v)

    def chosen(self) -> list[str]:
        """Folders of the partitions that may have rows."""
        parts = newest_manifest(self.root)["parts"]
        return [f["path"] for k, v in sorted(parts.items(), key=lambda p: int(p[0])) if self.least <= int(k) <= self.most and (self.only is None or int(k) in self.only) for f in v]

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        place, _ = _place(self.root)
        out, held = [[]], 0
        for folder in self.chosen():
            for f in place.get_file_info(fs.FileSelector(_place(folder)[1])):
                if f.is_file and f.base_name.endswith(".parquet"):
                    if out[-1] and held + f.size > TOGETHER:
                        out.append([])
                        held = 0
                    out[-1].append(f.path)
                    held += f.size
        return [Files(paths) for paths in out]

    def _expression(self):  # noqa: ANN202
        import pyarrow.dataset as ds

        out = None
        for f in self.row_filters:
            c, v = ds.field(f.attribute[0]), getattr(f, "value", None)
            found = {
                EqualTo: lambda c=c, v=v: c == v, EqualNullSafe: lambda c=c, v=v: c.is_null() if v is None else c == v, GreaterThan: lambda c=c, v=v: c > v, GreaterThanOrEqual: lambda c=c, v=v: c >= v,
                LessThan: lambda c=c, v=v: c < v, LessThanOrEqual: lambda c=c, v=v: c <= v, In: lambda c=c, v=v: c.isin(list(v)), IsNull: lambda c=c: c.is_null(), IsNotNull: lambda c=c: c.is_valid(),
            }.get(type(f))
            if found:
                out = found() if out is None else out & found()
        return out

    def read(self, partition: Files) -> Iterator:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.paths:
            return
        place, _ = _place(self.root)
        schema = to_arrow_schema(self.schema)
        rows = ds.dataset(partition.paths, schema=schema, format="parquet", filesystem=place)
        for batch in rows.to_batches(columns=schema.names, filter=self._expression(), batch_size=8192):
            if batch.num_rows:
                yield batch


class Cube(DataSource):
    """Options: path, time (the time dimension), length (seconds of a partition), dims (names, with commas between them)."""

    @classmethod
    def name(cls) -> str:
        return "cube"

    def schema(self) -> str:
        raise ValueError("a cube is read with a schema: part_start and the cube's columns")

    def reader(self, schema: StructType) -> CubeReader:
        dims = [d for d in self.options.get("dims", "").split(",") if d]
        return CubeReader(self.options["path"], schema, self.options.get("time"), int(self.options.get("length", 1)), dims)


def register(spark: SparkSession) -> None:
    """Makes the format cube known to the session, and lets filters reach it."""
    from ..session import ship_code

    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Cube)

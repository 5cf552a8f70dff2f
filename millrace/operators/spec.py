"""What a cube's rows are: dimensions, of which the first is a time, and measures that merge."""

from __future__ import annotations

import datetime
import typing
from dataclasses import dataclass, field, fields, is_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SQL types of stored columns by kind, in parity mode.
SQL_TYPES = {"time": "INT", "int": "INT", "string": "VARCHAR(255)", "count": "INT", "hll": "HLL"}
SPARK_TYPES = {"time": T.LongType(), "int": T.LongType(), "string": T.StringType(), "count": T.LongType(), "hll": T.BinaryType()}


@dataclass(frozen=True)
class Dimension:
    name: str
    kind: str = "string"
    sql_type: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("time", "int", "string"):
            raise ValueError(f"dimension {self.name}: no such kind {self.kind}")


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str = "count"
    sql_type: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("count", "hll"):
            raise ValueError(f"measure {self.name}: no such kind {self.kind}")


@dataclass(frozen=True)
class CubeSpec:
    """Dimensions before measures; the first dimension is the time, in whole seconds."""

    name: str
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not self.dimensions or self.dimensions[0].kind != "time":
            raise ValueError(f"cube {self.name}: the first dimension must be a time")
        names = [x.name for x in (*self.dimensions, *self.measures)]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"cube {self.name}: two columns have one name")

    @classmethod
    def of(cls, name: str, dimensions: type, measures: type) -> CubeSpec:
        """From two dataclasses: datetime fields are times, int and str fields are what they say; a measure is a count (int) or a sketch
        (bytes). field(metadata={"name": ..., "sql_type": ...}) gives a column another name or type; fields that are dataclasses
        themselves are flattened in their place."""
        kinds = {datetime.datetime: "time", int: "int", str: "string"}

        def flat(of: type) -> list[tuple[str, object, str | None]]:
            if not is_dataclass(of):
                raise ValueError(f"{of} is not a dataclass")
            hints, out = typing.get_type_hints(of), []
            for f in fields(of):
                if is_dataclass(hints[f.name]):
                    out += flat(hints[f.name])
                elif f.name.startswith("_"):
                    raise ValueError(f"{of.__name__}.{f.name} is private")
                else:
                    out.append((f.metadata.get("name", f.name), hints[f.name], f.metadata.get("sql_type")))
            return out

        def kind(column: str, hint: object, known: dict) -> str:
            if hint not in known:
                raise ValueError(f"column {column}: no kind for {hint}")
            return known[hint]

        dims = tuple(Dimension(n, kind(n, h, kinds), t) for n, h, t in flat(dimensions))
        return cls(name, dims, tuple(Measure(n, kind(n, h, {int: "count", bytes: "hll"}), t) for n, h, t in flat(measures)))

    @property
    def time_col(self) -> str:
        return self.dimensions[0].name

    @property
    def dims(self) -> list[str]:
        return [d.name for d in self.dimensions]

    @property
    def counts(self) -> list[str]:
        return [m.name for m in self.measures if m.kind == "count"]

    @property
    def sketches(self) -> list[str]:
        return [m.name for m in self.measures if m.kind == "hll"]

    @property
    def columns(self) -> list[str]:
        return [*self.dims, *(m.name for m in self.measures)]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(x.name, SPARK_TYPES[x.kind]) for x in (*self.dimensions, *self.measures)])

    def check(self, df: DataFrame) -> None:
        """Raises if a column is missing or has a type that its kind can't hold."""
        for x in (*self.dimensions, *self.measures):
            if x.name not in df.columns:
                raise ValueError(f"cube {self.name}: no column {x.name}")
            found = df.schema[x.name].dataType
            good = {"string": T.StringType, "hll": T.BinaryType}.get(x.kind, T.IntegralType)
            if not isinstance(found, good) and not (x.kind == "time" and isinstance(found, T.TimestampType | T.TimestampNTZType)):
                raise ValueError(f"cube {self.name}: column {x.name} has type {found.simpleString()}")

    # ---- the table's definition as SQL text

    def create_sql(self, table: str, temporary: bool = False) -> str:
        columns = [f"{x.name} {x.sql_type or SQL_TYPES[x.kind]}" for x in (*self.dimensions, *self.measures)]
        key = f"PRIMARY KEY({', '.join(self.dims)})"
        return f"CREATE {'TEMP ' if temporary else ''}TABLE IF NOT EXISTS {table} ({', '.join([*columns, key])})"

    @staticmethod
    def drop_sql(table: str) -> str:
        return f"DROP TABLE IF EXISTS {table} CASCADE"

    def copy_line(self) -> Column:
        """A row as tab-separated text: time in seconds, sketches as hexadecimal bytes."""
        shown = [F.concat(F.lit("\\\\x"), F.lower(F.hex(x.name))) if x.kind == "hll" else F.col(x.name).cast("string") for x in (*self.dimensions, *self.measures)]
        return F.concat_ws("\t", *shown)


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since 1970 UTC, rounded down, of a timestamp with or without zone, or of a number of seconds."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)") / 1_000_000).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.floor(F.unix_micros(column) / 1_000_000).cast("bigint")
    return F.col(column).cast("bigint")

"""HyperLogLog sketches in the storage format of postgresql-hll, version 1.

A sketch of few values is the set of their hashes (explicit, exact), of more it is 2^log2m registers. Which of both depends on
the set of distinct hashes alone, so sketches are built by grouping: registers are the largest rho for each (key, index), and
only keys with few filled registers are grouped by hash as well. Hashing crosses to Python in Arrow batches; grouping and
estimates are the JVM's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import bound_batches, ship_code, written

# Fixed values of Murmur3 x64-128 (published algorithm).
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
FMIX1, FMIX2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
ADD1, ADD2 = 0x52DCE729, 0x38495AB5
# Fixed values of the storage format: version, kinds.
VERSION = 1
UNDEFINED, EMPTY, EXPLICIT, SPARSE, DENSE = 0, 1, 2, 3, 4
AUTO = 63


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(FMIX1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(FMIX2)
    return h ^ (h >> np.uint64(33))


def murmur_rows(data: np.ndarray) -> np.ndarray:
    """The first 64 bits of Murmur3 x64-128 (seed 0) of each row of a matrix of bytes; all rows have one length."""
    rows, n = data.shape
    c1, c2, five = np.uint64(C1), np.uint64(C2), np.uint64(5)
    h1, h2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    padded = np.zeros((rows, -(-n // 16) * 16), np.uint8)
    padded[:, :n] = data
    lanes = padded.view("<u8").reshape(rows, -1) if n else np.zeros((rows, 0), np.uint64)
    for k in range(n // 16):
        k1, k2 = lanes[:, 2 * k], lanes[:, 2 * k + 1]
        h1 = (_rotl(h1 ^ (_rotl(k1 * c1, 31) * c2), 27) + h2) * five + np.uint64(ADD1)
        h2 = (_rotl(h2 ^ (_rotl(k2 * c2, 33) * c1), 31) + h1) * five + np.uint64(ADD2)
    if n % 16:
        h1 = h1 ^ (_rotl(lanes[:, -2] * c1, 31) * c2)
        if n % 16 > 8:
            h2 = h2 ^ (_rotl(lanes[:, -1] * c2, 33) * c1)
    h1, h2 = h1 ^ np.uint64(n), h2 ^ np.uint64(n)
    h1 = h1 + h2
    h2 = h2 + h1
    return _final(h1) + _final(h2)


def murmur_many(values: list[bytes | None]) -> list[int | None]:
    """Signed 64-bit hashes; None stays."""
    out: list[int | None] = [None] * len(values)
    by: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            by.setdefault(len(v), []).append(i)
    for n, at in by.items():
        data = np.frombuffer(b"".join(values[i] for i in at), np.uint8).reshape(len(at), n)
        for i, h in zip(at, murmur_rows(data).view(np.int64).tolist(), strict=True):
            out[i] = h
    return out


@F.pandas_udf(T.LongType())
def murmur(values: pd.Series) -> pd.Series:
    return pd.Series(murmur_many(values.tolist()), dtype="Int64")


def _little_endian(c: Column, width: int) -> Column:
    h = F.substring(F.lpad(F.hex(c.cast("bigint")), 16, "0"), 17 - 2 * width, 2 * width)
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]))


def hash_column(df: DataFrame, name: str) -> Column:
    """The hash of a column's values: integers as little-endian bytes of their width, strings as UTF-8, bytes as they are."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegerType):
        return murmur(_little_endian(F.col(name), 4))
    if isinstance(kind, T.IntegralType):
        return murmur(_little_endian(F.col(name), 8))
    return murmur(F.col(name).cast("binary"))


def address_bytes(c: Column | str) -> Column:
    """What counts of a binary network address: 4 bytes, or of 8 and more the first 8; of other lengths nothing."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.octet_length(c)
    return F.when(n == 4, c).when(n >= 8, F.substring(c, 1, 8))


@dataclass(frozen=True)
class Shape:
    """A sketch's parameters. threshold: values up to which it is explicit, -1 for what fits the size of the registers."""

    log2m: int = 11
    width: int = 5
    threshold: int = -1
    sparse: bool = True

    def __post_init__(self) -> None:
        if not (0 <= self.log2m <= 31 and 1 <= self.width <= 7 and -1 <= self.threshold <= 1 << 18):
            raise ValueError(f"no such sketch: {self}")
        if self.threshold > 0 and self.threshold & (self.threshold - 1):
            raise ValueError("the threshold must be -1, 0 or a power of two")

    @property
    def m(self) -> int:
        return 1 << self.log2m

    @property
    def explicit(self) -> int:
        return -(-self.width * self.m // 8) // 8 if self.threshold < 0 else self.threshold

    @property
    def top(self) -> int:
        return (1 << self.width) - 1

    @property
    def alpha(self) -> float:
        return {16: 0.673, 32: 0.697, 64: 0.709}.get(self.m, 0.7213 / (1 + 1.079 / self.m))

    def header(self, kind: int) -> bytes:
        coded = AUTO if self.threshold < 0 else self.threshold.bit_length()
        return bytes([VERSION << 4 | kind, (self.width - 1) << 5 | self.log2m, int(self.sparse) << 6 | coded])


DEFAULT = Shape()


def register(h: int, shape: Shape = DEFAULT) -> tuple[int, int]:
    """Index and rho of a signed hash."""
    h &= (1 << 64) - 1
    w = h >> shape.log2m
    return h & (shape.m - 1), min(shape.top, (w & -w).bit_length()) if w else 0


@dataclass(frozen=True)
class Sketch:
    """hashes if it is explicit, registers (index to rho) if not; neither for the undefined one."""

    shape: Shape = DEFAULT
    hashes: frozenset[int] | None = frozenset()
    registers: tuple[tuple[int, int], ...] | None = None

    @property
    def kind(self) -> str:
        if self.hashes is None and self.registers is None:
            return "UNDEFINED"
        return "COMPRESSED" if self.registers is not None else "EXPLICIT" if self.hashes else "EMPTY"

    def cardinality(self) -> float:
        if self.kind == "UNDEFINED":
            return -1.0
        if self.registers is None:
            return float(len(self.hashes))
        s, filled = self.shape, dict(self.registers)
        zeros = s.m - len(filled)
        estimate = s.alpha * s.m * s.m / (zeros + sum(2.0**-r for r in filled.values()))
        if zeros and estimate < 2.5 * s.m:
            return s.m * float(np.log(s.m / zeros))
        space = 2.0 ** (s.log2m + s.top - 1)
        return estimate if estimate <= space / 30 else -space * float(np.log(1 - estimate / space))

    def describe(self) -> str:
        s = self.shape
        n = len(self.hashes) if self.registers is None and self.hashes is not None else len(self.registers or ())
        return f"{self.kind}, {n} {'elements' if self.registers is None else 'filled registers'}, nregs={s.m}, nbits={s.width}, expthresh={s.threshold}({s.explicit}), sparseon={int(s.sparse)}"


    def dump(self) -> str:
        """describe, and what the sketch has. The form of the lines, of a number and a hash, or of 32 registers."""
        if self.registers is not None:
            filled = dict(self.registers)
            rows = range(0, self.shape.m - 31, 32)
            return self.describe() + ":" + "".join(f"\n{at:4d}: " + "".join(f"{filled.get(i, 0):2d} " for i in range(at, at + 32)) for at in rows)
        if self.hashes:
            return self.describe() + ":" + "".join(f"\n{i}: {h:20d} " for i, h in enumerate(sorted(self.hashes)))
        return self.describe()


def build(hashes: Iterable[int], shape: Shape = DEFAULT, registers: Iterable[tuple[int, int]] | None = None) -> Sketch:
    """The sketch of some hashes, and of registers where some values are known by those only."""
    values = frozenset(hashes)
    if registers is None and len(values) <= shape.explicit:
        return Sketch(shape, values)
    best: dict[int, int] = {}
    for i, r in [*(registers or ()), *(register(h, shape) for h in values)]:
        if r > best.get(i, 0):
            best[i] = r
    return Sketch(shape, None, tuple(sorted(best.items())))


def union(a: Sketch, b: Sketch) -> Sketch:
    """The undefined sketch absorbs, the empty one changes nothing. All four parameters must agree."""
    if a.shape != b.shape:
        raise ValueError(f"sketches of different parameters: {a.shape}, {b.shape}")
    if "UNDEFINED" in (a.kind, b.kind):
        return Sketch(a.shape, None, None)
    known = [x.registers for x in (a, b) if x.registers is not None]
    return build((a.hashes or frozenset()) | (b.hashes or frozenset()), a.shape, [r for x in known for r in x] if known else None)


def _to_bits(values: np.ndarray, width: int) -> np.ndarray:
    return (values[:, None] >> np.arange(width - 1, -1, -1)) & 1


def pack(sketch: Sketch) -> bytes:
    s = sketch.shape
    if sketch.kind in ("UNDEFINED", "EMPTY"):
        return s.header(UNDEFINED if sketch.kind == "UNDEFINED" else EMPTY)
    if sketch.registers is None:
        return s.header(EXPLICIT) + np.array(sorted(sketch.hashes), ">i8").tobytes()
    at = np.array([i for i, r in sketch.registers if r], np.int64)
    rho = np.array([r for _, r in sketch.registers if r], np.int64)
    if s.sparse and len(at) * (s.log2m + s.width) < s.m * s.width:
        return s.header(SPARSE) + np.packbits(_to_bits(at << s.width | rho, s.log2m + s.width).ravel().astype(np.uint8)).tobytes()
    full = np.zeros(s.m, np.int64)
    full[at] = rho
    return s.header(DENSE) + np.packbits(_to_bits(full, s.width).ravel().astype(np.uint8)).tobytes()


def unpack(data: bytes) -> Sketch:
    if len(data) < 3 or data[0] >> 4 != VERSION:
        raise ValueError("not a sketch of version 1")
    kind, coded = data[0] & 15, data[2] & 63
    shape = Shape(data[1] & 31, (data[1] >> 5) + 1, -1 if coded == AUTO else (1 << coded) >> 1, bool(data[2] >> 6 & 1))
    body = data[3:]
    if kind in (UNDEFINED, EMPTY):
        return Sketch(shape, None if kind == UNDEFINED else frozenset())
    if kind == EXPLICIT:
        if len(body) % 8:
            raise ValueError("an explicit sketch has 8 bytes for each value")
        values = np.frombuffer(body, ">i8").astype(np.int64)
        if (np.diff(values.astype(object)) <= 0).any():
            raise ValueError("an explicit sketch's values must ascend")
        return Sketch(shape, frozenset(values.tolist()))
    bits = np.unpackbits(np.frombuffer(body, np.uint8))
    number = lambda b: b.astype(np.int64) @ (1 << np.arange(b.shape[1] - 1, -1, -1, dtype=np.int64))
    if kind == SPARSE:
        wide = shape.log2m + shape.width
        values = number(bits[: len(bits) // wide * wide].reshape(-1, wide))
        pairs = [(int(v) >> shape.width, int(v) & shape.top) for v in values if int(v) & shape.top]
        return Sketch(shape, None, tuple(sorted(pairs)))
    if kind == DENSE:
        if len(body) != -(-shape.m * shape.width // 8):
            raise ValueError("a dense sketch has all registers")
        values = number(bits[: shape.m * shape.width].reshape(-1, shape.width))
        return Sketch(shape, None, tuple((i, int(r)) for i, r in enumerate(values) if r))
    raise ValueError(f"no such kind of sketch: {kind}")


# ---- by Spark


def cells(df: DataFrame, dims: list[str], hashed: str, shape: Shape = DEFAULT) -> DataFrame:
    """dims, idx, rho, h: a row for each key and filled register at most. h: the hash, where only one has been seen."""
    rest = F.shiftrightunsigned(hashed, shape.log2m)
    zeros = F.bit_count(rest.bitwiseAND(-rest) - 1)
    rho = F.when(rest == 0, 0).otherwise(F.least(F.lit(shape.top), zeros + 1))
    rows = df.where(F.col(hashed).isNotNull()).select(*dims, F.col(hashed).bitwiseAND(F.lit(shape.m - 1)).cast("int").alias("idx"), rho.cast("int").alias("rho"))
    return rows.groupBy(*dims, "idx").agg(F.max("rho").alias("rho"))


def sliced(df: DataFrame, dims: list[str], hashed: str, name: str = "slice", shape: Shape = DEFAULT) -> DataFrame:
    """dims, the distinct hashes and their slice: a range of hashes, in order, that has no more of them than an explicit sketch holds.

    Sketches by dims and slice are all explicit, so what is counted in them and added up is exact however many values a key has, and a key
    lies in as many tasks as it has slices. Null hashes are kept, in slice 0. The rows are written: hashes are computed once.
    """
    if shape.explicit < 1:
        raise ValueError("slices need explicit sketches")
    rows = written(df.select(*dims, hashed).distinct(), "hashes")
    number = lambda bits: F.shiftright(hashed, 64 - bits).cast("bigint") if bits else F.lit(0).cast("bigint")
    n, low, high = rows.agg(F.approx_count_distinct(hashed), F.min(hashed), F.max(hashed)).first()
    # a mean of a quarter of what fits, over the bits in which the hashes differ; then it is made sure of
    bits = 0 if n <= shape.explicit // 2 else min(64, (4 * n // shape.explicit).bit_length() + 64 - (high - low).bit_length())
    while (rows.groupBy(number(bits)).agg(F.count_distinct(hashed).alias("n")).agg(F.max("n")).first()[0] or 0) > shape.explicit:
        bits += 1
    return rows.withColumn(name, F.coalesce(number(bits), F.lit(0).cast("bigint")))


def estimates(df: DataFrame, dims: list[str], hashed: str, name: str, shape: Shape = DEFAULT) -> DataFrame:
    """dims and the estimated number of distinct hashes (double); null hashes don't count.

    Registers bound what is shuffled. Only keys with so few filled ones that they can be explicit are counted by hash.
    """
    filled = F.count_if(F.col("rho") > 0)
    total = F.sum(F.when(F.col("rho") > 0, F.pow(F.lit(2.0), -F.col("rho"))).otherwise(0.0))
    sums = cells(df, dims, hashed, shape).groupBy(*dims).agg(filled.alias("__filled"), F.count("*").alias("__cells"), total.alias("__sum"))
    zeros = F.lit(shape.m) - F.col("__filled")
    raw = F.lit(shape.alpha * shape.m * shape.m) / (zeros + F.col("__sum"))
    space = 2.0 ** (shape.log2m + shape.top - 1)
    linear = F.lit(float(shape.m)) * F.log(F.lit(float(shape.m)) / zeros)
    estimate = F.when((zeros > 0) & (raw < 2.5 * shape.m), linear).when(raw <= space / 30, raw).otherwise(F.lit(-space) * F.log(1 - raw / space))
    sums = sums.withColumn("__estimate", estimate)
    few = sums.where(F.col("__cells") <= shape.explicit).select(*dims)
    on = _null_safe(dims, "d", "f")
    exact = df.alias("d").join(few.alias("f"), on, "left_semi").groupBy(*[F.col(f"d.{c}") for c in dims]).agg(F.count_distinct(F.col(f"d.{hashed}")).alias("__exact"))
    out = sums.alias("d").join(exact.alias("f"), on, "left")
    best = F.when(F.col("__exact") <= shape.explicit, F.col("__exact").cast("double")).otherwise(F.col("__estimate"))
    keys = df.select(*dims).distinct()
    known = out.select(*[F.col(f"d.{c}").alias(c) for c in dims], best.alias(name))
    joined = keys.alias("d").join(known.alias("f"), on, "left")
    return joined.select(*[F.col(f"d.{c}").alias(c) for c in dims], F.coalesce(F.col(f"f.{name}"), F.lit(0.0)).alias(name))


def _null_safe(dims: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for d in dims:
        out = out & F.col(f"{a}.{d}").eqNullSafe(F.col(f"{b}.{d}"))
    return out


def sketches(df: DataFrame, dims: list[str], hashed: str, name: str, shape: Shape = DEFAULT) -> DataFrame:
    """dims and the packed sketch. What is collected for a key is its registers, or its hashes if they are few."""
    found = cells(df, dims, hashed, shape)
    registers = found.groupBy(*dims).agg(F.collect_list(F.struct("idx", "rho")).alias("__registers"), F.count("*").alias("__cells"))
    few = registers.where(F.col("__cells") <= shape.explicit).select(*dims)
    on = _null_safe(dims, "d", "f")
    hashes = df.alias("d").join(few.alias("f"), on, "left_semi").groupBy(*[F.col(f"d.{c}") for c in dims]).agg(F.collect_set(F.col(f"d.{hashed}")).alias("__hashes"))

    @F.pandas_udf(T.BinaryType())
    def packed(hashes: pd.Series, registers: pd.Series) -> pd.Series:
        return pd.Series([pack(_whole(h, r, shape)) for h, r in zip(hashes, registers, strict=True)])

    both = registers.alias("d").join(hashes.alias("f"), on, "left").select(*[F.col(f"d.{c}").alias(c) for c in dims], "__hashes", F.transform("__registers", lambda x: x["idx"] * 128 + x["rho"]).alias("__registers"))
    return both.select(*dims, packed("__hashes", "__registers").alias(name))


def _whole(hashes: object, registers: object, shape: Shape) -> Sketch:
    if hashes is not None and len(hashes) <= shape.explicit:
        return build([int(h) for h in hashes], shape)
    return build([], shape, [(int(x) >> 7, int(x) & 127) for x in registers])


class Uniting:
    """A union that grows by packed sketches: a set of hashes while it is explicit, registers then."""

    def __init__(self) -> None:
        self.header: bytes | None = None
        self.hashes: set[int] | None = set()
        self.registers: np.ndarray | None = None

    def add(self, data: bytes) -> None:
        if len(data) < 3 or data[0] >> 4 != VERSION:
            raise ValueError("not a sketch of version 1")
        if self.header is None:
            self.header, coded = data[1:3], data[2] & 63
            self.shape = Shape(data[1] & 31, (data[1] >> 5) + 1, -1 if coded == AUTO else (1 << coded) >> 1, bool(data[2] >> 6 & 1))
        elif self.header != data[1:3]:
            raise ValueError(f"sketches of different parameters: {self.header.hex()}, {data[1:3].hex()}")
        kind, s = data[0] & 15, self.shape
        if kind == UNDEFINED:
            self.hashes = self.registers = None
        elif self.hashes is None and self.registers is None or kind == EMPTY:
            pass
        elif kind == DENSE and len(data) == 3 + -(-s.m * s.width // 8):
            bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=3), count=s.m * s.width).reshape(s.m, s.width)
            self._registers()
            np.maximum(self.registers, bits @ (1 << np.arange(s.width - 1, -1, -1, dtype=np.uint8)), out=self.registers)
        else:
            found = unpack(data)
            if found.registers is not None:
                self._registers()
                for i, r in found.registers:
                    self.registers[i] = max(self.registers[i], r)
            elif self.registers is not None:
                self._hashed(found.hashes)
            else:
                self.hashes |= found.hashes
                if len(self.hashes) > s.explicit:
                    self._registers()

    def _registers(self) -> None:
        """From now on in registers."""
        if self.registers is None:
            self.registers, hashes, self.hashes = np.zeros(self.shape.m, np.uint8), self.hashes, None
            self._hashed(hashes)

    def _hashed(self, hashes: Iterable[int]) -> None:
        for h in hashes:
            i, r = register(h, self.shape)
            self.registers[i] = max(self.registers[i], r)

    def packed(self) -> bytes | None:
        if self.header is None:
            return None
        if self.registers is not None:
            at = np.flatnonzero(self.registers)
            return pack(Sketch(self.shape, None, tuple(zip(at.tolist(), self.registers[at].tolist(), strict=True))))
        return pack(Sketch(self.shape, None if self.hashes is None else frozenset(self.hashes)))


#: Keys whose unions a task holds at once (some 2 KB a sketch).
HELD_KEYS = 4096


def united_in_tasks(df: DataFrame, keys: list[str], sketches: list[str], sums: list[str] | None = None) -> DataFrame:
    """keys, the sums and the unions of what each task has of a key: of HELD_KEYS keys at a time. Null sketches don't count."""
    sums = sums or []
    ship_code(df.sparkSession)
    bound_batches(df.sparkSession)
    k, fields = len(keys), [*[df.schema[c] for c in keys], *[T.StructField(c, T.LongType()) for c in sums], *[T.StructField(c, T.BinaryType()) for c in sketches]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    arrow = to_arrow_schema(schema)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list[int], list[Uniting]]] = {}

        def rows() -> pa.RecordBatch:
            out = [(*key, *n, *(u.packed() for u in unions)) for key, (n, unions) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[:k]
                if key not in held:
                    if len(held) == HELD_KEYS:
                        yield rows()
                    held[key] = [0] * len(sums), [Uniting() for _ in sketches]
                n, unions = held[key]
                for i, value in enumerate(row[k : k + len(sums)]):
                    n[i] += value or 0
                for union, data in zip(unions, row[k + len(sums) :], strict=True):
                    if data is not None:
                        union.add(data)
        if held:
            yield rows()

    return df.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in sums], *sketches).mapInArrow(unite, schema)


def union_agg(df: DataFrame, keys: list[str], sketches: list[str], sums: list[str] | None = None) -> DataFrame:
    """keys, the sums of some columns and the union of each column of packed sketches, a row for each key (null is one); without keys, one row.

    Each task unites the sketches of a key that it has and sends one sketch for each on; the tasks that get them by key unite those one by
    one, as they come in order of the keys. So of one key's sketches, however many there are, a task gets one from each task before (or
    some, if those had more keys), and holds one. A key without any sketch has null.
    """
    partial = united_in_tasks(df, keys, sketches, sums)
    dealt = partial.repartition(*keys).sortWithinPartitions(*keys) if keys else partial.repartition(1)
    # a key's rows come one after the other here, so what goes on is whole
    return united_in_tasks(dealt, keys, sketches, sums)


def contents(df: DataFrame, keys: list[str], sketch: str) -> DataFrame:
    """keys, kind, at, value: what packed sketches have, as rows. Of an explicit one the hashes in order, of a compressed one its filled
    registers with their rho; an empty or undefined one has one row without at and value. Null sketches have none."""
    ship_code(df.sparkSession)
    bound_batches(df.sparkSession)
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keys], T.StructField("kind", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("value", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, at, values = [], [], [], []
            for i, data in enumerate(batch.column(len(keys)).to_pylist()):
                if data is None:
                    continue
                found = unpack(data)
                pairs = list(found.registers) if found.registers is not None else list(enumerate(sorted(found.hashes))) if found.hashes else [(None, None)]
                rows += [i] * len(pairs)
                kinds += [found.kind] * len(pairs)
                at += [p[0] for p in pairs]
                values += [p[1] for p in pairs]
            if rows:
                taken = [batch.column(c).take(pa.array(rows)) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(kinds, pa.string()), pa.array(at, pa.int32()), pa.array(values, pa.int64())], schema=arrow)

    return df.select(*keys, sketch).mapInArrow(run, schema)


def joined(df: DataFrame, keys: list[str], slice_: str, sketch: str) -> DataFrame:
    """keys and one explicit sketch of the explicit ones of a key's slices: the head, and the hashes of all, in order. A key's bytes are one
    value, which may have more hashes than the threshold in its head: readers take it as it is, a union makes registers of it."""
    parts = F.sort_array(F.collect_list(F.struct(slice_, F.hex(F.expr(f"substring(`{sketch}`, 4)")).alias("body"))))
    head = F.first(F.hex(F.substring(sketch, 1, 3)), ignorenulls=True)
    return df.groupBy(*keys).agg(F.unhex(F.concat(head, F.array_join(F.transform(parts, lambda x: x["body"]), ""))).alias(sketch))


@F.pandas_udf(T.StringType())
def dump(values: pd.Series) -> pd.Series:
    """Each packed sketch as text: its parameters, and all that it has."""
    return pd.Series([None if v is None else unpack(bytes(v)).dump() for v in values], dtype="object")


@F.pandas_udf(T.DoubleType())
def cardinality(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else unpack(bytes(v)).cardinality() for v in values], dtype="float64")

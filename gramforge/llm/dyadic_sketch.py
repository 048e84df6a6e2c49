"""Percentiles of very large numeric columns by dyadic Count-sketches.

A value is encoded as an order-preserving integer of `12 + mantissa_bits` bits. Level l of the
dyadic tree counts the codes shifted right by l. Every level with more than 2**exact_bits nodes is a
signed Count-sketch of `depth` rows by `width` cells; the coarsest of the kept levels has at most 2**exact_bits nodes, fewer than
a sketch has cells, and is counted node by node (its sums give the levels above).
A sketch is a table with one row per group and level: (group, level, cells, n), `cells` being the packed array of the
level's non-zero cells and n the counted rows. Two sketches are merged by adding arrays, and deletion
adds with weight -1. Ranks are inverted by descending the levels.

Building: every task encodes its rows batch by batch and adds them up per (group, code) in memory of a fixed
bound. What it ships per group is the shorter of these counted codes and the sketch's own cells, so a
group that holds a third of all rows ships one bounded part per task. Parts are added in two steps, first
in `fan` groups of tasks, then over these.

Stated error, per group and quantile: the rank of the answer differs from q*n by at most
`rank_bound` with high probability. It is the smaller of two sums over the sketched levels, both read off the sketch: three standard
deviations sqrt(F2/width) of a Count-sketch row; and three of the rows' estimates at the visited node, from their median absolute
deviation (0 where most rows agree, as with few distinct values). Both count the spread of a median of `depth` rows.
The value's relative error is at most 2**-mantissa_bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.errors import InvalidOperation
from gramforge.util import col, join_on, reject_clash, require

SKETCH_COLUMNS = ("level", "cells", "n")
#: Rows of (group, code) a task holds before it ships them, and codes in one shipped row.
_HELD, _SHIPPED = 1 << 20, 1 << 16
_CODES = -1


@dataclass(frozen=True)
class SketchShape:
    """Parameters every mergeable part must share. width is a power of two."""

    mantissa_bits: int = 16
    exact_bits: int = 14
    width: int = 4096
    depth: int = 5

    def __post_init__(self):
        if self.width & (self.width - 1) or self.width < 2 or not 1 <= self.mantissa_bits <= 36 or self.depth < 1 or not 1 <= self.exact_bits <= 22:
            raise InvalidOperation(f"bad sketch shape {self}")

    @property
    def bits(self) -> int:
        return 12 + self.mantissa_bits

    @property
    def sketched(self) -> int:
        """Number of sketched levels; the next one is counted node by node."""
        return max(0, self.bits - self.exact_bits)

    @property
    def most_cells(self) -> int:
        return self.sketched * self.depth * self.width + 2 ** min(self.exact_bits, self.bits)


def encode(v: np.ndarray, shape: SketchShape) -> np.ndarray:
    """Order-preserving codes of finite doubles: sign, binary exponent, leading mantissa bits."""
    mag = (np.abs(v).view(np.int64)) >> (52 - shape.mantissa_bits)
    mid = np.int64(1) << (shape.bits - 1)
    return np.where(v < 0, mid - 1 - mag, mid + mag)


def decode(codes: np.ndarray, shape: SketchShape) -> np.ndarray:
    """The middle of the values that share a code; 0 for the code of 0."""
    mid = np.int64(1) << (shape.bits - 1)
    neg = codes < mid
    mag = np.where(neg, mid - 1 - codes, codes - mid).astype(np.int64)
    shift = 52 - shape.mantissa_bits
    v = np.where(mag == 0, 0.0, ((mag << shift) + (1 << (shift - 1))).view(np.float64))
    return np.where(neg, -v, v)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words (finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(nodes: np.ndarray, level: int, shape: SketchShape) -> tuple[np.ndarray, np.ndarray]:
    """(flat cell, sign) of every node in each row of a level's sketch, both depth x nodes."""
    seeds = _mix(np.arange(1, shape.depth + 1, dtype=np.uint64) + np.uint64(level * 1000))
    h = _mix(nodes.astype(np.uint64)[None, :] ^ seeds[:, None])
    cell = (h >> np.uint64(8)).astype(np.int64) & (shape.width - 1)
    return cell + (np.arange(shape.depth) * shape.width)[:, None], 1 - 2 * (h & np.uint64(1)).astype(np.int64)


def _sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their sums, without keys whose sum is 0."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.add.reduceat(n, first)
    return key[first][n != 0], n[n != 0]


def _narrow(x: np.ndarray) -> np.ndarray:
    for t in (np.int8, np.int16, np.int32):
        if not len(x) or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max):
            return x.astype(t)
    return x


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted places and their counts, as differences in the narrowest integers, deflated."""
    step, n = _narrow(np.diff(at, prepend=0)), _narrow(n)
    return struct.pack("<IBB", len(at), step.itemsize, n.itemsize) + zlib.compress(step.tobytes() + n.tobytes(), 1)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, a, b = struct.unpack_from("<IBB", raw)
    body = zlib.decompress(raw[6:])
    return np.cumsum(np.frombuffer(body, f"<i{a}", size).astype(np.int64)), np.frombuffer(body, f"<i{b}", size, size * a).astype(np.int64)


class _Adder:
    """The sum of parts of one group: counted codes as long as they are the shorter form, else cells by level."""

    def __init__(self, shape: SketchShape):
        self.shape = shape
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.levels: dict[int, np.ndarray] = {}

    def codes(self, code: np.ndarray, n: np.ndarray) -> None:
        self.held.append((code, n))
        self.size += len(code)
        if self.size > 2 * self.shape.most_cells:
            self.fold()
            if self.size > self.shape.most_cells:
                self.sketch()

    def cells(self, level: int, at: np.ndarray, n: np.ndarray) -> None:
        if level not in self.levels:
            size = self.shape.depth * self.shape.width if level < self.shape.sketched else 2 ** min(self.shape.exact_bits, self.shape.bits)
            self.levels[level] = np.zeros(size, np.int64)
        self.levels[level][at] += n

    def add(self, level: int, raw: bytes) -> None:
        at, n = unpack(raw)
        if level == _CODES:
            self.codes(at, n)
        else:
            self.cells(level, at, n)

    def fold(self) -> None:
        if len(self.held) > 1:
            self.held = [_sum_by(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
            self.size = len(self.held[0][0])

    def sketch(self) -> None:
        self.fold()
        for code, n in self.held:
            for level in range(self.shape.sketched + 1):
                nodes, m = _sum_by(code >> level, n)
                if level == self.shape.sketched:
                    self.cells(level, nodes, m)
                elif len(nodes):
                    cell, sign = _places(nodes, level, self.shape)
                    at, k = _sum_by(cell.ravel(), (sign * m).ravel())
                    self.cells(level, at, k)
        self.held, self.size = [], 0

    def rows(self, final: bool) -> Iterator[tuple[int, bytes, int]]:
        """(level, cells, n): of a final sum all levels, else the shorter form."""
        self.fold()
        if final or self.levels or self.size > self.shape.most_cells:
            self.sketch()
        for code, n in self.held:
            for i in range(0, len(code), _SHIPPED):
                yield _CODES, pack(code[i : i + _SHIPPED], n[i : i + _SHIPPED]), int(n[i : i + _SHIPPED].sum())
        top = self.levels.get(self.shape.sketched)
        total = 0 if top is None else int(top.sum())
        for level in sorted(self.levels):
            at = np.flatnonzero(self.levels[level])
            if len(at):
                yield level, pack(at, self.levels[level][at]), total


def _batch(keys: list[tuple], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*[(*k, *r) for k, r in zip(keys, rows, strict=True)], strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _merged(parts: DataFrame, keys: Sequence[str], by: Sequence[str], schema: pa.Schema, kind: T.StructType, shape: SketchShape, final: bool) -> DataFrame:
    """Adds the parts that agree on `by`; a task streams over its sorted parts and holds one sum."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k, extra = len(keys), len(by) - len(keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, adder = None, None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for i, (level, raw) in enumerate(zip(cols[k], cols[k + 1], strict=True)):
                key = tuple(c[i] for c in cols[:k]) + ((cols[k + 3][i],) if extra else ())
                if adder is None or key != now:
                    if adder is not None:
                        rows = list(adder.rows(final))
                        yield _batch([now[:k]] * len(rows), rows, schema)
                    now, adder = key, _Adder(shape)
                adder.add(level, raw)
        if adder is not None:
            rows = list(adder.rows(final))
            yield _batch([now[:k]] * len(rows), rows, schema)

    # The number of partitions is given, as coalescing by bytes would leave the sketching to one task.
    return parts.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(kernel, kind)


def build_sketch(df: DataFrame, groups: Sequence[str], value: str, *, shape: SketchShape = SketchShape(), weight: str | None = None, fan: int = 32) -> DataFrame:  # noqa: B008
    """The sketch of `value` per combination of `groups`: their columns and (level, cells, n).

    NULL, NaN and infinite values are not counted. A NULL group is a group of its own. Repeated
    rows and ties count each. weight: a column of integral counts, negative to delete (NULL counts 0). An
    empty table gives an empty sketch, and so does a group whose counts add up to 0 in every code. Other columns of `df` are not carried along;
    a group column may not be named level, cells or n. fan: groups of tasks whose parts are added first.
    """
    reject_clash(groups, SKETCH_COLUMNS)
    require(df, *groups, value, *([weight] if weight else []))
    g = [f"_g{i}" for i in range(len(groups))]
    v = col(value).cast("double")
    fin = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    w = F.coalesce(col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    src = df.where(fin).select(*[col(a).alias(b) for a, b in zip(groups, g, strict=True)], v.alias("v"), w.alias("w"))
    kinds = [src.schema[x] for x in g]
    out = T.StructType([*kinds, T.StructField("level", T.IntegerType()), T.StructField("cells", T.BinaryType()), T.StructField("n", T.LongType())])
    part = T.StructType([*out.fields, T.StructField("salt", T.IntegerType())])
    empty = src.sparkSession.createDataFrame([], out)
    arrow = empty.toArrow().schema
    arrow_part = pa.schema([*arrow, pa.field("salt", pa.int32())])
    k, bits = len(g), shape.bits

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % fan
        ids: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def shipped() -> Iterator[pa.RecordBatch]:
            code, n = held[0]
            names = list(ids)
            owner = code >> bits
            cuts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(code)]])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    adder = _Adder(shape)
                    adder.codes(code[lo:hi] & ((1 << bits) - 1), n[lo:hi])
                    rows = [(*r, salt) for r in adder.rows(False)]
                    yield _batch([names[owner[lo]]] * len(rows), rows, arrow_part)

        for b in batches:
            if not b.num_rows:
                continue
            mark = np.zeros(b.num_rows, np.int64)
            for i in range(k):
                d = b.column(i).dictionary_encode()
                mark = mark * (len(d.dictionary) + 1) + (d.indices.fill_null(len(d.dictionary))).to_numpy(zero_copy_only=False)
            _, first, inv = np.unique(mark, return_index=True, return_inverse=True)
            own = np.array([ids.setdefault(tuple(b.column(i)[int(r)].as_py() for i in range(k)), len(ids)) for r in first], np.int64)
            code = encode(b.column(k).to_numpy(zero_copy_only=False), shape)
            held.append(_sum_by((own[inv.ravel()] << bits) | code, b.column(k + 1).to_numpy(zero_copy_only=False)))
            size += len(held[-1][0])
            if size > 2 * _HELD:
                held = [_sum_by(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > _HELD:
                    yield from shipped()
                    held, size, ids = [], 0, {}
        if held:
            held = [_sum_by(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield from shipped()

    parts = src.mapInArrow(kernel, part)
    some = _merged(parts, g, [*g, "salt"], arrow, out, shape, False)
    # Without groups a constant takes the place of the key.
    whole = _merged(some if g else some.withColumn("_all", F.lit(0)), g, g or ["_all"], arrow, out, shape, True)
    return whole.select(*[col(b).alias(a) for a, b in zip(groups, g, strict=True)], "level", "cells", "n")


def merge_sketches(sketch: DataFrame, groups: Sequence[str], *, shape: SketchShape = SketchShape()) -> DataFrame:  # noqa: B008
    """Adds sketches (of days, areas, deletions ...) into one per combination of `groups`; a task holds the sum of one level."""
    g = [f"_g{i}" for i in range(len(groups))]
    src = sketch.select(*[col(a).alias(b) for a, b in zip(groups, g, strict=True)], "level", "cells", "n", col("level").alias("lv"))
    out = T.StructType(src.schema.fields[:-1])
    arrow = src.sparkSession.createDataFrame([], out).toArrow().schema
    k, n = len(g), int(sketch.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, level, total, adder = None, 0, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(adder.levels[level])
            if len(at):
                yield _batch([now[:k]], [(level, pack(at, adder.levels[level][at]), total)], arrow)

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for i in range(b.num_rows):
                key = tuple(c[i] for c in cols[: k + 1])
                if key != now:
                    if adder is not None:
                        yield from done()
                    now, level, total, adder = key, key[k], 0, _Adder(shape)
                adder.add(level, cols[k + 1][i])
                total += cols[k + 2][i]
        if adder is not None:
            yield from done()

    merged = src.repartition(n, *g, "lv").sortWithinPartitions(*g, "lv").mapInArrow(kernel, out)
    return merged.select(*[col(b).alias(a) for a, b in zip(groups, g, strict=True)], "level", "cells", "n")


def _invert(levels: Sequence[int], cells: Sequence[bytes], qs: np.ndarray, shape: SketchShape) -> tuple[int, np.ndarray, np.ndarray]:
    """(total, rank bounds, quantiles); all quantiles descend together."""
    s, d, w = shape.sketched, shape.depth, shape.width
    adder = _Adder(shape)
    for level, raw in zip(levels, cells, strict=True):
        adder.add(level, raw)
    top = adder.levels.get(s, np.zeros(1, np.int64))
    total = int(top.sum())
    f2 = [np.median((adder.levels[lv].reshape(d, w).astype(float) ** 2).sum(axis=1)) for lv in range(s) if lv in adder.levels]
    spread = 1.0 if d < 3 else float(np.sqrt(np.pi / 2 / d))  # of a median of d normal values, from above
    bound = 3 * spread * float(sum(np.sqrt(x / w) for x in f2))
    if total <= 0:
        return total, np.zeros(len(qs)), np.full(len(qs), np.nan)
    r = np.maximum(1.0, np.ceil(qs * total - 1e-9))
    below = np.cumsum(top)
    node = np.searchsorted(below, r)
    size = top[node].astype(float)
    r = r - (below[node] - size)
    apart = np.zeros(len(qs))
    for lv in range(s - 1, -1, -1):
        node = node * 2
        cell, sign = _places(node, lv, shape)
        est = sign * adder.levels[lv][cell] if lv in adder.levels else np.zeros((d, len(node)))
        left = np.median(est, axis=0)
        apart += 3 * spread * 1.4826 * np.median(np.abs(est - left), axis=0)
        left = np.minimum(np.maximum(left, 0.0), size)
        right = (r > left) & (left < size)
        r, size, node = np.where(right, r - left, r), np.where(right, size - left, left), node + right
    return total, np.minimum(bound, apart), decode(node, shape)


def sketch_quantiles(sketch: DataFrame, groups: Sequence[str], qs: Sequence[float], *, shape: SketchShape = SketchShape()) -> DataFrame:  # noqa: B008
    """Per group and q: `q`, `quantile` (the least value whose rank reaches q*n), `n_values`, `rank_bound`.

    sketch: one row per group and level, as `build_sketch` and `merge_sketches` give them, so a group is a few rows however many it counts.
    A group whose counts are deleted down to 0 has a NULL quantile, or no row if no cell is left.
    """
    if bad := [q for q in qs if not 0 <= q <= 1]:
        raise InvalidOperation(f"quantiles outside [0, 1]: {bad}")
    kinds = {f.name: f.dataType for f in sketch.schema}
    schema = T.StructType([T.StructField(g, kinds[g]) for g in groups] + [T.StructField("q", T.DoubleType()), T.StructField("quantile", T.DoubleType()), T.StructField("n_values", T.LongType()), T.StructField("rank_bound", T.DoubleType())])
    qs = [float(q) for q in qs]

    def kernel(key, pdf):
        n, bound, vals = _invert(pdf["level"], pdf["cells"], np.array(qs), shape)
        cols = {g: [k] * len(qs) for g, k in zip(groups, key, strict=True)}
        return pd.DataFrame(cols | {"q": qs, "quantile": vals, "n_values": n, "rank_bound": bound})

    return sketch.groupBy(*[col(g) for g in groups]).applyInPandas(kernel, schema)


def check_ranks(df: DataFrame, quantiles: DataFrame, groups: Sequence[str], value: str, *, shape: SketchShape = SketchShape()) -> DataFrame:  # noqa: B008
    """Per group and q the exact rank error of the sketched quantiles and whether it is within `rank_bound`, by one more pass over `df`.

    Result: the groups, `q`, `n_values` (finite values counted here), `rank_error` and `within_bound`. The error is how far
    q*n lies outside the ranks of the values that share the quantile's code.
    """
    require(df, *groups, value)
    require(quantiles, *groups, "q", "quantile", "rank_bound")
    size = quantiles.select("q").distinct().count()
    v = col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))).select(*[col(g) for g in groups], v.alias("_v"))
    ask = quantiles.groupBy(*[col(g) for g in groups]).agg(F.sort_array(F.collect_list(F.struct("q", "quantile", "rank_bound"))).alias("_a"))
    x = join_on(rows, ask, groups, "inner")
    part = []
    for i in range(size):
        at = F.col("_a")[i]["quantile"]
        tol = F.abs(at) * 2.0 ** -(shape.mantissa_bits + 1) * 1.01
        part += [F.count_if(F.col("_v") < at - tol).alias(f"l{i}"), F.count_if(F.col("_v") <= at + tol).alias(f"h{i}")]
    x = x.groupBy(*[col(g) for g in groups]).agg(F.count(F.lit(1)).alias("n_values"), F.first("_a").alias("_a"), *part)
    each = F.array(*[F.struct(F.col("_a")[i]["q"].alias("q"), F.col("_a")[i]["rank_bound"].alias("b"), F.col(f"l{i}").alias("l"), F.col(f"h{i}").alias("h")) for i in range(size)])
    x = x.select(*[col(g) for g in groups], "n_values", F.inline(each))
    want = F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("n_values") - 1e-9).cast("double"))
    err = F.greatest(F.lit(0.0), F.col("l") + 1 - want, want - F.col("h"))
    return x.select(*[col(g) for g in groups], "q", "n_values", err.alias("rank_error"), (err <= F.col("b") + 1).alias("within_bound"))

"""A frame of named columns over a Spark DataFrame.

Relational methods are lazy. Missing means NULL, or NaN in a floating column. Methods that depend on
row order use the frame's `order_by` columns through `operators.ordered`; a frame without an order rejects
them. Methods that return numbers run one aggregate job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation, ShapeMismatch, VariableNotFound
from gramforge.formula import Formula
from gramforge.operators.ordered import Ordered
from gramforge.plans.moments import gram
from gramforge.plans.select import quantiles, select_ranks
from gramforge.util import col, free_name, is_missing, require

_NUMERIC = ("double", "float", "tinyint", "smallint", "int", "bigint", "boolean")
_AGGS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median}


class Frame:
    def __init__(self, df: DataFrame, order_by: Sequence[str] = (), partition_by: Sequence[str] = ()):
        require(df, *order_by, *partition_by)
        self.df, self.order_by, self.partition_by = df, tuple(order_by), tuple(partition_by)

    # construction and schema
    @staticmethod
    def new(spark: SparkSession, columns: Mapping[str, Sequence]) -> Frame:
        """From equally long Python sequences; the row number becomes the order."""
        if len({len(v) for v in columns.values()}) > 1:
            raise ShapeMismatch("columns differ in length")
        pos = free_name("row_no", columns)
        n = len(next(iter(columns.values()), []))
        return Frame(spark.createDataFrame(pd.DataFrame({**columns, pos: range(n)})), [pos])

    @staticmethod
    def from_columns(spark: SparkSession, columns: Mapping[str, Sequence], schema: Mapping[str, str]) -> Frame:
        if len({len(v) for v in columns.values()}) > 1:
            raise ShapeMismatch("columns differ in length")
        return Frame(spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` {schema[c]}" for c in columns)))

    @staticmethod
    def empty(spark: SparkSession, n_rows: int) -> Frame:
        return Frame(spark.range(n_rows).withColumnRenamed("id", "row_no"), ["row_no"])

    @staticmethod
    def builder(spark: SparkSession) -> FrameBuilder:
        return FrameBuilder(spark)

    def _with(self, df: DataFrame) -> Frame:
        return Frame(df, [o for o in self.order_by if o in df.columns], [p for p in self.partition_by if p in df.columns])

    def n_rows(self) -> int:
        return self.df.count()

    def n_cols(self) -> int:
        return len(self.df.columns)

    def has_column(self, name: str) -> bool:
        return name in self.df.columns

    def column_names(self) -> list[str]:
        return self.df.columns

    def get(self, name: str) -> Column:
        """A numeric column as double."""
        require(self.df, name)
        if dict(self.df.dtypes)[name] not in _NUMERIC:
            raise VariableNotFound(f"{name} is not numeric")
        return col(name).cast("double")

    def get_column(self, name: str) -> DataFrame:
        require(self.df, name)
        return self.df.select(col(name))

    def _typed(self, name: str, *kinds: str) -> DataFrame:
        require(self.df, name)
        if not dict(self.df.dtypes)[name].startswith(kinds):
            raise VariableNotFound(f"{name} is not of type {kinds[0]}")
        return self.df.select(col(name))

    def get_bool(self, name: str) -> DataFrame:
        return self._typed(name, "boolean")

    def get_int(self, name: str) -> DataFrame:
        return self._typed(name, "bigint", "int", "smallint", "tinyint")

    def get_datetime(self, name: str) -> DataFrame:
        return self._typed(name, "timestamp", "date")

    def get_string(self, name: str) -> DataFrame:
        return self._typed(name, "string")

    def get_categorical(self, name: str) -> DataFrame:
        """Levels with their codes."""
        return self.encode(name)[1]

    def insert(self, name: str, value: Column) -> Frame:
        return self._with(self.df.withColumn(name, value))

    insert_column = insert

    def insert_categorical(self, name: str, value: Column) -> Frame:
        return self._with(self.df.withColumn(name, value.cast("string")))

    def info(self) -> str:
        return "\n".join([f"{len(self.df.columns)} columns", *[f"  {n}: {t}" for n, t in self.df.dtypes]])

    # projection, filter, missing data
    def drop(self, *names: str) -> Frame:
        require(self.df, *names)
        return self._with(self.df.drop(*names))

    def rename(self, names: Mapping[str, str]) -> Frame:
        require(self.df, *names)
        df = self.df.withColumnsRenamed(dict(names))
        return Frame(df, [names.get(o, o) for o in self.order_by], [names.get(p, p) for p in self.partition_by])

    def filter(self, predicate: Column | str) -> Frame:
        return self._with(self.df.where(predicate))

    def select(self, *names: str) -> Frame:
        require(self.df, *names)
        return self._with(self.df.select(*[col(n) for n in names]))

    def apply(self, func: Callable[[Column], Column]) -> Frame:
        """`func` on every numeric column."""
        kinds = dict(self.df.dtypes)
        return self._with(self.df.select(*[func(col(c).cast("double")).alias(c) if kinds[c] in _NUMERIC and c not in self.order_by else col(c) for c in self.df.columns]))

    def map_column(self, name: str, func: Callable) -> Frame:
        """`func` maps a Column, or (if it fails on one) a pandas Series batch by batch."""
        require(self.df, name)
        try:
            made = func(self.get(name))
            if not isinstance(made, Column):
                raise TypeError
        except TypeError:
            made = F.pandas_udf(lambda s: func(s), "double")(self.get(name))  # noqa: PLW0108
        return self._with(self.df.withColumn(name, made))

    def _missing(self, names: Sequence[str] | None = None) -> dict[str, Column]:
        return {c: is_missing(self.df, c) for c in (names or self.df.columns)}

    def dropna(self) -> Frame:
        return self._with(self.df.na.drop("any"))

    def dropna_subset(self, subset: Sequence[str]) -> Frame:
        require(self.df, *subset)
        return self._with(self.df.na.drop("any", subset=list(subset)))

    def dropna_all(self) -> Frame:
        return self._with(self.df.na.drop("all"))

    def _floats(self) -> list[str]:
        return [c for c, t in self.df.dtypes if t in ("double", "float")]

    def fillna(self, value: float) -> Frame:
        return self._with(self.df.na.fill(float(value), subset=self._floats()))

    def fillna_column(self, name: str, value: float) -> Frame:
        require(self.df, name)
        return self._with(self.df.na.fill({name: value}))

    def _fill_by(self, agg: Callable[[Column], Column]) -> Frame:
        names = self._floats()
        if not names:
            return self
        r = self.df.agg(*[agg(F.when(~is_missing(self.df, c), col(c))).alias(c) for c in names]).first()
        return self._with(self.df.na.fill({c: float(r[c]) for c in names if r[c] is not None}))

    def fillna_mean(self) -> Frame:
        return self._fill_by(F.avg)

    def fillna_median(self) -> Frame:
        names = self._floats()
        mid = {c: quantiles(self.df, col(c), [0.5])[0] for c in names}
        return self._with(self.df.na.fill({c: v for c, v in mid.items() if not math.isnan(v)})) if names else self

    def isna(self) -> Frame:
        return Frame(self.df.select(*[m.alias(c) for c, m in self._missing().items()]))

    def notna(self) -> Frame:
        return Frame(self.df.select(*[(~m).alias(c) for c, m in self._missing().items()]))

    def count_na(self) -> dict[str, int]:
        return self.df.agg(*[F.count_if(m).alias(c) for c, m in self._missing().items()]).first().asDict()

    def has_na(self) -> bool:
        return any(self.count_na().values())

    def winsorize(self, name: str, p: float) -> Frame:
        """Clip at the sorted values number floor(p n) and ceil((1-p) n) (from 0) of the finite ones."""
        if not 0 <= p < 0.5:
            raise InvalidOperation("p must be in [0, 0.5)")
        x = self.get(name)
        fin = F.when(~F.isnan(x) & (F.abs(x) != math.inf), x)
        n = self.df.agg(F.count(fin)).first()[0]
        if not n:
            return self
        lo, hi = order_statistics(self.df.select(fin.alias("v")).where("v is not null"), "v", [math.floor(p * n), min(math.ceil((1 - p) * n), n - 1)])
        return self._with(self.df.withColumn(name, F.when(fin.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).otherwise(x)))

    def encode(self, name: str) -> tuple[Frame, DataFrame]:
        """`{name}_code` by first appearance in the order (by value if unordered), and the (level, code) table."""
        require(self.df, name)
        out = f"{name}_code"
        first = F.min(F.struct(*[col(o) for o in self.order_by])) if self.order_by else F.min(col(name))
        levels = self.df.where(col(name).isNotNull()).groupBy(col(name).alias("level")).agg(first.alias("_first"))
        table = Ordered(levels, ["_first"]).rows().select("level", F.col("_pos").cast("double").alias("code"))
        joined = self.df.join(table.withColumnRenamed("code", out), col(name) == F.col("level"), "left").drop("level")
        return self._with(joined), table

    def generate_dummies(self, name: str, prefix: str, max_levels: int = 1000) -> Frame:
        require(self.df, name)
        levels = sorted(r[0] for r in self.df.where(col(name).isNotNull()).select(col(name)).distinct().limit(max_levels + 1).collect())
        if len(levels) > max_levels:
            raise InvalidOperation(f"{name} has over {max_levels} levels")
        return self._with(self.df.select("*", *[F.when(col(name) == F.lit(v), 1.0).otherwise(0.0).alias(f"{prefix}_{v}") for v in levels]))

    # joins and sets
    def merge(self, other: Frame, on: str | Sequence[str], how: str = "inner") -> Frame:
        on = [on] if isinstance(on, str) else list(on)
        if how not in ("inner", "left", "right", "outer", "semi", "anti"):
            raise InvalidOperation(f"unknown join {how!r}")
        require(self.df, *on)
        require(other.df, *on)
        if both := (set(self.df.columns) & set(other.df.columns)) - set(on):
            raise ShapeMismatch(f"columns on both sides: {sorted(both)}")
        return self._with(self.df.join(other.df, on, {"outer": "full"}.get(how, how)))

    def concat(self, other: Frame) -> Frame:
        if dict(self.df.dtypes) != dict(other.df.dtypes):
            raise ShapeMismatch("frames differ in columns or types")
        return self._with(self.df.unionByName(other.df))

    def append_row(self, row: Mapping[str, object]) -> Frame:
        if set(row) != set(self.df.columns):
            raise ShapeMismatch("the row must have exactly the frame's columns")
        one = self.df.sparkSession.createDataFrame([tuple(row[c] for c in self.df.columns)], self.df.schema)
        return self._with(self.df.unionByName(one))

    def drop_duplicates(self, name: str) -> Frame:
        """The first row per value of `name` in the order; a partial aggregate, no window."""
        require(self.df, name)
        row = F.struct(*[col(c) for c in self.df.columns])
        key = F.struct(*[col(o) for o in (self.order_by or self.df.columns)])
        x = self.df.groupBy(col(name).alias("_key")).agg(F.min_by(row, key).alias("_row"))
        return self._with(x.select(*[F.col("_row").getField(c).alias(c) for c in self.df.columns]))

    # aggregates
    def _each(self, agg: Callable[[Column], Column], skip_nan: bool = False) -> dict[str, float]:
        names = [c for c, t in self.df.dtypes if t in _NUMERIC]
        r = self.df.agg(*[agg(F.when(~F.isnan(self.get(c)), self.get(c)) if skip_nan else self.get(c)).alias(c) for c in names]).first()
        return {c: math.nan if r[c] is None else float(r[c]) for c in names}

    def mean(self) -> dict[str, float]:
        return self._each(F.avg)

    def sum(self) -> dict[str, float]:
        return self._each(F.sum)

    def min(self) -> dict[str, float]:
        return self._each(F.min, True)

    def max(self) -> dict[str, float]:
        return self._each(F.max, True)

    def std(self) -> dict[str, float]:
        return self._each(F.stddev_samp)

    def var(self) -> dict[str, float]:
        return self._each(F.var_samp)

    def median(self) -> dict[str, float]:
        return {c: quantiles(self.df, self.get(c), [0.5])[0] for c, t in self.df.dtypes if t in _NUMERIC}

    def quantile(self, name: str, q: float) -> float:
        if not 0 <= q <= 1:
            raise InvalidOperation("q must be in [0, 1]")
        return quantiles(self.df, self.get(name), [q])[0]

    def describe(self) -> DataFrame:
        """One row per numeric column: count, mean, std, min, median, max; one job and the selection of the medians."""
        names = [c for c, t in self.df.dtypes if t in _NUMERIC]
        long = self.df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), self.get(c).alias("v")) for c in names])).alias("x")).select("x.*")
        ok = F.when(~F.isnan("v"), F.col("v"))
        mid = self.df.sparkSession.createDataFrame(list(self.median().items()), "column_name string, median double")
        return long.groupBy("column_name").agg(F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min(ok).alias("min"), F.max(ok).alias("max")).join(mid, "column_name").select("column_name", "count", "mean", "std", "min", "median", "max")

    def _second(self, names: Sequence[str] | None) -> tuple[list[str], np.ndarray, int]:
        names = list(names or [c for c, t in self.df.dtypes if t in _NUMERIC])
        g = gram(self.df, {c: self.get(c) for c in names})
        return names, g.centred, g.n

    def cov(self, names: Sequence[str] | None = None) -> tuple[list[str], np.ndarray]:
        names, s, n = self._second(names)
        return names, s / (n - 1) if n > 1 else np.full_like(s, math.nan)

    def corr(self, names: Sequence[str] | None = None) -> tuple[list[str], np.ndarray]:
        """Pearson correlations; 0 where a variance is 0, 1 on the diagonal."""
        names, s, _ = self._second(names)
        d = np.sqrt(np.diag(s))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.where(np.outer(d, d) > 0, s / np.outer(d, d), 0.0)
        np.fill_diagonal(r, 1.0)
        return names, r

    def groupby(self, by: str | Sequence[str], value: str, agg: str) -> Frame:
        by = [by] if isinstance(by, str) else list(by)
        require(self.df, *by, value)
        if agg not in _AGGS:
            raise InvalidOperation(f"unknown aggregate {agg!r}")
        return Frame(self.df.groupBy(*[col(b) for b in by]).agg(_AGGS[agg](col(value)).alias(f"{value}_{agg}")), by)

    def pivot_table(self, index: str, columns: str, values: str, agg: str = "mean", max_columns: int = 1000) -> Frame:
        require(self.df, index, columns, values)
        if agg not in _AGGS:
            raise InvalidOperation(f"unknown aggregate {agg!r}")
        heads = sorted(r[0] for r in self.df.where(col(columns).isNotNull()).select(col(columns)).distinct().limit(max_columns + 1).collect())
        if len(heads) > max_columns:
            raise InvalidOperation(f"{columns} has over {max_columns} values")
        out = self.df.groupBy(col(index)).pivot(columns, heads).agg(_AGGS[agg](col(values)))
        return Frame(out.withColumnsRenamed({str(h): f"{columns}_{h}" for h in heads}), [index])

    def melt(self, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> Frame:
        require(self.df, *id_vars, *(value_vars or []))
        values = list(value_vars or [c for c in self.df.columns if c not in id_vars])
        typed = self.df.select(*[col(c) for c in id_vars], *[self.get(c).alias(c) for c in values])
        return Frame(typed.unpivot([col(c) for c in id_vars], [col(c) for c in values], var_name, value_name))

    # ordered operators
    def ordered(self) -> Ordered:
        if not self.order_by:
            raise InvalidOperation("this frame has no order")
        return Ordered(self.df, self.order_by, self.partition_by)

    def _ordered(self, make: Callable[[Ordered], DataFrame]) -> Frame:
        o = self.ordered()
        out = make(o)
        return self._with(out.drop(o.pos))

    def fillna_ffill(self, name: str) -> Frame:
        return self._ordered(lambda o: o.ffill(name))

    def fillna_bfill(self, name: str) -> Frame:
        return self._ordered(lambda o: o.bfill(name))

    def rolling(self, name: str, window: int, func: str) -> Frame:
        return self._ordered(lambda o: o.rolling(name, window, func))

    def cumsum(self, name: str) -> Frame:
        return self._ordered(lambda o: o.cumsum(name))

    def cumprod(self, name: str) -> Frame:
        return self._ordered(lambda o: o.cumprod(name))

    def cummax(self, name: str) -> Frame:
        return self._ordered(lambda o: o.cummax(name))

    def cummin(self, name: str) -> Frame:
        return self._ordered(lambda o: o.cummin(name))

    def shift(self, name: str, periods: int) -> Frame:
        return self._ordered(lambda o: o.shift(name, periods))

    def lag(self, name: str, periods: int = 1) -> Frame:
        return self._ordered(lambda o: o.lag(name, periods))

    def lead(self, name: str, periods: int = 1) -> Frame:
        return self._ordered(lambda o: o.lead(name, periods))

    def diff(self, name: str, periods: int = 1) -> Frame:
        return self._ordered(lambda o: o.diff(name, periods))

    def pct_change(self, name: str, periods: int = 1) -> Frame:
        return self._ordered(lambda o: o.pct_change(name, periods))

    def interpolate(self, name: str) -> Frame:
        return self._ordered(lambda o: o.interpolate(name))

    def rank(self, name: str, ascending: bool = True) -> Frame:
        """Ordinal rank from 1; ties in the frame's order."""
        require(self.df, name)
        key = col(name).asc_nulls_last() if ascending else col(name).desc_nulls_last()
        return self._with(Ordered(self.df, [key, *self.order_by], self.partition_by).rank(name))

    def sort_by(self, name: str, ascending: bool = True) -> Frame:
        require(self.df, name)
        return Frame(self.df.orderBy(col(name).asc_nulls_last() if ascending else col(name).desc_nulls_first(), *[col(o) for o in self.order_by]), [name, *self.order_by])

    def head(self, n: int) -> Frame:
        return self._with(self.df.orderBy(*[col(o) for o in self.order_by]).limit(n))

    def tail(self, n: int) -> Frame:
        return self._with(self.df.orderBy(*[col(o).desc() for o in self.order_by]).limit(n))

    def _positions(self, indices: Sequence[int]) -> tuple[Ordered, DataFrame]:
        o = Ordered(self.df, self.order_by or self.df.columns)
        return o, self.df.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(indices)], f"{o.pos} long, _at int")

    def drop_rows(self, indices: Sequence[int]) -> Frame:
        o, wanted = self._positions(indices)
        return self._with(o.rows().join(wanted, o.pos, "left_anti").drop(o.pos))

    def iloc(self, rows: Sequence[int] | None = None, cols: Sequence[int] | None = None) -> Frame:
        """Rows (repeatable, in the given order: `row_at`) and columns by position."""
        names = self.df.columns if cols is None else [self.df.columns[i] for i in cols]
        if rows is None:
            return self.select(*names)
        o, wanted = self._positions(rows)
        out = o.rows().join(wanted, o.pos).select(*[col(c) for c in names], F.col("_at").alias("row_at"))
        if rows and max(rows) >= self.n_rows():
            raise InvalidOperation("row position out of range")
        return Frame(out, ["row_at"])

    def sample(self, n: int, seed: int = 0) -> Frame:
        """`n` rows without replacement: the rows with the least seeded hashes of their whole content, top-k per task."""
        if n > self.n_rows():
            raise InvalidOperation("more rows wanted than there are")
        return self._with(self.df.orderBy(F.xxhash64(*[col(c) for c in self.df.columns], F.lit(seed)), *[col(c) for c in self.order_by]).limit(n))

    # formulas
    def formula_var_names(self, formula: Formula | str) -> list[str]:
        return (Formula.parse(formula) if isinstance(formula, str) else formula).names(self.df)

    def to_design_matrix(self, formula: Formula | str) -> DataFrame:
        y, x = (Formula.parse(formula) if isinstance(formula, str) else formula).design(self.df)
        return self.df.select(y.alias("y"), *[e.alias(n) for n, e in x.items()])


class FrameBuilder:
    """Typed columns from Python sequences."""

    def __init__(self, spark: SparkSession):
        self.spark, self.columns, self.kinds = spark, {}, {}

    def add_typed_column(self, name: str, values: Sequence, kind: str) -> FrameBuilder:
        self.columns[name], self.kinds[name] = list(values), kind
        return self

    def add_column(self, name: str, values: Sequence[float]) -> FrameBuilder:
        return self.add_typed_column(name, [float(v) for v in values], "double")

    add_column_array = add_column

    def add_categorical(self, name: str, values: Sequence[str]) -> FrameBuilder:
        return self.add_typed_column(name, values, "string")

    add_string = add_categorical

    def add_bool(self, name: str, values: Sequence[bool]) -> FrameBuilder:
        return self.add_typed_column(name, values, "boolean")

    def add_int(self, name: str, values: Sequence[int]) -> FrameBuilder:
        return self.add_typed_column(name, values, "bigint")

    def add_datetime(self, name: str, values: Sequence) -> FrameBuilder:
        return self.add_typed_column(name, values, "timestamp_ntz")

    def build(self) -> Frame:
        return Frame.from_columns(self.spark, self.columns, self.kinds)


def order_statistics(df: DataFrame, name: str, positions: Sequence[int]) -> list[float]:
    """Exact sorted values at positions from 0."""
    return select_ranks(df, col(name), positions)


__all__ = ["Frame", "FrameBuilder", "order_statistics"]

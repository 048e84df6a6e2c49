"""Operations on ordered rows without a single-task window.

Rows are range-partitioned and sorted by (partition_by, order_by) once; every key's rows are then
cut into blocks of `block_rows` consecutive rows. Shifts and rolling windows see the last or first rows of the
neighbouring block (a halo); running values add the carry of earlier blocks by a prefix scan. A key with a
third of all rows is thus spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.plans.scan import carry_before, prefix_sum
from gramforge.util import checkpoint, col, free_name, join_on, require


class Ordered:
    """A frame in a total order: `order_by` columns (ties broken by all other columns of simple type)."""

    def __init__(self, df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str] = (), block_rows: int = 1 << 16):
        require(df, *partition_by, *[o for o in order_by if isinstance(o, str)])
        if block_rows < 1:
            raise InvalidOperation("block_rows must be positive")
        self.keys, self.block_rows = list(partition_by), block_rows
        self.source = df.columns
        names = df.columns
        self.pos, self.block, self._pid, self._one = (free_name(x, names) for x in ("_pos", "_block", "_pid", "_one"))
        order = [col(o) if isinstance(o, str) else o for o in order_by]
        used = {o for o in order_by if isinstance(o, str)} | set(partition_by)
        ties = [col(n) for n, t in df.dtypes if n not in used and not t.startswith(("map", "variant"))]
        x = df.orderBy(*[col(k) for k in self.keys], *order, *ties)
        # One key column stands in where there is none, so that scans have a key.
        if not self.keys:
            x = x.withColumn(self._one, F.lit(0))
            self.keys = [self._one]
        x = checkpoint(x.withColumn(self._pid, F.spark_partition_id().cast("long")).withColumn(self.pos, F.monotonically_increasing_id()))
        size, before = free_name("_size", x.columns), free_name("_before", x.columns)
        shards = x.groupBy(*self._key_cols(), col(self._pid)).agg(F.count(F.lit(1)).alias(size))
        shards = prefix_sum(shards, self.keys, self._pid, [size], [before]).select(*self._key_cols(), self._pid, before)
        here = Window.partitionBy(*self._key_cols(), col(self._pid)).orderBy(self.pos)
        self.df = self._join(x.withColumn(self.pos, F.row_number().over(here) - 1), shards, [self._pid]).withColumn(self.pos, col(self.pos) + col(before)).drop(before, self._pid)

    def _key_cols(self) -> list[Column]:
        return [col(k) for k in self.keys]

    def _join(self, left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        return join_on(left, right, [*self.keys, *on])

    def rows(self) -> DataFrame:
        """Source columns and the position in the key, from 0."""
        return self.df.select(*[col(c) for c in self.source], col(self.pos))

    def _blocks(self, size: int) -> DataFrame:
        return self.df.withColumn(self.block, F.floor(col(self.pos) / F.lit(size)))

    def with_neighbours(self, before: int, after: int, make: Callable[[object], dict[str, Column]]) -> DataFrame:
        """Adds window expressions that look at most `before` rows back and `after` rows ahead.

        make gets the WindowSpec (ordered, without a frame).
        """
        size = max(self.block_rows, before, after, 1)
        x = self._blocks(size)
        halo = free_name("_halo", x.columns)
        at = col(self.pos) % size
        copies = [F.struct(col(self.block).alias("b"), F.lit(False).alias("h"))]
        if before:
            copies.append(F.when(at >= size - before, F.struct((col(self.block) + 1).alias("b"), F.lit(True).alias("h"))))
        if after:
            copies.append(F.when((at < after) & (col(self.block) > 0), F.struct((col(self.block) - 1).alias("b"), F.lit(True).alias("h"))))
        x = x.withColumn(halo, F.explode(F.array_compact(F.array(*copies))))
        x = x.withColumn(self.block, col(halo)["b"])
        w = Window.partitionBy(*self._key_cols(), col(self.block)).orderBy(col(self.pos))
        made = make(w)
        x = x.select("*", *[e.alias(n) for n, e in made.items()]).where(~col(halo)["h"])
        return x.select(*[col(c) for c in self.source], col(self.pos), *[col(n) for n in made])

    def shift(self, column: str, periods: int, out: str | None = None) -> DataFrame:
        """The value `periods` rows earlier (later if negative); NULL at the edges."""
        return self.with_neighbours(max(periods, 0), max(-periods, 0), lambda w: {out or f"{column}_shift_{periods}": F.lag(col(column), periods).over(w)})

    def lag(self, column: str, periods: int = 1) -> DataFrame:
        return self.shift(column, periods, f"{column}_lag_{periods}")

    def lead(self, column: str, periods: int = 1) -> DataFrame:
        return self.shift(column, -periods, f"{column}_lead_{periods}")

    def diff(self, column: str, periods: int = 1) -> DataFrame:
        return self.with_neighbours(periods, 0, lambda w: {f"{column}_diff_{periods}": col(column) - F.lag(col(column), periods).over(w)})

    def pct_change(self, column: str, periods: int = 1) -> DataFrame:
        def make(w):
            p = F.lag(col(column), periods).over(w)
            return {f"{column}_pct_{periods}": F.when(p != 0, (col(column) - p) / p)}

        return self.with_neighbours(periods, 0, make)

    def rolling(self, column: str, window: int, func: str) -> DataFrame:
        """mean, sum, min, max or std (population) of the last `window` rows; NULL for the first window - 1."""
        agg = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}
        if func not in agg or window < 1:
            raise InvalidOperation(f"rolling {func} over {window}")
        frame = lambda w: w.rowsBetween(-(window - 1), 0)
        return self.with_neighbours(window - 1, 0, lambda w: {f"{column}_rolling_{func}": F.when(col(self.pos) >= window - 1, agg[func](col(column)).over(frame(w)))})

    def _running(self, columns: Sequence[str], suffix: str, agg: Callable, combine: Callable[[Column, Column], Column]) -> DataFrame:
        """Running aggregates: inside blocks by a window, over blocks by a scan of block aggregates; any number of columns in one pass."""
        x = self._blocks(self.block_rows)
        outs = [f"{c}_{suffix}" for c in columns]
        taken = [*x.columns, *outs]
        tot, run, carry = ([free_name(f"{n}{i}", taken) for i in range(len(columns))] for n in ("_tot", "_run", "_carry"))
        here = Window.partitionBy(*self._key_cols(), col(self.block)).orderBy(self.pos).rowsBetween(Window.unboundedPreceding, 0)
        tots = x.groupBy(*self._key_cols(), col(self.block)).agg(*[agg(col(c)).alias(t) for c, t in zip(columns, tot, strict=True)])
        tots = carry_before(tots, self.keys, self.block, tot, carry, agg, agg, combine)
        x = self._join(x.select("*", *[agg(col(c)).over(here).alias(r) for c, r in zip(columns, run, strict=True)]), tots, [self.block])
        made = [F.when(col(c).isNull(), col(r)).when(col(r).isNull(), col(c)).otherwise(combine(col(c), col(r))).alias(o) for c, r, o in zip(carry, run, outs, strict=True)]
        return x.select(*[col(c) for c in self.source], col(self.pos), *made)

    def cumsum(self, *columns: str) -> DataFrame:
        return self._running(columns, "cumsum", F.sum, lambda a, b: a + b)

    def cumprod(self, *columns: str) -> DataFrame:
        return self._running(columns, "cumprod", F.product, lambda a, b: a * b)

    def cummax(self, *columns: str) -> DataFrame:
        return self._running(columns, "cummax", F.max, lambda a, b: F.greatest(a, b))

    def cummin(self, *columns: str) -> DataFrame:
        return self._running(columns, "cummin", F.min, lambda a, b: F.least(a, b))

    def _edge(self, x: DataFrame, column: str, forward: bool, out: str) -> DataFrame:
        """Nearest given (position, value) at or before (forward) or at or after each row."""
        c = col(column)
        kind = dict(x.dtypes)[column]
        given = c.isNotNull() & (~F.isnan(c) if kind in ("double", "float") else F.lit(True))
        seen = F.when(given, F.struct(col(self.pos).alias("p"), c.alias("v")))
        carry, end, key = (free_name(n, [*x.columns, out]) for n in ("_carry", "_end", "_order"))
        # Backwards in descending order: a frame that grows is one pass, one that shrinks would be read again for every row.
        w = Window.partitionBy(*self._key_cols(), col(self.block)).orderBy(col(self.pos) if forward else col(self.pos).desc())
        near = F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        ends = x.where(given).groupBy(*self._key_cols(), col(self.block)).agg((F.max if forward else F.min)(F.struct(col(self.pos).alias("p"), c.alias("v"))).alias(end))
        ends = ends.withColumn(key, col(self.block) if forward else -col(self.block))
        # Blocks without any given value have no summary; every block looks up the nearest earlier one.
        every = x.select(*self._key_cols(), col(self.block)).distinct()
        every = self._join(every, ends.select(*self._key_cols(), col(self.block), end), [self.block]).withColumn(key, col(self.block) if forward else -col(self.block))
        # Nearest in block order is the greatest position, or the least one backwards.
        far = F.max if forward else F.min
        carried = carry_before(every, self.keys, key, [end], [carry], far, far, F.greatest if forward else F.least)
        every = carried.withColumn(self.block, col(key) if forward else -col(key)).drop(key)
        x = self._join(x.withColumn(out, near), every, [self.block])
        return x.withColumn(out, F.coalesce(col(out), col(carry))).drop(carry)

    def ffill(self, column: str) -> DataFrame:
        """`column` with missing values replaced by the last given one."""
        return self._filled(column, lambda a, b: a["v"], True, False)

    def bfill(self, column: str) -> DataFrame:
        return self._filled(column, lambda a, b: b["v"], False, True)

    def interpolate(self, column: str) -> DataFrame:
        """`column` linear by position between given neighbours; leading and trailing gaps stay missing."""

        def between(a: Column, b: Column) -> Column:
            return F.when(a["p"] == b["p"], a["v"].cast("double")).when(a.isNotNull() & b.isNotNull(), a["v"] + (b["v"] - a["v"]) * (col(self.pos) - a["p"]) / (b["p"] - a["p"]))

        return self._filled(column, between, True, True)

    def _filled(self, column: str, value: Callable[[Column, Column], Column], back: bool, ahead: bool) -> DataFrame:
        x = self._blocks(self.block_rows)
        a, b = free_name("_a", x.columns), free_name("_b", x.columns)
        if back:
            x = self._edge(x, column, True, a)
        if ahead:
            x = self._edge(x, column, False, b)
        v = value(col(a) if back else F.lit(None), col(b) if ahead else F.lit(None))
        return x.select(*[col(c) if c != column else v.alias(c) for c in self.source], col(self.pos))

    def rank(self, column: str = "") -> DataFrame:
        """Ordinal rank in the order, from 1, ties broken by the order itself."""
        return self.df.select(*[col(c) for c in self.source], (col(self.pos) + 1).alias(f"{column}_rank"))

    def head(self, n: int) -> DataFrame:
        return self.df.where(col(self.pos) < n).select(*[col(c) for c in self.source])

    def tail(self, n: int) -> DataFrame:
        size = free_name("_n", self.df.columns)
        counts = self.df.groupBy(*self._key_cols()).agg(F.count(F.lit(1)).alias(size))
        return self._join(self.df, counts, []).where(col(self.pos) >= col(size) - n).select(*[col(c) for c in self.source])


"""Prefix scans over summaries of shards, in levels, so that no task sees a whole key.

A running value over the rows of one key is computed from per-shard summaries:
shards are grouped in super-shards of `fan` shards, each level is scanned inside
its group, and the carry of the level above is added. A key with a third of all
rows is thus spread over many tasks at every level but the top one, which holds
rows / (shard size * fan) summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.util import col, free_name, join_on


def carry_last(summary: DataFrame, keys: Sequence[str], shard: str, value: str, out: str, fan: int = 4096) -> DataFrame:
    """Adds `out`: `value` of the nearest earlier shard of the same key, NULL for the first.

    summary: one row per key and non-empty shard; `shard` is integral; `value` is never NULL.
    """
    sup, last, base = (free_name(x, [*summary.columns, out]) for x in ("_super", "_last", "_base"))
    k = [col(x) for x in keys]
    s = summary.withColumn(sup, F.floor(col(shard) / F.lit(fan)))
    inner = Window.partitionBy(*k, col(sup)).orderBy(col(shard))
    tops = s.groupBy(*k, col(sup)).agg(F.max_by(col(value), col(shard)).alias(last))
    tops = tops.select(*k, col(sup), F.lag(col(last)).over(Window.partitionBy(*k).orderBy(col(sup))).alias(base))
    on = [*keys, sup]
    return (
        join_on(s.withColumn(out, F.lag(col(value)).over(inner)), tops, on)
        .withColumn(out, F.coalesce(col(out), col(base)))
        .select(*[col(c) for c in summary.columns], col(out))
    )


def prefix_sum(summary: DataFrame, keys: Sequence[str], shard: str, values: Sequence[str], outs: Sequence[str], fan: int = 4096) -> DataFrame:
    """Adds for each of `values` its sum over all earlier shards of the same key (0 for the first)."""
    sup = free_name("_super", [*summary.columns, *outs])
    k = [col(x) for x in keys]
    s = summary.withColumn(sup, F.floor(col(shard) / F.lit(fan)))
    inner = Window.partitionBy(*k, col(sup)).orderBy(col(shard)).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*k).orderBy(col(sup)).rowsBetween(Window.unboundedPreceding, -1)

    def before(c: Column, w) -> Column:
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    tots = [free_name(f"_tot{i}", [*summary.columns, *outs]) for i in range(len(values))]
    tops = s.groupBy(*k, col(sup)).agg(*[F.sum(col(v)).alias(t) for v, t in zip(values, tots, strict=True)])
    tops = tops.select(*k, col(sup), *[before(col(t), outer).alias(t) for t in tots])
    x = s.select("*", *[before(col(v), inner).alias(o) for v, o in zip(values, outs, strict=True)])
    return join_on(x, tops, [*keys, sup]).select(
        *[col(c) for c in summary.columns], *[(col(o) + F.coalesce(col(t), F.lit(0))).alias(o) for o, t in zip(outs, tots, strict=True)]
    )


def carry_before(summary: DataFrame, keys: Sequence[str], shard: str, values: Sequence[str], outs: Sequence[str], over: Callable[[Column], Column], whole: Callable[[Column], Column], combine: Callable[[Column, Column], Column], fan: int = 1024) -> DataFrame:
    """(keys, shard, outs): each of `values` aggregated over all earlier shards of its key, NULL before the first.

    over: the aggregate over a window in shard order; whole: the same over a group of shards, in any order; combine joins an earlier and a later part.
    """
    sup = free_name("_super", [*summary.columns, *outs])
    tots = [free_name(f"_tot{i}", [*summary.columns, *outs]) for i in range(len(values))]
    k = [col(x) for x in keys]
    s = summary.withColumn(sup, F.floor(col(shard) / F.lit(fan)))
    inner = Window.partitionBy(*k, col(sup)).orderBy(col(shard)).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*k).orderBy(col(sup)).rowsBetween(Window.unboundedPreceding, -1)
    tops = s.groupBy(*k, col(sup)).agg(*[whole(col(v)).alias(t) for v, t in zip(values, tots, strict=True)])
    tops = tops.select(*k, col(sup), *[over(col(t)).over(outer).alias(t) for t in tots])
    x = join_on(s.select(*k, col(sup), col(shard), *[over(col(v)).over(inner).alias(o) for v, o in zip(values, outs, strict=True)]), tops, [*keys, sup])
    made = [F.when(col(t).isNull(), col(o)).when(col(o).isNull(), col(t)).otherwise(combine(col(t), col(o))).alias(o) for o, t in zip(outs, tots, strict=True)]
    return x.select(*k, col(shard), *made)

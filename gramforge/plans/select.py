"""Exact order statistics without a sort: counts per bin narrow the range around a rank until few values are left.

Every pass is one aggregate with at most `BINS` groups, whatever the number of rows; a bin's own least and greatest value
bound the next pass, so heavy tails and ties cost no more passes than smooth columns. The last values, at most `FEW`, are collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, FEW = 4096, 10_000


def select_ranks(df: DataFrame, value: Column, ranks: Sequence[int]) -> list[float]:
    """Values at `ranks` (from 0) of the sorted non-NULL, non-NaN values of `value`; NaN for ranks beyond them."""
    v = value.cast("double")
    x = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    head = x.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    known: dict[int, float] = {}
    return [known.setdefault(r, _one(x, r, head["lo"], head["hi"], head["n"])) if 0 <= r < head["n"] else math.nan for r in ranks]


def _one(x: DataFrame, rank: int, lo: float, hi: float, n: int) -> float:
    part = x
    while lo < hi:
        part = x.where(F.col("v").between(lo, hi))
        if n <= FEW:
            return sorted(r[0] for r in part.collect())[rank]
        # Ends are bins of their own, so that infinite or very far values do not stretch the others' bins to nothing.
        if math.isinf(lo) or math.isinf(hi):
            b = F.when(F.col("v") == lo, -1).when(F.col("v") == hi, BINS).otherwise(0)
        else:
            b = F.least(F.floor((F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS), F.lit(BINS - 1))
        for r in sorted(part.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["b"]):
            if rank < r["c"]:
                lo, hi, n = r["lo"], r["hi"], r["c"]
                break
            rank -= r["c"]
    return lo


def quantiles(df: DataFrame, value: Column, qs: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between ranks; NaN without values."""
    v = value.cast("double")
    n = df.where(v.isNotNull() & ~F.isnan(v)).count()
    at = [q * (n - 1) for q in qs]
    wanted = sorted({int(f(a)) for a in at for f in (math.floor, math.ceil)}) if n else []
    got = dict(zip(wanted, select_ranks(df, value, wanted), strict=True))
    return [math.nan if not n else got[math.floor(a)] + (got[math.ceil(a)] - got[math.floor(a)]) * (a - math.floor(a)) if a != math.floor(a) else got[int(a)] for a in at]

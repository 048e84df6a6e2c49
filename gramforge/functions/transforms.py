"""Scalar and row-wise functions as Column expressions, with IEEE results where Spark gives NULL or an error."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.operators.ordered import Ordered
from gramforge.util import col, require

INF, NAN = math.inf, math.nan


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x > 0, f(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def _guard(x: Column, ok: Column, value: Column) -> Column:
    return F.when(ok, value).when(x.isNotNull(), F.lit(NAN))


def sign(x: Column) -> Column:
    """1 for 0 and above, -1 below, NaN stays."""
    return F.when(F.isnan(x), x).when(x >= 0, 1.0).when(x < 0, -1.0)


def round_digits(x: Column, digits: Column) -> Column:
    p = F.pow(F.lit(10.0), digits)
    return sign(x) * F.floor(F.abs(x) * p + 0.5) / p


def factorial(x: Column) -> Column:
    return F.factorial(x.cast("int")).cast("double")


def normal_density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _series(f: Callable, kinds: int) -> Callable[..., Column]:
    def one(a: pd.Series) -> pd.Series:
        return a.map(f)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([f(x, y, z) for x, y, z in zip(a, b, c, strict=True)], dtype=float)

    body = (one, two, three)[kinds - 1]
    # Made when first used: a pandas UDF needs no session before.
    return lambda *cols: F.pandas_udf(body, "double")(*[c.cast("double") for c in cols])


inv_normal = _series(dist.norm_ppf, 1)
t_tail = _series(lambda df, x: dist.t_sf(x, df), 2)
inv_t_tail = _series(lambda df, p: dist.t_ppf(1 - p, df), 2)
chi2_tail = _series(lambda df, x: dist.chi2_sf(x, df), 2)
f_tail = _series(lambda d1, d2, x: dist.f_sf(x, d1, d2), 3)


def comb(n: Column, k: Column) -> Column:
    """Binomial coefficient; 0 where k is above n or below 0."""
    top = F.least(k, n - k).cast("long")
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(top, F.lit(1)))
    value = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - top + i) / i)
    return F.when((k > n) | (k < 0), 0.0).when(top == 0, 1.0).otherwise(F.round(value))


def binomial_pmf(n: Column, k: Column, p: Column) -> Column:
    return comb(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)


def mod(x: Column, m: Column) -> Column:
    """Remainder that is never negative; NaN for m = 0."""
    return _guard(x, m != 0, F.pmod(x, F.when(m != 0, F.abs(m)))) if isinstance(m, Column) else F.pmod(x, F.lit(abs(m)))


def _pick(pick: Callable[..., Column], *cols: Column) -> Column:
    c = [F.when(~F.isnan(x), x) for x in cols]
    return F.coalesce(pick(*c), F.lit(NAN))


UNARY: dict[str, Callable[[Column], Column]] = {
    "log": _log(F.ln), "ln": _log(F.ln), "log2": _log(F.log2), "log10": _log(F.log10),
    "exp": F.exp, "sqrt": lambda x: _guard(x, x >= 0, F.sqrt(x)), "abs": F.abs,
    "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "round": lambda x: round_digits(x, F.lit(0)),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sign": sign, "signum": sign, "factorial": factorial, "normal": normal_density, "normalden": normal_density, "invnormal": inv_normal, "qnorm": inv_normal,
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "round": round_digits, "pow": F.pow, "atan2": F.atan2, "mod": mod, "fmod": mod,
    "max": lambda a, b: _pick(F.greatest, a, b), "min": lambda a, b: _pick(F.least, a, b), "comb": comb,
    "ttail": t_tail, "invttail": inv_t_tail, "chi2tail": chi2_tail,
}
TERNARY: dict[str, Callable[[Column, Column, Column], Column]] = {"cond": lambda c, a, b: F.when(c != 0, a).otherwise(b), "Ftail": f_tail, "binomial": binomial_pmf}


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def _rowwise(cols: Sequence[Column], value: Column) -> Column:
    ok = None
    for c in cols:
        ok = _finite(c) if ok is None else ok & _finite(c)
    return F.when(ok, value).otherwise(F.lit(NAN))


def _plus(cols: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + c
    return out


def row_sum(*cols: Column) -> Column:
    return _rowwise(cols, _plus(cols))


def row_mean(*cols: Column) -> Column:
    return _rowwise(cols, _plus(cols) / len(cols))


def row_min(*cols: Column) -> Column:
    return _rowwise(cols, F.least(*cols) if len(cols) > 1 else cols[0])


def row_max(*cols: Column) -> Column:
    return _rowwise(cols, F.greatest(*cols) if len(cols) > 1 else cols[0])


def row_total(*cols: Column) -> Column:
    return _plus([F.when(_finite(c), c).otherwise(0.0) for c in cols])


def row_miss(*cols: Column) -> Column:
    return _plus([F.when(_finite(c), 0.0).otherwise(1.0) for c in cols])


def uniform(seed: int) -> Column:
    return F.rand(seed)


def rnormal(mean: float, sd: float, seed: int) -> Column:
    return F.randn(seed) * sd + mean


def rbernoulli(p: float, seed: int) -> Column:
    return F.when(F.rand(seed) < p, 1.0).otherwise(0.0)


def regexm(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


def regexra(x: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(x, pattern, to)


def regexr(x: Column, pattern: str, to: str) -> Column:
    """Replace the first match only."""
    return F.when(x.rlike(pattern), F.regexp_replace(x, f"(?s)^(.*?)(?:{pattern})", "$1" + to)).otherwise(x)


def regexs(x: Column, pattern: str) -> Column:
    """First group of the first match, the whole match where the pattern has no group."""
    grouped = "(" in pattern.replace("\\(", "").replace("(?:", "")
    return F.regexp_extract(x, pattern, 1 if grouped else 0)


# whole-column functions
def standardize(df: DataFrame, name: str, out: str) -> DataFrame:
    """(x - mean) / sd; NaN where the sd is not above 1e-15."""
    require(df, name)
    r = df.agg(F.avg(col(name)).alias("m"), F.stddev_samp(col(name)).alias("s")).first()
    ok = r["s"] is not None and r["s"] > 1e-15
    return df.withColumn(out, (col(name) - r["m"]) / r["s"] if ok else F.lit(NAN))


def average_rank(df: DataFrame, name: str, out: str) -> DataFrame:
    """Rank from 1 with ties averaged: counts per value, then a running sum over the sorted values."""
    require(df, name)
    v = col(name)
    counts = df.where(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = Ordered(counts, ["_v"]).cumsum("_c").select("_v", (F.col("_c_cumsum") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(run, v == F.col("_v"), "left").drop("_v")


def group_ids(df: DataFrame, name: str, out: str) -> DataFrame:
    """1-based number of the row's value among the sorted distinct values."""
    require(df, name)
    levels = df.where(col(name).isNotNull()).select(col(name).alias("_v")).distinct()
    ids = Ordered(levels, ["_v"]).rows().select("_v", (F.col("_pos") + 1).alias(out))
    return df.join(ids, col(name) == F.col("_v"), "left").drop("_v")


def iqr(df: DataFrame, name: str) -> float:
    """Nearest-rank quartile distance."""
    from gramforge.frame import order_statistics

    n = df.agg(F.count(col(name))).first()[0]
    if not n:
        return NAN
    lo, hi = order_statistics(df.where(col(name).isNotNull()), name, [min(n - 1, n // 4), min(n - 1, 3 * n // 4)])
    return hi - lo



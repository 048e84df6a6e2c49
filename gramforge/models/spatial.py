"""Spatial regressions with the weights as an edge table (i, j, w)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.models.results import Fit
from gramforge.plans.moments import gram
from gramforge.util import checkpoint, col


def spatial_lag(df: DataFrame, edges: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Adds w_{name} = sum_j w_ij name_j (0 without neighbours): one join on j and one aggregate on i."""
    src = df.select(col(key).alias("j"), *[col(c).cast("double").alias(f"v{n}") for n, c in enumerate(names)])
    s = edges.join(src, "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(f"v{n}")).alias(f"w_{c}") for n, c in enumerate(names)])
    return df.join(s, col(key) == F.col("i"), "left").drop("i").na.fill(0.0, [f"w_{c}" for c in names])


def _eigenvalues(df: DataFrame, edges: DataFrame, key: str, max_units: int) -> np.ndarray:
    units = [r[0] for r in df.select(col(key)).distinct().orderBy(col(key)).limit(max_units + 1).collect()]
    if len(units) > max_units:
        raise InvalidOperation(f"the log-determinant needs the eigenvalues of W: over {max_units} units")
    at = {u: i for i, u in enumerate(units)}
    w = np.zeros((len(units), len(units)))
    # At most max_units squared pairs once repeated edges are added up.
    for r in edges.groupBy("i", "j").agg(F.sum("w").alias("w")).collect():
        w[at[r["i"]], at[r["j"]]] += r["w"]
    return np.linalg.eigvals(w)


def _search(f, lo: float = -0.99, hi: float = 0.99) -> float:
    grid = np.linspace(lo, hi, 199)
    i = int(np.argmax([f(r) for r in grid]))
    a, b = grid[max(i - 1, 0)], grid[min(i + 1, 198)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if f(c) > f(d) else (c, b)
    return (a + b) / 2


def sar(df: DataFrame, edges: DataFrame, key: str, y: str, x: Sequence[str], *, durbin: bool = False, max_units: int = 3000) -> Fit:
    """y = rho W y + x b (+ W x g) + e by the concentrated likelihood: all moments come from one Gram."""
    d = checkpoint(spatial_lag(df, edges, key, [y, *x]))
    ev = _eigenvalues(df, edges, key, max_units)
    reg = {"const": F.lit(1.0)} | {c: col(c) for c in x} | ({f"w_{c}": F.col(f"w_{c}") for c in x} if durbin else {})
    names = list(reg)
    g = gram(d, reg | {"__y": col(y), "__wy": F.col(f"w_{y}")})
    a = np.linalg.inv(g.pick(names, names))
    m = g.pick(["__y", "__wy"], ["__y", "__wy"]) - g.pick(["__y", "__wy"], names) @ a @ g.pick(names, ["__y", "__wy"])

    def ll(rho: float) -> float:
        v = np.array([1, -rho])
        return float(np.log(np.abs(1 - rho * ev)).sum() - g.n / 2 * math.log(v @ m @ v / g.n))

    rho = _search(ll)
    v = np.array([1, -rho])
    s2 = float(v @ m @ v / g.n)
    beta = a @ g.pick(names, ["__y", "__wy"]) @ v
    return Fit(names, beta, s2 * a, math.inf, {"n": g.n, "rho": rho, "sigma2": s2, "log_likelihood": ll(rho) - g.n / 2 * (math.log(2 * math.pi) + 1)}, list(reg.values()))


def spatial_durbin(df: DataFrame, edges: DataFrame, key: str, y: str, x: Sequence[str], **kwargs) -> Fit:
    return sar(df, edges, key, y, x, durbin=True, **kwargs)


def sem(df: DataFrame, edges: DataFrame, key: str, y: str, x: Sequence[str], *, max_units: int = 3000) -> Fit:
    """y = x b + u, u = lambda W u + e: generalised least squares on spatially filtered columns from one Gram of levels and lags."""
    d = checkpoint(spatial_lag(df.withColumn("__one", F.lit(1.0)), edges, key, [y, "__one", *x]))
    ev = _eigenvalues(df, edges, key, max_units)
    names = ["__one", *x, y]
    g = gram(d, {c: col(c) for c in names} | {f"w_{c}": F.col(f"w_{c}") for c in names})
    k = len(names)

    def at(lam: float):
        t = np.vstack([np.eye(k), -lam * np.eye(k)])
        q = t.T @ g.raw @ t
        b = np.linalg.solve(q[:-1, :-1], q[:-1, -1])
        return b, float(q[-1, -1] - b @ q[:-1, -1]) / g.n, q

    def ll(lam: float) -> float:
        return float(np.log(np.abs(1 - lam * ev)).sum() - g.n / 2 * math.log(at(lam)[1]))

    lam = _search(ll)
    b, s2, q = at(lam)
    return Fit(["const", *x], b, s2 * np.linalg.inv(q[:-1, :-1]), math.inf, {"n": g.n, "lambda": lam, "sigma2": s2, "log_likelihood": ll(lam) - g.n / 2 * (math.log(2 * math.pi) + 1)}, [F.lit(1.0), *[col(c) for c in x]])


def morans_i(df: DataFrame, edges: DataFrame, key: str, name: str) -> float:
    m = df.agg(F.avg(col(name))).first()[0]
    d = spatial_lag(df.select(col(key), (col(name) - m).alias("z")), edges, key, ["z"])
    r = d.agg(F.sum(F.col("z") * F.col("w_z")), F.sum(F.col("z") * F.col("z")), F.count(F.lit(1))).first()
    return float(r[2] / edges.agg(F.sum("w")).first()[0] * r[0] / r[1])


def spatial_panel(df: DataFrame, edges: DataFrame, key: str, time: str, y: str, x: Sequence[str], *, durbin: bool = False, max_units: int = 3000) -> Fit:
    """Spatial lag panel with unit effects: lags are taken within each period, then all columns are demeaned by unit; one Gram."""
    names = [y, *x]
    src = df.select(col(key).alias("j"), col(time).alias("__t"), *[col(c).cast("double").alias(f"v{n}") for n, c in enumerate(names)])
    s = edges.join(src, "j").groupBy("i", "__t").agg(*[F.sum(F.col("w") * F.col(f"v{n}")).alias(f"w_{c}") for n, c in enumerate(names)])
    d = df.join(s, (col(key) == F.col("i")) & (col(time) == F.col("__t")), "left").na.fill(0.0, [f"w_{c}" for c in names])
    every = [*names, *[f"w_{c}" for c in names]]
    d = d.select(col(key), *[col(c).cast("double").alias(c) for c in every])
    means = d.groupBy(col(key)).agg(*[F.avg(col(c)).alias(f"m_{c}") for c in every])
    d = checkpoint(d.join(means, key).select(*[(col(c) - col(f"m_{c}")).alias(c) for c in every]))
    ev = _eigenvalues(df.select(col(key)).distinct(), edges, key, max_units)
    reg = {c: col(c) for c in x} | ({f"w_{c}": col(f"w_{c}") for c in x} if durbin else {})
    k = list(reg)
    g = gram(d, reg | {"__y": col(y), "__wy": col(f"w_{y}")})
    a = np.linalg.inv(g.pick(k, k))
    m = g.pick(["__y", "__wy"], ["__y", "__wy"]) - g.pick(["__y", "__wy"], k) @ a @ g.pick(k, ["__y", "__wy"])
    periods = g.n / len(ev)

    def ll(rho: float) -> float:
        v = np.array([1, -rho])
        return float(periods * np.log(np.abs(1 - rho * ev)).sum() - g.n / 2 * math.log(v @ m @ v / g.n))

    rho = _search(ll)
    v = np.array([1, -rho])
    s2 = float(v @ m @ v / (g.n - len(ev)))
    return Fit(k, a @ g.pick(k, ["__y", "__wy"]) @ v, s2 * a, math.inf, {"n": g.n, "rho": rho, "sigma2": s2}, list(reg.values()))

"""Multivariate statistics from one Gram matrix, and kernel methods against bounded grids."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import InvalidOperation
from gramforge.operators.ordered import Ordered
from gramforge.plans.moments import gram, linear
from gramforge.plans.select import quantiles
from gramforge.util import checkpoint, col


@dataclass
class PCA:
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def fit(df: DataFrame, names: Sequence[str], components: int | None = None) -> PCA:
        """Of the correlation matrix; every component's largest loading is positive."""
        g = gram(df, {c: col(c) for c in names})
        sd = np.sqrt(np.diag(g.centred) / (g.n - 1))
        sd[sd == 0] = 1.0
        val, vec = np.linalg.eigh(g.centred / (g.n - 1) / np.outer(sd, sd))
        val, vec = val[::-1], vec[:, ::-1]
        vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(vec.shape[1])])
        return PCA(list(names), g.mean, sd, val, vec[:, : components or len(names)])

    def explained(self) -> np.ndarray:
        return self.values / self.values.sum()

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        z = [(col(c) - float(m)) / float(s) for c, m, s in zip(self.names, self.mean, self.scale, strict=True)]
        return df.select("*", *[linear(self.vectors[:, j], z).alias(f"{prefix}{j + 1}") for j in range(self.vectors.shape[1])])

    def inverse_transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        pcs = [F.col(f"{prefix}{j + 1}") for j in range(self.vectors.shape[1])]
        return df.select("*", *[(linear(self.vectors[i], pcs) * float(self.scale[i]) + float(self.mean[i])).alias(f"{c}_restored") for i, c in enumerate(self.names)])

    def biplot(self, scaling: float = 0.5) -> np.ndarray:
        """Variable coordinates; scaling 0 form, 1 covariance, 0.5 symmetric."""
        return self.vectors * np.sqrt(np.clip(self.values[: self.vectors.shape[1]], 0, None)) ** (2 * scaling)


def varimax(a: np.ndarray, iters: int = 200) -> np.ndarray:
    r, d = np.eye(a.shape[1]), 0.0
    for _ in range(iters):
        b = a @ r
        u, s, v = np.linalg.svd(a.T @ (b**3 - b * (b**2).mean(axis=0)))
        r = u @ v
        if s.sum() < d * (1 + 1e-10):
            break
        d = s.sum()
    return a @ r


def factor_analysis(df: DataFrame, names: Sequence[str], factors: int, *, rotate: bool = False, iters: int = 200) -> dict[str, np.ndarray]:
    """Principal axis factoring of the correlation matrix."""
    g = gram(df, {c: col(c) for c in names}).centred
    d = np.sqrt(np.diag(g))
    r = g / np.outer(d, d)
    h = 1 - 1 / np.diag(np.linalg.pinv(r))
    for _ in range(iters):
        m = r.copy()
        np.fill_diagonal(m, h)
        val, vec = np.linalg.eigh(m)
        load = vec[:, ::-1][:, :factors] * np.sqrt(np.clip(val[::-1][:factors], 0, None))
        new = (load**2).sum(axis=1)
        if np.abs(new - h).max() < 1e-8:
            break
        h = np.clip(new, 0, 1)
    load = varimax(load) if rotate else load
    return {"loadings": load, "communalities": h, "uniqueness": 1 - h}


def manova(df: DataFrame, names: Sequence[str], group: str) -> dict[str, float]:
    """Wilks, Pillai, Hotelling-Lawley and Roy from within and total cross products; the groups are reduced in Spark."""
    k = len(names)
    means = df.agg(*[F.avg(col(c)) for c in names]).first()
    z = [col(c).cast("double") - float(m) for c, m in zip(names, means, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    g = df.groupBy(col(group)).agg(F.count(F.lit(1)).alias("n"), *[F.sum(z[i]).alias(f"s{i}") for i in range(k)], *[F.sum(z[i] * z[j]).alias(f"q{i}_{j}") for i, j in pairs])
    r = g.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), *[F.sum(f"q{i}_{j}").alias(f"t{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"b{i}_{j}") for i, j in pairs]).first()
    t, h = np.zeros((k, k)), np.zeros((k, k))
    for i, j in pairs:
        t[i, j] = t[j, i] = r[f"t{i}_{j}"]
        h[i, j] = h[j, i] = r[f"b{i}_{j}"]
    e = t - h
    ev = np.clip(np.real(np.linalg.eigvals(np.linalg.solve(e, h))), 0, None)
    wilks = float(np.prod(1 / (1 + ev)))
    q = r["g"] - 1
    stat = -(r["n"] - 1 - (k + r["g"]) / 2) * math.log(wilks)
    return {"wilks": wilks, "pillai": float((ev / (1 + ev)).sum()), "hotelling": float(ev.sum()), "roy": float(ev.max()), "chi2": stat, "p": dist.chi2_sf(stat, k * q)}


def canonical_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    g = gram(df, {c: col(c) for c in [*left, *right]}).centred
    p = len(left)
    la, lb = np.linalg.cholesky(g[:p, :p]), np.linalg.cholesky(g[p:, p:])
    return np.linalg.svd(np.linalg.solve(la, g[:p, p:]) @ np.linalg.inv(lb).T, compute_uv=False)


_KERNELS = {"gaussian": lambda u: F.exp(-0.5 * u * u) / math.sqrt(2 * math.pi), "epanechnikov": lambda u: F.when(F.abs(u) < 1, 0.75 * (1 - u * u)).otherwise(0.0), "uniform": lambda u: F.when(F.abs(u) < 1, 0.5).otherwise(0.0), "triangular": lambda u: F.when(F.abs(u) < 1, 1 - F.abs(u)).otherwise(0.0)}


def silverman(df: DataFrame, name: str) -> float:
    r = df.agg(F.count(col(name)).alias("n"), F.stddev_samp(col(name)).alias("s")).first()
    lo, hi = quantiles(df, col(name), (0.25, 0.75))
    iqr = (hi - lo) / 1.34
    return 0.9 * (min(r["s"], iqr) if iqr > 0 else r["s"]) * r["n"] ** -0.2


def kde(df: DataFrame, name: str, points: int = 512, kernel: str = "gaussian", bandwidth: float | None = None) -> DataFrame:
    """Density on a regular grid. Values are first counted in bins an eighth of a grid step (or bandwidth) wide with linear weights, so
    the sum runs over bins x points whatever the number of rows; the binning error is of second order in the bin width."""
    h = silverman(df, name) if bandwidth is None else bandwidth
    lo, hi, n = df.agg(F.min(col(name)), F.max(col(name)), F.count(col(name))).first()
    a, b = lo - 3 * h, hi + 3 * h
    step = min((b - a) / (points - 1), h) / 8
    cell = F.floor((col(name) - a) / step)
    part = (col(name) - a) / step - cell
    w = df.where(col(name).isNotNull()).select(F.explode(F.array(F.struct(cell.alias("c"), (1 - part).alias("w")), F.struct((cell + 1).alias("c"), part.alias("w")))).alias("x")).groupBy("x.c").agg(F.sum("x.w").alias("w"))
    grid = df.sparkSession.createDataFrame([(i, a + (b - a) * i / (points - 1)) for i in range(points)], "i int, x double")
    # Every bin reaches only the grid points within the kernel's support (8 bandwidths for the Gaussian).
    reach = (8.0 if kernel == "gaussian" else 1.0) * h
    gs = (b - a) / (points - 1)
    at = F.lit(a) + F.col("c") * step
    hit = w.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((at - reach - a) / gs)).cast("int"), F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor((at + reach - a) / gs))).cast("int"))))
    return hit.join(grid, "i").groupBy("x").agg((F.sum(F.col("w") * _KERNELS[kernel]((F.col("x") - at) / h)) / (n * h)).alias("density"))


def kernel_regression(df: DataFrame, y: str, x: str, points: Sequence[float], bandwidth: float, kernel: str = "gaussian", *, local_linear: bool = False) -> DataFrame:
    """Nadaraya-Watson (or local linear) at given points: all points' sums in one aggregate."""
    if len(points) > 2000:
        raise InvalidOperation("over 2000 points")
    pts = F.array(*[F.lit(float(p)) for p in points])
    z = df.select(col(y).cast("double").alias("y"), F.posexplode(F.transform(pts, lambda p: (col(x) - p))).alias("i", "d"))
    w = _KERNELS[kernel](F.col("d") / bandwidth)
    r = z.groupBy("i").agg(F.sum(w).alias("s0"), F.sum(w * F.col("d")).alias("s1"), F.sum(w * F.col("d") * F.col("d")).alias("s2"), F.sum(w * F.col("y")).alias("t0"), F.sum(w * F.col("d") * F.col("y")).alias("t1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    fit = F.when(det > 0, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det) if local_linear else F.when(F.col("s0") > 0, F.col("t0") / F.col("s0"))
    slope = F.when(det > 0, (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / det)
    return r.select(F.element_at(pts, F.col("i") + 1).alias("x"), fit.alias("fitted"), *([slope.alias("slope")] if local_linear else []))


def isotonic(df: DataFrame, y: str, x: str, weight: str | None = None, max_points: int = 5_000_000) -> DataFrame:
    """Non-decreasing least squares: rows are averaged per x in Spark, pools are merged on chunks and then on their results.

    Pool-adjacent-violators may be run on consecutive chunks first: pools of a chunk are pools of points of the whole.
    """
    w = col(weight).cast("double") if weight else F.lit(1.0)
    pts = df.groupBy(col(x).alias("x")).agg(F.sum(w).alias("w"), (F.sum(w * col(y)) / F.sum(w)).alias("m"))
    o = Ordered(pts, ["x"], block_rows=1 << 15)
    b = o._blocks(o.block_rows)

    def pool(pdf):
        pdf = pdf.sort_values("x")
        st: list[list[float]] = []
        for lo, hi, ww, m in zip(pdf["x"], pdf["hi"], pdf["w"], pdf["m"], strict=True):
            cur = [lo, hi, ww, m]
            while st and st[-1][3] >= cur[3]:
                p = st.pop()
                tw = p[2] + cur[2]
                cur = [p[0], cur[1], tw, (p[2] * p[3] + cur[2] * cur[3]) / tw]
            st.append(cur)
        return pd.DataFrame(st, columns=["x", "hi", "w", "m"])

    kind = dict(pts.dtypes)["x"]
    schema = f"x {kind}, hi {kind}, w double, m double"
    first = checkpoint(b.select(col(o.block).alias("b"), "x", F.col("x").alias("hi"), "w", "m").groupBy("b").applyInPandas(lambda p: pool(p.drop(columns="b")), schema))
    if first.count() > max_points:
        raise InvalidOperation(f"over {max_points} pools")
    pools = first.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda p: pool(p.drop(columns="one")), schema)
    return pools.select(F.col("x").alias("x_low"), F.col("hi").alias("x_high"), F.col("m").alias("fitted"), F.col("w").alias("weight"))


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 2 / 3, robust: int = 3) -> np.ndarray:
    """Tricube local linear smoother with bisquare reweighting (a kernel for one bounded series)."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    n, span = len(x), max(2, math.ceil(frac * len(x)))
    rw, fit = np.ones(n), np.zeros(n)
    for _ in range(robust + 1):
        for i in range(n):
            lo = int(np.clip(np.searchsorted(xs, xs[i]) - span // 2, 0, n - span))
            while lo + span < n and xs[i] - xs[lo] > xs[lo + span] - xs[i]:
                lo += 1
            while lo > 0 and xs[i] - xs[lo - 1] < xs[lo + span - 1] - xs[i]:
                lo -= 1
            s = slice(lo, lo + span)
            h = max(np.abs(xs[s] - xs[i]).max(), 1e-12)
            w = np.clip(1 - (np.abs(xs[s] - xs[i]) / h) ** 3, 0, None) ** 3 * rw[s]
            sw = w.sum()
            m = (w * xs[s]).sum() / sw
            v = (w * (xs[s] - m) ** 2).sum()
            fit[i] = (w * ys[s]).sum() / sw + ((w * (xs[s] - m) * ys[s]).sum() / v * (xs[i] - m) if v > 1e-15 else 0)
        r = np.abs(ys - fit)
        c = 6 * np.median(r)
        if c <= 0:
            break
        rw = np.clip(1 - (r / c) ** 2, 0, None) ** 2
    out = np.empty(n)
    out[order] = fit
    return out


def copula(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Gaussian, Clayton, Gumbel and Frank parameters from ranks: the first by normal scores, the others by inverting Kendall's
    tau = 2/pi asin(rho)."""
    from gramforge.functions.transforms import average_rank

    x = average_rank(average_rank(df.where(col(a).isNotNull() & col(b).isNotNull()), a, "__ra"), b, "__rb")
    n = x.count()
    score = F.pandas_udf(lambda s: s.map(dist.norm_ppf), "double")
    g = gram(x.select(score(F.col("__ra") / (n + 1)).alias("u"), score(F.col("__rb") / (n + 1)).alias("v")), {"u": F.col("u"), "v": F.col("v")}).centred
    rho = float(g[0, 1] / math.sqrt(g[0, 0] * g[1, 1]))
    tau = 2 / math.pi * math.asin(rho)
    out = {"gaussian": rho, "tau": tau, "clayton": 2 * tau / (1 - tau) if tau > 0 else math.nan, "gumbel": 1 / (1 - tau) if tau > 0 else math.nan}
    lo, hi = 1e-6, 100.0

    def frank(t: float) -> float:
        s = np.linspace(1e-9, t, 2001)
        return 1 - 4 / t * (1 - np.trapezoid(s / np.expm1(s), s) / t)

    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if frank(mid) < abs(tau) else (lo, mid)
    return out | {"frank": math.copysign(lo, tau)}

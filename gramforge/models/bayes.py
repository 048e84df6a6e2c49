"""Bayesian regression, mixed models and Bayesian VAR from Gram matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.formula import Formula
from gramforge.models.results import Fit
from gramforge.models.timeseries import lagged
from gramforge.plans.moments import gram
from gramforge.util import checkpoint, col


def bayesian_linear(df: DataFrame, formula: str, *, prior_mean: Sequence[float] | None = None, prior_precision: float = 1e-3, a0: float = 1e-3, b0: float = 1e-3) -> Fit:
    """Conjugate normal-inverse-gamma posterior; the covariance is that of the marginal t."""
    y, x = Formula.parse(formula).design(df)
    names = list(x)
    g = gram(df, x | {"__y": y})
    xx, xy, yy = g.pick(names, names), g.pick(names, ["__y"])[:, 0], g.pick(["__y"], ["__y"])[0, 0]
    m0 = np.zeros(len(names)) if prior_mean is None else np.asarray(prior_mean, float)
    l0 = prior_precision * np.eye(len(names))
    ln = xx + l0
    mn = np.linalg.solve(ln, xy + l0 @ m0)
    an, bn = a0 + g.n / 2, b0 + 0.5 * (yy + m0 @ l0 @ m0 - mn @ ln @ mn)
    ev = 0.5 * (np.linalg.slogdet(l0)[1] - np.linalg.slogdet(ln)[1]) + a0 * math.log(b0) - an * math.log(bn) + math.lgamma(an) - math.lgamma(a0) - g.n / 2 * math.log(2 * math.pi)
    return Fit(names, mn, bn / an * np.linalg.inv(ln), 2 * an, {"n": g.n, "log_evidence": float(ev), "sigma2": bn / (an - 1)}, list(x.values()))


def bvar(df: DataFrame, names: Sequence[str], lags: int, order_by: Sequence[str], *, tightness: float = 0.1, cross: float = 0.2, decay: float = 1.0) -> np.ndarray:
    """Minnesota prior added to the lag Gram: own first lags shrink to 1, the rest to 0; rows lags x variables, columns equations."""
    d = lagged(df, names, lags, order_by)
    xs = [f"{c}__l{p}" for p in range(1, lags + 1) for c in names]
    g = gram(d, {c: col(c) for c in [*xs, *names]})
    sd = np.sqrt(np.diag(g.centred)[-len(names) :] / g.n)
    out = np.zeros((len(xs), len(names)))
    for e, c in enumerate(names):
        var, mean = np.empty(len(xs)), np.zeros(len(xs))
        for i, (p, v) in enumerate([(p, v) for p in range(1, lags + 1) for v in range(len(names))]):
            var[i] = (tightness / p**decay) ** 2 if v == e else (tightness * cross * sd[e] / sd[v] / p**decay) ** 2
            mean[i] = 1.0 if v == e and p == 1 else 0.0
        prec = np.diag(sd[e] ** 2 / var)
        out[:, e] = np.linalg.solve(g.pick(xs, xs) + prec, g.pick(xs, [c])[:, 0] + prec @ mean)
    return out


def mixed_lm(df: DataFrame, formula: str, group: str, *, tol: float = 1e-8, max_iter: int = 200) -> Fit:
    """Random intercepts by EM: groups enter through their sums, so every step is a two-level aggregate over group sums made once."""
    y, x = Formula.parse(formula).design(df)
    k = len(x)
    z = df.select(col(group).alias("g"), *[e.cast("double").alias(f"z{i}") for i, e in enumerate([*x.values(), y])])
    g = checkpoint(z.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(k + 1)]))
    total = gram(df, x | {"__y": y}).raw
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    n = int(round(g.agg(F.sum("n")).first()[0]))
    groups = g.count()
    yy = total[k, k]
    b = np.linalg.solve(total[:k, :k], total[:k, k])
    se2 = float(yy - b @ total[:k, k]) / n
    su2 = se2 / 2
    for _ in range(max_iter):
        w = F.lit(su2) / (F.lit(se2) + F.col("n") * su2)
        r = g.agg(*[F.sum(w * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
        m = np.zeros((k + 1, k + 1))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        a = total - m
        nb = np.linalg.solve(a[:k, :k], a[:k, k])
        res = F.col(f"s{k}")
        for i in range(k):
            res = res - F.lit(float(nb[i])) * F.col(f"s{i}")
        u, v = w * res, F.lit(su2 * se2) / (F.lit(se2) + F.col("n") * su2)
        q = g.agg(F.sum(u * u + v).alias("u"), F.sum(F.col("n") * (u * u + v) - 2 * u * res).alias("e")).first()
        rss = float(yy - 2 * nb @ total[:k, k] + nb @ total[:k, :k] @ nb)
        ns, ne = q["u"] / groups, (rss + q["e"]) / n
        done = np.max(np.abs(nb - b)) <= tol * (1 + np.max(np.abs(b))) and abs(ns - su2) <= tol * 10 * (su2 + 1e-12) and abs(ne - se2) <= tol * 10 * se2
        b, su2, se2 = nb, float(ns), float(ne)
        if done:
            break
    return Fit(list(x), b, se2 * np.linalg.inv(a[:k, :k]), math.inf, {"n": n, "groups": groups, "sigma_e2": se2, "sigma_u2": su2}, list(x.values()))


def favar(df: DataFrame, observed: Sequence[str], panel: Sequence[str], factors: int, lags: int, order_by: Sequence[str]):
    """Principal components of the panel, then a VAR of components and observed series."""
    from gramforge.models.multivariate import PCA
    from gramforge.models.timeseries import VAR

    x = PCA.fit(df, panel, factors).transform(df, "factor")
    return VAR(x, [*[f"factor{i + 1}" for i in range(factors)], *observed], lags, order_by)

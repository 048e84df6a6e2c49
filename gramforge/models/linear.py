"""Linear regression and its relatives: one Gram pass, one pass for robust covariances, a k x k solve on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import InvalidOperation, OptimizationFailed, ShapeMismatch
from gramforge.formula import Formula
from gramforge.models.results import Fit
from gramforge.operators.ordered import Ordered
from gramforge.plans.mle import batch_sums
from gramforge.plans.moments import gram, independent_columns, inverse_spd, linear, materialise, outer_sum, quadratic, solve_spd
from gramforge.plans.select import quantiles
from gramforge.util import checkpoint, col

LEVERAGE_TOP = 0.9999


@dataclass(frozen=True)
class Cov:
    """kind: nonrobust, HC1, HC2, HC3, HC4, newey_west (lags, order_by), cluster (clusters: one or two columns)."""

    kind: str = "nonrobust"
    lags: int = 0
    order_by: Sequence[str] = ()
    clusters: Sequence[str] = ()


def _scores(df: DataFrame, x: Sequence[Column], u: Column, keep: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in keep], *[(e * u).alias(f"s{i}") for i, e in enumerate(x)])


def _cluster_meat(scores: DataFrame, keys: Sequence[str], k: int) -> tuple[np.ndarray, int]:
    g = scores.groupBy(*[col(c) for c in keys]).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    r = g.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
    return m, int(r["g"])


def sandwich(df: DataFrame, x: Sequence[Column], u: Column, bread: np.ndarray, n: int, cov: Cov, weight: Column | None = None) -> np.ndarray:
    """Covariance of coefficients with scores x u (times weight) and the given bread."""
    k = len(x)
    score = u if weight is None else u * weight
    if cov.kind in ("HC0", "HC1", "HC2", "HC3", "HC4"):
        w = score * score
        if cov.kind in ("HC2", "HC3", "HC4"):
            h = quadratic(bread, x) * (F.lit(1.0) if weight is None else weight)
            free = F.when(h < LEVERAGE_TOP, 1 - h).otherwise(1.0)
            power = {"HC2": F.lit(1.0), "HC3": F.lit(2.0), "HC4": F.least(F.lit(4.0), h * (n / k))}[cov.kind]
            w = w / F.pow(free, power)
        v = bread @ outer_sum(df, x, w) @ bread
        return v * n / (n - k) if cov.kind == "HC1" else v
    if cov.kind == "newey_west":
        s = _scores(df, x, score, cov.order_by)
        o = Ordered(s, list(cov.order_by))
        lagged = o.with_neighbours(cov.lags, 0, lambda w: {f"l{lag}_{i}": F.coalesce(F.lag(F.col(f"s{i}"), lag).over(w), F.lit(0.0)) for lag in range(1, cov.lags + 1) for i in range(k)})
        names = [(lag, i, j) for lag in range(cov.lags + 1) for i in range(k) for j in range(k)]
        r = lagged.agg(*[F.sum(F.col(f"s{i}") * F.col(f"l{lag}_{j}" if lag else f"s{j}")).alias(f"m{lag}_{i}_{j}") for lag, i, j in names]).first()
        meat = np.zeros((k, k))
        for lag in range(cov.lags + 1):
            m = np.array([[r[f"m{lag}_{i}_{j}"] for j in range(k)] for i in range(k)])
            meat += m if lag == 0 else (1 - lag / (cov.lags + 1)) * (m + m.T)
        return bread @ meat @ bread * n / (n - k)
    if cov.kind == "cluster":
        s = _scores(df, x, score, cov.clusters)
        if len(cov.clusters) == 1:
            m, g = _cluster_meat(s, cov.clusters, k)
            scale = g / (g - 1) * (n - 1) / (n - k)
        elif len(cov.clusters) == 2:
            a, b = cov.clusters
            parts = [_cluster_meat(s, keys, k) for keys in ([a], [b], [a, b])]
            m = parts[0][0] + parts[1][0] - parts[2][0]
            g = min(parts[0][1], parts[1][1])
            scale = g / (g - 1) * (n - 1) / (n - k)
        else:
            raise InvalidOperation("one or two cluster columns")
        return bread @ m @ bread * scale
    raise InvalidOperation(f"unknown covariance {cov.kind!r}")


def fit_columns(df: DataFrame, y: Column, x: dict[str, Column], cov: Cov = Cov(), *, weight: Column | None = None, normal: bool = False, drop_collinear: bool = False) -> Fit:  # noqa: B008
    """Least squares of `y` on named columns; weights are treated as precision weights."""
    g = gram(df, x | {"__y": y}, weight)
    names = list(x)
    if drop_collinear:
        names = [names[i] for i in independent_columns(g.pick(names, names))]
    k, n = len(names), g.n
    if n <= k:
        raise ShapeMismatch(f"{n} rows for {k} columns")
    const = next((c for c in names if c == "const"), None)
    rest = [c for c in names if c != const]
    at = {c: i for i, c in enumerate(g.names)}
    if const:
        s = g.centred
        idx = [at[c] for c in rest]
        b = solve_spd(s[np.ix_(idx, idx)], s[idx, at["__y"]]) if rest else np.zeros(0)
        a = g.mean[at["__y"]] - g.mean[idx] @ b
        beta = np.array([a if c == const else b[rest.index(c)] for c in names])
        ssr = float(s[at["__y"], at["__y"]] - (b @ s[idx, at["__y"]] if rest else 0))
        sst = float(s[at["__y"], at["__y"]])
    else:
        xx, xy = g.pick(names, names), g.pick(names, ["__y"])[:, 0]
        beta = solve_spd(xx, xy)
        yy = g.pick(["__y"], ["__y"])[0, 0]
        ssr, sst = float(yy - beta @ xy), float(yy)
    ssr = max(ssr, 0.0)
    exprs = [x[c].cast("double") for c in names]
    bread = inverse_spd(g.pick(names, names))
    s2 = ssr / (n - k)
    v = s2 * bread if cov.kind == "nonrobust" else sandwich(df, exprs, y.cast("double") - linear(beta, exprs), bread, n, cov, weight)
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(max(ssr / n, 1e-300)) + 1)
    m = k - 1 if const else k
    r2 = 1 - ssr / sst if sst > 1e-12 else 0.0
    f = (sst - ssr) / m / s2 if m and s2 > 0 else math.nan
    stats = {"n": n, "df_resid": n - k, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - (1 if const else 0)) / (n - k), "sigma": math.sqrt(s2), "ssr": ssr, "f_statistic": f, "f_p_value": dist.f_sf(f, m, n - k) if m else math.nan, "log_likelihood": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(n) - 2 * ll}
    return Fit(names, beta, v, math.inf if normal else n - k, stats, exprs)


def ols(df: DataFrame, formula: str, cov: Cov = Cov(), **kwargs) -> Fit:  # noqa: B008
    y, x = Formula.parse(formula).design(df)
    return fit_columns(df, y, x, cov, **kwargs)


def wls(df: DataFrame, formula: str, weights: str, cov: Cov = Cov(), **kwargs) -> Fit:  # noqa: B008
    y, x = Formula.parse(formula).design(df)
    return fit_columns(df, y, x, cov, weight=col(weights), **kwargs)


def influence(df: DataFrame, formula: str) -> DataFrame:
    """Rows of `df` with fitted, residual, leverage, student_internal, student_external, cooks_d, dffits and dfbetas_<term> per term."""
    y, x = Formula.parse(formula).design(df)
    fit = fit_columns(df, y, x)
    n, k, s2 = fit.stats["n"], len(fit.names), fit.stats["sigma"] ** 2
    bread = fit.cov / s2
    h, e = quadratic(bread, fit.exprs), y - fit.predictor()
    d = df.withColumn("fitted", fit.predictor()).withColumn("residual", e).withColumn("leverage", h)
    free, e, h = 1 - F.col("leverage"), F.col("residual"), F.col("leverage")
    d = d.withColumn("student_internal", F.when(free > 1e-12, e / F.sqrt(free * s2)))
    s2i = (F.lit(s2 * (n - k)) - e * e / free) / (n - k - 1)
    d = d.withColumn("student_external", F.when((free > 1e-12) & (s2i > 0), e / F.sqrt(free * s2i)))
    d = d.withColumn("cooks_d", F.when(free > 1e-12, e * e * h / (k * s2 * free * free)))
    d = d.withColumn("dffits", F.col("student_external") * F.sqrt(h / free))
    # The change of a coefficient without the row, in errors estimated without it.
    share = [linear(bread[j], fit.exprs) / math.sqrt(bread[j, j]) for j in range(k)]
    return d.select("*", *[(F.col("student_external") * s / F.sqrt(1 - F.col("leverage"))).alias(f"dfbetas_{c}") for c, s in zip(fit.names, share, strict=True)])


def influence_thresholds(n: int, k: int) -> dict[str, float]:
    """Usual marks above which a row counts as influential, for n rows and k terms."""
    return {"leverage": 2 * k / n, "cooks_d": 4 / n, "dffits": 2 * math.sqrt(k / n), "dfbetas": 2 / math.sqrt(n)}


def iv(df: DataFrame, y: Column, x: dict[str, Column], z: dict[str, Column], cov: Cov = Cov()) -> Fit:  # noqa: B008
    """Two-stage least squares; `z` are all instruments (exogenous regressors included). Adds sargan and dwh statistics."""
    if len(z) < len(x):
        raise ShapeMismatch("fewer instruments than regressors")
    both = {f"x:{k}": v for k, v in x.items()} | {f"z:{k}": v for k, v in z.items()} | {"y": y}
    g = gram(df, both)
    xn, zn = [f"x:{k}" for k in x], [f"z:{k}" for k in z]
    zz, zx, zy = g.pick(zn, zn), g.pick(zn, xn), g.pick(zn, ["y"])[:, 0]
    pi = solve_spd(zz, zx)
    a = zx.T @ pi
    beta = solve_spd((a + a.T) / 2, pi.T @ zy)
    n, k = g.n, len(x)
    xe, ze = [e.cast("double") for e in x.values()], [e.cast("double") for e in z.values()]
    xx, xy, yy = g.pick(xn, xn), g.pick(xn, ["y"])[:, 0], g.pick(["y"], ["y"])[0, 0]
    ssr = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    bread = inverse_spd((a + a.T) / 2)
    u = y.cast("double") - linear(beta, xe)
    if cov.kind == "nonrobust":
        v = ssr / (n - k) * bread
    else:
        names = {f"h{i}": linear(pi[:, i], ze) for i in range(k)}
        hat = df.select("*", *[e.alias(f"__{c}") for c, e in names.items()])
        v = sandwich(hat, [F.col(f"__{c}") for c in names], u, bread, n, cov)
    zu = zy - zx @ beta
    sargan = float(n * zu @ solve_spd(zz, zu) / ssr) if len(z) > k else 0.0
    over = len(z) - k
    stats = {"n": n, "df_resid": n - k, "ssr": ssr, "sigma": math.sqrt(ssr / (n - k)), "r_squared": 1 - ssr / float(g.centred[-1, -1]), "sargan": sargan, "sargan_p": dist.chi2_sf(sargan, over) if over else math.nan}
    return Fit(list(x), beta, v, n - k, stats, xe)


def first_stage_f(df: DataFrame, endogenous: Column, exogenous: dict[str, Column], excluded: dict[str, Column]) -> float:
    """F of the excluded instruments in the first stage."""
    full, short = fit_columns(df, endogenous, exogenous | excluded), fit_columns(df, endogenous, exogenous)
    q = len(excluded)
    return (short.stats["ssr"] - full.stats["ssr"]) / q / (full.stats["ssr"] / full.stats["df_resid"])


def durbin_wu_hausman(df: DataFrame, y: Column, x: dict[str, Column], z: dict[str, Column], endogenous: Sequence[str]) -> tuple[float, float]:
    """F test that first-stage residuals of the endogenous regressors add nothing to the structural equation."""
    extra = {f"resid_{e}": x[e] - fit_columns(df, x[e], z).predictor() for e in endogenous}
    full, short = fit_columns(df, y, x | extra), fit_columns(df, y, x)
    q = len(extra)
    f = (short.stats["ssr"] - full.stats["ssr"]) / q / (full.stats["ssr"] / full.stats["df_resid"])
    return f, dist.f_sf(f, q, full.stats["df_resid"])


def gmm(df: DataFrame, y: Column, x: dict[str, Column], z: dict[str, Column], steps: int = 2) -> Fit:
    """Linear GMM: 2SLS weights, then the inverse of Z'diag(u^2)Z. Adds Hansen's J."""
    start = iv(df, y, x, z)
    both = {f"x:{k}": v for k, v in x.items()} | {f"z:{k}": v for k, v in z.items()} | {"y": y}
    g = gram(df, both)
    xn, zn = [f"x:{k}" for k in x], [f"z:{k}" for k in z]
    zx, zy, n = g.pick(zn, xn), g.pick(zn, ["y"])[:, 0], g.n
    xe, ze = [e.cast("double") for e in x.values()], [e.cast("double") for e in z.values()]
    beta = start.params
    for _ in range(max(1, steps - 1)):
        u = y.cast("double") - linear(beta, xe)
        w = inverse_spd(outer_sum(df, ze, u * u))
        beta = np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)
    cov = np.linalg.inv(zx.T @ w @ zx)
    m = zy - zx @ beta
    j, over = float(m @ w @ m), len(z) - len(x)
    return Fit(list(x), beta, cov, math.inf, {"n": n, "j": j, "j_p": dist.chi2_sf(j, over) if over > 0 else math.nan}, xe)


def _weighted_step(z: DataFrame, k: int, weight: Callable[[np.ndarray], np.ndarray], beta: np.ndarray) -> np.ndarray:
    """One weighted least-squares step over columns z0.. (k regressors, then y): a numpy pass, so new coefficients compile nothing."""

    def add(m: np.ndarray) -> np.ndarray:
        w = weight(m[:, k] - m[:, :k] @ beta)
        xw = m[:, :k] * w[:, None]
        return np.concatenate([(xw.T @ m[:, :k]).ravel(), xw.T @ m[:, k]])

    s = batch_sums(z, k * k + k, add)
    return solve_spd(s[: k * k].reshape(k, k), s[k * k :])


def quantile_regression(df: DataFrame, formula: str, tau: float = 0.5, *, eps: float = 1e-4, max_iter: int = 60) -> Fit:
    """Newton steps on a smoothed check loss, sharpened in stages to a kink of eps residual deviations; covariance by Powell's kernel estimate.

    The smoothed loss tau*u + h*ln(1 + exp(-u/h)) is convex; loss, gradient and Hessian of a step are one numpy pass over all rows.
    """
    if not 0 < tau < 1:
        raise InvalidOperation("tau must be in (0, 1)")
    y, x = Formula.parse(formula).design(df)
    z = checkpoint(materialise(df, x | {"y": y}))
    k = len(x)
    xe, ye = [F.col(f"z{i}") for i in range(k)], F.col(f"z{k}")
    start = fit_columns(z, ye, dict(zip(x, xe, strict=True)))
    scale = max(start.stats["sigma"], 1e-12)

    def smoothed(beta: np.ndarray, h: float) -> tuple[float, np.ndarray, np.ndarray]:
        def add(m: np.ndarray) -> np.ndarray:
            r = (m[:, k] - m[:, :k] @ beta) / h
            tail = np.exp(-np.abs(r))
            below = np.where(r >= 0, tail, 1.0) / (1 + tail)  # the logistic distribution function at -r
            loss = h * (tau * r + np.maximum(-r, 0) + np.log1p(tail)).sum()
            w = tail / (1 + tail) ** 2 / h
            return np.concatenate([[loss], m[:, :k].T @ (tau - below), ((m[:, :k] * w[:, None]).T @ m[:, :k]).ravel()])

        s = batch_sums(z, 1 + k + k * k, add)
        return float(s[0]), s[1 : k + 1], s[k + 1 :].reshape(k, k)

    # Columns of unit size keep the ridge below harmless.
    size = np.sqrt(np.maximum(np.array([start.cov[i, i] for i in range(k)]), 1e-300))
    beta, left, e = start.params, max_iter, 0.3
    while left > 0:
        loss, g, hess = smoothed(beta, e * scale)
        for _ in range(12):
            a = hess * np.outer(size, size)
            step = size * np.linalg.solve(a + 1e-10 * np.trace(a) * np.eye(k), size * g)
            gain = float(g @ step)
            if gain <= 1e-9 * abs(loss) or left <= 0:
                break
            part = 1.0
            while left > 0:
                left -= 1
                cand = smoothed(beta + part * step, e * scale)
                if cand[0] <= loss - 1e-4 * part * gain or part < 1e-6:
                    break
                part /= 4
            beta = beta + part * step
            loss, g, hess = cand
        if e <= eps:
            break
        e = max(e / 10, eps)
    u = ye - linear(beta, xe)
    n = int(start.stats["n"])
    lo, hi = quantiles(z, u, (0.25, 0.75))
    q = z.agg(F.stddev_samp(u).alias("s"), F.sum(u * (F.lit(tau) - F.when(u < 0, 1.0).otherwise(0.0))).alias("loss")).first()
    h = n ** (-1 / 3) * dist.norm_ppf(0.975) ** (2 / 3) * ((1.5 * dist.norm_pdf(dist.norm_ppf(tau)) ** 2) / (2 * dist.norm_ppf(tau) ** 2 + 1)) ** (1 / 3)
    width = min(q["s"] or 1.0, (hi - lo) / 1.34 or (q["s"] or 1.0)) * (dist.norm_ppf(min(tau + h, 1 - 1e-9)) - dist.norm_ppf(max(tau - h, 1e-9)))
    dens = outer_sum(z, xe, F.when(F.abs(u) < float(width), F.lit(1.0 / (2 * width))).otherwise(0.0))
    inv = inverse_spd(dens)
    cov = tau * (1 - tau) * inv @ outer_sum(z, xe, F.lit(1.0)) @ inv
    return Fit(list(x), beta, cov, n - k, {"n": n, "loss": float(q["loss"]), "tau": tau}, list(x.values()))


#: Robust norms: weight functions of u / scale with their usual tuning constants.
NORMS: dict[str, tuple[float, Callable[[np.ndarray, float], np.ndarray]]] = {
    "huber": (1.345, lambda u, c: np.where(np.abs(u) <= c, 1.0, c / np.maximum(np.abs(u), c))),
    "bisquare": (4.685, lambda u, c: np.where(np.abs(u) <= c, (1 - (u / c) ** 2) ** 2, 0.0)),
    "hampel": (2.0, lambda u, c: np.select([np.abs(u) <= c, np.abs(u) <= 2 * c, np.abs(u) <= 4 * c], [np.ones_like(u), c / np.maximum(np.abs(u), c), c / np.maximum(np.abs(u), c) * (4 * c - np.abs(u)) / (2 * c)], 0.0)),
    "andrew": (1.339, lambda u, c: np.where(np.abs(u) <= math.pi * c, np.sinc(u / c / math.pi), 0.0)),
}


def robust_regression(df: DataFrame, formula: str, norm: str = "huber", *, tol: float = 1e-7, max_iter: int = 100) -> Fit:
    """M-estimation with the scale MAD / 0.6745 re-estimated exactly in every iteration, the median by counts per bin."""
    c, wf = NORMS[norm]
    y, x = Formula.parse(formula).design(df)
    z = checkpoint(materialise(df, x | {"y": y}))
    k = len(x)
    xe, ye = [F.col(f"z{i}") for i in range(k)], F.col(f"z{k}")
    beta = fit_columns(z, ye, dict(zip(x, xe, strict=True))).params
    for _ in range(max_iter):
        scale = quantiles(z, F.abs(ye - linear(beta, xe)), [0.5])[0] / 0.6744897501960817
        if scale <= 0:
            break
        at = scale
        new = _weighted_step(z, k, lambda u: wf(u / at, c), beta)  # noqa: B023
        done = np.max(np.abs(new - beta)) <= tol * (1 + np.max(np.abs(beta)))
        beta = new
        if done:
            break

    def spread(m: np.ndarray) -> np.ndarray:
        u = (m[:, k] - m[:, :k] @ beta) / max(scale, 1e-300)
        return np.array([((wf(u, c) * u) ** 2).sum(), (np.abs(u) <= c).sum(), len(u)])

    psi2, inside, n = batch_sums(z, 3, spread)
    xx = inverse_spd(outer_sum(z, xe, F.lit(1.0)))
    cov = scale**2 * psi2 / (n - k) / max(inside / n, 1e-12) ** 2 * xx
    return Fit(list(x), beta, cov, math.inf, {"n": int(n), "scale": float(scale)}, list(x.values()))


def cochrane_orcutt(df: DataFrame, formula: str, order_by: Sequence[str], *, ar: int = 1, tol: float = 1e-6, max_iter: int = 100) -> Fit:
    """Feasible GLS with AR(p) errors: lagged columns are made once, every iteration is one Gram of quasi-differences."""
    y, x = Formula.parse(formula).design(df)
    base = df.select(*[col(o) for o in order_by], *[e.cast("double").alias(f"z{i}") for i, e in enumerate([*x.values(), y])])
    k = len(x)
    o = Ordered(base, list(order_by))
    lagged = checkpoint(o.with_neighbours(ar, 0, lambda w: {f"l{p}_{i}": F.lag(F.col(f"z{i}"), p).over(w) for p in range(1, ar + 1) for i in range(k + 1)}).where(F.col(o.pos) >= ar))
    names = list(x)
    beta = fit_columns(base, F.col(f"z{k}"), {c: F.col(f"z{i}") for i, c in enumerate(names)}).params
    for _ in range(max_iter):
        res = {0: F.col(f"z{k}") - linear(beta, [F.col(f"z{i}") for i in range(k)])}
        for p in range(1, ar + 1):
            res[p] = F.col(f"l{p}_{k}") - linear(beta, [F.col(f"l{p}_{i}") for i in range(k)])
        g = gram(lagged, {f"u{p}": e for p, e in res.items()}).raw
        rho = np.linalg.solve(g[1:, 1:], g[1:, 0])

        def quasi(i: int) -> Column:
            return F.col(f"z{i}") - linear(rho, [F.col(f"l{p}_{i}") for p in range(1, ar + 1)])  # noqa: B023

        fit = fit_columns(lagged, quasi(k), {c if c != "const" else "_c": quasi(i) for i, c in enumerate(names)})
        done = np.max(np.abs(fit.params - beta)) < tol
        beta = fit.params
        if done:
            break
    return Fit(names, beta, fit.cov, fit.df_resid, fit.stats | {f"rho{p + 1}": float(r) for p, r in enumerate(rho)}, list(x.values()))


def regularised_path(df: DataFrame, formula: str, alphas: Sequence[float], l1_ratio: float = 1.0, *, max_iter: int = 10_000, tol: float = 1e-10) -> list[tuple[float, np.ndarray]]:
    """Elastic-net path by covariance-update coordinate descent on the Gram matrix; the intercept is not penalised."""
    y, x = Formula.parse(formula).design(df)
    slopes = {c: e for c, e in x.items() if c != "const"}
    g = gram(df, slopes | {"y": y})
    n, k = g.n, len(slopes)
    sd = np.sqrt(np.diag(g.centred)[:k] / n)
    sd[sd == 0] = 1.0
    a = g.centred[:k, :k] / n / np.outer(sd, sd)
    b = g.centred[:k, k] / n / sd
    out, beta = [], np.zeros(k)
    for alpha in sorted(alphas, reverse=True):
        for _ in range(max_iter):
            old = beta.copy()
            for j in range(k):
                r = b[j] - a[j] @ beta + a[j, j] * beta[j]
                beta[j] = math.copysign(max(abs(r) - alpha * l1_ratio, 0.0), r) / (a[j, j] + alpha * (1 - l1_ratio))
            if np.max(np.abs(beta - old)) < tol:
                break
        slope = beta / sd
        out.append((alpha, np.concatenate([[g.mean[k] - g.mean[:k] @ slope], slope])))
    return out


def ridge(df: DataFrame, formula: str, alpha: float) -> np.ndarray:
    return regularised_path(df, formula, [alpha], 0.0)[0][1]


def lasso(df: DataFrame, formula: str, alpha: float) -> np.ndarray:
    return regularised_path(df, formula, [alpha], 1.0)[0][1]


def sur(df: DataFrame, equations: Sequence[str], *, iterate: int = 1) -> list[Fit]:
    """Seemingly unrelated regressions: one Gram over all equations' columns gives every cross product."""
    return _system(df, [Formula.parse(e).design(df) for e in equations], None, iterate)


def three_sls(df: DataFrame, equations: Sequence[str], instruments: dict[str, Column]) -> list[Fit]:
    return _system(df, [Formula.parse(e).design(df) for e in equations], instruments, 1)


def _system(df: DataFrame, designs: list, instruments: dict[str, Column] | None, iterate: int) -> list[Fit]:
    cols: dict[str, Column] = {}
    for i, (y, x) in enumerate(designs):
        cols |= {f"{i}:{c}": e for c, e in x.items()} | {f"{i}:__y": y}
    zn: list[str] = []
    if instruments:
        cols |= {f"z:{c}": e for c, e in instruments.items()}
        zn = [f"z:{c}" for c in instruments]
    g = gram(df, cols)
    xn = [[f"{i}:{c}" for c in x] for i, (_, x) in enumerate(designs)]
    yn = [f"{i}:__y" for i in range(len(designs))]
    m = len(designs)

    def cross(a: list[str], b: list[str]) -> np.ndarray:
        """a'b, or a'P_z b with instruments."""
        if not zn:
            return g.pick(a, b)
        return g.pick(a, zn) @ solve_spd(g.pick(zn, zn), g.pick(zn, b))

    beta = [np.linalg.solve(cross(xn[i], xn[i]), cross(xn[i], [yn[i]])[:, 0]) for i in range(m)]
    for _ in range(iterate):
        sigma = np.zeros((m, m))
        for i in range(m):
            for j in range(m):
                a, b = [*xn[i], yn[i]], [*xn[j], yn[j]]
                sigma[i, j] = np.append(-beta[i], 1) @ g.pick(a, b) @ np.append(-beta[j], 1) / g.n
        inv = np.linalg.inv(sigma)
        big = np.block([[inv[i, j] * cross(xn[i], xn[j]) for j in range(m)] for i in range(m)])
        rhs = np.concatenate([sum(inv[i, j] * cross(xn[i], [yn[j]])[:, 0] for j in range(m)) for i in range(m)])
        cov = np.linalg.inv(big)
        sol = cov @ rhs
        at = np.cumsum([0, *[len(x) for x in xn]])
        beta = [sol[at[i] : at[i + 1]] for i in range(m)]
    return [Fit(list(designs[i][1]), beta[i], cov[at[i] : at[i + 1], at[i] : at[i + 1]], math.inf, {"n": g.n, "sigma2": float(sigma[i, i])}, list(designs[i][1].values())) for i in range(m)]


def rolling_ols(df: DataFrame, y: str, x: Sequence[str], window: int, order_by: Sequence[str], *, partition_by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Coefficients over the last `window` rows: windowed cross moments per row, solved in Arrow batches."""
    z = [F.lit(1.0), *[col(c).cast("double") for c in x], col(y).cast("double")]
    w_ = col(weight).cast("double") if weight else F.lit(1.0)
    k = len(x) + 1
    o = Ordered(df, list(order_by), partition_by)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1) if (i, j) != (k, k)]
    m = o.with_neighbours(window - 1, 0, lambda w: {f"m{i}_{j}": F.sum(w_ * z[i] * z[j]).over(w.rowsBetween(-(window - 1), 0)) for i, j in pairs})
    m = m.where(F.col(o.pos) >= window - 1)
    names = ["const", *x]

    def kernel(s: pd.Series) -> pd.DataFrame:
        m = np.array(s.tolist(), float).reshape(len(s), len(pairs))
        a, b = np.zeros((len(s), k, k)), np.zeros((len(s), k))
        for c, (i, j) in enumerate(pairs):
            if j < k:
                a[:, i, j] = a[:, j, i] = m[:, c]
            elif i < k:
                b[:, i] = m[:, c]
        out = np.full((len(b), k), np.nan)
        ok = np.linalg.cond(a) < 1e12 if len(b) else np.zeros(0, bool)
        if ok.any():
            out[ok] = np.linalg.solve(a[ok], b[ok][..., None])[..., 0]
        return pd.DataFrame(out, columns=[f"b_{c}" for c in names])

    solve = F.pandas_udf(kernel, ", ".join(f"`b_{c}` double" for c in names))
    return m.withColumn("_b", solve(F.array(*[F.col(f"m{i}_{j}") for i, j in pairs]))).select(*[col(c) for c in df.columns], *[F.col("_b").getField(f"b_{c}").alias(f"b_{c}") for c in names])


def nls(df: DataFrame, y: str, x: Sequence[str], func: Callable[[np.ndarray, np.ndarray], np.ndarray], start: Sequence[float], *, tol: float = 1e-8, max_iter: int = 100) -> Fit:
    """Gauss-Newton with damping; func(params, X) gives predictions; J'J and J'r are added over Arrow batches."""
    src = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], col(y).cast("double").alias("y"))
    k = len(start)
    beta = np.array(start, float)

    def moments(b: np.ndarray) -> np.ndarray:
        def kernel(batches):
            s = np.zeros((k + 1, k + 1))
            n = 0
            for batch in batches:
                m = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(x))])
                r = batch.column(len(x)).to_numpy(zero_copy_only=False) - func(b, m)
                steps = 1e-6 * np.maximum(1, np.abs(b))
                j = np.column_stack([(func(b + d, m) - func(b - d, m)) / (2 * d[i]) for i, d in enumerate(np.diag(steps))])
                a = np.column_stack([j, r])
                s += a.T @ a
                n += len(r)
            flat = np.append(s.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "s"])

        out = np.zeros((k + 1) ** 2 + 1)
        for r in src.mapInArrow(kernel, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            out[r["i"]] = r["s"]
        return out

    cur, damp = moments(beta), 1e-3
    for _ in range(max_iter):
        s = cur[:-1].reshape(k + 1, k + 1)
        step = np.linalg.solve(s[:k, :k] + damp * np.diag(np.diag(s[:k, :k])), s[:k, k])
        nxt = moments(beta + step)
        if nxt[-2] <= cur[-2]:
            small = np.max(np.abs(step)) <= tol * (1 + np.max(np.abs(beta)))
            beta, cur, damp = beta + step, nxt, damp / 10
            if small:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    s = cur[:-1].reshape(k + 1, k + 1)
    n, ssr = int(cur[-1]), float(s[k, k])
    return Fit([f"b{i}" for i in range(k)], beta, ssr / (n - k) * np.linalg.inv(s[:k, :k]), n - k, {"n": n, "ssr": ssr})


def event_study(df: DataFrame, y: str, event_time: str, reference: int, low: int, high: int, controls: Sequence[str] = (), cov: Cov = Cov()) -> Fit:  # noqa: B008
    """Dummies for event times low..high without the reference; NULL event times are never-treated rows."""
    x = {"const": F.lit(1.0)} | {f"event_{t}": F.coalesce(F.when(col(event_time) == t, 1.0), F.lit(0.0)) for t in range(low, high + 1) if t != reference} | {c: col(c).cast("double") for c in controls}
    return fit_columns(df, col(y), x, cov)

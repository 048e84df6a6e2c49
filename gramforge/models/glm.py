"""Generalised linear models by iteratively reweighted least squares in Catalyst aggregates, and discrete and count
models by distributed maximum likelihood."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import InvalidOperation, OptimizationFailed
from gramforge.formula import MAX_LEVELS, Formula, bspline_columns
from gramforge.models.linear import Cov, fit_columns, sandwich
from gramforge.models.results import Fit
from gramforge.plans.mle import Kernel, batch_sums, maximise, numeric_scores, project
from gramforge.plans.moments import gram, inverse_spd, linear, outer_sum, solve_spd
from gramforge.util import checkpoint, col


class _SparkMath:
    """The functions links and families need, over columns; `_NumpyMath` has the same over arrays."""

    exp, log, sqrt, pow = F.exp, F.ln, F.sqrt, F.pow

    @staticmethod
    def clip(x, lo, hi):
        return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))

    @staticmethod
    def where(test, a, b):
        return F.when(test, a).otherwise(b)

    @staticmethod
    def one(x):
        return F.lit(1.0)


class _NumpyMath:
    exp, log, sqrt, pow, clip, where = np.exp, np.log, np.sqrt, np.power, np.clip, np.where

    @staticmethod
    def one(x):
        return np.ones_like(x)


@dataclass(frozen=True)
class Link:
    """mu as a function of eta, its derivative, and eta as a function of mu; the last argument chooses columns or arrays."""

    inverse: Callable
    slope: Callable
    forward: Callable


def _expit(e, m=_SparkMath):
    return 1 / (1 + m.exp(-m.clip(e, -700.0, 700.0)))


LINKS = {
    "identity": Link(lambda e, m=_SparkMath: e, lambda e, m=_SparkMath: m.one(e), lambda u, m=_SparkMath: u),
    "log": Link(lambda e, m=_SparkMath: m.exp(e), lambda e, m=_SparkMath: m.exp(e), lambda u, m=_SparkMath: m.log(u)),
    "logit": Link(_expit, lambda e, m=_SparkMath: _expit(e, m) * (1 - _expit(e, m)), lambda u, m=_SparkMath: m.log(u / (1 - u))),
    "cloglog": Link(lambda e, m=_SparkMath: 1 - m.exp(-m.exp(e)), lambda e, m=_SparkMath: m.exp(e - m.exp(e)), lambda u, m=_SparkMath: m.log(-m.log(1 - u))),
    "inverse": Link(lambda e, m=_SparkMath: 1 / e, lambda e, m=_SparkMath: -1 / (e * e), lambda u, m=_SparkMath: 1 / u),
    "inverse_squared": Link(lambda e, m=_SparkMath: 1 / m.sqrt(e), lambda e, m=_SparkMath: -0.5 * m.pow(e, -1.5), lambda u, m=_SparkMath: 1 / (u * u)),
    "sqrt": Link(lambda e, m=_SparkMath: e * e, lambda e, m=_SparkMath: 2 * e, lambda u, m=_SparkMath: m.sqrt(u)),
}


@dataclass(frozen=True)
class Family:
    """Variance function, unit deviance, starting mean, default link, whether the dispersion is 1."""

    variance: Callable
    deviance: Callable
    start: Callable
    link: str
    fixed: bool


def _ylogy(y, mu, m):
    """y ln(y / mu), 0 for y = 0."""
    return m.where(y > 0, y * m.log(m.where(y > 0, y, m.one(y)) / mu), 0.0 * y)


def family(name: str, alpha: float = 1.0, power: float = 1.5) -> Family:
    mid = lambda y, mean, m=_SparkMath: (y + mean) / 2
    table = {
        "gaussian": Family(lambda u, m=_SparkMath: m.one(u), lambda y, u, m=_SparkMath: (y - u) * (y - u), mid, "identity", False),
        "binomial": Family(lambda u, m=_SparkMath: u * (1 - u), lambda y, u, m=_SparkMath: 2 * (_ylogy(y, u, m) + _ylogy(1 - y, 1 - u, m)), lambda y, mean, m=_SparkMath: (y + 0.5) / 2, "logit", True),
        "poisson": Family(lambda u, m=_SparkMath: u, lambda y, u, m=_SparkMath: 2 * (_ylogy(y, u, m) - (y - u)), mid, "log", True),
        "gamma": Family(lambda u, m=_SparkMath: u * u, lambda y, u, m=_SparkMath: 2 * ((y - u) / u - m.log(y / u)), mid, "inverse", False),
        "inverse_gaussian": Family(lambda u, m=_SparkMath: u * u * u, lambda y, u, m=_SparkMath: (y - u) * (y - u) / (u * u * y), mid, "inverse_squared", False),
        "negative_binomial": Family(lambda u, m=_SparkMath: u + alpha * u * u, lambda y, u, m=_SparkMath: 2 * (_ylogy(y, u, m) - (y + 1 / alpha) * m.log((1 + alpha * y) / (1 + alpha * u))), mid, "log", True),
        "tweedie": Family(lambda u, m=_SparkMath: m.pow(u, power), lambda y, u, m=_SparkMath: 2 * (m.pow(m.clip(y, 0.0, math.inf), 2 - power) / ((1 - power) * (2 - power)) - y * m.pow(u, 1 - power) / (1 - power) + m.pow(u, 2 - power) / (2 - power)), mid, "log", False),
    }
    if name not in table:
        raise InvalidOperation(f"unknown family {name!r}")
    return table[name]


def glm(df: DataFrame, formula: str, fam: str = "gaussian", link: str | None = None, *, alpha: float = 1.0, power: float = 1.5, cov: Cov = Cov(), offset: Column | None = None, exposure: Column | None = None, tol: float = 1e-8, max_iter: int = 100) -> Fit:  # noqa: B008
    """IRLS: every iteration is one pass of a numpy kernel over Arrow batches, so no stage is compiled anew for new coefficients.

    exposure: a positive column whose logarithm is added to the offset (with the log link).
    """
    f, m = family(fam, alpha, power), _NumpyMath
    name = link or f.link
    lk = LINKS[name]
    if exposure is not None:
        if name != "log":
            raise InvalidOperation("exposure needs the log link")
        offset = F.ln(exposure) + (F.lit(0.0) if offset is None else offset)
    y, x = Formula.parse(formula).design(df)
    k = len(x)
    z = project(df, [*x.values(), y, F.lit(0.0) if offset is None else offset])
    head = z.agg(F.count(F.lit(1)).alias("n"), F.avg(f"z{k}").alias("m")).first()
    n, mean = head["n"], float(head["m"])

    def pieces(b: np.ndarray, beta: np.ndarray | None):
        xs, ys, off = b[:, :k], b[:, k], b[:, k + 1]
        eta = lk.forward(f.start(ys, mean, m), m) if beta is None else xs @ beta + off
        mu = lk.inverse(eta, m)
        d = lk.slope(eta, m) + 0.0 * eta
        return xs, ys, off, eta, mu, d, d * d / f.variance(mu, m)

    def normal(b: np.ndarray, beta: np.ndarray | None) -> np.ndarray:
        with np.errstate(all="ignore"):
            xs, ys, off, eta, mu, d, w = pieces(b, beta)
            xw = xs * w[:, None]
            return np.concatenate([(xw.T @ xs).ravel(), xw.T @ (eta - off + (ys - mu) / d)])

    beta: np.ndarray | None = None
    for it in range(max_iter):
        at = beta
        s = batch_sums(z, k * k + k, lambda b: normal(b, at))  # noqa: B023
        if not np.isfinite(s).all():
            raise OptimizationFailed("the working response is not finite")
        new = solve_spd(s[: k * k].reshape(k, k), s[k * k :])
        # Newton's steps square the error, so a step this small leaves none that matters.
        done = beta is not None and np.max(np.abs(new - beta)) <= tol * (1 + np.max(np.abs(new)))
        beta = new
        if done:
            break
    else:
        raise OptimizationFailed(f"no convergence in {max_iter} iterations")

    def final(b: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            xs, ys, _, _, mu, _, w = pieces(b, beta)
            ll = 0.0
            if fam == "binomial":
                ll = (np.where(ys > 0, ys * np.log(mu), 0.0) + np.where(ys < 1, (1 - ys) * np.log(1 - mu), 0.0)).sum()
            elif fam == "poisson":
                ll = (np.where(ys > 0, ys * np.log(mu), 0.0) - mu - dist.lgamma(ys + 1)).sum()
            sums = [f.deviance(ys, mu, m).sum(), f.deviance(ys, np.full_like(ys, mean), m).sum(), ((ys - mu) ** 2 / f.variance(mu, m)).sum(), ll]
            return np.concatenate([sums, ((xs * w[:, None]).T @ xs).ravel()])

    s = batch_sums(z, 4 + k * k, final)
    dev, null_dev, pearson, ll = (float(v) for v in s[:4])
    phi = 1.0 if f.fixed else pearson / (n - k)
    bread = inverse_spd(s[4:].reshape(k, k))
    xe, ye = [F.col(f"z{i}") for i in range(k)], F.col(f"z{k}")
    if cov.kind == "nonrobust":
        v = phi * bread
    else:
        eta = linear(beta, xe) + F.col(f"z{k + 1}")
        mu, d = lk.inverse(eta), lk.slope(eta)
        v = sandwich(z, xe, (ye - mu) / d, bread, n, cov, d * d / f.variance(mu))
    stats = {"n": n, "df_resid": n - k, "deviance": dev, "null_deviance": null_dev, "pearson_chi2": pearson, "dispersion": phi, "iterations": it + 1}
    if fam in ("binomial", "poisson"):
        stats |= {"log_likelihood": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(n) - 2 * ll, "pseudo_r2": 1 - dev / null_dev if null_dev else math.nan}
    return Fit(list(x), beta, v, math.inf if f.fixed else n - k, stats, list(x.values()), lk.inverse, name)


def logit(df: DataFrame, formula: str, **kwargs) -> Fit:
    return glm(df, formula, "binomial", "logit", **kwargs)


def poisson(df: DataFrame, formula: str, **kwargs) -> Fit:
    return glm(df, formula, "poisson", "log", **kwargs)


_PDF = {"probit": lambda e: F.exp(-e * e / 2) / math.sqrt(2 * math.pi)}


def _slope(fit: Fit) -> Callable[[Column], Column]:
    if fit.link in _PDF:
        return _PDF[fit.link]
    if fit.link in LINKS:
        return LINKS[fit.link].slope
    raise InvalidOperation("marginal effects need a fit with a known link")


def margins(df: DataFrame, fit: Fit, *, at: str | dict[str, float] = "rows") -> Fit:
    """Marginal effects d mu / d x with delta-method standard errors, for the fit's own link (others are an error); one aggregate.

    at: "rows" averages over the rows of `df`, "means" takes the terms' means, a dictionary gives values of terms (the others at their means).
    """
    g, h = _slope(fit), 1e-4
    if at == "rows":
        src, xs = df, fit.exprs
    else:
        m = df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(fit.exprs)]).first()
        given = {} if at == "means" else at
        if bad := [c for c in given if c not in fit.names]:
            raise InvalidOperation(f"no such terms: {bad}")
        src, xs = df.sparkSession.range(1), [F.lit(float(given.get(c, v))) for c, v in zip(fit.names, m, strict=True)]
    eta = linear(fit.params, xs)
    curve = (g(eta + h) - g(eta - h)) / (2 * h)
    r = src.agg(F.avg(g(eta)).alias("s"), *[F.avg(curve * e).alias(f"c{i}") for i, e in enumerate(xs)]).first()
    keep = [i for i, c in enumerate(fit.names) if c != "const"]
    jac = np.array([[r["s"] * (i == j) + fit.params[i] * r[f"c{j}"] for j in range(len(xs))] for i in keep])
    k = len(xs)
    return Fit([fit.names[i] for i in keep], fit.params[keep] * r["s"], jac @ fit.cov[:k, :k] @ jac.T, math.inf, {"n": fit.stats.get("n", math.nan)})


def marginal_effects(df: DataFrame, fit: Fit, *, at_means: bool = False) -> dict[str, float]:
    """Average marginal effects (or at the means) of a fit with a link."""
    m = margins(df, fit, at="means" if at_means else "rows")
    return dict(zip(m.names, map(float, m.params), strict=True))


def residuals(df: DataFrame, fit: Fit, response: Column, fam: str, kind: str = "response", out: str = "residual", *, alpha: float = 1.0) -> DataFrame:
    """Rows of `df` with response, pearson, working or deviance residuals of a fit with a link."""
    f, lk = family(fam, alpha), LINKS[fit.link]
    y, eta = response.cast("double"), linear(fit.params[: len(fit.exprs)], fit.exprs)
    mu = lk.inverse(eta)
    made = {
        "response": lambda: y - mu,
        "pearson": lambda: (y - mu) / F.sqrt(f.variance(mu)),
        "working": lambda: (y - mu) / lk.slope(eta),
        "deviance": lambda: F.signum(y - mu) * F.sqrt(F.greatest(f.deviance(y, mu), F.lit(0.0))),
    }
    if kind not in made:
        raise InvalidOperation(f"unknown residuals {kind!r}")
    return df.withColumn(out, made[kind]())


def overdispersion_test(df: DataFrame, fit: Fit, response: Column) -> dict[str, float]:
    """Regression test of a Poisson fit: the mean of ((y - mu)^2 - y) / mu is 0 without overdispersion; t of ((y-mu)^2 - y)/mu on mu, without constant."""
    mu, y = fit.predictor(), response.cast("double")
    v = (F.pow(y - mu, 2) - y) / mu
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(mu * mu).alias("xx"), F.sum(mu * v).alias("xy"), F.sum(v * v).alias("yy")).first()
    a = r["xy"] / r["xx"]
    se = math.sqrt((r["yy"] - a * r["xy"]) / (r["n"] - 1) / r["xx"])
    return {"alpha": a, "t": a / se, "p": dist.t_two_sided(a / se, r["n"] - 1)}


def goodness_of_fit(fit: Fit) -> dict[str, float]:
    """Deviance and Pearson statistics with their chi-square p-values."""
    d, p, df_ = fit.stats["deviance"], fit.stats["pearson_chi2"], fit.stats["df_resid"]
    return {"deviance": d, "deviance_p": dist.chi2_sf(d, df_), "pearson": p, "pearson_p": dist.chi2_sf(p, df_)}


def lr_test_vs_poisson(negbin: Fit, poisson_fit: Fit) -> tuple[float, float]:
    """Likelihood ratio of a negative binomial against a Poisson fit; alpha = 0 lies on the border, so the p-value is halved."""
    lr = max(0.0, 2 * (negbin.stats["log_likelihood"] - poisson_fit.stats["log_likelihood"]))
    return lr, 0.5 * dist.chi2_sf(lr, 1) if lr > 0 else 1.0


def _mle_fit(df: DataFrame, formula: str, extra: Sequence[str], start: Callable[[np.ndarray, np.ndarray], Sequence[float]], loglik: Callable[[int], Callable[[np.ndarray, np.ndarray], np.ndarray]], more: Sequence[Column] = (), kernel: Callable[[int], Kernel] | None = None) -> Fit:
    """Fit with columns [x..., y, more...]; `start` gets the least-squares coefficients and (mean, variance) of y."""
    y, x = Formula.parse(formula).design(df)
    k = len(x)
    z = project(df, [*x.values(), y, *more])
    ls = fit_columns(z, F.col(f"z{k}"), {c: F.col(f"z{i}") for i, c in enumerate(x)})
    head = z.agg(F.avg(f"z{k}"), F.var_samp(f"z{k}")).first()
    kern = kernel(k) if kernel else numeric_scores(loglik(k))
    b, ll, h, _, n = maximise(z, start(ls.params, np.array([head[0], head[1] or 0.0])), kern)
    p = len(b)
    return Fit([*list(x), *extra], b, np.linalg.pinv(-h), math.inf, {"n": n, "log_likelihood": ll, "aic": 2 * p - 2 * ll, "bic": p * math.log(n) - 2 * ll}, list(x.values()))


def _log_cdf(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(dist.norm_cdf(x), 1e-300))


def probit(df: DataFrame, formula: str) -> Fit:
    def kernel(k: int) -> Kernel:
        def f(b: np.ndarray, m: np.ndarray):
            x, q = m[:, :k], 2 * m[:, k] - 1
            e = q * (x @ b)
            p = np.maximum(dist.norm_cdf(e), 1e-300)
            return np.log(p), (q * dist.norm_pdf(e) / p)[:, None] * x

        return f

    fit = _mle_fit(df, formula, [], lambda ls, _: np.zeros(len(ls)), lambda k: None, kernel=kernel)
    fit.link = "probit"
    return fit


def negative_binomial(df: DataFrame, formula: str, p: float = 2.0) -> Fit:
    """NB-P: variance mu + alpha mu^p; the last parameter is ln(alpha)."""

    def ll(k: int):
        def f(b, m):
            mu, y = np.exp(np.clip(m[:, :k] @ b[:k], -30, 30)), m[:, k]
            size = np.exp(-b[k]) * mu ** (2 - p)
            return dist.lgamma(y + size) - dist.lgamma(size) - dist.lgamma(y + 1) + size * np.log(size / (size + mu)) + y * np.log(mu / (size + mu))

        return f

    def start(ls, head):
        return [math.log(max(head[0], 0.1)), *[0.0] * (len(ls) - 1), math.log(max((head[1] - head[0]) / max(head[0], 0.1) ** 2, 0.1))]

    return _mle_fit(df, formula, ["ln_alpha"], start, ll)


def generalised_poisson(df: DataFrame, formula: str, p: float = 1.0) -> Fit:
    def ll(k: int):
        def f(b, m):
            mu, y = np.exp(np.clip(m[:, :k] @ b[:k], -30, 30)), m[:, k]
            a = b[k] * mu ** (p - 1)
            u, v = np.maximum(1 + a, 1e-10), np.maximum(mu + a * y, 1e-10)
            return np.log(mu) + (y - 1) * np.log(v) - y * np.log(u) - v / u - dist.lgamma(y + 1)

        return f

    return _mle_fit(df, formula, ["alpha"], lambda ls, head: [math.log(max(head[0], 0.1)), *[0.0] * (len(ls) - 1), 0.1], ll)


def _zero_inflated(df: DataFrame, formula: str, inflate: Sequence[str], negbin: bool) -> Fit:
    q = len(inflate) + 1

    def ll(k: int):
        def f(b, m):
            mu, y = np.exp(np.clip(m[:, :k] @ b[:k], -30, 30)), m[:, k]
            g = np.column_stack([np.ones(len(m)), m[:, k + 1 :]]) @ b[k : k + q]
            pi = 1 / (1 + np.exp(-np.clip(g, -35, 35)))
            if negbin:
                size = np.exp(-b[k + q])
                base = dist.lgamma(y + size) - dist.lgamma(size) - dist.lgamma(y + 1) + size * np.log(size / (size + mu)) + y * np.log(mu / (size + mu))
            else:
                base = y * np.log(mu) - mu - dist.lgamma(y + 1)
            return np.where(y == 0, np.log(pi + (1 - pi) * np.exp(base)), np.log1p(-np.minimum(pi, 1 - 1e-12)) + base)

        return f

    names = ["inflate_const", *[f"inflate_{c}" for c in inflate], *(["ln_alpha"] if negbin else [])]
    return _mle_fit(df, formula, names, lambda ls, head: [math.log(max(head[0], 0.1)), *[0.0] * (len(ls) - 1), *[-1.0] + [0.0] * (q - 1), *([0.0] if negbin else [])], ll, [col(c) for c in inflate])


def zip_model(df: DataFrame, formula: str, inflate: Sequence[str] = ()) -> Fit:
    return _zero_inflated(df, formula, inflate, False)


def zinb_model(df: DataFrame, formula: str, inflate: Sequence[str] = ()) -> Fit:
    return _zero_inflated(df, formula, inflate, True)


def _levels(df: DataFrame, y: Column) -> tuple[list[float], Column]:
    """Sorted levels of the response (at most MAX_LEVELS) and the code of a row's level, NULL (an error in the fit) for a missing response."""
    levels = sorted(r[0] for r in df.where(y.isNotNull() & ~F.isnan(y)).select(y).distinct().limit(MAX_LEVELS + 1).collect())
    if len(levels) > MAX_LEVELS:
        raise InvalidOperation(f"the response has over {MAX_LEVELS} levels")
    code = F.when(F.lit(False), 0)
    for i, lv in enumerate(levels):
        code = code.when(y == lv, i)
    return levels, code


def _ordered(df: DataFrame, formula: str, cdf: Callable[[np.ndarray], np.ndarray]) -> Fit:
    """Categories are the sorted distinct values of the response; thresholds are cumulated exponentials."""
    f = Formula.parse(formula)
    y, x = f.design(df)
    x = {c: e for c, e in x.items() if c != "const"}
    levels, code = _levels(df, y)
    j, k = len(levels), len(x)
    if j < 2:
        raise InvalidOperation("the response needs two categories")
    z = project(df, [*x.values(), code])

    def cuts(b):
        return np.concatenate([[-np.inf], np.cumsum(np.concatenate([[b[k]], np.exp(b[k + 1 :])])), [np.inf]])

    def ll(b, m):
        c, e, at = cuts(b), m[:, :k] @ b[:k], m[:, k].astype(int)
        return np.log(np.maximum(cdf(c[at + 1] - e) - cdf(c[at] - e), 1e-300))

    start = np.zeros(k + j - 1)
    start[k] = -1.0
    b, value, h, _, n = maximise(z, start, numeric_scores(ll))
    c = cuts(b)[1:-1]
    jac = np.eye(len(b))
    for r in range(1, j - 1):
        jac[k + r, k] = 1
        jac[k + r, k + 1 : k + r + 1] = np.exp(b[k + 1 : k + r + 1])
    params = np.concatenate([b[:k], c])
    return Fit([*x, *[f"cut{i + 1}" for i in range(j - 1)]], params, jac @ np.linalg.pinv(-h) @ jac.T, math.inf, {"n": n, "log_likelihood": value}, list(x.values()))


def ordered_logit(df: DataFrame, formula: str) -> Fit:
    return _ordered(df, formula, lambda e: 1 / (1 + np.exp(-np.clip(e, -700, 700))))


def ordered_probit(df: DataFrame, formula: str) -> Fit:
    return _ordered(df, formula, dist.norm_cdf)


def multinomial_logit(df: DataFrame, formula: str) -> Fit:
    """Base category: the smallest value of the response."""
    y, x = Formula.parse(formula).design(df)
    levels, code = _levels(df, y)
    j, k = len(levels), len(x)
    z = project(df, [*x.values(), code])

    def kernel(b, m):
        xm, at = m[:, :k], m[:, k].astype(int)
        e = np.column_stack([np.zeros(len(m)), xm @ b.reshape(j - 1, k).T])
        e -= e.max(axis=1, keepdims=True)
        p = np.exp(e)
        p /= p.sum(axis=1, keepdims=True)
        hit = np.eye(j)[at]
        s = ((hit - p)[:, 1:, None] * xm[:, None, :]).reshape(len(m), -1)
        return np.log(np.maximum(p[np.arange(len(m)), at], 1e-300)), s

    b, ll, h, _, n = maximise(z, np.zeros((j - 1) * k), kernel)
    return Fit([f"{lv:g}:{c}" for lv in levels[1:] for c in x], b, np.linalg.pinv(-h), math.inf, {"n": n, "log_likelihood": ll}, [])


def multinomial_probabilities(df: DataFrame, fit: Fit, formula: str) -> DataFrame:
    """Rows of `df` with `p_<level>` per level of a multinomial fit; the base level's column is p_base."""
    _, x = Formula.parse(formula).design(df)
    k, levels = len(x), list(dict.fromkeys(n.split(":", 1)[0] for n in fit.names))
    eta = {lv: linear(fit.params[i * k : (i + 1) * k], list(x.values())) for i, lv in enumerate(levels)}
    top = F.greatest(F.lit(0.0), *eta.values()) if eta else F.lit(0.0)
    total = F.exp(-top)
    for e in eta.values():
        total = total + F.exp(e - top)
    return df.select("*", (F.exp(-top) / total).alias("p_base"), *[(F.exp(e - top) / total).alias(f"p_{lv}") for lv, e in eta.items()])


def relative_risk_ratios(fit: Fit) -> dict[str, float]:
    return dict(zip(fit.names, map(float, np.exp(fit.params)), strict=True))


def ordered_probabilities(df: DataFrame, fit: Fit, *, normal: bool = False) -> DataFrame:
    """Rows of `df` with p_1, p_2 ... of the sorted categories of an ordered logit (or, with `normal`, probit) fit."""
    k = len(fit.exprs)
    eta, cuts = linear(fit.params[:k], fit.exprs), [float(c) for c in fit.params[k:]]
    if normal:
        cdf = F.pandas_udf(lambda s: s.__class__(dist.norm_cdf(s.to_numpy(float))), "double")
    else:
        cdf = LINKS["logit"].inverse
    below = [F.lit(0.0), *[cdf(F.lit(c) - eta) for c in cuts], F.lit(1.0)]
    return df.select("*", *[(b - a).alias(f"p_{i}") for i, (a, b) in enumerate(zip(below, below[1:], strict=False), 1)])


def beta_regression(df: DataFrame, formula: str) -> Fit:
    """Logit mean, ln(phi) precision; responses strictly between 0 and 1."""

    def ll(k: int):
        def f(b, m):
            mu, y, phi = 1 / (1 + np.exp(-m[:, :k] @ b[:k])), m[:, k], np.exp(b[k])
            return dist.lgamma(np.full(len(m), phi)) - dist.lgamma(mu * phi) - dist.lgamma((1 - mu) * phi) + (mu * phi - 1) * np.log(y) + ((1 - mu) * phi - 1) * np.log1p(-y)

        return f

    return _mle_fit(df, formula, ["ln_phi"], lambda ls, head: [math.log(head[0] / (1 - head[0])), *[0.0] * (len(ls) - 1), 1.0], ll)


def tobit(df: DataFrame, formula: str, lower: float | None = 0.0, upper: float | None = None) -> Fit:
    def ll(k: int):
        def f(b, m):
            e, y, s = m[:, :k] @ b[:k], m[:, k], np.exp(b[k])
            out = -0.5 * np.log(2 * np.pi) - b[k] - 0.5 * ((y - e) / s) ** 2
            if lower is not None:
                out = np.where(y <= lower, _log_cdf((lower - e) / s), out)
            if upper is not None:
                out = np.where(y >= upper, _log_cdf((e - upper) / s), out)
            return out

        return f

    return _mle_fit(df, formula, ["ln_sigma"], lambda ls, head: [*ls, 0.5 * math.log(max(head[1], 1e-12))], ll)


def heckman(df: DataFrame, formula: str, selection: str) -> tuple[Fit, Fit]:
    """Two steps: probit of selection, then least squares with the inverse Mills ratio over selected rows."""
    sel = probit(df, selection)
    eta = linear(sel.params, sel.exprs)
    mills = F.pandas_udf(lambda s: s.__class__(dist.norm_pdf(s.to_numpy(float)) / np.maximum(dist.norm_cdf(s.to_numpy(float)), 1e-300)), "double")
    s = Formula.parse(selection).response
    y, x = Formula.parse(formula).design(df)
    rows = df.where(F.col(s) == 1).select(*[e.cast("double").alias(f"z{i}") for i, e in enumerate(x.values())], y.alias("y"), mills(eta).alias("mills"))
    return fit_columns(rows, F.col("y"), {c: F.col(f"z{i}") for i, c in enumerate(x)} | {"mills": F.col("mills")}, Cov("HC1")), sel


def conditional_logit(df: DataFrame, y: str, x: Sequence[str], group: str, *, tol: float = 1e-9, max_iter: int = 50) -> Fit:
    """One success or more per group; exact for one success per group (McFadden), by two-level aggregates per Newton step.

    Groups without or with only successes carry no information and drop out.
    """
    g = df.select(col(group).alias("g"), col(y).cast("double").alias("y"), *[col(c).cast("double").alias(f"z{i}") for i, c in enumerate(x)])
    g = checkpoint(g)
    if g.groupBy("g").agg(F.sum("y").alias("s")).where("s > 1").limit(1).count():
        raise InvalidOperation("a group has more than one success")
    k = len(x)
    b = np.zeros(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(max_iter):
        e = F.exp(linear(b, [F.col(f"z{i}") for i in range(k)]))
        s = g.withColumn("e", e).groupBy("g").agg(F.sum("y").alias("y"), F.sum("e").alias("e"), F.sum(F.when(F.col("y") == 1, F.ln("e"))).alias("l"), *[F.sum(F.col("e") * F.col(f"z{i}")).alias(f"m{i}") for i in range(k)], *[F.sum(F.col("y") * F.col(f"z{i}")).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("e") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}_{j}") for i, j in pairs]).where("y = 1")
        r = s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l") - F.ln("e")).alias("ll"), *[F.sum(F.col(f"s{i}") - F.col(f"m{i}") / F.col("e")).alias(f"g{i}") for i in range(k)], *[F.sum(F.col(f"q{i}_{j}") / F.col("e") - F.col(f"m{i}") * F.col(f"m{j}") / (F.col("e") * F.col("e"))).alias(f"h{i}_{j}") for i, j in pairs]).first()
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        step = np.linalg.solve(h, [r[f"g{i}"] for i in range(k)])
        b = b + step
        if np.max(np.abs(step)) < tol:
            break
    return Fit(list(x), b, np.linalg.inv(h), math.inf, {"groups": r["n"], "log_likelihood": r["ll"]}, [F.col(c) for c in x])


def conditional_poisson(df: DataFrame, y: str, x: Sequence[str], group: str, *, tol: float = 1e-9, max_iter: int = 50) -> Fit:
    """Fixed-effects Poisson: the group totals condition the effects out; two-level aggregates per Newton step."""
    g = checkpoint(df.select(col(group).alias("g"), col(y).cast("double").alias("y"), *[col(c).cast("double").alias(f"z{i}") for i, c in enumerate(x)]))
    k = len(x)
    b = np.zeros(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(max_iter):
        eta = linear(b, [F.col(f"z{i}") for i in range(k)])
        s = g.withColumn("e", F.exp(eta)).groupBy("g").agg(F.sum("y").alias("y"), F.sum("e").alias("e"), F.sum(F.col("y") * eta).alias("l"), *[F.sum(F.col("e") * F.col(f"z{i}")).alias(f"m{i}") for i in range(k)], *[F.sum(F.col("y") * F.col(f"z{i}")).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("e") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}_{j}") for i, j in pairs]).where("y > 0")
        r = s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l") - F.col("y") * F.ln("e")).alias("ll"), *[F.sum(F.col(f"s{i}") - F.col("y") * F.col(f"m{i}") / F.col("e")).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("y") * (F.col(f"q{i}_{j}") / F.col("e") - F.col(f"m{i}") * F.col(f"m{j}") / (F.col("e") * F.col("e")))).alias(f"h{i}_{j}") for i, j in pairs]).first()
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        step = np.linalg.solve(h, [r[f"g{i}"] for i in range(k)])
        b = b + step
        if np.max(np.abs(step)) < tol:
            break
    return Fit(list(x), b, np.linalg.inv(h), math.inf, {"groups": r["n"], "log_likelihood": r["ll"]}, [F.col(c) for c in x])


def gee(df: DataFrame, formula: str, group: str, fam: str = "gaussian", corr: str = "exchangeable", *, tol: float = 1e-8, max_iter: int = 60) -> Fit:
    """Generalised estimating equations with independent or exchangeable working correlation.

    The exchangeable inverse is I - a/(1+(m-1)a) 11', so a cluster enters through sums of its rows only:
    two-level aggregates, no matrix per cluster. Robust (sandwich) covariance.
    """
    f = family(fam)
    lk = LINKS[f.link]
    y, x = Formula.parse(formula).design(df)
    k = len(x)
    z = checkpoint(df.select(col(group).alias("g"), *[e.cast("double").alias(f"z{i}") for i, e in enumerate([*x.values(), y])]))
    xe, ye = [F.col(f"z{i}") for i in range(k)], F.col(f"z{k}")
    beta = glm(df, formula, fam).params
    alpha, n = 0.0, z.count()
    for _ in range(max_iter):
        eta = linear(beta, xe)
        mu, d = lk.inverse(eta), lk.slope(eta)
        sd = F.sqrt(f.variance(mu))
        r = (ye - mu) / sd
        cl = z.withColumn("r", r).groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
        t = cl.agg(F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") - F.col("q")).alias("c"), F.sum(F.col("m") * (F.col("m") - 1)).alias("p")).first()
        phi = t["q"] / (n - k)
        if corr == "exchangeable" and t["p"] > k:
            alpha = float(np.clip(t["c"] / phi / (t["p"] - k), -0.2, 0.95))
        w = z.select("g", *[(e * d / sd).alias(f"a{i}") for i, e in enumerate(xe)], r.alias("r"))
        cl = w.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("r").alias("sr"), *[F.sum(f"a{i}").alias(f"s{i}") for i in range(k)], *[F.sum(F.col(f"a{i}") * F.col("r")).alias(f"b{i}") for i in range(k)], *[F.sum(F.col(f"a{i}") * F.col(f"a{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)])
        c = F.lit(alpha) / (1 + (F.col("m") - 1) * alpha)
        sc = [(F.col(f"b{i}") - c * F.col(f"s{i}") * F.col("sr")) / (1 - alpha) for i in range(k)]
        cl = cl.select(*[s.alias(f"u{i}") for i, s in enumerate(sc)], *[((F.col(f"q{i}_{j}") - c * F.col(f"s{i}") * F.col(f"s{j}")) / (1 - alpha)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)])
        o = cl.agg(F.count(F.lit(1)).alias("g"), *[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)], *[F.sum(f"h{i}_{j}").alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        h, m = np.zeros((k, k)), np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = o[f"h{i}_{j}"]
                m[i, j] = m[j, i] = o[f"m{i}_{j}"]
        step = np.linalg.solve(h, [o[f"u{i}"] for i in range(k)])
        beta = beta + step
        if np.max(np.abs(step)) <= tol * (1 + np.max(np.abs(beta))):
            break
    else:
        raise OptimizationFailed(f"no convergence in {max_iter} iterations")
    inv = np.linalg.inv(h)
    return Fit(list(x), beta, inv @ m @ inv, math.inf, {"n": n, "groups": o["g"], "alpha": alpha, "phi": phi}, list(x.values()), lk.inverse)


def gam(df: DataFrame, y: str, smooth: Sequence[str], *, n_basis: int = 10, penalty: float = 1.0) -> Fit:
    """Gaussian additive model: B-spline bases with a second-difference penalty added to the Gram on the driver."""
    x: dict[str, Column] = {"const": F.lit(1.0)}
    pen = [np.zeros((1, 1))]
    for s in smooth:
        basis = bspline_columns(df, s, n_basis)
        # The first basis column is left out: the basis adds up to the intercept.
        x |= dict(list(basis.items())[1:])
        d = np.diff(np.eye(n_basis), 2, axis=0)
        pen.append(penalty * (d.T @ d)[1:, 1:])
    g = gram(df, x | {"__y": col(y)})
    names = list(x)
    k = len(names)
    p = np.zeros((k, k))
    at = 0
    for b in pen:
        p[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    xx, xy, yy = g.pick(names, names), g.pick(names, ["__y"])[:, 0], g.pick(["__y"], ["__y"])[0, 0]
    inv = np.linalg.inv(xx + p + 1e-10 * np.eye(k))
    beta = inv @ xy
    ssr = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    edf = float(np.trace(inv @ xx))
    s2 = ssr / (g.n - edf)
    return Fit(names, beta, s2 * inv @ xx @ inv, g.n - edf, {"n": g.n, "edf": edf, "sigma": math.sqrt(s2), "ssr": ssr}, list(x.values()))


def stochastic_frontier(df: DataFrame, formula: str, cost: bool = False) -> Fit:
    """Normal / half-normal frontier by maximum likelihood; last parameters ln sigma_v and ln sigma_u."""
    sign = 1.0 if cost else -1.0

    def ll(k: int):
        def f(b, m):
            sv, su = np.exp(b[k]), np.exp(b[k + 1])
            s, lam = math.sqrt(sv * sv + su * su), su / sv
            e = m[:, k] - m[:, :k] @ b[:k]
            return math.log(2) - 0.5 * math.log(2 * math.pi) - math.log(s) - 0.5 * (e / s) ** 2 + _log_cdf(sign * e * lam / s)

        return f

    return _mle_fit(df, formula, ["ln_sigma_v", "ln_sigma_u"], lambda ls, head: [*ls, 0.5 * math.log(head[1] / 2 + 1e-12), 0.5 * math.log(head[1] / 2 + 1e-12)], ll)


def panel_tobit(df: DataFrame, formula: str, entity: str, lower: float = 0.0) -> Fit:
    """Correlated-effects tobit: entity means of the regressors stand in for the effects (Mundlak)."""
    f = Formula.parse(formula)
    x = [t[0].name for t in f.terms]
    means = df.groupBy(col(entity)).agg(*[F.avg(col(c)).alias(f"mean_{c}") for c in x])
    wide = df.join(means, entity)
    return tobit(wide, f"{f.response} ~ {' + '.join([*x, *[f'mean_{c}' for c in x]])}", lower)

"""Time-series statistics on one ordered series of any length: lagged columns come from block windows with halos, and
everything else is a Gram matrix of lags."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import InvalidOperation, ShapeMismatch
from gramforge.models.linear import fit_columns
from gramforge.models.results import Fit
from gramforge.operators.ordered import Ordered
from gramforge.plans.moments import gram, solve_spd
from gramforge.util import checkpoint, col


def lagged(df: DataFrame, names: Sequence[str], lags: int, order_by: Sequence[str], *, drop: bool = True, also: int = 0) -> DataFrame:
    """Columns c__l1..c__l{lags} for each name and `__pos` (position from 0); the first `lags + also` rows are dropped if asked."""
    o = Ordered(df.select(*[col(c) for c in dict.fromkeys([*order_by, *names])]), list(order_by))
    x = o.with_neighbours(lags, 0, lambda w: {f"{c}__l{p}": F.lag(col(c), p).over(w) for p in range(1, lags + 1) for c in names})
    x = x.withColumnRenamed(o.pos, "__pos")
    return checkpoint(x.where(F.col("__pos") >= lags + also) if drop else x)


def lagmat(df: DataFrame, name: str, lags: int, order_by: Sequence[str]) -> DataFrame:
    return lagged(df, [name], lags, order_by, drop=False)


def acf(df: DataFrame, name: str, lags: int, order_by: Sequence[str]) -> list[float]:
    """Autocovariances divided by n at every lag, over the variance; zeros for a constant series."""
    m = df.agg(F.avg(col(name)), F.count(col(name))).first()
    x = lagged(df.withColumn(name, col(name) - m[0]), [name], lags, order_by, drop=False)
    r = x.agg(*[F.sum(col(name) * (F.col(f"{name}__l{p}") if p else col(name))).alias(f"c{p}") for p in range(lags + 1)]).first()
    g0 = r["c0"] / m[1]
    return [1.0] + [float((r[f"c{p}"] or 0) / m[1] / g0) for p in range(1, lags + 1)] if g0 >= 1e-15 else [0.0] * (lags + 1)


def pacf(df: DataFrame, name: str, lags: int, order_by: Sequence[str]) -> list[float]:
    """Durbin-Levinson on the autocorrelations."""
    r = acf(df, name, lags, order_by)
    out, phi = [1.0], np.zeros(0)
    for k in range(1, lags + 1):
        num = r[k] - sum(phi[j] * r[k - 1 - j] for j in range(k - 1))
        den = 1 - sum(phi[j] * r[j + 1] for j in range(k - 1))
        a = num / den if abs(den) > 1e-15 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return out


def ljung_box(df: DataFrame, name: str, lags: int, order_by: Sequence[str]) -> tuple[float, float]:
    n, r = df.where(col(name).isNotNull()).count(), acf(df, name, lags, order_by)
    q = n * (n + 2) * sum(r[k] ** 2 / (n - k) for k in range(1, lags + 1))
    return q, dist.chi2_sf(q, lags)


def arch_test(df: DataFrame, name: str, lags: int, order_by: Sequence[str]) -> tuple[float, float]:
    x = lagged(df.withColumn(name, col(name) * col(name)), [name], lags, order_by)
    fit = fit_columns(x, col(name), {"const": F.lit(1.0)} | {f"l{p}": F.col(f"{name}__l{p}") for p in range(1, lags + 1)})
    lm = fit.stats["n"] * fit.stats["r_squared"]
    return lm, dist.chi2_sf(lm, lags)


#: Asymptotic critical values at 1, 5 and 10 %.
ADF_CRITICAL = (-3.43, -2.86, -2.57)
ENGLE_GRANGER_CRITICAL = (-3.90, -3.34, -3.04)
ZIVOT_ANDREWS_CRITICAL = (-5.34, -4.80, -4.58)
KPSS_CRITICAL = {"c": (0.739, 0.463, 0.347), "ct": (0.216, 0.146, 0.119)}


def adf(df: DataFrame, name: str, order_by: Sequence[str], lags: int | None = None) -> dict[str, float]:
    n = df.where(col(name).isNotNull()).count()
    if n < 10:
        raise InvalidOperation("needs 10 rows")
    lags = int((n - 1) ** (1 / 3) + 1e-9) if lags is None else lags
    x = lagged(df, [name], lags + 1, order_by)
    lag = lambda p: F.col(f"{name}__l{p}") if p else col(name)
    fit = fit_columns(x, lag(0) - lag(1), {"const": F.lit(1.0), "level": lag(1)} | {f"d{p}": lag(p) - lag(p + 1) for p in range(1, lags + 1)})
    return {"statistic": float(fit.tvalues[1]), "lags": lags, "n": fit.stats["n"], "crit_1": ADF_CRITICAL[0], "crit_5": ADF_CRITICAL[1], "crit_10": ADF_CRITICAL[2]}


def phillips_perron(df: DataFrame, name: str, order_by: Sequence[str]) -> dict[str, float]:
    """Z(t) for rho = 1 with a Bartlett long-run variance."""
    x = lagged(df, [name], 1, order_by)
    fit = fit_columns(x, col(name), {"const": F.lit(1.0), "level": F.col(f"{name}__l1")})
    n = int(fit.stats["n"])
    e = x.select("__pos", (col(name) - fit.params[0] - fit.params[1] * F.col(f"{name}__l1")).alias("e"))
    lags = int(n**0.25)
    r = _autocov(e, "e", lags, ["__pos"], centre=False)
    lrv = r[0] + 2 * sum((1 - p / (lags + 1)) * r[p] for p in range(1, lags + 1))
    t = (fit.params[1] - 1) / fit.se[1]
    s2 = fit.stats["sigma"] ** 2
    z = math.sqrt(r[0] / lrv) * t - 0.5 * (lrv - r[0]) / math.sqrt(lrv) * n * fit.se[1] / math.sqrt(s2)
    return {"statistic": float(z), "lags": lags, "crit_1": ADF_CRITICAL[0], "crit_5": ADF_CRITICAL[1], "crit_10": ADF_CRITICAL[2]}


def _autocov(df: DataFrame, name: str, lags: int, order_by: Sequence[str], centre: bool = True) -> list[float]:
    m, n = df.agg(F.avg(col(name)), F.count(col(name))).first()
    x = lagged(df.withColumn(name, col(name) - (m if centre else 0.0)), [name], lags, order_by, drop=False) if lags else df.withColumn(name, col(name) - (m if centre else 0.0))
    r = x.agg(*[F.sum(col(name) * (F.col(f"{name}__l{p}") if p else col(name))).alias(f"c{p}") for p in range(lags + 1)]).first()
    return [float((r[f"c{p}"] or 0) / n) for p in range(lags + 1)]


def kpss(df: DataFrame, name: str, order_by: Sequence[str], kind: str = "c") -> dict[str, float]:
    o = Ordered(df.where(col(name).isNotNull()).select(*[col(c) for c in dict.fromkeys([*order_by, name])]), list(order_by))
    x = checkpoint(o.rows().withColumnRenamed(o.pos, "__pos"))
    n = x.count()
    fit = fit_columns(x, col(name), {"const": F.lit(1.0)} | ({"trend": F.col("__pos").cast("double")} if kind == "ct" else {}))
    e = checkpoint(x.select("__pos", (col(name) - fit.predictor()).alias("e")))
    lags = int(12 * (n / 100) ** 0.25)
    r = _autocov(e, "e", lags, ["__pos"], centre=False)
    lrv = r[0] + 2 * sum((1 - p / (lags + 1)) * r[p] for p in range(1, lags + 1))
    s = Ordered(e, ["__pos"]).cumsum("e").agg(F.sum(F.pow(F.col("e_cumsum"), 2))).first()[0]
    c = KPSS_CRITICAL[kind]
    return {"statistic": s / (n * n * lrv), "lags": lags, "crit_1": c[0], "crit_5": c[1], "crit_10": c[2]}


def granger_causality(df: DataFrame, y: str, x: str, lags: int, order_by: Sequence[str]) -> tuple[float, float]:
    """F test that lags of x add nothing to lags of y; both fits come from one Gram."""
    d = lagged(df, [y, x], lags, order_by)
    ys, xs = [f"{y}__l{p}" for p in range(1, lags + 1)], [f"{x}__l{p}" for p in range(1, lags + 1)]
    g = gram(d, {c: col(c) for c in [y, *ys, *xs]})
    s, at = g.centred, {c: i for i, c in enumerate(g.names)}

    def ssr(names: Sequence[str]) -> float:
        i = [at[c] for c in names]
        return float(s[0, 0] - s[0, i] @ solve_spd(s[np.ix_(i, i)], s[i, 0]))

    full, short = ssr([*ys, *xs]), ssr(ys)
    d2 = g.n - 2 * lags - 1
    f = (short - full) / lags / (full / d2)
    return f, dist.f_sf(f, lags, d2)


def engle_granger(df: DataFrame, y: str, x: Sequence[str], order_by: Sequence[str]) -> dict[str, float]:
    if df.count() < 20:
        raise InvalidOperation("needs 20 rows")
    fit = fit_columns(df, col(y), {"const": F.lit(1.0)} | {c: col(c) for c in x})
    r = adf(df.select(*[col(o) for o in order_by], (col(y) - fit.predictor()).alias("__e")), "__e", order_by)
    return r | {"crit_1": ENGLE_GRANGER_CRITICAL[0], "crit_5": ENGLE_GRANGER_CRITICAL[1], "crit_10": ENGLE_GRANGER_CRITICAL[2]}


def zivot_andrews(df: DataFrame, name: str, order_by: Sequence[str], trim: float = 0.15, lags: int = 1) -> dict[str, float]:
    """Least t over a grid of breaks in the level; the break dummy's cross products are suffix sums, added per block in one job."""
    x = lagged(df, [name], lags + 1, order_by)
    lag = lambda p: F.col(f"{name}__l{p}") if p else col(name)
    z = {"const": F.lit(1.0), "trend": F.col("__pos").cast("double"), "level": lag(1)} | {f"d{p}": lag(p) - lag(p + 1) for p in range(1, lags + 1)} | {"y": lag(0) - lag(1)}
    n0, n1 = x.agg(F.min("__pos"), F.max("__pos")).first()
    n = n1 - n0 + 1
    trim = min(max(trim, 0.05), 0.25)
    breaks = sorted({n0 + int(n * (trim + (1 - 2 * trim) * i / 199)) for i in range(200)})
    names = list(z)
    cell = F.lit(0)
    edges = F.array(*[F.lit(b) for b in breaks])
    cell = F.size(F.filter(edges, lambda e: e < F.col("__pos")))
    cols = x.select(cell.alias("c"), *[e.cast("double").alias(f"z{i}") for i, e in enumerate(z.values())])
    sums = {r["c"]: np.array([r["n"], *[r[f"s{i}"] for i in range(len(names))]], float) for r in cols.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(len(names))]).collect()}
    g = gram(x, z).raw
    k = len(names) - 1
    best = (math.inf, 0)
    after = np.zeros(len(names) + 1)
    for j in range(len(breaks), 0, -1):
        after = after + sums.get(j, np.zeros(len(names) + 1))
        a = np.zeros((k + 1, k + 1))
        a[:k, :k] = g[:k, :k]
        a[:k, k] = a[k, :k] = after[1 : k + 1]
        a[k, k] = after[0]
        b = np.append(g[:k, k], after[k + 1])
        try:
            inv = np.linalg.inv(a)
        except np.linalg.LinAlgError:
            continue
        beta = inv @ b
        s2 = (g[k, k] - beta @ b) / (n - k - 1)
        t = beta[2] / math.sqrt(max(s2 * inv[2, 2], 1e-300))
        best = min(best, (float(t), breaks[j - 1]))
    return {"statistic": best[0], "break_at": best[1], "crit_1": ZIVOT_ANDREWS_CRITICAL[0], "crit_5": ZIVOT_ANDREWS_CRITICAL[1], "crit_10": ZIVOT_ANDREWS_CRITICAL[2]}


def autoreg(df: DataFrame, name: str, lags: int, order_by: Sequence[str], *, trend: str = "c") -> Fit:
    x = lagged(df, [name], lags, order_by)
    det = ({"const": F.lit(1.0)} if "c" in trend else {}) | ({"trend": F.col("__pos").cast("double")} if "t" in trend else {})
    return fit_columns(x, col(name), det | {f"L{p}.{name}": F.col(f"{name}__l{p}") for p in range(1, lags + 1)})


def ardl(df: DataFrame, y: str, x: Sequence[str], y_lags: int, x_lags: int, order_by: Sequence[str]) -> Fit:
    """Adds the long-run multipliers sum(b_x) / (1 - sum(a)) to the summary."""
    m = max(y_lags, x_lags)
    d = lagged(df, [y, *x], m, order_by)
    reg = {"const": F.lit(1.0)} | {f"L{p}.{y}": F.col(f"{y}__l{p}") for p in range(1, y_lags + 1)} | {f"L{p}.{c}": F.col(f"{c}__l{p}") if p else col(c) for c in x for p in range(x_lags + 1)}
    fit = fit_columns(d, col(y), reg)
    b = dict(zip(fit.names, fit.params, strict=True))
    rest = 1 - sum(b[f"L{p}.{y}"] for p in range(1, y_lags + 1))
    fit.stats |= {f"long_run_{c}": float(sum(b[f"L{p}.{c}"] for p in range(x_lags + 1)) / rest) for c in x}
    return fit


def nardl(df: DataFrame, y: str, x: str, y_lags: int, x_lags: int, order_by: Sequence[str]) -> Fit:
    """ARDL on the cumulated positive and negative changes of x."""
    o = Ordered(df.select(*[col(c) for c in dict.fromkeys([*order_by, y, x])]), list(order_by))
    d = checkpoint(o.diff(x).withColumn("up", F.coalesce(F.greatest(F.col(f"{x}_diff_1"), F.lit(0.0)), F.lit(0.0))).withColumn("down", F.coalesce(F.least(F.col(f"{x}_diff_1"), F.lit(0.0)), F.lit(0.0))))
    both = Ordered(d, list(order_by)).cumsum("up", "down")
    z = both.select(*[col(c) for c in order_by], col(y), F.col("up_cumsum").alias(f"{x}_pos"), F.col("down_cumsum").alias(f"{x}_neg"))
    return ardl(z, y, [f"{x}_pos", f"{x}_neg"], y_lags, x_lags, order_by)


class VAR:
    """Vector autoregression from one Gram of current and lagged values."""

    def __init__(self, df: DataFrame, names: Sequence[str], lags: int, order_by: Sequence[str], *, intercept: bool = True):
        self.names, self.lags = list(names), lags
        d = lagged(df, names, lags, order_by)
        xs = (["const"] if intercept else []) + [f"{c}__l{p}" for p in range(1, lags + 1) for c in names]
        g = gram(d, {c: F.lit(1.0) if c == "const" else col(c) for c in xs} | {f"y:{c}": col(c) for c in names})
        yn = [f"y:{c}" for c in names]
        self.n, k = g.n, len(xs)
        if self.n <= k:
            raise ShapeMismatch("too few rows")
        xx, xy = g.pick(xs, xs), g.pick(xs, yn)
        self.params = solve_spd(xx, xy)
        resid = g.pick(yn, yn) - self.params.T @ xy
        self.sigma = resid / (self.n - k)
        self.sigma_ml = resid / self.n
        inv = np.linalg.inv(xx)
        self.fits = [Fit([x.replace("__l", ".L") for x in xs], self.params[:, i], self.sigma[i, i] * inv, self.n - k, {"n": self.n}) for i in range(len(names))]
        m = len(names)
        ld = float(np.linalg.slogdet(self.sigma_ml)[1])
        self.aic, self.bic = ld + 2 * k * m / self.n, ld + math.log(self.n) * k * m / self.n
        self.coefs = [self.params[(1 if intercept else 0) + p * m : (1 if intercept else 0) + (p + 1) * m].T for p in range(lags)]
        self.const = self.params[0] if intercept else np.zeros(m)

    def companion(self) -> np.ndarray:
        m = len(self.names)
        c = np.zeros((m * self.lags, m * self.lags))
        c[:m] = np.hstack(self.coefs)
        c[m:, : m * (self.lags - 1)] = np.eye(m * (self.lags - 1))
        return c

    def is_stable(self) -> bool:
        return bool(np.abs(np.linalg.eigvals(self.companion())).max() < 1)

    def irf(self, periods: int, *, orthogonal: bool = True, impact: np.ndarray | None = None) -> np.ndarray:
        """periods + 1 matrices of responses (row) to shocks (column)."""
        m, c = len(self.names), self.companion()
        p = impact if impact is not None else np.linalg.cholesky(self.sigma) if orthogonal else np.eye(m)
        out, power = [], np.eye(len(c))
        for _ in range(periods + 1):
            out.append(power[:m, :m] @ p)
            power = power @ c
        return np.array(out)

    def fevd(self, periods: int) -> np.ndarray:
        """Shares of shocks in the forecast error variance at each horizon from 1."""
        s = np.cumsum(self.irf(periods - 1) ** 2, axis=0)
        return s / s.sum(axis=2, keepdims=True)

    def forecast(self, last: np.ndarray, steps: int) -> np.ndarray:
        """last: the latest `lags` rows in time order."""
        rows = [np.asarray(r, float) for r in last]
        for _ in range(steps):
            rows.append(self.const + sum(a @ rows[-1 - p] for p, a in enumerate(self.coefs)))
        return np.array(rows[len(last) :])

    def svar(self, kind: str = "cholesky") -> np.ndarray:
        """Impact matrix: cholesky (also the recursive short-run scheme) or long_run (Blanchard-Quah)."""
        if kind in ("cholesky", "short_run"):
            return np.linalg.cholesky(self.sigma)
        if kind != "long_run":
            raise InvalidOperation(f"unknown identification {kind!r}")
        c1 = np.linalg.inv(np.eye(len(self.names)) - sum(self.coefs))
        return np.linalg.solve(c1, np.linalg.cholesky(c1 @ self.sigma @ c1.T))


#: 5 % critical values of the trace and maximum eigenvalue statistics with an unrestricted constant, by number of remaining relations.
JOHANSEN_TRACE_5 = (3.84, 15.49, 29.80, 47.86, 69.82, 95.75)
JOHANSEN_MAX_5 = (3.84, 14.26, 21.13, 27.58, 33.88, 40.08)


def johansen(df: DataFrame, names: Sequence[str], lags: int, order_by: Sequence[str]) -> dict[str, np.ndarray]:
    """Reduced-rank moments by partialling out lagged differences and a constant in one Gram."""
    d = lagged(df, names, lags + 1, order_by)
    lag = lambda c, p: F.col(f"{c}__l{p}") if p else col(c)
    z0 = {f"d:{c}": lag(c, 0) - lag(c, 1) for c in names}
    z1 = {f"l:{c}": lag(c, 1) for c in names}
    z2 = {f"x:{c}:{p}": lag(c, p) - lag(c, p + 1) for p in range(1, lags + 1) for c in names}
    g = gram(d, z0 | z1 | z2)
    m, s = len(names), g.centred / g.n
    a, b = s[: 2 * m, : 2 * m], s[: 2 * m, 2 * m :]
    r = a - b @ np.linalg.pinv(s[2 * m :, 2 * m :]) @ b.T if z2 else a
    s00, s01, s11 = r[:m, :m], r[:m, m:], r[m:, m:]
    l_ = np.linalg.cholesky(s11)
    inner = np.linalg.solve(l_, s01.T @ np.linalg.solve(s00, s01)) @ np.linalg.inv(l_).T
    val, vec = np.linalg.eigh((inner + inner.T) / 2)
    val, vec = np.clip(val[::-1], 0, 1 - 1e-15), np.linalg.solve(l_.T, vec[:, ::-1])
    logs = -g.n * np.log(1 - val)
    return {"eigenvalues": val, "vectors": vec, "trace": np.cumsum(logs[::-1])[::-1], "max_eig": logs, "trace_5": np.array(JOHANSEN_TRACE_5[:m][::-1]), "max_5": np.array(JOHANSEN_MAX_5[:m][::-1]), "n": np.array(g.n)}


def vecm(df: DataFrame, names: Sequence[str], rank: int, lags: int, order_by: Sequence[str]) -> dict[str, np.ndarray]:
    """Error-correction form: Johansen's beta, then least squares of differences on the relations and lagged differences."""
    beta = johansen(df, names, lags, order_by)["vectors"][:, :rank]
    beta = beta @ np.linalg.inv(beta[:rank])
    d = lagged(df, names, lags + 1, order_by)
    lag = lambda c, p: F.col(f"{c}__l{p}") if p else col(c)
    ec = {}
    for r in range(rank):
        e = F.lit(0.0)
        for i, c in enumerate(names):
            e = e + F.lit(float(beta[i, r])) * lag(c, 1)
        ec[f"ec{r + 1}"] = e
    x = {"const": F.lit(1.0)} | ec | {f"D{p}.{c}": lag(c, p) - lag(c, p + 1) for p in range(1, lags + 1) for c in names}
    fits = [fit_columns(d, lag(c, 0) - lag(c, 1), x) for c in names]
    params = np.array([f.params for f in fits])
    return {"beta": beta, "alpha": params[:, 1 : 1 + rank], "gamma": params[:, 1 + rank :], "const": params[:, 0]}


def varma(df: DataFrame, names: Sequence[str], p: int, q: int, order_by: Sequence[str]) -> np.ndarray:
    """Hannan-Rissanen: residuals of a long VAR stand in for the innovations; rows [const, AR lags, MA lags], columns equations."""
    n = df.count()
    long = max(p, q) + int(math.log(max(n, 3)))
    first = VAR(df, names, long, order_by)
    d = lagged(df, names, long, order_by)
    preds = {}
    for i, c in enumerate(names):
        e = F.lit(float(first.const[i]))
        for lag in range(1, long + 1):
            for j, b in enumerate(names):
                e = e + F.lit(float(first.coefs[lag - 1][i, j])) * F.col(f"{b}__l{lag}")
        preds[c] = e
    r = checkpoint(d.select("__pos", *[col(c) for c in names], *[(col(c) - e).alias(f"{c}__e") for c, e in preds.items()]))
    z = lagged(r, [*names, *[f"{c}__e" for c in names]], max(p, q), ["__pos"]) if max(p, q) else r
    x = {"const": F.lit(1.0)} | {f"{c}.L{i}": F.col(f"{c}__l{i}") for i in range(1, p + 1) for c in names} | {f"{c}.MA{i}": F.col(f"{c}__e__l{i}") for i in range(1, q + 1) for c in names}
    return np.array([fit_columns(z, col(c), x).params for c in names]).T


def decompose(df: DataFrame, name: str, period: int, order_by: Sequence[str], model: str = "additive") -> DataFrame:
    """Classical decomposition: centred moving average (half weights at even ends), seasonal means by position, remainder.

    Adds `trend`, `seasonal`, `resid`; the ends without a full average are NULL.
    """
    half = period // 2
    o = Ordered(df, list(order_by))
    x = col(name).cast("double")

    def make(w):
        if period % 2:
            return {"trend": F.avg(x).over(w.rowsBetween(-half, half)), "__n": F.count(x).over(w.rowsBetween(-half, half))}
        inner = F.sum(x).over(w.rowsBetween(-half + 1, half - 1))
        return {"trend": (inner + 0.5 * (F.lag(x, half).over(w) + F.lead(x, half).over(w))) / period, "__n": F.count(x).over(w.rowsBetween(-half, half))}

    d = o.with_neighbours(half, half, make)
    full = period if period % 2 else period + 1
    d = d.withColumn("trend", F.when(F.col("__n") == full, F.col("trend"))).withColumn("__k", F.col(o.pos) % period)
    d = checkpoint(d)
    ratio = x - F.col("trend") if model == "additive" else x / F.col("trend")
    s = d.where("trend is not null").groupBy("__k").agg(F.avg(ratio).alias("__s"))
    mean = s.agg(F.avg("__s")).first()[0] or (0.0 if model == "additive" else 1.0)
    s = s.select("__k", (F.col("__s") - mean if model == "additive" else F.col("__s") / mean).alias("seasonal"))
    d = d.join(s, "__k", "left")
    rest = x - F.col("trend") - F.col("seasonal") if model == "additive" else x / (F.col("trend") * F.col("seasonal"))
    return d.withColumn("resid", rest).select(*[col(c) for c in df.columns], "trend", "seasonal", "resid")


def bk_filter(df: DataFrame, name: str, order_by: Sequence[str], low: float = 6, high: float = 32, k: int = 12) -> DataFrame:
    """Baxter-King band-pass: symmetric weights over 2k + 1 rows; adds `cycle` (NULL at the ends)."""
    a, b = 2 * math.pi / high, 2 * math.pi / low
    w = np.array([(b - a) / math.pi] + [(math.sin(b * j) - math.sin(a * j)) / (math.pi * j) for j in range(1, k + 1)])
    w -= (w[0] + 2 * w[1:].sum()) / (2 * k + 1)
    o = Ordered(df, list(order_by))

    def make(win):
        e = F.lit(float(w[0])) * col(name)
        for j in range(1, k + 1):
            e = e + F.lit(float(w[j])) * (F.lag(col(name), j).over(win) + F.lead(col(name), j).over(win))
        return {"cycle": e}

    return o.with_neighbours(k, k, make).drop(o.pos)


def deterministic_process(df: DataFrame, order_by: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """terms: const, trend, seasonal:p (p - 1 dummies), fourier:p:k."""
    o = Ordered(df, list(order_by))
    t = F.col(o.pos)
    out = {}
    for term in terms:
        kind, *args = term.split(":")
        if kind == "const":
            out["const"] = F.lit(1.0)
        elif kind == "trend":
            out["trend"] = (t + 1).cast("double")
        elif kind == "seasonal":
            p = int(args[0])
            out |= {f"s{i}": F.when(t % p == i, 1.0).otherwise(0.0) for i in range(1, p)}
        elif kind == "fourier":
            p, k = int(args[0]), int(args[1])
            for i in range(1, k + 1):
                out |= {f"sin{i}_{p}": F.sin(2 * math.pi * i * t / p), f"cos{i}_{p}": F.cos(2 * math.pi * i * t / p)}
        else:
            raise InvalidOperation(f"unknown term {term!r}")
    return o.rows().select(*[col(c) for c in df.columns], *[e.alias(n) for n, e in out.items()])


def setar(df: DataFrame, name: str, lags: int, delay: int, order_by: Sequence[str], trim: float = 0.15) -> dict[str, object]:
    """Two-regime threshold autoregression: every distinct value of the threshold variable between the trimmed ends is tried.

    Grams are added per distinct value, running sums over the sorted values give every lower regime, and each task
    solves its own candidates; the least sum of squares (at ties the least threshold) is kept.
    """
    d = lagged(df, [name], max(lags, delay), order_by)
    v = [*[f"{name}__l{p}" for p in range(1, lags + 1)], name]
    k = lags + 2
    m = d.agg(F.count(F.lit(1)).alias("n"), *[f(col(c)).alias(f"{a}{i}") for i, c in enumerate(v) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = int(m["n"])
    # The intercept absorbs a shift, so centred and scaled columns give the same fit without loss of digits.
    mean, sd = np.array([m[f"m{i}"] for i in range(k - 1)]), np.array([m[f"s{i}"] or 1.0 for i in range(k - 1)])
    z = [F.lit(1.0), *[(col(c) - float(mean[i])) / float(sd[i]) for i, c in enumerate(v)]]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [f"m{i}_{j}" for i, j in pairs]
    by = d.groupBy(col(f"{name}__l{delay}").alias("q")).agg(*[F.sum(z[i] * z[j]).alias(c) for (i, j), c in zip(pairs, sums, strict=True)])

    def square(x: np.ndarray) -> np.ndarray:
        g = np.zeros((len(x), k, k))
        for c, (i, j) in enumerate(pairs):
            g[:, i, j] = g[:, j, i] = x[:, c]
        return g

    total = by.agg(*[F.sum(c).alias(c) for c in sums]).first()
    total = square(np.array([[total[c] for c in sums]]))
    cut = max(int(n * trim + 1e-9), k)
    seen = F.col("m0_0_cumsum")
    # Sorted positions of a value: seen - m0_0 to seen - 1.
    tried = Ordered(by, ["q"]).cumsum(*sums).where((seen > cut) & (seen - F.col("m0_0") < n - cut) & (seen >= k) & (n - seen >= k))

    def kernel(batches):
        best = None
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(sums) + 1)])
            if not len(x):
                continue
            low, ssr, betas = square(x[:, 1:]), 0.0, []
            for g in (low, total - low):
                beta = (np.linalg.pinv(g[:, :-1, :-1], rcond=1e-12, hermitian=True) @ g[:, :-1, -1:])[..., 0]
                ssr = ssr + np.maximum(g[:, -1, -1] - (beta * g[:, :-1, -1]).sum(1), 0)
                betas.append(beta)
            at = np.lexsort((x[:, 0], ssr))[0]
            if best is None or (ssr[at], x[at, 0]) < best[:2]:
                best = (float(ssr[at]), float(x[at, 0]), betas[0][at].tolist(), betas[1][at].tolist())
        if best:
            yield pa.RecordBatch.from_pydict({"ssr": [best[0]], "q": [best[1]], "low": [best[2]], "high": [best[3]]})

    found = tried.select(col("q").cast("double").alias("q"), *[F.col(f"{c}_cumsum").alias(c) for c in sums]).mapInArrow(kernel, "ssr double, q double, low array<double>, high array<double>")
    best = found.orderBy("ssr", "q").first()
    if best is None:
        raise InvalidOperation("no threshold leaves enough rows in both regimes")

    def unscale(b: Sequence[float]) -> np.ndarray:
        slopes = np.array(b[1:]) * sd[-1] / sd[:-1]
        return np.concatenate([[b[0] * sd[-1] + mean[-1] - slopes @ mean[:-1]], slopes])

    return {"ssr": float(best["ssr"] * sd[-1] ** 2), "threshold": float(best["q"]), "low": unscale(best["low"]), "high": unscale(best["high"]), "n": n}


def midas(df: DataFrame, y: str, x: str, lags: int, order_by: Sequence[str], n_grid: int = 25) -> dict[str, float]:
    """y on exponentially (Almon) weighted lags of x: the Gram of all lags is added once, the weight grid runs on the driver."""
    d = lagged(df, [x, y], lags, order_by)
    names = [x, *[f"{x}__l{p}" for p in range(1, lags)]]
    g = gram(d, {c: col(c) for c in names} | {"y": col(y)})
    k, s = len(names), g.centred
    best = (math.inf, 0.0, 0.0, 0.0)
    j = np.arange(k)
    for t1 in np.linspace(-0.5, 0.5, n_grid):
        for t2 in np.linspace(-0.2, 0.0, n_grid):
            w = np.exp(t1 * j + t2 * j * j)
            w /= w.sum()
            sxx, sxy = w @ s[:k, :k] @ w, w @ s[:k, k]
            b = sxy / sxx
            ssr = float(s[k, k] - b * sxy)
            if ssr < best[0]:
                best = (ssr, float(b), float(t1), float(t2))
    return {"ssr": best[0], "slope": best[1], "theta1": best[2], "theta2": best[3]}


def modwt(df: DataFrame, name: str, levels: int, order_by: Sequence[str]) -> DataFrame:
    """Maximal overlap Haar transform: w{j} and v{j} per level; NULL where the filter reaches before the start."""
    span = 2**levels
    o = Ordered(df, list(order_by))

    def make(w):
        out = {}
        for j in range(1, levels + 1):
            h = 2 ** (j - 1)
            recent, older = F.sum(col(name)).over(w.rowsBetween(-(h - 1), 0)), F.sum(col(name)).over(w.rowsBetween(-(2 * h - 1), -h))
            ok = F.col(o.pos) >= 2 * h - 1
            out |= {f"w{j}": F.when(ok, (recent - older) / (2 * h)), f"v{j}": F.when(ok, (recent + older) / (2 * h))}
        return out

    return o.with_neighbours(span, 0, make).drop(o.pos)


def tvar(df: DataFrame, names: Sequence[str], lags: int, threshold: str, delay: int, order_by: Sequence[str], n_grid: int = 100, trim: float = 0.15) -> dict[str, object]:
    """Two-regime threshold VAR: Grams per bin of the threshold variable in one job, the grid on the driver."""
    d = lagged(df, list(dict.fromkeys([*names, threshold])), max(lags, delay), order_by)
    q = F.col(f"{threshold}__l{delay}")
    cuts = sorted(set(d.agg(F.percentile_approx(q, [trim + (1 - 2 * trim) * i / (n_grid - 1) for i in range(n_grid)], 100000)).first()[0]))
    z = [F.lit(1.0), *[F.col(f"{c}__l{p}") for p in range(1, lags + 1) for c in names], *[col(c) for c in names]]
    k, m = len(z), len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cell = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda e: e < q))
    grams = np.zeros((len(cuts) + 1, k, k))
    for r in d.groupBy(cell.alias("c")).agg(*[F.sum(z[i] * z[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect():
        for i, j in pairs:
            grams[r["c"], i, j] = grams[r["c"], j, i] = r[f"m{i}_{j}"]
    low, total = np.cumsum(grams, axis=0), grams.sum(axis=0)
    best: tuple = (math.inf, None, None, None)
    for c in range(len(cuts)):
        parts = []
        for g in (low[c], total - low[c]):
            if g[0, 0] <= k:
                break
            b = np.linalg.lstsq(g[:-m, :-m], g[:-m, -m:], rcond=None)[0]
            parts.append((b, g[-m:, -m:] - b.T @ g[:-m, -m:]))
        if len(parts) == 2:
            ld = float(np.linalg.slogdet((parts[0][1] + parts[1][1]) / total[0, 0])[1])
            if ld < best[0]:
                best = (ld, float(cuts[c]), parts[0][0], parts[1][0])
    return {"log_det": best[0], "threshold": best[1], "low": best[2], "high": best[3]}


def quantile_var(df: DataFrame, names: Sequence[str], lags: int, tau: float, order_by: Sequence[str]) -> dict[str, Fit]:
    """One quantile regression per equation on all lags."""
    from gramforge.models.linear import quantile_regression

    d = lagged(df, names, lags, order_by)
    rhs = " + ".join(f"{c}__l{p}" for p in range(1, lags + 1) for c in names)
    return {c: quantile_regression(d, f"{c} ~ {rhs}", tau) for c in names}


def mixed_frequency_var(df: DataFrame, low: Sequence[str], high: Sequence[str], period: str, lags: int) -> VAR:
    """High-frequency columns are averaged to the low-frequency period, then a VAR."""
    names = [*low, *high]
    return VAR(df.groupBy(col(period)).agg(*[F.avg(col(c)).alias(c) for c in names]), names, lags, [period])

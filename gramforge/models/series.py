"""Inherently sequential models, one kernel per series, all series in parallel.

`per_series` gives every series to one task in time order; a series longer than `max_rows` is refused, as these recursions need
their whole past. Kernels are plain numpy functions from a vector to named numbers or to columns of the same length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.plans.optimise import nelder_mead
from gramforge.util import col, require

MAX_ROWS = 2_000_000


def per_series(df: DataFrame, series: Sequence[str], order_by: Sequence[str], value: str, kernel: Callable[[np.ndarray], dict], fields: Sequence[str], *, rowwise: bool = False, max_rows: int = MAX_ROWS) -> DataFrame:
    """rowwise: the kernel's vectors become columns beside (series, order_by, value); else one row per series.

    Missing values are dropped first. A series the kernel cannot fit (too short, singular) gives NULLs.
    """
    require(df, *series, *order_by, value)
    keep = df.select(*[col(c) for c in dict.fromkeys([*series, *order_by])], col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    sizes = keep.groupBy(*[col(s) for s in series]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows)
    if sizes.limit(1).count():
        raise InvalidOperation(f"a series has over {max_rows} rows")
    kinds = dict(keep.dtypes)
    made = ", ".join(f"`{f}` double" for f in fields)
    head = list(dict.fromkeys([*series, *order_by])) if rowwise else list(series)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in head] + ([f"`{value}` double"] if rowwise else []) + [made])

    def run(pdf):
        pdf = pdf.sort_values(list(order_by), kind="stable")
        v = pdf["__v"].to_numpy(float)
        try:
            out = kernel(v)
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError, IndexError, OverflowError):
            out = {f: np.full(len(v), np.nan) if rowwise else math.nan for f in fields}
        if rowwise:
            return pd.DataFrame({c: pdf[c].to_numpy() for c in head} | {value: v} | {f: np.asarray(out[f], float) for f in fields})
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in head} | {f: [float(out[f])] for f in fields})

    return keep.groupBy(*[col(s) for s in series]).applyInPandas(run, schema)


# filters
def hp_filter(y: np.ndarray, lam: float = 1600.0) -> dict:
    """Pentadiagonal (I + lam K'K) trend = y by banded LDL'."""
    n = len(y)
    if n < 4:
        raise ValueError("needs 4 values")
    d = np.full(n, 1 + 6 * lam)
    d[[0, -1]], d[[1, -2]] = 1 + lam, 1 + 5 * lam
    e, f = np.full(n, -4 * lam), np.full(n, lam)
    e[0], e[n - 2] = -2 * lam, -2 * lam
    dd, l1, l2 = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        dd[i] = d[i] - (l1[i - 1] ** 2 * dd[i - 1] if i > 0 else 0) - (l2[i - 2] ** 2 * dd[i - 2] if i > 1 else 0)
        if i + 1 < n:
            l1[i] = (e[i] - (l1[i - 1] * l2[i - 1] * dd[i - 1] if i > 0 else 0)) / dd[i]
        if i + 2 < n:
            l2[i] = f[i] / dd[i]
    z = np.array(y, float)
    for i in range(n):
        z[i] -= (l1[i - 1] * z[i - 1] if i > 0 else 0) + (l2[i - 2] * z[i - 2] if i > 1 else 0)
    z /= dd
    for i in range(n - 1, -1, -1):
        z[i] -= (l1[i] * z[i + 1] if i + 1 < n else 0) + (l2[i] * z[i + 2] if i + 2 < n else 0)
    return {"trend": z, "cycle": y - z}


def cf_filter(y: np.ndarray, low: float = 6, high: float = 32) -> dict:
    """Christiano-Fitzgerald asymmetric band-pass for a random walk with drift removed."""
    n = len(y)
    x = y - np.arange(n) * (y[-1] - y[0]) / (n - 1)
    a, b = 2 * math.pi / high, 2 * math.pi / low
    j = np.arange(1, n + 1)
    w = np.concatenate([[(b - a) / math.pi], (np.sin(b * j) - np.sin(a * j)) / (math.pi * j)])
    out = np.zeros(n)
    for t in range(n):
        fwd, back = w[1 : n - 1 - t + 1], w[1 : t + 1]
        end = -0.5 * w[0] - w[1 : n - 1 - t].sum() if t < n - 1 else -0.5 * w[0]
        start = -0.5 * w[0] - w[1:t].sum() if t > 0 else -0.5 * w[0]
        v = w[0] * x[t]
        if t < n - 1:
            v += (fwd[:-1] * x[t + 1 : n - 1]).sum() + end * x[n - 1]
        else:
            v += end * x[n - 1]
        if t > 0:
            v += (back[:-1] * x[t - 1 : 0 : -1]).sum() + start * x[0]
        else:
            v += start * x[0]
        out[t] = v
    return {"cycle": out, "trend": y - out}


def _loess(y: np.ndarray, x: np.ndarray, at: np.ndarray, span: int, robust: np.ndarray) -> np.ndarray:
    out = np.empty(len(at))
    n, span = len(x), min(span, len(x))
    for k, a in enumerate(at):
        i = int(np.clip(np.searchsorted(x, a) - span // 2, 0, n - span))
        xs, ys, r = x[i : i + span], y[i : i + span], robust[i : i + span]
        h = max(np.abs(xs - a).max(), 1e-12) * 1.0001
        w = (1 - (np.abs(xs - a) / h) ** 3) ** 3 * r
        sw = w.sum()
        if sw <= 0:
            out[k] = ys.mean()
            continue
        m = (w * xs).sum() / sw
        v = (w * (xs - m) ** 2).sum()
        out[k] = (w * ys).sum() / sw + ((w * (xs - m) * ys).sum() / v * (a - m) if v > 1e-12 else 0.0)
    return out


def stl(y: np.ndarray, period: int, seasonal: int = 7, outer: int = 0, inner: int = 2) -> dict:
    """Seasonal-trend decomposition by local regression."""
    n = len(y)
    if n < 2 * period:
        raise ValueError("needs two periods")
    t, trend, robust = np.arange(n, dtype=float), np.zeros(n), np.ones(n)
    span_t = int(math.ceil(1.5 * period / (1 - 1.5 / seasonal))) | 1
    for o in range(outer + 1):
        for _ in range(inner):
            d = y - trend
            cyc = np.zeros(n + 2 * period)
            for k in range(period):
                xs = np.arange(k, n, period)
                i = np.arange(len(xs), dtype=float)
                cyc[k :: period][: len(xs) + 2] = _loess(d[xs], i, np.arange(-1, len(xs) + 1, dtype=float), seasonal, robust[xs])
            ma = lambda v, w: np.convolve(v, np.ones(w) / w, "valid")
            low = ma(ma(ma(cyc, period), period), 3)
            low = _loess(low[:n], t, t, period | 1, np.ones(n))
            season = cyc[period : period + n] - low
            trend = _loess(y - season, t, t, span_t, robust)
        if o < outer:
            r = np.abs(y - trend - season)
            h = 6 * np.median(r)
            robust = np.clip(1 - (r / h) ** 2, 0, None) ** 2 if h > 0 else np.ones(n)
    return {"trend": trend, "seasonal": season, "resid": y - trend - season}


def mstl(y: np.ndarray, periods: Sequence[int], rounds: int = 2) -> dict:
    """Several seasonal components, each refined in turn on the series without the others."""
    seasons = {p: np.zeros(len(y)) for p in sorted(periods)}
    for _ in range(rounds):
        for p in seasons:
            rest = y - sum(s for q, s in seasons.items() if q != p)
            out = stl(rest, p)
            seasons[p] = out["seasonal"]
    total = sum(seasons.values())
    return {"trend": out["trend"], "seasonal": total, "resid": y - total - out["trend"]}


# ARIMA by conditional sums of squares
def _arma_residuals(w: np.ndarray, c: float, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    p, q, n = len(ar), len(ma), len(w)
    e = np.zeros(n)
    base = w - c
    for i, a in enumerate(ar, 1):
        base[i:] -= a * (w[:-i] - c)
    if not q:
        return base[p:]
    for t in range(p, n):
        e[t] = base[t] - sum(ma[j] * e[t - 1 - j] for j in range(min(q, t)))
    return e[p:]


def arima(y: np.ndarray, p: int = 1, d: int = 0, q: int = 0, steps: int = 1) -> dict:
    """ARIMA(p, d, q): conditional least squares; returns const, ar, ma, sigma2, aic and the forecast `steps` ahead."""
    w = np.diff(y, d) if d else np.array(y, float)
    n = len(w)
    if n < p + q + 3:
        raise ValueError("too short")
    c0 = w.mean()

    def unpack(b):
        return b[0], b[1 : 1 + p], b[1 + p :]

    def loss(b):
        c, ar, ma = unpack(b)
        if np.abs(ar).sum() > 5 or np.abs(ma).sum() > 5:
            return math.inf
        with np.errstate(over="ignore", invalid="ignore"):
            return float(np.square(_arma_residuals(w, c, ar, ma)).sum())

    if q == 0:
        x = np.column_stack([np.ones(n - p), *[w[p - i : n - i] for i in range(1, p + 1)]])
        b = np.linalg.lstsq(x, w[p:], rcond=None)[0]
        ar = b[1:]
        best = np.concatenate([[b[0] / (1 - ar.sum()) if abs(1 - ar.sum()) > 1e-8 else c0], ar])
        ss = loss(best)
    else:
        best, ss = nelder_mead(loss, [c0, *[0.1] * p, *[0.1] * q], step=0.2)
    c, ar, ma = unpack(best)
    e = np.concatenate([np.zeros(p), _arma_residuals(w, c, ar, ma)])
    hist, err = list(w), list(e)
    for _ in range(steps):
        hist.append(c + sum(a * (hist[-1 - i] - c) for i, a in enumerate(ar)) + sum(m * err[-1 - j] for j, m in enumerate(ma)))
        err.append(0.0)
    fc = np.array(hist[n:])
    for k in range(d, 0, -1):
        fc = np.cumsum(np.concatenate([[np.diff(y, k - 1)[-1]], fc]))[1:]
    m = n - p
    s2 = ss / m
    return {"const": c, "sigma2": s2, "aic": m * math.log(s2) + 2 * (p + q + 1), "forecast": fc[-1]} | {f"ar{i + 1}": a for i, a in enumerate(ar)} | {f"ma{i + 1}": a for i, a in enumerate(ma)}


# exponential smoothing
def ets(y: np.ndarray, trend: bool = False, seasonal: int = 0, damped: bool = False, multiplicative: bool = False, steps: int = 1) -> dict:
    """Additive-error exponential smoothing with optional (damped) trend and additive or multiplicative season."""
    n = len(y)
    m = max(seasonal, 1)
    if n < 2 * m + 2:
        raise ValueError("too short")
    level0 = y[:m].mean()
    trend0 = (y[m : 2 * m].mean() - level0) / m if trend else 0.0
    s0 = (y[:m] / level0 if multiplicative else y[:m] - level0) if seasonal else np.zeros(1)

    def run(b):
        a, be, g, phi = b
        lv, tr, s, err = level0, trend0, list(s0), np.empty(n)
        for t in range(n):
            sea = s[t % m] if seasonal else (1.0 if multiplicative else 0.0)
            base = lv + phi * tr
            f = base * sea if multiplicative and seasonal else base + sea
            err[t] = y[t] - f
            obs = (y[t] / sea if sea else y[t]) if multiplicative and seasonal else y[t] - sea
            new = a * obs + (1 - a) * base
            if trend:
                tr = be * (new - lv) + (1 - be) * phi * tr
            if seasonal:
                s[t % m] = g * ((y[t] / new if new else 1.0) if multiplicative else y[t] - new) + (1 - g) * sea
            lv = new
        return err, lv, tr, s

    free = [0] + ([1] if trend else []) + ([2] if seasonal else []) + ([3] if damped and trend else [])
    full = np.array([0.3, 0.1, 0.1, 1.0])

    def put(b):
        v = full.copy()
        v[free] = 1 / (1 + np.exp(-np.clip(b, -30, 30)))
        if 3 in free:
            v[3] = 0.8 + 0.2 * v[3]
        return v

    b, ss = nelder_mead(lambda b: float(np.square(run(put(b))[0]).sum()), np.zeros(len(free)) - 0.5, step=0.5, max_iter=400)
    v = put(b)
    _, lv, tr, s = run(v)
    fc = lv + tr * sum(v[3] ** i for i in range(1, steps + 1))
    if seasonal:
        sea = s[(n + steps - 1) % m]
        fc = fc * sea if multiplicative else fc + sea
    return {"alpha": v[0], "beta": v[1] if trend else math.nan, "gamma": v[2] if seasonal else math.nan, "phi": v[3], "sse": ss, "level": lv, "forecast": fc, "aic": n * math.log(max(ss, 1e-300) / n) + 2 * (len(free) + 2)}


# volatility
def _garch_path(y2: np.ndarray, y: np.ndarray, b: np.ndarray, kind: str, h0: float) -> np.ndarray:
    h = np.empty(len(y2))
    h[0] = h0
    if kind == "egarch":
        lh = math.log(h0)
        root = math.sqrt(2 / math.pi)
        for t in range(1, len(y)):
            z = y[t - 1] / math.exp(lh / 2)
            lh = min(max(b[0] + b[1] * (abs(z) - root) + b[3] * z + b[2] * lh, -50.0), 50.0)
            h[t] = math.exp(lh)
        return h
    g = b[3] if kind == "gjr" else 0.0
    for t in range(1, len(y2)):
        h[t] = b[0] + (b[1] + (g if y[t - 1] < 0 else 0.0)) * y2[t - 1] + b[2] * h[t - 1]
    return h


def garch(y: np.ndarray, kind: str = "garch") -> dict:
    """(1,1) models by Gaussian likelihood of the demeaned series: garch, egarch or gjr."""
    if len(y) < 20:
        raise ValueError("too short")
    r = y - y.mean()
    v = float(r.var())
    r2 = r * r

    def nll(b):
        if kind != "egarch" and (b[0] <= 0 or b[1] < 0 or b[2] < 0 or b[1] + b[2] + (0.5 * b[3] if kind == "gjr" else 0) >= 0.9999 or (kind == "gjr" and b[1] + b[3] < 0)):
            return math.inf
        if kind == "egarch" and abs(b[2]) >= 0.9999:
            return math.inf
        h = _garch_path(r2, r, b, kind, v)
        return 0.5 * float((np.log(2 * math.pi * h) + r2 / h).sum())

    start = [0.1 * math.log(v), 0.1, 0.9, 0.0] if kind == "egarch" else [0.05 * v, 0.05, 0.9, 0.02]
    b, f = nelder_mead(nll, start if kind != "garch" else start[:3], step=0.05, max_iter=1200)
    h = _garch_path(r2, r, b, kind, v)
    last = _garch_path(np.append(r2, 0), np.append(r, 0), b, kind, v)[-1]
    return {"omega": b[0], "alpha": b[1], "beta": b[2], "gamma": b[3] if len(b) > 3 else 0.0, "log_likelihood": -f, "last_variance": h[-1], "forecast_variance": last}


# state space
def local_level(y: np.ndarray) -> dict:
    """Random walk plus noise by the Kalman filter, variances by likelihood; smoothed level included."""
    n = len(y)
    if n < 5:
        raise ValueError("too short")

    def filt(b):
        ve, vu = np.exp(np.clip(b, -40, 40))
        a, p, ll = y[0], ve + 1e6 * vu, 0.0
        at, pt, vs, fs = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
        for t in range(n):
            v, f = y[t] - a, p + ve
            at[t], pt[t], vs[t], fs[t] = a, p, v, f
            if t:
                ll -= 0.5 * (math.log(2 * math.pi * f) + v * v / f)
            k = p / f
            a, p = a + k * v, p * (1 - k) + vu
        return ll, at, pt, vs, fs

    s = math.log(max(y.var(), 1e-12))
    b, f = nelder_mead(lambda b: -filt(b)[0], [s - 0.7, s - 2.0], step=0.5, max_iter=300)
    _, at, pt, vs, fs = filt(b)
    r, level = 0.0, np.empty(n)
    for t in range(n - 1, -1, -1):
        r = vs[t] / fs[t] + (1 - pt[t] / fs[t]) * r
        level[t] = at[t] + pt[t] * r
    return {"level": level, "var_noise": math.exp(b[0]), "var_level": math.exp(b[1]), "log_likelihood": -f}


def kalman_filter(y: np.ndarray, t: np.ndarray, z: np.ndarray, q: np.ndarray, h: np.ndarray, a0: np.ndarray, p0: np.ndarray) -> dict:
    """General linear filter and smoother for rows of y (NaN rows are skipped)."""
    n, m = len(y), len(a0)
    a, p, ll = np.array(a0, float), np.array(p0, float), 0.0
    ap, pp, af, pf = np.empty((n, m)), np.empty((n, m, m)), np.empty((n, m)), np.empty((n, m, m))
    for i in range(n):
        a, p = t @ a, t @ p @ t.T + q
        ap[i], pp[i] = a, p
        if not np.isnan(y[i]).any():
            v, f = y[i] - z @ a, z @ p @ z.T + h
            k = np.linalg.solve(f, z @ p).T
            ll -= 0.5 * (len(v) * math.log(2 * math.pi) + np.linalg.slogdet(f)[1] + v @ np.linalg.solve(f, v))
            a, p = a + k @ v, p - k @ z @ p
        af[i], pf[i] = a, p
    s, ps = af.copy(), pf.copy()
    for i in range(n - 2, -1, -1):
        j = np.linalg.solve(pp[i + 1], t @ pf[i]).T
        s[i] = af[i] + j @ (s[i + 1] - ap[i + 1])
        ps[i] = pf[i] + j @ (ps[i + 1] - pp[i + 1]) @ j.T
    return {"filtered": af, "smoothed": s, "smoothed_cov": ps, "log_likelihood": float(ll)}


def unobserved_components(y: np.ndarray) -> dict:
    """Local linear trend: level, slope and noise variances by likelihood."""
    t, z = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    s = math.log(max(np.diff(y).var(), 1e-12))

    def run(b):
        v = np.exp(np.clip(b, -40, 40))
        return kalman_filter(y[:, None], t, z, np.diag(v[:2]), np.array([[v[2]]]), np.array([y[0], 0.0]), np.eye(2) * 1e6)

    b, f = nelder_mead(lambda b: -run(b)["log_likelihood"], [s - 1, s - 4, s - 1], step=0.5, max_iter=250)
    out = run(b)
    return {"level": out["smoothed"][:, 0], "slope": out["smoothed"][:, 1], "log_likelihood": -f}


def markov_switching(y: np.ndarray, order: int = 0, max_iter: int = 200) -> dict:
    """Two Gaussian regimes with switching mean (and autoregression of the given order), by EM with the Hamilton filter and Kim smoother."""
    n = len(y) - order
    if n < 10:
        raise ValueError("too short")
    x = np.column_stack([np.ones(n), *[y[order - i : len(y) - i] for i in range(1, order + 1)]])
    w = y[order:]
    lo, hi = np.quantile(w, [0.25, 0.75])
    b = np.zeros((2, order + 1))
    b[0, 0], b[1, 0] = lo, hi
    s2 = np.full(2, w.var())
    p = np.array([[0.9, 0.1], [0.1, 0.9]])
    old = -math.inf
    for _ in range(max_iter):
        dens = np.exp(-0.5 * (w[:, None] - x @ b.T) ** 2 / s2) / np.sqrt(2 * math.pi * s2) + 1e-300
        filt, pred = np.empty((n, 2)), np.empty((n, 2))
        cur, ll = np.array([p[1, 0], p[0, 1]]) / max(p[1, 0] + p[0, 1], 1e-12), 0.0
        for t in range(n):
            pred[t] = cur
            j = cur * dens[t]
            tot = j.sum()
            ll += math.log(tot)
            filt[t] = j / tot
            cur = filt[t] @ p
        sm, joint = filt.copy(), np.zeros((2, 2))
        for t in range(n - 2, -1, -1):
            ratio = sm[t + 1] / np.maximum(pred[t + 1], 1e-300)
            joint += filt[t][:, None] * p * ratio[None, :]
            sm[t] = filt[t] * (p @ ratio)
        p = joint / joint.sum(axis=1, keepdims=True)
        for k in range(2):
            g = sm[:, k]
            b[k] = np.linalg.lstsq(x * np.sqrt(g)[:, None], w * np.sqrt(g), rcond=None)[0]
            s2[k] = max((g * (w - x @ b[k]) ** 2).sum() / g.sum(), 1e-8 * w.var())
        if abs(ll - old) < 1e-8 * (1 + abs(ll)):
            break
        old = ll
    if b[0, 0] > b[1, 0]:
        b, s2, p, sm = b[::-1], s2[::-1], p[::-1, ::-1], sm[:, ::-1]
    return {"mean_low": b[0, 0], "mean_high": b[1, 0], "var_low": s2[0], "var_high": s2[1], "stay_low": p[0, 0], "stay_high": p[1, 1], "log_likelihood": ll, "share_high": sm[:, 1].mean()}


def hawkes(times: np.ndarray) -> dict:
    """Exponential self-exciting process by its O(n) likelihood recursion: base rate mu, jump alpha, decay beta."""
    t = np.sort(times) - times.min()
    end, gaps = t[-1], np.diff(np.sort(times))
    if len(t) < 5 or end <= 0:
        raise ValueError("too short")

    def nll(b):
        mu, a, d = np.exp(np.clip(b, -30, 30))
        if a >= d:
            return math.inf
        r, ll = 0.0, math.log(mu)
        for g in gaps:
            r = (r + 1) * math.exp(-d * g)
            ll += math.log(mu + a * r)
        return -(ll - mu * end - a / d * (1 - np.exp(-d * (end - t))).sum())

    rate = len(t) / end
    b, f = nelder_mead(nll, np.log([rate * 0.6, rate * 0.5, rate * 1.5]), step=0.3, max_iter=500)
    mu, a, d = np.exp(b)
    return {"mu": mu, "alpha": a, "beta": d, "branching": a / d, "log_likelihood": -f}


def cusum(e: np.ndarray) -> dict:
    """Largest scaled cumulated sum of recursive residuals against the 5 % line."""
    s = np.cumsum(e) / e.std(ddof=1)
    n = len(e)
    line = 0.948 * (math.sqrt(n) + 2 * np.arange(1, n + 1) / math.sqrt(n))
    return {"max_ratio": float(np.abs(s / line).max())}


def recursive_ls(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Coefficients after every row, by rank-one updates."""
    k = x.shape[1]
    p, b, out = np.eye(k) * 1e8, np.zeros(k), np.empty((len(y), k))
    for i in range(len(y)):
        g = p @ x[i] / (1 + x[i] @ p @ x[i])
        b = b + g * (y[i] - x[i] @ b)
        p = p - np.outer(g, x[i] @ p)
        out[i] = b
    return out


def stochastic_volatility(y: np.ndarray) -> dict:
    """Quasi-likelihood: log squared returns as an AR(1) state plus noise of variance pi^2/2, by the Kalman filter."""
    if len(y) < 20:
        raise ValueError("too short")
    r = y - y.mean()
    z = np.log(r * r + 1e-4 * r.var()) + 1.2703628454614782

    def nll(b):
        mu, phi, s2 = b[0], math.tanh(b[1]), math.exp(min(max(b[2], -30), 10))
        h, p, out = mu, s2 / max(1 - phi * phi, 1e-6), 0.0
        for v in z:
            f = p + math.pi**2 / 2
            e = v - h
            out += 0.5 * (math.log(2 * math.pi * f) + e * e / f)
            k = p / f
            h, p = mu + phi * (h + k * e - mu), phi * phi * p * (1 - k) + s2
        return out

    b, f = nelder_mead(nll, [z.mean(), 1.5, -2.0], step=0.3, max_iter=400)
    return {"mu": b[0], "phi": math.tanh(b[1]), "sigma2": math.exp(b[2]), "log_likelihood": -f}


def tvp_regression(y: np.ndarray, x: np.ndarray) -> dict:
    """Random-walk coefficients; the ratio of state to noise variance by likelihood, smoothed coefficients by row."""
    k = x.shape[1]
    ols = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = float(np.square(y - x @ ols).mean())

    def run(q, smooth=False):
        a, p, ll = ols.copy(), np.eye(k) * 10.0, 0.0
        ap, pp, af, pf = [], [], [], []
        for t in range(len(y)):
            p = p + np.eye(k) * q
            ap.append(a)
            pp.append(p)
            f = x[t] @ p @ x[t] + 1.0
            e = y[t] - x[t] @ a
            g = p @ x[t] / f
            a, p = a + g * e, p - np.outer(g, x[t] @ p)
            af.append(a)
            pf.append(p)
            ll -= 0.5 * (math.log(2 * math.pi * f * s2) + e * e / (f * s2))
        if not smooth:
            return ll
        out = [af[-1]]
        for t in range(len(y) - 2, -1, -1):
            out.append(af[t] + pf[t] @ np.linalg.solve(pp[t + 1], out[-1] - ap[t + 1]))
        return np.array(out[::-1])

    b, f = nelder_mead(lambda b: -run(math.exp(min(max(b[0], -25), 5))), [-4.0], step=1.0, max_iter=60)
    q = math.exp(b[0])
    return {"coefficients": run(q, True), "ratio": q, "log_likelihood": -f}


def dcc_garch(y: np.ndarray) -> dict:
    """Univariate GARCH(1,1) per column, then Engle's dynamic correlations; y has one row per period."""
    n, m = y.shape
    z = np.empty((n, m))
    for i in range(m):
        g = garch(y[:, i])
        r = y[:, i] - y[:, i].mean()
        z[:, i] = r / np.sqrt(_garch_path(r * r, r, np.array([g["omega"], g["alpha"], g["beta"]]), "garch", float(r.var())))
    s = np.corrcoef(z.T)

    def path(a, b):
        q, out = s.copy(), np.empty((n, m, m))
        for t in range(n):
            d = np.sqrt(np.diag(q))
            out[t] = q / np.outer(d, d)
            q = (1 - a - b) * s + a * np.outer(z[t], z[t]) + b * q
        return out

    def nll(v):
        if v[0] < 0 or v[1] < 0 or v.sum() >= 0.999:
            return math.inf
        r = path(*v)
        return 0.5 * float((np.linalg.slogdet(r)[1] + np.einsum("ti,tij,tj->t", z, np.linalg.inv(r), z)).sum())

    v, f = nelder_mead(nll, [0.03, 0.9], step=0.03, max_iter=150)
    return {"a": v[0], "b": v[1], "correlations": path(*v), "quasi_log_likelihood": -f}


def dynamic_factor(y: np.ndarray, factors: int = 1) -> dict:
    """Two steps: principal components with a VAR(1), then Kalman smoothing of the factors."""
    z = (y - y.mean(0)) / y.std(0)
    _, v = np.linalg.eigh(np.cov(z.T))
    load = v[:, ::-1][:, :factors] * math.sqrt(z.shape[1])
    f = z @ load / z.shape[1]
    a = np.linalg.lstsq(f[:-1], f[1:], rcond=None)[0].T
    q = np.cov((f[1:] - f[:-1] @ a.T).T).reshape(factors, factors)
    h = np.diag(np.maximum((z - f @ load.T).var(0), 1e-6))
    out = kalman_filter(z, a, load, q, h, np.zeros(factors), np.eye(factors))
    return {"factors": out["smoothed"], "loadings": load, "transition": a, "log_likelihood": out["log_likelihood"]}


def fmols(y: np.ndarray, x: np.ndarray) -> dict:
    """Fully modified least squares with a Bartlett long-run covariance; x without the constant."""
    n, k = x.shape
    d = np.column_stack([np.ones(n), x])
    b = np.linalg.lstsq(d, y, rcond=None)[0]
    u = np.column_stack([(y - d @ b)[1:], np.diff(x, axis=0)])
    u = u - u.mean(0)
    lags = int(4 * (n / 100) ** (2 / 9))
    g = [u[j:].T @ u[: len(u) - j] / len(u) for j in range(lags + 1)]
    w = [1 - j / (lags + 1) for j in range(lags + 1)]
    omega = g[0] + sum(w[j] * (g[j] + g[j].T) for j in range(1, lags + 1))
    delta = sum(w[j] * g[j].T for j in range(lags + 1))
    inv = np.linalg.inv(omega[1:, 1:])
    yp = y[1:] - u[:, 1:] @ inv @ omega[1:, 0]
    dp = delta[1:, 0] - delta[1:, 1:] @ inv @ omega[1:, 0]
    x1 = d[1:]
    a = np.linalg.inv(x1.T @ x1)
    beta = a @ (x1.T @ yp - len(yp) * np.concatenate([[0.0], dp]))
    s2 = omega[0, 0] - omega[0, 1:] @ inv @ omega[1:, 0]
    return {"params": beta, "std_errors": np.sqrt(np.diag(a) * s2)}

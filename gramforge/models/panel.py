"""Panel estimators from two-level aggregates: rows are reduced to group sums, group sums to Gram matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import InvalidOperation, OptimizationFailed, ShapeMismatch, SingularMatrix
from gramforge.models.linear import Cov, fit_columns, iv, sandwich
from gramforge.models.results import Fit
from gramforge.operators.ordered import Ordered
from gramforge.plans.moments import gram, inverse_spd, linear, outer_sum, solve_spd
from gramforge.util import checkpoint, col, join_on

#: Periods of a dynamic panel.
MAX_PERIODS = 200
MAX_INSTRUMENTS = 2000


def _project(df: DataFrame, y: str, x: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in keep], *[col(c).cast("double").alias(f"z{i}") for i, c in enumerate([*x, y])])


def group_moments(z: DataFrame, key: str, k: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, dict[str, float]]:
    """(rows, groups, total cross products, sum n m m', sum m m', size statistics) of z0..z{k-1} by `key`, in one two-level job."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    g = z.groupBy(col(key)).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(k)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}_{j}") for i, j in pairs])
    m = [F.col(f"s{i}") / F.col("n") for i in range(k)]
    r = g.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(1 / F.col("n")).alias("hn"),
        *[F.sum(f"q{i}_{j}").alias(f"t{i}_{j}") for i, j in pairs], *[F.sum(F.col("n") * m[i] * m[j]).alias(f"b{i}_{j}") for i, j in pairs],
        *[F.sum(m[i] * m[j]).alias(f"u{i}_{j}") for i, j in pairs], *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)], *[F.sum(m[i]).alias(f"m{i}") for i in range(k)],
    ).first()

    def sym(p: str) -> np.ndarray:
        out = np.zeros((k, k))
        for i, j in pairs:
            out[i, j] = out[j, i] = r[f"{p}{i}_{j}"]
        return out

    extra = {"inv_n": float(r["hn"])} | {f"s{i}": float(r[f"s{i}"]) for i in range(k)} | {f"m{i}": float(r[f"m{i}"]) for i in range(k)}
    return int(r["n"]), int(r["g"]), sym("t"), sym("b"), sym("u"), extra


def demean(df: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """Columns minus their group means; the means are an aggregate joined back, no window over a group."""
    means = df.groupBy(col(key)).agg(*[F.avg(col(c)).alias(f"__m{i}") for i, c in enumerate(names)])
    x = join_on(df, means, [key])
    return x.select(*[(col(c) - F.col(f"__m{names.index(c)}")).alias(c) if c in names else col(c) for c in df.columns])


def fixed_effects(df: DataFrame, y: str, x: Sequence[str], entity: str, cov: Cov = Cov(), *, time: str | None = None) -> Fit:  # noqa: B008
    """Within estimator. Nonrobust one-way needs no row shuffle beyond group sums; with `time` (balanced panels) both effects are removed."""
    k = len(x)
    if time is None and cov.kind == "nonrobust":
        # Centring by the grand mean first keeps the difference of cross products accurate.
        means = df.agg(*[F.avg(col(c).cast("double")) for c in [*x, y]]).first()
        z = df.select(col(entity), *[(col(c).cast("double") - F.lit(float(m))).alias(f"z{i}") for i, (c, m) in enumerate(zip([*x, y], means, strict=True))])
        n, g, t, b, _, _ = group_moments(z, entity, k + 1)
        w = t - b
        beta = np.linalg.solve(w[:k, :k], w[:k, k])
        ssr = float(w[k, k] - beta @ w[:k, k])
        dof = n - g - k
        if dof <= 0:
            raise ShapeMismatch("no degrees of freedom")
        s2 = ssr / dof
        return Fit(list(x), beta, s2 * np.linalg.inv(w[:k, :k]), dof, {"n": n, "entities": g, "ssr": ssr, "sigma": math.sqrt(s2), "r_squared_within": 1 - ssr / w[k, k]}, [col(c) for c in x])
    names = [*x, y]
    d = demean(df.select(*[col(c).cast("double").alias(c) if c in names else col(c) for c in dict.fromkeys([*names, entity, *([time] if time else []), *cov.clusters])]), names, entity)
    if time:
        d = demean(d, names, time)
    d = checkpoint(d)
    fit = fit_columns(d, col(y), {c: col(c) for c in x})
    n, g = int(fit.stats["n"]), d.select(col(entity)).distinct().count()
    t = d.select(col(time)).distinct().count() - 1 if time else 0
    dof = n - g - t - k
    exprs = [col(c) for c in x]
    bread = inverse_spd(gram(d, {c: col(c) for c in x}).raw)
    v = fit.stats["ssr"] / dof * bread if cov.kind == "nonrobust" else sandwich(d, exprs, col(y) - linear(fit.params, exprs), bread, n, cov)
    return Fit(list(x), fit.params, v, dof, {"n": n, "entities": g, "ssr": fit.stats["ssr"], "sigma": math.sqrt(fit.stats["ssr"] / dof), "r_squared_within": fit.stats["r_squared"]}, exprs)


def entity_effects(df: DataFrame, fit: Fit, y: str, x: Sequence[str], entity: str) -> DataFrame:
    return df.groupBy(col(entity)).agg((F.avg(col(y)) - linear(fit.params, [F.avg(col(c)) for c in x])).alias("effect"))


def between(df: DataFrame, y: str, x: Sequence[str], entity: str) -> Fit:
    g = df.groupBy(col(entity)).agg(*[F.avg(col(c).cast("double")).alias(c) for c in [*x, y]])
    return fit_columns(g, col(y), {"const": F.lit(1.0)} | {c: col(c) for c in x})


def random_effects(df: DataFrame, y: str, x: Sequence[str], entity: str) -> Fit:
    """Swamy-Arora feasible GLS on quasi-demeaned rows; theta varies with the size of the group."""
    fe = fixed_effects(df, y, x, entity)
    be = between(df, y, x, entity)
    k = len(x)
    z = _project(df, y, x, [entity])
    n, g, _, _, _, extra = group_moments(z, entity, k + 1)
    se2 = fe.stats["sigma"] ** 2
    tbar = g / extra["inv_n"]
    su2 = max(0.0, be.stats["ssr"] / (g - k - 1) - se2 / tbar)
    means = z.groupBy(col(entity)).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(k + 1)])
    j = join_on(z, means, [entity])
    theta = 1 - F.sqrt(F.lit(se2) / (F.lit(se2) + F.col("__n") * su2))
    q = j.select((1 - theta).alias("c"), *[(F.col(f"z{i}") - theta * F.col(f"m{i}")).alias(f"q{i}") for i in range(k + 1)])
    fit = fit_columns(q, F.col(f"q{k}"), {"_c": F.col("c")} | {c: F.col(f"q{i}") for i, c in enumerate(x)})
    return Fit(["const", *x], fit.params, fit.cov, fit.df_resid, {"n": n, "entities": g, "sigma_e2": se2, "sigma_u2": su2, "ssr": fit.stats["ssr"]}, [F.lit(1.0), *[col(c) for c in x]])


def hausman(fe: Fit, re: Fit) -> tuple[float, float]:
    """(statistic, p) on the slopes both have."""
    at = [re.names.index(n) for n in fe.names]
    d = fe.params - re.params[at]
    h = float(d @ np.linalg.pinv(fe.cov - re.cov[np.ix_(at, at)]) @ d)
    return h, dist.chi2_sf(h, len(d))


def robust_hausman(df: DataFrame, y: str, x: Sequence[str], entity: str) -> tuple[float, float]:
    """Cluster-robust Wald test of the group means in the pooled regression."""
    fit, names = mundlak(df, y, x, entity)
    r = np.array([[1.0 if n == m else 0.0 for n in fit.names] for m in names])
    d = r @ fit.params
    w = float(d @ np.linalg.solve(r @ fit.cov @ r.T, d))
    return w, dist.chi2_sf(w, len(names))


def mundlak(df: DataFrame, y: str, x: Sequence[str], entity: str) -> tuple[Fit, list[str]]:
    """Pooled regression with group means of the regressors, clustered by entity."""
    means = df.groupBy(col(entity)).agg(*[F.avg(col(c)).alias(f"mean_{c}") for c in x])
    j = join_on(df.select(col(entity), *[col(c) for c in dict.fromkeys([*x, y])]), means, [entity])
    names = [f"mean_{c}" for c in x]
    return fit_columns(j, col(y), {"const": F.lit(1.0)} | {c: col(c) for c in [*x, *names]}, Cov("cluster", clusters=[entity])), names


def f_test_fixed_effects(df: DataFrame, y: str, x: Sequence[str], entity: str) -> tuple[float, float]:
    fe = fixed_effects(df, y, x, entity)
    pool = fit_columns(df, col(y), {"const": F.lit(1.0)} | {c: col(c) for c in x})
    g = fe.stats["entities"]
    f = (pool.stats["ssr"] - fe.stats["ssr"]) / (g - 1) / (fe.stats["ssr"] / fe.df_resid)
    return f, dist.f_sf(f, g - 1, fe.df_resid)


def breusch_pagan_lm(df: DataFrame, y: str, x: Sequence[str], entity: str) -> tuple[float, float]:
    """(n/2) (sum T ebar^2 / sum e^2 - 1)^2 / (Tbar - 1)."""
    pool = fit_columns(df, col(y), {"const": F.lit(1.0)} | {c: col(c) for c in x})
    e = col(y) - pool.predictor()
    g = df.select(col(entity).alias("g"), e.alias("e")).groupBy("g").agg(F.count(F.lit(1)).alias("t"), F.avg("e").alias("m"), F.sum(F.col("e") * F.col("e")).alias("q"))
    r = g.agg(F.sum("t").alias("n"), F.count(F.lit(1)).alias("g"), F.sum((F.col("t") * F.col("m")) * (F.col("t") * F.col("m"))).alias("a"), F.sum("q").alias("q")).first()
    tbar = r["n"] / r["g"]
    lm = r["n"] / 2 * (r["a"] / r["q"] - 1) ** 2 / (tbar - 1)
    return lm, dist.chi2_sf(lm, 1)


def fe_2sls(df: DataFrame, y: str, x: Sequence[str], z: Sequence[str], entity: str) -> Fit:
    """Within transformation of response, regressors and instruments, then two-stage least squares."""
    names = list(dict.fromkeys([y, *x, *z]))
    d = checkpoint(demean(df.select(col(entity), *[col(c).cast("double").alias(c) for c in names]), names, entity))
    fit = iv(d, col(y), {c: col(c) for c in x}, {c: col(c) for c in z})
    g = d.select(col(entity)).distinct().count()
    n, k = int(fit.stats["n"]), len(x)
    scale = (n - k) / (n - g - k)
    return Fit(fit.names, fit.params, fit.cov * scale, n - g - k, fit.stats | {"entities": g}, fit.exprs)


def first_differences(df: DataFrame, y: str, x: Sequence[str], entity: str, time: str) -> DataFrame:
    o = Ordered(df.select(col(entity), col(time), *[col(c).cast("double").alias(c) for c in dict.fromkeys([*x, y])]), [time], [entity])
    names = list(dict.fromkeys([*x, y]))
    d = o.with_neighbours(1, 0, lambda w: {f"d_{c}": col(c) - F.lag(col(c)).over(w) for c in names})
    return d.where(F.col(o.pos) >= 1)


def wooldridge_serial(df: DataFrame, y: str, x: Sequence[str], entity: str, time: str) -> tuple[float, float]:
    """Regress first-difference residuals on their lag; H0 rho = -1/2, clustered by entity."""
    d = checkpoint(first_differences(df, y, x, entity, time))
    fit = fit_columns(d, col(f"d_{y}"), {f"d_{c}": col(f"d_{c}") for c in x})
    o = Ordered(d.select(col(entity), col(time), (col(f"d_{y}") - fit.predictor()).alias("e")), [time], [entity])
    lagged = checkpoint(o.lag("e").where("e_lag_1 is not null"))
    r = fit_columns(lagged, F.col("e"), {"rho": F.col("e_lag_1")}, Cov("cluster", clusters=[entity]))
    t = (r.params[0] + 0.5) / r.se[0]
    return float(t * t), dist.f_sf(float(t * t), 1, r.stats["n"] - 1)


def pesaran_cd(df: DataFrame, residual: str, entity: str, time: str) -> tuple[float, float]:
    """sqrt(2 / (N (N-1))) sum_{i<j} sqrt(T) rho_ij over a balanced panel.

    The double sum over entities equals half of (sum_t (sum_i u_it)^2 - N) with u the entity's standardised residuals over
    sqrt(T), so no pair of entities is ever formed.
    """
    stats = df.groupBy(col(entity)).agg(F.avg(col(residual)).alias("m"), F.stddev_pop(col(residual)).alias("s"), F.count(F.lit(1)).alias("__c"))
    j = join_on(df.select(col(entity), col(time), col(residual).alias("e")), stats, [entity]).where("s > 0")
    per = j.select(col(time).alias("__t"), ((F.col("e") - F.col("m")) / F.col("s") / F.sqrt("__c")).alias("u")).groupBy("__t").agg(F.sum("u").alias("u"))
    n, t = stats.where("s > 0").agg(F.count(F.lit(1)), F.max("__c")).first()
    total = per.agg(F.sum(F.col("u") * F.col("u"))).first()[0]
    cd = math.sqrt(2 / (n * (n - 1))) * math.sqrt(t) * (total - n) / 2
    return cd, dist.norm_two_sided(cd)


def fama_macbeth(df: DataFrame, y: str, x: Sequence[str], time: str, *, lags: int = 0) -> Fit:
    """Cross-section moments per period, solved in Arrow batches; mean and standard error of the coefficients over periods.

    Periods with fewer rows than columns + 1 or singular moments are left out.
    """
    k = len(x) + 1
    z = [F.lit(1.0), *[col(c).cast("double") for c in x], col(y).cast("double")]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    m = df.groupBy(col(time).alias("t")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(z[i] * z[j]).alias(f"m{i}_{j}") for i, j in pairs]).where(F.col("n") > k)

    def kernel(s: pd.Series) -> pd.Series:
        out = []
        for row in s:
            a = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, row, strict=True):
                a[i, j] = a[j, i] = v
            out.append(np.linalg.solve(a[:k, :k], a[:k, k]).tolist() if np.linalg.cond(a[:k, :k]) < 1e14 else None)
        return pd.Series(out)

    b = m.select("t", F.pandas_udf(kernel, "array<double>")(F.array(*[F.col(f"m{i}_{j}") for i, j in pairs])).alias("b")).where("b is not null")
    b = b.select("t", *[F.col("b")[i].alias(f"b{i}") for i in range(k)])
    if lags:
        # Periods are few against rows: their coefficients are the reduced data.
        o = Ordered(b, ["t"])
        l_ = o.with_neighbours(lags, 0, lambda w: {f"l{p}_{i}": F.lag(f"b{i}", p).over(w) for p in range(1, lags + 1) for i in range(k)})
    else:
        l_ = b
    head = b.agg(F.count(F.lit(1)).alias("t"), *[F.avg(f"b{i}").alias(f"b{i}") for i in range(k)]).first()
    t, mean = head["t"], np.array([head[f"b{i}"] for i in range(k)])
    if t < 2:
        raise InvalidOperation("fewer than two usable periods")
    d = [F.col(f"b{i}") - F.lit(float(mean[i])) for i in range(k)]
    terms = [F.sum(d[i] * d[i]).alias(f"v0_{i}") for i in range(k)] + [F.sum(d[i] * (F.col(f"l{p}_{i}") - F.lit(float(mean[i])))).alias(f"v{p}_{i}") for p in range(1, lags + 1) for i in range(k)]
    r = l_.agg(*terms).first()
    var = np.array([(r[f"v0_{i}"] / (t - 1) if not lags else (r[f"v0_{i}"] + 2 * sum((1 - p / (lags + 1)) * (r[f"v{p}_{i}"] or 0) for p in range(1, lags + 1))) / t) / t for i in range(k)])
    return Fit(["const", *x], mean, np.diag(var), t - 1, {"periods": t}, z[:k])


def _entity_kernel(df: DataFrame, entity: str, size: int, func) -> np.ndarray:
    """Sum over entities of a flat vector computed from each entity's rows (an entity's own series is in one task, which emits one vector)."""

    def kernel(batches):
        total, rest = np.zeros(size), None
        for b in batches:
            groups = [g for _, g in (b if rest is None else pd.concat([rest, b])).groupby(entity, sort=False, dropna=False)]
            # The last entity may go on in the next batch.
            rest = groups.pop() if groups else rest
            for g in groups:
                o = func(g)
                np.add.at(total, o["i"].to_numpy(int), o["s"].to_numpy(float))
        if rest is not None:
            o = func(rest)
            np.add.at(total, o["i"].to_numpy(int), o["s"].to_numpy(float))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at, "s": total[at]})

    out = df.repartition(col(entity)).sortWithinPartitions(col(entity)).mapInPandas(kernel, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    v = np.zeros(size)
    for r in out:
        v[r["i"]] = r["s"]
    return v


def arellano_bond(df: DataFrame, y: str, x: Sequence[str], entity: str, time: str, *, max_lag: int = 99, two_step: bool = True, system: bool = False) -> Fit:
    """Difference (or system) GMM for y_it = rho y_i,t-1 + x'b + a_i + e_it with instruments y_i,t-2, ... and the differenced x.

    Periods are the sorted distinct times (at most MAX_PERIODS); instruments grow with their square and more than MAX_INSTRUMENTS are an
    error, as every task adds matrices of that size. max_lag limits how many lags of y serve as instruments of a period (99: all of up to 100 periods).
    """
    times = [r[0] for r in df.select(col(time)).distinct().orderBy(col(time)).limit(MAX_PERIODS + 1).collect()]
    if len(times) > MAX_PERIODS:
        raise InvalidOperation(f"over {MAX_PERIODS} periods")
    t_at = {t: i for i, t in enumerate(times)}
    cap, k = len(times), 1 + len(x)
    blocks: list[tuple[int, int]] = [(t, s) for t in range(2, cap) for s in range(max(0, t - 1 - max_lag), t - 1)]
    nz = len(blocks) + len(x) + ((cap - 2 + 1 + len(x)) if system else 0)
    if nz > MAX_INSTRUMENTS:
        raise InvalidOperation(f"{nz} instruments, over {MAX_INSTRUMENTS}: lower max_lag or use coarser periods")
    pos = {b: i for i, b in enumerate(blocks)}

    def parts(pdf: pd.DataFrame):
        n = np.array([t_at[t] for t in pdf[time]])
        yy = np.full(cap, np.nan)
        xx = np.full((cap, len(x)), np.nan)
        yy[n] = pdf[y].to_numpy(float)
        xx[n] = pdf[list(x)].to_numpy(float)
        rows_z, rows_w, rows_y, kind = [], [], [], []
        for t in range(2, cap):
            if np.isnan([yy[t], yy[t - 1], yy[t - 2], *xx[t], *xx[t - 1]]).any():
                continue
            z = np.zeros(nz)
            for s in range(max(0, t - 1 - max_lag), t - 1):
                if not math.isnan(yy[s]):
                    z[pos[t, s]] = yy[s]
            z[len(blocks) : len(blocks) + len(x)] = xx[t] - xx[t - 1]
            rows_z.append(z)
            rows_w.append([yy[t - 1] - yy[t - 2], *(xx[t] - xx[t - 1])] + ([0.0] if system else []))
            rows_y.append(yy[t] - yy[t - 1])
            kind.append(t)
            if system:
                z = np.zeros(nz)
                z[len(blocks) + len(x) + t - 2] = yy[t - 1] - yy[t - 2]
                z[len(blocks) + len(x) + cap - 2] = 1.0
                z[len(blocks) + len(x) + cap - 1 :] = xx[t]
                rows_z.append(z)
                rows_w.append([yy[t - 1], *xx[t], 1.0])
                rows_y.append(yy[t])
                kind.append(-t)
        kd = k + (1 if system else 0)
        return np.array(rows_z).reshape(-1, nz), np.array(rows_w).reshape(-1, kd), np.array(rows_y), np.array(kind)

    kd = k + (1 if system else 0)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        z, w, yv, kind = parts(pdf)
        h = np.eye(len(yv)) * np.where(kind > 0, 2.0, 1.0)
        for a in range(len(yv)):
            for b in range(len(yv)):
                if kind[a] > 0 and kind[b] > 0 and abs(kind[a] - kind[b]) == 1:
                    h[a, b] = -1.0
        v = np.concatenate([(z.T @ h @ z).ravel(), (z.T @ w).ravel(), z.T @ yv, [len(yv)]])
        return pd.DataFrame({"i": np.flatnonzero(v), "s": v[np.flatnonzero(v)]})

    src = df.select(col(entity), col(time), *[col(c).cast("double").alias(c) for c in dict.fromkeys([y, *x])])
    size = nz * nz + nz * kd + nz + 1
    v = _entity_kernel(src, entity, size, first)
    zhz, zw, zy, n = v[: nz * nz].reshape(nz, nz), v[nz * nz : nz * nz + nz * kd].reshape(nz, kd), v[-nz - 1 : -1], int(v[-1])
    a1 = np.linalg.pinv(zhz)
    inv1 = np.linalg.inv(zw.T @ a1 @ zw)
    beta = inv1 @ zw.T @ a1 @ zy

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        z, w, yv, _ = parts(pdf)
        g = z.T @ (yv - w @ beta)
        q = np.outer(g, g).ravel()
        return pd.DataFrame({"i": np.flatnonzero(q), "s": q[np.flatnonzero(q)]})

    s = _entity_kernel(src, entity, nz * nz, second).reshape(nz, nz)
    cov = inv1 @ zw.T @ a1 @ s @ a1 @ zw @ inv1
    weight = np.linalg.pinv(s)
    if two_step:
        inv2 = np.linalg.inv(zw.T @ weight @ zw)
        beta = inv2 @ zw.T @ weight @ zy
        cov = inv2
    m = zy - zw @ beta
    j, over = float(m @ weight @ m), int(np.linalg.matrix_rank(zhz)) - kd
    return Fit([f"{y}_lag1", *x, *(["const"] if system else [])], beta, cov, math.inf, {"n": n, "instruments": nz, "hansen_j": j, "hansen_p": dist.chi2_sf(j, over) if over > 0 else math.nan})


def system_gmm(df: DataFrame, y: str, x: Sequence[str], entity: str, time: str, **kwargs) -> Fit:
    return arellano_bond(df, y, x, entity, time, system=True, **kwargs)


def panel_threshold(df: DataFrame, y: str, x: Sequence[str], threshold: str, entity: str, *, n_grid: int | None = None, trim: float = 0.15) -> dict[str, float]:
    """One threshold, two regimes with own slopes. Every distinct threshold value between the trimmed ends is tried; above 300 of them
    every (number / 100)-th (the reference's rule), and with `n_grid` at most that many.

    All candidates share one job: sums per entity and bin of the threshold variable, running sums over an entity's bins
    (no more than candidates + 1), then sums per bin, which the driver accumulates.
    """
    k = len(x)
    q = col(threshold).cast("double")
    first = df.agg(F.avg(col(y).cast("double")).alias("m"), F.count_if(q.isNull() | F.isnan(q)).alias("bad")).first()
    if first["bad"]:
        raise InvalidOperation(f"{first['bad']} rows hold no threshold value")
    values = Ordered(df.select(q.alias("q")).distinct(), ["q"])
    n_values = values.rows().count()
    cut = math.ceil(n_values * trim)
    n_tried = n_values - 2 * cut
    if n_tried < 5:
        raise OptimizationFailed("not enough distinct values of the threshold variable")
    step = n_tried // 100 if n_tried > 300 else 1
    if n_grid is not None:
        step = max(step, math.ceil(n_tried / n_grid))
    at = F.col(values.pos) - cut
    cuts = sorted(r["q"] for r in values.rows().where((at >= 0) & (at < n_tried) & (at % step == 0)).collect())
    cell = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda e: e < q))
    # Entity effects absorb a shift of y, but not of x, whose regimes change over time.
    v = [*[col(c).cast("double") for c in x], col(y).cast("double") - float(first["m"])]
    z = df.select(col(entity).alias("e"), cell.alias("c"), *[e.alias(f"z{i}") for i, e in enumerate(v)])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    z = z.groupBy("e", "c").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"d{i}") for i in range(k + 1)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}_{j}") for i, j in pairs])
    whole = Window.partitionBy("e")
    before = whole.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    z = z.select(
        "*", F.sum("n").over(whole).alias("m"), *[F.sum(f"d{i}").over(whole).alias(f"s{i}") for i in range(k + 1)],
        *[F.coalesce(F.sum(f"d{i}").over(before), F.lit(0.0)).alias(f"l{i}") for i in range(k)],
    )
    low = [(i, j) for i in range(k) for j in range(i, k)]
    grown = {(i, j): (F.col(f"l{i}") * F.col(f"d{j}") + F.col(f"d{i}") * F.col(f"l{j}") + F.col(f"d{i}") * F.col(f"d{j}")) / F.col("m") for i, j in low}
    rows = z.groupBy("c").agg(
        *[F.sum(f"q{i}_{j}").alias(f"q{i}_{j}") for i, j in pairs], *[F.sum(e).alias(f"u{i}_{j}") for (i, j), e in grown.items()],
        *[F.sum(F.col(f"d{i}") * F.col(f"s{j}") / F.col("m")).alias(f"b{i}_{j}") for i in range(k + 1) for j in range(k + 1)],
    ).collect()
    own, square, mixed = np.zeros((len(cuts) + 1, k + 1, k + 1)), np.zeros((len(cuts) + 1, k, k)), np.zeros((len(cuts) + 1, k + 1, k + 1))
    for r in rows:
        for i, j in pairs:
            own[r["c"], i, j] = own[r["c"], j, i] = r[f"q{i}_{j}"]
        for i, j in low:
            square[r["c"], i, j] = square[r["c"], j, i] = r[f"u{i}_{j}"]
        mixed[r["c"]] = [[r[f"b{i}_{j}"] for j in range(k + 1)] for i in range(k + 1)]
    total, between = own.sum(axis=0), mixed.sum(axis=0)
    own, square, mixed = own.cumsum(axis=0), square.cumsum(axis=0), mixed.cumsum(axis=0)
    best = None
    for c, value in enumerate(cuts):
        ll, lh = own[c, :k, :k] - square[c], square[c] - mixed[c, :k, :k]
        hh = (total - own[c])[:k, :k] - (between[:k, :k] - mixed[c, :k, :k] - mixed[c, :k, :k].T + square[c])
        a = np.block([[ll, lh], [lh.T, hh]])
        ly = own[c, :k, k] - mixed[c, :k, k]
        b = np.concatenate([ly, total[:k, k] - between[:k, k] - ly])
        try:
            beta = solve_spd(a, b)
        except SingularMatrix:
            continue
        ssr = float(total[k, k] - between[k, k] - beta @ b)
        if best is None or ssr < best[0]:
            best = (ssr, value, beta)
    if best is None:
        raise OptimizationFailed("no threshold gives two estimable regimes")
    ssr, c, beta = best
    return {"threshold": float(c), "ssr": ssr} | {f"{v}_low": float(beta[i]) for i, v in enumerate(x)} | {f"{v}_high": float(beta[k + i]) for i, v in enumerate(x)}


def pcse(df: DataFrame, y: str, x: Sequence[str], entity: str, time: str) -> Fit:
    """Pooled least squares with panel-corrected errors (Beck and Katz) for a balanced panel of T periods.

    With s_ij = e_i'e_j / T, the sum over i, j of s_ij X_i'X_j equals the sum over pairs of periods (t, u) of h h' / T, where
    h = sum_i x_it e_iu: every row meets the T residuals of its entity, and no matrix of entities is built.
    """
    fit = fit_columns(df, col(y), {"const": F.lit(1.0)} | {c: col(c) for c in x})
    k = len(fit.names)
    z = checkpoint(df.select(col(entity).alias("i"), col(time).alias("t"), (col(y).cast("double") - fit.predictor()).alias("e"), *[c.cast("double").alias(f"x{j}") for j, c in enumerate(fit.exprs)]))
    size = z.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("g"), F.count_distinct("t").alias("t"), F.count_distinct("i", "t").alias("c")).first()
    periods = size["t"]
    if not size["n"] == size["c"] == size["g"] * periods:
        raise InvalidOperation("unbalanced panel: every entity needs one row in every period")
    other = z.select("i", F.col("t").alias("u"), F.col("e").alias("r"))
    h = z.join(other, "i").groupBy("t", "u").agg(*[F.sum(F.col(f"x{j}") * F.col("r")).alias(f"h{j}") for j in range(k)])
    meat = outer_sum(h, [F.col(f"h{j}") for j in range(k)], F.lit(1.0 / periods))
    bread = fit.cov / fit.stats["sigma"] ** 2
    return Fit(fit.names, fit.params, bread @ meat @ bread, fit.df_resid, fit.stats, fit.exprs)


def panel_quantile(df: DataFrame, y: str, x: Sequence[str], entity: str, tau: float) -> Fit:
    """Two-step fixed-effects quantile regression: effects from the within fit are subtracted, then a quantile fit."""
    from gramforge.models.linear import quantile_regression

    fe = fixed_effects(df, y, x, entity)
    j = join_on(df.select(col(entity), *[col(c) for c in dict.fromkeys([*x, y])]), entity_effects(df, fe, y, x, entity), [entity])
    return quantile_regression(j.withColumn(y, col(y) - F.col("effect")), f"{y} ~ {' + '.join(x)}", tau)


def panel_var(df: DataFrame, names: Sequence[str], entity: str, time: str, lags: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Within-transformed VAR: (coefficients (m*lags x m), residual covariance)."""
    o = Ordered(df.select(col(entity), col(time), *[col(c).cast("double").alias(c) for c in names]), [time], [entity])
    l_ = o.with_neighbours(lags, 0, lambda w: {f"{c}__l{p}": F.lag(col(c), p).over(w) for p in range(1, lags + 1) for c in names}).where(F.col(o.pos) >= lags)
    xs = [f"{c}__l{p}" for p in range(1, lags + 1) for c in names]
    z = l_.select(col(entity), *[col(c).alias(f"z{i}") for i, c in enumerate([*xs, *names])])
    n, g, t, b, _, _ = group_moments(z, entity, len(xs) + len(names))
    w = t - b
    k = len(xs)
    a = np.linalg.solve(w[:k, :k], w[:k, k:])
    return a, (w[k:, k:] - a.T @ w[:k, k:]) / (n - g - k)


def panel_gls(df: DataFrame, y: str, x: Sequence[str], entity: str) -> Fit:
    """Feasible GLS for groupwise heteroskedasticity: weights from the pooled residuals' variance per entity."""
    reg = {"const": F.lit(1.0)} | {c: col(c) for c in x}
    pool = fit_columns(df, col(y), reg)
    e = col(y) - pool.predictor()
    v = df.groupBy(col(entity)).agg((1 / F.greatest(F.avg(e * e), F.lit(1e-12))).alias("__w"))
    j = join_on(df.select(col(entity), *[col(c) for c in dict.fromkeys([*x, y])]), v, [entity])
    return fit_columns(j, col(y), reg, weight=F.col("__w"))


def panel_heckman(df: DataFrame, formula: str, selection: str, entity: str) -> tuple[Fit, Fit]:
    """Two-step selection model with entity means of the selection regressors (Mundlak-Chamberlain) in both equations."""
    from gramforge.formula import Formula
    from gramforge.models.glm import heckman

    f, s = Formula.parse(formula), Formula.parse(selection)
    z = list(dict.fromkeys(t[0].name for t in s.terms))
    means = df.groupBy(col(entity)).agg(*[F.avg(col(c)).alias(f"mean_{c}") for c in z])
    wide = join_on(df, means, [entity])
    extra = " + ".join(f"mean_{c}" for c in z)
    return heckman(wide, f"{f.response} ~ {' + '.join(t[0].name for t in f.terms)} + {extra}", f"{s.response} ~ {' + '.join(z)} + {extra}")


def factor_panel(df: DataFrame, y: str, x: Sequence[str], entity: str, factors: int) -> Fit:
    """Regressors are replaced by their principal components, then the within estimator."""
    from gramforge.models.multivariate import PCA

    z = PCA.fit(df, x, factors).transform(df.select(col(entity), *[col(c) for c in dict.fromkeys([*x, y])]), "factor")
    return fixed_effects(z, y, [f"factor{i + 1}" for i in range(factors)], entity)


def pstr(df: DataFrame, y: str, x: Sequence[str], transition: str, entity: str, *, n_centres: int = 10, slopes: Sequence[float] = (1.0, 5.0, 20.0), trim: float = 0.1) -> dict[str, float]:
    """Panel smooth transition: x b + g(q) x d with logistic g over a grid of slopes and centres; every grid point is one two-level job."""
    k = len(x)
    sd, qs = df.agg(F.stddev_samp(col(transition)), F.percentile_approx(col(transition), [trim + (1 - 2 * trim) * i / (n_centres - 1) for i in range(n_centres)], 100000)).first()
    base = checkpoint(df.select(col(entity), (col(transition) / F.lit(sd or 1.0)).alias("__q"), *[col(c).cast("double").alias(f"z{i}") for i, c in enumerate([*x, y])]))
    best = None
    for gamma in slopes:
        for c in sorted(set(qs)):
            g = 1 / (1 + F.exp(-F.lit(gamma) * (F.col("__q") - float(c) / (sd or 1.0))))
            z = base.select(col(entity), *[F.col(f"z{i}") for i in range(k)], *[(F.col(f"z{i}") * g).alias(f"z{k + i}") for i in range(k)], F.col(f"z{k}").alias(f"z{2 * k}"))
            _, _, t, b, _, _ = group_moments(z, entity, 2 * k + 1)
            w = t - b
            beta = np.linalg.lstsq(w[:-1, :-1], w[:-1, -1], rcond=None)[0]
            ssr = float(w[-1, -1] - beta @ w[:-1, -1])
            if best is None or ssr < best[0]:
                best = (ssr, float(c), gamma, beta)
    ssr, c, gamma, beta = best
    return {"centre": c, "slope": gamma, "ssr": ssr} | {f"{v}_low": float(beta[i]) for i, v in enumerate(x)} | {f"{v}_change": float(beta[k + i]) for i, v in enumerate(x)}

"""Multiple imputation by chained equations and by Gaussian conditionals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.plans.moments import gram, linear
from gramforge.util import checkpoint, col, is_missing


def mice(df: DataFrame, names: Sequence[str], *, imputations: int = 5, rounds: int = 5, ridge: float = 1e-6, seed: int = 42) -> list[DataFrame]:
    """Each missing column in turn is drawn from a regression on the others; one Gram per column and round, rows stay in place."""
    flags = {c: f"__miss{i}" for i, c in enumerate(names)}
    base = df.select("*", *[is_missing(df, c).alias(f) for c, f in flags.items()])
    means = base.agg(*[F.avg(F.when(~col(flags[c]), col(c).cast("double"))).alias(c) for c in names]).first()
    gone = base.agg(*[F.count_if(col(f)).alias(c) for c, f in flags.items()]).first()
    start = base
    for c in names:
        start = start.withColumn(c, F.when(col(flags[c]), F.lit(means[c])).otherwise(col(c).cast("double")))
    out = []
    for m in range(imputations):
        x = start
        for r in range(rounds):
            for i, c in enumerate(names):
                if not gone[c]:
                    continue
                others = {"const": F.lit(1.0)} | {o: col(o) for o in names if o != c}
                g = gram(x.where(~col(flags[c])), others | {"__y": col(c)})
                k = list(others)
                xx, xy = g.pick(k, k), g.pick(k, ["__y"])[:, 0]
                b = np.linalg.solve(xx + ridge * np.diag(np.diag(xx)), xy)
                s2 = max(float(g.pick(["__y"], ["__y"])[0, 0] - 2 * b @ xy + b @ xx @ b) / g.n, 0.0)
                draw = linear(b, list(others.values())) + F.randn(seed + 1000 * m + 10 * r + i) * math.sqrt(s2)
                x = x.withColumn(c, F.when(col(flags[c]), draw).otherwise(col(c)))
            x = checkpoint(x)
        out.append(x.drop(*flags.values()))
    return out


def gaussian_mi(df: DataFrame, names: Sequence[str], *, seed: int = 0, rounds: int = 20) -> DataFrame:
    """EM for mean and covariance over missing-data patterns (bounded by 2^columns), then one conditional draw per missing value."""
    k = len(names)
    bits = F.concat(*[F.when(is_missing(df, c), "1").otherwise("0") for c in names])
    x = checkpoint(df.withColumn("__p", bits))
    v = [F.when(is_missing(df, c), 0.0).otherwise(col(c).cast("double")) for c in names]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = x.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v[i]).alias(f"s{i}") for i in range(k)], *[F.sum(v[i] * v[j]).alias(f"q{i}_{j}") for i, j in pairs]).collect()
    pats = []
    for r in rows:
        q = np.zeros((k, k))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        pats.append((np.array([c == "1" for c in r["__p"]]), r["n"], np.array([r[f"s{i}"] for i in range(k)]), q))
    n = sum(p[1] for p in pats)
    seen = np.array([sum(p[1] for p in pats if not p[0][i]) for i in range(k)])
    mu = sum(p[2] for p in pats) / np.maximum(seen, 1)
    var = sum(np.diag(p[3]) for p in pats) / np.maximum(seen, 1) - mu**2
    cov = np.diag(np.maximum(var, 1e-9))
    maps = {}
    for _ in range(rounds):
        t1, t2 = np.zeros(k), np.zeros((k, k))
        for miss, m, s, q in pats:
            o, h = ~miss, miss
            b = cov[np.ix_(h, o)] @ np.linalg.pinv(cov[np.ix_(o, o)]) if o.any() else np.zeros((h.sum(), 0))
            a = mu[h] - b @ mu[o]
            full = np.zeros((k, k + 1))
            full[o, :k] = np.eye(k)[o]
            full[np.ix_(h, np.flatnonzero(o))] = b
            full[h, k] = a
            z = np.block([[q, s[:, None]], [s[None, :], np.array([[m]])]])
            rest = cov[np.ix_(h, h)] - b @ cov[np.ix_(o, h)]
            t1 += full @ np.append(s, m)
            t2 += full @ z @ full.T
            t2[np.ix_(h, h)] += m * rest
            maps["".join("1" if f else "0" for f in miss)] = (h, full, rest)
        mu, cov = t1 / n, t2 / n - np.outer(t1 / n, t1 / n) + 1e-12 * np.eye(k)
    out = {}
    for i, c in enumerate(names):
        e = col(c).cast("double")
        for p, (h, full, rest) in maps.items():
            if h[i]:
                root = np.linalg.cholesky(rest + 1e-12 * np.eye(len(rest)))
                row = root[list(np.flatnonzero(h)).index(i)]
                draw = linear(full[i, :k], v) + float(full[i, k])
                for j, w in enumerate(row):
                    draw = draw + F.randn(seed + j) * float(w)
                e = F.when(F.col("__p") == p, draw).otherwise(e)
        out[c] = e
    return x.select(*[out[c].alias(c) if c in names else col(c) for c in df.columns])

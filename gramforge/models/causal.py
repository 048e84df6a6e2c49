"""Causal estimators from grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import InvalidOperation
from gramforge.formula import Formula
from gramforge.models.glm import logit
from gramforge.models.linear import Cov, fit_columns
from gramforge.models.results import Fit
from gramforge.operators.ordered import Ordered
from gramforge.plans.moments import linear
from gramforge.util import checkpoint, col


def diff_in_diff(df: DataFrame, y: str, treated: str, post: str, cov: Cov = Cov(), controls: Sequence[str] = ()) -> Fit:  # noqa: B008
    """Least squares on [1, D, T, D T]; the last of these is the effect."""
    d, t = col(treated).cast("double"), col(post).cast("double")
    return fit_columns(df, col(y), {"const": F.lit(1.0), "treated": d, "post": t, "att": d * t} | {c: col(c) for c in controls}, cov)


def cell_means(df: DataFrame, y: str, treated: str, post: str) -> DataFrame:
    return df.groupBy(col(treated).alias("treated"), col(post).alias("post")).agg(F.avg(col(y)).alias("mean"), F.count(F.lit(1)).alias("n"))


def cuped(df: DataFrame, y: str, pre: Sequence[str], treated: str) -> dict[str, float]:
    """Outcome adjusted by pre-period covariates; Welch comparison of the arms."""
    fit = fit_columns(df, col(y), {"const": F.lit(1.0)} | {c: col(c) for c in pre})
    m = df.agg(*[F.avg(col(c)) for c in pre]).first()
    adj = col(y) - linear(fit.params[1:], [col(c) - float(v) for c, v in zip(pre, m, strict=True)])
    r = {x["a"]: x for x in df.groupBy((col(treated) == 1).alias("a")).agg(F.count(F.lit(1)).alias("n"), F.avg(adj).alias("m"), F.var_samp(adj).alias("v"), F.var_samp(col(y)).alias("v0")).collect()}
    a, b = r[True], r[False]
    se = math.sqrt(a["v"] / a["n"] + b["v"] / b["n"])
    raw = a["v0"] / a["n"] + b["v0"] / b["n"]
    d = a["m"] - b["m"]
    return {"effect": d, "se": se, "z": d / se, "p": dist.norm_two_sided(d / se), "variance_reduction": 1 - se * se / raw} | {f"theta_{c}": float(v) for c, v in zip(pre, fit.params[1:], strict=True)}


def regression_discontinuity(df: DataFrame, y: str, x: str, cutoff: float, bandwidth: float, kernel: str = "triangular", treatment: str | None = None) -> dict[str, float]:
    """Local linear fit on each side (x < c left, x >= c right); fuzzy with `treatment`: ratio of the jumps."""
    u = F.abs(col(x) - cutoff) / bandwidth
    w = {"triangular": 1 - u, "epanechnikov": 0.75 * (1 - u * u), "uniform": F.lit(0.5)}[kernel]
    near = checkpoint(df.where(u < 1).select(col(y).cast("double").alias("y"), (col(x) - cutoff).alias("x"), w.alias("w"), *([col(treatment).cast("double").alias("d")] if treatment else [])))

    def jump(name: str) -> tuple[float, float, int]:
        out = []
        for side in (F.col("x") < 0, F.col("x") >= 0):
            out.append(fit_columns(near.where(side), F.col(name), {"const": F.lit(1.0), "x": F.col("x")}, Cov("HC1"), weight=F.col("w")))
        return float(out[1].params[0] - out[0].params[0]), float(math.hypot(out[0].se[0], out[1].se[0])), int(out[0].stats["n"] + out[1].stats["n"])

    tau, se, n = jump("y")
    if treatment:
        fs, fse, _ = jump("d")
        tau, se = tau / fs, math.sqrt(se**2 + (tau / fs) ** 2 * fse**2) / abs(fs)
    return {"effect": tau, "se": se, "z": tau / se, "p": dist.norm_two_sided(tau / se), "n": n}


def ik_bandwidth(df: DataFrame, y: str, x: str, cutoff: float) -> float:
    """Imbens-Kalyanaraman plug-in bandwidth for the triangular kernel."""
    d = checkpoint(df.select(col(y).cast("double").alias("y"), (col(x) - cutoff).cast("double").alias("x")))
    r = d.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s")).first()
    n, h1 = r["n"], 1.84 * r["s"] * r["n"] ** -0.2
    s = d.agg(F.count_if((F.col("x") < 0) & (F.col("x") >= -h1)).alias("nl"), F.count_if((F.col("x") >= 0) & (F.col("x") <= h1)).alias("nr"), F.var_samp(F.when((F.col("x") < 0) & (F.col("x") >= -h1), F.col("y"))).alias("vl"), F.var_samp(F.when((F.col("x") >= 0) & (F.col("x") <= h1), F.col("y"))).alias("vr"), F.count_if("x >= 0").alias("np")).first()
    f = (s["nl"] + s["nr"]) / (2 * n * h1)
    p = lambda k: F.pow(F.col("x"), F.lit(float(k)))
    m3 = 6 * fit_columns(d, F.col("y"), {"const": F.lit(1.0), "d": F.when(F.col("x") >= 0, 1.0).otherwise(0.0), "x1": p(1), "x2": p(2), "x3": p(3)}).params[4]
    curve = []
    for side, v, m in ((F.col("x") < 0, s["vl"], n - s["np"]), (F.col("x") >= 0, s["vr"], s["np"])):
        h2 = 3.56 * (v / (f * max(m3 * m3, 1e-12))) ** (1 / 7) * m ** (-1 / 7)
        z = d.where(side & (F.abs(F.col("x")) <= h2))
        q = fit_columns(z, F.col("y"), {"const": F.lit(1.0), "x1": p(1), "x2": p(2)})
        curve.append((2 * q.params[2], 2160 * v / (q.stats["n"] * h2**4)))
    (ml, rl), (mr, rr) = curve
    return float(3.4375 * ((s["vl"] + s["vr"]) / (f * ((mr - ml) ** 2 + rl + rr))) ** 0.2 * n**-0.2)


def propensity(df: DataFrame, treated: str, x: Sequence[str], out: str = "propensity") -> DataFrame:
    return logit(df, f"{treated} ~ {' + '.join(x)}").predict(df, out)


def psm(df: DataFrame, y: str, treated: str, x: Sequence[str], *, caliper: float | None = None) -> dict[str, float]:
    """Nearest control by propensity with replacement (ATT): one sort by the score, then the nearest control before and after
    each treated row are carried along; no pair of rows is formed by a join."""
    s = propensity(df, treated, x, "__p").select(col(y).cast("double").alias("y"), (col(treated) == 1).alias("t"), F.col("__p").alias("p"))
    o = Ordered(s.withColumn("c", F.when(~F.col("t"), F.struct("p", "y"))), ["p"])
    back = o._edge(o._blocks(o.block_rows), "c", True, "before")
    both = o._edge(back, "c", False, "after")
    near = F.when(F.col("before").isNull(), F.col("after")["v"]).when(F.col("after").isNull(), F.col("before")["v"])
    b, a = F.col("before")["v"], F.col("after")["v"]
    near = near.when(F.col("p") - b["p"] <= a["p"] - F.col("p"), b).otherwise(a)
    m = both.where("t").select("y", "p", near.alias("m")).where("m is not null")
    if caliper is not None:
        m = m.where(F.abs(F.col("p") - F.col("m")["p"]) <= caliper)
    r = m.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") - F.col("m")["y"]).alias("att"), F.stddev_samp(F.col("y") - F.col("m")["y"]).alias("s")).first()
    return {"att": r["att"], "se": r["s"] / math.sqrt(r["n"]) if r["n"] else math.nan, "matched": r["n"]}


def _pseudo_outcome(df: DataFrame, y: str, treated: str, x: Sequence[str], clip: float) -> Column:
    """Doubly robust signal of a row's own effect: linear outcome models per arm and a logit propensity."""
    p = F.least(F.greatest(logit(df, f"{treated} ~ {' + '.join(x)}").predictor(), F.lit(clip)), F.lit(1 - clip))
    reg = {"const": F.lit(1.0)} | {c: col(c) for c in x}
    m1 = fit_columns(df.where(col(treated) == 1), col(y), reg).predictor()
    m0 = fit_columns(df.where(col(treated) == 0), col(y), reg).predictor()
    t = col(treated).cast("double")
    return m1 - m0 + t * (col(y) - m1) / p - (1 - t) * (col(y) - m0) / (1 - p)


def ipw(df: DataFrame, y: str, treated: str, x: Sequence[str], clip: float = 0.01) -> dict[str, float]:
    """Doubly robust (AIPW) average effect with linear outcome models and a logit propensity."""
    phi = _pseudo_outcome(df, y, treated, x, clip)
    r = df.agg(F.avg(phi).alias("a"), F.stddev_samp(phi).alias("s"), F.count(F.lit(1)).alias("n")).first()
    se = r["s"] / math.sqrt(r["n"])
    return {"ate": r["a"], "se": se, "z": r["a"] / se, "p": dist.norm_two_sided(r["a"] / se)}


def dr_learner(df: DataFrame, y: str, treated: str, x: Sequence[str], *, effect: Sequence[str] | None = None, clip: float = 0.01) -> Fit:
    """Conditional effects: the doubly robust signals regressed on `effect` (default x), HC1 errors; `predict` gives a row's effect."""
    phi = _pseudo_outcome(df, y, treated, x, clip)
    return fit_columns(df, phi, {"const": F.lit(1.0)} | {c: col(c) for c in (x if effect is None else effect)}, Cov("HC1"))


def double_ml(df: DataFrame, y: str, treated: str, x: Sequence[str], folds: int = 5, seed: int = 0) -> dict[str, float]:
    """Partially linear model with cross-fitted linear nuisances: each fold's Gram is subtracted from the total."""
    names = ["const", *x]
    z = {"const": F.lit(1.0)} | {c: col(c).cast("double") for c in x} | {"__y": col(y).cast("double"), "__d": col(treated).cast("double")}
    d = checkpoint(df.select(F.floor(F.rand(seed) * folds).cast("int").alias("f"), *[e.alias(f"z{i}") for i, e in enumerate(z.values())]))
    k = len(z)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    grams = {}
    for r in d.groupBy("f").agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"m{i}_{j}") for i, j in pairs]).collect():
        g = np.zeros((k, k))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"m{i}_{j}"]
        grams[r["f"]] = g
    total, m = sum(grams.values()), len(names)
    ry, rd = F.lit(None).cast("double"), F.lit(None).cast("double")
    xe = [F.col(f"z{i}") for i in range(m)]
    for f, g in grams.items():
        rest = total - g
        b = np.linalg.solve(rest[:m, :m], rest[:m, m:])
        ry = F.when(F.col("f") == f, F.col(f"z{m}") - linear(b[:, 0], xe)).otherwise(ry)
        rd = F.when(F.col("f") == f, F.col(f"z{m + 1}") - linear(b[:, 1], xe)).otherwise(rd)
    q = d.select(ry.alias("y"), rd.alias("d"))
    s = q.agg(F.sum(F.col("y") * F.col("d")).alias("a"), F.sum(F.col("d") * F.col("d")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    theta = s["a"] / s["b"]
    meat = q.agg(F.sum(F.pow((F.col("y") - theta * F.col("d")) * F.col("d"), 2))).first()[0]
    se = math.sqrt(meat) / s["b"]
    return {"theta": theta, "se": se, "z": theta / se, "p": dist.norm_two_sided(theta / se), "n": s["n"]}


dml = double_ml


def tmle(df: DataFrame, y: str, treated: str, x: Sequence[str], clip: float = 0.01) -> dict[str, float]:
    """Targeted effect for outcomes in [0, 1]: linear Q and logit g, one fluctuation on the logit scale."""
    t = col(treated).cast("double")
    reg = {"const": F.lit(1.0)} | {c: col(c) for c in x}
    q = fit_columns(df, col(y), reg | {"__t": t})
    base, b = linear(q.params[:-1], q.exprs[:-1]), float(q.params[-1])
    bound = lambda e: F.least(F.greatest(e, F.lit(clip)), F.lit(1 - clip))
    g = bound(logit(df, f"{treated} ~ {' + '.join(x)}").predictor())
    lo = lambda e: F.ln(e / (1 - e))
    ex = lambda e: 1 / (1 + F.exp(-e))
    d = checkpoint(df.select(col(y).cast("double").alias("y"), t.alias("t"), bound(base + b).alias("q1"), bound(base).alias("q0"), g.alias("g")))
    h = F.col("t") / F.col("g") - (1 - F.col("t")) / (1 - F.col("g"))
    qa = F.when(F.col("t") == 1, F.col("q1")).otherwise(F.col("q0"))
    eps = 0.0
    for _ in range(25):
        p = ex(lo(qa) + eps * h)
        r = d.agg(F.sum(h * (F.col("y") - p)).alias("s"), F.sum(h * h * p * (1 - p)).alias("i")).first()
        step = r["s"] / r["i"]
        eps += step
        if abs(step) < 1e-10:
            break
    p1, p0 = ex(lo(F.col("q1")) + eps / F.col("g")), ex(lo(F.col("q0")) - eps / (1 - F.col("g")))
    ate = d.agg(F.avg(p1 - p0)).first()[0]
    ic = h * (F.col("y") - ex(lo(qa) + eps * h)) + p1 - p0 - ate
    r = d.agg(F.stddev_samp(ic).alias("s"), F.count(F.lit(1)).alias("n")).first()
    se = r["s"] / math.sqrt(r["n"])
    return {"ate": ate, "se": se, "z": ate / se, "p": dist.norm_two_sided(ate / se), "epsilon": eps}


def conformal(df: DataFrame, formula: str, alpha: float = 0.1, share: float = 0.3, seed: int = 0) -> dict[str, float]:
    """Split conformal intervals: width = the ceil((n_c + 1)(1 - alpha))-th absolute calibration residual."""
    from gramforge.frame import order_statistics

    y, x = Formula.parse(formula).design(df)
    s = checkpoint(df.withColumn("__cal", F.rand(seed) < share))
    fit = fit_columns(s.where("not __cal"), y, x)
    r = s.where("__cal").select(F.abs(y - fit.predictor()).alias("r"))
    n = r.count()
    rank = min(math.ceil((n + 1) * (1 - alpha)), n)
    return {"half_width": order_statistics(r, "r", [rank - 1])[0], "n_calibration": n}


def lp_did(df: DataFrame, y: str, unit: str, time: str, treated: str, *, pre: int = 5, post: int = 8) -> DataFrame:
    """Local projections DiD with clean controls: per horizon h, change y(t+h) - y(t-1) on entering treatment at t with time effects
    (variance weighted), controls untreated up to t + h; errors clustered by unit. Rows (horizon, effect, std_error, n)."""
    o = Ordered(df.select(col(unit).alias("u"), col(time).alias("t"), col(y).cast("double").alias("y"), col(treated).cast("int").alias("d")), ["t"], ["u"])
    reach = max(post, pre, 1)

    def make(w):
        out = {"dlag": F.lag("d").over(w), "ylag": F.lag("y").over(w)}
        for h in range(1, post + 1):
            out |= {f"yf{h}": F.lead("y", h).over(w), f"df{h}": F.lead("d", h).over(w)}
        for h in range(2, pre + 1):
            out[f"yb{h}"] = F.lag("y", h).over(w)
        return out

    x = checkpoint(o.with_neighbours(reach, reach, make).where("dlag = 0"))
    rows: list[tuple] = [(-1, 0.0, 0.0, 0)]
    for h in [*range(-pre, -1), *range(post + 1)]:
        yh = F.col("y") if h == 0 else F.col(f"yf{h}") if h > 0 else F.col(f"yb{-h}")
        clean = (F.col("d") == 0) if h <= 0 else (F.col(f"df{h}") == 0)
        z = x.select("u", "t", (yh - F.col("ylag")).alias("y"), F.col("d").cast("double").alias("d"), clean.alias("ok")).where("y is not null and (d = 1 or ok)")
        m = z.groupBy("t").agg(F.avg("y").alias("my"), F.avg("d").alias("md"))
        w = checkpoint(z.join(m, "t").select("u", "t", (F.col("y") - F.col("my")).alias("y"), (F.col("d") - F.col("md")).alias("d")))
        r = w.agg(F.sum(F.col("y") * F.col("d")).alias("a"), F.sum(F.col("d") * F.col("d")).alias("b"), F.count(F.lit(1)).alias("n")).first()
        if not r["b"]:
            continue
        beta = r["a"] / r["b"]
        c = w.groupBy("u").agg(F.sum((F.col("y") - beta * F.col("d")) * F.col("d")).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.count(F.lit(1)).alias("g")).first()
        rows.append((h, beta, math.sqrt(c["s"] * c["g"] / max(c["g"] - 1, 1)) / r["b"], r["n"]))
    return df.sparkSession.createDataFrame(sorted(rows), "horizon int, effect double, std_error double, n long")


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.clip(v - c[np.flatnonzero(u > c)[-1]], 0, None)


def synthetic_control(df: DataFrame, y: str, unit: str, time: str, treated_unit, first_treated, *, max_donors: int = 2000, iters: int = 5000) -> dict[str, object]:
    """Simplex weights on the donors' pre-period Gram (added over periods on Spark), projected gradient on the driver; effect = mean post gap."""
    donors = [r[0] for r in df.where(col(unit) != F.lit(treated_unit)).select(col(unit)).distinct().orderBy(col(unit)).limit(max_donors + 1).collect()]
    if len(donors) > max_donors:
        raise InvalidOperation(f"over {max_donors} donors")
    wide = df.groupBy(col(time).alias("__t")).pivot(unit, [treated_unit, *donors]).agg(F.avg(col(y)))
    cols = wide.columns[1:]
    wide = checkpoint(wide.select((F.col("__t") >= F.lit(first_treated)).alias("post"), *[col(c).alias(f"z{i}") for i, c in enumerate(cols)]))
    k = len(cols)
    rows = wide.where("not post").na.drop().select(*[f"z{i}" for i in range(k)])
    from gramforge.plans.mle import batch_sums

    g = batch_sums(rows, k * k, lambda m: (m.T @ m).ravel()).reshape(k, k)
    q, b = g[1:, 1:], g[1:, 0]
    w = np.full(k - 1, 1 / (k - 1))
    step = 1 / max(np.linalg.eigvalsh(q)[-1], 1e-12)
    for _ in range(iters):
        new = _simplex(w - step * (q @ w - b))
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    gap = F.col("z0") - linear(w, [F.col(f"z{i}") for i in range(1, k)])
    r = wide.groupBy("post").agg(F.avg(gap).alias("g"), F.sqrt(F.avg(gap * gap)).alias("r")).collect()
    by = {x["post"]: x for x in r}
    return {"weights": dict(zip(donors, w.tolist(), strict=True)), "effect": by[True]["g"], "pre_rmspe": by[False]["r"]}


def synthetic_did(df: DataFrame, y: str, unit: str, time: str, treated_unit, first_treated, **kwargs) -> dict[str, float]:
    """Double difference of the treated unit against its weighted donors, periods weighted equally."""
    sc = synthetic_control(df, y, unit, time, treated_unit, first_treated, **kwargs)
    w = df.sparkSession.createDataFrame([(u, float(v)) for u, v in sc["weights"].items()], [unit, "__w"])
    post = col(time) >= F.lit(first_treated)
    d = df.join(w, unit, "left").groupBy(post.alias("p")).agg(F.avg(F.when(col(unit) == F.lit(treated_unit), col(y))).alias("t"), (F.sum(F.col("__w") * col(y)) / F.sum("__w")).alias("c"))
    m = {r["p"]: r for r in d.collect()}
    return {"effect": (m[True]["t"] - m[False]["t"]) - (m[True]["c"] - m[False]["c"])}


def causal_impact(df: DataFrame, y: str, x: Sequence[str], time: str, first_treated, level: float = 0.95) -> dict[str, float]:
    """Pre-period regression on controls; cumulated and mean post-period gap with normal intervals."""
    post = col(time) >= F.lit(first_treated)
    fit = fit_columns(df.where(~post), col(y), {"const": F.lit(1.0)} | {c: col(c) for c in x})
    r = df.where(post).agg(F.count(F.lit(1)).alias("n"), F.sum(col(y) - fit.predictor()).alias("s")).first()
    se, z = fit.stats["sigma"] * math.sqrt(r["n"]), dist.norm_ppf(0.5 + level / 2)
    return {"cumulative": r["s"], "average": r["s"] / r["n"], "low": r["s"] - z * se, "high": r["s"] + z * se, "n": r["n"]}


def t_learner_forest_effects(df: DataFrame, y: str, treated: str, x: Sequence[str], **kwargs) -> DataFrame:
    """Heterogeneous effects as the difference of two forests (arms fitted separately); adds `effect`."""
    from gramforge.models.learn import random_forest

    a = random_forest(df.where(col(treated) == 1), y, x, **kwargs)
    b = random_forest(df.where(col(treated) == 0), y, x, **kwargs)
    return a.predict(b.predict(df, "__m0"), "__m1").withColumn("effect", F.col("__m1") - F.col("__m0")).drop("__m0", "__m1")


def causal_forest(df: DataFrame, y: str, treated: str, x: Sequence[str], *, trees: int = 50, depth: int = 5, clip: float = 0.01, seed: int = 0) -> DataFrame:
    """Residual-on-residual forest: outcome and treatment are residualised (linear and logit nuisances), then a forest predicts
    (y - m) / (t - e) with weights (t - e)^2. Adds `effect`."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    m = fit_columns(df, col(y), {"const": F.lit(1.0)} | {c: col(c) for c in x}).predictor()
    e = F.least(F.greatest(logit(df, f"{treated} ~ {' + '.join(x)}").predictor(), F.lit(clip)), F.lit(1 - clip))
    r = col(treated) - e
    d = VectorAssembler(inputCols=list(x), outputCol="__f").transform(df.withColumn("__y", (col(y) - m) / r).withColumn("__w", r * r))
    model = RandomForestRegressor(featuresCol="__f", labelCol="__y", weightCol="__w", numTrees=trees, maxDepth=depth, seed=seed, predictionCol="effect").fit(d)
    return model.transform(d).drop("__f", "__y", "__w")



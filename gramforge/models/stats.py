"""Classical tests, diagnostics, multiple testing and weighted statistics from small aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import InvalidOperation
from gramforge.formula import Formula
from gramforge.models.linear import fit_columns
from gramforge.models.results import Fit
from gramforge.operators.ordered import Ordered
from gramforge.plans.moments import gram, linear, outer_sum
from gramforge.util import checkpoint, col


def _moments(df: DataFrame, name: str) -> dict[str, float]:
    """n, mean and central power sums m2, m3, m4 (divided by n), in two passes."""
    x = col(name).cast("double")
    h = df.agg(F.count(x), F.avg(x)).first()
    if not h[0]:
        raise InvalidOperation("no rows")
    d = x - F.lit(float(h[1]))
    r = df.agg(*[F.avg(F.pow(d, p)).alias(f"m{p}") for p in (2, 3, 4)]).first()
    return {"n": h[0], "mean": h[1], "m2": r["m2"], "m3": r["m3"], "m4": r["m4"]}


def jarque_bera(df: DataFrame, name: str) -> tuple[float, float]:
    m = _moments(df, name)
    s, k = m["m3"] / m["m2"] ** 1.5, m["m4"] / m["m2"] ** 2
    jb = m["n"] / 6 * (s * s + (k - 3) ** 2 / 4)
    return jb, dist.chi2_sf(jb, 2)


def skewness(df: DataFrame, name: str) -> float:
    """Population skewness times n^2/((n-1)(n-2))."""
    m = _moments(df, name)
    return m["n"] ** 2 / ((m["n"] - 1) * (m["n"] - 2)) * m["m3"] / m["m2"] ** 1.5


def kurtosis(df: DataFrame, name: str) -> float:
    m = _moments(df, name)
    n = m["n"]
    return n * n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * m["m4"] / m["m2"] ** 2 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))


def omnibus(df: DataFrame, name: str) -> tuple[float, float]:
    """D'Agostino's K^2."""
    m = _moments(df, name)
    n = m["n"]
    if n < 20:
        raise InvalidOperation("needs 20 rows")
    b1, b2 = m["m3"] / m["m2"] ** 1.5, m["m4"] / m["m2"] ** 2
    y = b1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (b2 - e) / math.sqrt(v)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + math.sqrt(1 + 4 / sb**2))
    t = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(t) ** (1 / 3), t)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, dist.chi2_sf(k2, 2)


def raw_moments(df: DataFrame, name: str, order: int) -> list[float]:
    return list(df.agg(*[F.avg(F.pow(col(name).cast("double"), p)) for p in range(1, order + 1)]).first())


def central_moments_to_cumulants(m: Sequence[float]) -> list[float]:
    """Central moments 2..k to cumulants 2..k."""
    mu = [1.0, 0.0, *m]
    kappa = [0.0, 0.0]
    for n in range(2, len(mu)):
        kappa.append(mu[n] - sum(math.comb(n - 1, j - 1) * kappa[j] * mu[n - j] for j in range(2, n)))
    return kappa[2:]


def cumulants_to_central_moments(c: Sequence[float]) -> list[float]:
    kappa, mu = [0.0, 0.0, *c], [1.0, 0.0]
    for n in range(2, len(kappa)):
        mu.append(kappa[n] + sum(math.comb(n - 1, j - 1) * kappa[j] * mu[n - j] for j in range(2, n)))
    return mu[2:]


def group_stats(df: DataFrame, name: str, group: str) -> DataFrame:
    return df.groupBy(col(group)).agg(F.count(col(name)).alias("n"), F.avg(col(name)).alias("mean"), F.var_samp(col(name)).alias("var"))


def anova_oneway(df: DataFrame, name: str, group: str) -> dict[str, float]:
    g = df.groupBy(col(group)).agg(F.count(col(name)).alias("n"), F.avg(col(name)).alias("m"), F.var_pop(col(name)).alias("v"))
    r = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("w"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("b")).first()
    d1, d2 = r["k"] - 1, r["n"] - r["k"]
    f = r["b"] / d1 / (r["w"] / d2)
    return {"ss_between": r["b"], "ss_within": r["w"], "df_between": d1, "df_within": d2, "f": f, "p": dist.f_sf(f, d1, d2)}


def _mean_var(df: DataFrame, name: str) -> tuple[int, float, float]:
    r = df.agg(F.count(col(name)), F.avg(col(name)), F.var_samp(col(name))).first()
    return r[0], r[1], r[2]


def _t(diff: float, se: float, df: float) -> dict[str, float]:
    if se < 1e-15:
        return {"t": 0.0, "df": df, "p": 1.0, "diff": diff}
    return {"t": diff / se, "df": df, "p": dist.t_two_sided(diff / se, df), "diff": diff, "se": se}


def ttest_1samp(df: DataFrame, name: str, mu: float) -> dict[str, float]:
    n, m, v = _mean_var(df, name)
    return _t(m - mu, math.sqrt(v / n), n - 1)


def ttest_ind(a: DataFrame, b: DataFrame, name: str, *, pooled: bool = False) -> dict[str, float]:
    (n1, m1, v1), (n2, m2, v2) = _mean_var(a, name), _mean_var(b, name)
    if pooled:
        return _t(m1 - m2, math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), n1 + n2 - 2)
    q1, q2 = v1 / n1, v2 / n2
    return _t(m1 - m2, math.sqrt(q1 + q2), (q1 + q2) ** 2 / (q1 * q1 / (n1 - 1) + q2 * q2 / (n2 - 1)) if q1 + q2 else n1 + n2 - 2)


def ttest_paired(df: DataFrame, first: str, second: str) -> dict[str, float]:
    return ttest_1samp(df.select((col(first) - col(second)).alias("d")), "d", 0.0)


def proportion_ztest(successes: int, n: int, p0: float) -> tuple[float, float]:
    z = (successes / n - p0) / math.sqrt(p0 * (1 - p0) / n)
    return z, dist.norm_two_sided(z)


def proportion_ztest_2samp(s1: int, n1: int, s2: int, n2: int) -> tuple[float, float]:
    p = (s1 + s2) / (n1 + n2)
    z = (s1 / n1 - s2 / n2) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    return z, dist.norm_two_sided(z)


def proportion_confint(successes: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Wilson interval."""
    z, p = dist.norm_ppf(0.5 + level / 2), successes / n
    mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def chi2_contingency(df: DataFrame, a: str, b: str) -> tuple[float, float, int]:
    """Pearson's chi-square of two columns from counts and margins; no continuity correction."""
    c = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    ra, rb = c.groupBy("a").agg(F.sum("o").alias("ra")), c.groupBy("b").agg(F.sum("o").alias("rb"))
    n, ka, kb = c.agg(F.sum("o")).first()[0], ra.count(), rb.count()
    # Empty cells add their expected count: in total n minus the expected counts of the filled ones.
    r = c.join(ra, "a").join(rb, "b").agg(F.sum(F.pow(F.col("o") - F.col("ra") * F.col("rb") / n, 2) / (F.col("ra") * F.col("rb") / n)).alias("x"), F.sum(F.col("ra") * F.col("rb") / n).alias("e")).first()
    x, dof = r["x"] + n - r["e"], (ka - 1) * (kb - 1)
    return x, dist.chi2_sf(x, dof), dof


def multipletests(p: Sequence[float], method: str = "holm", alpha: float = 0.05) -> tuple[list[bool], list[float]]:
    """bonferroni, sidak, holm, bh or by; adjusted values capped at 1."""
    p = np.asarray(p, float)
    n = len(p)
    order = np.argsort(p, kind="stable")
    s, rank = p[order], np.arange(1, n + 1)
    if method == "bonferroni":
        adj = s * n
    elif method == "sidak":
        adj = 1 - (1 - s) ** n
    elif method == "holm":
        adj = np.maximum.accumulate(s * (n - rank + 1))
    elif method in ("bh", "by"):
        c = (1 / rank).sum() if method == "by" else 1.0
        adj = np.minimum.accumulate((s * n / rank * c)[::-1])[::-1]
    else:
        raise InvalidOperation(f"unknown method {method!r}")
    out = np.empty(n)
    out[order] = np.minimum(adj, 1)
    return (out < alpha).tolist(), out.tolist()


def adjust_column(df: DataFrame, p: str, method: str = "bh", out: str = "p_adjusted") -> DataFrame:
    """Bonferroni, Holm or Benjamini-Hochberg over a column of any size by a global sort and running extremes."""
    n = df.where(col(p).isNotNull()).count()
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), col(p) * n))
    o = Ordered(df.where(col(p).isNotNull()), [col(p).asc() if method == "holm" else col(p).desc()])
    rank = F.col(o.pos) + 1 if method == "holm" else F.lit(n) - F.col(o.pos)
    scaled = o.rows().withColumn("__a", col(p) * (F.lit(n) - rank + 1 if method == "holm" else F.lit(n) / rank))
    again = Ordered(scaled, [o.pos])
    run = again.cummax("__a") if method == "holm" else again.cummin("__a")
    name = "__a_cummax" if method == "holm" else "__a_cummin"
    return run.select(*[col(c) for c in df.columns], F.least(F.lit(1.0), F.col(name)).alias(out))


def weighted_stats(df: DataFrame, name: str, weight: str) -> dict[str, float]:
    """Mean, variance with reliability weights, and standard error of the mean."""
    x, w = col(name).cast("double"), col(weight).cast("double")
    r = df.agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * x).alias("x")).first()
    m = r["x"] / r["w"]
    ss = df.agg(F.sum(w * (x - m) * (x - m))).first()[0]
    var = ss / (r["w"] - r["w2"] / r["w"])
    return {"mean": m, "var": var, "std": math.sqrt(var), "sum_weights": r["w"], "se_mean": math.sqrt(var * r["w2"]) / r["w"]}


# regression diagnostics
def _residuals(df: DataFrame, formula: str) -> tuple[Fit, Column, dict[str, Column]]:
    y, x = Formula.parse(formula).design(df)
    fit = fit_columns(df, y, x)
    return fit, y - fit.predictor(), x


def breusch_pagan(df: DataFrame, formula: str) -> tuple[float, float]:
    fit, e, x = _residuals(df, formula)
    aux = fit_columns(df, e * e, x)
    lm = fit.stats["n"] * aux.stats["r_squared"]
    return lm, dist.chi2_sf(lm, len(x) - 1)


def white_test(df: DataFrame, formula: str) -> tuple[float, float]:
    """Squared residuals on levels and squares, no cross products; df counts all auxiliary columns."""
    fit, e, x = _residuals(df, formula)
    aux = x | {f"{c}^2": v * v for c, v in x.items() if c != "const"}
    r = fit_columns(df, e * e, aux, drop_collinear=True)
    lm = fit.stats["n"] * r.stats["r_squared"]
    return lm, dist.chi2_sf(lm, len(aux))


def reset_test(df: DataFrame, formula: str, power: int = 3) -> tuple[float, float]:
    y, x = Formula.parse(formula).design(df)
    fit = fit_columns(df, y, x)
    s = df.agg(F.avg(fit.predictor()), F.stddev_pop(fit.predictor())).first()
    # Powers of the centred, scaled fit span the same space with less rounding.
    z = (fit.predictor() - s[0]) / (s[1] or 1.0)
    full = fit_columns(df, y, x | {f"fit^{p}": F.pow(z, F.lit(float(p))) for p in range(2, power + 1)})
    q = power - 1
    f = (fit.stats["ssr"] - full.stats["ssr"]) / q / (full.stats["ssr"] / full.stats["df_resid"])
    return f, dist.f_sf(f, q, full.stats["df_resid"])


def durbin_watson(df: DataFrame, residual: str, order_by: Sequence[str]) -> float:
    o = Ordered(df.select(*[col(c) for c in dict.fromkeys([*order_by, residual])]), list(order_by))
    r = o.diff(residual).agg(F.sum(F.pow(F.col(f"{residual}_diff_1"), 2)), F.sum(F.pow(col(residual), 2))).first()
    return r[0] / r[1]


def breusch_godfrey(df: DataFrame, formula: str, lags: int, order_by: Sequence[str]) -> tuple[float, float]:
    """LM = (n - lags) R^2 of residuals on the design and their lags, first `lags` rows dropped."""
    fit, e, x = _residuals(df, formula)
    base = df.select(*[col(o) for o in order_by], *[v.cast("double").alias(f"x{i}") for i, v in enumerate(x.values())], e.alias("e"))
    o = Ordered(base, list(order_by))
    l_ = checkpoint(o.with_neighbours(lags, 0, lambda w: {f"e{p}": F.lag("e", p).over(w) for p in range(1, lags + 1)}).where(F.col(o.pos) >= lags))
    aux = fit_columns(l_, F.col("e"), {c: F.col(f"x{i}") for i, c in enumerate(x)} | {f"e{p}": F.col(f"e{p}") for p in range(1, lags + 1)})
    lm = aux.stats["n"] * aux.stats["r_squared"]
    return lm, dist.chi2_sf(lm, lags)


def goldfeld_quandt(df: DataFrame, residual: str, order_by: Sequence[str]) -> tuple[float, float]:
    """Ratio of the halves' sums of squares in row order, two-tailed."""
    o = Ordered(df.select(*[col(c) for c in dict.fromkeys([*order_by, residual])]), list(order_by))
    n = df.count()
    half = n // 2
    e2 = F.pow(col(residual), 2)
    r = o.rows().agg(F.sum(F.when(F.col(o.pos) < half, e2)), F.sum(F.when(F.col(o.pos) >= n - half, e2))).first()
    f = r[1] / r[0]
    p = dist.f_sf(f, half, half)
    return f, 2 * min(p, 1 - p)


def vif(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix; infinite for R^2 of 0.9999 and above, NaN for constants."""
    s = gram(df, {c: col(c) for c in names}).centred
    d = np.sqrt(np.diag(s))
    live = [i for i in range(len(names)) if d[i] > 0]
    r = s[np.ix_(live, live)] / np.outer(d[live], d[live])
    out = dict.fromkeys(names, math.nan)
    for a, i in enumerate(live):
        rest = [b for b in range(len(live)) if b != a]
        r2 = float(r[a, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)]) @ r[rest, a]) if rest else 0.0
        out[names[i]] = math.inf if r2 >= 0.9999 else 1 / (1 - r2)
    return out


def condition_number(df: DataFrame, formula: str) -> float:
    _, x = Formula.parse(formula).design(df)
    v = np.linalg.eigvalsh(outer_sum(df, list(x.values()), F.lit(1.0)))
    return math.sqrt(v[-1] / max(v[0], 1e-300))


def anderson_darling(df: DataFrame, name: str) -> float:
    """A^2 for normality with estimated mean and variance; the sum runs over globally ranked rows."""
    n, m, v = _mean_var(df, name)
    z = (col(name) - m) / math.sqrt(v)
    logs = F.pandas_udf(lambda s: s.map(lambda x: math.log(max(float(dist.norm_cdf(x)), 1e-300))), "double")
    o = Ordered(df.where(col(name).isNotNull()).select(z.alias("z")), ["z"])
    i = F.col(o.pos) + 1
    s = o.rows().agg(F.sum((2 * i - 1) * logs(F.col("z")) + (2 * (n - i) + 1) * logs(-F.col("z")))).first()[0]
    return -n - s / n


def lilliefors(df: DataFrame, name: str) -> float:
    n, m, v = _mean_var(df, name)
    cdf = F.pandas_udf(lambda s: s.map(lambda x: float(dist.norm_cdf(x))), "double")
    o = Ordered(df.where(col(name).isNotNull()).select(((col(name) - m) / math.sqrt(v)).alias("z")), ["z"])
    r = o.rows().select(cdf("z").alias("c"), F.col(o.pos).alias("i"))
    return float(r.agg(F.max(F.greatest((F.col("i") + 1) / n - F.col("c"), F.col("c") - F.col("i") / n))).first()[0])


def shapiro_francia(df: DataFrame, name: str) -> float:
    """W' = squared correlation of the sorted values with normal scores (Blom)."""
    n = df.where(col(name).isNotNull()).count()
    score = F.pandas_udf(lambda s: s.map(lambda i: dist.norm_ppf((i + 1 - 0.375) / (n + 0.25))), "double")
    o = Ordered(df.where(col(name).isNotNull()).select(col(name).alias("v")), ["v"])
    g = gram(o.rows().select("v", score(F.col(o.pos)).alias("s")), {"v": F.col("v"), "s": F.col("s")}).centred
    return float(g[0, 1] ** 2 / (g[0, 0] * g[1, 1]))


# binary classification
def classification_table(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> dict[str, float]:
    pos, hit = col(y) == 1, col(score) >= threshold
    r = df.agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn")).first()
    tp, fp, fn, tn = (r[c] for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: a / b if b else 0.0
    p, s = safe(tp, tp + fp), safe(tp, tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "accuracy": safe(tp + tn, tp + fp + fn + tn), "precision": p, "sensitivity": s, "specificity": safe(tn, tn + fp), "f1": safe(2 * p * s, p + s)}


def _roc_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """Per score: positives and negatives; then running totals from the top score."""
    c = df.groupBy(col(score).alias("s")).agg(F.sum(F.when(col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(col(y) == 1, 0).otherwise(1)).alias("q"))
    return Ordered(c, [F.col("s").desc()]).cumsum("p", "q").select("s", "p", "q", "p_cumsum", "q_cumsum")


def roc(df: DataFrame, y: str, score: str) -> DataFrame:
    c = checkpoint(_roc_counts(df, y, score))
    t = c.agg(F.sum("p"), F.sum("q")).first()
    return c.select(F.col("s").alias("threshold"), (F.col("p_cumsum") / t[0]).alias("tpr"), (F.col("q_cumsum") / t[1]).alias("fpr"))


def auc(df: DataFrame, y: str, score: str) -> float:
    """Rank statistic with ties counted half."""
    c = _roc_counts(df, y, score)
    r = c.agg(F.sum(F.col("q") * (F.col("p_cumsum") - F.col("p") / 2)).alias("a"), F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    return float(r["a"] / (r["p"] * r["q"]))


def hosmer_lemeshow(df: DataFrame, y: str, score: str, groups: int = 10) -> tuple[float, float]:
    n = df.count()
    o = Ordered(df.select(col(y).alias("y"), col(score).alias("p")), ["p"])
    # Group g holds positions round(g n / groups) up to round((g + 1) n / groups).
    edges = [math.floor(g * n / groups + 0.5) for g in range(groups + 1)]
    g = F.lit(0)
    for i in range(1, groups):
        g = F.when(F.col(o.pos) >= edges[i], i).otherwise(g)
    c = o.rows().groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("o"), F.sum("p").alias("e"))
    x = c.agg(F.sum(F.when((F.col("e") > 0) & (F.col("e") < F.col("n")), F.pow(F.col("o") - F.col("e"), 2) / (F.col("e") * (1 - F.col("e") / F.col("n")))).otherwise(0.0))).first()[0]
    return x, dist.chi2_sf(x, groups - 2)


# model selection
def lr_test(restricted: Fit, full: Fit) -> tuple[float, int, float]:
    lr = 2 * (full.stats["log_likelihood"] - restricted.stats["log_likelihood"])
    q = len(full.names) - len(restricted.names)
    return lr, q, dist.chi2_sf(lr, q)


def compare_models(fits: dict[str, Fit], spark: SparkSession) -> DataFrame:
    """AIC, BIC, their ranks and Akaike weights."""
    aic, bic = ({k: f.stats[c] for k, f in fits.items()} for c in ("aic", "bic"))
    w = akaike_weights(list(aic.values()))
    rank = lambda d, k: 1 + sum(v < d[k] for v in d.values())
    return spark.createDataFrame([(k, float(aic[k]), float(bic[k]), rank(aic, k), rank(bic, k), float(x)) for k, x in zip(fits, w, strict=True)], "model string, aic double, bic double, aic_rank int, bic_rank int, akaike_weight double")


def akaike_weights(aic: Sequence[float]) -> list[float]:
    d = np.exp(-0.5 * (np.asarray(aic) - min(aic)))
    return (d / d.sum()).tolist()


def f_test_nested(restricted: Fit, full: Fit) -> tuple[float, float]:
    q = len(full.names) - len(restricted.names)
    f = (restricted.stats["ssr"] - full.stats["ssr"]) / q / (full.stats["ssr"] / full.stats["df_resid"])
    return f, dist.f_sf(f, q, full.stats["df_resid"])


def linktest(df: DataFrame, fit: Fit, y: str) -> Fit:
    """Refit on the linear predictor and its square."""
    from gramforge.models.glm import logit

    eta = linear(fit.params[: len(fit.exprs)], fit.exprs)
    return logit(df.select(col(y).alias("y"), eta.alias("hat"), (eta * eta).alias("hatsq")), "y ~ hat + hatsq")

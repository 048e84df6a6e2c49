"""What estimators return: a coefficient table and a dictionary of summary numbers."""

from __future__ import annotations

import html
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import InvalidOperation
from gramforge.plans.moments import linear, quadratic


@dataclass
class Fit:
    names: list[str]
    params: np.ndarray
    cov: np.ndarray
    df_resid: float = math.inf
    stats: dict[str, float] = field(default_factory=dict)
    exprs: list[Column] = field(default_factory=list, repr=False)
    link_inverse: object = field(default=None, repr=False)
    link: str | None = None

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    @property
    def tvalues(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.params / self.se

    @property
    def pvalues(self) -> np.ndarray:
        if math.isinf(self.df_resid):
            return np.array([dist.norm_two_sided(t) for t in self.tvalues])
        return np.array([dist.t_two_sided(t, self.df_resid) for t in self.tvalues])

    def conf_int(self, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
        p = 0.5 + level / 2
        q = dist.norm_ppf(p) if math.isinf(self.df_resid) else dist.t_ppf(p, self.df_resid)
        return self.params - q * self.se, self.params + q * self.se

    def rows(self) -> list[tuple]:
        lo, hi = self.conf_int()
        return [(n, *map(float, v)) for n, *v in zip(self.names, self.params, self.se, self.tvalues, self.pvalues, lo, hi, strict=True)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "term string, estimate double, std_error double, statistic double, p_value double, ci_low double, ci_high double")

    def summary(self, spark: SparkSession) -> DataFrame:
        keys = list(self.stats)
        return spark.createDataFrame([tuple(float(self.stats[k]) for k in keys)], ", ".join(f"`{k}` double" for k in keys))

    def predictor(self) -> Column:
        """The linear predictor, through the inverse link where there is one."""
        eta = linear(self.params[: len(self.exprs)], self.exprs)
        return self.link_inverse(eta) if self.link_inverse else eta

    def predict(self, df: DataFrame, out: str = "fitted") -> DataFrame:
        return df.withColumn(out, self.predictor())

    def with_inference(self, kind: str) -> Fit:
        """The same fit with "t" (needs residual degrees of freedom) or "normal" tests and intervals."""
        if kind not in ("t", "normal"):
            raise InvalidOperation(f"unknown inference {kind!r}")
        free = self.stats.get("df_resid", self.df_resid)
        if kind == "t" and math.isinf(free):
            raise InvalidOperation("no residual degrees of freedom")
        return replace(self, df_resid=math.inf if kind == "normal" else free)

    def get_prediction(self, df: DataFrame, level: float = 0.95) -> DataFrame:
        """Rows of `df` with predicted, pred_se, ci_low, ci_high (of the mean, through the link where there is one) and, for a fit with
        `sigma`, obs_low and obs_high (of a new observation)."""
        k = len(self.exprs)
        eta, var = linear(self.params[:k], self.exprs), quadratic(self.cov[:k, :k], self.exprs)
        p = 0.5 + level / 2
        q = dist.norm_ppf(p) if math.isinf(self.df_resid) else dist.t_ppf(p, self.df_resid)
        x = df.withColumn("_eta", eta).withColumn("pred_se", F.sqrt(F.greatest(var, F.lit(0.0))))
        low, high = F.col("_eta") - q * F.col("pred_se"), F.col("_eta") + q * F.col("pred_se")
        inv = self.link_inverse or (lambda e: e)
        a, b = inv(low), inv(high)
        x = x.withColumn("predicted", inv(F.col("_eta"))).withColumn("ci_low", F.least(a, b)).withColumn("ci_high", F.greatest(a, b))
        if "sigma" in self.stats and not self.link_inverse:
            wide = q * F.sqrt(F.col("pred_se") * F.col("pred_se") + float(self.stats["sigma"]) ** 2)
            x = x.withColumn("obs_low", F.col("_eta") - wide).withColumn("obs_high", F.col("_eta") + wide)
        return x.drop("_eta")

    def wald_test(self, r: np.ndarray, q: np.ndarray | None = None) -> tuple[float, float]:
        """(statistic, p): F for finite residual degrees of freedom, else chi-square."""
        r = np.atleast_2d(r)
        d = r @ self.params - (0 if q is None else q)
        w = float(d @ np.linalg.solve(r @ self.cov @ r.T, d))
        m = len(r)
        return (w, dist.chi2_sf(w, m)) if math.isinf(self.df_resid) else (w / m, dist.f_sf(w / m, m, self.df_resid))

    def lincom(self, weights: dict[str, float]) -> tuple[float, float]:
        c = np.array([weights.get(n, 0.0) for n in self.names])
        return float(c @ self.params), float(math.sqrt(max(c @ self.cov @ c, 0)))

    def nlcom(self, func, step: float = 1e-6) -> tuple[float, float]:
        """Estimate and delta-method standard error of a function of the parameters."""
        b = self.params
        at = float(func(b))
        g = np.array([(func(b + h) - func(b - h)) / (2 * h[i]) for i, h in enumerate(np.diag(step * np.maximum(1, np.abs(b))))])
        return at, float(math.sqrt(max(g @ self.cov @ g, 0)))

    def to_latex(self) -> str:
        body = "\n".join(f"{n.replace('_', chr(92) + '_')} & {b:.4f} & ({s:.4f}) & {t:.3f} & {p:.3f} \\\\" for n, b, s, t, p, *_ in self.rows())
        return "\\begin{tabular}{lrrrr}\nterm & estimate & s.e. & statistic & p \\\\\n\\hline\n" + body + "\n\\end{tabular}"

    def to_html(self) -> str:
        body = "".join(f"<tr><td>{html.escape(n)}</td>" + "".join(f"<td>{v:.4f}</td>" for v in (b, s, t, p)) + "</tr>" for n, b, s, t, p, *_ in self.rows())
        return f"<table><tr><th>term</th><th>estimate</th><th>std. error</th><th>statistic</th><th>p</th></tr>{body}</table>"

    def to_csv(self) -> str:
        return "\n".join(["term,estimate,std_error,statistic,p_value", *[f"{n},{b!r},{s!r},{t!r},{p!r}" for n, b, s, t, p, *_ in self.rows()]])


def compare(fits: dict[str, Fit], spark: SparkSession) -> DataFrame:
    """Models side by side: one row per term, columns per model with estimates and standard errors."""
    terms = list(dict.fromkeys(n for f in fits.values() for n in f.names))
    rows = []
    for t in terms:
        row: list = [t]
        for f in fits.values():
            row += [float(f.params[f.names.index(t)]), float(f.se[f.names.index(t)])] if t in f.names else [None, None]
        rows.append(tuple(row))
    return spark.createDataFrame(rows, "term string, " + ", ".join(f"`{m}` double, `{m}_se` double" for m in fits))

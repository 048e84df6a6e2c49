"""Survival analysis from counts per event time."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramforge.models.results import Fit
from gramforge.operators.ordered import Ordered
from gramforge.plans.moments import linear
from gramforge.plans.scan import prefix_sum
from gramforge.util import checkpoint, col


def kaplan_meier(df: DataFrame, duration: str, event: str, groups: Sequence[str] = ()) -> DataFrame:
    """Product limit per event time: at_risk, deaths, survival, std_error (Greenwood), ci_low, ci_high (plain 95 %, clipped)."""
    k = list(groups)
    c = df.where(col(duration).isNotNull()).groupBy(*[col(g) for g in k], col(duration).alias("time")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(col(event).cast("int") == 1, 1).otherwise(0)).alias("deaths"))
    tot = Ordered(c, [F.col("time").desc()], k).cumsum("n").withColumnRenamed("n_cumsum", "at_risk").drop("_pos")
    live = tot.where("deaths > 0")
    live = live.withColumn("l", F.when(F.col("deaths") < F.col("at_risk"), F.log1p(-F.col("deaths") / F.col("at_risk"))).otherwise(F.lit(-1e308)))
    live = live.withColumn("g", F.when(F.col("deaths") < F.col("at_risk"), F.col("deaths") / (F.col("at_risk") * (F.col("at_risk") - F.col("deaths")))).otherwise(0.0))
    b = Ordered(live, ["time"], k).cumsum("l", "g")
    s = F.exp("l_cumsum")
    se = s * F.sqrt("g_cumsum")
    return b.select(*[col(g) for g in k], "time", "at_risk", "deaths", s.alias("survival"), se.alias("std_error"), F.greatest(F.lit(0.0), s - 1.96 * se).alias("ci_low"), F.least(F.lit(1.0), s + 1.96 * se).alias("ci_high"))


def median_survival(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return curve.where("survival <= 0.5").groupBy(*[col(g) for g in groups]).agg(F.min("time").alias("median"))


def cox(df: DataFrame, duration: str, event: str, x: Sequence[str], *, tol: float = 1e-9, max_iter: int = 100) -> Fit:
    """Breslow ties: rows are reduced to sums per time, risk sets are running sums from the last time; Newton on the driver."""
    k = len(x)
    m = df.agg(*[F.avg(col(c)) for c in x]).first()
    z = checkpoint(df.select(col(duration).alias("t"), col(event).cast("int").alias("e"), *[(col(c).cast("double") - float(v)).alias(f"z{i}") for i, (c, v) in enumerate(zip(x, m, strict=True))]))
    # The times never change: they are put in order and cut into blocks once.
    o = Ordered(z.select("t").distinct(), [F.col("t").desc()])
    z = checkpoint(z.join(o._blocks(o.block_rows).select("t", F.col(o.pos).alias("p"), F.col(o.block).alias("blk")), "t").drop("t"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    xs = [F.col(f"z{i}") for i in range(k)]
    b, ll = np.zeros(k), -math.inf
    for _ in range(max_iter):
        w = z.withColumn("w", F.exp(linear(b, xs)))
        c = w.groupBy("p", "blk").agg(F.sum("e").alias("d"), F.sum("w").alias("s0"), *[F.sum(F.col("w") * xs[i]).alias(f"s{i + 1}") for i in range(k)], *[F.sum(F.col("w") * xs[i] * xs[j]).alias(f"q{i}_{j}") for i, j in pairs], *[F.sum(F.when(F.col("e") == 1, xs[i]).otherwise(0.0)).alias(f"x{i}") for i in range(k)])
        names = [f"s{i}" for i in range(k + 1)] + [f"q{i}_{j}" for i, j in pairs]
        here = Window.partitionBy("blk").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        tots = prefix_sum(c.groupBy("blk").agg(*[F.sum(n).alias(n) for n in names]), [], "blk", names, [f"c_{n}" for n in names]).select("blk", *[f"c_{n}" for n in names])
        run = c.select("*", *[F.sum(n).over(here).alias(f"r_{n}") for n in names]).join(tots, "blk").where("d > 0")
        s = {n: F.col(f"r_{n}") + F.col(f"c_{n}") for n in names}
        r = run.agg(F.sum(linear(b, [F.col(f"x{i}") for i in range(k)]) - F.col("d") * F.ln(s["s0"])).alias("ll"), F.sum("d").alias("d"), *[F.sum(F.col(f"x{i}") - F.col("d") * s[f"s{i + 1}"] / s["s0"]).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("d") * (s[f"q{i}_{j}"] / s["s0"] - s[f"s{i + 1}"] * s[f"s{j + 1}"] / (s["s0"] * s["s0"]))).alias(f"h{i}_{j}") for i, j in pairs]).first()
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        step = np.linalg.solve(h, [r[f"g{i}"] for i in range(k)])
        done = abs(r["ll"] - ll) <= tol * (1 + abs(r["ll"]))
        ll = r["ll"]
        if done:
            break
        b = b + step
    return Fit(list(x), b, np.linalg.inv(h), math.inf, {"log_likelihood": ll, "events": r["d"]}, [col(c) for c in x])


def hazard_ratio(df: DataFrame, fit: Fit, out: str = "hazard_ratio") -> DataFrame:
    return df.withColumn(out, F.exp(linear(fit.params, fit.exprs)))

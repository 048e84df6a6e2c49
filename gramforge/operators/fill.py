"""Filling missing values from rows of the same group and time.

Numeric fields follow a mixed-effects model y = mu + u_group + v_time + e with
random group and time effects. The variance components solve the expectations of the two between-level
sums of squares together, given the within-cell one; effects are best linear unbiased predictors,
i.e. level means shrunk by n*s2/(n*s2 + s2_error), refined by alternating sweeps
on the table of (group, time) cells.

Categorical fields follow a multinomial model with group and time effects,
log P(c | g, t) = log share_c + a_gc + b_tc + const, both effects shrunken: with the other effect fixed, the
multiplier exp(a_gc) is the posterior mean (n_gc + s*share_c) / (E_gc + s*share_c) of a gamma-Poisson model, E_gc being the count
expected without it and s the strength, estimated by moments. Without a time this is the Dirichlet-multinomial rule
P(c | g) = (n_gc + s*share_c) / (n_g + s).

Every step works on pre-aggregated cells; rows that already hold a value are never
shuffled, only rows to be filled are joined with the fitted effects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.util import checkpoint, col, free_name, join_on, require


def _branches(df: DataFrame, valid: Column, group: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay as they are, and rows that may be filled."""
    open_ = ~F.coalesce(valid, F.lit(False)) & col(group).isNotNull()
    return df.where(~open_), df.where(open_)


def _strength(pairs: DataFrame, level: str, shares: DataFrame) -> float:
    """Prior weight s of a factor by moments: two rows of a level agree with chance (1 + s*Q)/(1 + s), Q being the chance over all rows."""
    lv = pairs.groupBy(level).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("a"))
    r = lv.agg(F.sum("a").alias("a"), F.sum(F.col("n") * (F.col("n") - 1)).alias("p"), F.sum("n").alias("n")).first()
    if not r["p"]:
        return 1.0
    q = shares.agg(F.sum(F.pow("share", 2))).first()[0]
    agree = r["a"] / r["p"]
    return min(1e6, max(1e-3, (1 - agree) / (agree - q))) if agree > q else 1e6


class _Multinomial:
    """Multipliers th of (g, c) and ps of (t, c); pairs that never occur have the multiplier of a count of 0."""

    def __init__(self, cells: DataFrame, timed: bool, strength: float | None, sweeps: int):
        self.shares = checkpoint(cells.groupBy("c").agg(F.sum("n").alias("tot")).select("c", (F.col("tot") / cells.agg(F.sum("n")).scalar()).alias("share")))
        gc = cells.groupBy("g", "c").agg(F.sum("n").alias("n"))
        self.s = _strength(gc, "g", self.shares) if strength is None else strength
        self.of_g = cells.groupBy("g").agg(F.sum("n").alias("ng")).withColumn("th0", F.lit(self.s) / (F.col("ng") + self.s))
        self.gc = gc.join(self.shares, "c").join(self.of_g, "g")
        self.th = self._multiplier(self.gc, F.col("ng"), self.s)
        self.ps = None
        if not timed:
            return
        tc = cells.groupBy("t", "c").agg(F.sum("n").alias("n"))
        st = _strength(tc, "t", self.shares) if strength is None else strength
        self.of_t = checkpoint(cells.groupBy("t").agg(F.sum("n").alias("nt")).withColumn("ps0", F.lit(st) / (F.col("nt") + st)))
        gt = checkpoint(join_on(cells.groupBy("g", "t").agg(F.sum("n").alias("m")).join(self.of_g, "g"), self.of_t, ["t"], "inner"))
        for _ in range(sweeps):
            # What the group effects let expect: every class at its group's multiplier, seen classes at their own.
            rest = gt.groupBy("t").agg(F.sum(F.col("m") * F.col("th0")).alias("rest"))
            own = self.th.select("g", "c", "th").join(gt, "g").groupBy("t", "c").agg(F.sum(F.col("m") * (F.col("th") - F.col("th0"))).alias("own"))
            x = join_on(join_on(tc.join(self.shares, "c"), rest, ["t"], "inner"), own, ["t", "c"])
            self.ps = checkpoint(self._multiplier(x, F.col("rest") + F.coalesce("own", F.lit(0.0)), st).select("t", "c", F.col("th").alias("ps")))
            rest = gt.groupBy("g").agg(F.sum(F.col("m") * F.col("ps0")).alias("rest"))
            own = join_on(self.gc.select("g", "c").join(gt, "g"), self.ps, ["t", "c"], "inner").groupBy("g", "c").agg(F.sum(F.col("m") * (F.col("ps") - F.col("ps0"))).alias("own"))
            x = self.gc.join(rest, "g").join(own, ["g", "c"], "left")
            self.th = checkpoint(self._multiplier(x, F.col("rest") + F.coalesce("own", F.lit(0.0)), self.s))

    @staticmethod
    def _multiplier(x: DataFrame, expected: Column, s: float) -> DataFrame:
        """th = (n + s*share) / (share*expected + s*share)."""
        return x.withColumn("th", (F.col("n") + s * F.col("share")) / (F.col("share") * (expected + s)))

    def best(self, wanted: DataFrame | None) -> DataFrame:
        """(g, [t,] best): the most probable class seen in the group; of equal scores the smallest."""
        score = F.ln("share") + F.ln("th")
        if self.ps is None:
            x, keys = self.th, ["g"]
        else:
            x = join_on(join_on(wanted.join(self.th.select("g", "c", "share", "th"), "g"), self.ps, ["t", "c"]), self.of_t, ["t"])
            score, keys = score + F.ln(F.coalesce("ps", "ps0", F.lit(1.0))), ["g", "t"]
        # The least (-score, class); scores are rounded, as equal ones may differ in their last digits.
        return x.groupBy(*keys).agg(F.min(F.struct(F.round(-score, 9).alias("a"), F.col("c").alias("b")))["b"].alias("best"))


def fill_category(df: DataFrame, column: str, group: str, *, time: str | None = None, valid: Column | None = None, strength: float | None = None, sweeps: int = 1, mask: str | None = None) -> DataFrame:
    """Fill `column` with the most probable class of the row's `group` (and `time`) under the multinomial model.

    Candidates are the classes seen in the group; of equally probable ones the smallest is taken. `valid` says which values are
    given (default: not NULL); all others are missing. strength: prior weight of both effects (default: estimated for each). sweeps: times the
    time and group effects are re-estimated given each other. Result: all rows and columns of
    `df`, `column` filled where possible and NULL where a missing value cannot be filled,
    and a boolean `mask` column (default `<column>_was_filled`, with underscores appended
    while that name is taken) that is true exactly for filled values. A NULL group, a group
    without a given value and an empty table fill nothing. A NULL time is a level of its own; a time without given values has no effect. Repeated rows count each.
    """
    require(df, column, group, *([time] if time else []))
    valid = col(column).isNotNull() if valid is None else valid
    mask = free_name(mask or f"{column}_was_filled", df.columns)
    keep, todo = _branches(df, valid, group)
    at = col(time) if time else F.lit(0)
    given = df.where(F.coalesce(valid, F.lit(False)) & col(group).isNotNull())
    cells = checkpoint(given.groupBy(col(group).alias("g"), at.alias("t"), col(column).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    model = _Multinomial(cells, time is not None, strength, sweeps)
    best = model.best(todo.select(col(group).alias("g"), at.alias("t")).distinct() if time else None)
    g_, t_, best_ = (free_name(x, [*df.columns, mask]) for x in ("_g", "_t", "_best"))
    best = checkpoint(best.select(F.col("g").alias(g_), *([F.col("t").alias(t_)] if time else []), F.col("best").alias(best_)))
    on = col(group) == col(g_)
    if time:
        on &= col(time).eqNullSafe(col(t_))
    own = [col(c) if c != column else F.when(F.coalesce(valid, F.lit(False)), col(c)).alias(c) for c in df.columns]
    filled = todo.join(best, on, "left").select(*[col(c) if c != column else col(best_).alias(c) for c in df.columns], col(best_).isNotNull().alias(mask))
    return keep.select(*own, F.lit(False).alias(mask)).unionByName(filled)


def cell_moments(df: DataFrame, column: str, group: str, time: str | None, valid: Column, link: str) -> DataFrame:
    """Count, sum, within-cell squares, least and greatest value per (group, time) cell of the given values."""
    y = F.ln(col(column).cast("double")) if link == "log" else col(column).cast("double")
    t = col(time) if time else F.lit(0)
    cells = df.where(F.coalesce(valid, F.lit(False)) & col(group).isNotNull()).groupBy(col(group).alias("g"), t.alias("t"))
    cells = cells.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.min(col(column)).alias("lo"), F.max(col(column)).alias("hi"))
    return cells.select("g", "t", "n", (F.col("n") * F.col("m")).alias("s"), (F.col("n") * F.col("v")).alias("ss"), "lo", "hi")


def _between(cells: DataFrame, key: str) -> DataFrame:
    """One row of one factor: levels k, sum of squares b between level means, sum q of squared level sizes, and x, the sum over cells of size^2 / level size."""
    lv = cells.groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean = F.sum("s") / F.sum("n")
    return lv.agg(
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("n") * mean * mean).alias("b"),
        F.sum(F.col("n") * F.col("n")).alias("q"),
        F.sum(F.col("nn") / F.col("n")).alias("x"),
    )


@dataclass(frozen=True)
class VarianceComponents:
    """Mean, error variance and the variances of group and time effects."""

    mu: float
    se: float
    su: float
    sv: float


def variance_components(cells: DataFrame) -> VarianceComponents:
    """By the method of moments from one row of sums.

    E(b_group) = (k_g - 1) s2e + (n - q_g/n) s2u + (x_g - q_t/n) s2v and likewise for time are solved together, so that in an
    unbalanced table the variance of one factor is not taken for the other's. Where that gives no admissible pair, each
    factor's equation is solved without the other's term, which errs upwards and so shrinks less.
    """
    base = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("w"), F.count(F.lit(1)).alias("c")).select(F.struct("*").alias("base"))
    g, t = (_between(cells, k).select(F.struct("*").alias("r")).scalar() for k in ("g", "t"))
    r = base.select("base.*", g.alias("g"), t.alias("t")).first()
    if not r["n"]:
        return VarianceComponents(0.0, 0.0, 0.0, 0.0)
    n, se = r["n"], r["w"] / (r["n"] - r["c"]) if r["n"] > r["c"] else 0.0
    g, t = r["g"], r["t"]
    a, b, c, d = n - g["q"] / n, g["x"] - t["q"] / n, t["x"] - g["q"] / n, n - t["q"] / n
    y, z = g["b"] - (g["k"] - 1) * se, t["b"] - (t["k"] - 1) * se
    det = a * d - b * c
    su, sv = ((d * y - b * z) / det, (a * z - c * y) / det) if det > 1e-9 * n * n else (-1.0, -1.0)
    if min(su, sv) < 0:
        su, sv = y / a if a > 0 else 0.0, z / d if d > 0 else 0.0
    return VarianceComponents(r["s"] / n, se, max(0.0, su), max(0.0, sv))


def _effects(cells: DataFrame, key: str, other: DataFrame | None, other_key: str, vc: VarianceComponents, var: str) -> DataFrame:
    """Shrunken effects of the levels of `key`, given the other factor's effects."""
    x = cells if other is None else cells.join(other, other_key, "left")
    off = F.lit(0.0) if other is None else F.coalesce(F.col("e"), F.lit(0.0))
    lv = x.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("s") - F.col("n") * off).alias("s"), *([F.min("lo").alias("lo"), F.max("hi").alias("hi")] if key == "g" else []))
    s2 = getattr(vc, var)
    r = F.col("s") - F.col("n") * vc.mu
    den = F.col("n") * s2 + vc.se
    eff = F.when(den > 0, r * s2 / den).otherwise(0.0)
    return lv.select(key, eff.alias("e" if key == "t" else "u"), *(["lo", "hi"] if key == "g" else []))


def fill_numeric(df: DataFrame, column: str, group: str, *, time: str | None = None, valid: Column | None = None, link: str = "identity", sweeps: int = 2, mask: str | None = None) -> DataFrame:
    """Fill `column` with its mixed-effects prediction from rows of the same `group` and `time`.

    valid: which values are given (default: neither NULL nor NaN); all others are missing.
    link: "log" models the logarithm (the given values must then be positive), so the value filled in is the median of the
    row's distribution and lies below its mean. sweeps: times the
    time and group effects are re-estimated given each other. A missing value is filled if
    its group is not NULL and has a given value; the prediction is kept inside the group's own range
    and rounded for integral columns. A time level without given values has effect 0.
    Result: all rows and columns of `df`; values that stay missing are NULL; the
    boolean `mask` column (default `<column>_was_filled`, underscores appended while
    taken) is true exactly for filled values. Repeated rows count each; an empty
    table gives an empty one.
    """
    require(df, column, group, *([time] if time else []))
    kind = dict(df.dtypes)[column]
    if valid is None:
        valid = col(column).isNotNull() & (~F.isnan(col(column)) if kind in ("double", "float") else F.lit(True))
    mask = free_name(mask or f"{column}_was_filled", df.columns)
    cells = checkpoint(cell_moments(df, column, group, time, valid, link))
    vc = variance_components(cells)
    u = _effects(cells, "g", None, "", vc, "su")
    v = None
    for _ in range(sweeps if time else 0):
        v = _effects(cells.join(u.select("g", "u"), "g").withColumn("s", F.col("s") - F.col("n") * F.col("u")), "t", None, "", vc, "sv")
        v = checkpoint(v)
        u = _effects(cells, "g", v, "t", vc, "su")
    g_, u_, lo_, hi_, t_, e_, p_ = (free_name(x, [*df.columns, mask]) for x in ("_g", "_u", "_lo", "_hi", "_t", "_e", "_p"))
    keep, todo = _branches(df, valid, group)
    own = [col(c) if c != column else F.when(F.coalesce(valid, F.lit(False)), col(c)).alias(c) for c in df.columns]
    u = u.select(F.col("g").alias(g_), F.col("u").alias(u_), F.col("lo").alias(lo_), F.col("hi").alias(hi_))
    x = todo.join(u, col(group) == F.col(g_), "left")
    if v is not None:
        x = x.join(v.select(F.col("t").alias(t_), F.col("e").alias(e_)), col(time) == F.col(t_), "left")
    pred = F.lit(vc.mu) + F.col(u_) + (F.coalesce(F.col(e_), F.lit(0.0)) if v is not None else F.lit(0.0))
    pred = F.exp(pred) if link == "log" else pred
    pred = F.least(F.greatest(pred, F.col(lo_).cast("double")), F.col(hi_).cast("double"))
    pred = F.when(F.col(u_).isNotNull(), pred if kind in ("double", "float") or kind.startswith("decimal") else F.round(pred)).cast(kind)
    x = x.withColumn(p_, pred)
    filled = x.select(*[col(c) if c != column else F.col(p_).alias(c) for c in df.columns], F.col(p_).isNotNull().alias(mask))
    return keep.select(*own, F.lit(False).alias(mask)).unionByName(filled)

"""Regression families whose SQL solves the same equations: least squares by successive orthogonalisation, likelihoods by Newton steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from gramforge.models import causal, glm, linear, panel, stats, survival, timeseries
from gramforge.queries.estimators import _DAILY, _LIFE, _daily, _fit, _life, _lines, _monthly, _row, _two
from gramforge.util import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def least_squares(p: str, source: str, y: str, xs: Sequence[str], *, const: bool = True, weight: str = "1.0") -> str:
    """CTEs ending in `p`: one row with n, syy, ssr, b0 (with const), b1.. and se1..; every regressor is made orthogonal to those before it.

    source: what follows FROM. The columns b and se of regressor j are those of the regression on all of them.
    """
    k = len(xs)
    out = [f"{p}_r0 as materialized (select ({y})::double as y, ({weight})::double as w{''.join(f', ({x})::double as x{j}' for j, x in enumerate(xs, 1))} from {source})"]
    for j in range(1, k + 1):
        mean = f"sum(w * x{j}) / sum(w)" if const else "any_value(0.0::double)"
        coefs = "".join(f", sum(w * r{i} * x{j}) / sum(w * r{i} * r{i}) as c{i}_{j}" for i in range(1, j))
        out.append(f"{p}_c{j} as materialized (select {mean} as m{j}{coefs} from {p}_r{j - 1})")
        out.append(f"{p}_r{j} as materialized (select r.*, x{j} - m{j}{''.join(f' - c{i}_{j} * r{i}' for i in range(1, j))} as r{j} from {p}_r{j - 1} r, {p}_c{j})")
    my = "sum(w * y) / sum(w)" if const else "0.0"
    out.append(f"{p}_m as materialized (select {my} as my, count(*) as n from {p}_r{k})")
    out.append(f"{p}_g as materialized (select any_value(my) as my, any_value(n) as n, sum(w * (y - my) * (y - my)) as syy{''.join(f', sum(w * r{j} * (y - my)) as g{j}, sum(w * r{j} * r{j}) as d{j}' for j in range(1, k + 1))} from {p}_r{k}, {p}_m)")
    cols = [f"g{j} / d{j}{''.join(f' - c{j}_{i} * b{i}' for i in range(j + 1, k + 1))} as b{j}" for j in range(k, 0, -1)]
    # Rows of the inverse of the unit triangle of the c's.
    for j in range(1, k + 1):
        cols.append(f"1.0 as v{j}_{j}")
        cols += [f"-({' + '.join(f'v{j}_{m} * c{m}_{i}' for m in range(j, i))}) as v{j}_{i}" for i in range(j + 1, k + 1)]
    cols.append(f"syy{''.join(f' - g{j} * g{j} / d{j}' for j in range(1, k + 1))} as ssr")
    dof = f"(n - {k + (1 if const else 0)})"
    cols += [f"sqrt(ssr / {dof} * ({' + '.join(f'v{j}_{i} * v{j}_{i} / d{i}' for i in range(j, k + 1))})) as se{j}" for j in range(1, k + 1)]
    if const:
        cols.append(f"my{''.join(f' - m{j} * b{j}' for j in range(1, k + 1))} as b0")
    tables = ", ".join([f"{p}_g", *[f"{p}_c{j}" for j in range(1, k + 1)]])
    return ", ".join([*out, f"{p} as materialized (select n, syy, {', '.join(cols)} from {tables})"])


def _terms(p: str, names: Sequence[str], digits: int, *, const: bool = True, se: bool = False, first: int = 1) -> str:
    """A row per term of the regression `p`."""
    rows = [("const", "b0", "null::double")] if const else []
    rows += [(n, f"b{j}", f"se{j}") for j, n in enumerate(names, first)]
    return " union all ".join(f"select '{n}' as term, round({b}, {digits}) as estimate" + (f", round({s}, {digits}) as std_error" if se else "") + f" from {p}" for n, b, s in rows)


def _estimates(spark, fit, digits: int, *, se: bool = False, const: bool = True):
    t = fit.table(spark).select("term", F.round("estimate", digits).alias("estimate"), *([F.round("std_error", digits).alias("std_error")] if se else []))
    return t if const else t.where("term <> 'const'")


# formulas
def _formula(name: str, formula: str, terms: dict[str, str], digits: int = 4, const: bool = True):
    names = list(terms)

    def f(spark, d):
        fit = linear.ols(_lines(spark, d), formula)
        return _estimates(spark, fit, digits)

    f.__name__ = name
    y = {"log(l_extendedprice)": "ln(l_extendedprice)"}.get(formula.split("~")[0].strip(), formula.split("~")[0].strip())
    query(f"with {least_squares('o', 'lineitem', y, list(terms.values()), const=const)} {_terms('o', names, digits, const=const)}")(f)


_formula("formula_star", "l_extendedprice ~ l_quantity * l_tax", {"l_quantity": "l_quantity", "l_tax": "l_tax", "l_quantity:l_tax": "l_quantity * l_tax"})
_formula("formula_colon", "l_extendedprice ~ l_quantity : l_tax", {"l_quantity:l_tax": "l_quantity * l_tax"})
_formula("formula_no_intercept", "l_extendedprice ~ l_quantity + l_tax - 1", {"l_quantity": "l_quantity", "l_tax": "l_tax"}, const=False)
_formula("formula_power", "l_extendedprice ~ I(l_quantity^2) + l_quantity", {"I(l_quantity^2)": "l_quantity * l_quantity", "l_quantity": "l_quantity"}, 3)
_formula("formula_functions", "l_extendedprice ~ log(l_quantity) + sqrt(l_quantity) + exp(l_tax)", {"log(l_quantity)": "ln(l_quantity)", "sqrt(l_quantity)": "sqrt(l_quantity)", "exp(l_tax)": "exp(l_tax)"}, 2)


# least squares and what is built on it
_OLS2 = least_squares("o", "lineitem", "l_extendedprice", ["l_quantity", "l_tax"])


@query(f"with {_OLS2} select 'l_quantity' as term, round(b1, 4) as estimate, round(se1, 5) as std_error, round(b1 / se1, 4) as statistic, round(b1 - 1.959963984540054 * se1, 3) as ci_low, round(b1 + 1.959963984540054 * se1, 3) as ci_high from o union all select 'l_tax', round(b2, 4), round(se2, 5), round(b2 / se2, 4), round(b2 - 1.959963984540054 * se2, 3), round(b2 + 1.959963984540054 * se2, 3) from o")
def ols_with_inference(spark, d):
    t = linear.ols(_lines(spark, d), "l_extendedprice ~ l_quantity + l_tax").with_inference("normal").table(spark).where("term <> 'const'")
    return t.select("term", F.round("estimate", 4).alias("estimate"), F.round("std_error", 5).alias("std_error"), F.round("statistic", 4).alias("statistic"), F.round("ci_low", 3).alias("ci_low"), F.round("ci_high", 3).alias("ci_high"))


@query("""with m as (select count(*) as n, avg(o_totalprice) as my, avg(o_custkey) as mx, regr_sxx(o_totalprice, o_custkey) as sxx, regr_slope(o_totalprice, o_custkey) as b1, regr_intercept(o_totalprice, o_custkey) as b0,
  regr_syy(o_totalprice, o_custkey) - pow(regr_sxy(o_totalprice, o_custkey), 2) / regr_sxx(o_totalprice, o_custkey) as ssr from orders)
select o_orderkey, round(b0 + b1 * o_custkey, 4) as predicted, round(sqrt(ssr / (n - 2) * (1 / n + pow(o_custkey - mx, 2) / sxx)), 4) as pred_se,
  round(b0 + b1 * o_custkey - 1.959963984540054 * sqrt(ssr / (n - 2) * (1 / n + pow(o_custkey - mx, 2) / sxx)), 3) as ci_low,
  round(b0 + b1 * o_custkey + 1.959963984540054 * sqrt(ssr / (n - 2) * (1 + 1 / n + pow(o_custkey - mx, 2) / sxx)), 3) as obs_high from orders, m""")
def ols_prediction(spark, d):
    x = read_table(spark, d, "orders")
    p = linear.ols(x, "o_totalprice ~ o_custkey").with_inference("normal").get_prediction(x)
    return p.select("o_orderkey", F.round("predicted", 4).alias("predicted"), F.round("pred_se", 4).alias("pred_se"), F.round("ci_low", 3).alias("ci_low"), F.round("obs_high", 3).alias("obs_high"))


@query(f"with {_OLS2}, {least_squares('s', 'lineitem', 'l_extendedprice', ['l_quantity'])} select round((s.ssr - o.ssr) / (o.ssr / (o.n - 3)), 5) as f_nested, round(pow(o.b2 / o.se2, 2), 5) as wald, round(o.n * ln(s.ssr / o.ssr), 5) as lr from o, s")
def ols_nested_tests(spark, d):
    x = _lines(spark, d)
    full, short = linear.ols(x, "l_extendedprice ~ l_quantity + l_tax"), linear.ols(x, "l_extendedprice ~ l_quantity")
    return _row(spark, {"f_nested": stats.f_test_nested(short, full)[0], "wald": full.wald_test([0, 0, 1])[0], "lr": stats.lr_test(short, full)[0]}, 5)


@query(f"with {_OLS2} select round(b1 + 2 * b2, 3) as total, round(b2 / b1, 6) as ratio from o")
def ols_combinations(spark, d):
    fit = linear.ols(_lines(spark, d), "l_extendedprice ~ l_quantity + l_tax")
    total, ratio = fit.lincom({"l_quantity": 1, "l_tax": 2})[0], fit.nlcom(lambda b: b[2] / b[1])[0]
    return _row(spark, {"total": round(total, 3), "ratio": ratio}, 6)


@query(f"with {least_squares('o', 'lineitem', 'l_extendedprice', ['l_quantity'], weight='1 + l_linenumber')} {_terms('o', ['l_quantity'], 5, se=True)}".replace("null::double", "(select sqrt(o.ssr / (o.n - 2) * (1 / sum(w) + pow(sum(w * x1) / sum(w), 2) / any_value(o_g.d1))) from o_r1, o_g)"))
def wls_inference(spark, d):
    x = _lines(spark, d).withColumn("w", F.col("l_linenumber") + 1)
    return _estimates(spark, linear.wls(x, "l_extendedprice ~ l_quantity", "w"), 5, se=True)


@query("""with b as (select regr_slope(o_totalprice, o_custkey) as b1, regr_intercept(o_totalprice, o_custkey) as b0, regr_sxx(o_totalprice, o_custkey) as sxx, avg(o_custkey) as mx, count(*) as n,
  regr_syy(o_totalprice, o_custkey) - pow(regr_sxy(o_totalprice, o_custkey), 2) / regr_sxx(o_totalprice, o_custkey) as ssr from orders),
r as (select o_orderkey, o_custkey - mx as c, sxx, o_totalprice - b0 - b1 * o_custkey as e, 1 / n + pow(o_custkey - mx, 2) / sxx as h, ssr / (n - 2) as s2, n from orders, b)
select o_orderkey, round(h, 9) as leverage, round(e / sqrt(s2 * (1 - h)), 6) as student_internal, round(e * e * h / (2 * s2 * pow(1 - h, 2)), 9) as cooks_d,
  round(e / sqrt((s2 * (n - 2) - e * e / (1 - h)) / (n - 3) * (1 - h)) * sqrt(h / (1 - h)), 6) as dffits,
  round(c / sxx * e / (1 - h) / sqrt((s2 * (n - 2) - e * e / (1 - h)) / (n - 3)) * sqrt(sxx), 7) + 0.0 as dfbetas from r""")
def ols_influence(spark, d):
    x = linear.influence(read_table(spark, d, "orders"), "o_totalprice ~ o_custkey")
    return x.select("o_orderkey", F.round("leverage", 9).alias("leverage"), F.round("student_internal", 6).alias("student_internal"), F.round("cooks_d", 9).alias("cooks_d"), F.round("dffits", 6).alias("dffits"), (F.round("dfbetas_o_custkey", 7) + 0.0).alias("dfbetas"))


@query("""with w as (select event_id, case when row_number() over o >= 20 then regr_slope(value, user_id) over (order by event_id rows between 19 preceding and current row) end as b from events window o as (order by event_id))
select event_id, round(b / 0.7, 4) + 0.0 as slope from w where b is not null""")
def rolling_regression(spark, d):
    x = linear.rolling_ols(read_table(spark, d, "events"), "value", ["user_id"], 20, ["event_id"])
    return x.select("event_id", (F.round(F.col("b_user_id") / 0.7, 4) + 0.0).alias("slope")).where("slope is not null and not isnan(slope)")


@query(f"with {_OLS2} select 'l_quantity' as term, round(b1, 4) as estimate from o union all select 'l_tax', round(b2, 4) from o")
def sur_same_regressors(spark, d):
    x = _lines(spark, d)
    return _estimates(spark, linear.sur(x, ["l_extendedprice ~ l_quantity + l_tax", "l_discount ~ l_quantity + l_tax"])[0], 4, const=False)


_IV = "select round(covar_pop(y, z) / covar_pop(x, z), 2) as estimate from (select l_extendedprice as y, l_quantity as x, p_retailprice as z from lineitem join part on l_partkey = p_partkey)"


@query(_IV)
def gmm_just_identified(spark, d):
    j = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = F.lit(1.0)
    return _row(spark, {"estimate": linear.gmm(j, F.col("l_extendedprice"), {"const": one, "x": F.col("l_quantity")}, {"const": one, "z": F.col("p_retailprice")}).params[1]}, 2)


@query(_IV)
def three_stage_just_identified(spark, d):
    j = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _row(spark, {"estimate": linear.three_sls(j, ["l_extendedprice ~ l_quantity", "l_tax ~ l_quantity"], {"const": F.lit(1.0), "z": F.col("p_retailprice")})[0].params[1]}, 2)


@query("select round(pow(corr(l_quantity, p_retailprice), 2) / (1 - pow(corr(l_quantity, p_retailprice), 2)) * (count(*) - 2), 5) as f from lineitem join part on l_partkey = p_partkey")
def first_stage(spark, d):
    j = _lines(spark, d).join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _row(spark, {"f": linear.first_stage_f(j, F.col("l_quantity"), {"const": F.lit(1.0)}, {"z": F.col("p_retailprice")})}, 5)


@query(f"with {_OLS2} select round(b1, 3) as slope, round(b2, 2) as tax from o")
def nls_linear(spark, d):
    fit = linear.nls(_lines(spark, d), "l_extendedprice", ["l_quantity", "l_tax"], lambda b, m: b[0] + b[1] * m[:, 0] + b[2] * m[:, 1], [0.0, 1.0, 1.0])
    return _row(spark, {"slope": round(float(fit.params[1]), 3), "tax": round(float(fit.params[2]), 2)}, 3)


@query("""with s as (select count(*) as n, stddev_pop(l_quantity) as sx, avg(l_quantity) as mx, avg(l_extendedprice) as my, covar_pop(l_quantity, l_extendedprice) as sxy from lineitem),
r as (select my, mx, sxy / sx / (1 + 0.5) / sx as ridge, sign(sxy) * greatest(abs(sxy / sx) - 100, 0) / sx as lasso from s)
select round(ridge, 5) as ridge, round(my - mx * ridge, 4) as ridge_const, round(lasso, 5) as lasso from r""")
def penalised(spark, d):
    x = _lines(spark, d)
    r, la = linear.ridge(x, "l_extendedprice ~ l_quantity", 0.5), linear.lasso(x, "l_extendedprice ~ l_quantity", 100.0)
    return spark.createDataFrame([(round(float(r[1]), 5), round(float(r[0]), 4), round(float(la[1]), 5))], "ridge double, ridge_const double, lasso double")


@query("""with e as (select case when l_linenumber = 7 then null else l_linenumber end as k, avg(l_extendedprice) as m from lineitem group by 1), r as (select avg(l_extendedprice) as m from lineitem where l_linenumber in (7, 1))
select 'event_' || k as term, round(e.m - r.m, 4) as estimate from e, r where k between 2 and 6""")
def event_study_means(spark, d):
    x = _lines(spark, d).withColumn("k", F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")))
    return _estimates(spark, linear.event_study(x, "l_extendedprice", "k", 1, 1, 6), 4, const=False)


@query("""with m as (select count(*) as n, sum(q) as sx, sum(q * q) as sxx, sum(y) as sy, sum(q * y) as sxy from (select l_quantity as q, l_extendedprice as y from lineitem))
select round(((n + 0.5) * sxy - sx * sy) / ((n + 0.5) * (sxx + 0.5) - sx * sx), 6) as slope from m""")
def bayesian_posterior_mean(spark, d):
    from gramforge.models.bayes import bayesian_linear

    return _row(spark, {"slope": bayesian_linear(_lines(spark, d), "l_extendedprice ~ l_quantity", prior_precision=0.5).params[1]})


# diagnostics
_RES = "e as (select l_quantity as x, l_tax as z, l_extendedprice - regr_intercept(l_extendedprice, l_quantity) over () - regr_slope(l_extendedprice, l_quantity) over () * l_quantity as u, regr_intercept(l_extendedprice, l_quantity) over () + regr_slope(l_extendedprice, l_quantity) over () * l_quantity as f, l_extendedprice as y from lineitem)"


@query(f"with {_RES}, {least_squares('w', 'e', 'u * u', ['x', 'x * x'])} select round(n * (1 - ssr / syy), 4) as lm from w")
def white(spark, d):
    return _row(spark, {"lm": stats.white_test(_lines(spark, d), "l_extendedprice ~ l_quantity")[0]}, 4)


@query(f"with {_RES}, {least_squares('a', 'e', 'y', ['x', 'f * f'])}, {least_squares('b', 'e', 'y', ['x'])} select round((b.ssr - a.ssr) / (a.ssr / (a.n - 3)), 4) as f from a, b")
def reset(spark, d):
    return _row(spark, {"f": stats.reset_test(_lines(spark, d), "l_extendedprice ~ l_quantity", 2)[0]}, 4)


_EV = "v as (select event_id, user_id as x, value - regr_intercept(value, user_id) over () - regr_slope(value, user_id) over () * user_id as u from events), l as (select event_id, x, u, lag(u) over (order by event_id) as l1, lag(u, 2) over (order by event_id) as l2 from v), z as (select * from l where l2 is not null)"


@query(f"with {_EV}, {least_squares('g', 'z', 'u', ['x', 'l1', 'l2'])} select round(n * (1 - ssr / syy), 5) as lm from g")
def breusch_godfrey(spark, d):
    return _row(spark, {"lm": stats.breusch_godfrey(read_table(spark, d, "events"), "value ~ user_id", 2, ["event_id"])[0]}, 5)


@query("""with a as (select count(*) as n, avg(l_tax) as m, var_samp(l_tax) as v, sum((l_tax > 0.03)::int) as k from lineitem), z as (select avg(l_discount - l_tax) as m, var_samp(l_discount - l_tax) as v from lineitem),
b as (select avg(c_acctbal) as m, var_samp(c_acctbal) as v, count(*) as n from customer where c_mktsegment = 'BUILDING'), h as (select avg(c_acctbal) as m, var_samp(c_acctbal) as v, count(*) as n from customer where c_mktsegment = 'MACHINERY')
select round((a.m - 0.04) / sqrt(a.v / a.n), 5) as one_sample, round(z.m / sqrt(z.v / a.n), 5) as paired, round((b.m - h.m) / sqrt(((b.n - 1) * b.v + (h.n - 1) * h.v) / (b.n + h.n - 2) * (1 / b.n + 1 / h.n)), 5) as pooled,
  round((k / a.n - 0.5) / sqrt(0.25 / a.n), 5) as proportion, round((k / a.n + 3.841458820694124 / (2 * a.n) - 1.959963984540054 * sqrt(k / a.n * (1 - k / a.n) / a.n + 3.841458820694124 / (4 * a.n * a.n))) / (1 + 3.841458820694124 / a.n), 7) as wilson_low from a, z, b, h""")
def t_and_proportion_tests(spark, d):
    x, c = _lines(spark, d), read_table(spark, d, "customer")
    n, k = x.count(), x.where("l_tax > 0.03").count()
    v = {"one_sample": stats.ttest_1samp(x, "l_tax", 0.04)["t"], "paired": stats.ttest_paired(x, "l_discount", "l_tax")["t"], "pooled": stats.ttest_ind(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment = 'MACHINERY'"), "c_acctbal", pooled=True)["t"], "proportion": stats.proportion_ztest(k, n, 0.5)[0]}
    return _row(spark, v, 5).withColumn("wilson_low", F.lit(round(stats.proportion_confint(k, n)[0], 7)))


@query("""with p as (select count(*) as n, avg(o_totalprice) as m, var_pop(o_totalprice) as m2 from orders), q as (select n, m2, avg(pow(o_totalprice - m, 3)) as m3, avg(pow(o_totalprice - m, 4)) as m4, avg(o_totalprice * o_totalprice) as raw2 from orders, p group by n, m2)
select round(n * n / ((n - 1.0) * (n - 2)) * m3 / pow(m2, 1.5), 8) as skewness, round(n * n * (n + 1.0) / ((n - 1.0) * (n - 2) * (n - 3)) * m4 / (m2 * m2) - 3 * pow(n - 1.0, 2) / ((n - 2.0) * (n - 3)), 8) as kurtosis, round(raw2 / 1e10, 7) as raw2 from q""")
def moments(spark, d):
    x = read_table(spark, d, "orders")
    return spark.createDataFrame([(round(stats.skewness(x, "o_totalprice"), 8), round(stats.kurtosis(x, "o_totalprice"), 8), round(stats.raw_moments(x, "o_totalprice", 2)[1] / 1e10, 7))], "skewness double, kurtosis double, raw2 double")


@query("select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean, round(var_samp(o_totalprice) / 1e6, 3) as var from orders group by 1")
def group_summary(spark, d):
    return stats.group_stats(read_table(spark, d, "orders"), "o_totalprice", "o_orderstatus").select("o_orderstatus", "n", F.round("mean", 4).alias("mean"), F.round(F.col("var") / 1e6, 3).alias("var"))


@query("""with t as (select count(*) filter (l_returnflag = 'R' and l_quantity / 50 >= 0.5) as tp, count(*) filter (l_returnflag <> 'R' and l_quantity / 50 >= 0.5) as fp, count(*) filter (l_returnflag = 'R') as p, count(*) as n from lineitem)
select round((tp + n - p - fp) / n, 8) as accuracy, round(tp / p, 8) as sensitivity, round((n - p - fp) / (n - p), 8) as specificity from t""")
def classification(spark, d):
    x = _lines(spark, d).withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).withColumn("s", F.col("l_quantity") / 50)
    r = stats.classification_table(x, "y", "s")
    return _row(spark, {k: r[k] for k in ("accuracy", "sensitivity", "specificity")}, 8)


# panel
_FE2 = "w as (select l_suppkey as g, l_extendedprice - avg(l_extendedprice) over s as y, l_quantity - avg(l_quantity) over s as x1, l_tax - avg(l_tax) over s as x2, l_discount - avg(l_discount) over s as z from lineitem window s as (partition by l_suppkey))"


@query(f"with {_FE2}, {least_squares('o', 'w', 'y', ['x1', 'x2'], const=False)}, k as (select count(distinct g) as g from w) select 'l_quantity' as term, round(b1, 5) as estimate, round(se1 * sqrt((n - 2) / (n - k.g - 2)), 5) as std_error from o, k union all select 'l_tax', round(b2, 5), round(se2 * sqrt((n - 2) / (n - k.g - 2)), 5) from o, k")
def fixed_effects_two(spark, d):
    return _estimates(spark, panel.fixed_effects(_lines(spark, d), "l_extendedprice", ["l_quantity", "l_tax"], "l_suppkey"), 5, se=True)


@query(f"with {_FE2} select round(sum(z * y) / sum(z * x1), 2) as estimate from w")
def fe_two_stage(spark, d):
    return _row(spark, {"estimate": panel.fe_2sls(_lines(spark, d), "l_extendedprice", ["l_quantity"], ["l_discount"], "l_suppkey").params[0]}, 2)


_RE = f"""a as (select l_suppkey as g, count(*) as t, avg(l_extendedprice) as my, avg(l_quantity) as mx from lineitem group by 1),
i as (select l_suppkey as g, l_extendedprice - my as y, l_quantity - mx as x from lineitem join a on a.g = l_suppkey),
fe as (select sum(x * y) / sum(x * x) as b, (sum(y * y) - pow(sum(x * y), 2) / sum(x * x)) / (count(*) - count(distinct g) - 1) as se2, 1 / sum(x * x) as xx from i),
be as (select (regr_syy(my, mx) - pow(regr_sxy(my, mx), 2) / regr_sxx(my, mx)) / (count(*) - 2) as sb, count(*) / sum(1.0 / t) as tbar from a),
v as (select se2, b as fb, xx * se2 as fv, greatest(0, sb - se2 / tbar) as su2 from fe, be),
q as (select 1 - theta as c, l_extendedprice - theta * my as y, l_quantity - theta * mx as x from (select *, 1 - sqrt(se2 / (se2 + t * su2)) as theta from a, v) a join lineitem on l_suppkey = g),
{least_squares('r', 'q', 'y', ['c', 'x'], const=False)}"""


@query(f"with {_RE} select 'const' as term, round(b1, 3) as estimate, round(se1, 3) as std_error from r union all select 'l_quantity', round(b2, 3), round(se2, 3) from r")
def random_effects(spark, d):
    return _estimates(spark, panel.random_effects(_lines(spark, d), "l_extendedprice", ["l_quantity"], "l_suppkey"), 3, se=True)


_MONTHLY = "mo as (select o_custkey as u, date_diff('month', date '1990-01-01', date_trunc('month', o_orderdate)::date) as m, sum(o_totalprice) as total, count(*)::double as orders from orders group by all)"


@query(f"with {_MONTHLY}, j as (select *, avg(orders) over (partition by u) as mean_orders from mo), {least_squares('o', 'j', 'total', ['orders', 'mean_orders'])} {_terms('o', ['orders', 'mean_orders'], 3)}")
def mundlak(spark, d):
    return _estimates(spark, panel.mundlak(_monthly(spark, d), "total", ["orders"], "o_custkey")[0], 3)


@query(f"""with {_MONTHLY}, f as (select u, m, total - lag(total) over w as dy, orders - lag(orders) over w as dx from mo window w as (partition by u order by m)), b as (select sum(dx * dy) / sum(dx * dx) as b from f where dy is not null),
e as (select u, m, dy - b * dx as e from f, b where dy is not null), l as (select u, e, lag(e) over (partition by u order by m) as l from e), z as (select u, e, l from l where l is not null),
r as (select sum(e * l) / sum(l * l) as rho, sum(l * l) as ll, count(*) as n from z), s as (select u, sum(l * (e - rho * l)) as s from z, r group by u)
select round(pow((rho + 0.5) / (sqrt((select sum(s * s) from s) * g / (g - 1) * (n - 1) / (n - 1)) / ll), 2), 3) as statistic from r, (select count(*) as g from s)""")
def wooldridge_serial(spark, d):
    return _row(spark, {"statistic": panel.wooldridge_serial(_monthly(spark, d), "total", ["orders"], "o_custkey", "month")[0]}, 3)


_PANEL = "p as (select l_suppkey % 5 as g, year(l_shipdate) as t, avg(l_extendedprice) as e from lineitem group by all)"


@query(f"""with {_PANEL}, c as (select distinct a.g from p a), u as (select g, t, (e - avg(e) over w) / stddev_pop(e) over w / sqrt(count(*) over w) as u from p window w as (partition by g)),
s as (select t, sum(u) as s from u group by 1) select round(sqrt(2.0 / (n * (n - 1))) * sqrt(t) * (x - n) / 2, 6) as cd from (select count(*) as n from c), (select max(k) as t from (select count(*) as k from p group by g)), (select sum(s * s) as x from s)""")
def cross_section_dependence(spark, d):
    x = _lines(spark, d).groupBy((F.col("l_suppkey") % 5).alias("g"), F.year("l_shipdate").alias("t")).agg(F.avg("l_extendedprice").alias("e"))
    return _row(spark, {"cd": panel.pesaran_cd(x, "e", "g", "t")[0]})


# series
_L = "l as (select day, total, lag(total) over (order by day) as l1, lag(total, 2) over (order by day) as l2, lag(total, 3) over (order by day) as l3 from daily)"


@query(f"with {_DAILY}, {_L}, k as (select * from l where l2 is not null), {least_squares('o', 'k', 'total', ['l1', 'l2'])} {_terms('o', ['L1.total', 'L2.total'], 5, se=True)}")
def autoreg_two(spark, d):
    t = _fit(spark, timeseries.autoreg(_daily(spark, d), "total", 2, ["day"]), 5)
    return t.withColumn("std_error", F.when(F.col("term") != "const", F.col("std_error")))


@query(f"with {_DAILY}, {_L}, k as (select total - l1 as y, l1, l1 - l2 as d1 from l where l2 is not null), {least_squares('o', 'k', 'y', ['d1', 'l1'])} select round(b2 / se2, 5) as statistic from o")
def adf_statistic(spark, d):
    return _row(spark, {"statistic": timeseries.adf(_daily(spark, d), "total", ["day"], 1)["statistic"]}, 5)


_TWO_SQL = "two as (select cast(o_orderdate as date) as day, sum(o_totalprice) / 1e5 as total, count(*)::double as n from orders group by 1), l as (select total, n, lag(total) over w as t1, lag(total, 2) over w as t2, lag(n) over w as n1, lag(n, 2) over w as n2 from two window w as (order by day)), k as (select * from l where t2 is not null)"


@query(f"with {_TWO_SQL}, {least_squares('a', 'k', 'total', ['t1', 't2', 'n1', 'n2'])}, {least_squares('s', 'k', 'total', ['t1', 't2'])} select round((s.ssr - a.ssr) / 2 / (a.ssr / (a.n - 5)), 5) as f from a, s")
def granger(spark, d):
    return _row(spark, {"f": timeseries.granger_causality(_two(spark, d), "total", "n", 2, ["day"])[0]}, 5)


_VAR = ["total.L1", "n.L1", "total.L2", "n.L2"]


@query(f"with {_TWO_SQL}, {least_squares('a', 'k', 'total', ['t1', 'n1', 't2', 'n2'])}, {least_squares('b', 'k', 'n', ['t1', 'n1', 't2', 'n2'])} select 'total' as equation, * from ({_terms('a', _VAR, 5)}) union all select 'n', * from ({_terms('b', _VAR, 5)})")
def var_model(spark, d):
    v = timeseries.VAR(_two(spark, d), ["total", "n"], 2, ["day"])
    rows = [(c, t, round(float(b), 5)) for c, f in zip(v.names, v.fits, strict=True) for t, b in zip(f.names, f.params, strict=True)]
    return spark.createDataFrame(rows, "equation string, term string, estimate double")


@query(f"with {_TWO_SQL.replace('where t2 is not null', 'where t1 is not null')}, {least_squares('a', 'k', 'total', ['t1', 'n', 'n1'])} select 'long_run' as term, round((b2 + b3) / (1 - b1), 5) as estimate from a union all select 'L1.total', round(b1, 5) from a")
def ardl_long_run(spark, d):
    f = timeseries.ardl(_two(spark, d), "total", ["n"], 1, 1, ["day"])
    return spark.createDataFrame([("long_run", round(f.stats["long_run_n"], 5)), ("L1.total", round(float(f.params[f.names.index("L1.total")]), 5))], "term string, estimate double")


@query("with s as (select value * value as v, event_id from events), l as (select v, lag(v) over w as l1, lag(v, 2) over w as l2 from s window w as (order by event_id)), k as (select * from l where l2 is not null), " + least_squares("a", "k", "v", ["l1", "l2"]) + " select round(n * (1 - ssr / syy), 5) as lm from a")
def arch_lm(spark, d):
    return _row(spark, {"lm": timeseries.arch_test(read_table(spark, d, "events"), "value", 2, ["event_id"])[0]}, 5)


@query("""with m as (select event_id, value - avg(value) over () as v from events), l as (select v, lag(v) over w as l1, lag(v, 2) over w as l2 from m window w as (order by event_id)), r as (select sum(v * l1) / sum(v * v) as r1, sum(v * l2) / sum(v * v) as r2 from l)
select round(r1, 8) as p1, round((r2 - r1 * r1) / (1 - r1 * r1), 8) as p2 from r""")
def partial_autocorrelation(spark, d):
    r = timeseries.pacf(read_table(spark, d, "events"), "value", 2, ["event_id"])
    return _row(spark, {"p1": r[1], "p2": r[2]}, 8)


@query("select event_id, value, lag(value) over (order by event_id) as value__l1, lag(value, 2) over (order by event_id) as value__l2 from events")
def lag_matrix(spark, d):
    return timeseries.lagmat(read_table(spark, d, "events"), "value", 2, ["event_id"]).select("event_id", "value", "value__l1", "value__l2")


# causal
@query("with " + ", ".join(least_squares(p, f"(select l_extendedprice as y, l_quantity - 25 as x, 1 - abs(l_quantity - 25) / 10 as w from lineitem where abs(l_quantity - 25) < 10 and l_quantity {c} 25)", "y", ["x"], weight="w") for p, c in (("a", "<"), ("b", ">="))) + " select round(b.b0 - a.b0, 3) as effect, a.n + b.n as n from a, b")
def regression_discontinuity(spark, d):
    r = causal.regression_discontinuity(_lines(spark, d), "l_extendedprice", "l_quantity", 25.0, 10.0)
    return spark.createDataFrame([(round(r["effect"], 3), r["n"])], "effect double, n long")


def _lp_did_sql() -> str:
    head = """p as (select user_id as u, dayofmonth(ts) as t, avg(value) as y from events group by all), q as (select *, (u % 3 > 0 and t >= 8 + 5 * (u % 3))::int as d from p),
x as (select *, lag(d) over w as dlag, lag(y) over w as ylag, lead(y, 1) over w as yf1, lead(d, 1) over w as df1, lead(y, 2) over w as yf2, lead(d, 2) over w as df2, lead(y, 3) over w as yf3, lead(d, 3) over w as df3, lag(y, 2) over w as yb2, lag(y, 3) over w as yb3 from q window w as (partition by u order by t))"""
    parts, rows = [], ["select -1 as horizon, 0.0::double as effect, 0.0::double as std_error, 0::bigint as n"]
    for h in (-3, -2, 0, 1, 2, 3):
        y, ok = ("y", "d = 0") if h == 0 else (f"yf{h}", f"df{h} = 0") if h > 0 else (f"yb{-h}", "d = 0")
        k = f"h{h}".replace("-", "m")
        parts.append(f"""{k} as (select u, dy - avg(dy) over (partition by t) as y, d - avg(d) over (partition by t) as d from (select u, t, {y} - ylag as dy, d from x where dlag = 0 and {y} - ylag is not null and (d = 1 or {ok}))),
{k}b as (select sum(y * d) / sum(d * d) as b, sum(d * d) as dd, count(*) as n from {k}), {k}s as (select u, sum((y - b * d) * d) as s from {k}, {k}b group by u)""")
        rows.append(f"select {h}, round(b, 6), round(sqrt((select sum(s * s) * count(*) / (count(*) - 1) from {k}s)) / dd, 6), n from {k}b")
    return f"with {head}, {', '.join(parts)} {' union all '.join(rows)}"


@query(_lp_did_sql())
def lp_did(spark, d):
    x = read_table(spark, d, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("y"))
    x = x.withColumn("tr", F.when((F.col("user_id") % 3 > 0) & (F.col("day") >= 8 + 5 * (F.col("user_id") % 3)), 1).otherwise(0))
    return causal.lp_did(x, "y", "user_id", "day", "tr", pre=3, post=3).select("horizon", F.round("effect", 6).alias("effect"), F.round("std_error", 6).alias("std_error"), "n")


@query("select (user_id % 2)::bigint as treated, (event_type = 'click')::int as post, round(avg(value), 8) as mean, count(*) as n from events group by all")
def did_cell_means(spark, d):
    x = read_table(spark, d, "events").select("value", (F.col("user_id") % 2).alias("tr"), (F.col("event_type") == "click").cast("int").alias("po"))
    return causal.cell_means(x, "value", "tr", "po").withColumn("mean", F.round("mean", 8))


# likelihoods
def newton(source: str, score: str, info: str, steps: int) -> str:
    """CTEs s0..s{steps} of (a, b): Newton steps for an index e = a + b*x; score and info are expressions in e and y."""
    out = ["s0 as materialized (select 0.0::double as a, 0.0::double as b)"]
    for i in range(steps):
        out.append(f"s{i + 1} as materialized (select any_value(a) + (sum(h * x * x) * sum(g) - sum(h * x) * sum(g * x)) / (sum(h) * sum(h * x * x) - pow(sum(h * x), 2)) as a, any_value(b) + (sum(h) * sum(g * x) - sum(h * x) * sum(g)) / (sum(h) * sum(h * x * x) - pow(sum(h * x), 2)) as b from (select *, {score} as g, {info} as h from (select x, y, a, b, a + b * x as e from {source}, s{i})))")
    return ", ".join(out)


_CLICK = "src as (select l_quantity / 50 as x, (l_returnflag = 'R')::int::double as y from lineitem)"
_P = "(1 / (1 + exp(-e)))"
_LOGIT = f"{_CLICK}, {newton('src', f'y - {_P}', f'{_P} * (1 - {_P})', 8)}, fin as (select a, b, sum(p * (1 - p)) as h0, sum(p * (1 - p) * x) as h1, sum(p * (1 - p) * x * x) as h2, avg(p * (1 - p)) as s, avg(p * (1 - p) * (1 - 2 * p)) as c0, avg(p * (1 - p) * (1 - 2 * p) * x) as c1, sum(y * ln(p) + (1 - y) * ln(1 - p)) as ll, count(*) as n from (select *, 1 / (1 + exp(-a - b * x)) as p from src, s8) group by a, b)"


def _flagged(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), (F.col("l_quantity") / 50).alias("x"))


@query(f"with {_LOGIT} select 'const' as term, round(a, 6) as estimate, round(sqrt(h2 / (h0 * h2 - h1 * h1)), 6) as std_error from fin union all select 'x', round(b, 6), round(sqrt(h0 / (h0 * h2 - h1 * h1)), 6) from fin")
def logit_newton(spark, d):
    return _fit(spark, glm.logit(_flagged(spark, d), "y ~ x"))


@query(f"with {_LOGIT} select round(b * s, 7) as effect, round(sqrt((pow(b * c0, 2) * h2 - 2 * b * c0 * (s + b * c1) * h1 + pow(s + b * c1, 2) * h0) / (h0 * h2 - h1 * h1)), 7) as std_error from fin")
def logit_margins(spark, d):
    x = _flagged(spark, d)
    m = glm.margins(x, glm.logit(x, "y ~ x"))
    return _row(spark, {"effect": m.params[0], "std_error": m.se[0]}, 7)


@query(f"with {_LOGIT} select round(ll, 4) as log_likelihood, round(4 - 2 * ll, 4) as aic, n::double as n from fin")
def logit_summary(spark, d):
    return _row(spark, {k: glm.logit(_flagged(spark, d), "y ~ x").stats[k] for k in ("log_likelihood", "aic", "n")}, 4)


@query("""with g as (select (l_linestatus = 'O') as g, avg(l_linenumber) as m from lineitem group by 1), r as (select l_orderkey, l_linenumber as y, m from lineitem join g on g = (l_linestatus = 'O'))
select l_orderkey, round(y - m, 7) as response, round((y - m) / sqrt(m), 7) as pearson, round((y - m) / m, 7) as working, round(sign(y - m) * sqrt(2 * (y * ln(y / m) - (y - m))), 6) as deviance from r""")
def poisson_residuals(spark, d):
    x = _lines(spark, d).select("l_orderkey", F.col("l_linenumber").cast("double").alias("y"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("g"))
    fit = glm.poisson(x, "y ~ g")
    for kind in ("response", "pearson", "working", "deviance"):
        x = glm.residuals(x, fit, F.col("y"), "poisson", kind, kind)
    return x.select("l_orderkey", *[F.round(k, 7 if k != "deviance" else 6).alias(k) for k in ("response", "pearson", "working", "deviance")])


@query("""with g as (select (l_linestatus = 'O') as g, sum(l_linenumber) / sum(l_quantity) as r from lineitem group by 1) select round(ln(max(r) filter (g)) - ln(max(r) filter (not g)), 7) as log_rate_ratio from g""")
def poisson_exposure(spark, d):
    x = _lines(spark, d).select(F.col("l_linenumber").alias("y"), "l_quantity", F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("g"))
    return _row(spark, {"log_rate_ratio": glm.poisson(x, "y ~ g", exposure=F.col("l_quantity")).params[1]}, 7)


@query("""with g as (select (l_linestatus = 'O') as g, avg(l_linenumber) as m from lineitem group by 1), r as (select l_linenumber as y, m from lineitem join g on g = (l_linestatus = 'O')),
a as (select sum(m * m) as xx, sum(pow(y - m, 2) - y) as xy, sum(pow((pow(y - m, 2) - y) / m, 2)) as yy, count(*) as n, sum(pow(y - m, 2) / m) as pearson, 2 * sum(y * ln(y / m) - (y - m)) as deviance from r)
select round(xy / xx, 8) as alpha, round(xy / xx / sqrt((yy - xy * xy / xx) / (n - 1) / xx), 4) as t, round(pearson, 4) as pearson, round(deviance, 4) as deviance from a""")
def poisson_dispersion(spark, d):
    x = _lines(spark, d).select(F.col("l_linenumber").cast("double").alias("y"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("g"))
    fit = glm.poisson(x, "y ~ g")
    o, g = glm.overdispersion_test(x, fit, F.col("y")), glm.goodness_of_fit(fit)
    return spark.createDataFrame([(round(o["alpha"], 8), round(o["t"], 4), round(g["pearson"], 4), round(g["deviance"], 4))], "alpha double, t double, pearson double, deviance double")


@query(f"with src as (select l_discount as x, l_linenumber::double as y from lineitem), {newton('src', 'y - exp(e)', 'exp(e)', 9)} select 'const' as term, round(a, 6) as estimate from s9 union all select 'x', round(b, 6) from s9")
def poisson_newton(spark, d):
    x = _lines(spark, d).select(F.col("l_discount").alias("x"), F.col("l_linenumber").alias("y"))
    return _fit(spark, glm.poisson(x, "y ~ x")).select("term", "estimate")


def _cox_sql(steps: int) -> str:
    out = ["b0 as materialized (select 0.0::double as b)"]
    for i in range(steps):
        out.append(f"b{i + 1} as materialized (select any_value(b) + sum(sx - d * r1 / r0) / sum(d * (r1 / r0 - pow(r1 / r0, 2))) as b from (select *, sum(s0) over w as r0, sum(s1) over w as r1 from (select t, any_value(b) as b, sum(d) as d, sum(d * x) as sx, sum(exp(b * x)) as s0, sum(x * exp(b * x)) as s1 from z, b{i} group by t) window w as (order by t desc)))")
    return f"with {_LIFE.replace('select user_id, min', 'select user_id, min', 1)}, z as (select t, d, x - avg(x) over () as x from dx), ".replace("dur as (select date_diff", "dx as (select user_id % 2 as x, date_diff") + ", ".join(out).replace("r1 / r0 - pow(r1 / r0, 2)", "r2 / r0 - pow(r1 / r0, 2)").replace("sum(s1) over w as r1", "sum(s1) over w as r1, sum(s2) over w as r2").replace("sum(x * exp(b * x)) as s1", "sum(x * exp(b * x)) as s1, sum(x * x * exp(b * x)) as s2") + f" select 'odd' as term, round(b, 5) as estimate from b{steps}"


@query(_cox_sql(8))
def cox(spark, d):
    x = _life(spark, d).withColumn("odd", (F.col("user_id") % 2).cast("double"))
    return _fit(spark, survival.cox(x, "t", "d", ["odd"]), 5).select("term", "estimate")

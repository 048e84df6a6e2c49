"""Panel, time-series, causal, survival and multivariate estimators over the test tables; SQL where a closed form exists."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gramforge.models import causal, glm, learn, linear, multivariate, panel, series, stats, survival, timeseries
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


def _row(spark, values: dict, digits: int = 6):
    """One row of rounded numbers; ones that do not exist are NULL."""
    clean = {k: None if isinstance(v, float) and math.isnan(v) else round(float(v), digits) for k, v in values.items()}
    return spark.createDataFrame([tuple(clean.values())], ", ".join(f"`{k}` double" for k in clean))


def _fit(spark, fit, digits: int = 6):
    return fit.table(spark).select("term", F.round("estimate", digits).alias("estimate"), F.round("std_error", digits).alias("std_error"))


def _lines(spark, d):
    return read_table(spark, d, "lineitem")


# panel
_DEMEAN = """g as (select l_suppkey, avg(l_extendedprice) as my, avg(l_quantity) as mx, count(*) as n from lineitem group by 1),
w as (select l_suppkey, l_extendedprice - my as y, l_quantity - mx as x from lineitem join g using (l_suppkey)),
b as (select sum(x * y) / sum(x * x) as b, sum(x * x) as sxx, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) as ssr, count(*) as n, count(distinct l_suppkey) as g from w)"""


@query(f"with {_DEMEAN} select 'l_quantity' as term, round(b, 6) as estimate, round(sqrt(ssr / (n - g - 1) / sxx), 6) as std_error from b")
def fixed_effects(spark, d):
    return _fit(spark, panel.fixed_effects(_lines(spark, d), "l_extendedprice", ["l_quantity"], "l_suppkey"))


@query(f"""with {_DEMEAN}, s as (select l_suppkey, sum(x * (y - b * x)) as s from w, b group by 1)
select 'l_quantity' as term, round(b, 6) as estimate, round(sqrt((select sum(s * s) from s) * g / (g - 1) * (n - 1) / (n - 1)) / sxx, 6) as std_error from b""")
def fixed_effects_clustered(spark, d):
    return _fit(spark, panel.fixed_effects(_lines(spark, d), "l_extendedprice", ["l_quantity"], "l_suppkey", linear.Cov("cluster", clusters=["l_suppkey"])))


@query("with g as (select avg(l_extendedprice) as y, avg(l_quantity) as x from lineitem group by l_suppkey) select 'x' as term, round(regr_slope(y, x), 4) as estimate from g")
def between(spark, d):
    return _fit(spark, panel.between(_lines(spark, d), "l_extendedprice", ["l_quantity"], "l_suppkey"), 4).where("term = 'l_quantity'").select(F.lit("x").alias("term"), "estimate")


@query(f"""with {_DEMEAN}, p as (select regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity) as ssr0 from lineitem)
select round((ssr0 - ssr) / (g - 1) / (ssr / (n - g - 1)), 6) as f from b, p""")
def fe_f_test(spark, d):
    return _row(spark, {"f": panel.f_test_fixed_effects(_lines(spark, d), "l_extendedprice", ["l_quantity"], "l_suppkey")[0]})


@query("""with b as (select regr_slope(l_extendedprice, l_quantity) as b1, regr_intercept(l_extendedprice, l_quantity) as b0 from lineitem),
g as (select count(*) as t, sum(l_extendedprice - b0 - b1 * l_quantity) as s, sum(pow(l_extendedprice - b0 - b1 * l_quantity, 2)) as q from lineitem, b group by l_suppkey)
select round(sum(t) / 2 * pow(sum(s * s) / sum(q) - 1, 2) / (avg(t) - 1), 6) as lm from g""")
def breusch_pagan_lm(spark, d):
    return _row(spark, {"lm": panel.breusch_pagan_lm(_lines(spark, d), "l_extendedprice", ["l_quantity"], "l_suppkey")[0]})


@query("""with b as (select regr_slope(value, user_id) as b1, regr_intercept(value, user_id) as b0 from events group by cast(ts as date) having count(*) > 2)
select 'const' as term, round(avg(b0), 6) as estimate, round(stddev_samp(b0) / sqrt(count(*)), 6) as std_error from b union all select 'user_id', round(avg(b1), 6), round(stddev_samp(b1) / sqrt(count(*)), 6) from b""")
def fama_macbeth(spark, d):
    x = read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return _fit(spark, panel.fama_macbeth(x, "value", ["user_id"], "day"))


def _monthly(spark, d):
    """Customer by month panel of order totals."""
    o = read_table(spark, d, "orders").withColumn("month", F.months_between(F.trunc("o_orderdate", "month"), F.lit("1990-01-01")).cast("int"))
    return o.groupBy("o_custkey", "month").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).cast("double").alias("orders"))


@query()
def panel_threshold(spark, d):
    return _row(spark, panel.panel_threshold(_monthly(spark, d), "total", ["orders"], "month", "o_custkey"), 3)


def _yearly(spark, d):
    """Customer by year panel."""
    o = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("year"))
    return o.agg((F.avg("o_totalprice") / 1e5).alias("total"), F.log(F.count(F.lit(1)).cast("double")).alias("orders"))


@query()
def arellano_bond(spark, d):
    return _fit(spark, panel.arellano_bond(_yearly(spark, d), "total", ["orders"], "unit", "year"), 4)


@query()
def system_gmm(spark, d):
    return _fit(spark, panel.system_gmm(_yearly(spark, d), "total", ["orders"], "unit", "year"), 4)


# classical tests
@query("""with m as (select avg(o_totalprice) as m from orders), p as (select count(*) as n, avg(pow(o_totalprice - m, 2)) as m2, avg(pow(o_totalprice - m, 3)) as m3, avg(pow(o_totalprice - m, 4)) as m4 from orders, m)
select round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 5) as jb from p""")
def jarque_bera(spark, d):
    return _row(spark, {"jb": stats.jarque_bera(read_table(spark, d, "orders"), "o_totalprice")[0]}, 5)


@query("""with g as (select c_mktsegment, count(*) as n, avg(c_acctbal) as m, var_pop(c_acctbal) as v from customer group by 1)
select round((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) as f from g""")
def anova_oneway(spark, d):
    return _row(spark, {"f": stats.anova_oneway(read_table(spark, d, "customer"), "c_acctbal", "c_mktsegment")["f"]})


@query("""with g as (select avg(c_acctbal) as m, var_samp(c_acctbal) as v, count(*) as n from customer where c_mktsegment = 'BUILDING'), h as (select avg(c_acctbal) as m, var_samp(c_acctbal) as v, count(*) as n from customer where c_mktsegment = 'MACHINERY')
select round((g.m - h.m) / sqrt(g.v / g.n + h.v / h.n), 6) as t, round(pow(g.v / g.n + h.v / h.n, 2) / (pow(g.v / g.n, 2) / (g.n - 1) + pow(h.v / h.n, 2) / (h.n - 1)), 4) as df from g, h""")
def ttest_welch(spark, d):
    c = read_table(spark, d, "customer")
    r = stats.ttest_ind(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment = 'MACHINERY'"), "c_acctbal")
    return _row(spark, {"t": r["t"]}).withColumn("df", F.lit(round(r["df"], 4)))


@query("""with c as (select l_returnflag as a, l_linestatus as b, count(*) as o from lineitem group by all), r as (select a, sum(o) as ra from c group by 1), s as (select b, sum(o) as rb from c group by 1), n as (select sum(o) as n from c)
select round(sum(pow(coalesce(o, 0) - ra * rb / n, 2) / (ra * rb / n)), 4) as chi2 from r cross join s cross join n left join c using (a, b)""")
def chi2_contingency(spark, d):
    return _row(spark, {"chi2": stats.chi2_contingency(_lines(spark, d), "l_returnflag", "l_linestatus")[0]}, 4)


@query("select round(sum(pow(d, 2)) / sum(pow(e, 2)), 8) as dw from (select e, e - lag(e) over (order by event_id) as d from (select event_id, value - avg(value) over () as e from events))")
def durbin_watson(spark, d):
    x = read_table(spark, d, "events")
    m = x.agg(F.avg("value")).first()[0]
    return _row(spark, {"dw": stats.durbin_watson(x.withColumn("e", F.col("value") - m), "e", ["event_id"])}, 8)


@query("""with e as (select l_quantity as x, pow(l_extendedprice - (select regr_intercept(l_extendedprice, l_quantity) from lineitem) - (select regr_slope(l_extendedprice, l_quantity) from lineitem) * l_quantity, 2) as u from lineitem)
select round(count(*) * regr_r2(u, x), 4) as lm from e""")
def breusch_pagan(spark, d):
    return _row(spark, {"lm": stats.breusch_pagan(_lines(spark, d), "l_extendedprice ~ l_quantity")[0]}, 4)


@query("select round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 8) as q, round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 8) as p from lineitem")
def vif(spark, d):
    r = stats.vif(_lines(spark, d), ["l_quantity", "l_extendedprice"])
    return _row(spark, {"q": r["l_quantity"], "p": r["l_extendedprice"]}, 8)


@query("""with s as (select l_extendedprice as s, sum((l_returnflag = 'R')::int) as p, sum((l_returnflag <> 'R')::int) as q from lineitem group by 1),
r as (select p, q, sum(p) over (order by s desc) as cp from s) select round(sum(q * (cp - p / 2)) / (sum(p) * sum(q)), 8) as auc from r""")
def roc_auc(spark, d):
    x = _lines(spark, d).withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return _row(spark, {"auc": stats.auc(x, "y", "l_extendedprice")}, 8)


@query("""select threshold, round(sum(p) over w / sum(p) over (), 9) as tpr, round(sum(q) over w / sum(q) over (), 9) as fpr from
(select l_quantity as threshold, sum((l_returnflag = 'R')::int) as p, sum((l_returnflag <> 'R')::int) as q from lineitem group by 1) window w as (order by threshold desc)""")
def roc_curve(spark, d):
    x = _lines(spark, d).withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return stats.roc(x, "y", "l_quantity").select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("""with w as (select l_extendedprice as x, l_quantity as w from lineitem), m as (select sum(w * x) / sum(w) as m, sum(w) as sw, sum(w * w) as w2 from w)
select round(any_value(m), 4) as mean, round(sqrt(sum(w * (x - m) * (x - m)) / (any_value(sw) - any_value(w2) / any_value(sw))), 4) as std from w, m""")
def weighted_stats(spark, d):
    r = stats.weighted_stats(_lines(spark, d), "l_extendedprice", "l_quantity")
    return _row(spark, {"mean": r["mean"], "std": r["std"]}, 4)


@query("""with p as (select user_id, (rank() over (order by user_id)) / 400.0 as p from (select distinct user_id from events)), n as (select count(*) as n from p),
r as (select user_id, p, n, row_number() over (order by p) as k from p, n) select user_id, round(least(1, min(p * n / k) over (order by p desc)), 8) as p_adjusted from r""")
def adjust_bh(spark, d):
    u = read_table(spark, d, "events").select("user_id").distinct()
    from gramforge.operators.ordered import Ordered

    o = Ordered(u, ["user_id"])
    p = o.rows().select("user_id", ((F.col(o.pos) + 1) / F.lit(400.0)).alias("p"))
    return stats.adjust_column(p, "p", "bh").select("user_id", F.round("p_adjusted", 8).alias("p_adjusted"))


# time series
_ACF = """m as (select event_id, value - avg(value) over () as v from events), l as (select v, {lags} from m)
select {sums} from l"""


@query("with " + _ACF.format(lags=", ".join(f"lag(v, {k}) over (order by event_id) as l{k}" for k in range(1, 6)), sums=", ".join(f"round(sum(v * l{k}) / sum(v * v), 8) as r{k}" for k in range(1, 6))))
def acf(spark, d):
    r = timeseries.acf(read_table(spark, d, "events"), "value", 5, ["event_id"])
    return _row(spark, {f"r{k}": r[k] for k in range(1, 6)}, 8)


@query("with " + _ACF.format(lags=", ".join(f"lag(v, {k}) over (order by event_id) as l{k}" for k in range(1, 5)), sums="round(count(*) * (count(*) + 2) * (" + " + ".join(f"pow(sum(v * l{k}) / sum(v * v), 2) / (count(*) - {k})" for k in range(1, 5)) + "), 6) as q"))
def ljung_box(spark, d):
    return _row(spark, {"q": timeseries.ljung_box(read_table(spark, d, "events"), "value", 4, ["event_id"])[0]})


def _daily(spark, d):
    return read_table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1e5).alias("total"))


_DAILY = "daily as (select cast(o_orderdate as date) as day, sum(o_totalprice) / 1e5 as total from orders group by 1)"


@query(f"""with {_DAILY}, t as (select day, total, row_number() over (order by day) - 1 as p, avg(total) over (order by day rows between 3 preceding and 3 following) as tr, count(*) over (order by day rows between 3 preceding and 3 following) as n from daily),
f as (select day, total, p, case when n = 7 then tr end as trend from t), s as (select p % 7 as k, avg(total - trend) as s from f where trend is not null group by 1), c as (select k, s - avg(s) over () as seasonal from s)
select cast(cast(day as date) as varchar) as day, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(total - trend - seasonal, 4) as resid from f join c on p % 7 = k""")
def decompose_daily(spark, d):
    x = timeseries.decompose(_daily(spark, d), "total", 7, ["day"])
    return x.select(F.col("day").cast("string").alias("day"), *[F.round(c, 4).alias(c) for c in ("trend", "seasonal", "resid")])


@query(f"""with {_DAILY}, l as (select total as y, lag(total) over (order by day) as x from daily) select 'L1.total' as term, round(regr_slope(y, x), 6) as estimate from l where x is not null""")
def autoreg(spark, d):
    return _fit(spark, timeseries.autoreg(_daily(spark, d), "total", 1, ["day"])).where("term = 'L1.total'").select("term", "estimate")


@query()
def unit_root_tests(spark, d):
    x = _daily(spark, d)
    return _row(spark, {"adf": timeseries.adf(x, "total", ["day"], 2)["statistic"], "kpss": timeseries.kpss(x, "total", ["day"])["statistic"], "pp": timeseries.phillips_perron(x, "total", ["day"])["statistic"], "za": timeseries.zivot_andrews(x, "total", ["day"])["statistic"]}, 4)


def _two(spark, d):
    return read_table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1e5).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))


@query()
def johansen(spark, d):
    r = timeseries.johansen(_two(spark, d), ["total", "n"], 1, ["day"])
    return spark.createDataFrame([(i, round(float(a), 6), round(float(b), 3)) for i, (a, b) in enumerate(zip(r["eigenvalues"], r["trace"], strict=True))], "rank int, eigenvalue double, trace double")


@query()
def setar(spark, d):
    r = timeseries.setar(_daily(spark, d), "total", 1, 1, ["day"])
    return _row(spark, {"threshold": r["threshold"], "ssr": r["ssr"]}, 4)


def _per_type(spark, d):
    return read_table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("value"))


def _series_query(name: str, kernel, fields, **kw):
    def f(spark, d):
        return series.per_series(_per_type(spark, d), ["event_type"], ["hour"], "value", kernel, fields, **kw)

    f.__name__ = name
    query()(f)


_series_query("arima_by_type", lambda y: series.arima(y, 1, 0, 0), ["const", "ar1", "sigma2", "forecast"])
_series_query("ets_by_type", lambda y: series.ets(y), ["alpha", "level", "forecast"])
_series_query("garch_by_type", lambda y: series.garch(y), ["omega", "alpha", "beta", "log_likelihood"])
_series_query("markov_by_type", lambda y: series.markov_switching(y), ["mean_low", "mean_high", "stay_low", "stay_high"])
_series_query("hp_filter_by_type", lambda y: series.hp_filter(y, 1600.0), ["trend", "cycle"], rowwise=True)
_series_query("stl_by_type", lambda y: series.stl(y, 24), ["trend", "seasonal", "resid"], rowwise=True)


# generalised linear models
def _flags(spark, d):
    return _lines(spark, d).select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), (F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("d"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0).cast("double").alias("n"))


@query()
def logit(spark, d):
    return _fit(spark, glm.logit(_flags(spark, d), "y ~ q + d"), 5)


@query("""select 'g' as term, round(ln(avg(l_linenumber) filter (l_linestatus = 'O')) - ln(avg(l_linenumber) filter (l_linestatus <> 'O')), 6) as estimate from lineitem""")
def poisson_dummy(spark, d):
    x = _lines(spark, d).select(F.col("l_linenumber").alias("y"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("g"))
    return _fit(spark, glm.poisson(x, "y ~ g")).where("term = 'g'").select("term", "estimate")


@query()
def probit(spark, d):
    return _fit(spark, glm.probit(_flags(spark, d), "y ~ q + d"), 5)


@query()
def negative_binomial(spark, d):
    return _fit(spark, glm.negative_binomial(_flags(spark, d), "n ~ q"), 3)


@query()
def quantile_regression(spark, d):
    return _fit(spark, linear.quantile_regression(_lines(spark, d), "l_extendedprice ~ l_quantity", 0.5), 0)


@query()
def robust_regression(spark, d):
    return _fit(spark, linear.robust_regression(_lines(spark, d), "l_extendedprice ~ l_quantity"), 3)


@query()
def gee(spark, d):
    return _fit(spark, glm.gee(_lines(spark, d), "l_extendedprice ~ l_quantity", "l_suppkey"), 3)


# causal
_DID = """c as (select user_id % 2 as tr, (ts >= timestamp '2024-01-16')::int as po, avg(value) as m from events group by all)"""


@query(f"with {_DID} select 'att' as term, round(sum(case when tr = po then m else -m end), 8) as estimate from c")
def diff_in_diff(spark, d):
    x = read_table(spark, d, "events").select("value", (F.col("user_id") % 2).alias("tr"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).cast("int").alias("po"))
    return _fit(spark, causal.diff_in_diff(x, "value", "tr", "po"), 8).where("term = 'att'").select("term", "estimate")


@query("""with u as (select user_id, avg(value) filter (ts < timestamp '2024-01-16') as pre, avg(value) filter (ts >= timestamp '2024-01-16') as y, user_id % 2 as t from events group by user_id having count(*) filter (ts < timestamp '2024-01-16') > 0 and count(*) filter (ts >= timestamp '2024-01-16') > 0),
th as (select regr_slope(y, pre) as th, avg(pre) as mp from u), a as (select t, y - th * (pre - mp) as a, th from u, th)
select round(avg(a) filter (t = 1) - avg(a) filter (t = 0), 7) as effect, round(any_value(th), 7) as theta, round(sqrt(var_samp(a) filter (t = 1) / count(*) filter (t = 1) + var_samp(a) filter (t = 0) / count(*) filter (t = 0)), 7) as se from a""")
def cuped(spark, d):
    post = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    u = read_table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(~post, F.col("value"))).alias("pre"), F.avg(F.when(post, F.col("value"))).alias("y")).where("pre is not null and y is not null").withColumn("t", F.col("user_id") % 2)
    r = causal.cuped(u, "y", ["pre"], "t")
    return _row(spark, {"effect": r["effect"], "theta": r["theta_pre"], "se": r["se"]}, 7)


@query()
def double_ml(spark, d):
    x = _lines(spark, d).withColumn("t", (F.col("l_discount") > 0.05).cast("double"))
    return _row(spark, {k: v for k, v in causal.double_ml(x, "l_extendedprice", "t", ["l_quantity", "l_tax"]).items() if k in ("theta", "se")}, 3)


@query()
def psm(spark, d):
    x = _lines(spark, d).withColumn("t", F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).withColumn("q", F.col("l_quantity") / 50)
    return _row(spark, causal.psm(x, "l_extendedprice", "t", ["q", "l_tax"]), 4)


# survival
_LIFE = """life as (select user_id, min(ts) filter (event_type = 'error') as e, min(ts) as a, max(ts) as z from events group by 1),
dur as (select date_diff('hour', date_trunc('hour', a), date_trunc('hour', coalesce(e, z))) as t, (e is not null)::int as d from life)"""


def _life(spark, d):
    x = read_table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("e"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    hour = lambda c: F.date_trunc("hour", c)
    end = F.coalesce("e", "z")
    return x.select("user_id", F.timestamp_diff("HOUR", hour(F.col("a")), hour(end)).alias("t"), F.col("e").isNotNull().cast("int").alias("d"))


@query(f"""with {_LIFE}, c as (select t, count(*) as n, sum(d) as deaths from dur group by 1), r as (select t, deaths, sum(n) over (order by t desc) as at_risk from c),
s as (select t, deaths, at_risk, sum(case when deaths < at_risk then ln(1 - deaths / at_risk) else -1e308 end) over (order by t) as l from r where deaths > 0)
select t as time, at_risk::bigint as at_risk, deaths::bigint as deaths, round(exp(l), 8) as survival from s""")
def kaplan_meier(spark, d):
    return survival.kaplan_meier(_life(spark, d), "t", "d").select("time", "at_risk", "deaths", F.round("survival", 8).alias("survival"))


# multivariate and learning
@query("""with r as (select corr(l_quantity, l_extendedprice) as r from lineitem) select round(1 + abs(r), 8) as e1, round(1 - abs(r), 8) as e2 from r""")
def pca_two(spark, d):
    v = multivariate.PCA.fit(_lines(spark, d), ["l_quantity", "l_extendedprice"]).values
    return _row(spark, {"e1": v[0], "e2": v[1]}, 8)


@query()
def kde(spark, d):
    return multivariate.kde(_lines(spark, d), "l_quantity", 64).select(F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query()
def isotonic(spark, d):
    return multivariate.isotonic(_lines(spark, d), "l_extendedprice", "l_quantity")


_ENTRIES = [f"x{i}" for i in range(64)]


def _vectors(spark, d):
    """Every entry of the embeddings; a vector of another length is an error."""
    e = read_table(spark, d, "embeddings")
    whole = F.when(F.size("embedding") == len(_ENTRIES), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("embedding without 64 entries: "), F.col("vec_id").cast("string"))))
    return e.select("vec_id", whole.alias("e")).select("vec_id", *[F.col("e")[i].cast("double").alias(c) for i, c in enumerate(_ENTRIES)])


@query()
def kmeans(spark, d):
    x = _vectors(spark, d)
    return learn.kmeans(x, _ENTRIES, 4).predict(x).select("vec_id", "cluster")


# 1.15 is about the median distance to the fourth neighbour in 64 entries (1.143 at sf0.1); 0.05 was for the first two entries.
@query()
def dbscan(spark, d):
    return learn.dbscan(_vectors(spark, d), "vec_id", _ENTRIES, 1.15, 5)


@query()
def random_forest(spark, d):
    x = _vectors(spark, d)
    return learn.random_forest(x, "x0", _ENTRIES[1:]).predict(x).select("vec_id", "prediction")

"""Regressions with closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramforge.models.linear import Cov, iv, ols, wls
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




def _coef(spark, fit, digits: int = 6, se: bool = True):
    t = fit.table(spark).select("term", F.round("estimate", digits).alias("estimate"), *([F.round("std_error", digits).alias("std_error")] if se else []))
    return t


#: Normal equations of y on (1, a, b) from centred moments.
_TWO = """m as (select count(*) as n, avg({y}) as my, avg({a}) as ma, avg({b}) as mb from {t}),
s as (select n, my, ma, mb, sum(({a} - ma) * ({a} - ma)) as saa, sum(({b} - mb) * ({b} - mb)) as sbb, sum(({a} - ma) * ({b} - mb)) as sab, sum(({a} - ma) * ({y} - my)) as say, sum(({b} - mb) * ({y} - my)) as sby, sum(({y} - my) * ({y} - my)) as syy from {t}, m group by all),
c as (select *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) as b1, (saa * sby - sab * say) / (saa * sbb - sab * sab) as b2 from s),
r as (select *, my - b1 * ma - b2 * mb as b0, (syy - b1 * say - b2 * sby) / (n - 3) as s2, saa * sbb - sab * sab as det from c)"""
_T = _TWO.format(y="l_extendedprice", a="l_quantity", b="l_discount", t="lineitem")


@query(f"""with {_T} select 'const' as term, round(b0, 4) as estimate, round(sqrt(s2 * (1 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)), 4) as std_error from r
union all select 'l_quantity', round(b1, 4), round(sqrt(s2 * sbb / det), 4) from r union all select 'l_discount', round(b2, 4), round(sqrt(s2 * saa / det), 4) from r""")
def ols_lineitem(spark, d):
    return _coef(spark, ols(read_table(spark, d, "lineitem"), "l_extendedprice ~ l_quantity + l_discount"), 4)


@query(f"with {_T} select round(1 - s2 * (n - 3) / syy, 9) as r_squared, round(sqrt(s2), 4) as sigma, n::double as n from r")
def ols_summary(spark, d):
    s = ols(read_table(spark, d, "lineitem"), "l_extendedprice ~ l_quantity + l_discount").summary(spark)
    return s.select(F.round("r_squared", 9).alias("r_squared"), F.round("sigma", 4).alias("sigma"), "n")


@query(f"""with {_T} select l_orderkey, l_linenumber, round(b0 + b1 * l_quantity + b2 * l_discount, 4) as fitted from lineitem, r""")
def ols_predict(spark, d):
    x = read_table(spark, d, "lineitem")
    return ols(x, "l_extendedprice ~ l_quantity + l_discount").predict(x).select("l_orderkey", "l_linenumber", F.round("fitted", 4).alias("fitted"))


_ONE = """m as (select count(*) as n, avg({y}) as my, avg({x}) as mx from {t}),
b as (select n, mx, my, regr_slope({y}, {x}) as b1, regr_intercept({y}, {x}) as b0, regr_sxx({y}, {x}) as sxx from {t}, m group by n, mx, my)"""
_L = _ONE.format(y="l_extendedprice", x="l_quantity", t="lineitem")


def _one(cov: Cov):
    def f(spark, d):
        return _coef(spark, ols(read_table(spark, d, "lineitem"), "l_extendedprice ~ l_quantity", cov), 6).where("term = 'l_quantity'")

    return f


_HC = {"HC1": "n / (n - 2)", "HC2": "1 / (1 - h)", "HC3": "1 / ((1 - h) * (1 - h))", "HC4": "1 / pow(1 - h, least(4, h * n / 2))"}
for _k, _w in _HC.items():
    _f = _one(Cov(_k))
    _f.__name__ = f"ols_{_k.lower()}"
    query(f"""with {_L}, u as (select l_quantity - mx as c, l_extendedprice - b0 - b1 * l_quantity as u, 1.0 / n + (l_quantity - mx) * (l_quantity - mx) / sxx as h, n, sxx, b1 from lineitem, b)
select 'l_quantity' as term, round(any_value(b1), 6) as estimate, round(sqrt(sum(c * c * u * u * ({_w}))) / any_value(sxx), 6) as std_error from u""")(_f)

_f = _one(Cov("cluster", clusters=["l_suppkey"]))
_f.__name__ = "ols_clustered"
query(f"""with {_L}, g as (select l_suppkey, sum((l_quantity - mx) * (l_extendedprice - b0 - b1 * l_quantity)) as s, any_value(n) as n, any_value(sxx) as sxx, any_value(b1) as b1 from lineitem, b group by 1)
select 'l_quantity' as term, round(any_value(b1), 6) as estimate, round(sqrt(sum(s * s) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 2)) / any_value(sxx), 6) as std_error from g""")(_f)

_f = _one(Cov("cluster", clusters=["l_suppkey", "l_returnflag"]))
_f.__name__ = "ols_clustered_two_way"


def _scores(keys: str) -> str:
    return f"(select sum(s * s) as m, count(*) as g from (select sum((l_quantity - mx) * (l_extendedprice - b0 - b1 * l_quantity)) as s from lineitem, b group by {keys}))"


query(f"""with {_L}, p as {_scores("l_suppkey")}, q as {_scores("l_returnflag")}, o as {_scores("l_suppkey, l_returnflag")}
select 'l_quantity' as term, round(b1, 6) as estimate, round(sqrt(greatest(p.m + q.m - o.m, 0) * least(p.g, q.g) / (least(p.g, q.g) - 1) * (n - 1) / (n - 2)) / sxx, 6) as std_error from b, p, q, o""")(_f)


@query("""with m as (select count(*) as n, avg(value) as my, avg(user_id) as mx from events),
b as (select n, mx, regr_slope(value, user_id) as b1, regr_intercept(value, user_id) as b0, regr_sxx(value, user_id) as sxx from events, m group by n, mx),
s as (select event_id, (user_id - mx) * (value - b0 - b1 * user_id) as s, n, sxx, b1 from events, b),
l as (select s, lag(s, 1, 0) over w as l1, lag(s, 2, 0) over w as l2, lag(s, 3, 0) over w as l3, n, sxx, b1 from s window w as (order by event_id))
select 'user_id' as term, round(any_value(b1), 8) as estimate, round(sqrt((sum(s * s) + 2 * (0.75 * sum(s * l1) + 0.5 * sum(s * l2) + 0.25 * sum(s * l3))) * any_value(n) / (any_value(n) - 2)) / any_value(sxx), 8) as std_error from l""")
def ols_newey_west(spark, d):
    return _coef(spark, ols(read_table(spark, d, "events"), "value ~ user_id", Cov("newey_west", 3, ["event_id"])), 8).where("term = 'user_id'")


_WL = """w as (select l_extendedprice as y, l_quantity as x, 1 + l_linenumber as w from lineitem), m as (select sum(w * y) / sum(w) as my, sum(w * x) / sum(w) as mx from w)"""


@query(f"""with {_WL}, b as (select sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) as b1, any_value(mx) as mx, any_value(my) as my from w, m)
select 'l_quantity' as term, round(b1, 6) as estimate from b union all select 'const', round(my - b1 * mx, 6) from b""")
def wls_lineitem(spark, d):
    x = read_table(spark, d, "lineitem").withColumn("w", F.col("l_linenumber") + 1)
    return _coef(spark, wls(x, "l_extendedprice ~ l_quantity", "w"), 6, False)


@query("""with j as (select l_extendedprice as y, l_quantity as x, p_retailprice as z from lineitem join part on l_partkey = p_partkey)
select 'x' as term, round(covar_pop(y, z) / covar_pop(x, z), 2) as estimate from j""")
def iv_price(spark, d):
    j = read_table(spark, d, "lineitem").join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = F.lit(1.0)
    fit = iv(j, F.col("l_extendedprice"), {"const": one, "x": F.col("l_quantity")}, {"const": one, "z": F.col("p_retailprice")})
    return _coef(spark, fit, 2, False).where("term = 'x'")


@query("""with f as (select avg(l_extendedprice) filter (l_returnflag = 'A') as a, avg(l_extendedprice) filter (l_returnflag = 'N') as n, avg(l_extendedprice) filter (l_returnflag = 'R') as r from lineitem)
select 'const' as term, round(a, 6) as estimate from f union all select 'l_returnflag=N', round(n - a, 6) from f union all select 'l_returnflag=R', round(r - a, 6) from f""")
def ols_dummies(spark, d):
    return _coef(spark, ols(read_table(spark, d, "lineitem"), "l_extendedprice ~ C(l_returnflag)"), 6, False)

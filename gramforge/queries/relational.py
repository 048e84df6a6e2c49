"""Frame operators over the TPC-H-like tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.frame import Frame
from gramforge.functions import transforms as tr
from gramforge.util import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> Frame:
    return Frame(read_table(spark, d, "events"), ["event_id"])


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(avg(l_extendedprice), 6) as avg_price, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def agg_pricing_summary(spark, d):
    x = Frame(read_table(spark, d, "lineitem")).filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return x.df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 6).alias("avg_price"), F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000 and o_orderstatus = 'F'")
def filter_select(spark, d):
    return Frame(read_table(spark, d, "orders")).filter("o_totalprice > 200000 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").df


@query("select o_orderkey as k, o_totalprice as price from orders")
def rename_drop(spark, d):
    return Frame(read_table(spark, d, "orders")).rename({"o_orderkey": "k", "o_totalprice": "price"}).drop("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").df


def _join(how: str):
    def f(spark, d):
        # Firm numbers against order numbers: keys without a partner on both sides, repeated and NULL keys on one.
        c = Frame(read_table(spark, d, "orders")).rename({"o_orderkey": "k"}).select("k", "o_orderpriority")
        o = Frame(read_table(spark, d, "panel_data")).rename({"firm_id": "k"}).select("obs_id", "k")
        out = o.merge(c, "k", how).df
        return out if how in ("semi", "anti") else out.select("k", "obs_id", "o_orderpriority")

    f.__name__ = f"merge_{how}"
    return f


for _how, _sql in {
    "inner": "select k, obs_id, o_orderpriority from o join c using (k)",
    "left": "select k, obs_id, o_orderpriority from o left join c using (k)",
    "right": "select k, obs_id, o_orderpriority from o right join c using (k)",
    "outer": "select k, obs_id, o_orderpriority from o full join c using (k)",
    "semi": "select k, obs_id from o semi join c using (k)",
    "anti": "select k, obs_id from o anti join c using (k)",
}.items():
    query("with c as (select o_orderkey as k, o_orderpriority from orders), o as (select obs_id, firm_id as k from panel_data) " + _sql)(_join(_how))


def _group(agg: str):
    def f(spark, d):
        out = Frame(read_table(spark, d, "orders")).groupby(["o_orderstatus", "o_orderpriority"], "o_totalprice", agg).df
        return out.withColumn(f"o_totalprice_{agg}", F.round(f"o_totalprice_{agg}", 4))

    f.__name__ = f"groupby_{agg}"
    return f


for _agg in ("sum", "mean", "count", "min", "max", "median"):
    query(f"select o_orderstatus, o_orderpriority, round({ {'mean': 'avg'}.get(_agg, _agg) }(o_totalprice), 4) as o_totalprice_{_agg} from orders group by all")(_group(_agg))


@query("""select l_returnflag, round(avg(l_quantity) filter (l_linestatus = 'F'), 6) as "l_linestatus_F", round(avg(l_quantity) filter (l_linestatus = 'O'), 6) as "l_linestatus_O" from lineitem group by 1""")
def pivot_flags(spark, d):
    x = Frame(read_table(spark, d, "lineitem")).pivot_table("l_returnflag", "l_linestatus", "l_quantity", "mean").df
    return x.select("l_returnflag", *[F.round(c, 6).alias(c) for c in x.columns[1:]])


@query("select p_partkey, variable, value from (unpivot (select p_partkey, cast(p_size as double) as p_size, p_retailprice from part) on p_size, p_retailprice into name variable value value)")
def melt_parts(spark, d):
    return Frame(read_table(spark, d, "part")).melt(["p_partkey"], ["p_size", "p_retailprice"]).df


@query("""select column_name, count(*) as "count", round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, min(v) as min, median(v) as median, max(v) as max from (
  select 'o_totalprice' as column_name, o_totalprice as v from orders union all select 'o_orderkey', o_orderkey from orders union all select 'o_custkey', o_custkey from orders) group by 1""")
def describe_orders(spark, d):
    return Frame(read_table(spark, d, "orders")).describe().withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("select round(corr(l_quantity, l_extendedprice), 9) as r_price, round(corr(l_quantity, l_discount), 9) as r_discount, round(covar_samp(l_quantity, l_extendedprice), 4) as c_price from lineitem")
def corr_cov(spark, d):
    x = Frame(read_table(spark, d, "lineitem"))
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    r, c = x.corr(names)[1], x.cov(names)[1]
    return spark.createDataFrame([(round(float(r[0, 1]), 9), round(float(r[0, 2]), 9), round(float(c[0, 1]), 4))], "r_price double, r_discount double, c_price double")


@query("select quantile_cont(l_extendedprice, 0.1) as q10, quantile_cont(l_extendedprice, 0.5) as q50, quantile_cont(l_extendedprice, 0.99) as q99 from lineitem")
def quantiles(spark, d):
    x = Frame(read_table(spark, d, "lineitem"))
    return spark.createDataFrame([tuple(x.quantile("l_extendedprice", q) for q in (0.1, 0.5, 0.99))], "q10 double, q50 double, q99 double")


_W = "over (order by event_id)"


def _ordered(name: str, make: Callable[[Frame], Frame], sql: str, digits: int | None = 6):
    def f(spark, d):
        out = make(_events(spark, d)).df
        new = [c for c in out.columns if c.startswith("value_")] or ["value"]
        return out.select("event_id", *[F.round(c, digits).alias(c) if digits is not None else F.col(c) for c in new])

    f.__name__ = name
    query(sql)(f)


_ordered("lag_3", lambda x: x.lag("value", 3), f"select event_id, round(lag(value, 3) {_W}, 6) as value_lag_3 from events")
_ordered("lead_2", lambda x: x.lead("value", 2), f"select event_id, round(lead(value, 2) {_W}, 6) as value_lead_2 from events")
_ordered("shift_1", lambda x: x.shift("value", 1), f"select event_id, round(lag(value, 1) {_W}, 6) as value_shift_1 from events")
_ordered("diff_1", lambda x: x.diff("value", 1), f"select event_id, round(value - lag(value, 1) {_W}, 6) as value_diff_1 from events")
_ordered("pct_change_1", lambda x: x.pct_change("value", 1), f"select event_id, round(case when p <> 0 then (value - p) / p end, 6) as value_pct_1 from (select event_id, value, lag(value, 1) {_W} as p from events)")
for _f, _s in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_pop"}.items():
    _ordered(f"rolling_{_f}", lambda x, f=_f: x.rolling("value", 7, f), f"select event_id, case when row_number() {_W} >= 7 then round({_s}(value) over (order by event_id rows between 6 preceding and current row), 6) end as value_rolling_{_f} from events")
_ordered("cumsum", lambda x: x.cumsum("value"), f"select event_id, round(sum(value) {_W}, 4) as value_cumsum from events", 4)
_ordered("cummax", lambda x: x.cummax("value"), f"select event_id, max(value) {_W} as value_cummax from events", None)
_ordered("cummin", lambda x: x.cummin("value"), f"select event_id, min(value) {_W} as value_cummin from events", None)
_ordered("rank_value", lambda x: x.rank("value"), "select event_id, row_number() over (order by value, event_id) as value_rank from events", None)


def _gappy(spark, d) -> Frame:
    x = read_table(spark, d, "events")
    return Frame(x.withColumn("value", F.when(F.col("event_id") % 5 < 2, F.col("value"))), ["event_id"])


_GAP = "g as (select event_id, case when event_id % 5 < 2 then value end as value from events)"


@query(f"with {_GAP} select event_id, last_value(value ignore nulls) over (order by event_id) as value from g")
def ffill(spark, d):
    return _gappy(spark, d).fillna_ffill("value").df.select("event_id", "value")


@query(f"with {_GAP} select event_id, first_value(value ignore nulls) over (order by event_id rows between current row and unbounded following) as value from g")
def bfill(spark, d):
    return _gappy(spark, d).fillna_bfill("value").df.select("event_id", "value")


@query(f"""with {_GAP}, n as (select *, row_number() over (order by event_id) as p from g),
e as (select event_id, value, p, last_value(value ignore nulls) over w as a, last_value(case when value is not null then p end ignore nulls) over w as pa,
  first_value(value ignore nulls) over v as b, first_value(case when value is not null then p end ignore nulls) over v as pb
  from n window w as (order by p), v as (order by p rows between current row and unbounded following))
select event_id, round(case when value is not null then value when a is not null and b is not null then a + (b - a) * (p - pa) / (pb - pa) end, 6) as value from e""")
def interpolate(spark, d):
    return _gappy(spark, d).interpolate("value").df.select("event_id", F.round("value", 6).alias("value"))


@query("select user_id, event_id, sum(value) over (partition by user_id order by event_id) as value_cumsum from events")
def cumsum_by_user(spark, d):
    return Frame(read_table(spark, d, "events"), ["event_id"], ["user_id"]).cumsum("value").df.select("user_id", "event_id", "value_cumsum")


QUERIES["cumsum_by_user"] = lambda spark, d, f=cumsum_by_user: f(spark, d).withColumn("value_cumsum", F.round("value_cumsum", 4))
ORACLE["cumsum_by_user"] = ORACLE["cumsum_by_user"].replace("sum(value) over (partition by user_id order by event_id)", "round(sum(value) over (partition by user_id order by event_id), 4)")


@query("select event_id, value from events order by event_id limit 10")
def head_10(spark, d):
    return _events(spark, d).head(10).select("event_id", "value").df


@query("select event_id, value from events order by event_id desc limit 10")
def tail_10(spark, d):
    return _events(spark, d).tail(10).select("event_id", "value").df


@query("select event_id from (select event_id, row_number() over (order by event_id) - 1 as p from events) where p not in (0, 5, 7)")
def drop_rows(spark, d):
    return _events(spark, d).drop_rows([0, 5, 7]).select("event_id").df


@query("select event_id, row_at from (select event_id, row_number() over (order by event_id) - 1 as p from events) join (values (9, 0), (2, 1), (2, 2)) t(p, row_at) using (p)")
def iloc(spark, d):
    return _events(spark, d).iloc([9, 2, 2], [0]).df


@query("select c_custkey from customer order by c_acctbal, c_custkey limit 20")
def sort_limit(spark, d):
    return Frame(read_table(spark, d, "customer"), ["c_custkey"]).sort_by("c_acctbal").head(20).select("c_custkey").df


@query("select n_nationkey as k from nation union all select s_nationkey from supplier")
def concat(spark, d):
    a = Frame(read_table(spark, d, "nation")).rename({"n_nationkey": "k"}).select("k")
    return a.concat(Frame(read_table(spark, d, "supplier")).rename({"s_nationkey": "k"}).select("k")).df


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def drop_duplicates(spark, d):
    return Frame(read_table(spark, d, "orders"), ["o_orderkey"]).drop_duplicates("o_custkey").select("o_custkey", "o_orderkey").df


@query("select count(*) filter (x1 is null or isnan(x1)) as x1, count(*) filter (firm_id is null) as firm_id, count(*) filter (loaded_at is null) as loaded_at from panel_data")
def count_na(spark, d):
    r = Frame(read_table(spark, d, "panel_data")).select("x1", "firm_id", "loaded_at").count_na()
    return spark.createDataFrame([(r["x1"], r["firm_id"], r["loaded_at"])], "x1 long, firm_id long, loaded_at long")


@query("select obs_id, case when x1 is null or isnan(x1) then (select avg(x1) from panel_data where not isnan(x1)) else x1 end as x1 from panel_data")
def fillna_mean(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("obs_id", "x1")).fillna_mean().df


QUERIES["fillna_mean"] = lambda spark, d, f=fillna_mean: f(spark, d).withColumn("x1", F.round("x1", 8))
ORACLE["fillna_mean"] = f"select obs_id, round(x1, 8) as x1 from ({ORACLE['fillna_mean']})"


@query("select obs_id, coalesce(case when isnan(x2) then null else x2 end, (select median(x2) from panel_data where not isnan(x2))) as x2 from panel_data")
def fillna_median(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("obs_id", "x2")).fillna_median().df


@query("select obs_id from panel_data where firm_id is not null and x1 is not null and not isnan(x1)")
def dropna_subset(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("obs_id", "firm_id", "x1")).dropna_subset(["firm_id", "x1"]).select("obs_id").df


@query("""with s as (select l_extendedprice as v, row_number() over (order by l_extendedprice) - 1 as p, count(*) over () as n from lineitem),
b as (select max(v) filter (p = floor(0.05 * n)) as lo, max(v) filter (p = least(ceil(0.95 * n), n - 1)) as hi from s)
select l_orderkey, l_linenumber, least(greatest(l_extendedprice, lo), hi) as l_extendedprice from lineitem, b""")
def winsorize(spark, d):
    return Frame(read_table(spark, d, "lineitem")).winsorize("l_extendedprice", 0.05).select("l_orderkey", "l_linenumber", "l_extendedprice").df


@query("""with f as (select event_type as level, row_number() over (order by min(event_id)) - 1.0 as code from events group by 1)
select event_id, code::double as event_type_code from events join f on event_type = level""")
def encode_levels(spark, d):
    return _events(spark, d).encode("event_type")[0].select("event_id", "event_type_code").df


@query("select c_custkey, (c_mktsegment = 'BUILDING')::int::double as \"seg_BUILDING\", (c_mktsegment = 'MACHINERY')::int::double as \"seg_MACHINERY\" from customer")
def dummies(spark, d):
    x = Frame(read_table(spark, d, "customer")).generate_dummies("c_mktsegment", "seg").df
    return x.select("c_custkey", *[c for c in x.columns if c in ("seg_BUILDING", "seg_MACHINERY")])


@query("""select l_orderkey, l_linenumber, round(ln(l_quantity), 9) as log_q, round(sqrt(l_extendedprice), 9) as sqrt_p, floor(l_extendedprice / 7) as floor_p, round(exp(l_discount), 9) as exp_d,
  round(exp(-l_discount * l_discount / 2) / sqrt(2 * pi()), 9) as dens, ((l_partkey % 7) + 7) % 7 as m, greatest(l_tax, l_discount) as hi, least(l_tax, l_discount) as lo, round((l_tax + l_discount) / 2, 9) as row_mean,
  case when l_quantity <= 15 then 0.0 else 1.0 end as c, case when l_linenumber < 3 then 0.0 when l_linenumber = 3 then 1.0 when l_linenumber = 4 then 4.0 when l_linenumber = 5 then 10.0 when l_linenumber = 6 then 20.0 when l_linenumber = 7 then 35.0 end as comb from lineitem""")
def scalar_transforms(spark, d):
    q, p, t, s = (F.col(f"l_{c}") for c in ("quantity", "extendedprice", "tax", "discount"))
    u = tr.UNARY
    return read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(u["log"](q), 9).alias("log_q"), F.round(u["sqrt"](p), 9).alias("sqrt_p"), u["floor"](p / 7).alias("floor_p"), F.round(u["exp"](s), 9).alias("exp_d"),
        F.round(u["normal"](s), 9).alias("dens"), tr.mod(F.col("l_partkey"), 7).alias("m"), tr.BINARY["max"](t, s).alias("hi"), tr.BINARY["min"](t, s).alias("lo"), F.round(tr.row_mean(t, s), 9).alias("row_mean"),
        tr.TERNARY["cond"](F.when(q <= 15, 0).otherwise(1), F.lit(1.0), F.lit(0.0)).alias("c"), tr.comb(F.col("l_linenumber"), F.lit(3)).alias("comb"))


@query("""select c_custkey, regexp_matches(c_name, '0+1') as m, regexp_replace(c_name, '0', 'x') as first, regexp_replace(c_name, '0', 'x', 'g') as every, regexp_extract(c_name, '([1-9]+)', 1) as digits from customer""")
def regex_functions(spark, d):
    n = F.col("c_name")
    return read_table(spark, d, "customer").select("c_custkey", tr.regexm(n, "0+1").alias("m"), tr.regexr(n, "0", "x").alias("first"), tr.regexra(n, "0", "x").alias("every"), tr.regexs(n, "([1-9]+)").alias("digits"))


@query("select o_orderkey, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2 as r, dense_rank() over (order by o_orderpriority) as g from orders")
def average_ranks(spark, d):
    x = tr.group_ids(read_table(spark, d, "orders"), "o_orderpriority", "g")
    return tr.average_rank(x, "o_totalprice", "r").select("o_orderkey", "r", "g")


@query("select o_orderkey, round((o_totalprice - avg(o_totalprice) over ()) / stddev_samp(o_totalprice) over (), 8) as z from orders")
def standardize(spark, d):
    return tr.standardize(read_table(spark, d, "orders"), "o_totalprice", "z").select("o_orderkey", F.round("z", 8).alias("z"))

"""Frame methods, sources and sinks over the test tables, with their SQL."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile

from pyspark.sql import functions as F

from gramforge.frame import Frame
from gramforge.functions import transforms as tr
from gramforge.models import bootstrap, linear, multivariate
from gramforge.sources.csv import from_csv, to_csv
from gramforge.sources.datasets import longley, stackloss
from gramforge.sources.json import from_json, to_json
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


_COLS = ("o_totalprice", "o_custkey")
for _name, _sql in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp", "var": "var_samp", "median": "median"}.items():

    def _f(spark, d, name=_name):
        r = getattr(Frame(read_table(spark, d, "orders")).select(*_COLS), name)()
        return spark.createDataFrame([(c, float(f"{r[c]:.9g}")) for c in _COLS], "column_name string, value double")

    _f.__name__ = f"frame_{_name}"
    # Nine significant digits, as sums of many values differ in the last ones.
    query(" union all ".join(f"select '{c}' as column_name, cast(printf('%.9g', {_sql}({c})::double) as double) as value from orders" for c in _COLS))(_f)


@query("select obs_id, case when x1 is null or isnan(x1) then -1.0 else x1 end as x1, case when x2 is null or isnan(x2) then -1.0 else x2 end as x2 from panel_data")
def fillna_value(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("obs_id", "x1", "x2")).fillna(-1.0).df


@query("select obs_id, coalesce(firm_id, 0) as firm_id from panel_data")
def fillna_one_column(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("obs_id", "firm_id")).fillna_column("firm_id", 0).df


_OK = "firm_id is not null and x1 is not null and not isnan(x1) and y is not null and not isnan(y)"


@query(f"select obs_id from panel_data where {_OK}")
def dropna_any(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("obs_id", "firm_id", "x1", "y")).dropna().select("obs_id").df


@query("select firm_id, x1 from panel_data where firm_id is not null or (x1 is not null and not isnan(x1))")
def dropna_all_missing(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("firm_id", "x1")).dropna_all().df


@query("select obs_id is null as obs_id, firm_id is null as firm_id, x1 is null or isnan(x1) as x1, count(*) as n from panel_data group by all")
def isna_mask(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("obs_id", "firm_id", "x1")).isna().df.groupBy("obs_id", "firm_id", "x1").agg(F.count(F.lit(1)).alias("n"))


@query("select obs_id is not null as obs_id, firm_id is not null as firm_id, x1 is not null and not isnan(x1) as x1, count(*) as n from panel_data group by all")
def notna_mask(spark, d):
    return Frame(read_table(spark, d, "panel_data").select("obs_id", "firm_id", "x1")).notna().df.groupBy("obs_id", "firm_id", "x1").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_totalprice * 2 as o_totalprice, o_custkey * 2.0::double as o_custkey from orders")
def apply_double(spark, d):
    x = Frame(read_table(spark, d, "orders").select("o_orderkey", *_COLS), ["o_orderkey"])
    return x.apply(lambda c: c * 2).df


@query("select o_orderkey, round(sqrt(o_totalprice), 8) as o_totalprice from orders")
def map_one_column(spark, d):
    return Frame(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")).map_column("o_totalprice", F.sqrt).df.withColumn("o_totalprice", F.round("o_totalprice", 8))


@query("select event_id, round(ln(abs(product(1 + value / 1e6) over (order by event_id))), 9) as log_product from events")
def cumprod(spark, d):
    x = Frame(read_table(spark, d, "events").withColumn("v", 1 + F.col("value") / 1e6), ["event_id"]).cumprod("v").df
    return x.select("event_id", F.round(F.ln(F.abs("v_cumprod")), 9).alias("log_product"))


@query("select column_name, n from (select count(*) as o_orderkey, count(distinct o_custkey) as o_custkey from orders) unpivot (n for column_name in (o_orderkey, o_custkey))")
def frame_shape(spark, d):
    x = Frame(read_table(spark, d, "orders"))
    return spark.createDataFrame([("o_orderkey", x.n_rows()), ("o_custkey", x.drop_duplicates("o_custkey").n_rows())], "column_name string, n long")


def _folder() -> str:
    """A folder the executors share: beside the checkpoints, or a temporary one of this machine in local mode."""
    own = tempfile.mkdtemp(prefix="gramforge-out-")
    atexit.register(shutil.rmtree, own, True)
    return own


def _shared(spark) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/out-{spark.sparkContext.applicationId}-{os.urandom(4).hex()}" if root else _folder()


@query("select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark, d):
    """Written as CSV and read back with inferred types."""
    path = _shared(spark) + "/customer.csv"
    to_csv(Frame(read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")), path)
    return from_csv(spark, path).df.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def json_round_trip(spark, d):
    path = _shared(spark) + "/nation.json"
    to_json(Frame(read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")), path)
    return from_json(spark, path, lines=True).df.select("n_nationkey", "n_name", "n_regionkey")


@query("""select l_orderkey, l_linenumber, round(l_tax + l_discount, 9) as row_sum, least(l_tax, l_discount) as row_min, greatest(l_tax, l_discount) as row_max, round(l_tax + l_discount, 9) as row_total, 0 as row_miss from lineitem""")
def row_statistics(spark, d):
    t, s = F.col("l_tax"), F.col("l_discount")
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(tr.row_sum(t, s), 9).alias("row_sum"), tr.row_min(t, s).alias("row_min"), tr.row_max(t, s).alias("row_max"), F.round(tr.row_total(t, s), 9).alias("row_total"), tr.row_miss(t, s).cast("int").alias("row_miss"))


@query("select c_custkey, c_mktsegment like 'B%' as b, regexp_extract(c_mktsegment, '^(.)', 1) as initial from customer")
def regex_scalars(spark, d):
    n = F.col("c_mktsegment")
    return read_table(spark, d, "customer").select("c_custkey", tr.regexm(n, "^B").alias("b"), tr.regexs(n, "^(.)").alias("initial"))


@query("with r as (select corr(l_quantity, l_extendedprice) as r from lineitem) select round(abs(r), 8) as r1 from r")
def canonical_correlation(spark, d):
    r = multivariate.canonical_correlations(read_table(spark, d, "lineitem"), ["l_quantity"], ["l_extendedprice"])
    return spark.createDataFrame([(round(float(r[0]), 8),)], "r1 double")


@query("""with c as (select l_returnflag as g, count(*) as n, avg(l_quantity) as a, avg(l_extendedprice) as b, var_pop(l_quantity) * count(*) as aa, var_pop(l_extendedprice) * count(*) as bb, covar_pop(l_quantity, l_extendedprice) * count(*) as ab from lineitem group by 1),
w as (select sum(aa) as aa, sum(bb) as bb, sum(ab) as ab from c), t as (select var_pop(l_quantity) * count(*) as aa, var_pop(l_extendedprice) * count(*) as bb, covar_pop(l_quantity, l_extendedprice) * count(*) as ab from lineitem)
select round((w.aa * w.bb - w.ab * w.ab) / (t.aa * t.bb - t.ab * t.ab), 9) as wilks from w, t""")
def manova(spark, d):
    r = multivariate.manova(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag")
    return spark.createDataFrame([(round(float(r["wilks"]), 9),)], "wilks double")


@query("select -3482258.6 as const_rounded, 16::bigint as n, 21::bigint as stack_rows")
def classic_tables(spark, d):
    """The published intercept of the regression of employment on all six columns (employment in thousands)."""
    x = longley(spark)
    fit = linear.ols(x.df, "employed ~ gnp_deflator + gnp + unemployed + armed_forces + population + year")
    return spark.createDataFrame([(round(float(fit.params[0]) * 1000, 1), x.n_rows(), stackloss(spark).n_rows())], "const_rounded double, n long, stack_rows long")


@query("""with g as (select regr_slope(l_extendedprice, l_quantity) as b, sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)) as se from lineitem)
select 'l_quantity' as term, true as centred, true as spread_as_robust, true as interval_holds_estimate from g""")
def bootstrap_slope(spark, d):
    """200 replicates against the fit: mean within four of its errors, spread within 25 % of the HC1 error (a standard deviation of 200 draws has an error of 5 %), interval around the estimate."""
    x = read_table(spark, d, "lineitem")
    names, draws = bootstrap.pairs_bootstrap(x, "l_extendedprice ~ l_quantity", 200, seed=3)
    fit = linear.ols(x, "l_extendedprice ~ l_quantity")
    robust = linear.ols(x, "l_extendedprice ~ l_quantity", linear.Cov("HC1"))
    i = names.index("l_quantity")
    low, high = bootstrap.percentile_ci(draws)
    se = bootstrap.bootstrap_se(draws)[i]
    ok = (abs(draws[:, i].mean() - fit.params[i]) < 4 * se / math.sqrt(len(draws)), abs(se / robust.se[i] - 1) < 0.25, low[i] < fit.params[i] < high[i])
    return spark.createDataFrame([("l_quantity", *map(bool, ok))], "term string, centred boolean, spread_as_robust boolean, interval_holds_estimate boolean")

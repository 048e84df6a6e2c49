"""Queries p1, p2 and p4 over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.operators.fill import fill_category, fill_numeric
from gramforge.operators.grid import regular_grid
from gramforge.sources.records import FieldSpec, parse_chunks, parse_lines
from gramforge.util import read_table

#: What the test data state about valid entries.
FIRST_FIRM, LAST_TIME, TOP_X1, TOP_INCOME = 1000, 10**10, 1000, 5_000_000
WAGE_RECORD = (
    FieldSpec("wage", "double", 0, 100000, low_open=True),
    FieldSpec("education", "int", 0, 30),
    FieldSpec("experience", "int", 0, 70),
    FieldSpec("female", "flag"),
    FieldSpec("occupation", "string"),
)


def filled_panel(panel: DataFrame) -> DataFrame:
    x1 = F.col("x1")
    firms = fill_category(panel, "firm_id", "batch_id", time="wave", valid=F.col("firm_id") >= FIRST_FIRM)
    return fill_numeric(firms, "x1", "firm_id", time="wave", valid=(x1 > 0) & (x1 < TOP_X1))


def filled_income(income: DataFrame) -> DataFrame:
    month = income.withColumn("interview_month", F.trunc("interview_day", "month"))
    return fill_numeric(month, "income", "district_id", time="interview_month", valid=F.col("income").between(1, TOP_INCOME), link="log").drop("interview_month")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    panel, income = filled_panel(read_table(spark, d, "panel_data")), filled_income(read_table(spark, d, "income_dataset"))

    def cases(df: DataFrame, src: str, row: str, field: str, group: str) -> DataFrame:
        return df.where(f"{field}_was_filled").select(F.lit(src).alias("src"), F.col(row).alias("row_id"), F.lit(field).alias("field_name"), F.col(group).cast("bigint").alias("group_id"))

    fields = F.array(*[F.when(F.col(f"{f}_was_filled"), F.lit(f)) for f in ("firm_id", "x1")])
    both = panel.where("firm_id_was_filled or x1_was_filled").select(F.lit("panel_data").alias("src"), F.col("obs_id").alias("row_id"), F.explode(F.array_compact(fields)).alias("field_name"), F.col("firm_id").alias("group_id"))
    return both.unionByName(cases(income, "income_dataset", "resp_id", "income", "district_id"))


def _shown(df: DataFrame, *names: str) -> DataFrame:
    """Columns of a result, a filled x1 with three decimals."""
    x1 = F.when(F.col("x1_was_filled"), F.round("x1", 3)).otherwise(F.col("x1")).alias("x1") if "x1" in names else None
    return df.select(*[x1 if n == "x1" else n for n in names])


def p1_filled_panel(spark: SparkSession, d: str) -> DataFrame:
    return _shown(filled_panel(read_table(spark, d, "panel_data")), "obs_id", "firm_id", "firm_id_was_filled", "x1", "x1_was_filled")


def p1_filled_income(spark: SparkSession, d: str) -> DataFrame:
    return _shown(filled_income(read_table(spark, d, "income_dataset")), "resp_id", "district_id", "income", "income_was_filled")


def panel_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "panel_data").join(read_table(spark, d, "sectors"), "sector_id")
    valid = (F.col("firm_id") >= FIRST_FIRM) & (F.col("time_id") >= 0) & (F.col("time_id") < LAST_TIME)
    return regular_grid(rows, ["firm_id", "wave"], "time_id", "step_len", "y", valid=valid)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return panel_grid(spark, d).where("was_missing").select("firm_id", "slot")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return panel_grid(spark, d).withColumn("slot_value", F.round("slot_value", 6))


def parsed_wages(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(read_table(spark, d, "wage_raw"), "raw_line", WAGE_RECORD)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parsed_wages(spark, d).where("reason is not null").select("raw_id", "reason")


def p4_valid(spark: SparkSession, d: str) -> DataFrame:
    return parsed_wages(spark, d).where("reason is null").select("raw_id", "wage", "education", "experience", "female")


def p4_recovered(spark: SparkSession, d: str) -> DataFrame:
    """The same lines as text of their files, in chunks of 200 lines without any record borders: valid records found by recovery, counted."""
    lines = read_table(spark, d, "wage_raw").select("file_name", F.floor((F.col("line_no") - 2) / 200).alias("chunk_no"), "line_no", F.coalesce("raw_line", F.lit("")).alias("raw_line"))
    chunks = lines.groupBy("file_name", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw_line"))).alias("a"))
    chunks = chunks.select("file_name", "chunk_no", F.concat(F.array_join(F.col("a.raw_line"), "\n"), F.lit("\n")).alias("text"))
    found = parse_chunks(chunks, WAGE_RECORD, file="file_name", chunk="chunk_no", text="text").where("reason is null")
    return found.groupBy("file_name", "wage", "education", "experience", "female").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_filled_panel, p1_filled_income, p2_found, p2_grid, p4_found, p4_valid, p4_recovered)}

_FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
_P4 = rf"""
lines as (select raw_id, case when right(coalesce(raw_line, ''), 1) = chr(13) then left(raw_line, length(raw_line) - 1) else coalesce(raw_line, '') end as l from wage_raw),
shaped as (select raw_id, regexp_full_match(l, '(?s){_FIELD}(?:,{_FIELD})*') as ok,
  regexp_full_match(l, '(?s){_FIELD}(?:,{_FIELD}){{4}}') as five,
  [regexp_extract(l, '(?s)^(?:{_FIELD},){{' || k || '}}({_FIELD})(?:,|$)', 1) for k in [0, 1, 2, 3]] as f from lines),
cleaned as (select raw_id, ok, five, [trim(case when left(x, 1) = '"' then replace(x[2:-2], '""', '"') else x end, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) for x in f] as v from shaped),
typed as (select raw_id, ok, five, v, [x in ('', 'NA', '.', 'NaN', 'NULL', 'null') for x in v] as na,
  [regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') for x in v] as num, [try_cast(x as double) for x in v] as d from cleaned),
judged as (select raw_id, v, na, d, case when not ok then 'quoting' when not five then 'column_count'
  when not ((na[1] or (num[1] and d[1] > 0 and d[1] <= 100000)) and (na[2] or (num[2] and d[2] between 0 and 30 and d[2] = floor(d[2])))
    and (na[3] or (num[3] and d[3] between 0 and 70 and d[3] = floor(d[3]))) and (na[4] or v[4] in ('0', '1'))) then 'invalid_value' end as reason from typed)
"""
_READINGS = """
readings as (select p.firm_id, p.wave, s.step_len, cast(floor(p.time_id / s.step_len) as bigint) as slot, avg(p.y) as v, count(*) as n
  from panel_data p join sectors s using (sector_id)
  where p.firm_id >= 1000 and p.time_id >= 0 and p.time_id < 10000000000 and p.y is not null and not isnan(p.y) group by all),
steps as (select *, lag(slot) over w as prev, lag(v) over w as prev_v from readings window w as (partition by firm_id, wave order by slot)),
gaps as (select *, unnest(range(prev + 1, slot)) as s from steps where slot > prev + 1)
"""


def _mixed_effects(y: str, table: str) -> str:
    """CTEs that predict y from g and t of `table` (columns y, g, t), two sweeps: u2 (g, u, lo, hi), v2 (t, v) and vc (mu)."""
    effect = "case when sum(c.n) * {s2} + se > 0 then sum(c.s - c.n * {other} - c.n * mu) * {s2} / (sum(c.n) * {s2} + se) else 0 end"
    u = "select c.g, " + effect.format(s2="su", other="{v}") + " as u, min(c.lo) as lo, max(c.hi) as hi from cells c cross join vc {join} group by c.g, mu, se, su"
    v = "select c.t, " + effect.format(s2="sv", other="u.u") + " as v from cells c cross join vc join {u} u using (g) group by c.t, mu, se, sv"
    return f"""
cells as (select g, t, count(*)::double as n, avg({y}) * count(*) as s, var_pop({y}) * count(*) as ss, min(y) as lo, max(y) as hi from {table} where g is not null group by g, t),
tot as (select sum(n) as n, sum(s) as s, case when sum(n) > count(*) then sum(ss) / (sum(n) - count(*)) else 0 end as se from cells),
lg as (select count(*) as k, sum(s * s / n) - pow(sum(s), 2) / sum(n) as b, sum(n * n) as q, sum(nn / n) as x from (select sum(n) as n, sum(s) as s, sum(n * n) as nn from cells group by g)),
lt as (select count(*) as k, sum(s * s / n) - pow(sum(s), 2) / sum(n) as b, sum(n * n) as q, sum(nn / n) as x from (select sum(n) as n, sum(s) as s, sum(n * n) as nn from cells group by t)),
eq as (select tot.n, tot.s / tot.n as mu, se, tot.n - lg.q / tot.n as a, lg.x - lt.q / tot.n as b, lt.x - lg.q / tot.n as c, tot.n - lt.q / tot.n as d, lg.b - (lg.k - 1) * se as y, lt.b - (lt.k - 1) * se as z from tot, lg, lt),
both_ as (select *, case when a * d - b * c > 1e-9 * n * n then (d * y - b * z) / (a * d - b * c) else -1 end as su0, case when a * d - b * c > 1e-9 * n * n then (a * z - c * y) / (a * d - b * c) else -1 end as sv0 from eq),
vc as (select mu, se, case when least(su0, sv0) >= 0 then su0 when a > 0 then greatest(y / a, 0) else 0 end as su, case when least(su0, sv0) >= 0 then sv0 when d > 0 then greatest(z / d, 0) else 0 end as sv from both_),
u0 as ({u.format(v="0", join="")}),
v1 as ({v.format(u="u0")}),
u1 as ({u.format(v="coalesce(v.v, 0)", join="left join v1 v using (t)")}),
v2 as ({v.format(u="u1")}),
u2 as ({u.format(v="coalesce(v.v, 0)", join="left join v2 v using (t)")})"""


_PREDICTED = "least(greatest({0}, u2.lo), u2.hi)"
ORACLE = {
    "p1_filled_panel": f"""with batches as (select batch_id, min(firm_id) as firm from panel_data where firm_id >= 1000 group by batch_id),
rows_ as (select p.obs_id, case when p.firm_id >= 1000 then p.firm_id else b.firm end as g, p.wave as t, not coalesce(p.firm_id >= 1000, false) and b.firm is not null as ff,
  case when p.x1 > 0 and p.x1 < 1000 then p.x1 end as y from panel_data p left join batches b using (batch_id)),
given as (select * from rows_ where y is not null), {_mixed_effects("y", "given")}
select obs_id, r.g as firm_id, ff as firm_id_was_filled, case when y is not null then y when u2.u is not null then round({_PREDICTED.format("mu + u2.u + coalesce(v2.v, 0)")}, 3) end as x1, y is null and u2.u is not null as x1_was_filled
from rows_ r cross join vc left join u2 using (g) left join v2 using (t)""",
    "p1_filled_income": f"""with rows_ as (select resp_id, district_id as g, date_trunc('month', interview_day) as t, case when income between 1 and 5000000 then income end as y from income_dataset),
given as (select * from rows_ where y is not null), {_mixed_effects("ln(y)", "given")}
select resp_id, r.g as district_id, case when y is not null then y when u2.u is not null then round({_PREDICTED.format("exp(mu + u2.u + coalesce(v2.v, 0))")})::bigint end as income, y is null and u2.u is not null as income_was_filled
from rows_ r cross join vc left join u2 using (g) left join v2 using (t)""",
    "p1_found": """
with batches as (select batch_id, min(firm_id) as firm from panel_data where firm_id >= 1000 group by batch_id),
panel as (select p.obs_id, case when p.firm_id >= 1000 then p.firm_id else b.firm end as firm, coalesce(p.firm_id >= 1000, false) as had, coalesce(p.x1 > 0 and p.x1 < 1000, false) as ok
  from panel_data p left join batches b using (batch_id)),
measured as (select distinct firm from panel where ok and firm is not null),
districts as (select distinct district_id from income_dataset where income between 1 and 5000000)
select 'panel_data' as src, obs_id as row_id, 'firm_id' as field_name, firm as group_id from panel where not had and firm is not null
union all select 'panel_data', obs_id, 'x1', firm from panel join measured using (firm) where not ok
union all select 'income_dataset', resp_id, 'income', district_id from income_dataset join districts using (district_id) where not coalesce(income between 1 and 5000000, false)
""",
    "p2_found": f"with {_READINGS} select firm_id, s as slot from gaps",
    "p2_grid": f"""with {_READINGS}
select firm_id, wave, slot, slot * step_len as slot_start, round(v, 6) as slot_value, n as n_readings, false as was_missing from readings
union all select firm_id, wave, s, s * step_len, round(prev_v + (v - prev_v) * ((s - prev) / (slot - prev)), 6), 0, true from gaps
""",
    "p4_found": f"with {_P4} select raw_id, reason from judged where reason is not null",
    "p4_valid": f"""with {_P4} select raw_id, case when not na[1] then d[1] end as wage, case when not na[2] then cast(d[2] as bigint) end as education,
  case when not na[3] then cast(d[3] as bigint) end as experience, case when not na[4] then cast(d[4] as bigint) end as female from judged where reason is null""",
    "p4_recovered": f"""with {_P4}, valid as (select raw_id, case when not na[1] then d[1] end as wage, case when not na[2] then cast(d[2] as bigint) end as education,
  case when not na[3] then cast(d[3] as bigint) end as experience, case when not na[4] then cast(d[4] as bigint) end as female from judged where reason is null)
select file_name, wage, education, experience, female, count(*) as n_records from valid join wage_raw using (raw_id) group by all""",
}

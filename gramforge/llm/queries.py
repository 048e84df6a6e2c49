"""Queries p3 and p5 to p8 over the test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.llm.code_language import language_shares, natural_language_units
from gramforge.llm.dyadic_sketch import SketchShape, build_sketch, check_ranks, merge_sketches, sketch_quantiles
from gramforge.llm.leaked_items import leaked_items
from gramforge.llm.mixing import mix_sources
from gramforge.llm.shared_spans import shared_share, shared_spans
from gramforge.util import read_table

#: Where the vocabulary of a public tokenizer lies.
RANKS_FILE = os.environ.get("GRAMFORGE_RANKS_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")


MOST_WORDS = 100_000
P3_LEVELS = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """A sketch per level of education and area; the areas' sketches are added."""
    parts = build_sketch(read_table(spark, d, "wage_data"), ["education", "area"], "wage")
    return sketch_quantiles(merge_sketches(parts, ["education"]), ["education"], P3_LEVELS)


def p3_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact rank of every percentile lies within the stated bound."""
    checked = check_ranks(read_table(spark, d, "wage_data"), p3_percentiles(spark, d), ["education"], "wage")
    return checked.select("education", "q", "n_values", "within_bound")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Values counted per level of education in the merged sketch, without rows received over 30 days late, which are deleted from it."""
    wages = read_table(spark, d, "wage_data")
    late = wages.where(F.datediff("received_day", "survey_day") > 30).withColumn("minus", F.lit(-1))
    both = build_sketch(wages, ["education", "area"], "wage").unionByName(build_sketch(late, ["education", "area"], "wage", weight="minus"))
    merged = merge_sketches(both, ["education"])
    return merged.where(F.col("level") == SketchShape().sketched).select("education", F.col("n").alias("n_values"))


def _found_units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = read_table(spark, d, "source_files")
    # The project's own word list: a hand-kept one, so a longer table is not it.
    words = [r["pt_word"] for r in read_table(spark, d, "pt_words").where("pt_word is not null").limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise InvalidOperation(f"over {MOST_WORDS} words")
    return files, natural_language_units(files, extra_words={"pt": words}, keep_text=False)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _found_units(spark, d)[1].select("file_id", "line_no", "unit_kind", "lang").distinct()


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return language_shares(*_found_units(spark, d))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", "shared_runs", F.round("item_overlap", 9).alias("item_overlap"), F.col("answer_found").cast("int").alias("answer_found"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "source_targets"), ranks_file=RANKS_FILE)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target source what the mixture must hold: no document over its repeats, every copy once, the share within one document of its target."""
    mix, report = _mixed(spark, d)
    used = mix.groupBy("source").agg(F.max("repeats").alias("most"), F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id", "copy_no").alias("copies"), F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"))
    total = report.agg(F.sum("chosen_tokens").alias("total"), F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share"))).alias("whole"))
    x = report.join(used, "source", "left").crossJoin(F.broadcast(total))  # one row
    share = F.abs(F.col("n") - F.col("total") * F.col("target_share") / F.col("whole")) <= 2 * F.col("longest")
    return x.select(
        "source", "target_share", "max_repeats", "available_docs",
        F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("repeats_kept"),
        F.coalesce((F.col("rows") == F.col("copies")) & (F.col("n") == F.col("chosen_tokens")), F.lit(True)).alias("copies_once"),
        F.coalesce(share, F.col("available_docs") == 0).alias("share_met"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(read_table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return shared_share(docs, shared_spans(docs)).withColumn("shared_share", F.round("shared_share", 9))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_within_bound, p3_counts, p5_found, p5_shares, p6_found, p6_leaks, p7_mix, p7_shares, p7_checks, p8_found, p8_shares)}

_P8 = """
win as (select doc_id, unnest(range(0, length(text) - 349)) as s, text from documents where length(text) >= 350),
hashed as (select doc_id, s, md5(substr(text, s + 1, 350)) as h from win),
shared as (select h from hashed group by h having min(doc_id) <> max(doc_id)),
starts as (select doc_id, s from hashed join shared using (h)),
marked as (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 350 then 0 else 1 end as new from starts),
runs as (select doc_id, s, sum(new) over (partition by doc_id order by s) as run from marked),
spans as (select doc_id, min(s) as span_start, max(s) + 350 as span_end from runs group by doc_id, run)
"""
_P6 = r"""
docs as (select doc_id as id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{Nd}]+') as w from documents),
tests as (select item_id as id, regexp_extract_all(strip_accents(lower(item_text)), '[\p{L}\p{Nd}]+') as w from eval_items),
doc_runs as (select id, array_to_string(w[k:k+12], ' ') as g from (select id, w, unnest(range(1, len(w) - 11)) as k from docs)),
item_runs as (select id, array_to_string(w[k:k+12], ' ') as g from (select id, w, unnest(range(1, len(w) - 11)) as k from tests))
"""
_FINITE = "wage is not null and isfinite(wage)"
#: A pair's measures besides its score.
_P6_LEAKS = f"""with {_P6},
answers as (select item_id as id, regexp_extract_all(strip_accents(lower(answer)), '[\\p{{L}}\\p{{Nd}}]+') as a from eval_items),
pairs as (select d.id as doc, i.id as item, count(*) as shared_runs from doc_runs d join (select distinct id, g from item_runs) i using (g) group by all)
select doc as doc_id, item as item_id, shared_runs, round(len(list_intersect(list_distinct(d.w), t.w)) / len(list_distinct(t.w)), 9) as item_overlap,
  case when len(a) > 0 then (len(list_intersect(list_distinct(a), d.w)) = len(list_distinct(a)))::int end as answer_found
from pairs join docs d on d.id = doc join tests t on t.id = item join answers n on n.id = item"""
ORACLE = {
    "p6_leaks": _P6_LEAKS,
    "p3_within_bound": f"""select education, q::double as q, count(*) as n_values, true as within_bound from wage_data, unnest([{", ".join(map(str, P3_LEVELS))}]) t(q) where {_FINITE} group by all""",
    "p3_counts": f"""select education, count(*) as n_values from wage_data where {_FINITE}
  and not coalesce(received_day - survey_day > 30, false) group by education having count(*) > 0""",
    "p6_found": f"with {_P6} select distinct d.id as doc_id, i.id as item_id from doc_runs d join item_runs i using (g)",
    "p7_checks": """with n as (select lower(trim(source)) as source, count(*) as k from documents group by 1)
select lower(trim(t.source)) as source, target_share, max_repeats, coalesce(k, 0) as available_docs, true as repeats_kept, true as copies_once, true as share_met
from source_targets t left join n on n.source = lower(trim(t.source))""",
    "p8_found": f"with {_P8} select doc_id, span_start, span_end from spans",
    "p8_shares": f"""with {_P8}, sums as (select doc_id, sum(span_end - span_start) as k from spans group by doc_id)
select doc_id, coalesce(length(text), 0) as n_chars, coalesce(k, 0)::bigint as shared_chars, round(case when length(text) > 0 then coalesce(k, 0) / length(text) else 0 end, 9) as shared_share
from documents left join sums using (doc_id)""",
}

"""CSV reading with type inference in one aggregate job, and CSV writing."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation, VariableNotFound
from gramforge.frame import Frame
from gramforge.util import col

#: Default tokens of the type inference.
NULLS = ("", "NA", ".", "NaN", "NULL", "null")
TRUE = ("true", "True", "TRUE", "1", "yes", "Yes", "YES", "t", "T")
FALSE = ("false", "False", "FALSE", "0", "no", "No", "NO", "f", "F")
DATES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")


@dataclass(frozen=True)
class InferenceConfig:
    nulls: Sequence[str] = NULLS
    true: Sequence[str] = TRUE
    false: Sequence[str] = FALSE
    dates: Sequence[str] = DATES
    categorical_ratio: float = 0.5
    column_types: Mapping[str, str] = field(default_factory=dict)
    compat_nulls: bool = False


def infer_types(df: DataFrame, config: InferenceConfig = InferenceConfig()) -> dict[str, tuple]:  # noqa: B008
    """Type per string column: ("double"|"boolean"|"bigint"|"timestamp"|"categorical"|"string", detail). One job over all columns.

    Order: all missing → double; all true/false tokens → boolean; exactly two distinct
    non-numeric values → boolean, the larger being true; integers; numbers (all integral → bigint);
    one date format; distinct share below the ratio → categorical; else string.
    """
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.trim(col(c))
        v = F.when(~v.isin(*config.nulls), v)
        num = v.try_cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.approx_count_distinct(v, 0.02).alias(f"d{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        aggs += [F.count_if(v.isin(*config.true, *config.false)).alias(f"b{i}"), F.count_if(v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()).alias(f"i{i}"), F.count(num).alias(f"f{i}")]
        aggs += [F.count_if(num.isNotNull() & (F.isnan(num) | (F.abs(num) == float("inf")))).alias(f"x{i}"), F.count_if(num == F.floor(num)).alias(f"w{i}")]
        aggs += [F.count(F.try_to_timestamp(v, F.lit(d))).alias(f"t{i}_{j}") for j, d in enumerate(config.dates)]
    r = df.agg(*aggs).first()

    def value(i: int) -> Column:
        v = F.trim(col(df.columns[i]))
        return F.when(~v.isin(*config.nulls), v)

    # Distinct values are estimated; where that could tip a decision, the columns concerned are counted exactly.
    few = [i for i in range(len(df.columns)) if r[f"n{i}"] and r[f"d{i}"] <= 8 and not r[f"f{i}"]]
    two = df.agg(*[F.count_if(value(i).isin(r[f"lo{i}"], r[f"hi{i}"])).alias(f"e{i}") for i in few]).first().asDict() if few else {}
    near = [i for i in range(len(df.columns)) if r[f"n{i}"] and abs(r[f"d{i}"] / r[f"n{i}"] - config.categorical_ratio) < 0.15 * config.categorical_ratio]
    shares = {i: df.agg(F.count_distinct(value(i))).first()[0] / r[f"n{i}"] for i in near}
    out: dict[str, tuple] = {}
    for i, c in enumerate(df.columns):
        n, numeric = r[f"n{i}"], r[f"f{i}"]
        dates = [d for j, d in enumerate(config.dates) if n and r[f"t{i}_{j}"] == n]
        if n == 0:
            out[c] = ("double", None)
        elif r[f"b{i}"] == n:
            out[c] = ("boolean", None)
        elif i in few and r[f"lo{i}"] != r[f"hi{i}"] and two[f"e{i}"] == n:
            out[c] = ("boolean", r[f"hi{i}"])
        elif r[f"i{i}"] == n:
            out[c] = ("bigint", None)
        elif numeric == n and numeric > r[f"x{i}"]:
            out[c] = ("bigint", "integral") if r[f"w{i}"] == numeric - r[f"x{i}"] and not r[f"x{i}"] else ("double", None)
        elif dates:
            out[c] = ("timestamp", dates[0])
        else:
            out[c] = ("categorical" if shares.get(i, r[f"d{i}"] / n) < config.categorical_ratio else "string", None)
    return out


def create_column_with_type(c: Column, kind: str, config: InferenceConfig = InferenceConfig(), detail: str | None = None) -> Column:  # noqa: B008
    """Cast trimmed text; bad values are NULL, or 0 / false / the epoch with compat_nulls (NaN for double)."""
    v = F.trim(c)
    v = F.when(~v.isin(*config.nulls), v)
    if kind == "boolean":
        out = (v == detail) if detail else F.when(v.isin(*config.true), True).when(v.isin(*config.false), False)
        return F.coalesce(out, F.lit(False)) if config.compat_nulls else out
    if kind == "bigint":
        out = v.try_cast("double").try_cast("bigint") if detail == "integral" else v.try_cast("bigint")
        return F.coalesce(out, F.lit(0)) if config.compat_nulls else out
    if kind == "double":
        out = v.try_cast("double")
        return F.coalesce(out, F.lit(float("nan"))) if config.compat_nulls else out
    if kind == "timestamp":
        out = F.coalesce(*[F.try_to_timestamp(v, F.lit(d)) for d in ([detail] if detail else config.dates)]).cast("timestamp_ntz")
        return F.coalesce(out, F.lit("1970-01-01").cast("timestamp_ntz")) if config.compat_nulls else out
    if kind in ("string", "categorical"):
        return c if kind == "categorical" else v
    raise InvalidOperation(f"unknown column type {kind!r}")


def from_csv(spark: SparkSession, path: str, *, config: InferenceConfig = InferenceConfig(), columns: Sequence[str] | None = None, delimiter: str = ",", predicate: str | None = None) -> Frame:  # noqa: B008
    """Read CSV with a header; types are inferred unless given in `config.column_types`; `predicate` is an SQL filter on the typed columns."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path, sep=delimiter)
    if columns is not None:
        if bad := [c for c in columns if c not in raw.columns]:
            raise VariableNotFound(f"columns not in the file: {bad}")
        raw = raw.select(*[col(c) for c in columns])
    open_ = [c for c in raw.columns if c not in config.column_types]
    kinds = {c: (k, None) for c, k in config.column_types.items()} | (infer_types(raw.select(*[col(c) for c in open_]), config) if open_ else {})
    df = raw.select(*[create_column_with_type(col(c), kinds[c][0], config, kinds[c][1]).alias(c) for c in raw.columns])
    return Frame(df.where(predicate) if predicate else df)


def from_csv_url(spark: SparkSession, url: str, **kwargs) -> Frame:
    """Fetch a file to every node and read it."""
    from pyspark import SparkFiles

    spark.sparkContext.addFile(url)
    return from_csv(spark, "file://" + SparkFiles.get(os.path.basename(url)), **kwargs)


def to_csv(frame: Frame, path: str, *, append: bool = False, single: bool = False) -> None:
    """A folder of CSV part files with header (appended parts included). single: one part, for small frames."""
    df = frame.df.select(*[F.date_format(col(c), "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else col(c) for c, t in frame.df.dtypes])
    (df.coalesce(1) if single else df).write.mode("append" if append else "errorifexists").option("header", True).csv(path)

"""JSON in both shapes: an array (or lines) of records, or one object of arrays."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gramforge.errors import ShapeMismatch
from gramforge.frame import Frame
from gramforge.util import col


def from_json(spark: SparkSession, path: str, *, lines: bool = False) -> Frame:
    """Records, or a single object whose members are equally long arrays (then one row per position)."""
    df = spark.read.option("multiLine", not lines).json(path)
    if not df.columns or not all(t.startswith("array<") for _, t in df.dtypes):
        return Frame(df)
    sizes = df.select(*[F.size(col(c)).alias(c) for c in df.columns]).limit(2).collect()
    if len(sizes) != 1:
        return Frame(df)
    if len(set(sizes[0])) > 1:
        raise ShapeMismatch("columns differ in length")
    rows = df.select(F.posexplode(F.arrays_zip(*[col(c) for c in df.columns])).alias("row_no", "r"))
    return Frame(rows.select("row_no", *[F.col("r").getField(c).alias(c) for c in df.columns]), ["row_no"])


def from_json_url(spark: SparkSession, url: str, **kwargs) -> Frame:
    from pyspark import SparkFiles

    spark.sparkContext.addFile(url)
    return from_json(spark, "file://" + SparkFiles.get(os.path.basename(url)), **kwargs)


def to_json(frame: Frame, path: str, *, append: bool = False) -> None:
    """A folder of JSON lines files."""
    frame.df.write.mode("append" if append else "errorifexists").json(path)


def to_json_columns(frame: Frame, max_rows: int = 100_000) -> str:
    """One object of arrays as text, for frames of at most max_rows rows; missing values are null."""
    import json

    rows = frame.df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ShapeMismatch(f"over {max_rows} rows; write JSON lines instead")
    clean = lambda v: None if isinstance(v, float) and v != v else v
    return json.dumps({c: [clean(r[c]) for r in rows] for c in frame.df.columns}, indent=2, default=str)

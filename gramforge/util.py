"""Small helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation, VariableNotFound


def col(name: str) -> Column:
    """The column of exactly this name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(base: str, taken: Iterable[str]) -> str:
    """`base`, with underscores appended until no name in `taken` equals it (case ignored)."""
    used = {x.lower() for x in taken}
    while base.lower() in used:
        base += "_"
    return base


def require(df: DataFrame, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise VariableNotFound(f"column {n!r} not in {df.columns}")


def reject_clash(names: Iterable[str], made: Iterable[str]) -> None:
    """An error if a kept column is named like a result column (case ignored)."""
    taken = {m.lower() for m in made}
    if clash := [n for n in names if n.lower() in taken]:
        raise InvalidOperation(f"columns named like result columns: {clash}")


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = col(name)
    kind = dict(df.dtypes)[name]
    return (c.isNull() | F.isnan(c)) if kind in ("double", "float") else c.isNull()


def join_on(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Join on equally named keys where NULL equals NULL; the right side's keys are dropped."""
    keys = list(keys)
    new = {k: free_name(f"_right_{i}", [*left.columns, *right.columns]) for i, k in enumerate(keys)}
    r = right.select(*[col(c).alias(new.get(c, c)) for c in right.columns])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        e = col(k).eqNullSafe(col(new[k]))
        cond = e if i == 0 else cond & e
    return left.join(r, cond, how).drop(*new.values())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder all executors share; a local folder is set only where none is configured."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise InvalidOperation("set spark.checkpoint.dir to a folder shared by all executors")
        own = tempfile.mkdtemp(prefix="gramforge-ckpt-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()

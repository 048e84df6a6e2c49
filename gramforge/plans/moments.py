"""Sufficient statistics as Catalyst aggregates.

`gram` adds the cross products of expressions: in one pass for up to `ONE_PASS_TERMS` of them without weights, else in
a pass for the means and one for the centred products. Up to `JVM_TERMS`
expressions stay in whole-stage code; wider designs are multiplied per Arrow batch in numpy, so only one k x k
matrix per task is shuffled. Columns are centred and scaled before multiplying.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation, SingularMatrix
from gramforge.util import col

JVM_TERMS = 12
#: Up to this many expressions without weights one pass suffices.
ONE_PASS_TERMS = 5


@dataclass
class Gram:
    """n, weight total and raw second moments Z'WZ of named columns (numerically from centred ones)."""

    names: list[str]
    n: int
    weight: float
    mean: np.ndarray
    centred: np.ndarray

    @property
    def raw(self) -> np.ndarray:
        return self.centred + self.weight * np.outer(self.mean, self.mean)

    def pick(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        at = {x: i for i, x in enumerate(self.names)}
        return self.raw[np.ix_([at[r] for r in rows], [at[c] for c in cols])]


def materialise(df: DataFrame, exprs: dict[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Project named double expressions z0.. with the columns to keep."""
    return df.select(*[col(c) for c in keep], *[e.cast("double").alias(f"z{i}") for i, e in enumerate(exprs.values())])


def _check(r) -> None:
    if not r["n"]:
        raise InvalidOperation("no rows")
    if r["bad"]:
        raise InvalidOperation(f"{r['bad']} rows hold NULL, NaN or infinite values")


def gram(df: DataFrame, exprs: dict[str, Column], weight: Column | None = None) -> Gram:
    """Cross moments of `exprs` over all rows. NULL, NaN or infinite values are an error."""
    names = list(exprs)
    k = len(names)
    z = df.select(*[e.cast("double").alias(f"z{i}") for i, e in enumerate(exprs.values())], (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    bad = None
    for i in range(k):
        b = F.col(f"z{i}").isNull() | F.isnan(f"z{i}") | (F.abs(F.col(f"z{i}")) == float("inf"))
        bad = b if bad is None else bad | b
    w = F.col("w")
    if weight is None and k <= ONE_PASS_TERMS:
        # Spark's own covariance aggregates merge centred sums, so one pass gives what two give.
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        r = z.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(k)], *[F.covar_pop(f"z{i}", f"z{j}").alias(f"s{i}_{j}") for i, j in pairs]).first()
        _check(r)
        s = np.zeros((k, k))
        for i, j in pairs:
            s[i, j] = s[j, i] = r[f"s{i}_{j}"] * r["n"]
        return Gram(names, int(r["n"]), float(r["n"]), np.array([r[f"m{i}"] for i in range(k)]), s)
    first = z.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.count_if(bad).alias("bad"), *[F.sum(w * F.col(f"z{i}")).alias(f"m{i}") for i in range(k)]).first()
    _check(first)
    sw = float(first["sw"])
    mean = np.array([first[f"m{i}"] / sw for i in range(k)])
    if k <= JVM_TERMS:
        c = [F.col(f"z{i}") - F.lit(float(mean[i])) for i in range(k)]
        sums = z.agg(*[F.sum(w * c[i] * c[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        s = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                s[i, j] = s[j, i] = sums[f"s{i}_{j}"]
    else:
        s = _wide(z, k, mean)
    return Gram(names, int(first["n"]), sw, mean, s)


def _wide(z: DataFrame, k: int, mean: np.ndarray) -> np.ndarray:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.zeros((k, k))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)]) - mean
            s += (x * b.column(k).to_numpy(zero_copy_only=False)[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(s.ravel())], names=["i", "s"])

    rows = z.mapInArrow(kernel, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(k * k)
    for r in rows:
        out[r["i"]] = r["s"]
    return out.reshape(k, k)


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a x = b for a symmetric positive definite matrix, scaled to unit diagonal first."""
    d = np.sqrt(np.clip(np.diag(a), 0, None))
    if (d <= 0).any():
        raise SingularMatrix("a column is constant zero")
    r = a / np.outer(d, d)
    if np.linalg.eigvalsh(r)[0] < 1e-12:
        raise SingularMatrix("columns are linearly dependent")
    x = np.linalg.solve(r, (b.T / d).T)
    return (x.T / d).T


def inverse_spd(a: np.ndarray) -> np.ndarray:
    return solve_spd(a, np.eye(len(a)))


def independent_columns(a: np.ndarray, tol: float = 1e-10) -> list[int]:
    """Indices of columns kept by a left-to-right Cholesky of the scaled Gram; later dependent ones are omitted."""
    d = np.sqrt(np.clip(np.diag(a), 0, None))
    kept: list[int] = []
    for j in range(len(a)):
        if d[j] <= 0:
            continue
        if kept:
            r = a[np.ix_(kept, kept)] / np.outer(d[kept], d[kept])
            c = a[kept, j] / (d[kept] * d[j])
            if 1 - c @ np.linalg.solve(r, c) <= tol:
                continue
        kept.append(j)
    return kept


def grouped_sums(df: DataFrame, keys: Sequence[str], exprs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*[col(c) for c in keys]).agg(*[F.sum(e).alias(n) for n, e in exprs.items()])


def linear(beta: np.ndarray, exprs: Sequence[Column]) -> Column:
    """Sum of coefficient literals times expressions."""
    out = F.lit(0.0)
    for b, e in zip(beta, exprs, strict=True):
        out = out + F.lit(float(b)) * e
    return out


def quadratic(m: np.ndarray, exprs: Sequence[Column]) -> Column:
    """x' m x with literals."""
    out = F.lit(0.0)
    for i, a in enumerate(exprs):
        inner = F.lit(0.0)
        for j, b in enumerate(exprs):
            if j >= i:
                inner = inner + F.lit(float(m[i, j] * (1 if i == j else 2))) * b
        out = out + a * inner
    return out


def outer_sum(df: DataFrame, exprs: Sequence[Column], weight: Column) -> np.ndarray:
    """Sum of weight * x x'."""
    k = len(exprs)
    z = df.select(*[e.cast("double").alias(f"z{i}") for i, e in enumerate(exprs)], weight.cast("double").alias("w"))
    if k > JVM_TERMS:
        return _wide(z, k, np.zeros(k))
    r = z.agg(*[F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            s[i, j] = s[j, i] = r[f"s{i}_{j}"]
    return s

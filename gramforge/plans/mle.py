"""Distributed maximum likelihood: per Arrow batch, numpy adds the log-likelihood, scores and the Hessian (central
differences of the scores); Newton steps with halving run on p-sized matrices on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation, OptimizationFailed
from gramforge.util import checkpoint

#: Maps (parameters, matrix of the projected columns) to (log-likelihood per row, scores per row and parameter).
Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def numeric_scores(loglik: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Kernel:
    """A kernel from row log-likelihoods alone, by central differences."""

    def kernel(b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.empty((len(m), len(b)))
        for i in range(len(b)):
            h = np.zeros(len(b))
            h[i] = 1e-5 * max(1.0, abs(b[i]))
            s[:, i] = (loglik(b + h, m) - loglik(b - h, m)) / (2 * h[i])
        return loglik(b, m), s

    return kernel


def project(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """The model's columns as doubles, cut from lineage as every iteration reads them. Missing values are an error."""
    z = checkpoint(df.select(*[c.cast("double").alias(f"z{i}") for i, c in enumerate(columns)]))
    bad = None
    for c in z.columns:
        b = F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        bad = b if bad is None else bad | b
    r = z.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    if not r["n"] or r["bad"]:
        raise InvalidOperation("no rows" if not r["n"] else f"{r['bad']} rows hold NULL, NaN or infinite values")
    return z


def batch_sums(z: DataFrame, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all Arrow batches of a vector of `size` numbers; only one vector per task is shuffled."""

    def kernel(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += add(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "s"])

    out = np.zeros(size)
    for r in z.mapInArrow(kernel, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"]
    return out


def derivatives(z: DataFrame, b: np.ndarray, kernel: Kernel) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, int]:
    """(log-likelihood, gradient, Hessian, outer product of scores, rows) in one pass."""
    p = len(b)

    def add(m: np.ndarray) -> np.ndarray:
        ll, s = kernel(b, m)
        hess = np.empty((p, p))
        for i in range(p):
            h = np.zeros(p)
            h[i] = 1e-5 * max(1.0, abs(b[i]))
            hess[i] = (kernel(b + h, m)[1].sum(axis=0) - kernel(b - h, m)[1].sum(axis=0)) / (2 * h[i])
        return np.concatenate([[ll.sum(), len(m)], s.sum(axis=0), hess.ravel(), (s.T @ s).ravel()])

    v = batch_sums(z, 2 + p + 2 * p * p, add)
    h = v[2 + p : 2 + p + p * p].reshape(p, p)
    return float(v[0]), v[2 : 2 + p], (h + h.T) / 2, v[2 + p + p * p :].reshape(p, p), int(v[1])


def maximise(z: DataFrame, start: Sequence[float], kernel: Kernel, *, tol: float = 1e-7, max_iter: int = 100) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, int]:
    """(parameters, log-likelihood, Hessian, outer product of scores, rows) at the maximum."""
    b = np.array(start, float)
    ll, g, h, op, n = derivatives(z, b, kernel)
    for _ in range(max_iter):
        # The squared length of the gradient in the metric of the Hessian is twice the gain still to be had.
        if np.linalg.eigvalsh(-h)[0] > 0 and g @ np.linalg.solve(-h, g) <= tol * 1e-2:
            break
        vals, vecs = np.linalg.eigh(-h)
        floor = max(1e-10, 1e-9 * abs(vals).max())
        step = vecs @ ((vecs.T @ g) / np.maximum(np.abs(vals), floor))
        # The full step is mostly accepted, so it is tried with its derivatives; halved steps with the likelihood alone.
        cand = derivatives(z, b + step, kernel)
        if not (np.isfinite(cand[0]) and cand[0] >= ll - 1e-12 * abs(ll)):
            for _ in range(40):
                step = step / 2
                at = b + step
                value = batch_sums(z, 1, lambda m: np.array([kernel(at, m)[0].sum()]))[0]  # noqa: B023
                if np.isfinite(value) and value >= ll - 1e-12 * abs(ll):
                    break
            else:
                break
            cand = derivatives(z, b + step, kernel)
        b = b + step
        gain = cand[0] - ll
        ll, g, h, op, n = cand
        if gain <= tol * (1 + abs(ll)) * 1e-3 and np.max(np.abs(step)) <= tol * 100 * (1 + np.max(np.abs(b))):
            break
    else:
        raise OptimizationFailed(f"no convergence in {max_iter} iterations")
    return b, ll, h, op, n

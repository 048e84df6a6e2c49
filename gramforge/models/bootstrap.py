"""The pairs bootstrap of a regression in one pass: every row weighs Poisson(1) times in every replicate."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.formula import Formula
from gramforge.plans.mle import batch_sums
from gramforge.plans.moments import solve_spd

#: Distribution function of Poisson(1) at 0, 1, ...; counts above 12 have a chance under 1e-10.
_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])
_MOST_CELLS = 20_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words (finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs_bootstrap(df: DataFrame, formula: str, replicates: int = 200, *, seed: int = 0) -> tuple[list[str], np.ndarray]:
    """(terms, replicates x terms): least-squares coefficients under resampled rows.

    Weights are drawn from a hash of the row's number in the scan and the seed, so an unchanged scan gives the same
    replicates. Rows with missing values are an error of the solve, as in a fit. A task keeps replicates x terms^2 sums;
    more than 20 million of them are an error.
    """
    y, x = Formula.parse(formula).design(df)
    k, r = len(x), replicates
    if r < 1 or r * (k * k + k) > _MOST_CELLS:
        raise InvalidOperation("too many replicates for so many terms")
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(2**52))
    z = df.select(*[e.cast("double") for e in x.values()], y.cast("double"), row.cast("double"))
    z = z.toDF(*[f"z{i}" for i in range(k + 2)])
    steps = _mix(np.arange(1, r + 1, dtype=np.uint64) + np.uint64(seed % 2**32) * np.uint64(1 << 32))

    def add(m: np.ndarray) -> np.ndarray:
        out = np.zeros((r, k * k + k))
        for at in range(0, len(m), 2048):
            p = m[at : at + 2048]
            u = (_mix(p[:, k + 1].astype(np.uint64)[:, None] ^ steps[None, :]) >> np.uint64(11)).astype(float) / 2**53
            w = np.searchsorted(_CDF, u).astype(float)
            cross = (p[:, :k, None] * p[:, None, : k + 1]).reshape(len(p), -1)
            out += w.T @ np.hstack([cross.reshape(len(p), k, k + 1)[:, :, :k].reshape(len(p), -1), cross.reshape(len(p), k, k + 1)[:, :, k]])
        return out.ravel()

    s = batch_sums(z, r * (k * k + k), add).reshape(r, -1)
    return list(x), np.array([solve_spd(a[: k * k].reshape(k, k), a[k * k :]) for a in s])


def bootstrap_se(draws: np.ndarray) -> np.ndarray:
    return draws.std(axis=0, ddof=1)


def percentile_ci(draws: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    return np.quantile(draws, 0.5 - level / 2, axis=0), np.quantile(draws, 0.5 + level / 2, axis=0)

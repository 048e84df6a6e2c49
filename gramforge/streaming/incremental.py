"""Incremental regression over a stream: Gram matrices of micro-batches are added to a running table. An addition of this engine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.models.results import Fit
from gramforge.util import col


def batch_moments(df: DataFrame, y: str, x: Sequence[str]) -> DataFrame:
    """One row per pair of columns of (1, x..., y): sums that add over batches, days or files."""
    z = [F.lit(1.0), *[col(c).cast("double") for c in x], col(y).cast("double")]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (z[i] * z[j]).alias("v")) for i in range(len(z)) for j in range(i, len(z))]
    return df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.v").alias("v"))


def fit_moments(moments: DataFrame, x: Sequence[str]) -> Fit:
    """Least squares from the sum of any number of moment tables."""
    k = len(x) + 1
    g = np.zeros((k + 1, k + 1))
    for r in moments.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["v"]
    b = np.linalg.solve(g[:k, :k], g[:k, k])
    n = int(round(g[0, 0]))
    s2 = (g[k, k] - b @ g[:k, k]) / (n - k)
    return Fit(["const", *x], b, s2 * np.linalg.inv(g[:k, :k]), n - k, {"n": n})


def stream_moments(stream: DataFrame, y: str, x: Sequence[str], path: str, checkpoint_dir: str):
    """Start a query that appends every micro-batch's moments, with its number, to a Parquet table.

    A batch that is replayed after a failure overwrites its own folder, so it is counted once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch_moments(batch, y, x).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(write).start()


def windowed_means(stream: DataFrame, time: str, value: str, window: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Tumbling means with a watermark; rows later than `late` are left to a batch run."""
    return stream.withWatermark(time, late).groupBy(F.window(col(time), window), *[col(k) for k in keys]).agg(F.avg(col(value)).alias("mean"), F.count(F.lit(1)).alias("n"))

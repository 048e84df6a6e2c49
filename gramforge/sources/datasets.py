"""Small simulated data sets for trying out estimators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from gramforge.frame import Frame


def simulated_linear(spark: SparkSession, n: int = 200, seed: int = 0) -> Frame:
    """y = 1 + 2 x1 + 0.5 x2 + noise."""
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    return Frame(spark.createDataFrame(pd.DataFrame({"row_no": range(n), "x1": x1, "x2": x2, "y": 1 + 2 * x1 + 0.5 * x2 + rng.normal(size=n)})), ["row_no"])


def simulated_panel(spark: SparkSession, entities: int = 20, periods: int = 10, seed: int = 0) -> Frame:
    """y = a_i + 1.5 x + noise."""
    rng = np.random.default_rng(seed)
    e, t = np.repeat(np.arange(entities), periods), np.tile(np.arange(periods), entities)
    x = rng.normal(size=len(e))
    y = rng.normal(size=entities)[e] * 2 + 1.5 * x + rng.normal(size=len(e)) * 0.5
    return Frame(spark.createDataFrame(pd.DataFrame({"entity": e, "time": t, "x": x, "y": y})), ["entity", "time"])


#: The Longley data of 1967, in the order of LONGLEY_COLUMNS.
LONGLEY_COLUMNS = ("gnp_deflator", "gnp", "unemployed", "armed_forces", "population", "year", "employed")
LONGLEY = (
    (83.0, 234.289, 235.6, 159.0, 107.608, 1947, 60.323),
    (88.5, 259.426, 232.5, 145.6, 108.632, 1948, 61.122),
    (88.2, 258.054, 368.2, 161.6, 109.773, 1949, 60.171),
    (89.5, 284.599, 335.1, 165.0, 110.929, 1950, 61.187),
    (96.2, 328.975, 209.9, 309.9, 112.075, 1951, 63.221),
    (98.1, 346.999, 193.2, 359.4, 113.270, 1952, 63.639),
    (99.0, 365.385, 187.0, 354.7, 115.094, 1953, 64.989),
    (100.0, 363.112, 357.8, 335.0, 116.219, 1954, 63.761),
    (101.2, 397.469, 290.4, 304.8, 117.388, 1955, 66.019),
    (104.6, 419.180, 282.2, 285.7, 118.734, 1956, 67.857),
    (108.4, 442.769, 293.6, 279.8, 120.445, 1957, 68.169),
    (110.8, 444.546, 468.1, 263.7, 121.950, 1958, 66.513),
    (112.6, 482.704, 381.3, 255.2, 123.366, 1959, 68.655),
    (114.2, 502.601, 393.1, 251.4, 125.368, 1960, 69.564),
    (115.7, 518.173, 480.6, 257.2, 127.852, 1961, 69.331),
    (116.9, 554.894, 400.7, 282.7, 130.081, 1962, 70.551),
)
#: Brownlee's stack loss data, in the order of STACKLOSS_COLUMNS.
STACKLOSS_COLUMNS = ("air_flow", "water_temp", "acid_conc", "stackloss")
STACKLOSS = (
    (80, 27, 89, 42), (80, 27, 88, 37), (75, 25, 90, 37), (62, 24, 87, 28), (62, 22, 87, 18), (62, 23, 87, 18), (62, 24, 93, 19),
    (62, 24, 93, 20), (58, 23, 87, 15), (58, 18, 80, 14), (58, 18, 89, 14), (58, 17, 88, 13), (58, 18, 82, 11), (58, 19, 93, 12),
    (50, 18, 89, 8), (50, 18, 86, 7), (50, 19, 72, 8), (50, 19, 79, 8), (50, 20, 80, 9), (56, 20, 82, 15), (70, 20, 91, 15),
)


def _table(spark: SparkSession, names: tuple, rows: tuple) -> Frame:
    return Frame.new(spark, {n: [float(r[i]) for r in rows] for i, n in enumerate(names)})


def longley(spark: SparkSession) -> Frame:
    """Employment in the United States 1947 to 1962: nearly collinear regressors."""
    return _table(spark, LONGLEY_COLUMNS, LONGLEY)


def stackloss(spark: SparkSession) -> Frame:
    """Oxidation of ammonia over 21 days: a regression with outliers."""
    return _table(spark, STACKLOSS_COLUMNS, STACKLOSS)

"""Estimators try every candidate and read every row, column and level: compared with brute force where a part would give another result."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from gramforge.errors import InvalidOperation
from gramforge.models import glm, learn, panel, timeseries
from gramforge.queries import estimators


def test_setar_tries_every_value(spark):
    rng = np.random.default_rng(3)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = (0.8 * y[t - 1] + 1 if y[t - 1] <= 0.37 else -0.4 * y[t - 1]) + rng.normal()
    y = 1000 + y.round(2)
    got = timeseries.setar(spark.createDataFrame(pd.DataFrame({"t": range(400), "y": y})).repartition(4), "y", 2, 1, ["t"])
    x, z = np.column_stack([np.ones(398), y[1:-1], y[:-2]]), y[2:]
    q, cut = x[:, 1], 398 * 15 // 100
    best = (np.inf,)
    for c in np.sort(q)[cut : 398 - cut]:
        fits = [np.linalg.lstsq(x[m], z[m], rcond=None)[0] for m in (q <= c, q > c)]
        ssr = sum(((z[m] - x[m] @ b) ** 2).sum() for m, b in zip((q <= c, q > c), fits))
        if ssr < best[0]:
            best = (ssr, c, *fits)
    assert got["ssr"] == pytest.approx(best[0], rel=1e-9) and got["threshold"] == best[1] and got["n"] == 398
    assert got["low"] == pytest.approx(best[2], rel=1e-5) and got["high"] == pytest.approx(best[3], rel=1e-5)


def _panel_threshold(p, trim=0.15):
    v = np.unique(p["q"])
    cut = int(np.ceil(len(v) * trim))
    c = v[cut : len(v) - cut]
    out = []
    for g in c[:: len(c) // 100 if len(c) > 300 else 1]:
        low = (p["q"] <= g).astype(float)
        z = pd.DataFrame({"a": p["x1"] * low, "b": p["x2"] * low, "c": p["x1"] * (1 - low), "d": p["x2"] * (1 - low), "y": p["y"]})
        z = (z - z.groupby(p["g"]).transform("mean")).to_numpy()
        b = np.linalg.lstsq(z[:, :4], z[:, 4], rcond=None)[0]
        out.append((((z[:, 4] - z[:, :4] @ b) ** 2).sum(), g, b))
    return min(out, key=lambda e: e[:2])


@pytest.mark.parametrize("values", [80, 700])
def test_panel_threshold_tries_the_candidates_of_the_reference(spark, values):
    rng = np.random.default_rng(values)
    n = 1500
    p = pd.DataFrame({"g": np.repeat(np.arange(100), 15), "x1": rng.normal(size=n), "x2": rng.uniform(1, 3, n), "q": rng.integers(0, values, n)})
    p["y"] = p["g"] * 0.1 + p["x1"] * np.where(p["q"] <= 0.63 * values, 1.0, 1.6) + rng.normal(size=n)
    got = panel.panel_threshold(spark.createDataFrame(p).repartition(4), "y", ["x1", "x2"], "q", "g")
    ssr, c, b = _panel_threshold(p)
    assert got["threshold"] == c and got["ssr"] == pytest.approx(ssr, rel=1e-9)
    assert [got[k] for k in ("x1_low", "x2_low", "x1_high", "x2_high")] == pytest.approx(b, rel=1e-7)


@pytest.fixture(scope="module")
def vectors(sf):
    return duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by vec_id").df()


def test_kmeans_query_uses_every_entry(spark, sf, vectors):
    x = np.array(vectors["embedding"].tolist(), float)
    got = estimators.kmeans(spark, sf).orderBy("vec_id").toPandas()["cluster"].to_numpy()
    centres = np.array([x[got == c].mean(0) for c in range(4)])
    d = ((x[:, None] - centres[None]) ** 2).sum(-1)
    # At the end of Lloyd's iterations every vector is with the nearest mean.
    assert (d[np.arange(len(x)), got] <= d.min(1) + 1e-9).all()


def test_kmeans_keeps_the_best_of_all_restarts(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.05, (30, 2)) for c in ((0, 0), (0, 1), (5, 0), (5, 1), (9, 9))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).repartition(4)
    one = [learn.kmeans(df, ["a", "b"], 5, restarts=1, seed=s).inertia for s in range(10)]
    assert learn.kmeans(df, ["a", "b"], 5).inertia == pytest.approx(min(one), rel=1e-9)


def _dbscan(x, eps, least):
    """(core, component of core points, allowed components of each border point) by all pairs."""
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    for _ in x:
        label = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), len(x))
    return [label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=None) for i in range(len(x))]


@pytest.mark.parametrize(("p", "eps"), [(1, 0.05), (3, 0.4), (64, 1.3)])
def test_dbscan_in_any_number_of_columns(spark, p, eps):
    rng = np.random.default_rng(p)
    x = np.vstack([rng.normal(c, 0.11, (50, p)) for c in (0, 1)] + [rng.uniform(-1, 2, (60, p))])
    names = [f"v{i}" for i in range(p)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(len(x)))).repartition(4)
    got = {r["id"]: r["cluster"] for r in learn.dbscan(df, "id", names, eps, 5).collect()}
    want = _dbscan(x, eps, 5)
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 2


def test_learning_queries_pass_whole_vectors_and_defaults(spark, sf, monkeypatch):
    seen = {}
    for name in ("dbscan", "random_forest"):
        monkeypatch.setattr(learn, name, lambda df, *a, _name=name, **kw: seen.update({_name: (a, kw)}) or learn.Trees)
    monkeypatch.setattr(learn.Trees, "predict", lambda x: x.withColumn("prediction", x["x0"]))
    estimators.dbscan(spark, sf)
    estimators.random_forest(spark, sf)
    whole = [f"x{i}" for i in range(64)]
    assert seen["dbscan"][0][1] == whole and seen["random_forest"] == (("x0", whole[1:]), {})


@pytest.mark.parametrize("fit", [glm.ordered_logit, glm.ordered_probit, glm.multinomial_logit])
def test_responses_with_too_many_or_missing_levels_are_errors(spark, fit):
    many = spark.range(1001).selectExpr("cast(id as double) as y", "cast(id % 7 as double) as x")
    with pytest.raises(InvalidOperation, match="levels"):
        fit(many, "y ~ x")
    with pytest.raises(InvalidOperation, match="NULL"):
        fit(spark.range(40).selectExpr("if(id = 3, null, cast(id % 3 as double)) as y", "cast(id % 7 as double) as x"), "y ~ x")


def test_pcse_is_beck_and_katz(spark):
    rng = np.random.default_rng(6)
    n, t = 12, 9
    p = pd.DataFrame({"g": np.repeat(np.arange(n), t), "t": np.tile(np.arange(t), n), "x1": rng.normal(size=n * t), "x2": rng.uniform(0, 3, n * t)})
    p["y"] = 1 + p["x1"] - p["x2"] + rng.normal(size=t)[p["t"]] * (1 + p["g"] / 5) + rng.normal(size=n * t)
    df = spark.createDataFrame(p).repartition(4)
    fit = panel.pcse(df, "y", ["x1", "x2"], "g", "t")
    x = np.column_stack([np.ones(n * t), p["x1"], p["x2"]])
    inv = np.linalg.inv(x.T @ x)
    e, xs = (p["y"].to_numpy() - x @ (inv @ x.T @ p["y"].to_numpy())).reshape(n, t), x.reshape(n, t, 3)
    meat = sum((e[i] @ e[j] / t) * xs[i].T @ xs[j] for i in range(n) for j in range(n))
    assert fit.cov == pytest.approx(inv @ meat @ inv, rel=1e-8)
    with pytest.raises(InvalidOperation, match="unbalanced"):
        panel.pcse(df.where("g <> 3 or t <> 4"), "y", ["x1", "x2"], "g", "t")


def test_dynamic_panel_queries_keep_every_customer(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(estimators, "_fit", lambda spark, fit, digits: fit)
    for name in ("arellano_bond", "system_gmm"):
        monkeypatch.setattr(panel, name, lambda df, *a, **kw: seen.append((df.select("unit").distinct().count(), kw)))
        getattr(estimators, name)(spark, sf)
    customers = duckdb.sql(f"select count(distinct o_custkey) from '{sf}/orders.parquet'").fetchall()[0][0]
    assert seen == [(customers, {})] * 2
    # sf0.001 has fewer customers than 400: more of them here.
    wide = spark.createDataFrame([(401 * k, d, 1.0) for k in range(900) for d in pd.to_datetime(["1995-01-01", "1996-01-01"]).date], "o_custkey long, o_orderdate date, o_totalprice double")
    monkeypatch.setattr(estimators, "read_table", lambda *a: wide)
    assert estimators._yearly(spark, sf).count() == 1800


def test_dynamic_panel_over_the_period_bound_is_an_error(spark):
    df = spark.range(402).selectExpr("id % 2 as g", "cast(id / 2 as int) as t", "rand(1) as y", "rand(2) as x")
    with pytest.raises(InvalidOperation, match="periods"):
        panel.arellano_bond(df, "y", ["x"], "g", "t")

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gramforge import dist
from gramforge.errors import FormulaError, InvalidOperation, ShapeMismatch, SingularMatrix
from gramforge.formula import Formula
from gramforge.frame import Frame
from gramforge.models import bayes, causal, glm, imputation, learn, linear, multivariate, panel, series, spatial, stats, survival, timeseries
from gramforge.operators.ordered import Ordered
from gramforge.sources.csv import InferenceConfig, from_csv, to_csv
from gramforge.sources.json import from_json, to_json, to_json_columns
from gramforge.streaming.incremental import batch_moments, fit_moments


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 600
    g, t = np.repeat(np.arange(60), 10), np.tile(np.arange(10), 60)
    x1, x2 = rng.normal(size=n), rng.uniform(0, 5, n)
    a = rng.normal(size=60)[g]
    y = 1 + 2 * x1 - 0.7 * x2 + a + rng.normal(size=n)
    b = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x1)))).astype(float)
    c = rng.poisson(np.exp(0.2 + 0.4 * x1)).astype(float)
    pdf = pd.DataFrame({"i": range(n), "g": g, "t": t, "x1": x1, "x2": x2, "y": y, "b": b, "c": c, "w": rng.uniform(1, 2, n), "k": np.where(x2 < 2, "lo", "hi")})
    df = spark.createDataFrame(pdf).repartition(4).cache()
    df.count()
    return df, pdf


def design(pdf, *names):
    return np.column_stack([np.ones(len(pdf)), *[pdf[n] for n in names]])


def test_distributions():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert dist.chi2_ppf(0.95, 3) == pytest.approx(7.814727903, abs=1e-7)
    assert dist.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    x = np.array([0.01, 0.5, 1.0, 3.7, 9.0, 150.0])
    assert dist.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
    assert float(dist.digamma(1.0)) == pytest.approx(-0.5772156649, abs=1e-9)


def test_formula(spark, data):
    df, _ = data
    assert Formula.parse("y ~ x1*x2 + C(k) + I(x1^2) + log(w) - 1").names(df) == ["x1", "x2", "x1:x2", "k=lo", "I(x1^2)", "log(w)"]
    assert Formula.parse("y ~ poly(x1, 2) + I(x2**3)").names(df) == ["const", "poly(x1, 1)", "poly(x1, 2)", "I(x2^3)"]
    basis = Frame(df).to_design_matrix("y ~ bs(x2, df=5) - 1").drop("y").toPandas().to_numpy()
    assert basis.shape == (600, 5) and basis.sum(axis=1) == pytest.approx(np.ones(600))
    for bad in ("", "y", "y ~", "y ~ x1 +", "y ~ f(x1)", "y ~ 3", "y ~ x1 - x2"):
        with pytest.raises(FormulaError):
            Formula.parse(bad)


def test_ols_invariants(data):
    df, pdf = data
    fit = linear.ols(df, "y ~ x1 + x2", linear.Cov("HC3"))
    x, y = design(pdf, "x1", "x2"), pdf["y"].to_numpy()
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit.params == pytest.approx(b, rel=1e-9)
    e = df.select((F.col("y") - fit.predictor()).alias("e"), "x1").agg(F.sum("e"), F.sum(F.col("e") * F.col("x1"))).first()
    assert abs(e[0]) < 1e-7 and abs(e[1]) < 1e-7
    inv = np.linalg.inv(x.T @ x)
    u, h = y - x @ b, np.einsum("ij,jk,ik->i", x, inv, x)
    assert fit.cov == pytest.approx(inv @ (x.T * (u / (1 - h)) ** 2) @ x @ inv, rel=1e-8)
    with pytest.raises(SingularMatrix):
        linear.ols(df.withColumn("z", F.col("x1") * 2), "y ~ x1 + z")
    assert linear.ols(df.withColumn("z", F.col("x1") * 2), "y ~ x1 + z", drop_collinear=True).names == ["const", "x1"]
    with pytest.raises(ShapeMismatch):
        linear.ols(df.limit(2), "y ~ x1 + x2")
    with pytest.raises(InvalidOperation):
        linear.ols(df.withColumn("x1", F.when(F.col("i") > 3, F.col("x1"))), "y ~ x1")


def test_wide_gram_equals_narrow(data):
    df, pdf = data
    f = "y ~ poly(x1, 7) + poly(x2, 7)"
    x = np.column_stack([np.ones(600), *[pdf["x1"] ** p for p in range(1, 8)], *[pdf["x2"] ** p for p in range(1, 8)]])
    assert linear.ols(df, f).stats["ssr"] == pytest.approx(float(np.square(pdf["y"] - x @ np.linalg.lstsq(x, pdf["y"], rcond=None)[0]).sum()), rel=1e-6)


def test_glm_scores_vanish(data):
    df, pdf = data
    x = design(pdf, "x1", "x2")
    p = glm.logit(df, "b ~ x1 + x2").params
    assert x.T @ (pdf["b"] - 1 / (1 + np.exp(-x @ p))) == pytest.approx(np.zeros(3), abs=1e-5)
    p = glm.poisson(df, "c ~ x1 + x2").params
    assert x.T @ (pdf["c"] - np.exp(x @ p)) == pytest.approx(np.zeros(3), abs=1e-5)
    q = glm.probit(df, "b ~ x1").params
    e = design(pdf, "x1") @ q
    s = dist.norm_pdf(e) * (pdf["b"] - dist.norm_cdf(e)) / (dist.norm_cdf(e) * dist.norm_cdf(-e))
    assert design(pdf, "x1").T @ s == pytest.approx(np.zeros(2), abs=1e-3)


def test_ordered_multinomial_and_binary_agree(data):
    df, _ = data
    b = glm.logit(df, "b ~ x1").params
    o = glm.ordered_logit(df, "b ~ x1").params
    m = glm.multinomial_logit(df, "b ~ x1").params
    assert m == pytest.approx(b, abs=1e-4) and [-o[1], o[0]] == pytest.approx(b, abs=1e-4)


def test_conditional_and_gee(data):
    df, pdf = data
    fit = glm.gee(df, "y ~ x1 + x2", "g")
    assert fit.params[1:] == pytest.approx([2, -0.7], abs=0.12) and 0.3 < fit.stats["alpha"] < 0.7
    cp = glm.conditional_poisson(df, "c", ["x1"], "g")
    assert cp.params[0] == pytest.approx(0.4, abs=0.12)


def test_robust_and_quantile(data):
    df, pdf = data
    q = linear.quantile_regression(df, "y ~ x1", 0.25)
    x = design(pdf, "x1")
    u = pdf["y"] - x @ q.params
    assert (u < 0).mean() == pytest.approx(0.25, abs=0.01)
    loss = lambda b: float(((pdf["y"] - x @ b) * (0.25 - ((pdf["y"] - x @ b) < 0))).sum())
    assert all(loss(q.params) <= loss(q.params + d) + 1e-3 for d in ([0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]))
    dirty = df.withColumn("y", F.when(F.col("i") < 20, 500.0).otherwise(F.col("y")))
    assert linear.robust_regression(dirty, "y ~ x1 + x2", "bisquare").params[1:] == pytest.approx([2, -0.7], abs=0.2)


def test_systems_and_paths(data):
    df, pdf = data
    fits = linear.sur(df, ["y ~ x1 + x2", "c ~ x1 + x2"])
    assert fits[0].params == pytest.approx(linear.ols(df, "y ~ x1 + x2").params, rel=1e-6)
    assert linear.lasso(df, "y ~ x1 + x2", 0.0) == pytest.approx(linear.ols(df, "y ~ x1 + x2").params, rel=1e-5)
    assert linear.lasso(df, "y ~ x1 + x2", 100.0)[1:] == pytest.approx([0, 0])
    r = linear.rolling_ols(df, "y", ["x1"], 50, ["i"]).toPandas().sort_values("i")
    tail = pdf.tail(50)
    assert r.iloc[-1][["b_const", "b_x1"]].to_list() == pytest.approx(np.linalg.lstsq(design(tail, "x1"), tail["y"], rcond=None)[0], rel=1e-6)
    n = linear.nls(df, "y", ["x1"], lambda b, m: b[0] + b[1] * m[:, 0], [0.0, 0.0])
    assert n.params == pytest.approx(linear.ols(df, "y ~ x1").params, rel=1e-5)


def test_panel(spark, data):
    df, pdf = data
    fe = panel.fixed_effects(df, "y", ["x1", "x2"], "g")
    w = pdf[["y", "x1", "x2"]] - pdf.groupby("g")[["y", "x1", "x2"]].transform("mean")
    assert fe.params == pytest.approx(np.linalg.lstsq(w[["x1", "x2"]], w["y"], rcond=None)[0], rel=1e-8)
    re = panel.random_effects(df, "y", ["x1", "x2"], "g")
    assert re.params[1:] == pytest.approx([2, -0.7], abs=0.12)
    assert panel.hausman(fe, re)[1] > 0.001
    small = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 7.0), (2, 3.0, 11.0), (2, 4.0, 13.0), (3, 1.0, 2.0), (3, 2.0, 4.0)], "g int, x double, y double")
    exact = panel.fixed_effects(small, "y", ["x"], "g")
    assert exact.params == pytest.approx([2.0]) and exact.df_resid == 2
    p = pdf.pivot(index="t", columns="g", values="y").corr().to_numpy()
    n = len(p)
    assert panel.pesaran_cd(df, "y", "g", "t")[0] == pytest.approx(math.sqrt(2 / (n * (n - 1))) * math.sqrt(10) * p[np.triu_indices(n, 1)].sum(), rel=1e-6)


def difference_gmm(y, x):
    """One-step difference GMM written out for a balanced panel."""
    n, t = y.shape
    cells = [(p, q) for p in range(2, t) for q in range(p - 1)]
    zhz, zw, zy = 0, 0, 0
    h = 2 * np.eye(t - 2) - np.eye(t - 2, k=1) - np.eye(t - 2, k=-1)
    dy, dx = np.diff(y), np.diff(x)
    for i in range(n):
        z = np.zeros((t - 2, len(cells) + 1))
        for c, (p, q) in enumerate(cells):
            z[p - 2, c] = y[i, q]
        z[:, -1] = dx[i, 1:]
        w = np.column_stack([dy[i, :-1], dx[i, 1:]])
        zhz, zw, zy = zhz + z.T @ h @ z, zw + z.T @ w, zy + z.T @ dy[i, 1:]
    a = np.linalg.pinv(zhz)
    return np.linalg.solve(zw.T @ a @ zw, zw.T @ a @ zy)


def test_dynamic_panel(spark):
    rng = np.random.default_rng(2)
    a, x = rng.normal(size=300), rng.normal(size=(300, 27))
    y = np.zeros((300, 27))
    for t in range(1, 27):
        y[:, t] = 0.5 * y[:, t - 1] + x[:, t] + a + rng.normal(size=300)
    y, x = y[:, 20:], x[:, 20:]
    df = spark.createDataFrame([(i, t, float(y[i, t]), float(x[i, t])) for i in range(300) for t in range(7)], "i int, t int, y double, x double")
    assert panel.arellano_bond(df, "y", ["x"], "i", "t", two_step=False).params == pytest.approx(difference_gmm(y, x), rel=1e-6)
    assert panel.arellano_bond(df, "y", ["x"], "i", "t").params == pytest.approx([0.5, 1.0], abs=0.2)
    assert panel.system_gmm(df, "y", ["x"], "i", "t").params[:2] == pytest.approx([0.5, 1.0], abs=0.1)


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=(500, 2))
    y = np.zeros((500, 2))
    for t in range(1, 500):
        y[t] = np.array([[0.5, 0.2], [0.0, 0.4]]) @ y[t - 1] + e[t]
    pdf = pd.DataFrame({"t": range(500), "a": y[:, 0], "b": y[:, 1], "w": np.cumsum(e[:, 0])})
    return spark.createDataFrame(pdf).repartition(3), pdf


def test_time_series(walk):
    df, pdf = walk
    v = timeseries.VAR(df, ["a", "b"], 1, ["t"])
    assert v.coefs[0] == pytest.approx(np.array([[0.5, 0.2], [0.0, 0.4]]), abs=0.1) and v.is_stable()
    assert v.fevd(5).sum(axis=2) == pytest.approx(np.ones((5, 2)))
    assert timeseries.adf(df, "a", ["t"], 2)["statistic"] < -5 < timeseries.adf(df, "w", ["t"], 2)["statistic"]
    assert timeseries.phillips_perron(df, "a", ["t"])["statistic"] < -5
    assert timeseries.granger_causality(df, "a", "b", 1, ["t"])[1] < 0.01 < timeseries.granger_causality(df, "b", "a", 1, ["t"])[1]
    r = timeseries.acf(df, "a", 3, ["t"])
    z = pdf["a"] - pdf["a"].mean()
    assert r[2] == pytest.approx((z[2:].to_numpy() * z[:-2].to_numpy()).sum() / (z**2).sum(), rel=1e-9)
    j = timeseries.johansen(df, ["a", "b"], 1, ["t"])
    assert (j["eigenvalues"] >= 0).all() and j["trace"][0] > j["trace_5"][0]
    m = timeseries.modwt(df, "a", 2, ["t"]).orderBy("t").toPandas()
    assert (m["w1"] + m["v1"]).dropna().to_numpy() == pytest.approx(pdf["a"].to_numpy()[1:])


def test_series_kernels(spark, walk):
    df, pdf = walk
    y = pdf["a"].to_numpy()
    k = np.diff(np.eye(60), 2, axis=0)
    assert series.hp_filter(y[:60], 100)["trend"] == pytest.approx(np.linalg.solve(np.eye(60) + 100 * k.T @ k, y[:60]))
    out = series.per_series(df.withColumn("s", F.lit("x")), ["s"], ["t"], "a", lambda v: series.arima(v, 1, 0, 0), ["ar1", "forecast"]).first()
    assert out["ar1"] == pytest.approx(0.5, abs=0.15)
    with pytest.raises(InvalidOperation):
        series.per_series(df.withColumn("s", F.lit("x")), ["s"], ["t"], "a", lambda v: {}, [], max_rows=10)


def test_ordered_blocks(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 400).astype(float), "t": rng.permutation(400), "v": np.where(rng.uniform(size=400) < 0.3, np.nan, rng.normal(size=400))})
    pdf.loc[pdf["k"] == 2, "k"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("k", F.when(~F.isnan("k"), F.col("k").cast("int"))).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    o = Ordered(df, ["t"], ["k"], block_rows=7)
    s = pdf.assign(k=pdf["k"].fillna(9)).sort_values(["k", "t"])
    g = s.groupby("k")["v"]
    want = {"lag": g.shift(9), "ff": g.ffill(), "bf": g.bfill(), "sum": g.transform(lambda x: x.fillna(0).cumsum()), "max": g.transform(lambda x: x.cummax().ffill())}
    got = {"lag": (o.lag("v", 9), "v_lag_9"), "ff": (o.ffill("v"), "v"), "bf": (o.bfill("v"), "v"), "sum": (o.cumsum("v"), "v_cumsum"), "max": (o.cummax("v"), "v_cummax")}
    for name, (x, c) in got.items():
        r = x.toPandas().set_index("t")[c].reindex(s["t"]).to_numpy(float)
        w = want[name].to_numpy(float)
        r = np.where(np.isnan(r), 0, r) if name == "sum" else r
        assert r == pytest.approx(w, nan_ok=True), name


def test_survival(spark):
    km = survival.kaplan_meier(spark.createDataFrame([(float(i), 1) for i in range(1, 11)], "t double, e int"), "t", "e")
    assert [r["survival"] for r in km.orderBy("time").collect()] == pytest.approx([(9 - i) / 10 for i in range(10)], abs=1e-12)
    assert survival.median_survival(km).first()["median"] == 5.0
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    t = np.round(rng.exponential(np.exp(-0.7 * x)) * 20) + 1
    fit = survival.cox(spark.createDataFrame(pd.DataFrame({"t": t, "e": 1, "x": x})), "t", "e", ["x"])
    assert fit.params[0] == pytest.approx(0.7, abs=0.15)


def test_causal(spark, data):
    df, pdf = data
    rng = np.random.default_rng(9)
    x = rng.normal(size=2000)
    d = (rng.uniform(size=2000) < 1 / (1 + np.exp(-x))).astype(float)
    z = spark.createDataFrame(pd.DataFrame({"x": x, "d": d, "y": 1 + 0.5 * d + x + rng.normal(size=2000) * 0.3}))
    assert causal.ipw(z, "y", "d", ["x"])["ate"] == pytest.approx(0.5, abs=0.08)
    assert causal.double_ml(z, "y", "d", ["x"])["theta"] == pytest.approx(0.5, abs=0.08)
    assert causal.psm(z, "y", "d", ["x"])["att"] == pytest.approx(0.5, abs=0.12)
    r = spark.createDataFrame(pd.DataFrame({"x": x, "y": (x >= 0) * 2.0 + x + rng.normal(size=2000) * 0.1}))
    assert causal.regression_discontinuity(r, "y", "x", 0.0, 1.0)["effect"] == pytest.approx(2, abs=0.1)
    c = causal.conformal(z, "y ~ x + d", 0.1)
    assert 0.3 < c["half_width"] < 0.7
    rows = [(u, t, float(u + 0.3 * t + (2.0 if u % 2 and t >= 6 else 0.0)), int(bool(u % 2) and t >= 6)) for u in range(20) for t in range(12)]
    lp = {q["horizon"]: q["effect"] for q in causal.lp_did(spark.createDataFrame(rows, "u int, t int, y double, d int"), "y", "u", "t", "d", pre=3, post=3).collect()}
    assert lp[0] == pytest.approx(2.0) and lp[3] == pytest.approx(2.0) and lp[-2] == pytest.approx(0.0, abs=1e-9)
    sc = [(u, t, float(u * t)) for u in (1, 2, 3) for t in range(8)]
    assert causal.synthetic_control(spark.createDataFrame(sc, "u int, t int, y double"), "y", "u", "t", 2, 5)["effect"] == pytest.approx(0.0, abs=1e-3)


def test_statistics(spark, data):
    df, pdf = data
    assert stats.vif(df, ["x1", "x2"])["x1"] == pytest.approx(1 / (1 - np.corrcoef(pdf["x1"], pdf["x2"])[0, 1] ** 2))
    assert stats.shapiro_francia(df, "x1") > 0.98 and stats.omnibus(df, "x1")[1] > 0.001
    adj = stats.multipletests([0.01, 0.04, 0.03, 0.005], "holm")[1]
    assert adj == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert stats.multipletests([0.01, 0.04, 0.03, 0.005], "bh")[1] == pytest.approx([0.02, 0.04, 0.04, 0.02])
    lo, hi = stats.proportion_confint(8, 10)
    assert (lo, hi) == pytest.approx((0.4901625, 0.9433178), abs=1e-6)
    c = stats.central_moments_to_cumulants([2.0, 1.0, 14.0])
    assert c == pytest.approx([2.0, 1.0, 2.0]) and stats.cumulants_to_central_moments(c) == pytest.approx([2.0, 1.0, 14.0])
    s = df.withColumn("p", glm.logit(df, "b ~ x1").predictor())
    a = stats.auc(s, "b", "p")
    pos, neg = pdf[pdf.b == 1].x1.to_numpy(), pdf[pdf.b == 0].x1.to_numpy()
    assert a == pytest.approx((pos[:, None] > neg[None]).mean(), abs=1e-9)
    assert stats.hosmer_lemeshow(s, "b", "p")[1] > 1e-4


def test_multivariate_and_learning(spark, data):
    df, pdf = data
    p = multivariate.PCA.fit(df, ["x1", "x2", "y"])
    back = p.inverse_transform(p.transform(df)).select("x1", "x1_restored").toPandas()
    assert back["x1_restored"].to_numpy() == pytest.approx(back["x1"].to_numpy())
    assert p.values == pytest.approx(np.sort(np.linalg.eigvalsh(pdf[["x1", "x2", "y"]].corr()))[::-1])
    area = multivariate.kde(df, "x1", 200).orderBy("x").toPandas()
    assert np.trapezoid(area["density"], area["x"]) == pytest.approx(1, abs=0.01)
    iso = multivariate.isotonic(df, "y", "x1").orderBy("x_low").toPandas()["fitted"].to_numpy()
    assert (np.diff(iso) > 0).all()
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [[[10.0, 10.0]]])
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")
    km = learn.kmeans(q.where("id < 120"), ["a", "b"], 3)
    assert km.inertia < 120 * 0.05
    d = {r["id"]: r["cluster"] for r in learn.dbscan(q, "id", ["a", "b"], 0.5, 4).collect()}
    assert len({d[i] for i in range(120)}) == 3 and d[120] is None and d[0] == d[39] != d[40]
    comp = learn.connected_components(spark.createDataFrame([(i,) for i in range(8)], "id long"), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long"))
    assert {r["id"]: r["component"] for r in comp.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    h = learn.hierarchical(pts[:120], 3)
    assert len(set(h[:40])) == 1 and len(set(h)) == 3
    gm = learn.gaussian_mixture(q.where("id < 80"), ["a", "b"], 2)
    assert sorted(gm["means"][:, 0].round()) == [0, 3]


def test_bayes_spatial_imputation(spark, data):
    df, pdf = data
    assert bayes.bayesian_linear(df, "y ~ x1 + x2", prior_precision=1e-9).params == pytest.approx(linear.ols(df, "y ~ x1 + x2").params, rel=1e-4)
    mm = bayes.mixed_lm(df, "y ~ x1 + x2", "g")
    assert mm.params[1:] == pytest.approx([2, -0.7], abs=0.12) and 0.5 < mm.stats["sigma_u2"] < 2
    rng = np.random.default_rng(5)
    n = 80
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[i, (i - 1) % n] = 0.5
    x = rng.normal(size=n)
    y = np.linalg.solve(np.eye(n) - 0.6 * w, 1 + 2 * x + rng.normal(size=n) * 0.3)
    src = spark.createDataFrame(pd.DataFrame({"id": range(n), "x": x, "y": y}))
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "i long, j long, w double")
    fit = spatial.sar(src, edges, "id", "y", ["x"])
    assert fit.stats["rho"] == pytest.approx(0.6, abs=0.1) and fit.params[1] == pytest.approx(2, abs=0.15)
    gone = df.select("i", "x1", "y", F.when(F.col("i") % 5 > 0, F.col("x2")).alias("x2"))
    for full in (imputation.mice(gone, ["x1", "x2", "y"], imputations=1, rounds=2)[0], imputation.gaussian_mi(gone, ["x1", "x2", "y"])):
        assert full.where("x2 is null or isnan(x2)").count() == 0
        assert full.agg(F.avg("x2")).first()[0] == pytest.approx(pdf["x2"].mean(), abs=0.25)


def test_incremental_moments(spark, data):
    df, _ = data
    parts = batch_moments(df.where("i < 300"), "y", ["x1", "x2"]).unionByName(batch_moments(df.where("i >= 300"), "y", ["x1", "x2"]))
    assert fit_moments(parts, ["x1", "x2"]).params == pytest.approx(linear.ols(df, "y ~ x1 + x2").params)


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,f,b,s,d,c,n,w\n1,1.5,1,female,2020-01-02,x,NA,2.0\n2,NA,0,male,2020-02-03,x,,3.0\n3,2.5,1,male,2020-03-04,y,.,4\n4,9,1,male,2020-03-05,x,.,NA\n")
    f = from_csv(spark, str(tmp_path / "a.csv"))
    kinds = dict(f.df.dtypes)
    assert kinds == {"i": "bigint", "f": "double", "b": "boolean", "s": "boolean", "d": "timestamp_ntz", "c": "boolean", "n": "double", "w": "bigint"}
    assert f.df.where("s").count() == 3
    g = from_csv(spark, str(tmp_path / "a.csv"), columns=["i", "f"], predicate="i > 1", config=InferenceConfig(column_types={"i": "string"}))
    assert g.df.count() == 3 and g.df.dtypes[0] == ("i", "string")
    to_csv(f, str(tmp_path / "out"))
    assert from_csv(spark, str(tmp_path / "out")).df.count() == 4
    to_json(f, str(tmp_path / "j"))
    assert from_json(spark, str(tmp_path / "j"), lines=True).df.count() == 4
    (tmp_path / "c.json").write_text('{"a": [1, 2, 3], "b": ["x", null, "z"]}')
    h = from_json(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in h.df.orderBy("row_no").collect()] == [(0, 1, "x"), (1, 2, None), (2, 3, "z")]
    assert '"a"' in to_json_columns(h)


def test_frame_errors(spark):
    f = Frame.new(spark, {"a": [1.0, 2.0], "b": [3.0, 4.0]})
    with pytest.raises(KeyError):
        f.select("zz")
    with pytest.raises(ShapeMismatch):
        Frame.new(spark, {"a": [1], "b": [1, 2]})
    with pytest.raises(ShapeMismatch):
        f.merge(f, "row_no")
    with pytest.raises(InvalidOperation):
        Frame(f.df).lag("a")
    assert f.mean()["a"] == 1.5 and f.n_rows() == 2 and f.has_column("b") and "3 columns" in f.info()
    assert Frame.builder(spark).add_int("a", [1]).add_string("s", ["x"]).build().df.dtypes == [("a", "bigint"), ("s", "string")]


def test_more_panel_models(data):
    df, pdf = data
    assert panel.panel_gls(df, "y", ["x1", "x2"], "g").params[1:] == pytest.approx([2, -0.7], abs=0.15)
    assert panel.factor_panel(df, "y", ["x1", "x2"], "g", 2).stats["ssr"] == pytest.approx(panel.fixed_effects(df, "y", ["x1", "x2"], "g").stats["ssr"])
    bent = df.withColumn("y", F.col("y") + F.when(F.col("x2") > 2.5, 3 * F.col("x1")).otherwise(0.0))
    s = panel.pstr(bent, "y", ["x1"], "x2", "g", n_centres=5, slopes=(20.0,))
    assert s["x1_low"] == pytest.approx(2, abs=0.3) and s["x1_change"] == pytest.approx(3, abs=0.4) and abs(s["centre"] - 2.5) < 0.6
    t = panel.panel_threshold(bent, "y", ["x1"], "x2", "g", n_grid=9)
    assert t["x1_high"] - t["x1_low"] == pytest.approx(3, abs=0.5)


def test_more_series_models(walk):
    df, pdf = walk
    v = timeseries.tvar(df, ["a", "b"], 1, "a", 1, ["t"], 10)
    assert v["low"].shape == (3, 2) and np.isfinite(v["log_det"])
    q = timeseries.quantile_var(df, ["a", "b"], 1, 0.5, ["t"])
    assert q["a"].params[1:] == pytest.approx([0.5, 0.2], abs=0.2)
    d = timeseries.vecm(df.withColumn("c", F.col("w") + F.col("b")), ["w", "c"], 1, 1, ["t"])
    assert d["beta"][:, 0] == pytest.approx([1, -1], abs=0.1)


def test_frontier_forest_and_network(spark):
    rng = np.random.default_rng(8)
    n = 1500
    x = rng.normal(size=n)
    y = 1 + 0.5 * x + 0.2 * rng.normal(size=n) - np.abs(rng.normal(size=n)) * 0.6
    fit = glm.stochastic_frontier(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(4), "y ~ x")
    assert fit.params[:2] == pytest.approx([1, 0.5], abs=0.12) and np.exp(fit.params[3]) == pytest.approx(0.6, abs=0.15)
    t = (rng.uniform(size=n) < 0.5).astype(float)
    z = spark.createDataFrame(pd.DataFrame({"x": x, "t": t, "y": x + t * (x > 0) * 2 + rng.normal(size=n) * 0.2})).repartition(4)
    e = causal.causal_forest(z, "y", "t", ["x"], trees=20).groupBy((F.col("x") > 0).alias("p")).agg(F.avg("effect").alias("m")).collect()
    m = {r["p"]: r["m"] for r in e}
    assert m[True] - m[False] == pytest.approx(2, abs=0.5)

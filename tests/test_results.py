"""Results of fits, rank selection and resampling against closed forms and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.models import bootstrap, causal, glm, linear
from gramforge.plans import select
from gramforge.sources.datasets import longley, stackloss


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, 1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-0.3 - 0.8 * x))).astype(float)
    return spark.createDataFrame([(float(a), float(b), int(rng.poisson(math.exp(0.5 + 0.4 * a)))) for a, b in zip(x, y, strict=True)], "x double, y double, n int")


@pytest.mark.parametrize("few", [3, 10_000])
def test_ranks_of_any_column(spark, monkeypatch, few):
    monkeypatch.setattr(select, "FEW", few)
    rng = np.random.default_rng(few)
    v = [*np.exp(rng.normal(0, 20, 500)), *([7.0] * 300), -math.inf, math.inf, math.inf, -1e308, 1e308, 0.0, 5e-324]
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,), (math.nan,)], "v double")
    s = sorted(v)
    at = [0, 1, 2, 3, 100, 400, 600, len(s) - 3, len(s) - 2, len(s) - 1]
    assert select.select_ranks(df, F.col("v"), at) == [s[i] for i in at]
    assert math.isnan(select.select_ranks(df, F.col("v"), [len(s)])[0])
    assert math.isnan(select.quantiles(df.where("v is null"), F.col("v"), [0.5])[0])
    fin = df.where("abs(v) < 1e300")
    assert select.quantiles(fin, F.col("v"), [0.0, 0.31, 1.0]) == pytest.approx(np.quantile([x for x in v if abs(x) < 1e300], [0.0, 0.31, 1.0]))


def test_margins_follow_the_link(spark, binary):
    fit, pro = glm.logit(binary, "y ~ x"), glm.probit(binary, "y ~ x")
    a, b = glm.margins(binary, fit), glm.margins(binary, pro)
    assert a.params[0] == pytest.approx(b.params[0], rel=0.05) and a.se[0] == pytest.approx(b.se[0], rel=0.1)
    at = glm.margins(binary, fit, at={"x": 0.0})
    p = 1 / (1 + math.exp(-fit.params[0]))
    assert at.params[0] == pytest.approx(fit.params[1] * p * (1 - p))
    pois = glm.poisson(binary, "n ~ x")
    mean = binary.agg(F.avg("n")).first()[0]
    assert glm.marginal_effects(binary, pois)["x"] == pytest.approx(pois.params[1] * mean, rel=1e-6)
    with pytest.raises(InvalidOperation):
        glm.margins(binary, linear.ols(binary, "y ~ x"))
    with pytest.raises(InvalidOperation):
        glm.margins(binary, fit, at={"z": 1.0})


def test_intervals_of_predictions_go_through_the_link(spark, binary):
    fit = glm.logit(binary, "y ~ x")
    r = fit.get_prediction(binary).first()
    eta = math.log(r["predicted"] / (1 - r["predicted"]))
    assert 1 / (1 + math.exp(-(eta - 1.959964 * r["pred_se"]))) == pytest.approx(r["ci_low"], rel=1e-6)
    with pytest.raises(InvalidOperation):
        fit.with_inference("other")


def test_class_probabilities_add_up(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 900)
    y = np.digitize(x + rng.logistic(0, 1, 900), [-1, 1])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
    o = glm.ordered_probabilities(df, glm.ordered_logit(df, "y ~ x")).selectExpr("avg(p_1)", "avg(p_2)", "avg(p_3)").first()
    m = glm.multinomial_probabilities(df, glm.multinomial_logit(df, "y ~ x"), "y ~ x")
    share = np.bincount(y) / len(y)
    assert list(o) == pytest.approx(share, abs=0.02) and sum(o) == pytest.approx(1)
    assert list(m.select(*[F.avg(F.col(f"`{c}`")) for c in m.columns[2:]]).first()) == pytest.approx(share, abs=1e-6)
    probit = glm.ordered_probabilities(df, glm.ordered_probit(df, "y ~ x"), normal=True).selectExpr("avg(p_1)", "avg(p_2)", "avg(p_3)").first()
    assert list(probit) == pytest.approx(share, abs=0.02)


def test_overdispersion_is_seen_where_it_is(spark, binary):
    assert abs(glm.overdispersion_test(binary, glm.poisson(binary, "n ~ x"), F.col("n"))["t"]) < 3.5
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 1500)
    wide = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, rng.poisson(np.exp(0.5 + 0.4 * x) * rng.gamma(1.5, 1 / 1.5, 1500)), strict=True)], "x double, n int")
    pois = glm.poisson(wide, "n ~ x")
    lr, p = glm.lr_test_vs_poisson(glm.negative_binomial(wide, "n ~ x"), pois)
    assert lr > 50 and p < 1e-6 and glm.overdispersion_test(wide, pois, F.col("n"))["t"] > 4
    assert glm.goodness_of_fit(pois)["pearson_p"] < 1e-6


def test_glm_with_robust_errors_and_offsets(spark, binary):
    a = glm.glm(binary, "n ~ x", "poisson", cov=linear.Cov("HC1"))
    b = glm.glm(binary, "n ~ x", "poisson")
    assert a.params == pytest.approx(b.params) and a.se == pytest.approx(b.se, rel=0.2)
    e = glm.poisson(binary.withColumn("e", F.lit(2.0)), "n ~ x", exposure=F.col("e"))
    assert e.params[0] == pytest.approx(b.params[0] - math.log(2)) and e.params[1] == pytest.approx(b.params[1])
    for fam, link in (("gamma", "log"), ("gaussian", "identity"), ("tweedie", "log"), ("inverse_gaussian", "log")):
        fit = glm.glm(binary.withColumn("p", F.col("n") + 1), "p ~ x", fam, link)
        assert np.isfinite(fit.params).all()
    with pytest.raises(InvalidOperation):
        glm.glm(binary, "y ~ x", "binomial", exposure=F.lit(1.0))


def test_bootstrap_is_reproducible_and_close_to_theory(spark, binary):
    names, a = bootstrap.pairs_bootstrap(binary, "y ~ x", 300, seed=1)
    b = bootstrap.pairs_bootstrap(binary, "y ~ x", 300, seed=1)[1]
    assert names == ["const", "x"] and (a == b).all()
    fit = linear.ols(binary, "y ~ x", linear.Cov("HC1"))
    assert bootstrap.bootstrap_se(a) == pytest.approx(fit.se, rel=0.2)
    low, high = bootstrap.percentile_ci(a)
    assert (low < fit.params).all() and (fit.params < high).all()
    with pytest.raises(InvalidOperation):
        bootstrap.pairs_bootstrap(binary, "y ~ x", 10**8)


def test_conditional_effects(spark):
    rng = np.random.default_rng(9)
    n = 4000
    x, t = rng.normal(0, 1, n), (rng.random(n) < 0.5).astype(int)
    y = 1 + x + t * (2 + 1.5 * x) + rng.normal(0, 1, n)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(x, t, y, strict=True)], "x double, t int, y double")
    fit = causal.dr_learner(df, "y", "t", ["x"])
    assert list(fit.params) == pytest.approx([2, 1.5], abs=0.15)


def test_classic_data(spark):
    fit = linear.ols(stackloss(spark).df, "stackloss ~ air_flow + water_temp + acid_conc")
    assert list(fit.params) == pytest.approx([-39.9197, 0.7156, 1.2953, -0.1521], abs=1e-4)
    assert longley(spark).n_rows() == 16

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.operators.fill import cell_moments, fill_category, fill_numeric, variance_components

PANEL = "id int, g string, t int, y double, c string"


def rows(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_category_takes_most_frequent_and_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.0, "x"), (2, "a", 1, 0.0, "x"), (3, "a", 1, 0.0, "y"), (4, "a", 1, 0.0, None), (5, "b", 1, 0.0, "z"), (6, "b", 1, 0.0, "w"), (7, "b", 1, 0.0, None), (8, "e", 1, 0.0, None), (9, None, 1, 0.0, None), (10, None, 1, 0.0, "x")], PANEL)
    r = rows(fill_category(df, "c", "g"))
    assert (r[4]["c"], r[4]["c_was_filled"]) == ("x", True)
    assert (r[7]["c"], r[7]["c_was_filled"]) == ("w", True)  # equal counts, equal shares: the smallest
    assert (r[8]["c"], r[8]["c_was_filled"]) == (None, False)
    assert (r[9]["c"], r[9]["c_was_filled"]) == (None, False)
    assert (r[10]["c"], r[10]["c_was_filled"]) == ("x", False)
    assert len(r) == 10


def test_category_shrinks_towards_overall_shares(spark):
    data = [(i, "a", 1, 0.0, "x") for i in range(50)] + [(100, "b", 1, 0.0, "x"), (101, "b", 1, 0.0, "k"), (102, "b", 1, 0.0, None)]
    r = rows(fill_category(spark.createDataFrame(data, PANEL), "c", "g"))
    assert r[102]["c"] == "x"


def test_category_follows_the_time_where_groups_leave_it_open(spark):
    # Group "g" has seen x and y equally often; at time 2 every other group turns to y, at time 1 to x.
    data = [(i, f"o{i % 5}", t, 0.0, c) for i, (t, c) in enumerate([(1, "x")] * 40 + [(2, "y")] * 40)]
    data += [(900, "g", 3, 0.0, "x"), (901, "g", 3, 0.0, "y"), (910, "g", 1, 0.0, None), (911, "g", 2, 0.0, None), (912, "g", 9, 0.0, None), (913, "g", None, 0.0, None), (914, "new", 1, 0.0, None)]
    r = rows(fill_category(spark.createDataFrame(data, PANEL), "c", "g", time="t"))
    assert [r[i]["c"] for i in (910, 911, 912, 913, 914)] == ["x", "y", "x", "x", None]
    assert r[913]["c_was_filled"] and not r[914]["c_was_filled"] and len(r) == len(data)


def test_category_with_time_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.0, None), (2, None, None, 0.0, None), (3, "a", None, 0.0, None)], PANEL)
    assert fill_category(df.limit(0), "c", "g", time="t").count() == 0
    assert [r["c_was_filled"] for r in fill_category(df, "c", "g", time="t").collect()] == [False] * 3
    clash = spark.createDataFrame([(1, "a", 1, "x", 5, 5, 5, 5), (2, "a", 1, None, 6, 6, 6, 6), (2, "a", 1, None, 6, 6, 6, 6)], "id int, g string, t int, c string, n int, th int, share int, best int")
    out = fill_category(clash, "c", "g", time="t").collect()
    assert sorted((r["id"], r["c"], r["n"], r["best"], r["c_was_filled"]) for r in out) == [(1, "x", 5, 5, False), (2, "x", 6, 6, True), (2, "x", 6, 6, True)]


def test_multinomial_multipliers_match_a_dense_fit(spark):
    from gramforge.operators.fill import _Multinomial

    rng = np.random.default_rng(4)
    n = rng.poisson(2.0, (6, 3, 4)) * rng.integers(0, 2, (6, 3, 4))  # group, time, class
    cells = spark.createDataFrame([(g, t, c, float(n[g, t, c])) for g in range(6) for t in range(3) for c in range(4) if n[g, t, c]], "g int, t int, c int, n double")
    m = _Multinomial(cells, True, 2.0, 1)
    share, ng, nt, m_gt, s = n.sum((0, 1)) / n.sum(), n.sum((1, 2)), n.sum((0, 2)), n.sum(2), 2.0
    n_gc, n_tc = n.sum(1), n.sum(0)
    th = np.where(n_gc > 0, (n_gc + s * share) / (share * (ng[:, None] + s)), (s / (ng + s))[:, None])
    ps = np.where(n_tc > 0, (n_tc + s * share) / (share * (m_gt.T @ th + s)), (s / (nt + s))[:, None])
    th = (n_gc + s * share) / (share * (m_gt @ ps + s))
    assert {(r["t"], r["c"]): r["ps"] for r in m.ps.collect()} == pytest.approx({(t, c): ps[t, c] for t in range(3) for c in range(4) if n_tc[t, c]})
    assert {(r["g"], r["c"]): r["th"] for r in m.th.collect()} == pytest.approx({(g, c): th[g, c] for g in range(6) for c in range(4) if n_gc[g, c]})


def test_variance_components_are_solved_together(spark):
    """Against Monte Carlo expectations: the sums of squares of simulated tables of the same layout average to the equations' values."""
    rng = np.random.default_rng(11)
    n = rng.integers(0, 5, (15, 6)).astype(float)
    n[0] *= 9
    ng, nt, total = n.sum(1), n.sum(0), n.sum()

    def between(y):
        return (y.sum(1) ** 2 / ng).sum() - y.sum() ** 2 / total, (y.sum(0) ** 2 / nt).sum() - y.sum() ** 2 / total

    got = np.mean([between(n * (rng.normal(0, 2, 15)[:, None] + rng.normal(0, 3, 6)) + np.sqrt(n) * rng.normal(0, 1, n.shape)) for _ in range(20000)], axis=0)
    # Cells whose sums of squares are these expectations must give back the variances 4, 9 and 1.
    qg, qt, xg, xt = (ng**2).sum(), (nt**2).sum(), (n**2 / ng[:, None]).sum(), (n**2 / nt).sum()
    want = (14 + 4 * (total - qg / total) + 9 * (xg - qt / total), 5 + 4 * (xt - qg / total) + 9 * (total - qt / total))
    assert got == pytest.approx(want, rel=0.03)
    u, v = rng.normal(0, 2, 15), rng.normal(0, 3, 6)
    s = n * (u[:, None] + v)
    cells = spark.createDataFrame([(g, t, float(n[g, t]), float(s[g, t]), float(n[g, t] - 1)) for g in range(15) for t in range(6) if n[g, t]], "g int, t int, n double, s double, ss double")
    vc = variance_components(cells)
    b, se = between(s), (n[n > 0] - 1).sum() / (total - (n > 0).sum())
    a = np.array([[total - qg / total, xg - qt / total], [xt - qg / total, total - qt / total]])
    assert (vc.su, vc.sv) == pytest.approx(np.linalg.solve(a, [b[0] - 14 * se, b[1] - 5 * se])) and vc.se == pytest.approx(se)


def test_numeric_matches_reference_predictor(spark):
    rng = np.random.default_rng(3)
    ug, vt = rng.normal(0, 3, 12), rng.normal(0, 1, 6)
    data = []
    for g in range(12):
        for t in range(6):
            for _ in range(rng.integers(1, 5)):
                data.append((len(data), f"g{g}", t, float(10 + ug[g] + vt[t] + rng.normal(0, 0.5)), None))
    hidden = set(range(0, len(data), 7))
    df = spark.createDataFrame([(i, g, t, None if i in hidden else y, c) for i, g, t, y, c in data], PANEL)
    r = rows(fill_numeric(df, "y", "g", time="t", sweeps=6))
    err = np.array([r[i]["y"] - data[i][3] for i in hidden])
    group_mean = {g: np.mean([y for i, gg, _, y, _ in data if gg == g and i not in hidden]) for g in {d[1] for d in data}}
    base = np.array([group_mean[data[i][1]] - data[i][3] for i in hidden])
    assert np.sqrt((err**2).mean()) < 0.75
    assert (err**2).mean() < (base**2).mean()
    assert all(r[i]["y_was_filled"] == (i in hidden) for i in r)
    vc = variance_components(cell_moments(df, "y", "g", "t", F.col("y").isNotNull(), "identity"))
    assert vc.se == pytest.approx(0.25, abs=0.1) and vc.su == pytest.approx(np.var(ug, ddof=1), rel=0.25)


def test_numeric_edge_cases(spark):
    df = spark.createDataFrame([(1, "a", 1, 5.0, None), (2, "a", 1, None, None), (3, "a", 2, math.nan, None), (4, "b", 1, None, None), (5, None, 1, None, None), (6, "a", None, None, None), (6, "a", None, None, None)], PANEL)
    out = fill_numeric(df, "y", "g", time="t").collect()
    r = {x["id"]: x for x in out}
    assert len(out) == 7
    assert r[2]["y"] == 5.0 and r[3]["y"] == 5.0 and r[6]["y"] == 5.0
    assert r[4]["y"] is None and r[5]["y"] is None and not r[4]["y_was_filled"]
    empty = df.limit(0)
    assert fill_numeric(empty, "y", "g", time="t").count() == 0
    assert fill_category(empty, "c", "g").count() == 0


def test_masks_do_not_clash_and_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True, 7, "u"), (2, "a", None, True, 8, "v")], "id int, g string, y double, Y_was_filled boolean, _u int, `odd.name` string")
    out = fill_numeric(df, "y", "g")
    assert out.columns == [*df.columns, "y_was_filled_"]
    r = rows(out)
    assert r[2]["y"] == 1.0 and r[2]["y_was_filled_"] and r[2]["_u"] == 8 and r[2]["odd.name"] == "v"
    out = fill_category(df.withColumn("_best", F.lit(1)), "odd.name", "g", valid=F.col("`odd.name`") == "u")
    assert rows(out)[2]["odd.name"] == "u"


def test_integer_columns_are_rounded_and_log_link_stays_positive(spark):
    df = spark.createDataFrame([(1, "a", 100), (2, "a", 1000), (3, "a", None), (4, "a", -5)], "id int, g string, y long")
    r = rows(fill_numeric(df, "y", "g", valid=F.col("y") > 0, link="log"))
    assert isinstance(r[3]["y"], int) and 100 <= r[3]["y"] <= 1000
    assert r[4]["y"] == r[3]["y"] and r[4]["y_was_filled"]


def test_unknown_column(spark):
    with pytest.raises(KeyError):
        fill_numeric(spark.range(1), "y", "g")

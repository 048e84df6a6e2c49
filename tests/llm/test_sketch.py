import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.llm.dyadic_sketch import SketchShape, build_sketch, check_ranks, decode, encode, merge_sketches, pack, sketch_quantiles, unpack

QS = [i / 100 for i in range(101)]


def test_encoding_keeps_order_and_precision():
    shape = SketchShape()
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 1, 500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, 1.0, -1.0, 8.0, np.nextafter(8, 0), 5e-324, 1.7e308]])
    codes = encode(v, shape)
    order = np.argsort(v, kind="stable")
    assert (np.diff(codes[order]) >= 0).all() and 0 <= codes.min() and codes.max() < 2**shape.bits
    assert encode(np.array([-0.0]), shape) == encode(np.array([0.0]), shape) and decode(encode(np.zeros(1), shape), shape) == 0
    big = np.abs(v) > 1e-300
    assert decode(codes[big], shape) == pytest.approx(v[big], rel=2.0**-shape.mantissa_bits)


def test_packed_cells_come_back():
    for at, n in (([], []), ([0], [-1]), ([3, 70000, 2**40], [300, -(2**40), 5])):
        a, b = unpack(pack(np.array(at, np.int64), np.array(n, np.int64)))
        assert list(a) == at and list(b) == n


def test_every_fine_level_is_a_sketch(spark):
    shape = SketchShape()
    assert shape.sketched == 14 and 2**shape.exact_bits < shape.width * shape.depth
    df = spark.createDataFrame([(float(i),) for i in range(1, 500)], "v double")
    assert sorted(r["level"] for r in build_sketch(df, [], "v").collect()) == list(range(15))


def rank_error(values, q, got):
    tol = abs(got) * 2.0**-15
    lo, hi = (values < got - tol).sum(), (values <= got + tol).sum()
    want = max(1, math.ceil(q * len(values)))
    return max(0, lo + 1 - want, want - hi)


@pytest.mark.parametrize("kind", ["tail", "ties", "wide"])
def test_error_is_within_the_stated_bound(spark, kind):
    rng = np.random.default_rng(5)
    v = {"tail": np.round(np.exp(rng.normal(3, 1, 40000)), 2), "ties": rng.integers(0, 30, 40000).astype(float), "wide": rng.normal(0, 1, 40000) ** 3}[kind]
    df = spark.createDataFrame([(float(x), i % 3) for i, x in enumerate(v)], "v double, part int")
    sk = merge_sketches(build_sketch(df, ["part"], "v"), [])
    for r in sketch_quantiles(sk, [], QS).collect():
        assert r["n_values"] == len(v)
        assert r["rank_bound"] <= (0 if kind == "ties" else 0.015) * len(v)
        assert rank_error(v, r["q"], r["quantile"]) <= r["rank_bound"] + 1


def test_merge_and_deletion_equal_the_direct_sketch(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(x), int(d)) for x, d in zip(rng.exponential(20, 3000), rng.integers(0, 4, 3000), strict=True)], "v double, day int")
    whole = build_sketch(df, [], "v")
    assert sorted(map(tuple, merge_sketches(build_sketch(df, ["day"], "v"), []).collect())) == sorted(map(tuple, whole.collect()))
    gone = build_sketch(df.where("day = 3").withColumn("w", F.lit(-1)), [], "v", weight="w")
    left = merge_sketches(whole.unionByName(gone), [])
    direct = build_sketch(df.where("day < 3"), [], "v")
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, direct.collect()))


def test_edge_cases(spark):
    df = spark.createDataFrame([("a", None), ("a", math.nan), ("a", math.inf), ("a", 2.0), ("a", 2.0), (None, 3.0), ("b", None)], "g string, v double")
    r = {x["g"]: x for x in sketch_quantiles(build_sketch(df, ["g"], "v"), ["g"], [0.5]).collect()}
    assert set(r) == {"a", None}
    assert r["a"]["n_values"] == 2 and r["a"]["quantile"] == pytest.approx(2.0, rel=1e-4) and r[None]["quantile"] == pytest.approx(3.0, rel=1e-4)
    assert build_sketch(df.limit(0), ["g"], "v").count() == 0
    assert sketch_quantiles(build_sketch(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0
    assert build_sketch(df.withColumn("code", F.lit(1)).withColumn("w", F.lit(1)), ["code"], "v").columns[0] == "code"
    two = build_sketch(df.withColumn("h", F.lit(1.5)), ["g", "h"], "v")
    assert {(x["g"], x["h"]) for x in two.collect()} == {("a", 1.5), (None, 1.5)}
    with pytest.raises(InvalidOperation):
        build_sketch(df.withColumn("Level", F.lit(1)), ["Level"], "v")
    with pytest.raises(InvalidOperation):
        sketch_quantiles(build_sketch(df, ["g"], "v"), ["g"], [1.5])


def test_parts_over_the_memory_bound_are_shipped(spark, monkeypatch):
    from gramforge.llm import dyadic_sketch

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(x), i % 5) for i, x in enumerate(rng.normal(0, 1, 30000))], "v double, g int").coalesce(2)
    small = SketchShape(mantissa_bits=8, exact_bits=10, width=16, depth=3)
    want = sorted(map(tuple, build_sketch(df, ["g"], "v", shape=small).collect()))
    adder = dyadic_sketch._Adder(small)
    v = np.array([r["v"] for r in df.where("g = 2").collect()])
    for part in np.array_split(v, 7):
        adder.codes(*dyadic_sketch._sum_by(encode(part, small), np.ones(len(part), np.int64)))
    assert adder.levels  # more codes than cells: sketched on the way
    assert [(2, *r) for r in adder.rows(True)] == [(g, lv, bytes(c), n) for g, lv, c, n in want if g == 2]


def test_exact_ranks(spark):
    df = spark.createDataFrame([("a", float(i % 10 + 1)) for i in range(100)] + [(None, 4.0), (None, math.nan)], "g string, v double")
    q = sketch_quantiles(build_sketch(df, ["g"], "v"), ["g"], [0.25, 0.5])
    r = {(x["g"], x["q"]): x for x in check_ranks(df, q, ["g"], "v").collect()}
    assert set(r) == {("a", 0.25), ("a", 0.5), (None, 0.25), (None, 0.5)} and all(x["within_bound"] for x in r.values())
    assert r["a", 0.5]["n_values"] == 100 and r["a", 0.5]["rank_error"] == 0 and r[None, 0.5]["n_values"] == 1
    off = q.withColumn("quantile", F.lit(9.0)).withColumn("rank_bound", F.lit(3.0))
    assert not any(x["within_bound"] for x in check_ranks(df, off, ["g"], "v").where("g = 'a'").collect())

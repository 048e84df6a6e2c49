import math
import random

import pytest
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.operators.grid import regular_grid

READ = "k string, w int, t long, y double, step long"


def brute(rows):
    groups = {}
    for k, w, t, y, step in rows:
        if t is not None and y is not None and not math.isnan(y) and step and step > 0:
            groups.setdefault((k, w, step), {}).setdefault(t // step, []).append(y)
    out = set()
    for (k, w, _), slots in groups.items():
        for s in range(min(slots), max(slots) + 1):
            out.add((k, w, s, s not in slots))
    return out


@pytest.mark.parametrize(("shard", "fan"), [(1, 2), (3, 2), (5, 3), (4096, 4096)])
def test_matches_brute_force_at_any_shard_size(spark, shard, fan):
    rng = random.Random(shard)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), rng.choice([None, *[rng.randrange(-400, 2000) for _ in range(9)]]), rng.choice([None, math.nan, *[rng.random() for _ in range(8)]]), 10) for _ in range(300)]
    rows += rows[:20] + [("far", 1, 0, 1.0, 10), ("far", 1, 100000, 3.0, 10), ("one", 1, 7, 1.0, 10), ("bad", 1, 7, 1.0, 0), ("bad", 1, 7, 1.0, None)]
    got = regular_grid(spark.createDataFrame(rows, READ), ["k", "w"], "t", "step", "y", shard_slots=shard, fan=fan).collect()
    cells = [(r["k"], r["w"], r["slot"], r["was_missing"]) for r in got]
    assert len(cells) == len(set(cells))
    assert set(cells) == brute(rows)
    far = {r["slot"]: r["slot_value"] for r in got if r["k"] == "far"}
    assert far[5000] == pytest.approx(2.0)


def test_methods_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0, 10), ("a", 1, 45, 5.0, 10), ("a", 1, 47, 7.0, 10)], READ)
    value = lambda m: [r["slot_value"] for r in regular_grid(df, ["k"], "t", 10, "y", method=m).orderBy("slot").collect()]
    assert value("linear") == pytest.approx([1, 2.25, 3.5, 4.75, 6])
    assert value("locf") == [1, 1, 1, 1, 6]
    assert value("mark") == [1, None, None, None, 6]
    assert regular_grid(df.limit(0), ["k"], "t", 10, "y").count() == 0
    assert regular_grid(df, ["k"], "t", 10, "y", valid=F.lit(None).cast("boolean")).count() == 0


def test_a_gap_over_many_shards_is_spread(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1000, 3.0)], "k string, t long, y double")
    got = regular_grid(df, ["k"], "t", 1, "y", shard_slots=20)
    tasks = got.where("was_missing").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 999


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 9, 9, 9)], "k string, t long, y double, st int, prev int, piece int")
    assert regular_grid(df, ["k"], "t", 1, "y").count() == 1
    assert regular_grid(df.withColumnRenamed("k", "st_"), ["st_"], "t", 1, "y").columns[0] == "st_"
    with pytest.raises(InvalidOperation):
        regular_grid(df.withColumnRenamed("k", "Slot"), ["Slot"], "t", 1, "y")

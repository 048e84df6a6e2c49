import math
from collections import Counter

import numpy as np
import pytest

from gramforge.errors import InvalidOperation
from gramforge.llm.mixing import mix_sources, plan_quotas, shard_ranges, split_tree, tree_nodes, with_token_counts
from gramforge.llm.queries import RANKS_FILE

TARGET = "source string, target_share double, max_repeats int"


def test_plan_meets_shares_or_caps():
    rows = [("a", 0.5, 1, 10, 1000), ("b", 0.3, 2, 10, 100), ("c", 0.2, 4, 0, 0)]
    plan = plan_quotas(rows, None)
    assert [p.quota for p in plan] == pytest.approx([200 * 0.5 / 0.3, 200, 0])
    plan = plan_quotas(rows, 10_000)
    assert [p.quota for p in plan] == [1000, 200, 0]


def _tree(units, shards, seed):
    return np.array([q for _, q in split_tree(units, 0, shards, seed)])


def test_split_tree_is_exact():
    q = _tree([1000, 10, 0, 333], 7, 1)
    assert q.sum(axis=0).tolist() == [1000, 10, 0, 333]
    assert q.sum(axis=1).max() - q.sum(axis=1).min() <= 7
    means = np.mean([_tree([900, 90], 3, s) for s in range(200)], axis=0)
    assert np.abs(means[:, 1] - 30).max() < 1.5


def test_subtrees_give_the_whole_tree(spark):
    units = [500, 0, 61, 9]
    whole = _tree(units, 37, 5)
    parts = [q for have, at, n in tree_nodes(np.array(units), 37, 5, 8) for _, q in split_tree(have, at, n, 5)]
    assert len(tree_nodes(np.array(units), 37, 5, 8)) == 8 and (np.array(parts) == whole).all()
    rows = shard_ranges(spark, units, 37, 5).collect()
    for j, n in enumerate(units):
        mine = sorted((r["lo"], r["hi"], r["shard"]) for r in rows if r["j"] == j)
        assert [u for lo, hi, _ in mine for u in range(lo, hi + 1)] == list(range(n))
        assert [hi - lo + 1 for lo, hi, _ in mine] == [int(q[j]) for q in whole if q[j]]


def test_thousands_of_sources(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('s', id % 4000) as source", "repeat('word ', int(3 + id % 5)) as text")
    targets = spark.range(5000).selectExpr("concat('s', id) as source", "1.0 / 5000 as target_share", "2 as max_repeats")
    mix, report = mix_sources(docs, targets, ranks_file=RANKS_FILE, total_tokens=20_000, shard_tokens=500)
    r = report.selectExpr("count(*) as k", "sum(chosen_tokens) as n", "sum(chosen_copies) as c").first()
    got = mix.selectExpr("count(*) as c", "sum(n_tokens) as n", "count(distinct doc_id, copy_no) as d").first()
    assert r["k"] == 5000 and (r["n"], r["c"]) == (got["n"], got["c"]) and got["d"] == got["c"] and 0 < r["n"]


def _docs(spark):
    rows = [(i, "word " * (5 + i % 40), ("A ", "a", "b")[i % 3] if i % 10 else None) for i in range(900)]
    rows += [(900 + i, "tiny text here", "c") for i in range(3)] + [(999, "", "b"), (998, None, "b"), (5, "word " * 9, "a")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n int, shard string")


def test_mixture(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.4, 3), ("c", 0.05, 2), ("none", 0.05, 9)], TARGET)
    mix, report = mix_sources(_docs(spark), targets, ranks_file=RANKS_FILE, total_tokens=12000, block_docs=8, shard_tokens=1000)
    rows = mix.collect()
    rep = {r["source"]: r for r in report.collect()}
    total = sum(r["n_tokens"] for r in rows)
    for s, cap in (("a", 1), ("b", 3), ("c", 2)):
        used = Counter(r["doc_id"] for r in rows if r["source"] == s and r["doc_id"] != 5)
        assert max(used.values()) <= cap
        assert rep[s]["chosen_copies"] == sum(r["source"] == s for r in rows)
        assert rep[s]["actual_share"] == pytest.approx(sum(r["n_tokens"] for r in rows if r["source"] == s) / total)
    assert rep["none"]["actual_share"] == 0.0
    assert abs(rep["a"]["chosen_tokens"] - 12000 * 0.5 / 0.95) < 60 and abs(rep["b"]["chosen_tokens"] - 12000 * 0.4 / 0.95) < 60
    assert rep["c"]["chosen_copies"] == 6
    shards = Counter(r["shard"] for r in rows)
    assert len(shards) == math.ceil(total / 1000)
    assert len({(r["shard"], r["position"]) for r in rows}) == len(rows)
    assert len({(r["doc_id"], r["source"], r["copy_no"], r["n_tokens"]) for r in rows}) == len(rows)


def test_default_total_meets_every_share(spark):
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], TARGET)
    _, report = mix_sources(_docs(spark), targets, ranks_file=RANKS_FILE)
    rep = {r["source"]: r["actual_share"] for r in report.collect()}
    assert rep["a"] == pytest.approx(0.6, abs=0.01)


def test_empty_and_bad_targets(spark):
    targets = spark.createDataFrame([("a", 1.0, None)], TARGET)
    mix, report = mix_sources(_docs(spark).limit(0), targets, ranks_file=RANKS_FILE)
    assert mix.count() == 0 and report.first()["actual_share"] == 0.0
    with pytest.raises(InvalidOperation):
        mix_sources(_docs(spark), targets.unionByName(targets), ranks_file=RANKS_FILE)
    with pytest.raises(InvalidOperation):
        mix_sources(_docs(spark), targets.unionByName(targets.selectExpr("'b' as source", "target_share", "max_repeats")), ranks_file=RANKS_FILE, max_sources=1)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>"), (5, "na" * 50_000)], "n_tokens long, text string")
    r = {x["n_tokens"]: x["n_tokens_"] for x in with_token_counts(df, "text", RANKS_FILE).collect()}
    assert r[1] == 0 and r[2] == 0 and r[3] == 2 and r[4] > 1 and r[5] > 1000


def test_id_named_like_a_result(spark):
    targets = spark.createDataFrame([("a", 1.0, None)], TARGET)
    with pytest.raises(InvalidOperation):
        mix_sources(_docs(spark), targets, ranks_file=RANKS_FILE, doc="shard")

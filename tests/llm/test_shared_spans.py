import random

import numpy as np
import pytest

from gramforge.errors import InvalidOperation
from gramforge.llm import shared_spans as ss
from gramforge.llm.shared_spans import RollingHash, shared_share, shared_spans


def brute(docs, n):
    where = {}
    for d, t in docs:
        if d is not None and t is not None:
            for i in range(len(t) - n + 1):
                where.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d in {d for d, t in docs if d is not None and t is not None}:
        marks = set()
        for e, t in docs:
            if e == d and t is not None:
                for i in range(len(t) - n + 1):
                    if len(where[t[i : i + n]]) > 1:
                        marks |= set(range(i, i + n))
        run = sorted(marks)
        start = None
        for i, p in enumerate(run):
            start = p if start is None else start
            if i + 1 == len(run) or run[i + 1] != p + 1:
                out.add((d, start, p + 1))
                start = None
    return out


def make(seed, n_docs=40):
    rng = random.Random(seed)
    alphabet = "ab " if seed % 2 else "abcdefghé😀 "
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(n_docs)]
    for _ in range(25):
        i, j = rng.randrange(n_docs), rng.randrange(n_docs)
        a = rng.randrange(len(base[i]) + 1)
        piece = base[i][a : a + rng.randrange(5, 60)]
        at = rng.randrange(len(base[j]) + 1)
        base[j] = base[j][:at] + piece + base[j][at:]
    return [(k, t) for k, t in enumerate(base)]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_matches_brute_force(spark, seed):
    docs = [*make(seed), (1000, ""), (1001, None), (None, "x" * 50), (1002, "a" * 80), (1003, "b" * 90), (1004, "a" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (7, 20):
        got = {tuple(r) for r in shared_spans(df, min_len=n).collect()}
        assert got == brute(docs, n)


def test_small_chunks_give_the_same(spark, monkeypatch):
    docs = make(8, 20)
    monkeypatch.setattr(ss, "_CHUNK", 16)
    texts = [t for _, t in docs]
    who, a, b, fp, cls = ss.anchor_ranges(texts, 7)
    starts = {(w, s) for w, x, y in zip(who, a, b, strict=True) for s in range(x, y + 1)}
    assert starts == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 6)}
    assert len(starts) == sum(y - x + 1 for x, y in zip(a, b, strict=True))
    i = max(range(len(texts)), key=lambda i: len(texts[i]))
    ranges = [(int(x), int(y)) for w, x, y in zip(who, a, b, strict=True) if w == i]
    idx, rel, h = ss.window_hashes(texts[i], ranges[::-1], 7)
    seen = {}
    for k, r, v in zip(idx, rel, h, strict=True):
        at = ranges[::-1][k][0] + r
        assert seen.setdefault(texts[i][at : at + 7], v) == v


def test_rolling_hash_depends_on_content_only():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 0x10FFFF, 5000).astype(np.uint32)
    c[3000:3400] = c[100:500]
    rh = RollingHash(c, 6000)
    assert (rh.windows(np.array([100]), np.array([500])) == rh.windows(np.array([3000]), np.array([3400]))).all()
    h = rh.windows(slice(0, 4901), slice(100, 5001))
    assert len(np.unique(h)) == 4901 - 301


def test_repeated_rows_clashing_names_and_empty(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(300))
    df = spark.createDataFrame([(1, t, 5, "x"), (1, t, 5, "x"), (2, "zz", 5, "x")], "doc_id long, text string, s int, fp string")
    assert shared_spans(df).count() == 0
    more = df.unionByName(spark.createDataFrame([(3, "??" + t, 1, "y")], df.schema))
    assert {tuple(r) for r in shared_spans(more).collect()} == {(1, 0, len(t)), (3, 2, 2 + len(t))}
    assert shared_spans(df.limit(0)).count() == 0
    share = {r["doc_id"]: r["shared_share"] for r in shared_share(more.dropDuplicates(["doc_id"]), shared_spans(more)).collect()}
    assert share[1] == 1.0 and share[2] == 0.0


def test_very_long_text_and_many_copies(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    copies = [(i, long[1000:2000]) for i in range(2, 60)]
    df = spark.createDataFrame([(1, long), *copies], "doc_id string, text string")
    got = {tuple(r) for r in shared_spans(df).collect()}
    assert got == {("1", 1000, 2000), *[(str(i), 0, 1000) for i, _ in copies]}


def test_id_named_like_a_result(spark):
    with pytest.raises(InvalidOperation):
        shared_spans(spark.createDataFrame([(1, "x")], "Span_start long, text string"), doc="Span_start")

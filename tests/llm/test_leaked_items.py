import random

import pytest

from gramforge.errors import InvalidOperation
from gramforge.llm.leaked_items import ItemIndex, leaked_items, words


def test_words():
    assert words("Ação-NÃO  o’Neil_x 12,5") == ["acao", "nao", "o", "neil", "x", "12", "5"]
    assert words(None) == [] and words("") == []


def test_index_finds_every_shared_run():
    rng = random.Random(0)
    vocab = ["the", "of", "a"] * 5 + [f"w{i}" for i in range(40)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(5, 40))] for _ in range(60)]
    items += [list(items[0][:20]), ["the"] * 30, []]
    ix = ItemIndex(items, 6)
    grams = {}
    for i, it in enumerate(items):
        for j in range(len(it) - 5):
            grams.setdefault(tuple(it[j : j + 6]), set()).add(i)
    for _ in range(150):
        doc = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            it = rng.choice(items[:61])
            a = rng.randrange(len(it) + 1)
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = it[a : a + rng.randrange(3, 12)]
        want = set()
        for j in range(len(doc) - 5):
            want |= grams.get(tuple(doc[j : j + 6]), set())
        assert set(ix.leaks(doc, 15)) == want


def _tables(spark):
    q = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([("i1", q, "Zwölf"), ("i2", "too short", None), ("i3", None, None), ("i1", q, "Zwölf")], "item_id string, item_text string, answer string")
    docs = spark.createDataFrame([(1, "x " + q.upper().replace(" ", ", ") + " zwolf", 1), (1, "x " + q, 1), (2, q.replace("seven", "7"), 2), (3, None, 3), (4, "", 4), (None, "Ône two thrée " + q[14:], 5)], "doc_id long, text string, item_id int")
    return docs, items


def test_edge_cases(spark):
    docs, items = _tables(spark)
    out = leaked_items(docs, items)
    r = {(x["doc_id"], x["item_id"]): x for x in out.collect()}
    assert set(r) == {(1, "i1"), (None, "i1")}
    assert r[1, "i1"]["answer_found"] and not r[None, "i1"]["answer_found"] and r[1, "i1"]["shared_runs"] == 2
    assert leaked_items(docs.limit(0), items).count() == 0
    assert leaked_items(docs, items.limit(0)).count() == 0


def test_item_blocks_give_the_same(spark):
    docs, items = _tables(spark)
    more = items.unionByName(spark.createDataFrame([(f"k{i}", f"alpha beta {i} gamma delta one two three four five six seven eight nine ten", None) for i in range(20)], items.schema))
    key = lambda df: sorted((str(r["doc_id"]), r["item_id"], round(r["bm25_score"], 9), *tuple(r)[3:]) for r in df.collect())
    whole = key(leaked_items(docs, more))
    assert whole and whole == key(leaked_items(docs, more, block_bytes=600)) == key(leaked_items(docs, more, block_bytes=200))


def test_overlap_and_answer_as_conditions(spark):
    docs, items = _tables(spark)
    assert {r["doc_id"] for r in leaked_items(docs, items, need_answer=True).collect()} == {1}
    over = {r["doc_id"]: r["item_overlap"] for r in leaked_items(docs, items).collect()}
    assert {r["doc_id"] for r in leaked_items(docs, items, min_item_overlap=0.99).collect()} == {d for d, o in over.items() if o >= 0.99}


def test_run_across_passages_in_a_long_text(spark):
    docs, items = _tables(spark)
    q = items.first()["item_text"]
    for lead in (30, 40, 47, 5000):
        d = spark.createDataFrame([(1, "pad " * lead + q + " pad" * 20000)], "doc_id long, text string")
        assert leaked_items(d, items).count() == 1


def test_id_columns(spark):
    docs, items = _tables(spark)
    same = leaked_items(docs.select("doc_id", "text"), items.withColumnRenamed("item_id", "doc_id"), item="doc_id")
    assert same.columns[:2] == ["doc_id", "doc_id_"]
    with pytest.raises(InvalidOperation):
        leaked_items(docs.withColumnRenamed("doc_id", "shared_runs"), items, doc="shared_runs")

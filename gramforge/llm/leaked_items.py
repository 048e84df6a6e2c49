"""Evaluation items that leak into training documents.

The items are indexed as a BM25 inverted index with block maxima. Every passage of every document is
a query; block-max WAND returns all items whose score reaches the item's threshold. The threshold
is the least score that any run of `min_run` consecutive words of the item gives, so an item that
shares such a run with a passage cannot be missed (passages overlap by min_run - 1 words). Each
candidate is then verified exactly on its word runs and on the overlap of its question and answer with the document.

The statistics of BM25 (number of items, items per word, mean length) are counted once over all items, so
scores do not depend on the blocks in which items go to the tasks.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.util import checkpoint, col, free_name, reject_clash, require

_MARKS = regex.compile(r"\p{M}+")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_K1, _B, _BLOCK = 1.2, 0.75, 16


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower case, without accents."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(text)


@dataclass(frozen=True)
class ItemStatistics:
    """Over all items: their number, their mean length in words, and the items that hold a word."""

    n: int
    mean: float
    df: Mapping[str, int]

    @staticmethod
    def of(items: list[list[str]]) -> ItemStatistics:
        return ItemStatistics(len(items), sum(map(len, items)) / max(1, len(items)), Counter(t for x in items for t in set(x)))


class ItemIndex:
    """BM25 postings of items in blocks of `_BLOCK`, with the greatest weight per term and block."""

    def __init__(self, items: list[list[str]], min_run: int, stats: ItemStatistics | None = None):
        self.items, self.min_run = items, min_run
        stats = ItemStatistics.of(items) if stats is None else stats
        n, df, mean = max(1, stats.n), stats.df, stats.mean or 1.0
        #: Per term the items that hold it, ascending, and its weight in each.
        self.postings: dict[str, tuple[list[int], list[float]]] = {}
        self.thresholds: list[float] = []
        self.grams: list[frozenset[str]] = []
        for i, item in enumerate(items):
            c = Counter(item)
            norm = _K1 * (1 - _B + _B * len(item) / mean)
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * (_K1 + 1) / (k + norm) for t, k in c.items()}
            runs = [item[j : j + min_run] for j in range(len(item) - min_run + 1)]
            # A little below the exact sum, as sums in another order differ in the last digits.
            self.thresholds.append(min((sum(w[t] for t in set(r)) for r in runs), default=math.inf) * (1 - 1e-9))
            self.grams.append(frozenset(" ".join(r) for r in runs))
            if runs:
                for t, x in w.items():
                    ids, weights = self.postings.setdefault(t, ([], []))
                    ids.append(i)
                    weights.append(x)
        self.upper = {t: max(x) for t, (_, x) in self.postings.items()}
        self.block_max: dict[str, dict[int, float]] = {}
        for t, p in self.postings.items():
            m = self.block_max[t] = {}
            for i, x in zip(*p, strict=True):
                m[i // _BLOCK] = max(m.get(i // _BLOCK, 0.0), x)
        self.least = min(self.thresholds, default=math.inf)
        self.block_least = [min(self.thresholds[b : b + _BLOCK]) for b in range(0, len(items), _BLOCK)]

    def search(self, query: set[str]) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least the item's threshold, by block-max WAND."""
        terms = [t for t in query if t in self.upper]
        if sum(self.upper[t] for t in terms) < self.least:
            return []
        found = []
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]  # (item, place in the postings, term)
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.upper[c[2]]
                if bound >= self.least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // _BLOCK
            if sum(self.block_max[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) < self.block_least[block]:
                # No item of the block up to the next cursor can reach a threshold.
                to = (block + 1) * _BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                self._advance(cursors, pivot + 1, max(to, item + 1))
            elif cursors[0][0] == item:
                score = sum(self.postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                if score >= self.thresholds[item]:
                    found.append((item, score))
                self._advance(cursors, pivot + 1, item + 1)
            else:
                self._advance(cursors, pivot, item)
        return found

    def _advance(self, cursors: list[list], upto: int, to: int) -> None:
        """Move the first `upto` cursors to their first posting at or after item `to`."""
        done = False
        for c in cursors[:upto]:
            ids = self.postings[c[2]][0]
            c[1] = bisect_left(ids, to, c[1])
            if c[1] < len(ids):
                c[0] = ids[c[1]]
            else:
                c[0], done = -1, True
        if done:
            cursors[:] = [c for c in cursors if c[0] >= 0]

    def leaks(self, doc: list[str], passage: int) -> dict[int, tuple[float, int]]:
        """Item number to (best score, shared runs) for items sharing a run of min_run words with the document."""
        out: dict[int, tuple[float, int]] = {}
        r = self.min_run
        step = max(1, passage - r + 1)
        for at in range(0, max(0, len(doc) - r) + 1, step):
            part = doc[at : at + passage]
            hits = self.search(set(part))
            if hits:
                grams = [" ".join(part[j : j + r]) for j in range(len(part) - r + 1)]
                for item, score in hits:
                    n = sum(g in self.grams[item] for g in grams)
                    if n:
                        best, k = out.get(item, (0.0, 0))
                        out[item] = (max(best, score), k + n)
        return out


def leaked_items(df: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", answer: str | None = "answer", min_run: int = 13, passage: int = 48, min_item_overlap: float = 0.0, need_answer: bool = False, block_bytes: int = 16_000_000) -> DataFrame:
    """One row per document and item that share a run of at least `min_run` consecutive words.

    Words are maximal runs of letters and digits after lower-casing and removing accents. Result
    columns: the document and item columns, `bm25_score` (best passage), `shared_runs` (starts in the document of runs
    of min_run words that the item has too), `item_overlap` (share of the item's words found in the document) and
    `answer_found` (NULL for an item without answer words). A pair counts only if its `item_overlap` is at least
    `min_item_overlap` and, with `need_answer`, if the answer of an item that has one is found. NULL and empty texts and items shorter than
    min_run words share nothing; repeated rows are looked at once per row and come out once; NULL
    ids are compared like others. The id columns may not be named like a result column; an item column named like the
    document column gets an underscore. The items go to every task in blocks of at most `block_bytes`
    of text and answers, one pass over the documents per block, so the index in a task and on the driver is bounded
    however many items there are (a single item larger than a block is a block by itself).
    """
    require(df, doc, text)
    require(items, item, item_text, *([answer] if answer else []))
    reject_clash([doc, item], ("bm25_score", "shared_runs", "item_overlap", "answer_found"))
    chosen = items.select(col(item).alias("i"), col(item_text).alias("t"), (col(answer) if answer else F.lit(None).cast("string")).alias("a")).distinct()
    nil = F.lit(0)
    head = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("t"), nil) + F.coalesce(F.octet_length("a"), nil)).alias("bytes")).first()
    size = head["bytes"] or 0
    blocks = max(1, math.ceil(1.5 * size / block_bytes)) if size > block_bytes else 1
    chosen = checkpoint(chosen.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")))
    held = checkpoint(_item_words(chosen))
    spread = held.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    mean = (held.agg(F.sum("k")).first()[0] or 0) / max(1, head["n"])
    d_name, i_name = doc, item if item.lower() != doc.lower() else free_name(item, [doc])
    out = None
    for b in range(blocks):
        own = held.where(F.col("b") == b).select("w").distinct().join(spread, "w").collect()
        stats = ItemStatistics(head["n"], mean, {r["w"]: r["n"] for r in own})
        part = _leaks(df, doc, text, chosen.schema["i"].dataType, chosen.where(F.col("b") == b).collect(), min_run, passage, min_item_overlap, need_answer, stats)
        # With several blocks each is finished before the next one is read.
        part = part if blocks == 1 else checkpoint(part)
        out = part if out is None else out.unionByName(part)
    # A repeated document row, and an item id with several texts, give one row.
    g = out.groupBy("d", "i").agg(F.max("s").alias("bm25_score"), F.max("n").alias("shared_runs"), F.max("o").alias("item_overlap"), F.bool_or("f").alias("answer_found"))
    return g.select(F.col("d").alias(d_name), F.col("i").alias(i_name), "bm25_score", "shared_runs", "item_overlap", "answer_found")


def _item_words(chosen: DataFrame) -> DataFrame:
    """One row (b, w, k) per item and word in it, k times in the item."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, w, k) for t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w, k in Counter(words(t)).items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["b", "w", "k"])

    return chosen.select("t", "b").mapInArrow(kernel, "b int, w string, k long")


def _leaks(df: DataFrame, doc: str, text: str, item_kind: T.DataType, rows: list, min_run: int, passage: int, min_item_overlap: float, need_answer: bool, stats: ItemStatistics) -> DataFrame:
    ids = [r["i"] for r in rows]
    texts, answers = [words(r["t"]) for r in rows], [words(r["a"]) for r in rows]
    docs = df.select(col(doc).alias("d"), col(text).alias("t"))
    kind = docs.schema["d"].dataType
    schema = T.StructType([T.StructField("d", kind), T.StructField("i", item_kind), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("o", T.DoubleType()), T.StructField("f", T.BooleanType())])
    empty = docs.sparkSession.createDataFrame([], schema).toArrow().schema
    passage = max(passage, min_run)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(texts, min_run, stats)
        for batch in batches:
            who, found = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                w = words(t)
                if len(w) < min_run:
                    continue
                own = None
                for i, (score, n) in index.leaks(w, passage).items():
                    own = set(w) if own is None else own
                    q = set(texts[i])
                    overlap, answered = len(q & own) / len(q), set(answers[i]) <= own if answers[i] else None
                    if overlap >= min_item_overlap and not (need_answer and answered is False):
                        who.append(k)
                        found.append((ids[i], score, n, overlap, answered))
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())).cast(empty.field(0).type), *[pa.array(c, empty.field(j + 1).type) for j, c in enumerate(cols)]], names=empty.names)

    return docs.mapInArrow(kernel, schema)

"""Spans that occur verbatim in more than one document.

Every window of `min_len` characters is a Rabin-Karp hash (two moduli, joined). Counting all
windows of a corpus would shuffle a row per character, so windows are grouped first:

1. A window's anchor is its least hashed k-gram (k = 4/7 of min_len), which depends on
   the window's content only: equal windows have equal anchors. The windows of a document
   that share an anchor are a contiguous range, one row of about 2/3 of a hundred windows,
   with the hash of the range's whole text as its class.
2. Anchors are counted in Spark. A range whose anchor occurs in one document only holds no shared
   window. A range whose class occurs in several documents is shared as a whole.
3. Only for the other ranges, one per class, each window is hashed and counted by itself. As a
   range is shorter than a window, its shared windows form one run, found from the least and the greatest.
4. The shared windows' spans are merged into maximal runs per document.

No step compares pairs, keeps a list per hash or drops frequent hashes; copies of a text cost one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.errors import InvalidOperation
from gramforge.util import checkpoint, col, reject_clash, require

#: Two primes below 2**31 and a base for each.
_MODULI = ((2147483647, 1103515245), (2147483629, 862048943))
_CHUNK = 1 << 19
_OUT_ROWS = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words (finaliser of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of arbitrary windows of one text of at most `capacity` characters by prefix sums."""

    _tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def __init__(self, chars: np.ndarray, capacity: int):
        if capacity not in self._tables:
            self._tables[capacity] = [(self._powers(b, p, capacity), self._powers(pow(b, -1, p), p, capacity)) for p, b in _MODULI]
        n = len(chars)
        c = chars.astype(np.uint64) + np.uint64(1)
        self._prefix = []
        for (p, _), (up, _) in zip(_MODULI, self._tables[capacity], strict=True):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(c * up[:n] % np.uint64(p), out=sums[1:])
            self._prefix.append(sums % np.uint64(p))
        self._capacity = capacity

    @staticmethod
    def _powers(base: int, p: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        size = 1
        while size < n:
            step = min(size, n - size)
            out[size : size + step] = out[:step] * np.uint64(pow(base, size, p)) % np.uint64(p)
            size += step
        return out

    def windows(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        """Joined 62-bit hashes, well mixed, of text[start:stop] for arrays of offsets."""
        out = None
        for (p, _), pre, (_, down) in zip(_MODULI, self._prefix, self._tables[self._capacity], strict=True):
            q = np.uint64(p)
            inv = down[start] if not isinstance(start, slice) else down[: len(pre)][start]
            h = (pre[stop] + q - pre[start]) % q * inv % q
            out = h if out is None else (out << np.uint64(32)) | h
        return _mix(out)


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Low bits that carry a place in a batch of texts while least values are sought.
_PLACE = 22


def _sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the least value, by its upper bits, of every window of w values; the leftmost of equal ones."""
    mask = np.uint64((1 << _PLACE) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    n, size = len(h) - w + 1, 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[:n], low[w - size : w - size + n])
    return (low & mask).astype(np.int64)


def anchor_ranges(texts: list[str], min_len: int) -> tuple[np.ndarray, ...]:
    """(text index, first start, last start, anchor hash, class hash) of all anchored ranges."""
    k = max(1, min_len * 4 // 7)
    pieces = []  # (text index, offset in the text, text)
    for i, t in enumerate(texts):
        for at in range(0, len(t) - min_len + 1, _CHUNK):
            pieces.append((i, at, t[at : at + _CHUNK + min_len - 1]))
    out: list[tuple[np.ndarray, ...]] = []
    cap = 2 * _CHUNK + 2 * min_len
    lo = 0
    while lo < len(pieces):
        hi, total = lo, 0
        while hi < len(pieces) and (hi == lo or total + len(pieces[hi][2]) <= _CHUNK):
            total += len(pieces[hi][2])
            hi += 1
        part = pieces[lo:hi]
        lo = hi
        lens = np.array([len(p[2]) for p in part])
        base = np.concatenate([[0], np.cumsum(lens)[:-1]])
        counts = lens - min_len + 1
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(part)), counts)
        starts = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + base[owner]
        rh = RollingHash(_chars("".join(p[2] for p in part)), cap)
        n = int(lens.sum())
        grams = rh.windows(slice(0, n - k + 1), slice(k, n + 1))
        low = _sliding_argmin(grams, min_len - k + 1)[starts]
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        a, b, m = starts[first], starts[last], low[first]
        cls = rh.windows(a, b + min_len) ^ _mix(((m - a).astype(np.uint64) << np.uint64(32)) | (b - a).astype(np.uint64))
        who = owner[first]
        shift = np.array([p[1] for p in part])[who] - base[who]
        out.append((np.array([p[0] for p in part])[who], a + shift, b + shift, grams[m], cls))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e.view(np.uint64), e.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_hashes(text: str, ranges: list[tuple[int, int]], min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range index, start - first start, window hash) of every window of the given ranges of starts."""
    cap = 2 * _CHUNK + 2 * min_len
    order = sorted(range(len(ranges)), key=lambda i: ranges[i])
    out = []
    lo = 0
    while lo < len(order):
        at = ranges[order[lo]][0]
        hi = lo
        while hi < len(order) and ranges[order[hi]][1] + min_len - at <= cap - 1:
            hi += 1
        part = order[lo:hi]
        lo = hi
        rh = RollingHash(_chars(text[at : max(ranges[i][1] for i in part) + min_len]), cap)
        idx = np.repeat(np.array(part), [ranges[i][1] - ranges[i][0] + 1 for i in part])
        rel = np.concatenate([np.arange(ranges[i][1] - ranges[i][0] + 1) for i in part])
        s = rel + np.array([r[0] for r in ranges])[idx] - at
        out.append((idx, rel, rh.windows(s, s + min_len)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shared_spans(df: DataFrame, *, doc: str = "doc_id", text: str = "text", min_len: int = 350) -> DataFrame:
    """Maximal runs of characters that lie in a stretch of `min_len` characters found in another document.

    Result columns: the document column, `span_start`, `span_end` (exclusive), in code points. Documents are told apart by
    `doc`; a stretch repeated only within one `doc` is not shared, and repeated rows of one `doc` count as one document.
    Rows with a NULL `doc` or text are left out, texts shorter than `min_len` and an empty table give no
    rows. Texts of any length are read whole. Other columns of `df` are not carried along; `doc` may not be named like a result column.
    """
    require(df, doc, text)
    reject_clash([doc], ("span_start", "span_end"))
    if not 2 <= min_len <= 1 << 20:
        raise InvalidOperation("min_len must lie between 2 and 2**20")
    kind = df.schema[doc].dataType
    docs = df.select(col(doc).alias("d"), col(text).alias("t")).where(F.col("d").isNotNull() & (F.length("t") >= min_len)).withColumn("th", F.xxhash64("t"))
    arrow_kind = docs.select("d").limit(0).toArrow().schema.field("d").type
    schema = T.StructType([T.StructField("d", kind)] + [T.StructField(c, T.LongType()) for c in ("th", "a", "b", "fp", "cls")])
    i64 = pa.int64()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, a, b, fp, cls = anchor_ranges(batch.column(1).to_pylist(), min_len)
            for lo in range(0, len(who), _OUT_ROWS):
                s = slice(lo, lo + _OUT_ROWS)
                take = pa.array(who[s])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take).cast(arrow_kind), batch.column(2).take(take), *[pa.array(x[s].astype(np.int64), i64) for x in (a, b)], *[pa.array(x[s].view(np.int64), i64) for x in (fp, cls)]], names=schema.names)

    anchors = checkpoint(docs.select("d", "t", "th").mapInArrow(ranges, schema))
    classes = anchors.groupBy("fp", "cls").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min(F.struct("d", "th", "a", "b")).alias("rep"))
    counted = classes.groupBy("fp").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count(F.lit(1)).alias("n")).where("l <> h").select("fp", "n")
    classes = checkpoint(classes.join(counted, "fp"))

    # One range of each class whose anchor also has other classes: its windows are counted one by one.
    todo = classes.where("n > 1").select("fp", "cls", "lo", "hi", "rep.*")
    holders = T.StructType([*(T.StructField(c, T.LongType()) for c in ("fp", "h")), T.StructField("lo", kind), T.StructField("hi", kind)])
    places = T.StructType([*(T.StructField(c, T.LongType()) for c in ("fp", "h", "cls")), T.StructField("rel", T.IntegerType())])

    def windows(batches: Iterator[pa.RecordBatch], held: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for i, t in enumerate(batch.column(0).to_pylist()):
                r = lists[i].values
                idx, rel, h = window_hashes(t, list(zip(r.field("a").to_pylist(), r.field("b").to_pylist(), strict=True)), min_len)
                for lo in range(0, len(idx), _OUT_ROWS):
                    s = slice(lo, lo + _OUT_ROWS)
                    take = pa.array(idx[s])
                    more = [r.field("lo").take(take), r.field("hi").take(take)] if held else [r.field("cls").take(take), pa.array(rel[s].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([r.field("fp").take(take), pa.array(h[s].view(np.int64), i64), *more], names=(holders if held else places).names)

    def hashed(which: DataFrame, held: bool) -> DataFrame:
        lists = which.groupBy("d", "th").agg(F.collect_list(F.struct("a", "b", "fp", "cls", "lo", "hi")).alias("r"))
        return docs.join(lists, ["d", "th"]).select("t", "r").mapInArrow(lambda batches: windows(batches, held), holders if held else places)

    hits = hashed(todo, True).groupBy("fp", "h").agg(F.min("lo").alias("l"), F.max("hi").alias("u")).where("l <> u").select("fp", "h")
    parts = hashed(todo.where("lo = hi"), False).join(hits, ["fp", "h"]).groupBy("fp", "cls").agg(F.min("rel").alias("r0"), F.max("rel").alias("r1"))
    whole = classes.where("lo <> hi").select("fp", "cls", F.lit(None).cast("int").alias("r0"), F.lit(None).cast("int").alias("r1"))
    found = anchors.join(parts.unionByName(whole), ["fp", "cls"])
    spans = found.select("d", (F.col("a") + F.coalesce("r0", F.lit(0))).alias("s"), (F.coalesce(F.col("a") + F.col("r1"), F.col("b")) + min_len).alias("e"))
    order = Window.partitionBy("d").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("d", "run").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end")).select(F.col("d").alias(doc), "span_start", "span_end")


def shared_share(df: DataFrame, spans: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of `df`: `n_chars`, `shared_chars` and `shared_share` (0 for an empty or NULL text)."""
    s = spans.groupBy(col(doc).alias("_d")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("_s"))
    n, k = F.coalesce(F.length(col(text)), F.lit(0)).cast("long"), F.coalesce(F.col("_s"), F.lit(0))
    return df.join(s, col(doc) == F.col("_d"), "left").select(col(doc), n.alias("n_chars"), k.alias("shared_chars"), F.when(n > 0, k / n).otherwise(0.0).alias("shared_share"))

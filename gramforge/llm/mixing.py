"""Mixing sources to target weights.

Every source gets a token quota; all its documents are used floor(quota / size) times and a
random part of them once more, cut where the running size of the permuted documents reaches the rest.
The chosen copies are grouped in permuted blocks. A splitting tree divides the blocks of all
sources among the output shards: at every node the left half's share of each source is drawn from the
multivariate hypergeometric distribution, so leaf quotas are exact and every document copy lands
in exactly one shard. The driver draws the first levels of the tree, one vector of sources per node; every
node below is a row whose subtree a task draws. Shards then take disjoint ranges of their sources' permuted
blocks and are shuffled locally. Only per-source totals and the quotas of at most `_NODES` nodes reach the driver.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramforge.errors import InvalidOperation
from gramforge.plans.scan import prefix_sum
from gramforge.util import checkpoint, col, free_name, reject_clash, require

#: Fixed value: the public word-splitting pattern of the byte-level BPE vocabulary.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Nodes of the splitting tree that the driver draws, and the greatest vocabulary file sent to the tasks.
_NODES, _MOST_RANKS = 256, 64_000_000
#: numpy draws from fewer than this many units.
_MOST_UNITS = 10**9
_encodings: dict[str, tiktoken.Encoding] = {}


def _encoding(raw: bytes, pattern: str) -> tiktoken.Encoding:
    key = f"{hash(raw)} {pattern}"
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def with_token_counts(df: DataFrame, text: str, ranks_file: str, *, out: str = "n_tokens", pattern: str = BYTE_BPE_PATTERN, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) and `out`, the number of tokens of the whole text (0 for NULL).

    ranks_file: a vocabulary in tiktoken's format; its bytes (under 2 MB for public ones) are sent to the tasks, and more than 64 MB are an error.
    """
    require(df, text)
    if os.path.getsize(ranks_file) > _MOST_RANKS:
        raise InvalidOperation(f"{ranks_file} is larger than {_MOST_RANKS} bytes")
    with open(ranks_file, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    keep = df.columns if keep is None else keep
    out = free_name(out, keep)
    src = df.select(*[col(c) for c in keep], col(text).alias(t := free_name("_text", keep)))
    schema = T.StructType([*src.drop(t).schema.fields, T.StructField(out, T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks.value, pattern)
        for b in batches:
            n = [0 if x is None else len(enc.encode_ordinary(x)) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, out])

    return src.mapInArrow(kernel, schema)


@dataclass(frozen=True)
class SourceQuota:
    source: str
    target_share: float
    max_repeats: int
    n_docs: int
    tokens: int
    quota: float

    @property
    def full(self) -> int:
        return min(self.max_repeats, int(self.quota // self.tokens)) if self.tokens else 0

    @property
    def rest(self) -> float:
        return 0.0 if self.full >= self.max_repeats else self.quota - self.full * self.tokens


def plan_quotas(rows: list[tuple[str, float, int, int, int]], total_tokens: float | None) -> list[SourceQuota]:
    """rows: (source, target share, max repeats, documents, tokens). Shares of sources without tokens go to the others in proportion."""
    usable = [r for r in rows if r[4] > 0 and r[1] > 0 and r[2] > 0]
    whole = sum(r[1] for r in usable)
    if total_tokens is None:
        total_tokens = min((r[4] * r[2] * whole / r[1] for r in usable), default=0.0)
    names = {r[0] for r in usable}
    return [SourceQuota(*r, min(r[4] * r[2], total_tokens * r[1] / whole) if r[0] in names else 0.0) for r in rows]


def _halves(have: np.ndarray, n: int, seed: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of the first n // 2 of n shards and of the others; a node's draw depends on its place only."""
    half = n // 2
    take = int(round(int(have.sum()) * half / n))
    left = np.random.default_rng([seed, first, n]).multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
    return left, have - left


def split_tree(units: np.ndarray, first: int, shards: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, units per source) of the shards first, first + 1 ..., in order: `units` divided exactly by hypergeometric splits. Holds one vector per level."""
    stack = [(np.asarray(units, np.int64), first, shards)]
    while stack:
        have, at, n = stack.pop()
        if n == 1:
            yield at, have
            continue
        left, right = _halves(have, n, seed, at)
        stack += [(right, at + n // 2, n - n // 2), (left, at, n // 2)]


def tree_nodes(units: np.ndarray, shards: int, seed: int, most: int = _NODES) -> list[tuple[np.ndarray, int, int]]:
    """The first levels of the tree: (units per source, first shard, shards) of at most `most` nodes, by first shard."""
    nodes = [(np.asarray(units, np.int64), 0, shards)]
    while len(nodes) * 2 <= most and any(n > 1 for _, _, n in nodes):
        nxt = []
        for have, at, n in nodes:
            if n == 1:
                nxt.append((have, at, n))
            else:
                left, right = _halves(have, n, seed, at)
                nxt += [(left, at, n // 2), (right, at + n // 2, n - n // 2)]
        nodes = nxt
    return nodes


def shard_ranges(spark: SparkSession, units: list[int], shards: int, seed: int) -> DataFrame:
    """(j, shard, lo, hi): the units lo..hi of source number j that a shard gets; nothing for shards that get none."""
    nodes = tree_nodes(np.array(units, np.int64), shards, seed)
    start = np.zeros(len(units), np.int64)
    rows = []
    for have, at, n in nodes:
        rows.append((at, n, have.tolist(), start.tolist()))
        start = start + have
    table = spark.createDataFrame(rows, "first long, n long, units array<long>, start array<long>").repartition(min(len(rows), spark.sparkContext.defaultParallelism))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, have, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.array(start, np.int64)
                for shard, quota in split_tree(np.array(have, np.int64), first, n, seed):
                    j = np.flatnonzero(quota)
                    yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(np.full(len(j), shard), pa.int64()), pa.array(at[j]), pa.array(at[j] + quota[j] - 1)], names=["j", "shard", "lo", "hi"])
                    at += quota

    return table.mapInArrow(kernel, "j int, shard long, lo long, hi long")


def _unit_permutation(size: int, seed: int) -> tuple[int, int]:
    rng = np.random.default_rng(seed)
    a = int(rng.integers(1, max(2, size)))
    while math.gcd(a, max(1, size)) != 1:
        a += 1
    return a, int(rng.integers(0, max(1, size)))


def mix_sources(df: DataFrame, targets: DataFrame, *, ranks_file: str, doc: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, seed: int = 7, block_docs: int = 64, shard_tokens: int = 500_000, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The mixture, one row per document copy, and the report, one row per target source.

    targets: columns `source`, `target_share`, `max_repeats` (NULL counts as 1; a repeated source is an error). Source names are
    compared without outer blanks and in lower case. Sizes are tokens of whole texts. total_tokens: size of
    the mixture; default the largest at which every source with documents meets its share. Sources
    without tokens get nothing, and the others share its part in proportion; where a given total
    exceeds what a source's max_repeats allows, the source stays below its target and the report shows it.
    Mixture columns: the document and source columns, `n_tokens`, `repeats` (copies of the document), `copy_no`
    (from 1), `shard`, `position` (in the shard). Report: `source`, `target_share`, `max_repeats`, `available_docs`,
    `available_tokens`, `chosen_docs`, `chosen_copies`, `chosen_tokens`, `actual_share` (0 if nothing is chosen).
    Documents with a NULL or untargeted source are not chosen; repeated rows are documents
    of their own; an empty text has size 0 and is treated like others; an empty table gives an empty mixture.
    Shares are met to within one document per source. `doc` and `source` may not be named like another result column. More than max_sources target
    sources, or 10**9 blocks of block_docs copies, are an error; their quotas are a table that is joined, small enough for a broadcast. A shard holds about shard_tokens tokens, whatever their number.
    """
    require(df, doc, text, source)
    require(targets, "source", "target_share", "max_repeats")
    reject_clash([doc, source], ("n_tokens", "repeats", "copy_no", "shard", "position"))
    spark = df.sparkSession
    wanted = targets.limit(max_sources + 1).collect()
    names = [None if r["source"] is None else r["source"].strip().lower() for r in wanted]
    if len(wanted) > max_sources or len(set(names)) < len(names) or None in names:
        raise InvalidOperation(f"targets must be at most {max_sources} different sources")
    listed = spark.createDataFrame([(n,) for n in names], "s string")
    mine = df.select(col(doc).alias("d"), F.lower(F.trim(col(source))).alias("s"), col(text).alias("t")).join(F.broadcast(listed), "s")
    sized = checkpoint(with_token_counts(mine, "t", ranks_file, out="n", keep=["d", "s"]))
    have = {r["s"]: r for r in sized.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}
    rows = [(n, float(r["target_share"] or 0), 1 if r["max_repeats"] is None else int(r["max_repeats"]), have[n]["k"] if n in have else 0, have[n]["n"] if n in have else 0) for n, r in zip(names, wanted, strict=True)]
    plan = plan_quotas(rows, total_tokens)

    # Permuted order: by hash; blocks are equal ranges of the hash, so they are random and about block_docs long.
    blocks = {p.source: max(1, math.ceil(p.n_docs / block_docs)) for p in plan}
    quota = spark.createDataFrame([(p.source, blocks[p.source], p.full, float(p.rest)) for p in plan if p.n_docs], "s string, blocks long, full long, rest double")
    x = sized.join(F.broadcast(quota), "s").withColumn("h", F.xxhash64("d", F.lit(seed)))
    unit = (F.shiftrightunsigned("h", 11) / F.lit(float(2**53))).cast("double")
    x = x.withColumn("b", F.least(F.floor(unit * F.col("blocks")), F.col("blocks") - 1))
    sums = prefix_sum(x.groupBy("s", "b").agg(F.sum("n").alias("bn")), ["s"], "b", ["bn"], ["before"]).select("s", "b", "before")
    run = Window.partitionBy("s", "b").orderBy(F.shiftrightunsigned("h", 11), "h", "d", "n").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("in", F.coalesce(F.sum("n").over(run), F.lit(0))).join(sums, ["s", "b"])
    extra = (F.col("rest") > 0) & (F.col("before") + F.col("in") + F.col("n") / 2 <= F.col("rest"))
    x = x.withColumn("reps", (F.col("full") + F.when(extra, 1).otherwise(0)).cast("int")).where("reps > 0")
    x = checkpoint(x.select("d", "s", "n", "h", "b", "reps", "full"))
    got = {r["s"]: r for r in x.groupBy("s").agg(F.count(F.lit(1)).alias("docs"), F.sum("reps").alias("copies"), F.sum(F.col("reps") * F.col("n")).alias("n"), F.max(F.when(F.col("reps") > F.col("full"), F.col("b"))).alias("last")).collect()}

    size = sum(r["n"] for r in got.values())
    shards = max(1, math.ceil(size / shard_tokens))
    units = [block_count(p, blocks[p.source], got.get(p.source)) for p in plan]
    if sum(units) >= _MOST_UNITS:
        raise InvalidOperation(f"{sum(units)} blocks of copies, {_MOST_UNITS} or more cannot be drawn: raise block_docs")
    place = spark.createDataFrame([(j, p.source, blocks[p.source], max(1, u), *_unit_permutation(u, seed + j)) for j, (p, u) in enumerate(zip(plan, units, strict=True))], "j int, s string, blocks long, size long, a long, c long")
    places = shard_ranges(spark, units, shards, seed).select("j", "shard", F.explode(F.sequence("lo", "hi")).alias("u"))
    y = x.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("reps")))).join(F.broadcast(place), "s")
    nominal = (F.col("copy_no") - 1) * F.col("blocks") + F.col("b")
    y = y.withColumn("u", F.pmod(nominal * F.col("a") + F.col("c"), F.col("size"))).join(places, ["j", "u"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64("d", "copy_no", F.lit(seed + 1)), "d", "copy_no", "s", "n")
    y = y.withColumn("position", F.row_number().over(local))
    mixture = y.select(F.col("d").alias(doc), F.col("s").alias(source), F.col("n").alias("n_tokens"), F.col("reps").alias("repeats"), "copy_no", "shard", "position")
    report = [(p.source, p.target_share, p.max_repeats, p.n_docs, p.tokens or 0, *((g["docs"], g["copies"], g["n"], g["n"] / size if size else 0.0) if (g := got.get(p.source)) else (0, 0, 0, 0.0))) for p in plan]
    kinds = "source string, target_share double, max_repeats int, available_docs long, available_tokens long, chosen_docs long, chosen_copies long, chosen_tokens long, actual_share double"
    return mixture, spark.createDataFrame(report, kinds)


def block_count(p: SourceQuota, blocks: int, got) -> int:
    """Blocks of all copies of a source; the last copy's blocks end where its cut lies."""
    if got is None:
        return 0
    return p.full * blocks + (0 if got["last"] is None else int(got["last"]) + 1)

"""Irregular readings onto a regular grid per source.

The slots of a source are cut into time shards. Each shard is summarised by its
first and last reading. A prefix scan over the summaries carries the last reading before each
shard's start to it; together with the shard's first reading it bounds the gap between shards. Inside a
shard the readings fill the slots between them; a gap between shards is cut at shard borders
into pieces that are spread over the tasks. So every shard, with or without readings, is filled by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.errors import InvalidOperation
from gramforge.plans.scan import carry_last
from gramforge.util import col, reject_clash, require


def regular_grid(df: DataFrame, keys: Sequence[str], time: str, step: str | int, value: str, *, valid: Column | None = None, method: str = "linear", shard_slots: int = 4096, fan: int = 4096) -> DataFrame:
    """One row per step of each source between its first and its last reading.

    keys: columns naming a source (NULL is a source of its own). time: integral or
    numeric time; slot k covers [k*step, (k+1)*step). step: a column constant within a
    source, or a number; steps that are NULL or not above 0 give no slots. valid: which
    rows are readings; rows with a NULL time or a NULL or NaN value never are.
    method: "linear" interpolates between the neighbouring readings, "locf" carries the last
    one, "mark" leaves NULL. Several readings in a slot are averaged; repeated rows thus do
    not change the slots. Result columns: keys, `slot`, `slot_start`, `slot_value`,
    `n_readings` (0 for a filled slot) and `was_missing`. Other columns of `df` are not
    carried along, so their names cannot clash, but a key may not be named like a result column.
    An empty table, or one without readings, gives no rows.
    """
    reject_clash(keys, ("slot", "slot_start", "slot_value", "n_readings", "was_missing"))
    if method not in ("linear", "locf", "mark"):
        raise InvalidOperation(f"unknown method {method!r}")
    require(df, *keys, time, value)
    st = col(step) if isinstance(step, str) else F.lit(step)
    v = col(value).cast("double")
    ok = col(time).isNotNull() & v.isNotNull() & ~F.isnan(v) & (st > 0)
    if valid is not None:
        ok &= F.coalesce(valid, F.lit(False))
    k = [f"_k{i}" for i in range(len(keys))]
    base = df.where(ok).select(*[col(c).alias(a) for c, a in zip(keys, k, strict=True)], F.floor(col(time) / st).cast("long").alias("slot"), v.alias("v"), st.alias("st"))
    slots = base.groupBy(*k, "st", "slot").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    slots = slots.withColumn("shard", F.floor(F.col("slot") / F.lit(shard_slots)))
    end = F.struct("slot", "v")
    source = [*k, "st"]
    shards = slots.groupBy(*source, "shard").agg(F.min(end).alias("first"), F.max(end).alias("last"))
    # Between shards: from the carried reading to the shard's first one, in pieces of one shard each.
    gaps = carry_last(shards, source, "shard", "last", "prev", fan).where(F.col("first.slot") > F.col("prev.slot") + 1)
    gaps = gaps.select(*source, "prev", F.col("first").alias("next"))
    size = F.lit(shard_slots).cast("long")
    border = F.floor((F.col("prev.slot") + 1) / size)
    pieces = gaps.withColumn("p", F.explode(F.sequence(border, F.floor((F.col("next.slot") - 1) / size))))
    lo, hi = F.greatest(F.col("p") * size, F.col("prev.slot") + 1), F.least(F.col("p") * size + (shard_slots - 1), F.col("next.slot") - 1)
    # A piece is a small row that becomes a whole shard: the number of partitions is given, as coalescing by bytes would pile pieces up.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    outer = pieces.repartition(tasks, *source, "p").select(*source, "prev", "next", F.explode(F.sequence(lo, hi)).alias("s"), F.lit(0).cast("long").alias("n"))
    # Inside a shard: every reading opens the slots after the one before it.
    w = Window.partitionBy(*source, "shard").orderBy("slot")
    inner = slots.withColumn("prev", F.lag(end).over(w))
    inner = inner.select(*source, "prev", end.alias("next"), F.explode(F.sequence(F.coalesce(F.col("prev.slot") + 1, F.col("slot")), F.col("slot"))).alias("s"), "n")
    x = inner.unionByName(outer)
    miss = F.col("s") < F.col("next.slot")
    if method == "linear":
        part = (F.col("s") - F.col("prev.slot")) / (F.col("next.slot") - F.col("prev.slot"))
        fill = F.col("prev.v") + (F.col("next.v") - F.col("prev.v")) * part
    else:
        fill = F.col("prev.v") if method == "locf" else F.lit(None).cast("double")
    return x.select(
        *[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)],
        F.col("s").alias("slot"),
        (F.col("s") * F.col("st")).alias("slot_start"),
        F.when(miss, fill).otherwise(F.col("next.v")).alias("slot_value"),
        F.when(miss, F.lit(0).cast("long")).otherwise(F.col("n")).alias("n_readings"),
        miss.alias("was_missing"),
    )

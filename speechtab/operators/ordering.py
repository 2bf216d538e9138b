"""Exact positions within a key that stay balanced when one key is huge.

A plain ``row_number() over (partition by key order by ...)`` sorts each
key's rows in one task.  Here the rows are cut into contiguous segments of
(key, order...) by bounds that are computed once, from a bounded sample, and
travel as one row.  A row's segment is a column expression of its own values,
so every branch of the plan assigns the same one; each segment is numbered
locally, and per-segment counts (at most keys + segments rows) give its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sampled rows per segment, from which the bounds are taken.
_SAMPLES = 16


def _segment(bounds: Column, row: Column, segments: int) -> Column:
    """How many of the sorted ``bounds`` are not above ``row``: binary search."""
    steps = F.sequence(F.lit(1), F.lit(max(1, segments.bit_length() + 1)))
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        up = open_ & (F.get(bounds, mid) <= row)
        return F.struct(F.when(up, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~up, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(steps, start, step, lambda acc: acc["lo"])


def positions_within_key(
    df: DataFrame,
    key: str | Sequence[str],
    order_cols: Sequence[str],
    out_col: str = "position",
    total_col: str | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Add ``out_col``: 0-based position of each row inside its key (one
    column or several), ordered by ``order_cols`` (ascending, NULLs first),
    and optionally the key's row count as ``total_col``.  Rows that tie on the
    order are put in the order of a hash of the whole row, so positions do not
    depend on the run; only rows alike in all columns are interchangeable."""
    keys = [key] if isinstance(key, str) else list(key)
    n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    order = [*order_cols, "_tie"]
    row = F.struct(*[F.col(c) for c in [*keys, *order]])
    sample = df.select(row.alias("r")).orderBy(F.xxhash64("r"), "r").limit(n * _SAMPLES)
    # every 16th of the sorted sample; one row, empty array for an empty table
    bounds = sample.agg(F.sort_array(F.collect_list("r")).alias("s")).select(
        F.transform(
            F.filter(F.col("s"), lambda _, i: (i % _SAMPLES == _SAMPLES - 1)),
            lambda x: x,
        ).alias("b")
    )
    seg = df.withColumn("_bounds", bounds.scalar()).withColumn("_seg", _segment(F.col("_bounds"), row, n)).drop("_bounds")
    counts = seg.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    cols = [*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_seg").alias("_s"), "_off"]
    if total_col is not None:
        offs = offs.withColumn(total_col, F.sum("_c").over(Window.partitionBy(*keys)))
        cols.append(total_col)
    local = seg.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order)) - 1)
    offs = offs.select(*cols)
    on = F.col("_seg") == F.col("_s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(offs, on, "inner").withColumn(out_col, (F.col("_off") + F.col("_local")).cast("bigint"))
    return out.drop("_seg", "_off", "_local", "_tie", "_s", *[f"_k{i}" for i in range(len(keys))])

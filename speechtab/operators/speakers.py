"""Speaker-level selection: duration filter (AGG4), reproducible per-speaker
sampling (WIN1), manifest ordering (SRT1) and first-seen order (SRT2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_columns


def seeded_order(seed: int | str, key: Column) -> Column:
    """Sort key that is a pure function of (seed, key): md5 of ``seed:key``.

    Any engine that has md5 reproduces the same order, and it does not depend
    on partitioning or row order.
    """
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def speakers_with_min_duration(df: DataFrame, speaker_col: str, duration_col: str, min_duration: float) -> DataFrame:
    """AGG4: speakers whose total duration is at least ``min_duration``
    (a speaker is dropped only when the total is strictly below)."""
    # decimal sum: exact, so the verdict does not depend on partitioning
    total = F.sum(F.col(duration_col).cast("decimal(38,9)"))
    return (
        df.groupBy(speaker_col)
        .agg(total.alias("total_duration"))
        .where(F.col("total_duration") >= F.lit(min_duration).cast("decimal(38,9)"))
    )


def sample_per_group(df: DataFrame, group_col: str, id_col: str, n: int, seed: int | str = 42) -> DataFrame:
    """WIN1: at most ``n`` rows per group, chosen by the seeded md5 order.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a hot group ships only ``n`` rows per map task.
    """
    w = Window.partitionBy(group_col).orderBy(seeded_order(seed, F.col(id_col)), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def build_manifest(
    df: DataFrame,
    speaker_col: str = "speakerid",
    id_col: str = "utterance_id",
    duration_col: str = "duration",
    min_duration: float = 300.0,
    n_per_speaker: int = 10,
    seed: int | str = 42,
    extra_cols: tuple[str, ...] = (),
) -> DataFrame:
    """AGG4 + WIN1: the propagation manifest.

    Sampling runs first (it keeps <= n rows per speaker, pre-limited map
    side) and the duration rule is applied to the small result through a
    semi join with the per-speaker totals; the outcome equals filtering first
    because the rule is per speaker.
    """
    require_columns(df, [speaker_col, id_col, duration_col, *extra_cols])
    base = df.where(F.col(speaker_col).isNotNull()).select(speaker_col, id_col, duration_col, *extra_cols)
    sampled = sample_per_group(base, speaker_col, id_col, n_per_speaker, seed)
    keep = speakers_with_min_duration(base, speaker_col, duration_col, min_duration).select(speaker_col)
    return sampled.join(keep, [speaker_col], "left_semi")


def ordered_for_write(df: DataFrame, speaker_col: str, id_col: str) -> DataFrame:
    """SRT1: rows contiguous per speaker.  A global range sort; use only
    right before writing a file that readers consume in order."""
    return df.orderBy(speaker_col, id_col)


def first_seen(df: DataFrame, key_col: str, order_col: str) -> DataFrame:
    """SRT2: distinct keys with their first position (partial aggregation)."""
    return df.groupBy(key_col).agg(F.min(order_col).alias("first_seen"))

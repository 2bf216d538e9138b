"""Dataset-level statistics (AGG8, AGG9, AGG17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require_columns


def _has(col: str) -> F.Column:
    return F.coalesce(F.size(F.col(col)) > 0, F.lit(False))


def split_statistics(
    df: DataFrame,
    split_col: str = "split",
    speaker_col: str = "speakerid",
    duration_col: str = "duration",
    intrinsic_col: str = "intrinsic_tags",
    situational_col: str = "situational_tags",
) -> DataFrame:
    """AGG9: examples, unique speakers and hours per split, hours carrying
    intrinsic / situational / both tags; the grand total is the NULL-split row
    of the rollup."""
    require_columns(df, [split_col, speaker_col, duration_col, intrinsic_col, situational_col])
    dur = F.col(duration_col)
    hi, hs = _has(intrinsic_col), _has(situational_col)

    def hours(c):
        return F.round(c.cast("double") / 3600, 6)

    def exact_sum(c):
        # decimal sums are exact, so the total does not depend on row order
        return F.sum(c.cast("decimal(38,9)"))

    return df.rollup(split_col).agg(
        F.count(F.lit(1)).alias("examples"),
        F.count_distinct(speaker_col).alias("speakers"),
        hours(exact_sum(dur)).alias("hours"),
        hours(F.coalesce(exact_sum(F.when(hi, dur)), F.lit(0))).alias("hours_intrinsic"),
        hours(F.coalesce(exact_sum(F.when(hs, dur)), F.lit(0))).alias("hours_situational"),
        hours(F.coalesce(exact_sum(F.when(hi & hs, dur)), F.lit(0))).alias("hours_both"),
    )


def manifest_summary(df: DataFrame, speaker_col: str = "speaker") -> DataFrame:
    """AGG8: rows and distinct speakers of a manifest."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(speaker_col).alias("speakers"))


def speakers_not_n(df: DataFrame, n: int, speaker_col: str = "speaker") -> DataFrame:
    """AGG17: speakers whose row count differs from ``n`` (empty when sound)."""
    return df.groupBy(speaker_col).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") != n)


def frame_to_utterance(df: DataFrame, key: str, pitch_col: str, snr_col: str, c50_col: str) -> DataFrame:
    """AGG15: frame-level values -> utterance level: pitch mean and sample
    standard deviation, SNR mean, C50 mean (partial aggregation)."""
    return df.groupBy(key).agg(
        F.avg(pitch_col).alias("utterance_pitch_mean"),
        F.stddev_samp(pitch_col).alias("utterance_pitch_std"),
        F.avg(snr_col).alias("snr"),
        F.avg(c50_col).alias("c50"),
    )

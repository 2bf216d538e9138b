"""Per-row audio arithmetic (MTH2, MTH3) and sample-array transforms
(ARR2 peak normalisation, ARR3 wrap-pad crops, ARR9 leading slice)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_seconds(n_samples: Column, sampling_rate: Column) -> Column:
    return n_samples / sampling_rate


def speaking_rate(phonemes: Column, n_samples: Column, sampling_rate: Column) -> Column:
    """MTH2: phoneme characters per second of audio."""
    return F.length(phonemes) / clip_seconds(n_samples, sampling_rate)


def gender_from_probs(probs: Column) -> Column:
    """MTH3: male when class 1 outscores class 0, otherwise female (a third
    class, if any, is ignored)."""
    return F.when(F.element_at(probs, 2) > F.element_at(probs, 1), F.lit("male")).otherwise(F.lit("female"))


def peak_normalize(samples: Column, headroom_db: float = 0.1) -> Column:
    """ARR2: scale so the largest magnitude sits ``headroom_db`` below full
    scale; an all-zero clip stays zero."""
    target = 10 ** (-headroom_db / 20.0)
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(samples, lambda x: x * F.lit(target) / peak)).otherwise(
        F.transform(samples, lambda x: x * 0.0)
    )


def leading_slice(samples: Column, seconds: float, sampling_rate: Column) -> Column:
    """ARR9: the first ``seconds`` of a clip."""
    n = (F.lit(float(seconds)) * sampling_rate).cast("int")
    return F.slice(samples, 1, n)


def wrap_pad(samples: Column, max_frames: int) -> Column:
    """ARR3 first step: a clip no longer than ``max_frames*160+240`` samples
    is extended cyclically to that length + 1 (numpy 'wrap' padding)."""
    max_audio = max_frames * 160 + 240
    size = F.size(samples)
    reps = F.floor(F.lit(max_audio + 1) / size).cast("int") + 1
    return F.when(
        size <= max_audio,
        F.slice(F.flatten(F.array_repeat(samples, reps)), 1, F.lit(max_audio + 1)),
    ).otherwise(samples)


def crops_of_padded(padded: Column, max_frames: int, num_eval: int = 10) -> Column:
    """ARR3 second step: ``num_eval`` evenly spaced crops of
    ``max_frames*160+240`` samples from an already padded clip."""
    max_audio = max_frames * 160 + 240
    span = F.size(padded) - max_audio
    # evenly spaced float starts (last one exactly at the end), truncated
    step = span.cast("double") / F.lit(float(max(num_eval - 1, 1)))
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(num_eval - 1)),
        lambda i: F.when(i == num_eval - 1, span).otherwise(F.floor(i.cast("double") * step).cast("int"))
        if num_eval > 1
        else F.lit(0),
    )
    return F.transform(starts, lambda s0: F.slice(padded, s0 + 1, F.lit(max_audio)))


def eval_crops(samples: Column, max_frames: int, num_eval: int = 10) -> Column:
    """ARR3: wrap-pad a short clip to ``max_frames*160+240 + 1`` samples and
    take ``num_eval`` evenly spaced crops of ``max_frames*160+240`` samples
    (``max_frames=0`` keeps the whole clip as the single crop).  On tables
    prefer :func:`crops_table`, which pads once per row."""
    if max_frames == 0:
        return F.array(samples)
    return crops_of_padded(wrap_pad(samples, max_frames), max_frames, num_eval)


def crops_table(df, samples_col: str, max_frames: int, num_eval: int = 10, out_col: str = "crops"):
    """ARR3 on a table, padding each clip once before cutting the crops."""
    if max_frames == 0:
        return df.withColumn(out_col, F.array(F.col(samples_col)))
    staged = df.withColumn("_padded", wrap_pad(F.col(samples_col), max_frames))
    return staged.withColumn(out_col, crops_of_padded(F.col("_padded"), max_frames, num_eval)).drop("_padded")

"""Label and code tables for training (ARR4-ARR8, AGG16) and snapshot
bookkeeping (WIN8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import delay_pattern, pad_to, round_up, trim_frames


def pad_batches(
    df: DataFrame,
    seq_col: str,
    batch_col: str,
    pad_value: int = -100,
    mode: str = "longest",
    max_length: int | None = None,
    multiple_of: int | None = None,
    side: str = "right",
    out_col: str = "padded",
) -> DataFrame:
    """ARR4: pad every sequence of a batch to the batch's longest (or to
    ``max_length``), optionally rounded up to a multiple.  The batch length
    is a per-batch aggregate joined back (batches are bounded in size); rows
    without a batch are one batch."""
    if mode == "longest":
        lens = df.groupBy(F.col(batch_col).alias("_batch")).agg(F.max(F.size(seq_col)).alias("_target"))
        out = df.join(lens, F.col(batch_col).eqNullSafe(F.col("_batch"))).drop("_batch")
        target = round_up(F.col("_target"), multiple_of)
        if max_length is not None:
            target = F.least(target, F.lit(max_length))
    elif mode == "max_length":
        if max_length is None:
            raise ValueError("max_length mode needs max_length")
        out = df.withColumn("_target", F.lit(max_length))
        target = round_up(F.col("_target"), multiple_of)
    else:
        raise ValueError("mode is 'longest' or 'max_length'")
    return out.withColumn(out_col, pad_to(F.col(seq_col), target, pad_value, side)).drop("_target")


def trim_codes(df: DataFrame, codes_col: str, length_col: str, batch_col: str, out_col: str = "trimmed") -> DataFrame:
    """ARR8: ratio = code frames / longest clip of the batch; keep
    ``int(ratio * clip length)`` frames.  Rows without a batch are one batch."""
    frames = F.size(F.element_at(codes_col, 1))
    lens = df.groupBy(F.col(batch_col).alias("_batch")).agg(F.max(length_col).alias("_maxlen"))
    out = df.join(lens, F.col(batch_col).eqNullSafe(F.col("_batch"))).drop("_batch")
    ratio = frames / F.col("_maxlen")
    return out.withColumn(out_col, trim_frames(F.col(codes_col), ratio, F.col(length_col))).drop("_maxlen")


def longest_clip(df: DataFrame, length_col: str = "target_length", labels_col: str = "labels") -> DataFrame:
    """AGG16: the longest clip, and the longest label row among clips of
    that length -- one aggregate, no sort."""
    m = F.max(F.struct(F.col(length_col).alias("target_length"), F.size(F.element_at(labels_col, 1)).alias("label_length")))
    return df.agg(m.alias("_m")).select("_m.target_length", "_m.label_length")


_CKPT = "^checkpoint-(\\d+)(?:-epoch-(\\d+))?$"


def snapshot_retention(df: DataFrame, name_col: str = "name", run_col: str | None = "run", keep_last: int = 3) -> DataFrame:
    """WIN8: parse ``checkpoint-<step>`` and ``checkpoint-<step>-epoch-<e>``
    names; flag the newest and the last ``keep_last`` by step (the rest may be
    deleted by the caller).  Other names, steps beyond 63 bits among them, are
    listed too, without a step, and always kept; a name that occurs twice in a
    run is listed once.  Rows without a run form a run of their own.

    The kept set is a ``row_number() <= keep_last`` limit (pre-limited map
    side) joined back to flag rows, so no run is sorted whole in one task.
    """
    if run_col is None:
        df = df.withColumn("_run", F.lit(0))
        run_col = "_run"
    keys = [run_col]

    def number(group: int) -> Column:
        found = F.regexp_extract(F.col(name_col), _CKPT, group)
        return F.when(found != "", found.try_cast("bigint"))

    parsed = df.select(*keys, name_col).distinct().select(*keys, name_col, number(1).alias("step"), number(2).alias("epoch"))
    w = Window.partitionBy(*keys).orderBy(F.col("step").desc(), F.col(name_col).desc())
    top = parsed.where(F.col("step").isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep_last)
    top = top.select(F.col(run_col).alias("_r"), F.col(name_col).alias("_n"), (F.col("_rn") == 1).alias("latest"), F.lit(True).alias("keep"))
    out = parsed.join(top, F.col(run_col).eqNullSafe(F.col("_r")) & (F.col(name_col) == F.col("_n")), "left")
    return out.select(
        *[k for k in keys if k != "_run"],
        name_col,
        "step",
        "epoch",
        F.coalesce("keep", F.col("step").isNull()).alias("keep"),
        F.coalesce("latest", F.lit(False)).alias("latest"),
    )


def delayed_labels(df: DataFrame, codes_col: str, n_codebooks: int, bos_id: int, eos_id: int, out_col: str = "labels") -> DataFrame:
    """ARR5 on a table."""
    return df.withColumn(out_col, delay_pattern(F.col(codes_col), n_codebooks, bos_id, eos_id))


def undelayed_codes(df: DataFrame, labels_col: str, n_codebooks: int, codebook_size: int, out_col: str = "codes") -> DataFrame:
    """ARR6 on a table, in stages so each intermediate array is computed
    once per row: strip the delay from every codebook row, find the frames
    whose codes are all in range, keep those frames."""
    lab = F.col(labels_col)
    t = F.size(F.element_at(lab, 1)) - n_codebooks
    staged = df.withColumn("_rows", F.transform(lab, lambda row, k: F.slice(row, k + 1, F.greatest(t, F.lit(0)))))
    frames = F.size(F.element_at("_rows", 1))
    ok = F.transform(
        F.sequence(F.lit(1), F.greatest(frames, F.lit(1))),
        lambda j: (frames > 0) & F.forall("_rows", lambda r: F.element_at(r, j) < codebook_size),
    )
    staged = staged.withColumn("_ok", ok)
    keep = F.filter(F.sequence(F.lit(1), F.greatest(frames, F.lit(1))), lambda j: F.element_at("_ok", j))
    staged = staged.withColumn("_keep", keep)
    return staged.withColumn(
        out_col, F.transform("_rows", lambda r: F.transform("_keep", lambda j: F.element_at(r, j)))
    ).drop("_rows", "_ok", "_keep")

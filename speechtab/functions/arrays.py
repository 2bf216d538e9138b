"""Code-array reshaping for training labels (ARR4-ARR8) and segment cuts
(ARR1), all as built-in array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delay_pattern(codes: Column, n_codebooks: int, bos_id: int, eos_id: int) -> Column:
    """ARR5: delayed labels from a codebooks x frames matrix.

    Row k becomes k begin ids, the T codes of codebook k, then K-k end ids
    (length T+K).  With fewer than K-2 frames every cell is the end id.
    """
    t = F.size(F.element_at(codes, 1))
    k_n = n_codebooks
    rows = F.transform(
        codes,
        lambda row, k: F.concat(
            F.array_repeat(F.lit(bos_id), k), row, F.array_repeat(F.lit(eos_id), F.lit(k_n) - k)
        ),
    )
    all_end = F.array_repeat(F.array_repeat(F.lit(eos_id), t + k_n), k_n)
    return F.when(t < k_n - 2, all_end).otherwise(rows)


def undelay(labels: Column, n_codebooks: int, codebook_size: int) -> Column:
    """ARR6: undo :func:`delay_pattern` (row k -> its T codes) and drop every
    frame in which any codebook holds an out-of-range code."""
    t = F.size(F.element_at(labels, 1)) - n_codebooks
    rows = F.transform(labels, lambda row, k: F.slice(row, k + 1, t))
    keep = F.filter(
        F.sequence(F.lit(1), F.greatest(t, F.lit(1))),
        lambda j: (t > 0) & F.forall(rows, lambda r: F.element_at(r, j) < codebook_size),
    )
    return F.transform(rows, lambda r: F.transform(keep, lambda j: F.element_at(r, j)))


def shift_right(ids: Column, pad_id: int, start_id: int, ignore_id: int = -100) -> Column:
    """ARR7: prepend the start id, drop the last id, replace ``ignore_id``
    by the pad id."""
    n = F.size(ids)
    shifted = F.when(n == 0, ids).otherwise(F.concat(F.array(F.lit(start_id)), F.slice(ids, 1, F.greatest(n - 1, F.lit(0)))))
    return F.transform(shifted, lambda x: F.when(x == ignore_id, F.lit(pad_id)).otherwise(x))


def trim_frames(codes: Column, ratio: Column, length: Column) -> Column:
    """ARR8: keep ``int(ratio * length)`` frames of every codebook."""
    keep = (ratio * length).cast("int")
    return F.transform(codes, lambda r: F.slice(r, 1, keep))


def pad_to(seq: Column, target: Column, pad_value: int, side: str = "right") -> Column:
    """ARR4 step: pad (or truncate) one sequence to ``target`` items."""
    n = F.size(seq)
    fill = F.array_repeat(F.lit(pad_value), F.greatest(target - n, F.lit(0)))
    if side == "right":
        return F.slice(F.concat(seq, fill), 1, target)
    if side == "left":
        cut = F.when(n > target, F.slice(seq, n - target + 1, target)).otherwise(seq)
        return F.concat(fill, cut)
    raise ValueError("side must be 'left' or 'right'")


def round_up(n: Column, multiple: int | None) -> Column:
    if not multiple:
        return n
    return (F.ceil(n / F.lit(float(multiple))) * multiple).cast("int")


def cut_ms(samples: Column, sampling_rate: Column, start_s: Column, end_s: Column) -> Column:
    """ARR1: samples between two times, cut at whole milliseconds like an
    audio-segment slice: frame index = int(int(t*1000) * rate / 1000)."""
    a = (F.floor(start_s * 1000).cast("int") * sampling_rate / 1000.0).cast("int")
    b = (F.floor(end_s * 1000).cast("int") * sampling_rate / 1000.0).cast("int")
    n = F.size(samples)
    a = F.least(F.greatest(a, F.lit(0)), n)
    b = F.least(F.greatest(b, a), n)
    return F.when(b > a, F.slice(samples, a + 1, b - a)).otherwise(F.slice(samples, 1, 0))

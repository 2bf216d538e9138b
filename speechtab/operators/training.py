"""The training table as one plan (L3): metadata merged (JN1), text limit
(FLT2), token counts (STR5), codes trimmed (ARR8) and laid out with their delay
(ARR5), joined by id (JN2), length and token limits (FLT3, FLT4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_prompt, count_tokens
from ..schema import require_columns
from . import codes as C
from . import prepare as P


@dataclass(frozen=True)
class TrainingLimits:
    """Bounds of the table; a token bound of None does not apply."""

    max_text_chars: int = 500
    min_seconds: float = 2.0
    max_seconds: float = 30.0
    sampling_rate: int = 44_100
    max_description_tokens: int | None = None
    max_prompt_tokens: int | None = None


@dataclass(frozen=True)
class CodeLayout:
    """Codebooks of a code table and the ids that begin and end a row."""

    n_codebooks: int
    bos_id: int
    eos_id: int


def training_labels(codes: DataFrame, layout: CodeLayout, id_col: str = "id", codes_col: str = "codes",
                    length_col: str = "target_length", batch_col: str = "batch") -> DataFrame:
    """(id, target_length, labels) from an encoder's output, of which every batch
    was padded to its longest clip: the frames of the padding go, then each
    codebook is shifted by its delay.  Rows without a batch are one batch."""
    require_columns(codes, [id_col, codes_col, length_col, batch_col], "codes")
    trimmed = C.trim_codes(codes, codes_col, length_col, batch_col, "_trimmed")
    labels = C.delayed_labels(trimmed, "_trimmed", layout.n_codebooks, layout.bos_id, layout.eos_id, "labels")
    return labels.select(id_col, F.col(length_col).alias("target_length"), "labels")


def training_table(
    dataset: DataFrame,
    metadata: DataFrame,
    codes: DataFrame,
    layout: CodeLayout,
    limits: TrainingLimits = TrainingLimits(),
    id_col: str = "id",
    prompt_col: str = "prompt",
    description_col: str = "description",
    on_mismatch: str = "raise",
) -> DataFrame:
    """One row per clip that passes every limit: the merged columns, the two
    texts cleaned, ``prompt_tokens`` and ``description_tokens``,
    ``target_length`` and ``labels``.

    A row whose text, length or codes are missing passes no limit and is not in
    the table; a clip with two rows of codes is there twice.  The dataset's
    columns named like one of the results are replaced.  Limits on text come
    before the join with the codes, the widest column of the plan."""
    merged = P.merge_metadata(dataset, metadata, id_col, on_mismatch=on_mismatch)
    require_columns(merged, [id_col, prompt_col, description_col], "dataset with metadata")
    t = P.text_shorter_than(merged, description_col, limits.max_text_chars)
    t = t.drop("target_length", "labels")
    for name, col, most in (("description_tokens", description_col, limits.max_description_tokens),
                            ("prompt_tokens", prompt_col, limits.max_prompt_tokens)):
        t = t.withColumn(col, clean_prompt(F.col(col)))
        t = t.withColumn(name, count_tokens(F.col(col))).where(F.col(name).isNotNull())
        if most is not None:
            t = P.tokens_below(t, name, most)
    wanted = P.length_in_range(training_labels(codes, layout, id_col), "target_length", limits.min_seconds, limits.max_seconds, limits.sampling_rate)
    return t.join(wanted.where(F.col("labels").isNotNull()), [id_col], "inner")

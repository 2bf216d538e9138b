"""Tag votes and propagation bookkeeping (AGG6, FLT6, JN5, JN6, SET3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Tags that may be copied from a source speaker to similar
# target speakers (clarity-related tags excluded), as published.
# ---------------------------------------------------------------------------
INTRINSIC_TAGS_EXPANDABLE = [
    "Shrill", "Nasal", "Deep",
    "Silky", "Husky", "Raspy", "Guttural", "Vocal-fry",
    "Booming", "Authoritative", "Loud", "Soft",
    "Flowing", "Monotonous", "Punctuated", "Hesitant", "Singsong", "Enunciated",
]
# ---------------------------------------------------------------------------


def explode_annotation_map(df: DataFrame, map_col: str = "annotations") -> DataFrame:
    """SRC3 after parsing: ``map<string, array<string>>`` -> (name, tag) rows,
    one per vote (repeats kept)."""
    return df.select(F.explode(map_col).alias("name", "_tags")).select("name", F.explode("_tags").alias("tag"))


def tag_votes(
    annotations: DataFrame,
    min_annotations: int = 2,
    allowed: Sequence[str] | None = INTRINSIC_TAGS_EXPANDABLE,
    name_col: str = "name",
    tag_col: str = "tag",
) -> DataFrame:
    """AGG6 + FLT6: per name the sorted tags named by at least
    ``min_annotations`` votes and on the ``allowed`` list; names left with no
    tag do not appear."""
    votes = annotations.where(F.col(tag_col).isNotNull())
    if allowed is not None:
        votes = votes.where(F.col(tag_col).isin(list(allowed)))
    counted = votes.groupBy(name_col, tag_col).agg(F.count(F.lit(1)).alias("_votes"))
    kept = counted.where(F.col("_votes") >= min_annotations)
    return kept.groupBy(name_col).agg(F.sort_array(F.collect_list(tag_col)).alias("tags"))


def restrict_to(df: DataFrame, keys: DataFrame, on: str | list) -> DataFrame:
    """JN5: keep rows whose key appears in ``keys`` (left semi join)."""
    return df.join(keys, on, "left_semi")


def attach_parent_tags(best: DataFrame, votes: DataFrame, name_col: str = "name") -> DataFrame:
    """JN6: (target, parent, score) + the parent's tags."""
    v = votes.select(F.col(name_col).alias("parent"), "tags")
    return best.join(v, ["parent"], "inner")


def all_tags(*cols: Column) -> Column:
    """SET3: sorted union of several tag arrays, NULL arrays counting as empty."""
    parts = [F.coalesce(c, F.array().cast("array<string>")) for c in cols]
    return F.array_sort(F.array_distinct(F.concat(*parts)))

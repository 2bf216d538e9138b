"""Reports counted in passing (JN1, JN9, WIN7, UDF3): how many rows did not
match, were rejected or failed, gathered by the job that writes the result,
without a second scan.

Each function returns (frame, observation).  Run one action on the frame, then
read ``observation.get``: a dict of counts.  The counts are taken after the last
shuffle of the frame, so a task that is repeated because its executor was lost
counts once, as long as the caller writes the frame without a further shuffle;
below a further shuffle a repeated task counts again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.arrays import cut_ms
from ..functions.text import segment_file_name
from ..schema import require_columns
from .prepare import column_overlap


def counted(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, with an observation of its ``rows`` and, for each named
    condition, of the rows that meet it (NULL counts as not met)."""
    if "rows" in conditions:
        raise ValueError("'rows' counts all rows")
    seen = Observation()
    counts = [F.count(F.when(c, F.lit(1))).alias(n) for n, c in conditions.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def merge_counted(dataset: DataFrame, metadata: DataFrame, id_col: str = "id") -> tuple[DataFrame, Observation]:
    """JN1: the rows whose id both sides have, as ``prepare.merge_metadata``
    with ``on_mismatch="inner"`` gives them, and the counts ``dataset_only``,
    ``metadata_only`` and ``repeated`` (matched rows whose id the metadata have
    more than once).  A NULL id matches nothing."""
    require_columns(dataset, [id_col], "dataset")
    require_columns(metadata, [id_col], "metadata")
    other = f"metadata_{id_col}"
    md = metadata.withColumnRenamed(id_col, other)
    clash, _ = column_overlap(dataset, md)
    md = md.drop(*clash).withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(other)))
    both = dataset.withColumn("_here", F.lit(True)).join(md, dataset[id_col] == md[other], "full_outer")
    here, there = F.col("_here").isNotNull(), F.col("_times").isNotNull()
    out, seen = counted(both, dataset_only=here & ~there, metadata_only=there & ~here, repeated=here & there & (F.col("_times") > 1))
    return out.where(here & there).drop("_here", "_times"), seen


def first_per_key_counted(
    segments: DataFrame, keys=("filename", "channel"), order_col: str = "line_no"
) -> tuple[DataFrame, Observation]:
    """WIN7: rows of the first line of each key, as ``segments.first_per_key``
    keeps them, and the count ``rejected`` of all others, rows with a NULL key
    or a NULL line among them."""
    firsts = segments.groupBy(*keys).agg(F.min(order_col).alias("_first"))
    flagged = segments.join(firsts, list(keys), "left").withColumn("_kept", F.coalesce(F.col(order_col) == F.col("_first"), F.lit(False)))
    out, seen = counted(flagged, rejected=~F.col("_kept"))
    return out.where("_kept").select(*segments.columns), seen


def cut_segments_counted(clips: DataFrame, segments: DataFrame) -> tuple[DataFrame, Observation]:
    """JN9: the cut segments, as ``segments.cut_segments`` gives them, and the
    count ``without_segments`` of clips that have none."""
    require_columns(clips, ["filename", "channel", "samples", "sampling_rate"], "clips")
    cuts = segments.select("filename", "channel", "segment_no", "start", "end", F.lit(True).alias("_segment"))
    both = clips.select("filename", "channel", "samples", "sampling_rate").join(cuts, ["filename", "channel"], "left")
    out, seen = counted(both, without_segments=F.col("_segment").isNull())
    return out.where(F.col("_segment").isNotNull()).select(
        "filename",
        "channel",
        "segment_no",
        segment_file_name(F.col("filename"), F.col("channel"), F.col("start"), F.col("end")).alias("segment_name"),
        cut_ms(F.col("samples"), F.col("sampling_rate"), F.col("start"), F.col("end")).alias("samples"),
    ), seen


def enriched_counted(enriched: DataFrame) -> tuple[DataFrame, Observation]:
    """UDF3: the rows of ``enrich(..., on_error="capture")`` and the count
    ``failed`` of those that carry an error."""
    require_columns(enriched, ["error"])
    return counted(enriched, failed=F.col("error").isNotNull())

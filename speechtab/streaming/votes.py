"""STM4, the running form of AGG6: tag votes that keep arriving, some of them
twice, some of them late.

Two streams, as a count over all time cannot follow a deduplication in one
update-mode query: the first admits each vote once and appends it to a table
(which is also the record of what was counted), the second counts that table's
rows as they land."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tags import INTRINSIC_TAGS_EXPANDABLE


def admitted_votes(stream: DataFrame, delay: str, id_col: str = "vote_id", time_col: str = "ts") -> DataFrame:
    """Each vote once: of rows with one ``id_col`` that come within ``delay`` of
    each other one is kept, and rows older than the watermark (the latest time
    seen in earlier micro-batches, less ``delay``) are late and dropped; the
    query counts them (:func:`run_admitted`).  State holds the ids of the last
    ``delay`` only.  Rows without an id or a time are no votes: nothing could
    tell a repeated one from a new one."""
    known = stream.where(F.col(id_col).isNotNull() & F.col(time_col).isNotNull())
    return known.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def run_admitted(stream: DataFrame, out_dir: str, checkpoint: str) -> int:
    """Append the admitted votes that are available to ``out_dir``; returns how
    many rows were late.  The figure is read from the progress of every
    micro-batch while the query runs, as only the last ones are kept."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    late: dict[int, int] = {}
    ended = False
    while not ended:
        ended = q.awaitTermination(1)
        for p in q.recentProgress:
            late[p["batchId"]] = sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"])
    return sum(late.values())


def running_votes(
    admitted: DataFrame,
    allowed: Sequence[str] | None = INTRINSIC_TAGS_EXPANDABLE,
    name_col: str = "name",
    tag_col: str = "tag",
) -> DataFrame:
    """Votes for each (name, tag) so far, for update mode; one row of state for
    each.  Tags that are NULL or not on the ``allowed`` list do not count."""
    votes = admitted.where(F.col(tag_col).isNotNull())
    if allowed is not None:
        votes = votes.where(F.col(tag_col).isin(list(allowed)))
    return votes.groupBy(name_col, tag_col).agg(F.count(F.lit(1)).alias("votes"))


def voted_tags(counts: DataFrame, min_annotations: int = 2, name_col: str = "name", tag_col: str = "tag") -> DataFrame:
    """FLT6 over running counts: per name the sorted tags with enough votes."""
    kept = counts.where(F.col("votes") >= min_annotations)
    return kept.groupBy(name_col).agg(F.sort_array(F.collect_list(tag_col)).alias("tags"))

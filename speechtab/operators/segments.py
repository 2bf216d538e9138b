"""Voice-activity segment files (SRC8, STR1, FLT5, WIN7) and cutting clips
into segments (JN9, ARR1, STR6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import cut_ms
from ..functions.text import segment_file_name


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: text lines (file, line_no, line) of one file or several.

    ``line_no`` is a struct that sorts as the lines do: by file path, by the
    start of the block of the file that a task read, and by row within that
    task.  It rests on the scan's own file metadata, so it holds for files cut
    into splits and for splits of several files packed into one task."""
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("line_no"), F.col("value").alias("line"))


def parse_segment_lines(lines: DataFrame, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """STR1 + FLT5: ``file/channel<TAB>(s, e) (s, e) ...`` -> one row per
    segment (filename, channel, segment_no, start, end, line_no).  Comment
    (``#``), blank and ``longform`` lines are skipped."""
    t = F.trim(F.col(line_col))
    kept = lines.where(~t.startswith("#") & (t != "") & ~t.contains("longform")).select(order_col, t.alias("_t"))
    head = F.split(F.col("_t"), "\t")
    key = F.split(F.element_at(head, 1), "/")
    times = F.trim(F.element_at(head, 2))
    parts = F.filter(F.split(times, "\\) "), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.split(F.regexp_replace(p, "[()]", ""), ", "))
    rows = kept.select(
        order_col,
        F.element_at(key, 1).alias("filename"),
        F.element_at(key, 2).alias("channel"),
        F.posexplode(pairs).alias("segment_no", "_p"),
    )
    return rows.select(
        "filename",
        "channel",
        F.col("segment_no").cast("int").alias("segment_no"),
        F.element_at("_p", 1).cast("double").alias("start"),
        F.element_at("_p", 2).cast("double").alias("end"),
        order_col,
    )


def first_per_key(segments: DataFrame, keys=("filename", "channel"), order_col: str = "line_no"):
    """WIN7: keep the first line per key; the rest is returned as rejects.

    The first line per key is an aggregate (partial, skew-safe); rows of other
    lines are the rejects (anti join on the line number)."""
    firsts = segments.groupBy(*keys).agg(F.min(order_col).alias(order_col))
    kept = segments.join(firsts, [*keys, order_col], "left_semi")
    rejects = segments.join(firsts, [*keys, order_col], "left_anti")
    return kept, rejects


def cut_segments(clips: DataFrame, segments: DataFrame):
    """JN9 + ARR1 + STR6: (filename, channel, segment_no, segment_name,
    samples) for every segment of an existing clip, and the clips that have
    no segment (report)."""
    joined = clips.join(segments, ["filename", "channel"], "inner")
    cut = joined.select(
        "filename",
        "channel",
        "segment_no",
        segment_file_name(F.col("filename"), F.col("channel"), F.col("start"), F.col("end")).alias("segment_name"),
        cut_ms(F.col("samples"), F.col("sampling_rate"), F.col("start"), F.col("end")).alias("samples"),
    )
    missing = clips.join(segments.select("filename", "channel"), ["filename", "channel"], "left_anti")
    return cut, missing

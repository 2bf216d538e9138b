"""Tables clustered by a key (SRT1, SNK2): rows of a speaker lie together in
one bucket, sorted, so that later joins, aggregates and windows by the key
read them where they are, without a shuffle.

A key that holds more rows than ``rows_per_part`` is cut into several parts,
so no bucket, and no task that reads it, grows with one key.  Tables are named
in the session's catalogue; their files lie in the folder that the caller
names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.speakers import seeded_order
from ..schema import require_columns

PART = "part"


def _part_of(parts: Column, id_col: Column) -> Column:
    """Part of a row among ``parts``, from its id alone (the seeded md5 order,
    its first 32 bits)."""
    head = F.conv(F.substring(seeded_order(42, F.coalesce(id_col.cast("string"), F.lit("NULL"))), 1, 8), 16, 10)
    return (head.cast("bigint") % parts).cast("int")


def save_clustered(
    df: DataFrame,
    name: str,
    path: str,
    key: str,
    id_col: str,
    buckets: int,
    rows_per_part: int = 1_000_000,
    mode: str = "errorifexists",
) -> DataFrame:
    """SRT1: the rows of ``df`` as table ``name`` under ``path``, in
    ``buckets`` buckets by (key, ``part``) and sorted by key, part and
    ``id_col`` inside each; returns the saved table.

    A key of up to ``rows_per_part`` rows has one part, 0, and lies in the
    order of its ids.  A larger one has as many parts as it needs; the
    part of a row depends on its id only, so rows that share an id stay
    together.  Only keys that need cutting are looked up by the rows.
    Rows with a NULL key are kept, as one more key.  ``df`` is read twice."""
    require_columns(df, [key, id_col])
    if PART in df.columns:
        raise ValueError(f"the table has a column {PART!r} already")
    if buckets < 1 or rows_per_part < 1:
        raise ValueError("buckets and rows_per_part are at least 1")
    large = (
        df.groupBy(F.col(key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_part)
        .select("_key", F.ceil(F.col("_rows") / rows_per_part).alias("_parts"))
    )
    placed = df.join(large, F.col(key).eqNullSafe(F.col("_key")), "left")
    part = F.when(F.col("_parts").isNull(), 0).otherwise(_part_of(F.col("_parts"), F.col(id_col)))
    return _bucketed(placed.withColumn(PART, part).select(*df.columns, PART), name, path, key, [id_col], buckets, mode)


def _bucketed(df: DataFrame, name: str, path: str, key: str, order: Sequence[str], buckets: int, mode: str) -> DataFrame:
    # the shuffle's hash is the bucket's: one task, one file for each bucket
    out = df.repartition(buckets, key, PART).write.mode(mode).format("parquet").option("path", path)
    out.bucketBy(buckets, key, PART).sortBy(key, PART, *order).saveAsTable(name)
    return df.sparkSession.table(name)


def parts_of(clustered: DataFrame, key: str) -> DataFrame:
    """The directory of a clustered table: (key, part, rows, before), where
    ``before`` counts the key's rows in earlier parts.  The rows are counted
    where they lie; only the directory's own rows are shuffled."""
    counted = clustered.groupBy(key, PART).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def save_beside(
    per_key: DataFrame, clustered: DataFrame, name: str, path: str, key: str, buckets: int, mode: str = "errorifexists"
) -> DataFrame:
    """The clustered table's directory with the columns of ``per_key`` (one row
    a key at most; NULL where a key has none), in the same buckets: one row for
    each part of each key.  :func:`attach` joins it without moving a row."""
    require_columns(per_key, [key])
    clash = {"rows", "before", PART} & set(per_key.columns)
    if clash:
        raise ValueError(f"columns of the directory: {sorted(clash)}")
    directory = parts_of(clustered, key)
    values = per_key.withColumnRenamed(key, "_key")
    both = directory.join(values, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return _bucketed(both, name, path, key, [], buckets, mode)


def attach(clustered: DataFrame, beside: DataFrame, key: str, id_col: str | None = None) -> DataFrame:
    """JN3 / JN8 on clustered tables: every row with its key's columns from
    ``beside`` (saved by :func:`save_beside` with as many buckets); neither
    side is shuffled.  Rows with a NULL key get NULL.

    With ``id_col`` a column ``position`` numbers the rows of a key from 0 in
    the table's order (part, then id): a window over one part, plus the rows
    before it.  Rows of one part that share an id are numbered in any order."""
    side = beside.drop("rows") if id_col else beside.drop("rows", "before")
    out = clustered.join(side, [key, PART], "left")
    if id_col is None:
        return out
    place = F.row_number().over(Window.partitionBy(key, PART).orderBy(id_col))
    return out.withColumn("position", F.col("before") + place - 1).drop("before")

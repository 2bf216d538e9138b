"""Sources and sinks (SRC1-SRC8, SNK1-SNK6).

Everything is a plain Spark reader or writer; no file is opened on the
driver except for the two small outputs that are by nature one document
(edges, run arguments), which are written from one-row DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import require_columns

ANNOTATION_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


# ----------------------------------------------------------------- sources --
def load_table(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split",
               fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """SRC1: a saved table, optionally one split (pushed to the scan; with a
    ``partitionBy(split)`` layout only that folder is read)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path)
    if split is not None:
        df = df.where(F.col(split_col) == split)
    return df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC2: tab-separated text with a header, fixed schema (no inference)."""
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def read_annotation_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: a JSON object ``{name: [tag, ...]}`` -> (name, tag) vote rows.

    The whole file is one JSON value, so it is parsed per file
    (``wholetext``); many such files parse in parallel."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", ANNOTATION_MAP).alias("m"))
    return parsed.select(F.explode("m").alias("name", "_tags")).select("name", F.explode("_tags").alias("tag"))


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC3, scalable layout: JSON lines ``{"name": ..., "tags": [...]}``."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    return spark.read.schema(schema).json(path).select("name", F.explode("tags").alias("tag"))


def align_embeddings(manifest: DataFrame, embeddings: DataFrame, id_col: str = "utterance_id") -> DataFrame:
    """SRC5 / JN8: embeddings joined to their manifest rows by id, never by
    position; the result has no order requirement."""
    require_columns(manifest, [id_col], "manifest")
    require_columns(embeddings, [id_col, "embedding"], "embeddings")
    return manifest.join(embeddings.select(id_col, "embedding"), [id_col], "inner")


def list_files(spark: SparkSession, root: str, suffix_glob: str = "*.wav", exclude_like: Sequence[str] = ()) -> DataFrame:
    """SRC6: files under ``root`` (recursive) matching the glob, as (path,
    length, modificationTime) -- file contents are not read."""
    df = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", suffix_glob)
        .load(root)
        .select("path", "length", "modificationTime")
    )
    for pat in exclude_like:
        df = df.where(~F.col("path").like(pat))
    return df


@dataclass(frozen=True)
class SourceSpec:
    """SRC7: one table of a mixture: folder ``name`` (and ``config`` below it),
    the split to take, its weight in the mix and its metadata table."""

    name: str
    config: str | None = None
    split: str | None = "train"
    weight: float | None = None
    metadata: str | None = None


def parse_sources(names: str, **lists: str | None) -> list[SourceSpec]:
    """``SourceSpec`` for every name of a ``+``-joined list; ``config``,
    ``split``, ``weight`` and ``metadata`` may each be such a list, as long."""
    columns = {k: v.split("+") for k, v in lists.items() if v is not None}
    every = names.split("+")
    for k, v in columns.items():
        if len(v) != len(every):
            raise ValueError(f"{k} has {len(v)} entries for {len(every)} names: {v}")
    rows = [dict(zip(columns, values)) for values in zip(*columns.values())] or [{}] * len(every)
    return [SourceSpec(n, **(r | ({"weight": float(r["weight"])} if "weight" in r else {}))) for n, r in zip(every, rows)]


def load_many(spark: SparkSession, specs: Sequence[SourceSpec], root: str | None = None, fmt: str = "parquet",
              id_col: str = "id", on_mismatch: str = "raise", seed: int = 42) -> DataFrame:
    """SRC7 + JN1 + SET1 + SET2: load each table (one split each), attach its
    metadata by id, union all by column name, tagged ``source`` and ``split``,
    and mix them if they have weights (``mix_key`` then orders the mix)."""
    from ..operators.prepare import merge_metadata, mix_sources

    weights = [sp.weight for sp in specs]
    if any(w is not None for w in weights) and None in weights:
        raise ValueError("give every source a weight, or none")

    def load(name: str, config: str | None) -> DataFrame:
        return spark.read.format(fmt).load("/".join(p for p in (root, name, config) if p))

    parts = []
    for sp in specs:
        df = load(sp.name, sp.config)
        if sp.split is not None:
            df = df.where(F.col("split") == sp.split) if "split" in df.columns else df.withColumn("split", F.lit(sp.split))
        if sp.metadata is not None:
            md = load(sp.metadata, sp.config)
            if sp.split is not None and "split" in md.columns:
                md = md.where(F.col("split") == sp.split)
            df = merge_metadata(df, md, id_col, on_mismatch=on_mismatch)
        parts.append(df.withColumn("source", F.lit(sp.name)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if weights and weights[0] is not None:
        out = mix_sources(out, {sp.name: sp.weight for sp in specs}, "source", id_col, seed)
    return out


# ------------------------------------------------------------------- sinks --
def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of the cluster's file system."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    except AttributeError:  # no JVM handle (Spark Connect): probe with a reader
        try:
            spark.read.format("binaryFile").load(path).limit(1).count()
            return True
        except Exception:  # noqa: BLE001
            return False


def save_or_reuse(spark: SparkSession, df: DataFrame, path: str, split_col: str | None = "split",
                  mode: str = "errorifexists") -> DataFrame:
    """SNK1: write the table (partitioned by split) unless it is already
    there; either way return the saved table, so later steps read it
    instead of recomputing (and lineage is cut).  A folder counts as saved
    when its write was committed (``_SUCCESS``); one that a crash left
    behind is written anew."""
    if not exists(spark, path.rstrip("/") + "/_SUCCESS"):
        w = df.write.mode("overwrite" if exists(spark, path) else mode)
        if split_col is not None and split_col in df.columns:
            w = w.partitionBy(split_col)
        w.parquet(path)
    return spark.read.parquet(path)


def write_tsv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """SNK2: manifest as TSV with a header (one file per partition)."""
    df.select(*columns).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_json_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK3: one JSON object per row, e.g. (target, parent, score, tags);
    written in parallel, never gathered into one document."""
    df.write.mode(mode).json(path)


def edges_table(edges: Mapping[str, DataFrame | Sequence[float]], spark: SparkSession | None = None) -> DataFrame:
    """SNK4: one row per metric (metric, edges) from learned one-row edge
    tables or literal lists."""
    parts = []
    for metric, e in edges.items():
        if isinstance(e, DataFrame):
            parts.append(e.select(F.lit(metric).alias("metric"), F.col("edges")))
        else:
            if spark is None:
                raise ValueError("literal edges need a session")
            parts.append(spark.createDataFrame([(metric, [float(x) for x in e])], "metric string, edges array<double>"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def save_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK4: the edge table as JSON (tiny: one row per metric)."""
    edges.coalesce(1).write.mode(mode).json(path)


def load_edges(spark: SparkSession, path: str) -> dict[str, list[float]]:
    """Edges saved by :func:`save_edges`, back as literals for BIN1 (a
    handful of numbers per metric)."""
    schema = T.StructType([T.StructField("metric", T.StringType()), T.StructField("edges", T.ArrayType(T.DoubleType()))])
    return {r["metric"]: list(r["edges"]) for r in spark.read.schema(schema).json(path).collect()}


def append_chunk(df: DataFrame, path: str, chunk_id: int) -> None:
    """SNK5: write one chunk (a ``chunk_id`` partition); reading the folder
    is the concatenation, in chunk order when sorted by ``chunk_id``.  A
    chunk written again replaces itself and no other."""
    out = df.withColumn("chunk_id", F.lit(int(chunk_id))).write.mode("overwrite").partitionBy("chunk_id")
    out.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_chunks(df: DataFrame, path: str, chunk_col: str = "chunk_id") -> list[int]:
    """SNK5 + STM3 in one pass: every chunk of ``df`` that ``path`` does not
    hold yet, each as a partition, in one write; returns the chunks that were
    there before.  A partition appears whole, when the job commits, so a run
    that was stopped goes on with what is missing.  A chunk goes through one
    task: choose chunks of bounded size (``id div rows``, say).  Rows without a
    chunk would be written again by every run, so they fail the job."""
    done = done_chunks(df.sparkSession, path, chunk_col)
    c = F.col(chunk_col)
    known = F.when(c.isNull(), F.raise_error(F.lit(f"row without a {chunk_col}")).cast("bigint")).otherwise(c.cast("bigint"))
    pending = df.withColumn(chunk_col, known)
    if done:
        pending = pending.where(~c.isin(done))
    out = pending.repartition(chunk_col).write.mode("overwrite").partitionBy(chunk_col)
    out.option("partitionOverwriteMode", "dynamic").parquet(path)
    return done


def done_chunks(spark: SparkSession, path: str, chunk_col: str = "chunk_id") -> list[int]:
    """STM3: chunk ids already written (resume after the last one)."""
    if not exists(spark, path):
        return []
    try:
        written = spark.read.parquet(path)
    except AnalysisException:  # a folder without a committed row
        return []
    return sorted(r[0] for r in written.select(chunk_col).distinct().collect())


def write_run_arguments(spark: SparkSession, args: Mapping[str, object], path: str, mode: str = "errorifexists") -> None:
    """SNK6: the run's arguments as a one-row table beside the output (ids
    travel inside the data rows, so no separate order file is needed)."""
    row = {k: (None if v is None else str(v)) for k, v in args.items()}
    schema = T.StructType([T.StructField(k, T.StringType()) for k in row])
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode(mode).json(path)


def read_run_arguments(spark: SparkSession, path: str) -> dict[str, str | None]:
    """The arguments of a saved run, as strings (one row); an argument that was
    None is not written and is missing here."""
    return {k: v for r in spark.read.option("primitivesAsString", True).json(path).collect() for k, v in r.asDict().items()}

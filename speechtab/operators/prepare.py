"""Training-table preparation (L3): merge with metadata (JN1, SET4), paths
(PRJ3, FLT1, FLT7), length and text filters (FLT2-FLT4), unions and mixing
(SET1, SET2), leading / seeded subsets (WIN5), length-grouped batches (WIN6),
per-epoch order (WIN9), descriptions (PRJ4) and column reattachment (JN2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import require_columns
from .speakers import seeded_order


# ------------------------------------------------------------------ merge --
def column_overlap(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """SET4: (columns in both, right-only columns) -- driver-side on schemas."""
    lc = set(left.columns)
    both = [c for c in right.columns if c in lc]
    only = [c for c in right.columns if c not in lc]
    return both, only


def merge_metadata(
    dataset: DataFrame,
    metadata: DataFrame,
    id_col: str = "id",
    prefer: str = "dataset",
    on_mismatch: str = "raise",
) -> DataFrame:
    """JN1: attach a metadata table to a dataset by id (equi-join).

    The ids of both sides have to correspond, one metadata row for each:
    ``on_mismatch="raise"`` (default) fails the job that finds an id on one
    side only or twice in the metadata; ``"inner"`` keeps the ids that both
    sides have, ``"left"`` all dataset rows.

    On a column-name clash the dataset copy wins (``prefer="metadata"``
    keeps the metadata copy instead).  The metadata id is kept as
    ``metadata_<id>``; :func:`merge_mismatches` lists the ids that disagree.
    """
    if on_mismatch not in ("raise", "inner", "left"):
        raise ValueError("on_mismatch is 'raise', 'inner' or 'left'")
    require_columns(dataset, [id_col], "dataset")
    require_columns(metadata, [id_col], "metadata")
    md = metadata.withColumnRenamed(id_col, f"metadata_{id_col}")
    both, _ = column_overlap(dataset, md)
    if prefer == "dataset":
        md = md.drop(*both)
        ds = dataset
    elif prefer == "metadata":
        ds = dataset.drop(*both)
    else:
        raise ValueError("prefer must be 'dataset' or 'metadata'")
    if on_mismatch != "raise":
        return ds.join(md, ds[id_col] == md[f"metadata_{id_col}"], on_mismatch)
    # the window and the join need the same partitioning: no further shuffle
    md = md.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(f"metadata_{id_col}")))
    both = ds.withColumn("_here", F.lit(True)).join(md, ds[id_col] == md[f"metadata_{id_col}"], "full_outer")

    def fail(what: str) -> Column:
        known = F.coalesce(F.col(id_col).cast("string"), F.col(f"metadata_{id_col}").cast("string"), F.lit("NULL"))
        return F.raise_error(F.concat(F.lit(f"id {what}: "), known)).cast("boolean")

    agrees = (
        F.when(F.col("_here").isNull(), fail("in the metadata but not in the dataset"))
        .when(F.col("_times").isNull(), fail("in the dataset but not in the metadata"))
        .when(F.col("_times") > 1, fail("more than once in the metadata"))
        .otherwise(F.lit(True))
    )
    # a later filter on either side's columns would turn the outer join into an inner one and
    # the check would see nothing; no filter moves below a column that is not deterministic
    checked = both.withColumn("_agrees", agrees & (F.monotonically_increasing_id() >= 0))
    return checked.where("_agrees").drop("_here", "_times", "_agrees")


def merge_mismatches(dataset: DataFrame, metadata: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids present on one side only, with the side: (id, side)."""
    d = dataset.select(id_col).distinct()
    m = metadata.select(id_col).distinct()
    return d.join(m, [id_col], "left_anti").withColumn("side", F.lit("dataset")).unionByName(
        m.join(d, [id_col], "left_anti").withColumn("side", F.lit("metadata"))
    )


def assert_merge_agrees(dataset: DataFrame, metadata: DataFrame, id_col: str = "id") -> None:
    """Raise when ids disagree (one small action: ``isEmpty``)."""
    if not merge_mismatches(dataset, metadata, id_col).isEmpty():
        raise ValueError("dataset and metadata ids do not correspond")


# ------------------------------------------------------------------ paths --
def _norm_root(root: str) -> str:
    """A root folder as a path object prints it: no repeated or trailing
    separators, no "." components (done once, on the driver)."""
    parts = [p for p in root.split("/") if p not in ("", ".")]
    return ("/" if root.startswith("/") else "") + "/".join(parts)


def _normalize_path(path: Column) -> Column:
    """Path-object normalisation of a joined path: repeated separators, "."
    components and a trailing separator go.  The regular expressions run
    only on paths that contain such parts."""
    needs = path.contains("//") | path.contains("/./") | path.endswith("/") | path.endswith("/.")
    fixed = F.regexp_replace(F.regexp_replace(path, "/(\\./)+", "/"), "/+", "/")
    fixed = F.regexp_replace(F.regexp_replace(fixed, "/\\.$", ""), "(.)/$", "$1")
    return F.when(needs, fixed).otherwise(path)


def add_audio_paths(
    df: DataFrame,
    sources: Sequence[str],
    roots: Sequence[str],
    source_col: str = "source",
    rel_col: str = "relative_audio_path",
    out_col: str = "audio_path",
) -> DataFrame:
    """PRJ3: ``out_col`` = root(source) / relative path; an unknown source
    fails the job.  The mapping is a literal CASE choosing the (driver-side
    normalised) root prefix, so no join is needed; an absolute relative path
    replaces the root, as with path objects."""
    if len(sources) != len(roots):
        raise ValueError(f"{len(sources)} sources but {len(roots)} roots: pass one root for each source")
    src = F.col(source_col)
    rel = F.col(rel_col)
    prefix = None
    for s_, r in zip(sources, roots):
        root = _norm_root(r)
        p = F.lit(root if root in ("", "/") else root + "/")
        prefix = F.when(src == F.lit(s_), p) if prefix is None else prefix.when(src == F.lit(s_), p)
    err = F.raise_error(F.concat(F.lit("no root was given for source: "), F.coalesce(src.cast("string"), F.lit("NULL")))).cast("string")
    path = F.when(rel.startswith("/"), rel).otherwise(F.concat(prefix, rel))
    joined = F.when(src.isin(list(sources)), path).otherwise(err) if sources else err
    # two steps, so the joined path is built once and then only inspected
    return df.withColumn(out_col, joined).withColumn(out_col, _normalize_path(F.col(out_col)))


def missing_paths(df: DataFrame, listing: DataFrame, path_col: str = "audio_path", listing_col: str = "path") -> DataFrame:
    """FLT1: rows whose path is not in the file listing (left anti join)."""
    lst = listing.select(F.col(listing_col).alias(path_col))
    return df.join(lst, [path_col], "left_anti")


def pending_work(df: DataFrame, completed: DataFrame, key: str | list) -> DataFrame:
    """FLT7 / STM3 (batch): items not yet done (left anti join on the key)."""
    return df.join(completed, key, "left_anti")


# ---------------------------------------------------------------- filters --
def text_shorter_than(df: DataFrame, col: str, max_chars: int = 500) -> DataFrame:
    """FLT2: characters strictly below the limit."""
    return df.where(F.length(col) < max_chars)


def length_bounds(min_seconds: float, max_seconds: float, sampling_rate: int) -> tuple[int, int]:
    return int(min_seconds * sampling_rate), int(max_seconds * sampling_rate)


def length_in_range(df: DataFrame, length_col: str, min_seconds: float, max_seconds: float, sampling_rate: int) -> DataFrame:
    """FLT3: ``int(min*rate) < length < int(max*rate)`` (both strict)."""
    lo, hi = length_bounds(min_seconds, max_seconds, sampling_rate)
    c = F.col(length_col)
    return df.where((c > lo) & (c < hi))


def tokens_below(df: DataFrame, tokens_col: str, max_tokens: int) -> DataFrame:
    """FLT4: token count strictly below the limit (``tokens_col`` holds the
    token array, or already the count)."""
    c = F.col(tokens_col)
    n = c if not isinstance(df.schema[tokens_col].dataType, T.ArrayType) else F.size(c)
    return df.where(n < max_tokens)


# ------------------------------------------------------- unions and mixes --
def concat_tables(tables: Sequence[DataFrame], names: Sequence[str] | None = None, name_col: str = "source") -> DataFrame:
    """SET1: union by column name (missing columns become NULL); with
    ``names`` each part is tagged in ``name_col``."""
    parts = list(tables)
    if names is not None:
        if len(names) != len(parts):
            raise ValueError("one name per table")
        parts = [t.withColumn(name_col, F.lit(n)) for t, n in zip(parts, names)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def hash_fraction(seed, key: Column) -> Column:
    """Uniform [0, 1) number from md5(seed:key) (first 32 bits)."""
    h = F.conv(F.substring(seeded_order(seed, key), 1, 8), 16, 10).cast("bigint")
    return h.cast("double") / F.lit(4294967296.0)


def mix_sources(
    df: DataFrame,
    probabilities: Mapping[str, float],
    source_col: str = "source",
    id_col: str = "id",
    seed: int = 42,
) -> DataFrame:
    """SET2 (batch form of probability interleaving, stop at first exhausted).

    With source sizes r_i and probabilities p_i the stream stops after about
    n = min_i r_i / p_i draws, of which p_i * n come from source i.  Each
    row of source i is kept when its seeded hash fraction is below
    p_i * n / r_i, so the choice is per row (no window, no hot task) and
    reproducible; ``mix_key``, salted differently, gives the interleaved
    order, in which every stretch holds the sources in proportion.  Only sources
    named in ``probabilities`` take part; one of them without a row is exhausted
    at once, so nothing is kept.
    """
    total = float(sum(probabilities.values()))
    probs = {k: v / total for k, v in probabilities.items() if v > 0}
    part = df.where(F.col(source_col).isin(list(probs)))
    sizes = part.groupBy(source_col).agg(F.count(F.lit(1)).alias("_r"))
    p_expr = None
    for k, v in probs.items():
        p_expr = F.when(F.col(source_col) == k, F.lit(v)) if p_expr is None else p_expr.when(F.col(source_col) == k, F.lit(v))
    sizes = sizes.withColumn("_p", p_expr)
    n = sizes.agg(F.when(F.count(F.lit(1)) == len(probs), F.min(F.col("_r") / F.col("_p"))).otherwise(0.0).alias("n")).scalar()
    # one row per named source: bounded by the caller's list
    frac = F.broadcast(sizes.select(source_col, (F.col("_p") * n / F.col("_r")).alias("_keep")))
    u = hash_fraction(seed, F.col(id_col))
    return (
        part.join(frac, [source_col], "inner")
        .where(u < F.col("_keep"))
        .drop("_keep")
        .withColumn("mix_key", seeded_order(f"{seed}:order", F.col(id_col)))
    )


# ------------------------------------------------------ subsets / orders --
def first_rows(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """WIN5: first n rows by a key (top-k: TakeOrderedAndProject)."""
    return df.orderBy(order_col).limit(n)


def seeded_subset(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """WIN5: seeded shuffle, then the first n rows (top-k by md5 order)."""
    return df.withColumn("_o", seeded_order(seed, F.col(id_col))).orderBy("_o", id_col).limit(n).drop("_o")


def epoch_order(df: DataFrame, id_col: str, epochs: Sequence[int], seed: int = 42) -> DataFrame:
    """WIN9: per-epoch order key md5(seed:epoch:id); sort by it (or
    ``repartitionByRange``) to get that epoch's shuffle."""
    ep = F.explode(F.array(*[F.lit(int(e)) for e in epochs])).alias("epoch")
    out = df.select("*", ep)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col(id_col).cast("string")))
    return out.withColumn("order_key", key)


def length_batches(
    df: DataFrame,
    id_col: str,
    length_col: str,
    batch_size: int,
    megabatch_rows: int = 50 * 8,
    seed: int = 42,
    n_rows: int | None = None,
) -> DataFrame:
    """WIN6: similar lengths share a batch.  Rows are dealt into seeded
    mega-batches of about ``megabatch_rows`` (hash shard, so no global sort
    and no hot partition), sorted by length descending inside each, and cut
    into batches of ``batch_size``.  Output adds (megabatch, batch, position)."""
    # without a given row count, one scalar subquery of the same plan counts
    n = F.lit(n_rows) if n_rows is not None else df.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_mb = F.greatest(F.lit(1), F.ceil(n / F.lit(megabatch_rows))).cast("bigint")
    shard = F.pmod(F.conv(F.substring(seeded_order(seed, F.col(id_col)), 1, 8), 16, 10).cast("bigint"), n_mb)
    out = df.withColumn("megabatch", shard)
    w = Window.partitionBy("megabatch").orderBy(F.col(length_col).desc(), F.col(id_col))
    out = out.withColumn("position", F.row_number().over(w))
    return out.withColumn("batch", F.floor((F.col("position") - 1) / batch_size).cast("bigint"))


def explode_descriptions(df: DataFrame, col: str = "text_description", out_col: str = "description", keep_empty: bool = False) -> DataFrame:
    """PRJ4: one row per style description (with its index).  A row whose list
    is NULL or empty gives none, or with ``keep_empty`` one without index and
    description."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select("*", explode(col).alias("description_index", out_col)).drop(col)


def reattach(base: DataFrame, computed: DataFrame, id_col: str, renames: Mapping[str, str] | None = None) -> DataFrame:
    """JN2 (+ PRJ2): add separately computed columns back by id (never by
    position), optionally renaming them."""
    if renames:
        computed = computed.withColumnsRenamed(dict(renames))
    return base.join(computed, [id_col], "left")

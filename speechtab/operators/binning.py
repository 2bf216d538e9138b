"""Learned bin edges (AGG2, AGG3), speaker-level pitch labels (AGG1, JN3,
BIN2) and the histogram tables behind the reference's plots (AGG18).

Edges are a global statistic, so they are computed by aggregates that Spark
runs with map-side partial aggregation (one small row per task crosses the
shuffle) and handed to the row-level expressions as a scalar subquery: no
join, no driver round trip, and the plan stays lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import bin_label, gender_bin_label
from ..schema import require_columns


def _valid(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v)


def _finite(v: Column) -> Column:
    d = v.cast("double")
    return _valid(v) & (F.abs(d) != float("inf"))


def _edges_from_bounds(lo: Column, hi: Column, n_bins: int) -> Column:
    """``n_bins + 1`` equal-width edges over lo..hi, last edge exactly hi.

    Same arithmetic as an equal-width histogram: edge_i = i * ((hi-lo)/n) + lo.
    """
    step = (hi - lo) / F.lit(float(n_bins))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bins)),
        lambda i: F.when(i == F.lit(n_bins), hi).otherwise(i.cast("double") * step + lo),
    )


def _outer_bounds(lo: Column, hi: Column, n_kept: Column, lower_range: float | None):
    """Histogram range rules: empty data -> 0..1, equal bounds widen by 0.5."""
    if lower_range is not None:
        lo = F.lit(float(lower_range))
        hi = F.when(n_kept > 0, hi)
        lo = F.when(hi.isNull(), F.lit(None).cast("double")).otherwise(lo)
        lo = F.when(lo > hi, F.raise_error(F.lit("lower range above the largest value")).cast("double")).otherwise(lo)
    else:
        lo = F.when(n_kept > 0, lo).otherwise(F.lit(0.0))
        hi = F.when(n_kept > 0, hi).otherwise(F.lit(1.0))
    same = lo == hi
    return (F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi))


def select_for_edges(df: DataFrame, value_col: str, split_col: str | None = None, leading_split: str | None = None) -> DataFrame:
    """FLT8 + FLT9: rows of splits whose name contains ``leading_split`` (all when
    None), with NULL, NaN and infinite values removed (no equal-width edges
    lead to infinity)."""
    v = F.col(value_col)
    out = df
    if leading_split is not None:
        if split_col is None:
            raise ValueError("leading_split needs split_col")
        out = out.where(F.col(split_col).contains(leading_split))
    keep = [c for c in df.columns if c != value_col]
    return out.where(_finite(v)).select(v.cast("double").alias("v"), *keep)


def learn_edges(
    df: DataFrame,
    value_col: str,
    n_bins: int,
    std_tolerance: float | None = None,
    lower_range: float | None = None,
    split_col: str | None = None,
    leading_split: str | None = None,
    group_cols: Sequence[str] = (),
) -> DataFrame:
    """AGG2 (and AGG3 with ``group_cols``): one row per group holding
    ``edges array<double>`` (n_bins + 1), plus the statistics used.

    Outliers are values with ``|v - mean| >= tol * std_pop`` (dropped); std 0
    therefore keeps nothing.  ``lower_range=None`` means unset; 0.0 is a real
    lower bound here (the reference treats 0.0 as unset).
    """
    require_columns(df, [value_col, *group_cols])
    keys = [F.col(c) for c in group_cols]
    base = select_for_edges(df.select(value_col, *group_cols, *([split_col] if split_col else [])), value_col, split_col, leading_split)
    base = base.select("v", *keys) if group_cols else base.select("v")
    if std_tolerance is not None:
        stats = base.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
        if group_cols:
            # one row per group, joined by the group key (AQE broadcasts it
            # when its measured size is small)
            kept = base.join(stats, list(group_cols), "inner")
        else:
            st = stats.select(F.struct("mean", "std").alias("s")).scalar()
            kept = base.withColumn("mean", st["mean"]).withColumn("std", st["std"])
        kept = kept.where(F.abs(F.col("v") - F.col("mean")) < F.lit(float(std_tolerance)) * F.col("std"))
    else:
        kept = base
    bounds = kept.groupBy(*keys).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n_kept")
    )
    if group_cols:
        # groups with nothing kept still need a row (edges 0..1)
        all_groups = base.select(*keys).distinct()
        bounds = all_groups.join(bounds, list(group_cols), "left").fillna({"n_kept": 0})
    lo, hi = _outer_bounds(F.col("lo"), F.col("hi"), F.col("n_kept"), lower_range)
    return bounds.select(*keys, _edges_from_bounds(lo, hi, n_bins).alias("edges"), F.col("n_kept"))


def edges_column(edges_df: DataFrame) -> Column:
    """The single ``edges`` array of a one-row edges table, as a scalar subquery."""
    return edges_df.select("edges").scalar()


def apply_bins(df: DataFrame, value_col: str, out_col: str, labels: Sequence[str], edges) -> DataFrame:
    """BIN1 on a table: ``edges`` is a literal list, an array Column, or a
    one-row edges DataFrame from :func:`learn_edges`."""
    if isinstance(edges, DataFrame):
        edges = edges_column(edges)
    return df.withColumn(out_col, bin_label(F.col(value_col), edges, labels))


def label_by_learned_bins(
    df: DataFrame,
    value_col: str,
    out_col: str,
    labels: Sequence[str],
    std_tolerance: float | None = None,
    lower_range: float | None = None,
    split_col: str | None = None,
    leading_split: str | None = None,
) -> DataFrame:
    """AGG2 + BIN1: learn edges on the (leading) splits, label every row."""
    edges = learn_edges(df, value_col, len(labels), std_tolerance, lower_range, split_col, leading_split)
    return apply_bins(df, value_col, out_col, labels, edges)


def speaker_means(df: DataFrame, speaker_col: str, value_col: str, gender_col: str, order_col: str) -> DataFrame:
    """AGG1: per speaker, mean of ``value_col`` skipping NaN and the first
    non-null gender by ``order_col``; NULL speaker keys are dropped.

    The pass over all utterances is a hash aggregate of numbers by speaker and
    gender; the first gender is then picked among the few rows of a speaker."""
    require_columns(df, [speaker_col, value_col, gender_col, order_col])
    v = F.col(value_col)
    g = F.col(gender_col)
    per_gender = df.where(F.col(speaker_col).isNotNull()).groupBy(speaker_col, gender_col).agg(
        F.sum(F.when(_valid(v), v.cast("double"))).alias("_s"),
        F.count(F.when(_valid(v), F.lit(1))).alias("_n"),
        F.min(order_col).alias("_o"),
    )
    return per_gender.groupBy(speaker_col).agg(
        F.when(F.sum("_n") > 0, F.sum("_s") / F.sum("_n")).alias(value_col),
        F.min_by(g, F.when(g.isNotNull(), F.col("_o"))).alias(gender_col),
    )


GENDERS = ("male", "female")


def speaker_pitch_labels(
    df: DataFrame,
    labels: Sequence[str],
    speaker_col: str = "speakerid",
    gender_col: str = "gender",
    value_col: str = "utterance_pitch_mean",
    out_col: str = "pitch",
    order_col: str = "utterance_id",
    std_tolerance: float | None = 2.0,
    edges_by_gender=None,
) -> DataFrame:
    """AGG1 + AGG3 + BIN2 + JN3: speaker-level pitch label, relative to gender.

    Returns the input rows with ``out_col`` added.  When ``edges_by_gender``
    (``{"male": [...], "female": [...]}``) is given the edges are not learnt.
    """
    speakers = speaker_means(df, speaker_col, value_col, gender_col, order_col)
    if edges_by_gender is None:
        edges = learn_edges(
            speakers.where(F.col(gender_col).isin(*GENDERS)), value_col, len(labels), std_tolerance, group_cols=[gender_col]
        )
        # at most one row per known gender: a proven size bound for broadcast
        spk = speakers.join(F.broadcast(edges.select(gender_col, "edges")), [gender_col], "left")
        spk = spk.select(
            speaker_col,
            bin_label(F.col(value_col), F.col("edges"), labels).alias(out_col),
        )
    else:
        spk = speakers.select(
            speaker_col, gender_bin_label(F.col(value_col), F.col(gender_col), edges_by_gender, labels).alias(out_col)
        )
    return df.join(spk, [speaker_col], "left")


def _with_bucket(df: DataFrame, v: str, lo: str, hi: str, n_bins: int, out: str) -> DataFrame:
    """Add ``out``: 0-based equal-width bucket of ``v`` over lo..hi, half-open
    bins except the last, exact with respect to the edges
    i * ((hi-lo)/n) + lo.  Staged column by column so no expression is
    repeated inside another."""
    step = (F.col(hi) - F.col(lo)) / F.lit(float(n_bins))

    def edge(i):
        return F.when(i == F.lit(n_bins), F.col(hi)).otherwise(i.cast("double") * step + F.col(lo))

    raw = (F.col(v) - F.col(lo)) * (F.lit(float(n_bins)) / (F.col(hi) - F.col(lo)))
    # clamped as a double: a value far outside lo..hi does not fit an int
    df = df.withColumn(out, F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(n_bins - 1))).cast("int"))
    i = F.col(out)
    df = df.withColumn(out, F.when(F.col(v) < edge(i), i - 1).otherwise(i))
    i = F.col(out)
    return df.withColumn(out, F.when((F.col(v) >= edge(i + 1)) & (i != n_bins - 1), i + 1).otherwise(i))


def histogram_table(df: DataFrame, value_col: str, n_bins: int = 100, std_tolerance: float | None = None) -> DataFrame:
    """AGG18: the histogram behind the reference's plots, as a table.

    ``stage`` is ``before`` (NaN, NULL and infinite values dropped) and, when ``std_tolerance`` is
    given, ``after`` (outliers dropped).  Bins are equal width over min..max,
    half-open except the last, and every bin is listed (zero counts too).
    Two scalar statistics (all values; kept values) and one counting pass
    over the data, whatever the number of stages.
    """
    base = df.where(_finite(F.col(value_col))).select(F.col(value_col).cast("double").alias("v"))

    def bounds_row(agg_df: DataFrame, extra=()) -> Column:
        # final histogram range computed inside the one-row statistics plan,
        # so the main plan only reads a few fields of one scalar subquery
        lo, hi = _outer_bounds(F.col("lo"), F.col("hi"), F.col("n"), None)
        return agg_df.select(F.struct(*extra, lo.alias("lo"), hi.alias("hi")).alias("s")).scalar()

    st1 = base.agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.count(F.lit(1)).alias("n"),
    )
    s1 = bounds_row(st1, (F.col("mean"), F.col("std")))
    stages = [("before", F.lit(True), s1["lo"], s1["hi"])]
    if std_tolerance is not None:
        keep = F.abs(F.col("v") - s1["mean"]) < F.lit(float(std_tolerance)) * s1["std"]
        st2 = base.where(keep).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
        s2 = bounds_row(st2)
        stages.append(("after", keep, s2["lo"], s2["hi"]))
    staged = base.select(
        "v", *[c.alias(f"_k{i}") for i, (_, c, _, _) in enumerate(stages)],
        *[x.alias(f"_lo{i}") for i, (_, _, x, _) in enumerate(stages)],
        *[x.alias(f"_hi{i}") for i, (_, _, _, x) in enumerate(stages)],
    )
    for i in range(len(stages)):
        staged = _with_bucket(staged, "v", f"_lo{i}", f"_hi{i}", n_bins, f"_b{i}")
    tagged = staged.select(
        F.explode(
            F.array(
                *[
                    F.when(F.col(f"_k{i}"), F.struct(F.lit(name).alias("stage"), F.col(f"_b{i}").alias("bucket")))
                    for i, (name, _, _, _) in enumerate(stages)
                ]
            )
        ).alias("b")
    ).where(F.col("b").isNotNull())
    counts = tagged.groupBy(F.col("b.stage").alias("stage"), F.col("b.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grids = []
    for name, _, lo, hi in stages:
        g = base.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bucket"), lo.alias("_lo"), hi.alias("_hi"))
        step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_bins))
        b = F.col("bucket")
        grids.append(
            g.select(
                F.lit(name).alias("stage"),
                "bucket",
                (b.cast("double") * step + F.col("_lo")).alias("lower"),
                F.when(b + 1 == F.lit(n_bins), F.col("_hi")).otherwise((b + 1).cast("double") * step + F.col("_lo")).alias("upper"),
            )
        )
    grid = grids[0]
    for g in grids[1:]:
        grid = grid.unionByName(g)
    return grid.join(counts, ["stage", "bucket"], "left").select(
        "stage", "bucket", "lower", "upper", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")
    )


def distribution_tables(
    df: DataFrame,
    value_col: str,
    n_labels: int,
    n_bins: int = 100,
    std_tolerance: float | None = None,
    lower_range: float | None = None,
    group_col: str | None = None,
    groups: Sequence[str] = (),
) -> DataFrame:
    """AGG18 in full: the distributions drawn over each other, with the label
    edges drawn into them.

    A series is a group (each of ``groups``, the values of ``group_col`` that
    count; one series named ``all`` without it) at a stage: ``before`` and, with
    ``std_tolerance``, ``after`` its group's outliers are dropped.  Rows
    ``series, stage, bucket, lower, upper, n, label_edges``: ``n_bins`` bins over
    the series' own min..max, empty ones too, and the ``n_labels + 1`` edges
    that labels learned from the series have, from ``lower_range`` on if given
    (NULL for a series without values then, 0..1 otherwise).  NULL, NaN and
    infinite values are left out.

    Every series is counted in the same pass, each row once for each stage; the
    groups' statistics (two aggregates of one row a group) are columns of it."""
    require_columns(df, [value_col, *([group_col] if group_col else [])])
    names = list(groups) if group_col else ["all"]
    series = F.col(group_col).cast("string") if group_col else F.lit("all")
    base = df.where(_finite(F.col(value_col)) & series.isin(names)).select(F.col(value_col).cast("double").alias("v"), series.alias("series"))

    def statistics(d: DataFrame) -> Column:
        one = d.groupBy("series").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
        return one.agg(F.map_from_entries(F.collect_list(F.struct("series", F.struct("mean", "std", "lo", "hi", "n")))).alias("m")).scalar()

    def ends(of: str, series: str = "series") -> list[Column]:
        s = F.element_at(of, F.col(series))
        return list(_outer_bounds(s["lo"], s["hi"], F.coalesce(s["n"], F.lit(0)), None))

    maps = {"before": statistics(base)}
    staged = base.withColumn("_before", maps["before"])
    stages = [("before", F.lit(True))]
    if std_tolerance is not None:
        s = F.element_at("_before", F.col("series"))
        keep = F.abs(F.col("v") - s["mean"]) < F.lit(float(std_tolerance)) * s["std"]
        maps["after"] = statistics(staged.where(keep))
        staged = staged.withColumn("_after", maps["after"])
        stages.append(("after", keep))
    shown = [F.when(k, F.struct(F.lit(name).alias("stage"), *[x.alias(a) for x, a in zip(ends(f"_{name}"), ("_lo", "_hi"))])) for name, k in stages]
    rows = staged.select("series", "v", F.explode(F.array(*shown)).alias("_x")).where("_x IS NOT NULL").select("series", "v", "_x.*")
    counts = _with_bucket(rows, "v", "_lo", "_hi", n_bins, "bucket").groupBy("series", "stage", "bucket").agg(F.count(F.lit(1)).alias("n"))

    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(g).alias("series"), F.lit(st).alias("stage")) for g in names for st, _ in stages])).alias("_s")).select("_s.*")
    for name in maps:
        grid = grid.withColumn(f"_{name}", maps[name])
    of = F.when(F.col("stage") == "before", F.element_at("_before", F.col("series")))
    if "after" in maps:
        of = of.otherwise(F.element_at("_after", F.col("series")))
    grid = grid.select("series", "stage", of.alias("_st"))
    n = F.coalesce(F.col("_st.n"), F.lit(0))
    lo, hi = _outer_bounds(F.col("_st.lo"), F.col("_st.hi"), n, None)
    first, last = _outer_bounds(F.col("_st.lo"), F.col("_st.hi"), n, lower_range)
    grid = grid.select("series", "stage", lo.alias("_lo"), hi.alias("_hi"), _edges_from_bounds(first, last, n_labels).alias("label_edges"), F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bucket"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_bins))
    b = F.col("bucket")
    return grid.join(counts, ["series", "stage", "bucket"], "left").select(
        "series",
        "stage",
        "bucket",
        (b.cast("double") * step + F.col("_lo")).alias("lower"),
        F.when(b + 1 == F.lit(n_bins), F.col("_hi")).otherwise((b + 1).cast("double") * step + F.col("_lo")).alias("upper"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"),
        "label_edges",
    )

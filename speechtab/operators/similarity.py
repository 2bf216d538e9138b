"""Speaker similarity: median vectors (AGG5), similarity threshold join with
per-source top-k (JN4, WIN2), best source per target (WIN3) and pair scoring
(JN7, AGG13).

The threshold join is the one operator with no Spark built-in.  Angles between
unit vectors obey the triangle inequality, so vectors are grouped by nearest
pivot and by their angle to it into blocks of bounded size, and each block
knows its least and greatest angle to every pivot.  Two blocks whose intervals
lie further apart than the threshold's angle cannot hold a pair; only the
others meet, in a cogrouped call that multiplies two small matrices.  Within
it a source's k-th best score so far is the threshold that later targets have
to beat.  The global top-k is then a ``row_number`` limit that Spark
pre-applies map-side.  No cross join, no pair list per group, and the data a
task holds is bounded by the block size, not by the input.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_double_array, cos_to_rating, dot, l2_normalize
from ..schema import require_columns
from ..session import materialize


#: Vectors of a group whose components are sorted in place; of larger groups
#: only counts travel.
GATHERED = 1024
#: Parts that the rows of a large group are dealt over.
SALTS = 64
#: Buckets of a selection round, and rounds after the first: the first finds a
#: sixteenth of an octave, which holds 2**48 doubles, each further one 1/2**16
#: of what is left, the last parts two neighbours.
BUCKETS, ROUNDS = 65_536, 4


def _middle(values: Column) -> Column:
    """Median of an array: the mean of the two middle values, NaN if there is
    a NaN, NULL of none."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    mid = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    return F.when(F.isnan(F.get(v, n - 1)), F.lit(float("nan"))).otherwise(mid)


def _medians_of_small(rows: DataFrame, key: str) -> DataFrame:
    groups = rows.groupBy(key).agg(F.collect_list("_v").alias("_vs"))
    dims = F.sequence(F.lit(0), F.array_max(F.transform("_vs", lambda v: F.size(v))) - 1)
    median = F.transform(dims, lambda i: _middle(F.transform("_vs", lambda v: F.get(v, i))))
    empty = F.array_max(F.transform("_vs", lambda v: F.size(v))) == 0
    return groups.select(key, F.when(empty, F.array().cast("array<double>")).otherwise(median).alias("median"))


def _log_bucket(x: Column) -> Column:
    """A number that grows with ``x``, 16 steps an octave; NaN for NaN."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x)) * 16).cast("double") + 20_000))


def _picked(hist: DataFrame, group: list[str], ranks: Column) -> DataFrame:
    """For each group the buckets that hold the wanted places: ``hist`` has
    ``_c`` values from ``_lo`` to ``_hi`` in each ``_b``; ``ranks`` gives the
    places (an array) from the group's ``_n``.  Rows ``_lo, _hi, _r`` with the
    place inside the bucket."""
    sorted_ = hist.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_b", "_c", "_lo", "_hi"))).alias("_h"), F.sum("_c").alias("_n"), F.first("_r").alias("_r"))

    def find(rank: Column) -> Column:
        start = F.struct(rank.alias("left"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("bigint").alias("r"))

        def step(acc: Column, b: Column) -> Column:
            here = acc["r"].isNull() & (acc["left"] < b["_c"])
            return F.struct(
                (acc["left"] - b["_c"]).alias("left"),
                F.when(here, b["_lo"]).otherwise(acc["lo"]).alias("lo"),
                F.when(here, b["_hi"]).otherwise(acc["hi"]).alias("hi"),
                F.when(here, acc["left"]).otherwise(acc["r"]).alias("r"),
            )

        return F.aggregate("_h", start, step)

    found = sorted_.select(*group, F.isnan(F.get("_h", F.size("_h") - 1)["_hi"]).alias("_nan"), F.explode(F.transform(ranks, find)).alias("_f"))
    nan = F.lit(float("nan"))
    return found.select(*group, F.when(F.col("_nan"), nan).otherwise(F.col("_f.lo")).alias("_lo"), F.when(F.col("_nan"), nan).otherwise(F.col("_f.hi")).alias("_hi"), F.col("_f.r").alias("_r"))


def _medians_of_large(rows: DataFrame, key: str) -> DataFrame:
    """Selection by histogram: count a dimension's values by bucket, keep the
    bucket with the middle one, count again inside it.  A bucket knows its least
    and greatest value, so a dimension is done when they are the same.  Only
    counts are shuffled (a task sends at most one for each bucket), and each
    round reads the rows anew instead of moving exploded values."""
    counted = [F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    first = rows.select(key, F.posexplode("_v").alias("_dim", "_x")).where("_x IS NOT NULL")
    hist = first.groupBy(key, "_dim", _log_bucket(F.col("_x")).alias("_b")).agg(*counted).withColumn("_r", F.lit(None).cast("bigint"))
    both = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    open_ = _picked(hist, [key, "_dim"], both)
    done = None
    for _ in range(ROUNDS):
        found = open_.where(F.col("_lo") == F.col("_hi")).select(key, "_dim", "_lo")
        done = found if done is None else done.unionAll(found)
        open_ = open_.where(F.col("_lo") != F.col("_hi"))
        wanted = open_.groupBy(key).agg(F.collect_list(F.struct("_dim", "_lo", "_hi", "_r")).alias("_w"))
        wanted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = rows.join(wanted, [key, "_salt"]).select(key, "_v", F.explode("_w").alias("_w")).select(key, F.get("_v", F.col("_w._dim")).alias("_x"), "_w.*")
        near = near.where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
        bucket = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS).cast("double")
        place = F.struct(F.col("_lo"), F.col("_hi"), F.col("_r")).alias("_of")
        hist = near.select(key, "_dim", place, bucket.alias("_b"), "_x").groupBy(key, "_dim", "_of", "_b").agg(*counted).withColumn("_r", F.col("_of._r"))
        open_ = _picked(hist, [key, "_dim", "_of"], F.array("_r")).drop("_of")
    done = done.unionAll(open_.select(key, "_dim", "_lo"))
    med = done.groupBy(key, "_dim").agg(F.avg("_lo").alias("_m"))
    pairs = med.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_dim", "_m"))).alias("_s"))
    dims = rows.groupBy(key).agg(F.max(F.size("_v")).alias("_d"))
    return dims.join(pairs, key, "left").select(key, F.when(F.col("_d") == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("_d") - 1), lambda i: F.get(F.array(F.element_at("_s", i)), F.lit(0)))).alias("median"))


def median_vectors(df: DataFrame, key: str = "speaker", vec: str = "embedding", normalize: bool = True, gathered: int = GATHERED) -> DataFrame:
    """AGG5 (+ MTH4): element-wise median of each group's vectors, L2-normalised.

    One rule for groups of any size: a dimension's median is over the vectors
    that have a value there (NULL components and missing ends of shorter
    vectors do not count; NULL if none has one), the mean of the two middle
    values for an even number, and NaN where any of them is NaN.  Rows with a
    NULL key or vector are left out.

    Groups of up to ``gathered`` vectors are shuffled once and sorted in place.
    In larger ones, if a first look at the keys alone finds any, the middle is
    selected by histogram, with rows dealt over many tasks and nothing gathered
    but counts."""
    require_columns(df, [key, vec])
    rows = df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(key, as_double_array(F.col(vec)).alias("_v"))
    large = df.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > gathered).select(key)
    if large.isEmpty():
        med = _medians_of_small(rows, key)
    else:
        large = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
        med = _medians_of_small(rows.join(large, [key, "_salt"], "left_anti"), key)
        med = med.unionByName(_medians_of_large(rows.join(large, [key, "_salt"], "left_semi"), key))
    if normalize:
        med = med.withColumn("median", l2_normalize(F.col("median")))
    return med


# -------------------------------------------------------- similarity join --
#: Pivots, and the vectors (of least hash) that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 16, 256
#: Targets of a cell that are scored at once.
CHUNK = 512


def _pivots(vectors: DataFrame) -> DataFrame:
    """One row ``p``: up to ``PIVOTS`` vectors of a bounded sample, each the
    furthest from those before it."""
    sample = vectors.select("vec", F.xxhash64("vec").alias("_h")).orderBy("_h").limit(PIVOT_SAMPLE)
    one = sample.agg(F.sort_array(F.collect_list(F.struct("_h", "vec"))).alias("_s")).select(F.transform("_s", lambda s: s["vec"]).alias("_s"))
    first = F.get("_s", F.lit(0))
    start = F.struct(F.array(first).alias("p"), F.transform("_s", lambda v: dot(v, first)).alias("near"))

    def step(acc: Column, _: Column) -> Column:
        new = F.get("_s", (F.array_position(acc["near"], F.array_min(acc["near"])) - 1).cast("int"))
        return F.struct(F.concat(acc["p"], F.array(new)).alias("p"), F.zip_with(acc["near"], F.col("_s"), lambda n, v: F.greatest(n, dot(v, new))).alias("near"))

    chosen = F.aggregate(F.sequence(F.lit(2), F.lit(PIVOTS)), start, step)
    return one.select(F.when(F.size("_s") > 0, chosen["p"]).otherwise(F.array().cast("array<array<double>>")).alias("p"))


def _constant(value: object, kind: str) -> Column:
    """A value of few bytes as a literal of a nested type."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _zoned(vectors: DataFrame, pivots: Column, width: float) -> DataFrame:
    """``vectors`` with their angles ``_a`` to the pivots and their ``zone``: the
    nearest pivot and a ring of angles to it."""
    angles = F.transform(pivots, lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(p, F.col("vec"))))))
    v = vectors.withColumn("_a", angles).withColumn("_own", F.coalesce(F.array_min("_a"), F.lit(0.0)))
    cell = F.coalesce(F.array_position("_a", F.col("_own")), F.lit(0))
    return v.withColumn("zone", cell * 1000 + F.floor(F.col("_own") / width)).drop("_own")


def _groups(sizes: dict[int, int], block_rows: int) -> dict[str, list[int]]:
    """zone -> (group, blocks of the group): the rings of a pivot become one
    group as long as they fit one block, and so do all zones of a small table,
    so that cells are worth a call."""
    out, members, held = {}, [], 0
    one = sum(sizes.values()) <= block_rows

    def close() -> None:
        for z in members:
            out[str(z)] = [members[0], max(1, math.ceil(held / block_rows))]

    for zone in sorted(sizes):
        if members and not one and (held + sizes[zone] > block_rows or zone // 1000 != members[0] // 1000):
            close()
            members, held = [], 0
        members.append(zone)
        held += sizes[zone]
    close()
    return out


def _blocked(zoned: DataFrame, key: str, groups: dict[str, list[int]]) -> DataFrame:
    """Zoned vectors with their group as ``zone`` and their ``block``: a group is
    cut by a hash of the key."""
    v = zoned.withColumn("_g", F.element_at(_constant(groups, "map<string,array<bigint>>"), F.col("zone").cast("string")))
    block = F.get("_g", F.lit(0)) * (1 << 40) + F.pmod(F.xxhash64(key), F.get("_g", F.lit(1)))
    return v.withColumn("zone", F.get("_g", F.lit(0))).withColumn("block", block).drop("_g")


def _blocks(blocked: DataFrame) -> DataFrame:
    """The blocks: ``block, zone, n`` and their least and greatest angles
    ``lo``, ``hi`` to each pivot."""

    def ends(how: str) -> Column:
        return F.expr("array(" + ", ".join(f"{how}(_a[{i}])" for i in range(PIVOTS)) + ")")

    return blocked.groupBy("block", "zone").agg(ends("min").alias("lo"), ends("max").alias("hi"), F.count(F.lit(1)).alias("n"))


def _apart(lo1: Column, hi1: Column, lo2: Column, hi2: Column, reach: float) -> Column:
    """Whether some pivot shows two groups to be further apart than ``reach``."""
    gaps = F.zip_with(F.arrays_zip(lo1.alias("a"), hi1.alias("b")), F.arrays_zip(lo2.alias("a"), hi2.alias("b")), lambda x, y: F.greatest(x["a"] - y["b"], y["a"] - x["b"]))
    return F.exists(gaps, lambda g: g > reach)


def _cells(source_blocks: DataFrame, target_blocks: DataFrame, reach: float) -> DataFrame:
    """``sb, tb, s_rows, t_rows``: the pairs of blocks that can hold a similar
    pair.  Zones are compared first (a bounded list), then blocks of zones
    within reach, met by zone."""
    zones = target_blocks.groupBy("zone").agg(
        F.expr("array(" + ", ".join(f"min(lo[{i}])" for i in range(PIVOTS)) + ")").alias("lo"),
        F.expr("array(" + ", ".join(f"max(hi[{i}])" for i in range(PIVOTS)) + ")").alias("hi"),
    )
    all_zones = zones.agg(F.collect_list(F.struct("zone", "lo", "hi")).alias("z")).scalar()
    near = F.filter("_z", lambda z: ~F.coalesce(_apart(F.col("lo"), F.col("hi"), z["lo"], z["hi"], reach), F.lit(False)))
    s = source_blocks.withColumn("_z", all_zones).select(F.col("block").alias("sb"), F.col("n").alias("s_rows"), "lo", "hi", F.explode(F.transform(near, lambda z: z["zone"])).alias("zone"))
    t = target_blocks.select(F.col("block").alias("tb"), F.col("n").alias("t_rows"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "zone")
    apart = _apart(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"), reach)
    return s.join(t, "zone").where(~F.coalesce(apart, F.lit(False))).select("sb", "tb", "s_rows", "t_rows")


def _pair_schema(skey_type, tkey_type, sorder_type) -> T.StructType:
    return T.StructType(
        [
            T.StructField("source", skey_type),
            T.StructField("source_order", sorder_type),
            T.StructField("target", tkey_type),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _best_of_cell(sm: np.ndarray, tm: np.ndarray, names: np.ndarray, threshold: float, scale: float, top_k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source row, target row, score) of the pairs above the threshold, of
    each source its ``top_k`` best (ties: least target).

    Targets are scored in chunks, those in the sources' direction first.  Once
    a source has ``top_k`` pairs, its k-th score is what others have to reach;
    sources that no target of a chunk can lift above it by angle are left out
    of its product."""
    floor = np.full(len(sm), threshold)
    order = np.arange(len(tm))
    unit = np.allclose((tm * tm).sum(axis=1), 1.0) and np.allclose((sm * sm).sum(axis=1), 1.0)
    axis = sm.sum(axis=0)
    length = np.linalg.norm(axis)
    bounded = top_k is not None and unit and length > 0
    if bounded:
        to_axis_s, to_axis_t = (np.arccos(np.clip(m @ (axis / length), -1, 1)) for m in (sm, tm))
        order = np.argsort(to_axis_t, kind="stable")
    rank = np.empty(len(tm), np.int64)
    rank[np.argsort(names, kind="stable")] = np.arange(len(tm))
    si, ti, sc = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(order), CHUNK):
        ts = order[at : at + CHUNK]
        live = np.arange(len(sm))
        if bounded:
            gap = np.maximum(np.maximum(to_axis_t[ts[0]] - to_axis_s, to_axis_s - to_axis_t[ts[-1]]), 0)
            live = live[scale * np.cos(gap) + 1.0 + 1e-9 >= floor]
        score = scale * (sm[live] @ tm[ts].T) + 1.0
        a, b = np.nonzero((score > threshold) & (score >= floor[live][:, None]))
        si, ti, sc = np.concatenate([si, live[a]]), np.concatenate([ti, ts[b]]), np.concatenate([sc, score[a, b]])
        if top_k is not None and len(a):
            by = np.lexsort((rank[ti], -sc, si))
            si, ti, sc = si[by], ti[by], sc[by]
            starts = np.searchsorted(si, si, side="left")
            place = np.arange(len(si)) - starts
            full = place == top_k - 1
            floor[si[full]] = sc[full]
            keep = place < top_k
            si, ti, sc = si[keep], ti[keep], sc[keep]
    return si, ti, sc


def _block_pairs_fn(threshold: float, top_k: int | None, max_label: float):
    scale = max_label - 1.0

    def fn(tpdf: pd.DataFrame, spdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["source", "source_order", "target", "score"]
        if tpdf.empty or spdf.empty:
            return pd.DataFrame({c: [] for c in cols})
        tm = np.stack(tpdf["vec"].to_numpy()).astype(np.float64, copy=False)
        sm = np.stack(spdf["vec"].to_numpy()).astype(np.float64, copy=False)
        si, ti, sc = _best_of_cell(sm, tm, tpdf["target"].to_numpy(), threshold, scale, top_k)
        return pd.DataFrame(
            {
                "source": spdf["source"].to_numpy()[si],
                "source_order": spdf["source_order"].to_numpy()[si],
                "target": tpdf["target"].to_numpy()[ti],
                "score": sc,
            }
        )[cols]

    return fn


def planned_cells(sources: DataFrame, targets: DataFrame, threshold: float, max_label: float = 6.0, block_rows: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources and targets with their blocks, the pairs of blocks to be
    multiplied with their row counts): what :func:`similar_pairs` works on.

    Three small jobs plan the work: the pivots (of a bounded sample), the sizes
    of the zones (at most one row for each pivot and ring), and the pairs of
    blocks, which are stored."""
    require_columns(sources, ["source", "source_order", "vec"], "sources")
    require_columns(targets, ["target", "vec"], "targets")
    s = sources.select("source", "source_order", "vec").where(F.col("vec").isNotNull())
    t = targets.select("target", "vec").where(F.col("vec").isNotNull())
    cos = max(-1.0, min(1.0, (threshold - 1.0) / (max_label - 1.0)))
    reach = math.acos(cos) + 1e-6
    width = max(reach / 4, math.pi / 64)
    pivots = _constant(_pivots(t).first()["p"], "array<array<double>>")
    s, t = _zoned(s, pivots, width), _zoned(t, pivots, width)
    sizes = s.select("zone", F.lit(0).alias("side")).unionAll(t.select("zone", F.lit(1))).groupBy("side", "zone").agg(F.count(F.lit(1)).alias("n"))
    parts: tuple[dict, dict] = ({}, {})
    for r in sizes.collect():
        parts[r["side"]][r["zone"]] = r["n"]
    s, t = (_blocked(v, key, _groups(p, block_rows)) for v, key, p in ((s, "source", parts[0]), (t, "target", parts[1])))
    cells = materialize(_cells(_blocks(s), _blocks(t), reach), reliable=True)
    return s.drop("_a", "zone"), t.drop("_a", "zone"), cells


def similar_pairs(
    sources: DataFrame,
    targets: DataFrame,
    threshold: float,
    top_k: int | None = 1000,
    max_label: float = 6.0,
    block_rows: int = 2048,
) -> DataFrame:
    """JN4 + WIN2: (source, target, score, rank) with rating
    ``(max_label-1) * cos + 1 > threshold`` (strict), at most ``top_k``
    targets per source ranked by score desc then target asc.

    ``sources``: (source, source_order, vec); ``targets``: (target, vec);
    vectors L2-normalised (or zero) ``array<double>`` of one length; rows with
    a NULL vector pair with nothing.  Both sides are read several times (see
    :func:`planned_cells`): hand over stored tables.

    How much is pruned depends on the data: vectors without structure in many
    dimensions are all about as far from every pivot, and most blocks meet."""
    s, t, cells = planned_cells(sources, targets, threshold, max_label, block_rows)
    schema = _pair_schema(
        sources.schema["source"].dataType, targets.schema["target"].dataType, sources.schema["source_order"].dataType
    )
    s = s.join(cells.select("sb", "tb"), F.col("block") == F.col("sb")).drop("block")
    t = t.join(cells.select(F.col("sb").alias("sb2"), F.col("tb").alias("tb2")), F.col("block") == F.col("tb2")).drop("block")
    pairs = (
        t.groupBy("tb2", "sb2")
        .cogroup(s.groupBy("tb", "sb"))
        .applyInPandas(_block_pairs_fn(float(threshold), top_k, float(max_label)), schema=schema)
    )
    if top_k is not None:
        # row_number() <= k: Spark keeps only k rows per source in every map
        # task (WindowGroupLimit) before the shuffle
        w = Window.partitionBy("source").orderBy(F.col("score").desc(), F.col("target").asc())
        return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    # no cap: ranks by range segments, so a source matching most targets is
    # still ranked by many tasks
    from .ordering import positions_within_key

    ranked = positions_within_key(pairs.withColumn("_neg", -F.col("score")), "source", ["_neg", "target"], "_pos")
    return ranked.withColumn("rank", (F.col("_pos") + 1).cast("int")).drop("_neg", "_pos")


def best_source(pairs: DataFrame) -> DataFrame:
    """WIN3: per target the source with the highest score; on equal scores the
    source first in manifest order wins.  One aggregate with partial merge."""
    pick = F.min_by(
        F.struct(F.col("source").alias("parent"), F.col("score")),
        F.struct((-F.col("score")).alias("neg_score"), F.col("source_order")),
    )
    return pairs.groupBy("target").agg(pick.alias("_b")).select("target", F.col("_b.parent").alias("parent"), F.col("_b.score").alias("score"))


def match_statistics(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG7: annotated sources, sources with >= 1 match, mean and median
    matches among those, and distinct targets matched."""
    per_source = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("matches"))
    stats = per_source.agg(
        F.count(F.lit(1)).alias("sources_with_matches"),
        F.avg("matches").alias("mean_matches"),
        F.median("matches").alias("median_matches"),
    )
    n_sources = sources.agg(F.count(F.lit(1)).alias("annotated_sources"))
    n_targets = pairs.agg(F.count_distinct("target").alias("targets_matched"))
    return n_sources.select(
        "annotated_sources",
        stats.select("sources_with_matches").scalar().alias("sources_with_matches"),
        stats.select("mean_matches").scalar().alias("mean_matches"),
        stats.select("median_matches").scalar().alias("median_matches"),
        n_targets.select("targets_matched").scalar().alias("targets_matched"),
    )


def mean_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise mean vector per key, exact and skew-safe: exploded per
    dimension with partial aggregation, reassembled by dimension."""
    ex = df.select(key, F.posexplode(as_double_array(F.col(vec))).alias("_dim", "_x"))
    m = ex.groupBy(key, "_dim").agg(F.avg("_x").alias("_m"))
    return m.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_dim", "_m"))).alias("_s")).select(
        key, F.transform("_s", lambda s: s["_m"]).alias("mean")
    )


def pair_scores(pairs: DataFrame, crops: DataFrame, full: DataFrame, max_label: float = 6.0) -> DataFrame:
    """JN7: score listed pairs.  ``crops`` (file, embedding) holds the
    per-crop vectors of each file and ``full`` (file, embedding) the
    whole-clip vector.  Score = mean over all crop pairs of the dot product
    (= dot of the two crop means) averaged with the whole-clip dot product,
    then rescaled to 1..max_label."""
    require_columns(pairs, ["wav1", "wav2", "label"], "pairs")
    cm = mean_vectors(crops, "file", "embedding")
    fv = full.select("file", as_double_array(F.col("embedding")).alias("full"))
    vecs = cm.join(fv, ["file"], "inner")
    a = vecs.select(F.col("file").alias("wav1"), F.col("mean").alias("m1"), F.col("full").alias("f1"))
    b = vecs.select(F.col("file").alias("wav2"), F.col("mean").alias("m2"), F.col("full").alias("f2"))
    j = pairs.join(a, ["wav1"], "inner").join(b, ["wav2"], "inner")
    score = (dot(F.col("m1"), F.col("m2")) + dot(F.col("f1"), F.col("f2"))) / 2.0
    return j.select("wav1", "wav2", "label", cos_to_rating(score, max_label).alias("score"))


def pair_correlation(scored: DataFrame, batch_col: str | None = None) -> DataFrame:
    """AGG13: Pearson correlation of score and label; with ``batch_col`` the
    mean of per-batch correlations (the trainer's running figure)."""
    if batch_col is None:
        return scored.agg(F.corr("score", "label").alias("pearson"))
    per = scored.groupBy(batch_col).agg(F.corr("score", "label").alias("r"))
    return per.agg(F.avg("r").alias("pearson"))

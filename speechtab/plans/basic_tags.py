"""Contract queries for the basic-tag stage (L1): value -> text labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binning import (
    REVERBERATION_BINS,
    SHIPPED_BIN_EDGES,
    SHIPPED_TEXT_BINS,
    SPEAKER_LEVEL_PITCH_BINS,
    SPEAKER_RATE_BINS,
    UTTERANCE_LEVEL_STD,
    resolve_labels,
)
from ..operators import binning as B
from ..operators import stats as S
from . import bindings as bd
from . import oracle as O

NOISE_LABELS = SHIPPED_TEXT_BINS["snr_bins"]
PITCH3 = SHIPPED_TEXT_BINS["speaker_level_pitch_bins"]


def noise_labels(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    lab = B.apply_bins(u, "snr", "noise", NOISE_LABELS, SHIPPED_BIN_EDGES["noise"])
    return lab.groupBy("noise").agg(F.count(F.lit(1)).alias("n"))


NOISE_LABELS_SQL = (
    O.with_(O.UTTERANCES)
    + f"SELECT {O.case_label('snr', SHIPPED_BIN_EDGES['noise'], NOISE_LABELS)} AS noise, count(*) AS n FROM utterances GROUP BY 1"
)


def rate_labels_learned(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    out = B.label_by_learned_bins(
        u, "speaking_rate_value", "speaking_rate", SPEAKER_RATE_BINS, std_tolerance=4.0, split_col="split", leading_split="train"
    )
    return out.select("utterance_id", "speaking_rate")


def _rate_sql() -> str:
    n = len(SPEAKER_RATE_BINS)
    vals = "vals AS (SELECT speaking_rate_value AS v FROM utterances WHERE split LIKE '%train%' AND speaking_rate_value IS NOT NULL AND NOT isnan(speaking_rate_value))"
    edges = [O.learned_edge(k, n) for k in range(n + 1)]
    return (
        O.with_(O.UTTERANCES, vals, O.bounds_sql("vals", 4.0))
        + f"SELECT utterance_id, {O.case_label('speaking_rate_value', edges, SPEAKER_RATE_BINS)} AS speaking_rate FROM utterances, bounds"
    )


def speaker_pitch_labels(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    out = B.speaker_pitch_labels(u, SPEAKER_LEVEL_PITCH_BINS, std_tolerance=2.0)
    return out.select("utterance_id", "speakerid", "pitch")


def _pitch_sql() -> str:
    n = len(SPEAKER_LEVEL_PITCH_BINS)
    spk = (
        "spk AS (SELECT speakerid, avg(CASE WHEN NOT isnan(utterance_pitch_mean) THEN utterance_pitch_mean END) AS m0,"
        " arg_min(gender, utterance_id) FILTER (WHERE gender IS NOT NULL) AS gender FROM utterances"
        " WHERE speakerid IS NOT NULL GROUP BY speakerid)"
    )
    vals = "vals AS (SELECT gender, m0 AS v FROM spk WHERE gender IN ('male', 'female') AND m0 IS NOT NULL AND NOT isnan(m0))"
    edges = [O.learned_edge(k, n) for k in range(n + 1)]
    return (
        O.with_(O.UTTERANCES, spk, vals, O.bounds_sql("vals", 2.0, group="gender"))
        + "SELECT u.utterance_id, u.speakerid, "
        + O.case_label("s.m0", edges, SPEAKER_LEVEL_PITCH_BINS).replace("CASE WHEN s.m0 IS NULL", "CASE WHEN s.m0 IS NULL OR b.lo IS NULL")
        + " AS pitch FROM utterances u LEFT JOIN spk s USING (speakerid) LEFT JOIN bounds b ON b.gender = s.gender"
    )


def speaker_pitch_labels_fixed(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    spk = B.speaker_means(u, "speakerid", "utterance_pitch_mean", "gender", "utterance_id")
    from ..functions.binning import gender_bin_label

    edges = {"male": SHIPPED_BIN_EDGES["pitch_bins_male"], "female": SHIPPED_BIN_EDGES["pitch_bins_female"]}
    return spk.select(
        "speakerid",
        "gender",
        F.round("utterance_pitch_mean", 6).alias("pitch_mean"),
        gender_bin_label(F.col("utterance_pitch_mean"), F.col("gender"), edges, PITCH3).alias("pitch"),
    )


def _pitch_fixed_sql() -> str:
    m = O.case_label("m0", SHIPPED_BIN_EDGES["pitch_bins_male"], PITCH3)
    f = O.case_label("m0", SHIPPED_BIN_EDGES["pitch_bins_female"], PITCH3)
    return (
        O.with_(O.UTTERANCES)
        + "SELECT speakerid, gender, round(m0, 6) AS pitch_mean, "
        + f"CASE WHEN gender = 'male' THEN {m} WHEN gender = 'female' THEN {f} ELSE NULL END AS pitch FROM ("
        + "SELECT speakerid, avg(CASE WHEN NOT isnan(utterance_pitch_mean) THEN utterance_pitch_mean END) AS m0,"
        + " arg_min(gender, utterance_id) FILTER (WHERE gender IS NOT NULL) AS gender FROM utterances"
        + " WHERE speakerid IS NOT NULL GROUP BY speakerid)"
    )


def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    h = B.histogram_table(u, "snr", n_bins=100, std_tolerance=3.5)
    return h.select("stage", F.col("bucket").cast("bigint").alias("bucket"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


def _hist_sql() -> str:
    n = 100
    before = "b0 AS (SELECT snr AS v FROM utterances WHERE snr IS NOT NULL AND NOT isnan(snr))"
    st = "st AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM b0)"
    after = "a0 AS (SELECT v FROM b0, st WHERE abs(v - m) < 3.5 * s)"
    parts = []
    for stage, src in (("before", "b0"), ("after", "a0")):
        parts.append(
            f"""SELECT '{stage}' AS stage, g.i AS bucket, round(g.lo_e, 6) AS lower, round(g.hi_e, 6) AS upper, count(x.v) AS n
FROM (SELECT i, CASE WHEN i = 0 THEN lo ELSE i * ((hi - lo) / {float(n)}) + lo END AS lo_e,
             CASE WHEN i + 1 = {n} THEN hi ELSE (i + 1) * ((hi - lo) / {float(n)}) + lo END AS hi_e
      FROM (SELECT min(v) AS lo, max(v) AS hi FROM {src}), range(0, {n}) t(i)) g
LEFT JOIN {src} x ON (x.v >= g.lo_e AND (x.v < g.hi_e OR (g.i = {n - 1} AND x.v <= g.hi_e)))
GROUP BY ALL"""
        )
    return O.with_(O.UTTERANCES, before, st, after) + "\nUNION ALL\n".join(parts)


def _shown(h: DataFrame) -> DataFrame:
    return h.select("series", "stage", F.col("bucket").cast("bigint").alias("bucket"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n", F.transform("label_edges", lambda e: F.round(e, 6)).alias("label_edges"))


def pitch_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Speaker means by gender, before and after the outliers: four series."""
    spk = B.speaker_means(bd.utterances(spark, d), "speakerid", "utterance_pitch_mean", "gender", "utterance_id")
    return _shown(B.distribution_tables(spk, "utterance_pitch_mean", len(SPEAKER_LEVEL_PITCH_BINS), std_tolerance=2.0, group_col="gender", groups=B.GENDERS))


def rate_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Speaking rates with label edges from a lower range of -2 on."""
    return _shown(B.distribution_tables(bd.utterances(spark, d), "speaking_rate_value", len(SPEAKER_RATE_BINS), std_tolerance=2.5, lower_range=-2.0))


def _distributions_sql(values: tuple[str, ...], tol: float, n_labels: int, first: str) -> str:
    """``values`` define the CTE ``b0 (series, v)``."""
    n = 100
    edges = ", ".join(f"round({'hi' if k == n_labels else f'{k} * ((hi - {first}) / {float(n_labels)}) + {first}'}, 6)" for k in range(n_labels + 1))
    return O.with_(
        O.UTTERANCES,
        *values,
        "st AS (SELECT series, avg(v) AS m, stddev_pop(v) AS s FROM b0 GROUP BY series)",
        f"x AS (SELECT series, 'before' AS stage, v FROM b0 UNION ALL SELECT series, 'after', v FROM b0 JOIN st USING (series) WHERE abs(v - m) < {tol} * s)",
        "r AS (SELECT series, stage, min(v) AS lo, max(v) AS hi FROM x GROUP BY ALL)",
        f"g AS (SELECT *, i * ((hi - lo) / {float(n)}) + lo AS lo_e, CASE WHEN i + 1 = {n} THEN hi ELSE (i + 1) * ((hi - lo) / {float(n)}) + lo END AS hi_e FROM r, range(0, {n}) t(i))",
    ) + f"""SELECT g.series, g.stage, i AS bucket, round(lo_e, 6) AS lower, round(hi_e, 6) AS upper, count(x.v) AS n, [{edges}] AS label_edges
FROM g LEFT JOIN x ON x.series = g.series AND x.stage = g.stage AND x.v >= lo_e AND (x.v < hi_e OR (i = {n - 1} AND x.v <= hi_e))
GROUP BY g.series, g.stage, i, lo_e, hi_e, lo, hi"""


PITCH_DISTRIBUTIONS_SQL = _distributions_sql(
    (
        "spk AS (SELECT speakerid, avg(utterance_pitch_mean) AS v, arg_min(gender, utterance_id) FILTER (WHERE gender IS NOT NULL) AS gender FROM utterances WHERE speakerid IS NOT NULL GROUP BY speakerid)",
        "b0 AS (SELECT gender AS series, v FROM spk WHERE gender IN ('male', 'female'))",
    ),
    2.0,
    len(SPEAKER_LEVEL_PITCH_BINS),
    "lo",
)
RATE_DISTRIBUTIONS_SQL = _distributions_sql(("b0 AS (SELECT 'all' AS series, speaking_rate_value AS v FROM utterances)",), 2.5, len(SPEAKER_RATE_BINS), "-2.0")


def split_statistics(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances_tagged(spark, d)
    return S.split_statistics(u)


SPLIT_STATS_SQL = (
    O.with_(
        O.UTTERANCES,
        "tagged AS (SELECT *, speakerid % 3 = 0 AS has_i, utterance_id % 7 = 0 AS has_s FROM utterances)",
    )
    + """SELECT split, count(*) AS examples, count(DISTINCT speakerid) AS speakers,
       round(CAST(sum(CAST(duration AS DECIMAL(38,9))) AS DOUBLE) / 3600, 6) AS hours,
       round(CAST(coalesce(sum(CASE WHEN has_i THEN CAST(duration AS DECIMAL(38,9)) END), 0) AS DOUBLE) / 3600, 6) AS hours_intrinsic,
       round(CAST(coalesce(sum(CASE WHEN has_s THEN CAST(duration AS DECIMAL(38,9)) END), 0) AS DOUBLE) / 3600, 6) AS hours_situational,
       round(CAST(coalesce(sum(CASE WHEN has_i AND has_s THEN CAST(duration AS DECIMAL(38,9)) END), 0) AS DOUBLE) / 3600, 6) AS hours_both
FROM tagged GROUP BY ROLLUP (split)"""
)

# ---------------------------------------------------------------------------
# Default outlier tolerances of the basic-tag step.
# ---------------------------------------------------------------------------
DEFAULT_TOLERANCES = {"pitch": 2.0, "speaking_rate": 4.0, "noise": 3.5, "reverberation": 4.0, "speech_monotony": 4.0}
# ---------------------------------------------------------------------------


def annotate_basic_tags(
    df: DataFrame,
    text_bins: dict | None = None,
    bin_edges: dict | None = None,
    leading_split: str | None = None,
    split_col: str = "split",
    speaker_col: str = "speakerid",
    gender_col: str = "gender",
    order_col: str = "utterance_id",
    tolerances: dict | None = None,
    snr_lower_range: float | None = None,
    speaking_rate_lower_range: float | None = None,
    with_pitch: bool = True,
) -> DataFrame:
    """L1 in one plan: speaker-level pitch label (relative to gender) and the
    speaking-rate, noise, reverberation and monotony labels.

    ``text_bins`` uses the label-file keys (missing keys fall back to the
    built-in seven-label lists); ``bin_edges`` uses the edge-file keys
    (``speaking_rate``, ``noise``, ``reverberation``, ``speech_monotony``,
    ``pitch_bins_male`` + ``pitch_bins_female``); a metric without edges has
    them learned from the rows of the leading splits.
    """
    tol = dict(DEFAULT_TOLERANCES, **(tolerances or {}))
    edges = bin_edges or {}
    out = df
    if with_pitch:
        pitch_edges = None
        if "pitch_bins_male" in edges and "pitch_bins_female" in edges:
            pitch_edges = {"male": edges["pitch_bins_male"], "female": edges["pitch_bins_female"]}
        out = B.speaker_pitch_labels(
            out, resolve_labels(text_bins, "speaker_level_pitch_bins"), speaker_col, gender_col,
            "utterance_pitch_mean", "pitch", order_col, tol["pitch"], pitch_edges,
        )
    plan = [
        ("speaking_rate_value", "speaking_rate", "speaker_rate_bins", "speaking_rate", speaking_rate_lower_range),
        ("snr", "noise", "snr_bins", "noise", snr_lower_range),
        ("c50", "reverberation", "reverberation_bins", "reverberation", None),
        ("utterance_pitch_std", "speech_monotony", "utterance_level_std", "speech_monotony", None),
    ]
    for value_col, out_col, label_key, edge_key, lower in plan:
        labels = resolve_labels(text_bins, label_key)
        if edge_key in edges:
            out = B.apply_bins(out, value_col, out_col, labels, edges[edge_key])
        else:
            # statistics come from the input rows, not from the labelled plan
            learned = B.learn_edges(df, value_col, len(labels), tol[out_col], lower, split_col if leading_split else None, leading_split)
            out = B.apply_bins(out, value_col, out_col, labels, learned)
    return out


def basic_tags_all(spark: SparkSession, d: str) -> DataFrame:
    u = bd.utterances(spark, d)
    shipped = {k: v for k, v in SHIPPED_BIN_EDGES.items()}
    out = annotate_basic_tags(u, SHIPPED_TEXT_BINS, shipped)
    return out.select("utterance_id", "pitch", "speaking_rate", "noise", "reverberation", "speech_monotony")


def _basic_all_sql() -> str:
    pitch3 = SHIPPED_TEXT_BINS["speaker_level_pitch_bins"]
    rate3 = SHIPPED_TEXT_BINS["speaker_rate_bins"]
    snr7 = SHIPPED_TEXT_BINS["snr_bins"]
    m = O.case_label("s.m0", SHIPPED_BIN_EDGES["pitch_bins_male"], pitch3)
    f = O.case_label("s.m0", SHIPPED_BIN_EDGES["pitch_bins_female"], pitch3)
    n = 7
    e_lo = [O.learned_edge(k, n, "r.lo", "r.hi") for k in range(n + 1)]
    e_mo = [O.learned_edge(k, n, "mo.lo", "mo.hi") for k in range(n + 1)]
    spk = (
        "spk AS (SELECT speakerid, avg(CASE WHEN NOT isnan(utterance_pitch_mean) THEN utterance_pitch_mean END) AS m0,"
        " arg_min(gender, utterance_id) FILTER (WHERE gender IS NOT NULL) AS gender FROM utterances"
        " WHERE speakerid IS NOT NULL GROUP BY speakerid)"
    )
    rv = "rv AS (SELECT c50 AS v FROM utterances WHERE c50 IS NOT NULL AND NOT isnan(c50))"
    mv = "mv AS (SELECT utterance_pitch_std AS v FROM utterances WHERE utterance_pitch_std IS NOT NULL AND NOT isnan(utterance_pitch_std))"
    rb = O.bounds_sql("rv", 4.0, name="rbounds", stats="rst")
    mb = O.bounds_sql("mv", 4.0, name="mbounds", stats="mst")
    return (
        O.with_(O.UTTERANCES, spk, rv, mv, rb, mb)
        + "SELECT u.utterance_id, "
        + f"CASE WHEN s.gender = 'male' THEN {m} WHEN s.gender = 'female' THEN {f} ELSE NULL END AS pitch, "
        + f"{O.case_label('u.speaking_rate_value', SHIPPED_BIN_EDGES['speaking_rate'], rate3)} AS speaking_rate, "
        + f"{O.case_label('u.snr', SHIPPED_BIN_EDGES['noise'], snr7)} AS noise, "
        + f"{O.case_label('u.c50', e_lo, REVERBERATION_BINS)} AS reverberation, "
        + f"{O.case_label('u.utterance_pitch_std', e_mo, UTTERANCE_LEVEL_STD)} AS speech_monotony "
        + "FROM utterances u LEFT JOIN spk s USING (speakerid), rbounds r, mbounds mo"
    )


QUERIES = {
    "noise_labels": (noise_labels, NOISE_LABELS_SQL),
    "rate_labels_learned": (rate_labels_learned, _rate_sql()),
    "speaker_pitch_labels": (speaker_pitch_labels, _pitch_sql()),
    "speaker_pitch_labels_fixed": (speaker_pitch_labels_fixed, _pitch_fixed_sql()),
    "value_histogram": (value_histogram, _hist_sql()),
    "pitch_distributions": (pitch_distributions, PITCH_DISTRIBUTIONS_SQL),
    "rate_distributions": (rate_distributions, RATE_DISTRIBUTIONS_SQL),
    "split_statistics": (split_statistics, SPLIT_STATS_SQL),
    "basic_tags_all": (basic_tags_all, _basic_all_sql()),
}


"""Value -> text label expressions (BIN1, BIN2) and the fixed label sets.

Bins are right-closed: a value equal to an inner edge falls in the lower bin,
values below the first edge go to the first bin, values above the last edge
(and NaN, which orders above every number) go to the last bin.  This is
``searchsorted(edges, v, side="left") - 1`` clamped to ``[0, n-1]``.

The label is built as a plain ``CASE WHEN`` chain over the inner edges so it
stays inside whole-stage codegen (no higher-order function, no UDF).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's label sets and shipped edges
# for results to agree.  Natural order, as published.
# ---------------------------------------------------------------------------
SPEAKER_RATE_BINS = ["very slowly", "quite slowly", "slightly slowly", "moderate speed", "slightly fast", "quite fast", "very fast"]
SNR_BINS = ["very noisy", "quite noisy", "slightly noisy", "moderate ambient sound", "slightly clear", "quite clear", "very clear"]
REVERBERATION_BINS = ["very roomy sounding", "quite roomy sounding", "slightly roomy sounding", "moderate reverberation", "slightly confined sounding", "quite confined sounding", "very confined sounding"]
UTTERANCE_LEVEL_STD = ["very monotone", "quite monotone", "slightly monotone", "moderate intonation", "slightly expressive", "quite expressive", "very expressive"]
SPEAKER_LEVEL_PITCH_BINS = ["very low pitch", "quite low pitch", "slightly low pitch", "moderate pitch", "slightly high pitch", "quite high pitch", "very high pitch"]

# Shipped label file (keys as published).
SHIPPED_TEXT_BINS = {
    "speaker_rate_bins": ["slow speed", "measured speed", "fast speed"],
    "snr_bins": ["very noisy environment", "noisy environment", "slightly noisy environment", "environment balanced in clarity", "slightly clean environment", "clean environment", "very clean environment"],
    "speaker_level_pitch_bins": ["low-pitched", "medium-pitched", "high-pitched"],
}

# Shipped edge file (keys as published).
SHIPPED_BIN_EDGES = {
    "speaking_rate": [0.0, 11.477411477411476, 19.129019129019127, 26.78062678062678],
    "noise": [17.12751579284668, 25.4012325831822, 33.67494937351772, 41.94866616385323, 50.22238295418875, 58.49609974452427, 66.76981653485979, 75.04353332519531],
    "pitch_bins_male": [64.6531982421875, 115.69412231445312, 149.72140502929688, 183.74868774414062],
    "pitch_bins_female": [120.17855072021484, 141.6242690945264, 184.51570584314953, 270.29857934039575],
}
# ---------------------------------------------------------------------------

DEFAULT_LABELS = {
    "speaker_level_pitch_bins": SPEAKER_LEVEL_PITCH_BINS,
    "speaker_rate_bins": SPEAKER_RATE_BINS,
    "snr_bins": SNR_BINS,
    "reverberation_bins": REVERBERATION_BINS,
    "utterance_level_std": UTTERANCE_LEVEL_STD,
}


def resolve_labels(config: Mapping[str, Sequence[str]] | None, key: str) -> list[str]:
    """SRC4: a label list from a config mapping, falling back to the built-in list."""
    if config and key in config:
        return list(config[key])
    return list(DEFAULT_LABELS[key])


def _edge(edges, k: int) -> Column:
    """Edge ``k`` (0-based) of a literal list or of an ``array<double>`` column."""
    if isinstance(edges, Column):
        return F.element_at(edges, k + 1)
    return F.lit(float(edges[k]))


def _unlabelled(value: Column, edges, n_labels: int) -> Column:
    """No value, or learned edges of which an inner one is missing."""
    out = value.isNull()
    if isinstance(edges, Column):  # element by element: the edges may be a scalar subquery
        for k in range(1, n_labels):
            out = out | _edge(edges, k).isNull()
    return out


def bin_index(value: Column, edges, n_labels: int) -> Column:
    """0-based right-closed bin index, clamped; NULL for a NULL value, and
    where learned edges are NULL or hold a NULL.

    ``edges`` is a Python list of n+1 numbers or an ``array<double>`` column
    (for learned edges).  Only the inner edges 1..n-1 decide the bin.
    """
    if not isinstance(edges, Column) and len(edges) != n_labels + 1:
        raise ValueError(f"{len(edges)} edges for {n_labels} labels; need n+1")
    expr = None
    for k in range(n_labels - 1):
        cond = value <= _edge(edges, k + 1)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    last = F.lit(n_labels - 1)
    expr = last if expr is None else expr.otherwise(last)
    return F.when(_unlabelled(value, edges, n_labels), F.lit(None).cast("int")).otherwise(expr)


def bin_label(value: Column, edges, labels: Sequence[str]) -> Column:
    """BIN1: text label of ``value`` for ``edges`` (n+1) and ``labels`` (n)."""
    labels = list(labels)
    n = len(labels)
    if not isinstance(edges, Column) and len(edges) != n + 1:
        raise ValueError(f"{len(edges)} edges for {n} labels; need n+1")
    expr = None
    for k in range(n - 1):
        cond = value <= _edge(edges, k + 1)
        expr = F.when(cond, F.lit(labels[k])) if expr is None else expr.when(cond, F.lit(labels[k]))
    last = F.lit(labels[-1])
    expr = last if expr is None else expr.otherwise(last)
    return F.when(_unlabelled(value, edges, n), F.lit(None).cast("string")).otherwise(expr)


def gender_bin_label(value: Column, gender: Column, edges_by_gender: Mapping[str, object], labels: Sequence[str]) -> Column:
    """BIN2: label by gender-specific edges; unknown gender gives NULL."""
    expr = None
    for g, edges in edges_by_gender.items():
        lab = bin_label(value, edges, labels)
        expr = F.when(gender == F.lit(g), lab) if expr is None else expr.when(gender == F.lit(g), lab)
    return expr.otherwise(F.lit(None).cast("string"))

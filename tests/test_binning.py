import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechtab.functions.binning import (
    REVERBERATION_BINS,
    SHIPPED_BIN_EDGES,
    SPEAKER_RATE_BINS,
    bin_index,
    bin_label,
)
from speechtab.operators import binning as B


def reference_bin(edges, v, n):
    """searchsorted(side=left) - 1, clamped -- the rule the labels follow."""
    i = int(np.searchsorted(np.asarray(edges), v, side="left")) - 1
    return min(max(i, 0), n - 1)


def test_right_closed_and_clamped(spark):
    edges = [0.0, 1.0, 2.0, 3.0]
    vals = [-5.0, 0.0, 0.5, 1.0, 1.0000001, 2.0, 2.5, 3.0, 9.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(bin_index(F.col("v"), edges, 3)).collect()]
    want = [reference_bin(edges, v, 3) for v in vals]
    assert got == want
    # a value equal to an inner edge falls in the lower bin
    assert got[3] == 0 and got[5] == 1


def test_null_gives_null_label(spark):
    df = spark.createDataFrame([(None,), (1.5,)], "v double")
    got = [r[0] for r in df.select(bin_label(F.col("v"), [0.0, 1.0, 2.0, 3.0], ["a", "b", "c"])).collect()]
    assert got == [None, "b"]


def test_shipped_noise_edges_match_searchsorted(spark):
    edges = SHIPPED_BIN_EDGES["noise"]
    rng = np.random.default_rng(0)
    vals = list(rng.uniform(0, 90, 200)) + edges
    labels = [f"l{i}" for i in range(7)]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = [r[0] for r in df.select(bin_label(F.col("v"), edges, labels)).collect()]
    assert got == [labels[reference_bin(edges, v, 7)] for v in vals]


def numpy_edges(values, n, tol=None, lower=None):
    a = np.asarray(values, dtype=float)
    a = a[~np.isnan(a)]
    if tol is not None:
        a = a[np.abs(a - a.mean()) < tol * a.std()]
    rng = (lower, a.max()) if lower is not None else None
    return np.histogram(a, bins=n, range=rng)[1]


@pytest.mark.parametrize("tol", [None, 2.0, 4.0])
def test_learned_edges_equal_numpy(spark, tol):
    rng = np.random.default_rng(1)
    vals = list(rng.normal(10, 3, 400)) + [200.0, -150.0, float("nan")]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    e = B.learn_edges(df, "v", 7, std_tolerance=tol).collect()[0]["edges"]
    assert np.allclose(e, numpy_edges(vals, 7, tol), rtol=0, atol=1e-12)


def test_constant_and_empty_edges(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    e = B.learn_edges(df, "v", 2).collect()[0]["edges"]
    assert e == [3.5, 4.0, 4.5]
    empty = spark.createDataFrame([(float("nan"),)], "v double")
    e = B.learn_edges(empty, "v", 2).collect()[0]["edges"]
    assert e == [0.0, 0.5, 1.0]


def test_zero_lower_range_is_honoured(spark):
    df = spark.createDataFrame([(2.0,), (6.0,)], "v double")
    e = B.learn_edges(df, "v", 2, lower_range=0.0).collect()[0]["edges"]
    assert e == [0.0, 3.0, 6.0]


def test_split_filter_contains(spark):
    df = spark.createDataFrame([(1.0, "train_a"), (3.0, "my_train"), (100.0, "dev")], "v double, split string")
    e = B.learn_edges(df, "v", 2, split_col="split", leading_split="train").collect()[0]["edges"]
    assert e == [1.0, 2.0, 3.0]


def test_speaker_pitch_labels_first_gender_and_nan(spark):
    rows = [
        (1, "s1", None, 100.0),
        (2, "s1", "male", float("nan")),
        (3, "s1", "female", 110.0),
        (4, "s2", "female", 200.0),
        (5, None, "male", 50.0),
    ]
    df = spark.createDataFrame(rows, "utterance_id long, speakerid string, gender string, utterance_pitch_mean double")
    spk = {r["speakerid"]: r for r in B.speaker_means(df, "speakerid", "utterance_pitch_mean", "gender", "utterance_id").collect()}
    assert set(spk) == {"s1", "s2"}
    assert spk["s1"]["gender"] == "male"  # first non-null by row order
    assert math.isclose(spk["s1"]["utterance_pitch_mean"], 105.0)


def test_histogram_counts_equal_numpy(spark):
    rng = np.random.default_rng(3)
    vals = list(rng.normal(0, 1, 300)) + [25.0]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    h = B.histogram_table(df, "v", n_bins=20, std_tolerance=3.0).collect()
    before = [r["n"] for r in sorted((r for r in h if r["stage"] == "before"), key=lambda r: r["bucket"])]
    a = np.asarray(vals)
    assert before == list(np.histogram(a, 20)[0])
    kept = a[np.abs(a - a.mean()) < 3.0 * a.std()]
    after = [r["n"] for r in sorted((r for r in h if r["stage"] == "after"), key=lambda r: r["bucket"])]
    assert after == list(np.histogram(kept, 20)[0])


def test_annotate_basic_tags_learns_missing_edges(spark):
    from speechtab.plans.basic_tags import annotate_basic_tags

    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        spk = i % 6
        rows.append((i, spk, "male" if spk % 2 else "female", "train" if i % 3 else "dev",
                     float(100 + rng.normal(0, 20)), float(rng.uniform(1, 30)), float(rng.uniform(0, 60)),
                     float(rng.uniform(0, 50)), float(rng.uniform(5, 40))))
    df = spark.createDataFrame(
        rows,
        "utterance_id long, speakerid long, gender string, split string, utterance_pitch_mean double, "
        "speaking_rate_value double, snr double, c50 double, utterance_pitch_std double",
    )
    edges = {"noise": [0.0, 20.0, 40.0, 60.0]}
    bins = {"snr_bins": ["loud", "mid", "quiet"]}
    out = {r["utterance_id"]: r for r in annotate_basic_tags(df, bins, edges, leading_split="train").collect()}
    train = [r for r in rows if r[3] == "train"]
    for col, idx, tol in (("speaking_rate", 5, 4.0), ("reverberation", 7, 4.0)):
        e = numpy_edges([r[idx] for r in train], 7, tol)
        for r in rows:
            assert out[r[0]][col] is not None
            want = reference_bin(e, r[idx], 7)
            labels = {"speaking_rate": SPEAKER_RATE_BINS, "reverberation": REVERBERATION_BINS}[col]
            assert out[r[0]][col] == labels[want]
    for r in rows:
        assert out[r[0]]["noise"] == ["loud", "mid", "quiet"][reference_bin(edges["noise"], r[6], 3)]


def test_distributions_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("male", 400), ("female", 300)) for v in rng.normal(size=n) * (3 if g == "male" else 1)]
    rows += [("male", 90.0), ("other", 5.0), (None, 1.0), ("male", float("nan")), ("male", float("inf")), ("female", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {}
    for r in B.distribution_tables(df, "v", 3, n_bins=20, std_tolerance=2.0, group_col="g", groups=["male", "female", "one", "none"]).collect():
        got.setdefault((r.series, r.stage), []).append((r.bucket, r.n, r.lower, r.upper, r.label_edges))
    for g in ("male", "female", "one", "none"):
        values = np.array([v for k, v in rows if k == g and v is not None and np.isfinite(v)])
        after = values[np.abs(values - values.mean()) < 2.0 * values.std()] if len(values) else values
        for stage, v in (("before", values), ("after", after)):
            cells = sorted(got[g, stage])
            n, edges = np.histogram(v, 20)
            assert [c[1] for c in cells] == n.tolist()
            assert np.allclose([c[2] for c in cells] + [cells[-1][3]], edges)
            assert np.allclose(cells[0][4], np.histogram(v, 3)[1])
    low = B.distribution_tables(df.where("g = 'female'"), "v", 4, n_bins=2, lower_range=-9.0).collect()
    v = np.array([x for k, x in rows if k == "female" and x is not None])
    assert len(low) == 2 and np.allclose(low[0].label_edges, np.histogram(v, 4, range=(-9.0, v.max()))[1])
    assert {r.n for r in B.distribution_tables(df.limit(0), "v", 3, n_bins=5).collect()} == {0}


def test_infinite_values_do_not_reach_the_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(float("inf"),), (float("-inf"),)], "v double")
    assert B.learn_edges(df, "v", 2).first()["edges"] == [0.0, 5.0, 10.0]

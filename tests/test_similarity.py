import numpy as np

from speechtab.operators import similarity as SIM
from speechtab.operators import tags as TG


def _vec_df(spark, rows):
    return spark.createDataFrame(rows, "speaker long, embedding array<float>")


def test_median_vectors_equal_numpy_for_any_group_size(spark):
    rng = np.random.default_rng(0)
    rows, groups = [], {}
    sizes = {1: 10, 2: 7, 3: 1, 4: 73, 5: 2000}
    for g, n in sizes.items():
        m = rng.normal(size=(n, 6)).astype(np.float32)
        groups[g] = m
        rows += [(g, [float(x) for x in v]) for v in m]
    got = {r["speaker"]: np.array(r["median"]) for r in SIM.median_vectors(_vec_df(spark, rows)).collect()}
    for g, m in groups.items():
        med = np.median(m.astype(np.float64), axis=0)
        med /= np.linalg.norm(med)
        assert np.allclose(got[g], med, atol=1e-9), g


def _brute(src, tgt, threshold, k):
    out = []
    for s, order, sv in src:
        scored = [(t, 5.0 * float(np.dot(sv, tv)) + 1.0) for t, tv in tgt]
        scored = [x for x in scored if x[1] > threshold]
        scored.sort(key=lambda x: (-x[1], x[0]))
        out += [(s, t, sc, i + 1) for i, (t, sc) in enumerate(scored[:k])]
    return sorted(out)


def _unit(rng, n, d):
    m = rng.normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_similar_pairs_equal_brute_force_with_topk_and_blocks(spark):
    rng = np.random.default_rng(5)
    s_m, t_m = _unit(rng, 9, 4), _unit(rng, 40, 4)
    t_m[7] = t_m[3]  # tied scores for every source
    src = [(i, i, s_m[i]) for i in range(9)]
    tgt = [(100 + j, t_m[j]) for j in range(40)]
    sources = spark.createDataFrame([(s, o, [float(x) for x in v]) for s, o, v in src], "source long, source_order long, vec array<double>")
    targets = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in tgt], "target long, vec array<double>")
    everything = _brute(src, tgt, 2.0, 10**6)
    got = SIM.similar_pairs(sources, targets, 2.0, top_k=None, block_rows=7)
    got = sorted((r["source"], r["target"], r["score"], r["rank"]) for r in got.collect())
    assert [(a, b, round(c, 9), d) for a, b, c, d in got] == [(a, b, round(c, 9), d) for a, b, c, d in everything]
    want = _brute(src, tgt, 2.0, 3)
    for rows in (2048, 9, 3):
        got = SIM.similar_pairs(sources, targets, 2.0, top_k=3, block_rows=rows)
        got = sorted((r["source"], r["target"], r["score"], r["rank"]) for r in got.collect())
        assert [(a, b, round(c, 9), d) for a, b, c, d in got] == [(a, b, round(c, 9), d) for a, b, c, d in want]


def test_best_source_tie_goes_to_first_source(spark):
    pairs = spark.createDataFrame(
        [(1, 1, 10, 3.0), (2, 2, 10, 3.0), (2, 2, 11, 4.0), (1, 1, 11, 2.5)],
        "source long, source_order long, target long, score double",
    )
    got = {r["target"]: (r["parent"], r["score"]) for r in SIM.best_source(pairs).collect()}
    assert got == {10: (1, 3.0), 11: (2, 4.0)}


def test_tag_votes_threshold_and_allowed(spark):
    ann = spark.createDataFrame(
        [("a", "Deep"), ("a", "Deep"), ("a", "Husky"), ("a", "Crisp"), ("a", "Crisp"), ("b", "Nasal")], "name string, tag string"
    )
    got = {r["name"]: r["tags"] for r in TG.tag_votes(ann, 2).collect()}
    assert got == {"a": ["Deep"]}


def test_pair_scores_use_crop_means(spark):
    crops = spark.createDataFrame(
        [("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("y", [1.0, 0.0])], "file string, embedding array<double>"
    )
    full = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "file string, embedding array<double>")
    pairs = spark.createDataFrame([("x", "y", 3.0)], "wav1 string, wav2 string, label double")
    r = SIM.pair_scores(pairs, crops, full).collect()[0]
    # crop pairs: (1,0).(1,0)=1, (0,1).(1,0)=0 -> mean 0.5; full: 0 -> score 0.25 -> 5*0.25+1
    assert abs(r["score"] - 2.25) < 1e-12


def test_median_with_nan_like_numpy(spark):
    rows = [(1, [1.0, float("nan")]), (1, [2.0, 5.0]), (1, [3.0, 6.0])]
    rows += [(2, [float(i), float("nan") if i == 3 else float(i)]) for i in range(69)]
    df = spark.createDataFrame(rows, "speaker long, embedding array<double>")
    got = {r["speaker"]: r["median"] for r in SIM.median_vectors(df, normalize=False).collect()}
    for g in (1, 2):
        m = np.median(np.array([v for k, v in rows if k == g]), axis=0)
        assert all((np.isnan(a) and np.isnan(b)) or a == b for a, b in zip(got[g], m)), (g, got[g], m)


def test_median_rule_is_one_for_all_sizes(spark):
    """NULL components do not count, NaN makes the dimension NaN, whatever the size."""
    rows, want = [], {}
    for g, n in enumerate((1, 2, 63, 64, 65, 5000)):
        v = [[float(i), None if i % 3 == 1 else float(-i), float("nan") if i == n - 1 else 1.0] for i in range(n)]
        rows += [(g, x) for x in v]
        some = [x[1] for x in v if x[1] is not None]
        want[g] = (float(np.median([x[0] for x in v])), float(np.median(some)))
    rows += [(0, None), (None, [1.0, 1.0, 1.0]), (9, [2.0]), (9, [4.0, 8.0])]
    df = spark.createDataFrame(rows, "speaker long, embedding array<double>")
    got = {r["speaker"]: r["median"] for r in SIM.median_vectors(df, normalize=False).collect()}
    assert got.pop(9) == [3.0, 8.0] and None not in got
    for g, m in got.items():
        assert tuple(m[:2]) == want[g] and np.isnan(m[2])


def _tables(spark, src, tgt):
    sources = spark.createDataFrame([(s, o, [float(x) for x in v]) for s, o, v in src], "source long, source_order long, vec array<double>")
    targets = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in tgt], "target long, vec array<double>")
    return sources, targets


def test_clustered_vectors_are_pruned_and_exact(spark):
    """20 clusters: well under half of all pairs are scored, none is lost."""
    rng = np.random.default_rng(11)
    centres = _unit(rng, 20, 16)
    t_m = centres[rng.integers(0, 20, 1500)] + rng.normal(scale=0.05, size=(1500, 16))
    t_m /= np.linalg.norm(t_m, axis=1, keepdims=True)
    t_m[5] = 0.0
    s_m = t_m[rng.integers(0, 1500, 120)]
    src, tgt = [(i, i, v) for i, v in enumerate(s_m)], list(enumerate(t_m))
    sources, targets = _tables(spark, src, tgt)
    _, _, cells = SIM.planned_cells(sources, targets, 5.0, block_rows=100)
    rows = cells.collect()
    assert 0 < sum(r.s_rows * r.t_rows for r in rows) < 0.5 * len(src) * len(tgt)
    assert max(r.t_rows for r in rows) <= 200
    for k in (None, 10):
        got = sorted((r.source, r.target, r["rank"]) for r in SIM.similar_pairs(sources, targets, 5.0, top_k=k, block_rows=100).collect())
        assert got == sorted((a, b, d) for a, b, _, d in _brute(src, tgt, 5.0, k or 10**6))


def test_thresholds_below_every_rating_and_edges(spark):
    rng = np.random.default_rng(2)
    src, tgt = [(i, i, v) for i, v in enumerate(_unit(rng, 3, 3))], list(enumerate(_unit(rng, 8, 3)))
    src.append((3, 3, np.zeros(3)))
    sources, targets = _tables(spark, src, tgt)
    got = sorted((r.source, r.target) for r in SIM.similar_pairs(sources, targets, -9.0, top_k=None).collect())
    assert got == [(i, j) for i in range(4) for j in range(8)]
    assert SIM.similar_pairs(sources, targets.limit(0), 2.0).collect() == []
    assert SIM.similar_pairs(sources.limit(0), targets, 2.0).collect() == []
    nulls = sources.unionByName(sources.limit(1).selectExpr("9L AS source", "9L AS source_order", "CAST(NULL AS array<double>) AS vec"))
    assert {r.source for r in SIM.similar_pairs(nulls, targets, 1.0, top_k=2).collect()} <= {0, 1, 2, 3}


def test_rising_threshold_in_a_cell():
    rng = np.random.default_rng(4)
    sm, tm = _unit(rng, 40, 5), _unit(rng, 3000, 5)
    tm[100:200] = tm[0]
    names = rng.permutation(3000)
    si, ti, sc = SIM._best_of_cell(sm, tm, names, 1.5, 5.0, 30)
    want = _brute([(i, i, v) for i, v in enumerate(sm)], [(int(names[j]), tm[j]) for j in range(3000)], 1.5, 30)
    assert sorted((int(a), int(names[b])) for a, b in zip(si, ti)) == sorted((a, b) for a, b, _, _ in want)


def test_large_groups_select_by_histogram(spark):
    """Any distribution: huge and tiny magnitudes, ties, infinities, zeros."""
    rng = np.random.default_rng(7)
    n = 3001
    cols = [rng.normal(size=n), np.exp(rng.normal(scale=80, size=n)) * rng.choice([-1, 1], n), rng.integers(-2, 3, n).astype(float), np.where(rng.random(n) < 0.6, np.inf, -1.0), np.nextafter(1.0, 2.0) - np.arange(n) % 2 * 2.0**-53, np.zeros(n)]
    m = np.stack(cols, axis=1)
    rows = [(1, [float(x) for x in v]) for v in m] + [(2, [float(x) for x in v]) for v in m[:2000]]
    df = spark.createDataFrame(rows, "speaker long, embedding array<double>").repartition(6)
    got = {r.speaker: r.median for r in SIM.median_vectors(df, normalize=False, gathered=50).collect()}
    assert got[1] == np.median(m, axis=0).tolist()
    assert got[2] == np.median(m[:2000], axis=0).tolist()

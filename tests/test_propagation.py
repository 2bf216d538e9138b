"""Propagation from raw rows: duration rule, sample and embeddings in one call."""

import math

from speechtab.plans import propagation as PP


def _rows(spark, side):
    return spark.createDataFrame(side, "speaker string, utterance_id bigint, duration double")


def test_propagate_from_rows(spark):
    axis = {"s1": [1.0, 0.0, 0.0], "s2": [0.0, 1.0, 0.0], "s3": [0.0, 0.0, 1.0], "t1": [0.9, 0.1, 0.0], "t2": [0.0, 0.8, 0.6], "t3": [0.0, 1.0, 0.0]}
    utts, vecs = {}, []
    for k, (name, v) in enumerate(axis.items()):
        utts[name] = [(name, 100 * k + i, 100.0) for i in range(5)]
        vecs += [(100 * k + i, v) for i in range(5)]
    utts["s3"] = [(n, i, 50.0) for n, i, _ in utts["s3"]]  # 250 seconds: too little
    vecs = [(i, None if i == 400 else v) for i, v in vecs if i // 100 != 5]  # t3 has no embedding, t2 one less
    sources = _rows(spark, utts["s1"] + utts["s2"] + utts["s3"] + [(None, 999, 1e6)])
    targets = _rows(spark, utts["t1"] + utts["t2"] + utts["t3"])
    emb = spark.createDataFrame(vecs, "utterance_id bigint, embedding array<double>")
    ann = spark.createDataFrame([(s, "deep") for s in ("s1", "s2", "s3") for _ in range(2)] + [("s1", "husky")], "name string, tag string")
    allowed = {t.lower(): t for t in PP.TG.INTRINSIC_TAGS_EXPANDABLE}
    ann = ann.replace({"deep": allowed["deep"], "husky": allowed["husky"]}, subset="tag")
    pairs, tagged, votes, found = PP.propagate_from_rows(sources, targets, emb, ann, threshold=3.0, min_duration=300.0, n_per_speaker=4)
    got = {r.target: (r.parent, r.score, list(r.tags)) for r in tagged.collect()}
    assert set(got) == {"t1", "t2"}
    cos = 0.9 / math.hypot(0.9, 0.1)
    assert got["t1"][0] == "s1" and math.isclose(got["t1"][1], 5 * cos + 1, rel_tol=1e-12) and got["t1"][2] == [allowed["deep"]]
    assert got["t2"][0] == "s2" and math.isclose(got["t2"][1], 5.0, rel_tol=1e-12)
    assert {r.source for r in found.collect()} == {"s1", "s2"}


def test_propagate_from_rows_of_empty_tables(spark):
    none = _rows(spark, [])
    emb = spark.createDataFrame([], "utterance_id bigint, embedding array<double>")
    ann = spark.createDataFrame([], "name string, tag string")
    pairs, tagged, _, _ = PP.propagate_from_rows(none, none, emb, ann)
    assert pairs.count() == 0 and tagged.count() == 0

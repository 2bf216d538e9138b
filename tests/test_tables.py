import pytest
from pyspark.sql import functions as F

from speechtab.operators import codes as C
from speechtab.operators import evaluation as EV
from speechtab.operators import prepare as P
from speechtab.operators import segments as SG
from speechtab.operators import speakers as SPK
from speechtab.schema import MissingColumnsError, keep_columns


def test_sample_per_group_size_and_partition_independence(spark):
    rows = [(s, i) for s in range(6) for i in range(s * 3)]
    df = spark.createDataFrame(rows, "spk int, id long")
    a = SPK.sample_per_group(df.repartition(1), "spk", "id", 4, seed=7)
    b = SPK.sample_per_group(df.repartition(5), "spk", "id", 4, seed=7)
    ra = sorted(tuple(r) for r in a.collect())
    assert ra == sorted(tuple(r) for r in b.collect())
    counts = {}
    for s, _ in ra:
        counts[s] = counts.get(s, 0) + 1
    assert counts == {s: min(4, s * 3) for s in range(1, 6)}


def test_manifest_min_duration_boundary(spark):
    rows = [("a", 1, 150.0), ("a", 2, 150.0), ("b", 3, 299.9)]
    df = spark.createDataFrame(rows, "speakerid string, utterance_id long, duration double")
    m = SPK.build_manifest(df, min_duration=300.0, n_per_speaker=10)
    assert sorted(r["speakerid"] for r in m.collect()) == ["a", "a"]


def test_keep_columns_fails_on_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(MissingColumnsError):
        keep_columns(df, ["a", "b"])


def test_segment_lines(spark):
    lines = [
        (0, "# comment"),
        (1, ""),
        (2, "f1/channel1\t(0.5, 1.25) (2.0, 3.75)"),
        (3, "f1/channel1\t(9.0, 9.5)"),
        (4, "f2/channel2\t(0.0, 1.0) longform"),
        (5, "  f2/channel1\t(1.0, 2.0)  "),
    ]
    df = spark.createDataFrame(lines, "line_no long, line string")
    parsed = SG.parse_segment_lines(df)
    kept, rejects = SG.first_per_key(parsed)
    got = sorted((r["filename"], r["channel"], r["segment_no"], r["start"], r["end"]) for r in kept.collect())
    assert got == [("f1", "channel1", 0, 0.5, 1.25), ("f1", "channel1", 1, 2.0, 3.75), ("f2", "channel1", 0, 1.0, 2.0)]
    assert [r["line_no"] for r in rejects.collect()] == [3]


def test_best_attempt_rules(spark):
    rows = [
        (1, 1, 30.0), (1, 2, 10.0), (1, 3, 5.0),      # first accepted: attempt 2
        (2, 1, 30.0), (2, 2, 25.0), (2, 3, 25.0),     # none accepted: lowest, earliest tie -> 2
        (3, 1, 40.0), (3, 4, 1.0),                    # attempt 4 is beyond the retries
    ]
    df = spark.createDataFrame(rows, "item long, attempt int, wer double")
    got = {r["item"]: (r["attempt"], r["accepted"]) for r in EV.best_attempt(df, threshold=20.0, retries=3).collect()}
    assert got == {1: (2, True), 2: (2, False), 3: (1, False)}


def test_clean_noisy_edges(spark):
    rows = spark.createDataFrame([(1, 2, 30.0), (0, 3, 40.0)], "edits long, ref_words long, si_sdr double")
    r = EV.clean_noisy_wer(rows, "si_sdr", 25.0).collect()[0]
    assert r["noisy_wer"] == 0.0 and abs(r["clean_wer"] - 20.0) < 1e-12 and r["percent_clean"] == 1.0
    r = EV.clean_noisy_wer(rows, "si_sdr", 99.0).collect()[0]
    assert r["clean_wer"] is None and r["percent_clean"] == 0.0
    empty = rows.where("edits < 0")
    assert EV.corpus_wer(empty).collect()[0]["wer"] == 100.0


def test_audio_paths_and_unknown_source(spark):
    df = spark.createDataFrame([("a", "x/1.wav"), ("b", "/abs/2.wav")], "source string, relative_audio_path string")
    out = P.add_audio_paths(df, ["a", "b"], ["/root/a/", "/r//b"])
    assert [r["audio_path"] for r in out.orderBy("source").collect()] == ["/root/a/x/1.wav", "/abs/2.wav"]
    bad = spark.createDataFrame([("zzz", "1.wav")], "source string, relative_audio_path string")
    with pytest.raises(Exception):
        P.add_audio_paths(bad, ["a"], ["/r"]).collect()
    with pytest.raises(ValueError):
        P.add_audio_paths(df, ["a", "b"], ["/r"])


def test_merge_metadata_prefers_dataset_and_reports_mismatch(spark):
    ds = spark.createDataFrame([(1, "d1", "x"), (2, "d2", "y")], "id long, text string, lang string")
    md = spark.createDataFrame([(1, "m1", 0.5), (3, "m3", 0.1)], "id long, text string, score double")
    m = P.merge_metadata(ds, md, "id", on_mismatch="inner").collect()
    assert [(r["id"], r["text"], r["score"], r["metadata_id"]) for r in m] == [(1, "d1", 0.5, 1)]
    mm = sorted((r["id"], r["side"]) for r in P.merge_mismatches(ds, md).collect())
    assert mm == [(2, "dataset"), (3, "metadata")]
    with pytest.raises(ValueError):
        P.assert_merge_agrees(ds, md)
    for bad in (md, md.where("id = 1"), ds.unionByName(ds.limit(1))):
        with pytest.raises(Exception, match="id (in|more)"):
            P.merge_metadata(ds, bad, "id").collect()
    assert [r["id"] for r in P.merge_metadata(ds, ds, "id").orderBy("id").collect()] == [1, 2]


def test_mix_sources_keeps_smallest_whole(spark):
    rows = [("a", i) for i in range(400)] + [("b", 1000 + i) for i in range(100)]
    df = spark.createDataFrame(rows, "source string, id long")
    mixed = P.mix_sources(df, {"a": 0.5, "b": 0.5}).groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in mixed}
    assert counts["b"] == 100 and 60 < counts["a"] < 140


def test_snapshot_retention(spark):
    names = ["checkpoint-10-epoch-0", "checkpoint-30-epoch-1", "checkpoint-20-epoch-0", "checkpoint-x", "checkpoint-5-epoch-0", "checkpoint-25", "checkpoint-25"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    r = {x["name"]: (x["keep"], x["latest"]) for x in C.snapshot_retention(df, "name", None, 2).collect()}
    assert C.snapshot_retention(df, "name", None, 2).count() == 6
    assert r == {
        "checkpoint-x": (True, False),
        "checkpoint-30-epoch-1": (True, True),
        "checkpoint-25": (True, False),
        "checkpoint-20-epoch-0": (False, False),
        "checkpoint-10-epoch-0": (False, False),
        "checkpoint-5-epoch-0": (False, False),
    }


def test_length_batches_respect_size(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(200)], "id long, length long")
    out = P.length_batches(df, "id", "length", batch_size=8, megabatch_rows=50).collect()
    per = {}
    for r in out:
        per.setdefault((r["megabatch"], r["batch"]), []).append(r["length"])
    assert all(len(v) <= 8 for v in per.values())
    assert len(out) == 200


def test_positions_within_key_hot_key(spark):
    from pyspark.sql import Window

    from speechtab.operators.ordering import positions_within_key

    rows = [("hot", i % 97, i) for i in range(3000)] + [(f"k{j}", j, j) for j in range(50)]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    got = positions_within_key(df, "key", ["t", "id"], "pos", "total", segments=7)
    want = df.withColumn("pos", (F.row_number().over(Window.partitionBy("key").orderBy("t", "id")) - 1).cast("bigint"))
    g = sorted((r["key"], r["id"], r["pos"], r["total"]) for r in got.collect())
    w = {(r["key"], r["id"]): r["pos"] for r in want.collect()}
    assert all(w[(k, i)] == p for k, i, p, _ in g) and len(g) == 3050
    assert {t for k, _, _, t in g if k == "hot"} == {3000}


def test_positions_without_exchange_reuse(spark):
    from speechtab.operators.ordering import positions_within_key

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1)], "key string, t long")
        got = sorted((r["key"], r["t"], r["pos"]) for r in positions_within_key(df, "key", ["t"], "pos", segments=5).collect())
        assert [p for k, t, p in got if k == "a"] == list(range(500)) and ("b", 1, 0) in got
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_positions_with_payload_columns_at_scale(spark):
    from pyspark.sql import Window
    from speechtab.operators.ordering import positions_within_key

    df = spark.range(300_000).select((F.col("id") % 3).alias("key"), F.xxhash64("id").alias("t"), F.lit("x").alias("payload"), (F.col("id") % 7).alias("other"))
    got = positions_within_key(df, "key", ["t"], "pos", "total")
    want = F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1
    assert got.count() == 300_000
    assert got.withColumn("want", want).where("pos <> want OR total <> 100000").count() == 0


def test_mixing_order_holds_the_sources_in_proportion(spark):
    df = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    mixed = P.mix_sources(df, {"a": 0.5, "b": 0.5}).withColumn("tenth", F.substring("mix_key", 1, 1))
    shares = mixed.groupBy("tenth").agg(F.avg((F.col("source") == "a").cast("int")).alias("s")).collect()
    assert len(shares) == 16 and all(0.4 < r["s"] < 0.6 for r in shares)


def test_histogram_takes_an_extreme_value(spark):
    from speechtab.operators.binning import histogram_table

    df = spark.range(1000).select(F.col("id").cast("double").alias("v")).unionAll(spark.createDataFrame([(1e12,)], "v double"))
    rows = histogram_table(df, "v", 10, std_tolerance=3.0).collect()
    assert sum(r["n"] for r in rows if r["stage"] == "before") == 1001
    assert sum(r["n"] for r in rows if r["stage"] == "after") == 1000


def test_unknown_gender_has_no_label(spark):
    from speechtab.operators.binning import speaker_pitch_labels

    rows = [(i, i, 100.0 + i, "male" if i % 2 else "female") for i in range(40)] + [(90, 90, 500.0, None), (91, 91, 500.0, "other")]
    df = spark.createDataFrame(rows, "speakerid long, utterance_id long, utterance_pitch_mean double, gender string")
    got = {r["speakerid"]: r["pitch"] for r in speaker_pitch_labels(df, ["low", "mid", "high"], speaker_col="speakerid").collect()}
    assert got[90] is None and got[91] is None and got[1] is not None


def test_tokens_are_unicode_words(spark):
    from speechtab.functions.text import count_tokens, simple_tokens

    df = spark.createDataFrame([("déjà vu\u00a0façade, ok",)], "t string")
    r = df.select(simple_tokens(F.col("t")).alias("w"), count_tokens(F.col("t")).alias("n")).collect()[0]
    assert r["w"] == ["déjà", "vu", "façade", ",", "ok"] and r["n"] == 5

import math


from speechtab.operators import codes as C
from speechtab.operators import evaluation as EV
from speechtab.operators import prepare as P
from speechtab.operators import similarity as SIM
from speechtab.operators import stats as ST


def test_split_statistics_rollup(spark):
    rows = [
        ("dev", "a", 3600.0, ["Deep"], None),
        ("dev", "b", 1800.0, None, ["hushed"]),
        ("train", "a", 7200.0, ["Deep"], ["loud"]),
    ]
    df = spark.createDataFrame(
        rows, "split string, speakerid string, duration double, intrinsic_tags array<string>, situational_tags array<string>"
    )
    got = {r["split"]: r for r in ST.split_statistics(df).collect()}
    assert got["dev"]["examples"] == 2 and got["dev"]["speakers"] == 2 and got["dev"]["hours"] == 1.5
    assert got[None]["examples"] == 3 and got[None]["speakers"] == 2 and got[None]["hours_both"] == 2.0
    assert got["dev"]["hours_intrinsic"] == 1.0 and got["dev"]["hours_situational"] == 0.5


def test_manifest_checks(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "speaker string")
    assert ST.manifest_summary(df).collect()[0].asDict() == {"rows": 3, "speakers": 2}
    assert [r["speaker"] for r in ST.speakers_not_n(df, 2).collect()] == ["b"]


def test_frame_to_utterance_sample_std(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (1, 3.0, 2.0, 4.0), (2, 5.0, 1.0, 1.0)], "u long, p double, s double, c double")
    got = {r["u"]: r for r in ST.frame_to_utterance(df, "u", "p", "s", "c").collect()}
    assert got[1]["utterance_pitch_mean"] == 2.0 and math.isclose(got[1]["utterance_pitch_std"], math.sqrt(2.0))
    assert got[2]["utterance_pitch_std"] is None


def test_pad_batches_modes(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3]), (2, 0, [4]), (3, 1, [5, 6])], "id long, b long, s array<int>")
    longest = {r["id"]: r["padded"] for r in C.pad_batches(df, "s", "b", multiple_of=4).collect()}
    assert longest == {1: [1, 2, 3, -100], 2: [4, -100, -100, -100], 3: [5, 6, -100, -100]}
    fixed = {r["id"]: r["padded"] for r in C.pad_batches(df, "s", "b", pad_value=0, mode="max_length", max_length=2, side="left").collect()}
    assert fixed == {1: [2, 3], 2: [0, 4], 3: [5, 6]}


def test_trim_codes_and_longest_clip(spark):
    df = spark.createDataFrame(
        [(1, 0, [[1, 2, 3, 4], [5, 6, 7, 8]], 100), (2, 0, [[1, 2, 3, 4], [5, 6, 7, 8]], 50)],
        "id long, b long, labels array<array<int>>, target_length int",
    )
    got = {r["id"]: r["trimmed"] for r in C.trim_codes(df, "labels", "target_length", "b").collect()}
    assert got == {1: [[1, 2, 3, 4], [5, 6, 7, 8]], 2: [[1, 2], [5, 6]]}
    r = C.longest_clip(df).collect()[0]
    assert (r["target_length"], r["label_length"]) == (100, 4)


def test_topk_accuracy_ties_and_cosine_eps(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9], 2), ([0.5, 0.1, 0.2], 0), ([0.3, 0.3, 0.1], 1)], "s array<double>, t int")
    r = EV.topk_accuracy(df, "s", "t", ks=(1, 2)).collect()[0]
    # row 1: index 1 ties and wins (lower index) -> rank 2; row 2: rank 1; row 3: tie with index 0 -> rank 2
    assert math.isclose(r["top1"], 100 / 3) and math.isclose(r["top2"], 100.0)
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert EV.paired_cosine(z, "a", "b").collect()[0]["cosine"] == 0.0


def test_metric_names_and_means(spark):
    df = spark.createDataFrame([(1, "loss", 1.0), (1, "loss", 3.0), (1, "codebook_0_loss", 2.0)], "step long, key string, value double")
    got = {r["name"]: r["value"] for r in EV.metric_means(df).collect()}
    assert got == {"eval/loss": 2.0, "codebook_eval/codebook_0_loss": 2.0}


def test_pair_correlation_per_batch(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 2.0, 2.0), (1, 1.0, 2.0), (1, 2.0, 1.0)], "b int, score double, label double")
    assert math.isclose(SIM.pair_correlation(df, "b").collect()[0]["pearson"], 0.0, abs_tol=1e-12)
    whole = SIM.pair_correlation(df).collect()[0]["pearson"]
    assert math.isclose(whole, 0.0, abs_tol=1e-12)


def test_subsets_orders_and_unions(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(50)], "id long, src string")
    a = [r["id"] for r in P.seeded_subset(df, 5, "id", seed=1).collect()]
    b = [r["id"] for r in P.seeded_subset(df.repartition(4), 5, "id", seed=1).collect()]
    assert a == b and len(a) == 5
    assert [r["id"] for r in P.first_rows(df, 3, "id").collect()] == [0, 1, 2]
    e = P.epoch_order(df, "id", [0, 1]).groupBy("epoch").count().collect()
    assert sorted((r["epoch"], r["count"]) for r in e) == [(0, 50), (1, 50)]
    u = P.concat_tables([df.limit(2), df.select("id").limit(1)], ["x", "y"], "part")
    assert sorted((r["part"], r["src"]) for r in u.collect())[-1] == ("y", None)


def test_explode_descriptions_and_reattach(spark):
    df = spark.createDataFrame([(1, ["calm voice", "low pitch"])], "id long, text_description array<string>")
    rows = sorted((r["description_index"], r["description"]) for r in P.explode_descriptions(df).collect())
    assert rows == [(0, "calm voice"), (1, "low pitch")]
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    comp = spark.createDataFrame([(2, 0.5)], "id long, snr double")
    got = {r["id"]: r["noise_db"] for r in P.reattach(base, comp, "id", {"snr": "noise_db"}).collect()}
    assert got == {1: None, 2: 0.5}

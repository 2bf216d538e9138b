import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from speechtab.schema import MANIFEST
from speechtab.sources import io as IO


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="speechtab-io-")


def test_tsv_round_trip(spark, tmp):
    df = spark.createDataFrame([("a.wav", "s1", "n1", 1.5), ("b.wav", "s2", "n2", 2.0)], MANIFEST)
    IO.write_tsv(df, f"{tmp}/m", ["audio_path", "speaker", "name", "duration"])
    back = IO.read_tsv(spark, f"{tmp}/m", MANIFEST)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_annotation_map_votes(spark, tmp):
    with open(f"{tmp}/ann.json", "w") as f:
        json.dump({"x": ["Deep", "Deep", "Husky"], "y": []}, f, indent=2)
    votes = sorted(tuple(r) for r in IO.read_annotation_map(spark, f"{tmp}/ann.json").collect())
    assert votes == [("x", "Deep"), ("x", "Deep"), ("x", "Husky")]


def test_save_or_reuse_and_split_load(spark, tmp):
    df = spark.createDataFrame([(1, "train"), (2, "dev")], "id long, split string")
    a = IO.save_or_reuse(spark, df, f"{tmp}/t")
    b = IO.save_or_reuse(spark, df.limit(0), f"{tmp}/t")  # already there: reused
    assert a.count() == b.count() == 2
    assert [r["id"] for r in IO.load_table(spark, f"{tmp}/t", split="dev").collect()] == [2]


def test_chunks_and_resume(spark, tmp):
    for c in (0, 1, 2):
        IO.append_chunk(spark.createDataFrame([(c * 10,)], "v long"), f"{tmp}/chunks", c)
    assert IO.done_chunks(spark, f"{tmp}/chunks") == [0, 1, 2]
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp}/chunks").collect()) == [0, 10, 20]


def test_edges_round_trip(spark, tmp):
    learned = spark.createDataFrame([([0.0, 1.0, 2.0],)], "edges array<double>")
    t = IO.edges_table({"noise": learned, "speaking_rate": [0.0, 5.0]}, spark)
    IO.save_edges(t, f"{tmp}/edges")
    assert IO.load_edges(spark, f"{tmp}/edges") == {"noise": [0.0, 1.0, 2.0], "speaking_rate": [0.0, 5.0]}


def test_list_files_and_source_specs(spark, tmp):
    os.makedirs(f"{tmp}/d/sub")
    for p in ("d/a.wav", "d/sub/b.wav", "d/sub/b_denoised.wav", "d/c.txt"):
        with open(f"{tmp}/{p}", "wb") as f:
            f.write(b"xx")
    got = IO.list_files(spark, f"{tmp}/d", "*.wav", exclude_like=["%_denoised.wav"]).select("path").collect()
    assert sorted(os.path.basename(r[0]) for r in got) == ["a.wav", "b.wav"]
    spec = IO.parse_sources("a+b", config="c1+c2", split="train+dev", weight="1+2")
    assert [s.split for s in spec] == ["train", "dev"] and spec[1].weight == 2.0 and IO.parse_sources("a")[0].split == "train"
    with pytest.raises(ValueError):
        IO.parse_sources("a+b", config="c1")


def test_json_rows_and_run_args(spark, tmp):
    df = spark.createDataFrame([("t1", "p1"), ("t2", "p2")], "k string, v string")
    IO.write_json_rows(df, f"{tmp}/j")
    assert sorted(tuple(r) for r in spark.read.schema("k string, v string").json(f"{tmp}/j").collect()) == [("t1", "p1"), ("t2", "p2")]
    IO.write_run_arguments(spark, {"checkpoint_every": 100, "seed": None}, f"{tmp}/args")
    assert spark.read.json(f"{tmp}/args").count() == 1


def test_load_many_tags_source_and_split(spark, tmp):
    spark.createDataFrame([(1, "train"), (2, "dev")], "id long, split string").write.parquet(f"{tmp}/a")
    spark.createDataFrame([(3, "x")], "id long, text string").write.parquet(f"{tmp}/b")
    specs = IO.parse_sources("a+b", split="dev+train")
    got = sorted((r["source"], r["id"], r["split"], r["text"]) for r in IO.load_many(spark, specs, root=tmp).collect())
    assert got == [("a", 2, "dev", None), ("b", 3, "train", "x")]


def test_load_many_merges_metadata_and_mixes(spark, tmp):
    for name, lo in (("a", 0), ("b", 1000)):
        df = spark.range(lo, lo + 400).select("id", F.when(F.col("id") % 2 == 0, "train").otherwise("dev").alias("split"))
        df.write.parquet(f"{tmp}/{name}/c1")
        df.select("id", "split", (F.col("id") * 2).alias("twice")).write.parquet(f"{tmp}/{name}_md/c1")
    specs = IO.parse_sources("a+b", config="c1+c1", weight="3+1", metadata="a_md+b_md")
    got = IO.load_many(spark, specs, root=tmp)
    assert got.where("twice <> 2 * id OR split <> 'train' OR mix_key IS NULL").count() == 0
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert n["a"] == 200 and 40 < n["b"] < 95
    spark.range(3).write.parquet(f"{tmp}/c_md")
    spark.range(4).write.parquet(f"{tmp}/c")
    with pytest.raises(Exception, match="id in the dataset"):
        IO.load_many(spark, IO.parse_sources("c", metadata="c_md"), root=tmp).collect()


def test_a_half_written_table_is_not_reused(spark, tmp):
    import glob

    df = spark.range(100).withColumn("split", F.lit("train"))
    spark.range(3).withColumn("split", F.lit("train")).write.partitionBy("split").parquet(f"{tmp}/t")
    for f in glob.glob(f"{tmp}/t/*_SUCCESS*") + glob.glob(f"{tmp}/t/.*SUCCESS*"):
        os.remove(f)
    assert IO.save_or_reuse(spark, df, f"{tmp}/t").count() == 100
    assert IO.save_or_reuse(spark, df.limit(1), f"{tmp}/t").count() == 100


def test_a_chunk_written_twice_is_there_once(spark, tmp):
    for k in (0, 1, 1):
        IO.append_chunk(spark.range(5), f"{tmp}/c", k)
    assert spark.read.parquet(f"{tmp}/c").count() == 10


def test_checkpoint_dir_comes_from_the_session(spark):
    from speechtab.session import ensure_checkpoint_dir, materialize

    configured = spark.conf.get("spark.checkpoint.dir")
    # Spark checkpoints into a fresh sub-folder of the configured one
    assert configured and configured.rstrip("/").split(":")[-1] in ensure_checkpoint_dir(spark)
    df = spark.range(5)
    assert materialize(df, reliable=True).count() == 5
    assert materialize(df).count() == 5


def test_lines_of_several_files_cut_into_splits_keep_their_order(spark, tmp):
    from speechtab.operators.segments import first_per_key, parse_segment_lines, read_lines

    os.makedirs(f"{tmp}/lines")
    want = []
    for f in range(5):
        # the first file is the largest, so a scan that packs by size starts with it
        rows = [f"clip{(n * 7 + f) % 90}/ch\t({f}.0, {n}.5)" for n in range(4000 if f == 0 else 300 * f)]
        want += rows
        with open(f"{tmp}/lines/part-{f}.txt", "w") as out:
            out.write("\n".join(rows) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        lines = read_lines(spark, f"{tmp}/lines")
        assert lines.rdd.getNumPartitions() > 10
        assert [r["line"] for r in lines.orderBy("line_no").collect()] == want
        kept, rejects = first_per_key(parse_segment_lines(lines))
        got = {r["filename"]: (r["start"], r["end"]) for r in kept.collect()}
        n_rejects = rejects.count()
    finally:
        spark.conf.set(key, before)
    first = {}
    for row in want:
        head, times = row.split("\t")
        first.setdefault(head.split("/")[0], tuple(float(x) for x in times[1:-1].split(", ")))
    assert got == first and n_rejects == len(want) - len(first)

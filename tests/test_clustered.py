"""Clustered tables: order on disk, no shuffle under joins and windows, hot
keys cut into parts; reports counted by the write itself."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from speechtab.operators import reports as R
from speechtab.operators import segments as SG
from speechtab.sources import clustered as CL
from speechtab.sources import io as IO
from speechtab.streaming import scratch_dir


@pytest.fixture(scope="module")
def saved(spark):
    """Speakers 0..19 with ten rows each, speaker 7 with a further 700, and rows
    without a speaker."""
    rows = [(i, i % 20) for i in range(200)] + [(1000 + i, 7) for i in range(700)] + [(5000 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, speaker bigint").repartition(5)
    root, name = scratch_dir(spark, "t-clustered"), "t_" + uuid.uuid4().hex[:10]
    table = CL.save_clustered(df, name, f"{root}/rows", "speaker", "id", 4, rows_per_part=100)
    names = spark.createDataFrame([(k, f"name {k}") for k in range(19)], "speaker bigint, name string")
    beside = CL.save_beside(names, table, f"{name}_b", f"{root}/beside", "speaker", 4)
    return table, beside, root


def test_rows_and_parts(saved):
    table, beside, _ = saved
    assert table.count() == 905
    parts = {(r.speaker, r.part): r.n for r in table.groupBy("speaker", "part").agg(F.count("*").alias("n")).collect()}
    assert {p for s, p in parts if s == 7} == set(range(8))  # 710 rows
    assert all(n < 200 for n in parts.values())
    assert {p for s, p in parts if s != 7} == {0}
    d = {(r.speaker, r.part): (r.rows, r.before, r.name) for r in beside.collect()}
    assert {k: v[0] for k, v in d.items()} == parts
    hot = [d[7, p] for p in range(8)]
    assert [h[1] for h in hot] == [sum(x[0] for x in hot[:i]) for i in range(8)]
    assert d[7, 3][2] == "name 7" and d[19, 0][2] is None and d[None, 0][2] is None


def test_each_file_lies_in_order(spark, saved):
    _, _, root = saved
    files = IO.list_files(spark, f"{root}/rows", "*.parquet").collect()
    assert 1 < len(files) <= 4
    import pyarrow.parquet as pq

    for f in files:
        t = pq.read_table(re.sub("^file:/*", "/", f["path"])).to_pylist()
        keys = [(-1 if r["speaker"] is None else r["speaker"], r["part"], r["id"]) for r in t]
        assert keys == sorted(keys)


def test_attach_moves_no_row_and_numbers_a_key(saved):
    table, beside, _ = saved
    out = CL.attach(table, beside, "speaker", "id")
    # adaptive planning could broadcast the small side here: forbid it, so that the buckets have to serve
    with_hint = CL.attach(table, beside.hint("merge"), "speaker", "id")
    plan = with_hint._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    rows = out.collect()
    assert len(rows) == 905
    for key in (3, 7):
        mine = sorted((r.position, r.part, r.id) for r in rows if r.speaker == key)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert {r.name for r in rows if r.speaker is None} == {None}


def test_group_by_key_and_part_moves_no_row(saved):
    table, _, _ = saved
    plan = table.groupBy("speaker", "part").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_clustered_edge_cases(spark):
    empty = spark.createDataFrame([], "id bigint, speaker string, extra int")
    root, name = scratch_dir(spark, "t-clustered"), "t_" + uuid.uuid4().hex[:10]
    t = CL.save_clustered(empty, name, root, "speaker", "id", 2)
    assert t.count() == 0 and t.columns == ["id", "speaker", "extra", "part"]
    with pytest.raises(ValueError, match="part"):
        CL.save_clustered(empty.withColumn("part", F.lit(1)), name + "x", root + "x", "speaker", "id", 2)
    with pytest.raises(ValueError, match="directory"):
        CL.save_beside(t.groupBy("speaker").agg(F.count("*").alias("rows")), t, name + "y", root + "y", "speaker", 2)
    # repeated ids and text keys: rows that share an id stay in one part
    df = spark.createDataFrame([(i % 3, "a") for i in range(30)], "id bigint, speaker string")
    t = CL.save_clustered(df, name + "z", root + "z", "speaker", "id", 2, rows_per_part=4)
    assert t.count() == 30
    assert t.groupBy("id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


def test_merge_counts(spark, tmp_path):
    ds = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "id int, src string")
    md = spark.createDataFrame([(2, "x", 5), (3, "y", 6), (3, "z", 7), (9, "q", 8)], "id int, src string, q int")
    out, seen = R.merge_counted(ds, md)
    out.write.parquet(str(tmp_path / "m"))
    assert seen.get == {"rows": 6, "dataset_only": 2, "metadata_only": 1, "repeated": 2}
    rows = sorted((r.id, r.metadata_id, r.src, r.q) for r in spark.read.parquet(str(tmp_path / "m")).collect())
    assert rows == [(2, 2, "b", 5), (3, 3, "c", 6), (3, 3, "c", 7)]
    out, seen = R.merge_counted(ds.limit(0), md.limit(0))
    assert out.collect() == [] and seen.get["dataset_only"] == 0


def test_a_later_filter_does_not_change_the_counts(spark):
    ds = spark.createDataFrame([(1, "a"), (2, "b")], "id int, src string")
    md = spark.createDataFrame([(2, 5), (9, 8)], "id int, q int")
    out, seen = R.merge_counted(ds, md)
    assert out.where("q > 100").collect() == []
    assert seen.get == {"rows": 3, "dataset_only": 1, "metadata_only": 1, "repeated": 0}


def test_first_lines_and_cuts_counted(spark):
    segs = spark.createDataFrame(
        [("f", "1", 0, 0.0, 1.0, 10), ("f", "1", 1, 1.0, 2.0, 10), ("f", "1", 0, 5.0, 6.0, 20), (None, "1", 0, 0.0, 1.0, 30)],
        "filename string, channel string, segment_no int, start double, end double, line_no bigint",
    )
    kept, seen = R.first_per_key_counted(segs)
    plain, rejects = SG.first_per_key(segs)
    assert sorted(kept.collect()) == sorted(plain.select(*segs.columns).collect())
    assert seen.get == {"rows": 4, "rejected": rejects.count()} and rejects.count() == 2
    clips = spark.createDataFrame(
        [("f", "1", [0.5] * 32, 16), ("g", "1", [0.5] * 32, 16), (None, "1", [0.5], 16)],
        "filename string, channel string, samples array<double>, sampling_rate int",
    )
    cut, seen = R.cut_segments_counted(clips, plain)
    want, missing = SG.cut_segments(clips, plain)
    assert sorted(cut.collect()) == sorted(want.select(*cut.columns).collect())
    assert seen.get["without_segments"] == missing.count() == 2


def test_conditions_that_are_null_do_not_count(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    out, seen = R.counted(df, large=F.col("x") > 2)
    assert len(out.collect()) == 3 and seen.get == {"rows": 3, "large": 1}
    with pytest.raises(ValueError):
        R.counted(df, rows=F.col("x") > 2)


def test_run_arguments_come_back(spark):
    path = scratch_dir(spark, "t-args")
    IO.write_run_arguments(spark, {"limit": 2.5, "name": "x", "seed": 42, "resume": None}, path)
    assert IO.read_run_arguments(spark, path) == {"limit": "2.5", "name": "x", "seed": "42"}

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from speechtab.operators.training import CodeLayout, TrainingLimits, training_labels, training_table
from speechtab.sources import io as IO

LAYOUT = CodeLayout(2, 90, 91)
LIMITS = TrainingLimits(20, 1.0, 3.0, 10, max_description_tokens=3, max_prompt_tokens=4)
CODES = "id long, codes array<array<int>>, target_length int, batch long"


def _codes(spark, rows):
    return spark.createDataFrame(rows, CODES)


def test_labels_lose_the_padding_of_their_batch(spark):
    codes = _codes(spark, [
        (1, [[1, 2, 3, 4], [5, 6, 7, 8]], 20, 0),  # the longest of its batch keeps all frames
        (2, [[1, 2, 3, 4], [5, 6, 7, 8]], 10, 0),  # half as long: half the frames
        (3, [[1, 2, 3, 4], [5, 6, 7, 8]], 10, None),
    ])
    got = {r["id"]: r["labels"] for r in training_labels(codes, LAYOUT).collect()}
    assert got[1] == [[1, 2, 3, 4, 91, 91], [90, 5, 6, 7, 8, 91]]
    assert got[2] == [[1, 2, 91, 91], [90, 5, 6, 91]]
    assert got[3] == got[1]


def test_table_keeps_what_passes_every_limit(spark):
    m = [[1, 2], [3, 4]]
    ds = spark.createDataFrame(
        [(k, p, "own") for k, p in [(1, "one two \n"), (2, "a b c d"), (3, "ok"), (4, "ok"), (5, None), (6, "ok"), (7, "ok"), (8, ""), (9, "ok")]],
        "id long, prompt string, labels string",
    )
    md = spark.createDataFrame(
        [(1, "calm voice"), (2, "calm voice"), (3, "a b c"), (4, "x" * 20), (5, "calm"), (6, None), (7, "calm"), (8, ""), (9, "calm")],
        "id long, description string",
    )
    # 7 is too long, 9 has no codes
    codes = _codes(spark, [(k, m, 30 if k == 7 else 20, k) for k in range(1, 9)])
    out = training_table(ds, md, codes, LAYOUT, LIMITS)
    rows = {r["id"]: r for r in out.collect()}
    # 2: four tokens, 3: three, 4: twenty characters, 5 and 6: no text
    assert sorted(rows) == [1, 8]
    assert rows[1]["prompt"] == "one two" and rows[1]["prompt_tokens"] == 2 and rows[1]["description_tokens"] == 2
    assert rows[1]["labels"] == [[1, 2, 91, 91], [90, 3, 4, 91]] and rows[1]["target_length"] == 20
    assert rows[8]["prompt_tokens"] == 0
    loose = training_table(ds, md, codes, LAYOUT, TrainingLimits(100, 1.0, 3.5, 10))
    assert sorted(r["id"] for r in loose.collect()) == [1, 2, 3, 4, 7, 8]
    empty = training_table(ds.limit(0), md.limit(0), codes.limit(0), LAYOUT, LIMITS)
    assert empty.count() == 0


def test_table_raises_where_the_metadata_disagrees(spark):
    ds = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    md = spark.createDataFrame([(1, "calm")], "id long, description string")
    codes = _codes(spark, [(k, [[1, 2], [3, 4]], 20, k) for k in (1, 2)])
    with pytest.raises(Exception, match="in the dataset but not in the metadata"):
        training_table(ds, md, codes, LAYOUT, LIMITS).collect()
    kept = training_table(ds, md, codes, LAYOUT, LIMITS, on_mismatch="inner")
    assert [r["id"] for r in kept.collect()] == [1]


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_chunks_in_one_pass_resume_with_what_is_missing(spark):
    path = tempfile.mkdtemp(prefix="speechtab-chunks-") + "/t"
    df = spark.range(100).withColumn("chunk_id", F.expr("id div 10"))
    assert IO.done_chunks(spark, path) == []
    assert IO.write_chunks(df.where("chunk_id in (0, 3)"), path) == []
    before = _files(path)
    # what a stopped run leaves behind is no chunk
    os.makedirs(f"{path}/.spark-staging-1/chunk_id=5")
    assert IO.write_chunks(df, path) == [0, 3]
    assert before < _files(path)  # the first two were not written again
    assert IO.done_chunks(spark, path) == list(range(10))
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(100))
    after = _files(path)
    assert IO.write_chunks(df, path) == list(range(10)) and _files(path) == after


def test_chunks_of_an_empty_table_and_rows_without_a_chunk(spark):
    path = tempfile.mkdtemp(prefix="speechtab-chunks-") + "/t"
    df = spark.range(4).withColumn("chunk_id", F.expr("id div 2"))
    assert IO.write_chunks(df.limit(0), path) == [] and IO.done_chunks(spark, path) == []
    with pytest.raises(Exception, match="row without a chunk_id"):
        IO.write_chunks(df.withColumn("chunk_id", F.when(F.col("id") > 1, F.col("chunk_id"))), path)
    assert IO.write_chunks(df, path) == [] and IO.done_chunks(spark, path) == [0, 1]


@pytest.mark.parametrize("later", ["description <> ''", "prompt <> ''", "id > 0 and metadata_id > 0"])
def test_a_later_filter_does_not_hide_ids_that_disagree(spark, later):
    from speechtab.operators.prepare import merge_metadata

    ds = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    md = spark.createDataFrame([(1, "calm"), (3, "calm")], "id long, description string")
    for left, right in ((ds, md.where("id = 1")), (ds.where("id = 1"), md)):
        with pytest.raises(Exception, match="id in the "):
            merge_metadata(left, right).where(later).collect()
    assert merge_metadata(ds.where("id = 1"), md.where("id = 1")).where(later).count() == 1

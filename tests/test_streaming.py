import pandas as pd
from pyspark.sql import types as T

from speechtab.operators.enrich import enrich
from speechtab.plans import streams as PS

SF = "/root/testdata/sf0.001"


def test_stream_chunks_equal_batch_twin(spark):
    batch = sorted(tuple(r) for r in PS.chunk_emission(spark, SF).collect())
    stream = sorted(tuple(r) for r in PS.stream_chunks(spark, SF).select("user_id", "event_id", "position", "chunk").collect())
    assert stream == batch


def test_chunk_rule_small_case(spark):
    from speechtab.streaming import chunk_emission

    df = spark.createDataFrame([("k", i, i) for i in range(23)], "key string, item long, t long")
    got = [r["chunk"] for r in chunk_emission(df, "key", ["t"], "item", 10, 3).orderBy("position").collect()]
    # chunk 1: items 0..6, chunk 2: 7..16, end flush (chunk 3): 17..22
    assert got == [1] * 7 + [2] * 10 + [3] * 6


def test_stream_labels_equal_batch(spark):
    s = sorted(tuple(r) for r in PS.stream_labels(spark, SF).collect())
    assert len(s) == 1000


def test_enrich_capture(spark):
    df = spark.createDataFrame([(1, "ok text"), (2, "secret"), (3, "")], "id long, t string")

    def factory():
        def score(pdf):
            if any("secret" in x for x in pdf["t"]):
                raise ValueError("no")
            return pd.DataFrame({"n": [len(x) for x in pdf["t"]]})

        return score

    schema = T.StructType([T.StructField("n", T.LongType())])
    got = {r["id"]: (r["n"], r["error"]) for r in enrich(df, factory, ["t"], schema, keep_cols=["id"], on_error="capture").collect()}
    assert got[1] == (7, None) and got[3] == (0, None)
    assert got[2][0] is None and got[2][1].startswith("ValueError")


def test_interleave_two_file_streams(spark):
    import tempfile

    from speechtab.streaming import file_stream, interleave_streams, run_append, scratch_dir

    base = tempfile.mkdtemp(prefix="speechtab-streams-")
    spark.createDataFrame([(1, "x")], "id long, t string").write.parquet(f"{base}/a")
    spark.createDataFrame([(2, 0.5)], "id long, v double").write.parquet(f"{base}/b")
    a = file_stream(spark, f"{base}/a", "*.parquet", T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())]))
    b = file_stream(spark, f"{base}/b", "*.parquet", T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())]))
    out = scratch_dir(spark, "interleave")
    run_append(interleave_streams([a, b], ["a", "b"]), out + "/t", out + "/c")
    rows = sorted((r["source"], r["id"], r["t"], r["v"]) for r in spark.read.parquet(out + "/t").collect())
    assert rows == [("a", 1, "x", None), ("b", 2, None, 0.5)]


def test_enrich_factory_gets_task_context(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").repartition(2)

    def factory(ctx):
        pid = ctx.partitionId()

        def score(pdf):
            return pd.DataFrame({"part": [pid] * len(pdf)})

        return score

    schema = T.StructType([T.StructField("part", T.IntegerType())])
    parts = {r["part"] for r in enrich(df, factory, ["t"], schema, keep_cols=["id"], with_context=True).collect()}
    assert parts <= {0, 1} and len(parts) >= 1


def test_enrich_factory_with_a_default_argument(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").repartition(2)

    def factory(scale=3):
        return lambda pdf: pd.DataFrame({"n": [scale] * len(pdf)})

    schema = T.StructType([T.StructField("n", T.IntegerType())])
    assert {r["n"] for r in enrich(df, factory, ["t"], schema, keep_cols=["id"]).collect()} == {3}


def test_stream_chunks_of_strings_over_several_batches(spark):
    from speechtab.streaming import chunk_emission, file_stream, run_append, scratch_dir, stream_chunks

    rows = [("k", f"i{n:03d}", n, False) for n in range(47)] + [("k", "", 99, True), ("open", "x", 1, False)]
    schema = "key string, item string, t long, is_end boolean"
    out = scratch_dir(spark, "strings")
    stream = file_stream(spark, out + "/in/*", "*.parquet", spark.createDataFrame([], schema).schema)
    for k, (lo, hi) in enumerate([(0, 5), (5, 23), (23, 49)]):
        spark.createDataFrame(rows[lo:hi], schema).repartition(3).write.parquet(f"{out}/in/{k}")
        run_append(stream_chunks(stream, "key", "item", ["t"]), out + "/t", out + "/c")
    got = sorted((r["item"], r["position"], r["chunk"]) for r in spark.read.parquet(out + "/t").collect())
    batch = chunk_emission(spark.createDataFrame(rows[:47], schema).drop("is_end"), "key", ["t"], "item")
    assert got == sorted((r["item"], r["position"], r["chunk"]) for r in batch.collect())


def _chunk_inputs(spark, name):
    from speechtab.streaming import file_stream, scratch_dir

    schema = "key string, item string, t long, is_end boolean"
    out = scratch_dir(spark, name)
    return out, schema, file_stream(spark, out + "/in/*", "*.parquet", spark.createDataFrame([], schema).schema)


def test_listed_chunks_of_strings_over_several_batches(spark):
    from speechtab.streaming import chunk_emission, run_append
    from speechtab.streaming.chunks import list_state_store, stream_chunks_listed

    rows = [("k", f"i{n:03d}", n, False) for n in range(47)] + [("k", "", 99, True), ("open", "x", 1, False)]
    out, schema, stream = _chunk_inputs(spark, "listed")
    for k, (lo, hi) in enumerate([(0, 5), (5, 23), (23, 49)]):
        spark.createDataFrame(rows[lo:hi], schema).repartition(3).write.parquet(f"{out}/in/{k}")
        with list_state_store(spark):
            run_append(stream_chunks_listed(stream, "key", "item", ["t"]), out + "/t", out + "/c")
        seen = spark.read.parquet(out + "/t").count()
        assert seen == (0, 17, 47)[k]  # what is final after each batch, and no more
    got = sorted((r["item"], r["position"], r["chunk"]) for r in spark.read.parquet(out + "/t").collect())
    batch = chunk_emission(spark.createDataFrame(rows[:47], schema).drop("is_end"), "key", ["t"], "item")
    assert got == sorted((r["item"], r["position"], r["chunk"]) for r in batch.collect())


def test_listed_chunks_close_a_silent_key_by_timer(spark):
    import time

    from speechtab.streaming.chunks import list_state_store, stream_chunks_listed

    out, schema, stream = _chunk_inputs(spark, "timer")
    spark.createDataFrame([("k", f"i{n:02d}", n, False) for n in range(13)], schema).write.parquet(f"{out}/in/0")
    with list_state_store(spark):
        chunks = stream_chunks_listed(stream, "key", "item", ["t"], timeout_ms=1500)
        w = chunks.writeStream.format("parquet").option("path", out + "/t").option("checkpointLocation", out + "/c")
        q = w.outputMode("append").trigger(processingTime="500 milliseconds").start()
    rows = []
    try:
        for _ in range(60):
            time.sleep(0.5)
            rows = spark.read.schema(chunks.schema).parquet(out + "/t").collect() if q.lastProgress else []
            if len(rows) == 13 or not q.isActive:
                break
    finally:
        q.stop()
    assert sorted((r["key"], r["position"], r["chunk"]) for r in rows) == [("k", p, 1 if p < 7 else 2) for p in range(13)]


def test_votes_repeated_late_and_unknown(spark):
    from datetime import datetime, timedelta

    from speechtab.operators.tags import tag_votes
    from speechtab.streaming import file_stream, latest, run_update, scratch_dir
    from speechtab.streaming import votes as V

    t0 = datetime(2024, 1, 1)
    schema = "vote_id long, name long, tag string, ts timestamp"
    at = lambda h: t0 + timedelta(hours=h)
    arrivals = [
        [(1, 7, "Deep", at(10)), (1, 7, "Deep", at(10)), (2, 7, "Husky", at(11)), (3, 8, "Crisp", at(12))],
        # 1 and 2 again (within the delay), an id and a time that are missing
        [(1, 7, "Deep", at(10)), (2, 7, "Husky", at(11)), (4, 7, "Deep", at(13)), (None, 7, "Deep", at(13)), (5, 7, "Deep", None)],
        # the watermark is at 13 - 5: 6 is late by it, 7 just is not
        [(6, 7, "Husky", at(8)), (7, 7, "Husky", at(8) + timedelta(seconds=1)), (8, None, "Deep", at(14)), (9, 7, None, at(14))],
    ]
    out = scratch_dir(spark, "votes-test")
    empty = spark.createDataFrame([], schema)
    stream = V.admitted_votes(file_stream(spark, out + "/in/*", "*.parquet", empty.schema), "5 hours")
    late = []
    for k, part in enumerate(arrivals):
        spark.createDataFrame(part, schema).write.parquet(f"{out}/in/{k}")
        late.append(V.run_admitted(stream, out + "/adm", out + "/adm-c"))
        counts = V.running_votes(file_stream(spark, out + "/adm", "*.parquet", empty.schema))
        run_update(counts, out + "/n", out + "/n-c")
    assert late == [0, 0, 1]
    admitted = spark.read.parquet(out + "/adm")
    assert sorted(r["vote_id"] for r in admitted.collect()) == [1, 2, 3, 4, 7, 8, 9]
    t = latest(spark, out + "/n", ["name", "tag"])
    # Crisp is not on the list of tags that spread; a vote without a name is one of nobody
    assert {(r["name"], r["tag"]): r["votes"] for r in t.collect()} == {(7, "Deep"): 2, (7, "Husky"): 2, (None, "Deep"): 1}
    assert sorted(map(tuple, V.voted_tags(t).collect())) == sorted(map(tuple, tag_votes(admitted).collect())) == [(7, ["Deep", "Husky"])]

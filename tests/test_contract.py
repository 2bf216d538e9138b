"""Contract queries vs their DuckDB oracle on the smallest test tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


FAST = [
    "noise_labels", "rate_labels_learned", "speaker_pitch_labels", "tag_votes", "similar_speakers",
    "propagated_tags", "manifest_sample", "best_attempt", "word_error_rows", "delay_labels",
    "segments_parsed", "mixed_sources", "length_batches", "value_histogram",
    "training_table", "chunked_codes", "segments_from_files", "listed_files", "running_tag_votes",
    "clustered_speakers", "observed_reports", "resumed_manifest", "pair_correlation_batched", "propagated_from_rows",
]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(res.columns, res.fetchall())


def test_every_query_has_oracle():
    from speechtab.plans.contract import registry

    assert set(registry()) <= set(E.queries()) and set(registry()) <= set(E.oracle_sql())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0

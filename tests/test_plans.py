"""Plan properties of every contract query (SURVEY: UDF2 is a rule, checked
on the plans; no cross products; top-k and sampling are pre-limited)."""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"

# queries whose plans may hold a Python node: the blocked similarity product,
# compatibility folding, the word edit distance, the pluggable scorer (and plans built on them)
PYTHON_ALLOWED = {
    "similar_speakers", "similar_speakers_all", "propagated_tags", "propagated_from_rows", "match_statistics",
    "normalised_by_language", "word_error_rows", "corpus_wer", "clean_noisy_wer", "enrich_scores",
}
PYTHON_NODES = re.compile(r"\b(BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|FlatMapCoGroupsInPandas|PythonMapInArrow)\b")
CROSS = re.compile(r"\b(CartesianProduct|BroadcastNestedLoopJoin)\b")


@pytest.fixture(scope="module")
def plans(spark):
    out = {}
    from speechtab.plans.contract import registry

    for name in sorted(registry()):
        fn = E.queries()[name]
        spark.catalog.clearCache()
        out[name] = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cross_products(plans):
    bad = [n for n, p in plans.items() if CROSS.search(p)]
    assert bad == []


def test_python_only_where_needed(plans):
    bad = [n for n, p in plans.items() if PYTHON_NODES.search(p) and n not in PYTHON_ALLOWED]
    assert bad == []


def test_no_row_at_a_time_udfs(plans):
    assert [n for n, p in plans.items() if "BatchEvalPython" in p] == []


@pytest.mark.parametrize("name", ["manifest_sample", "similar_speakers", "snapshot_retention"])
def test_rank_limits_are_pushed_map_side(plans, name):
    assert "WindowGroupLimit" in plans[name] and "Partial" in plans[name]


def test_scans_read_only_needed_columns(plans):
    # the similarity queries never read the label column of embeddings with the vectors
    for name in ("speaker_median_vectors", "noise_labels"):
        schemas = re.findall(r"ReadSchema: (struct<[^\n]*?>)", plans[name])
        assert schemas and all("props" not in s and "label:" not in s for s in schemas), (name, schemas)

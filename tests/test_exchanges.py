"""Which exchanges plans have: what is keyed by document is dealt by document once, and joins on a document and more take it as it is."""

import re

import pytest
from conftest import SMALL

from lectern import plans


def exchanges(frame):
    """The keys and the reason of every exchange of a plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [(re.sub(r"#\d+L?", "", keys), reason) for keys, reason in re.findall(r"Exchange hashpartitioning\((.*), \d+\), (\w+)", plan)]


@pytest.mark.parametrize("name", ["d20_alignment_runs", "d21_aligned_chunks", "d22_body_filter", "d18_rematch"])
def test_aligned_tables_are_dealt_with_their_texts_only(spark, name):
    found = exchanges(plans.QUERIES[name](spark, SMALL))
    assert found and set(found) == {("document_id", "REPARTITION_BY_NUM")}


@pytest.mark.parametrize("name", ["c7_unknown_ids", "e3_envelope", "e5_clean_groups", "e5_ignored", "e7_renumber", "e8_overlapping_groups", "e9_metrics"])
def test_grouping_output_is_keyed_by_document(spark, name):
    found = exchanges(plans.QUERIES[name](spark, SMALL))
    assert found and {keys for keys, _ in found} == {"document_id"}


@pytest.mark.parametrize("name", ["e4_halve"])
def test_windows_are_halved_without_sorting(spark, name):
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan


def test_parts_are_as_many_as_the_characters_need(spark):
    from lectern.plans import views

    assert views.chunks(spark, SMALL, 50_000).rdd.getNumPartitions() > views.chunks(spark, SMALL, 10**9).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_text_of_one_task_is_bounded(spark):
    """An outline's task sorts the rows of its text several times, so its text is small, as that of alignment."""
    from lectern.plans import record_queries, views

    assert views.TASK_CHARS <= record_queries.ALIGNED_CHARS

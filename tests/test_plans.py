"""Shapes of the physical plans."""

from pathlib import Path

import pytest

from pressgrid.plans.registry import all_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
EAGER = {"nearest_predecessor", "nearest_predecessor_lookback", "assign_stories", "assign_stories_lookback", "assign_stories_vectors", "story_rollup"}


def plan(spark, name: str, capsys) -> str:
    capsys.readouterr()
    all_queries()[name](spark, DATA).explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(n for n in all_queries() if n not in EAGER and not n.startswith("stream_")))
def test_no_cross_joins(spark, name, capsys):
    text = plan(spark, name, capsys)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["enrich_candidates", "story_images", "evidence_preview", "top_themes_per_outlet", "diverse_sample"])
def test_ranks_are_cut_before_the_shuffle(spark, name, capsys):
    assert "WindowGroupLimit" in plan(spark, name, capsys)


@pytest.mark.parametrize("name", ["eligible_batch", "failed_articles", "recent_runs", "latest_ingestion_run"])
def test_top_k_needs_no_full_sort(spark, name, capsys):
    assert "TakeOrderedAndProject" in plan(spark, name, capsys)


def test_scans_read_only_what_is_needed(spark, capsys):
    text = plan(spark, "articles_by_state", capsys)
    assert "ReadSchema: struct<doc_id:bigint>" in text
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src7)]" in plan(spark, "outlet_by_slug", capsys)

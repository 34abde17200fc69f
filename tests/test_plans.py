"""What the plans must and must not contain."""

import io
import os
from contextlib import redirect_stdout

import pytest

from pagelake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")

PYTHON = {
    "container_links", "listing_requests", "extract_detail", "extract_downloads", "split_rejects",
    "decode_body", "file_name", "header_name", "url_name", "classify_fetch", "media_results",
    "media_status_counts", "archive_round_trip",
}


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    eager = {"crawl_reach", "captures_stream", "dedup_stream", "stats_stream", "load_stream"}
    return {n: plan(q(spark, SF)) for n, q in catalog.queries().items() if n not in eager}


def test_no_all_pairs(plans):
    assert [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoop" in p] == []


def test_no_row_at_a_time_python(plans):
    assert [n for n, p in plans.items() if "BatchEvalPython" in p] == []


def test_native_operators_stay_in_the_jvm(plans):
    touched = [n for n, p in plans.items() if "ArrowEvalPython" in p or "InArrow" in p or "InPandas" in p]
    assert set(touched) <= PYTHON


def test_no_window_in_one_partition(plans):
    for name, p in plans.items():
        if "Window" in p:
            assert "SinglePartition" not in p, name


def test_pages_are_parsed_once(plans):
    for name in ("split_rejects", "extract_detail", "listing_requests"):
        assert plans[name].count("ArrowEvalPython") == 1, name
    assert plans["extract_links"].count("regexp_extract_all") == 1


def test_stages_hold_each_join_once(plans):
    """Covers, and candidates with outcomes and their choice; the stored records are read for rows and for links."""
    for name in ("staged_records", "success_report"):
        assert plans[name].count("Join") <= 3, name
        assert plans[name].count("Union") == 0, name


def test_columns_are_pruned(plans):
    assert "ReadSchema: struct<url:string>" in plans["url_parts"]
    assert "html" not in plans["seed_requests"]


def test_batches_are_limited_before_the_shuffle(plans):
    p = plans["next_batch"]
    assert "TakeOrderedAndProject" in p and p.count("WindowGroupLimit") == 2


def test_keys_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_exploded_candidates_are_not_broadcast(plans):
    for name in ("first_success", "attempts", "fetch_plan"):
        assert "BuildLeft" not in plans[name], name

"""Registered queries against DuckDB on the smallest tables.

A spread of sections by default; PLUMBLINE_ALL=1 runs every query (about ten minutes)."""

import os

import pytest

import __spark_entry__ as E
from plumbline.plans import all_oracles
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
PICK = ["box_iou", "crop_window_box", "boxes_overlap", "parse_box_answer", "numbered_verdict_lines", "align_span", "gate_pass_table", "condition_pivot_relations", "stop_rules", "auroc", "rate_ci",
        "fleiss_kappa", "scene_batches", "greedy_keep", "stratified_draw", "union_first_wins", "near_duplicate_disjoint", "snapshot_diff", "cross_group_pairs", "label_matrix", "mask_dilate_translate",
        "control_sampling", "trace_reward", "cached_scoring", "running_training_metrics"]
NAMES = list(all_oracles()) if os.environ.get("PLUMBLINE_ALL") else PICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    status, rows, _, _, detail = compare(spark, con, E.queries()[name], E.oracle_sql()[name], SF)
    assert status == "OK", detail
    assert rows > 0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "positive_acc" in df.columns


def test_inventory_is_registered():
    from plumbline.plans import all_queries

    assert len(all_queries()) >= 229 and set(all_queries()) <= set(E.queries())
    assert set(all_queries()) - set(all_oracles()) == {"audit_row_items", "spatial_pair_items"}


def test_abstain_report_combines_before_the_shuffle(spark):
    plan = E.queries()["abstain_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan

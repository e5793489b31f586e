"""Registered queries against their checking SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import compare, duck  # noqa: E402

NAMES = [
    "e1_score_findings",
    "a07_coverage_cube",
    "f01_flow_quality",
    "j05_frame_to_flow",
    "f19_key_exchange",
    "j07_nth_frame_attach",
    "j06_second_source_merge",
    "f12_dialogue_outcome",
    "j24_identity_match",
    "j25_chain_walk",
    "f29_handshake_rules",
    "m1_baseline_scores",
    "a24_alert_rates",
    "j15_finding_protocol",
    "a09_case_summaries",
    "v05_document_diff",
    "f40_forensic_report_text",
    "st04_protocol_events",
    "st06_st09_daily_windows_stream",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, name)
    assert ok, note


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0

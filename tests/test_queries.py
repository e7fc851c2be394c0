"""Registered queries against their check SQL on the smallest tables.

By default one or two of each section, GRAVURE_ALL=1 for all of them.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from check import compare

SAMPLE = (
    "flagship_request_megapixels", "a02_scan_object_store", "a06_detect_type", "a12_slice_range", "a16_decode_scan",
    "b01_split_signature", "b05_argument_errors", "b07_presets_expand", "b10_decode_source_url", "b13_classify_source_ip",
    "b15_verify_signature", "b24_dedupe_renditions", "c04_output_format", "c11_fit_max_bytes", "d15_crop_box", "d20_guarded_result", "d22_watermark_layout",
    "d23_result_size", "e03_trim", "e05_smart_crop", "e06_resize", "e12_pixelate", "e14_extend", "e17_watermark", "e23_animate_map", "e24_render", "g01_iptc_validate",
    "g02_iptc_typed", "h01_sanitize_markup", "h02_href_audit", "i01_cache_control", "i04_conditional_in",
    "j05_duration_histogram", "j07_in_progress", "k01_dct_hash", "k04_near_duplicates", "l03_stream_metrics",
    "l05_client_sessions", "l06_unfinished_requests", "m02_group_trends",
)
NAMES = tuple(contract.queries()) if os.environ.get("GRAVURE_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_check(spark, sf_dir, name):
    verdict = compare(spark, sf_dir, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["out_format", "resizing_type", "renditions", "result_pixels"]
    assert df.count() > 0

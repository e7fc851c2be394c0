"""Paths, options, signatures, addresses and links with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.functions.text import wildcard_regex
from gravure.operators.markup import href_safe
from gravure.plans import options, requests


def _plan(spark, path):
    df = spark.createDataFrame([(1, 0, path)], "req_id int, ts_us long, path string")
    df = requests.argument_errors(requests.tokenize_options(df), security_options=True)
    return options.typed_plan(df).collect()[0]


def test_resize_with_extend_and_gravity(spark):
    row = _plan(spark, "rs:fill:100:200:1:1:noea:1.5:2/plain/u")
    assert (row.resizing_type, row.width, row.height, row.enlarge, row.extend) == ("fill", 100, 200, True, True)
    assert (row.extend_type, row.extend_x, row.extend_y) == ("noea", 1.5, 2.0)


def test_padding_copies_sides(spark):
    row = _plan(spark, "pd:10:20/pd::5/plain/u")
    assert (row.pad_top, row.pad_right, row.pad_bottom, row.pad_left) == (10, 5, 10, 5)


def test_smart_gravity_clears_offsets_and_others_keep_them(spark):
    assert _plan(spark, "g:no:3:4/g:sm/plain/u").gravity_x is None
    assert _plan(spark, "g:no:3:4/g:so/plain/u").gravity_y == 4.0


def test_last_write_wins_and_clears(spark):
    row = _plan(spark, "w:1/w:2/bg:fff/bg:/cb:a/cb:/fq:webp:1:webp:2/plain/u")
    assert (row.width, row.background, row.cachebuster, row.format_quality) == (2, None, None, {"webp": 2})


def test_signatures(spark):
    good = "oWaL7QoW5TsgbuiS9-5-DI8S3Ibbo1gdB2SteJh3a20"
    second = "jYz1UZ7j1BCdSzH3pZhaYf0iuz0vusoOTdqJsUT6WXI"
    df = spark.createDataFrame([(s, "asd") for s in (good, second, "oWaL7QoW5Ts", "dtLwhdnPPis")], "signature string, path string")
    one, two = (b"test-key", b"test-salt"), (b"test-key2", b"test-salt2")
    status = lambda pairs, size=32: [
        r.signature_status for r in requests.verify_signature(df, pairs, size).collect()
    ]
    assert status([one]) == [None, 403, 403, 403]
    assert status([one, two]) == [None, None, 403, 403]
    assert status([one], 8) == [403, 403, None, 403]


def test_addresses(spark):
    cases = {
        "100.63.255.255": "public", "100.64.0.0": "private", "100.127.255.255": "private", "100.128.0.0": "public",
        "172.16.0.1": "private", "64:ff9b::172.16.0.1": "private", "64:ff9b::8.8.8.8": "public", "::1": "loopback",
        "::ffff:169.254.1.1": "link_local", "nonsense": "invalid",
    }
    df = requests.classify_source_ip(spark.createDataFrame([(c,) for c in cases], "ip string"))
    assert {r.ip: r.ip_class for r in df.collect()} == cases


def test_links(spark):
    web = {
        "": True, "#test": True, "foo/bar.svg": True, "//evil.com/x": True, "https://example.com": True,
        "javascript:alert(1)": False, "jAvAsCriPt:alert(1)": False, "mailto:test@example.com": False,
        "data:text/html,x": False, "jav&#97;script:alert(1)": False, "jav&#x61;script:alert(1)": False,
        "javascript&colon;alert(1)": False,
    }
    df = spark.createDataFrame([(v, f' href="{v}"') for v in web], "v string, attribute string")
    safe = href_safe(F.lit("a"), F.col("attribute")).alias("safe")
    assert {r.v: r.safe for r in df.select("v", safe).collect()} == web
    image = spark.createDataFrame([(' href="data:image/png;base64,AAAA"',), (' href="javascript:x"',)], "attribute string")
    assert [r.safe for r in image.select(href_safe(F.lit("image"), F.col("attribute")).alias("safe")).collect()] == [True, False]


def test_wildcards():
    import re

    pattern = wildcard_regex("http://*.mycdn.dev/")
    assert re.search(pattern, "http://a-1.b-2.mycdn.dev/x")
    assert not re.search(pattern, "http://other.dev/.mycdn.dev/x")


def test_bad_rows_do_not_fail_the_job(spark):
    paths = ["fq:webp/plain/u", "bg:x:y:z/plain/u", "z:/plain/u", "c:/plain/u", "exp:abc/plain/u", "rot:x/plain/u", "", "a/b"]
    df = spark.createDataFrame([(i, 0, p) for i, p in enumerate(paths)], "req_id int, ts_us long, path string")
    df = options.typed_plan(requests.argument_errors(requests.decode_source_url(requests.tokenize_options(df))))
    assert df.filter(F.col("option_error").isNotNull()).count() == 6


def test_malformed_ipv6_is_no_address(spark):
    from pyspark.sql import functions as F

    from gravure.plans.requests import ip_hex

    bad = ["12345::1", "1::2::3", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "1:::2", "1:2:3:4:5:6:7::8", "g::1"]
    good = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "fe80::1", "::ffff:10.0.0.1"]
    rows = spark.createDataFrame([(a,) for a in bad + good], "ip string").select("ip", ip_hex(F.col("ip")).alias("h")).collect()
    assert [r["h"] is not None for r in rows] == [False] * len(bad) + [True] * len(good)


def test_sizes_beyond_64_bits_are_null(spark):
    from pyspark.sql import functions as F

    from gravure.functions import numeric

    row = spark.range(1).select(numeric.scale(F.lit(1e300), F.lit(2.0)).alias("a"), numeric.megapixels(F.lit(1e300)).alias("b")).first()
    assert row["a"] is None and row["b"] is None

"""Queries B: request log to plan, each with its SQL check (options as rows there)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.plans import dims, geometry, options, requests
from gravure.registry.fixtures import table, with_tables
from gravure.registry.geometry import RESULT_CTES, RESULT_SQL

KEY, SALT = b"test-key", b"test-salt"
KEY2, SALT2 = b"test-key2", b"test-salt2"
AES_KEY = bytes(range(32))
SOURCES = ["http://img1.example.com/", "http://img2.*.com/p/1*", "http://*.example.com/p/*.gif"]
REWRITES = [("http://img0.example.com/*/", "s3://bucket/$1/"), ("http://img1.*/p/", "https://cdn.${1}/q/")]
ALLOWED = ["w", "h", "rs", "q", "pr", "maf", "msr"]

_LIST = "|"


def presets(spark, sf):
    return table(spark, sf, "presets").withColumn("args", F.split("argtext", ":")).drop("argtext")


def _options_text():
    return F.array_join(
        F.transform(
            "options", lambda o: F.concat_ws("=", F.coalesce(o["given_name"], F.lit("")), F.array_join(o["args"], ","))
        ),
        _LIST,
    ).alias("options_text")


def _tokens(spark, sf, name="option_paths"):
    return requests.tokenize_options(table(spark, sf, name))


_TEXT_ONLY = [f for f in options.TEXT_FIELDS]
PLAN_COLUMNS = [*_TEXT_ONLY, *options.PADDING_FIELDS]


def _plan_select(df, *extra):
    pairs = F.transform(
        F.array_sort(F.map_entries("format_quality")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return df.select(
        "req_id",
        *extra,
        *PLAN_COLUMNS,
        F.nullif(F.array_join("skip_formats", ","), F.lit("")).alias("skip_formats"),
        F.array_join(pairs, ",").alias("format_quality"),
    )


def _parsed(spark, sf):
    return requests.parse_requests(
        table(spark, sf, "requests"), presets=presets(spark, sf), sources=["http://img*.example.com/"]
    )


def _b04(spark, sf):
    df = requests.argument_errors(_tokens(spark, sf), security_options=True)
    return _plan_select(options.typed_plan(df.filter(F.col("option_error").isNull())))


def _b07(spark, sf):
    df = requests.presets_expand(_tokens(spark, sf, "preset_paths"), presets(spark, sf))
    used = F.array_join(
        F.transform(F.filter("options", lambda o: o["name"] == "#preset"), lambda o: F.get(o["args"], F.lit(0))), ","
    )
    return df.select(
        "req_id",
        used.alias("used_presets"),
        F.array_join(
            F.transform(
                F.filter("options", lambda o: ~F.coalesce(o["name"] == "#preset", F.lit(False))),
                lambda o: F.concat_ws("=", o["given_name"], F.array_join(o["args"], ",")),
            ),
            _LIST,
        ).alias("options_text"),
    )


def _b08(spark, sf):
    paths = table(spark, sf, "events").selectExpr(
        "event_id AS req_id",
        "concat(CASE event_id % 3 WHEN 0 THEN 'thumb' WHEN 1 THEN 'thumb:wide' ELSE 'loop_a:nosuch' END, "
        "'/plain/http://example.com/', event_id) AS path",
    )
    df = requests.presets_expand(requests.only_presets(paths), presets(spark, sf), default=False)
    return df.select(
        "req_id",
        F.array_join(
            F.transform(
                F.filter("options", lambda o: ~F.coalesce(o["name"] == "#preset", F.lit(False))),
                lambda o: F.concat_ws("=", o["given_name"], F.array_join(o["args"], ",")),
            ),
            _LIST,
        ).alias("options_text"),
        F.array_join("rest", "/").alias("rest"),
    )


def _b10(spark, sf):
    df = table(spark, sf, "source_paths").withColumn("rest", F.split("tail", "/"))
    flagged = requests.decode_source_url(df, base64_filename=True).select("req_id", F.col("source_url").alias("named_url"))
    return (
        requests.decode_source_url(df)
        .select("req_id", "source_url", "ext", F.col("url_status").cast("bigint").alias("url_status"))
        .join(flagged, "req_id")
    )


def _b14(spark, sf):
    df = _parsed(spark, sf).join(
        table(spark, sf, "images").select("source_url", F.col("format").alias("src_format"), "bytes"), "source_url", "left"
    )
    df = df.withColumns(
        {
            "save_status": F.when(F.col("format") == "svg", 422),
            "queue_status": F.when(F.col("req_id") % 50 == 7, 429),
            "fetch_status": F.when(F.col("bytes") > 1_200_000, 422),
            "load_status": F.when(F.col("src_format") == "ico", 422),
        }
    )
    verdict = requests.request_verdict(
        df,
        [
            ("path_status", "path_parsing"), ("legacy_status", "path_parsing"), ("option_status", "path_parsing"),
            ("url_status", "path_parsing"), ("ext_status", "path_parsing"), ("source_status", "security"),
            ("save_status", "path_parsing"), ("queue_status", "queue"), ("fetch_status", "download"),
            ("load_status", "path_parsing"),
        ],
    )
    return verdict.select("req_id", F.col("status").cast("bigint").alias("status"), "error_category")


def _signed(spark, sf):
    df = table(spark, sf, "requests").withColumn("path", F.substring_index("uri", "/unsafe/", -1))
    one = requests.sign_urls(df, KEY, SALT).withColumnRenamed("signed_uri", "one")
    two = requests.sign_urls(one, KEY2, SALT2).withColumnRenamed("signed_uri", "two")
    signature = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(2))
    pick = (
        F.when(F.col("req_id") % 5 == 0, signature("one"))
        .when(F.col("req_id") % 5 == 1, signature("two"))
        .when(F.col("req_id") % 5 == 2, F.lit("trusted"))
        .when(F.col("req_id") % 5 == 3, F.concat(F.lit("A"), signature("one")))
        .otherwise(F.lit("not:base64"))
    )
    return two.withColumn("signature", pick)


def _b15(spark, sf):
    pairs = [(KEY, SALT), (KEY2, SALT2)]
    df = requests.verify_signature(_signed(spark, sf), pairs, trusted=("trusted",))
    df = df.withColumnRenamed("signature_status", "status_keys")
    df = requests.verify_signature(df, [], trusted=())
    return df.select(
        "req_id",
        F.col("status_keys").cast("bigint").alias("status_keys"),
        F.col("signature_status").cast("bigint").alias("status_open"),
    )


def _b16(spark, sf):
    df = table(spark, sf, "requests").withColumn("path", F.substring_index("uri", "/unsafe/", -1))
    short = requests.sign_urls(df, KEY, SALT, 8).withColumnRenamed("signed_uri", "short_uri")
    return requests.sign_urls(short, KEY, SALT).select("req_id", "signed_uri", "short_uri")


def _b17(spark, sf):
    df = table(spark, sf, "images").select("image_id", "source_url")
    iv = F.substring(F.unhex(F.sha2("source_url", 256)), 1, 16)
    df = requests.decrypt_source_urls(requests.encrypt_source_urls(df, AES_KEY, iv), AES_KEY)
    return df.select("image_id", "decrypted_url", F.length("enc_path").cast("bigint").alias("token_length"))


def _features(spark, sf):
    return requests.client_features(
        table(spark, sf, "client_headers"), auto=("webp", "jxl"), enforce=("avif",), client_hints=True
    )


def _b19(spark, sf):
    df = _features(spark, sf).join(_tokens(spark, sf).select("req_id", "ts_us", "options"), "req_id")
    df = requests.default_plan(requests.presets_expand(df, presets(spark, sf)))
    df = requests.argument_errors(df, security_options=True).filter(F.col("option_error").isNull())
    return options.typed_plan(df).select("req_id", "width", "dpr", "auto_rotate")


def _b21(spark, sf):
    exts = F.when(F.col("req_id") % 3 == 0, "webp").when(F.col("req_id") % 3 == 1, "bogus").otherwise("")
    df = options.typed_plan(_tokens(spark, sf)).withColumn("ext", exts)
    return requests.apply_extension(df).select(
        "req_id", "format", F.col("ext_status").cast("bigint").alias("ext_status")
    )


def _b22(spark, sf):
    df = _parsed(spark, sf).withColumn(
        "headers",
        F.create_map(F.lit("Accept"), F.lit("*/*"), F.lit("Range"), F.lit("bytes=0-9"), F.lit("Cookie"), F.lit("x")),
    )
    raw, transform = requests.split_raw(df)
    kept = F.map_filter("headers", lambda k, _: k.isin("Accept", "Range"))
    return (
        raw.select(F.lit("raw").alias("branch"), "source_url", F.size(kept).alias("n"))
        .unionByName(transform.select(F.lit("transform").alias("branch"), "source_url", F.lit(0).alias("n")))
        .groupBy("branch")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("n").alias("headers"))
    )


PLAN_GROUPS = {
    "": {"width": "width", "height": "height", "resizing_type": "resizing_type", "enlarge": "enlarge"},
    "crop": {"width": "crop_w", "height": "crop_h"},
    "gravity": {"type": "gravity_type", "x_offset": "gravity_x", "y_offset": "gravity_y"},
    "padding": {"top": "pad_top", "right": "pad_right", "bottom": "pad_bottom", "left": "pad_left"},
}


def _b23(spark, sf):
    df = requests.argument_errors(_tokens(spark, sf), security_options=True).filter(F.col("option_error").isNull())
    return requests.plan_json(options.typed_plan(df), PLAN_GROUPS).select("req_id", "plan_json")


def _b24(spark, sf):
    df = requests.dedupe_renditions(_parsed(spark, sf))
    return df.select("requests", "first_req")


def _b25(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id AS req_id",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS ts_us",
        "concat('exp:', CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '12x' "
        "ELSE CAST(1704067200 + (event_id * 977) % 2592000 AS STRING) END, '/plain/x') AS path",
    )
    df = requests.argument_errors(requests.tokenize_options(df))
    return df.select("req_id", "option_error", F.col("option_status").cast("bigint").alias("option_status"))


def flagship(spark, sf):
    """Request log -> plan -> geometry -> result megapixels by output format and resizing type."""
    images = table(spark, sf, "images").select(
        "source_url", F.col("width").alias("img_w"), F.col("height").alias("img_h"), "frames", "orientation", "has_alpha",
        F.col("format").alias("src_format"),
    )
    parsed = _parsed(spark, sf).filter(
        F.coalesce("option_status", "url_status", "ext_status", "source_status").isNull()
    )
    planned = geometry.result_size(
        geometry.plan_geometry(options.with_defaults(parsed.join(images, "source_url")))
    )
    return planned.groupBy(F.coalesce("format", "src_format").alias("out_format"), "resizing_type").agg(
        F.count(F.lit(1)).alias("renditions"), F.sum(F.col("result_w") * F.col("result_h")).alias("result_pixels")
    )


QUERIES = {
    "flagship_request_megapixels": flagship,
    "b01_split_signature": lambda spark, sf: requests.split_signature(table(spark, sf, "uris"), "/pfx").select(
        "req_id", "signature", "path", F.col("path_status").cast("bigint").alias("path_status")
    ),
    "b02_redenormalize_path": lambda spark, sf: requests.redenormalize_path(
        requests.split_signature(table(spark, sf, "uris"), "/pfx")
    ).select("req_id", "path"),
    "b03_tokenize_options": lambda spark, sf: _tokens(spark, sf).select(
        "req_id", _options_text(), F.array_join("rest", "/").alias("rest")
    ),
    "b04_options_parse": _b04,
    "b05_argument_errors": lambda spark, sf: requests.argument_errors(_tokens(spark, sf)).select(
        "req_id", "option_error", F.col("option_status").cast("bigint").alias("option_status")
    ),
    "b06_presets_parse": lambda spark, sf: requests.presets_parse(table(spark, sf, "preset_lines")).select(
        "line_id", F.when(F.col("error").isNull(), F.col("name")).alias("name"), "error", _options_text()
    ),
    "b07_presets_expand": _b07,
    "b08_only_presets": _b08,
    "b09_gate_options": lambda spark, sf: requests.gate_options(_tokens(spark, sf), ALLOWED, False).select(
        "req_id", "option_error", F.col("option_status").cast("bigint").alias("option_status")
    ),
    "b10_decode_source_url": _b10,
    "b11_rewrite_source_url": lambda spark, sf: requests.rewrite_source_url(
        table(spark, sf, "images").select("image_id", "source_url"), REWRITES, "https://"
    ),
    "b12_check_source_allowed": lambda spark, sf: requests.check_source_allowed(
        table(spark, sf, "images"), SOURCES
    ).select("image_id", F.col("source_status").cast("bigint").alias("source_status")),
    "b13_classify_source_ip": lambda spark, sf: requests.classify_source_ip(
        table(spark, sf, "source_ips"), allow_private=False
    ),
    "b14_request_verdict": _b14,
    "b15_verify_signature": _b15,
    "b16_sign_urls": _b16,
    "b17_encrypt_source_urls": _b17,
    "b18_client_features": lambda spark, sf: _features(spark, sf).select(
        "req_id", "prefer_webp", "enforce_webp", "prefer_avif", "enforce_avif", "prefer_jxl", "enforce_jxl", "hint_dpr",
        "hint_width",
    ),
    "b19_default_plan": _b19,
    "b20_vary_header": lambda spark, sf: table(spark, sf, "client_headers").select(
        "req_id",
        F.when(F.col("req_id") % 2 == 0, requests.vary_header(("webp",), (), True))
        .otherwise(requests.vary_header((), ("avif",), False))
        .alias("vary"),
    ),
    "b21_apply_extension": _b21,
    "b22_split_raw": _b22,
    "b23_plan_json": _b23,
    "b24_dedupe_renditions": _b24,
    "b25_expires_check": _b25,
}

# --- SQL check --------------------------------------------------------------------------


def _values(rows):
    def lit(v):
        return "true" if v is True else "false" if v is False else str(v) if isinstance(v, int) else f"'{v}'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


_ALIASES = f"alias(given, canon) AS (VALUES {_values(dims.CANONICAL.items())})"
_SLOTS = [
    ("resize", 0, "resizing_type", "rt", True), ("resize", 1, "width", "int0", True),
    ("resize", 2, "height", "int0", True), ("resize", 3, "enlarge", "bool", True), ("resize", 4, "extend", "bool", True),
    ("resize", 5, "extend_type", "text", False), ("resize", 6, "extend_x", "f", True), ("resize", 7, "extend_y", "f", True),
    ("size", 0, "width", "int0", True), ("size", 1, "height", "int0", True), ("size", 2, "enlarge", "bool", True),
    ("size", 3, "extend", "bool", True), ("size", 4, "extend_type", "text", False), ("size", 5, "extend_x", "f", True),
    ("size", 6, "extend_y", "f", True), ("resizing_type", 0, "resizing_type", "rt", False),
    ("width", 0, "width", "int0", False), ("height", 0, "height", "int0", False),
    ("min-width", 0, "min_width", "int0", False), ("min-height", 0, "min_height", "int0", False),
    ("zoom", 0, "zoom_w", "f1", False), ("zoom", 1, "zoom_h", "f1", False), ("dpr", 0, "dpr", "f1", False),
    ("enlarge", 0, "enlarge", "bool", False), ("extend", 0, "extend", "bool", False),
    ("extend", 1, "extend_type", "text", False), ("extend", 2, "extend_x", "f", True), ("extend", 3, "extend_y", "f", True),
    ("extend_aspect_ratio", 0, "extend_ar", "bool", False), ("extend_aspect_ratio", 1, "extend_ar_type", "text", False),
    ("extend_aspect_ratio", 2, "extend_ar_x", "f", True), ("extend_aspect_ratio", 3, "extend_ar_y", "f", True),
    ("gravity", 0, "gravity_type", "text", False), ("gravity", 1, "gravity_x", "f", True),
    ("gravity", 2, "gravity_y", "f", True), ("crop", 0, "crop_w", "f0", False), ("crop", 1, "crop_h", "f0", False),
    ("crop", 2, "crop_type", "text", False), ("crop", 3, "crop_x", "f", True), ("crop", 4, "crop_y", "f", True),
    ("trim", 0, "trim_threshold", "f", True), ("trim", 1, "trim_color", "hex", True),
    ("trim", 2, "trim_equal_h", "bool", True), ("trim", 3, "trim_equal_v", "bool", True),
    ("padding", 0, "p0", "int0", True), ("padding", 1, "p1", "int0", True), ("padding", 2, "p2", "int0", True),
    ("padding", 3, "p3", "int0", True), ("auto_rotate", 0, "auto_rotate", "bool", False),
    ("rotate", 0, "rotate", "rot", False), ("flip", 0, "flip_h", "bool", True), ("flip", 1, "flip_v", "bool", True),
    ("blur", 0, "blur", "f0", False), ("sharpen", 0, "sharpen", "f0", False), ("pixelate", 0, "pixelate", "int0", False),
    ("watermark", 0, "wm_opacity", "op", False), ("watermark", 1, "wm_position", "gw", True),
    ("watermark", 2, "wm_x", "f", True), ("watermark", 3, "wm_y", "f", True), ("watermark", 4, "wm_scale", "f1", True),
    ("strip_metadata", 0, "strip_metadata", "bool", False), ("keep_copyright", 0, "keep_copyright", "bool", False),
    ("strip_color_profile", 0, "strip_color_profile", "bool", False), ("preserve_hdr", 0, "preserve_hdr", "bool", False),
    ("enforce_thumbnail", 0, "enforce_thumbnail", "bool", False), ("quality", 0, "quality", "q", False),
    ("max_bytes", 0, "max_bytes", "int0", False), ("format", 0, "format", "fmt", False), ("raw", 0, "raw", "bool", False),
    ("cachebuster", 0, "cachebuster", "text", True), ("expires", 0, "expires", "int", False),
    ("return_attachment", 0, "return_attachment", "bool", False),
    ("max_src_resolution", 0, "max_src_resolution", "f0", False),
    ("max_src_file_size", 0, "max_src_file_size", "int", False), ("max_animation_frames", 0, "max_frames", "int1", False),
    ("max_animation_frame_resolution", 0, "max_frame_resolution", "f0", False),
    ("max_result_dimension", 0, "max_dim", "int", False),
]
_ARITY = {
    "resize": 8, "size": 7, "zoom": 2, "extend": 4, "extend_aspect_ratio": 4, "trim": 4, "padding": 4, "flip": 2,
    "watermark": 7, "filename": 2, "gravity": 99, "crop": 99, "background": 99, "format_quality": 99,
    "skip_processing": 99, "preset": 99,
}
_CLEAR = "§"
_ISINT = "regexp_full_match({v}, '[+-]?[0-9]+') AND try_cast({v} AS BIGINT) IS NOT NULL"
_ISF = r"regexp_full_match({v}, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')"
_FMT = "('jpeg','jxl','png','webp','gif','ico','svg','heic','avif','bmp','tiff','jpg')"
_TRUE = "('1','t','T','TRUE','true','True')"


def _valid(kind, v):
    i, f = _ISINT.format(v=v), _ISF.format(v=v)
    num, real = f"CAST({v} AS BIGINT)", f"CAST({v} AS DOUBLE)"
    # A branch decides before the cast of a text that is no number could run.
    cond = {
        "int": i,
        "int0": f"CASE WHEN {i} THEN {num} >= 0 ELSE false END",
        "int1": f"CASE WHEN {i} THEN {num} > 0 ELSE false END",
        "q": f"CASE WHEN {i} THEN {num} BETWEEN 0 AND 100 ELSE false END",
        "rot": f"CASE WHEN {i} THEN {num} % 90 = 0 ELSE false END",
        "f": f,
        "f0": f"CASE WHEN {f} THEN {real} >= 0 ELSE false END",
        "f1": f"CASE WHEN {f} THEN {real} > 0 ELSE false END",
        "op": f"CASE WHEN {f} THEN {real} BETWEEN 0 AND 1 ELSE false END",
        "rt": f"{v} IN ('fit','fill','fill-down','force','auto')",
        "gw": f"{v} IN ('ce','no','ea','so','we','nowe','noea','sowe','soea','re')",
        "hex": f"regexp_full_match({v}, '([0-9a-fA-F]{{3}}){{1,2}}')",
        "fmt": f"{v} IN {_FMT}",
    }
    return cond[kind]


_KINDS = ("int", "int0", "int1", "q", "rot", "f", "f0", "f1", "op", "rt", "gw", "hex", "fmt")
_VALID = "CASE kind " + " ".join(f"WHEN '{k}' THEN ({_valid(k, 'v')})" for k in _KINDS) + " ELSE true END"


def tokens_sql(src, name="ro", path="path"):
    """CTEs: one row per option of `src`, as {name}(req_id, ts_us, pos, given, args, canon)."""
    return f"""
{name}_c AS (SELECT req_id, ts_us, {path} AS path_, string_split({path}, '/') AS parts FROM {src}),
{name}_s AS (SELECT *, coalesce(nullif(list_position(list_transform(parts, lambda p: contains(p, ':')), false), 0),
    len(parts) + 1) AS stop FROM {name}_c),
{name}_u AS (SELECT req_id, ts_us, unnest(range(1, stop)) AS pos, unnest(parts[1:stop - 1]) AS seg FROM {name}_s),
{name} AS (SELECT req_id, ts_us, pos, a.given, args, al.canon FROM
    (SELECT req_id, ts_us, pos, string_split(seg, ':')[1] AS given, string_split(seg, ':')[2:] AS args FROM {name}_u) a
    LEFT JOIN alias al ON al.given = a.given)"""


def _gravity_bad(off, allowed):
    t, n = f"args[{off + 1}]", f"(len(args) - {off})"
    real = lambda i: f"""(args[{i}] <> '' AND NOT CASE WHEN {_ISF.format(v=f"args[{i}]")}
      THEN {t} <> 'fp' OR CAST(args[{i}] AS DOUBLE) BETWEEN 0 AND 1 ELSE false END)"""
    kinds = ", ".join(f"'{k}'" for k in allowed)
    return f"""({n} > 0 AND ({t} NOT IN ({kinds}) OR {n} > 3 OR ({t} = 'sm' AND {n} > 1) OR ({t} = 'fp' AND {n} <> 3)
      OR coalesce({real(off + 2)}, false) OR coalesce({real(off + 3)}, false)))"""


_FILE_B64_OK = (
    "(regexp_full_match(rtrim(args[1], '='), '[A-Za-z0-9_-]*') AND len(rtrim(args[1], '=')) % 4 <> 1)"
)


def errors_sql(src, allowed=(), security=False, name="err"):
    """CTE {name}(req_id, option_error): the first refused option of each request."""
    gate = f"WHEN given NOT IN ({', '.join(repr(a) for a in allowed)}) THEN 'forbidden_option'" if allowed else ""
    secure = "" if security else (
        f"WHEN canon IN ({', '.join(repr(s) for s in dims.SECURITY_OPTIONS)}) THEN 'security_options'"
    )
    arity = "CASE canon " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _ARITY.items()) + " ELSE 1 END"
    ge, gc = dims.EXTEND_GRAVITIES, dims.CROP_GRAVITIES
    return f"""
slot(canon, idx, key, kind, skip) AS (VALUES {_values(_SLOTS)}),
{name}_args AS (SELECT req_id, pos, canon, args, unnest(range(0, len(args))) AS idx, unnest(args) AS v FROM {src}),
{name}_bad AS (SELECT DISTINCT req_id, pos FROM {name}_args JOIN slot USING (canon, idx)
   WHERE NOT (skip AND v = '') AND NOT ({_VALID})
     AND NOT (canon = 'resize' AND idx > 4) AND NOT (canon = 'size' AND idx > 3)),
{name}_each AS (SELECT o.req_id, o.pos, CASE
   {gate} WHEN canon IS NULL THEN 'unknown_option' WHEN canon = 'preset' THEN 'unknown_preset' {secure}
   WHEN len(args) > {arity} OR b.pos IS NOT NULL THEN 'option_argument'
   WHEN canon = 'resize' AND coalesce(args[5], '') <> '' AND {_gravity_bad(5, ge)} THEN 'option_argument'
   WHEN canon = 'size' AND coalesce(args[4], '') <> '' AND {_gravity_bad(4, ge)} THEN 'option_argument'
   WHEN canon IN ('extend', 'extend_aspect_ratio') AND {_gravity_bad(1, ge)} THEN 'option_argument'
   WHEN canon = 'gravity' AND {_gravity_bad(0, gc)} THEN 'option_argument'
   WHEN canon = 'crop' AND {_gravity_bad(2, gc)} THEN 'option_argument'
   WHEN canon = 'background' AND NOT CASE len(args)
     WHEN 1 THEN args[1] = '' OR regexp_full_match(args[1], '([0-9a-fA-F]{{3}}){{1,2}}')
     WHEN 3 THEN list_bool_and(list_transform(args, lambda x: regexp_full_match(x, '[0-9]{{1,9}}')
        AND coalesce(try_cast(x AS BIGINT), 999) <= 255))
     ELSE false END THEN 'option_argument'
   WHEN canon = 'format_quality' AND (len(args) % 2 = 1 OR list_bool_or(list_transform(range(1, len(args) + 1),
     lambda i: CASE WHEN i % 2 = 1 THEN args[i] NOT IN {_FMT} ELSE NOT (
       regexp_full_match(args[i], '[+-]?[0-9]+') AND coalesce(try_cast(args[i] AS BIGINT), 999) BETWEEN 0 AND 100) END)))
     THEN 'option_argument'
   WHEN canon = 'skip_processing' AND list_bool_or(list_transform(args, lambda x: x NOT IN {_FMT})) THEN 'option_argument'
   WHEN canon = 'filename' AND coalesce(args[2], '') IN {_TRUE} AND NOT {_FILE_B64_OK} THEN 'option_argument'
   WHEN canon = 'expires' AND CAST(args[1] AS BIGINT) > 0 AND CAST(args[1] AS BIGINT) < ts_us // 1000000 THEN 'expired_url'
   END AS e FROM {src} o LEFT JOIN {name}_bad b ON b.req_id = o.req_id AND b.pos = o.pos),
{name} AS (SELECT req_id, arg_min(e, pos) AS option_error FROM {name}_each WHERE e IS NOT NULL GROUP BY req_id)"""


def plan_sql(src, all_rows, name="plan"):
    """CTE {name}: typed plan columns of every request in `all_rows` (after errors_sql's slot table)."""
    clear = f"'{_CLEAR}'"
    cast = []
    for f in options.TEXT_FIELDS:
        raw = f"nullif(max_by(v, pos) FILTER (WHERE key = '{f}'), {clear})"
        if f in options.INT_FIELDS:
            cast.append(f"TRY_CAST({raw} AS BIGINT) AS {f}")
        elif f in options.FLOAT_FIELDS:
            cast.append(f"TRY_CAST({raw} AS DOUBLE) AS {f}")
        elif f in options.BOOL_FIELDS:
            cast.append(f"{raw} IN {_TRUE} AS {f}")
        elif f in options.PIXEL_FIELDS:
            cast.append(f"CAST(trunc(TRY_CAST({raw} AS DOUBLE) * 1000000) AS BIGINT) AS {f}")
        else:
            cast.append(f"{raw} AS {f}")
    hex6 = lambda v: f"lower(CASE WHEN len({v}) = 3 THEN regexp_replace({v}, '(.)', '\\1\\1', 'g') ELSE {v} END)"
    hexed = lambda i: f"lpad(lower(to_hex(CAST(args[{i}] AS BIGINT))), 2, '0')"
    return f"""
{name}_w AS (
  SELECT req_id, pos, key, CASE WHEN kind = 'hex' THEN {hex6("v")} WHEN kind = 'fmt' AND v = 'jpg' THEN 'jpeg' ELSE v END AS v
    FROM (SELECT req_id, pos, canon, args, unnest(range(0, len(args))) AS idx, unnest(args) AS v FROM {src})
    JOIN slot USING (canon, idx)
    WHERE NOT (skip AND v = '') AND NOT (canon = 'resize' AND idx > 4 AND coalesce(args[5], '') = '')
      AND NOT (canon = 'size' AND idx > 3 AND coalesce(args[4], '') = '')
  UNION ALL SELECT req_id, pos, 'zoom_h', args[1] FROM {src} WHERE canon = 'zoom' AND len(args) = 1
  UNION ALL SELECT req_id, pos, unnest(['gravity_x', 'gravity_y']), {clear} FROM {src} WHERE canon = 'gravity' AND args[1] = 'sm'
  UNION ALL SELECT req_id, pos, unnest(['crop_x', 'crop_y']), {clear} FROM {src} WHERE canon = 'crop' AND args[3] = 'sm'
  UNION ALL SELECT req_id, pos, 'trim_threshold', {clear} FROM {src} WHERE canon = 'trim' AND args[1] = ''
  UNION ALL SELECT req_id, pos, 'trim_color', {clear} FROM {src} WHERE canon = 'trim' AND coalesce(args[2], '') = ''
  UNION ALL SELECT req_id, pos, 'cachebuster', {clear} FROM {src} WHERE canon = 'cachebuster' AND args[1] = ''
  UNION ALL SELECT req_id, pos, 'background', CASE WHEN len(args) = 3 THEN concat({hexed(1)}, {hexed(2)}, {hexed(3)})
     WHEN args[1] = '' THEN {clear} ELSE {hex6("args[1]")} END FROM {src} WHERE canon = 'background'
  UNION ALL SELECT req_id, pos, 'filename', CASE WHEN coalesce(args[2], '') IN {_TRUE}
     THEN try(decode(from_base64(rpad(translate(rtrim(args[1], '='), '-_', '+/'),
       CAST(ceil(len(rtrim(args[1], '=')) / 4) * 4 AS INTEGER), '=')))) ELSE args[1] END
     FROM {src} WHERE canon = 'filename'),
{name}_p0 AS (SELECT req_id, pos, nullif(args[1], '') AS a0, nullif(args[2], '') AS a1, nullif(args[3], '') AS a2,
    nullif(args[4], '') AS a3 FROM {src} WHERE canon = 'padding'),
{name}_p1 AS (SELECT *, last_value(a0 IGNORE NULLS) OVER (PARTITION BY req_id ORDER BY pos) AS t FROM {name}_p0),
{name}_p2 AS (SELECT *, last_value(coalesce(a1, t) IGNORE NULLS) OVER (PARTITION BY req_id ORDER BY pos) AS r,
    last_value(coalesce(a2, t) IGNORE NULLS) OVER (PARTITION BY req_id ORDER BY pos) AS b FROM {name}_p1),
{name}_p3 AS (SELECT *, last_value(coalesce(a3, r) IGNORE NULLS) OVER (PARTITION BY req_id ORDER BY pos) AS l FROM {name}_p2),
{name}_pad AS (SELECT req_id, CAST(arg_max(t, pos) AS BIGINT) AS pad_top, CAST(arg_max(r, pos) AS BIGINT) AS pad_right,
    CAST(arg_max(b, pos) AS BIGINT) AS pad_bottom, CAST(arg_max(l, pos) AS BIGINT) AS pad_left FROM {name}_p3 GROUP BY req_id),
{name}_skip AS (SELECT req_id, string_agg(CASE WHEN f = 'jpg' THEN 'jpeg' ELSE f END, ',' ORDER BY pos, i) AS skip_formats
    FROM (SELECT req_id, pos, unnest(range(0, len(args))) AS i, unnest(args) AS f FROM {src} WHERE canon = 'skip_processing')
    GROUP BY req_id),
{name}_fq AS (SELECT req_id, string_agg(k || '=' || q, ',' ORDER BY k) AS format_quality FROM
    (SELECT req_id, k, arg_max(q, pos * 100 + i) AS q FROM
      (SELECT req_id, pos, i, CASE WHEN args[i] = 'jpg' THEN 'jpeg' ELSE args[i] END AS k, args[i + 1] AS q FROM
        (SELECT req_id, pos, args, unnest(range(1, len(args), 2)) AS i FROM {src} WHERE canon = 'format_quality'))
     GROUP BY req_id, k) GROUP BY req_id),
{name}_f AS (SELECT req_id, {", ".join(cast)} FROM {name}_w GROUP BY req_id),
{name} AS (SELECT a.req_id, {name}_f.* EXCLUDE (req_id), {name}_pad.* EXCLUDE (req_id), skip_formats, format_quality
  FROM {all_rows} a LEFT JOIN {name}_f USING (req_id) LEFT JOIN {name}_pad USING (req_id)
  LEFT JOIN {name}_skip USING (req_id) LEFT JOIN {name}_fq USING (req_id))"""


def _with_options(body, *parts, tables="option_paths", src="option_paths"):
    return with_tables(tables, ",".join([_ALIASES, tokens_sql(src), *parts]) + "\n" + body)


_STATUS = """CAST(CASE WHEN option_error = 'security_options' THEN 403 WHEN option_error IS NOT NULL THEN 404 END AS BIGINT)
  AS option_status"""
_GOOD = "good AS (SELECT a.req_id FROM option_paths a LEFT JOIN err USING (req_id) WHERE option_error IS NULL)"
_SPLIT = """u0 AS (SELECT req_id, regexp_replace(CASE WHEN starts_with(split_part(uri, '?', 1), '/pfx')
    THEN substr(split_part(uri, '?', 1), 5) ELSE split_part(uri, '?', 1) END, '^/', '') AS u FROM uris),
u1 AS (SELECT req_id, split_part(u, '/', 1) AS s, CASE WHEN contains(u, '/') THEN substr(u, strpos(u, '/') + 1) ELSE '' END AS p
    FROM u0),
u2 AS (SELECT req_id, CASE WHEN s = '' OR p = '' THEN '' ELSE s END AS signature,
    CASE WHEN s = '' OR p = '' THEN '' ELSE p END AS path,
    CAST(CASE WHEN s = '' OR p = '' THEN 404 END AS BIGINT) AS path_status FROM u1)"""
_B02 = """, v0 AS (SELECT req_id, CASE WHEN starts_with(path, 'plain/') THEN '' WHEN contains(path, '/plain/')
      THEN substr(path, 1, strpos(path, '/plain/') - 1) ELSE path END AS o,
    CASE WHEN starts_with(path, 'plain/') THEN substr(path, 7) WHEN contains(path, '/plain/')
      THEN substr(path, strpos(path, '/plain/') + 7) END AS q FROM u2)
SELECT req_id, regexp_replace(CASE WHEN q IS NULL THEN replace(o, '%3A', ':') ELSE replace(o, '%3A', ':') || '/plain/' ||
  CASE WHEN regexp_extract(q, '^(\\S+):/([^/])', 1) = 'local' THEN regexp_replace(q, '^(\\S+):/([^/])', '\\1:///\\2')
       ELSE regexp_replace(q, '^(\\S+):/([^/])', '\\1://\\2') END END, '^/', '') AS path FROM v0"""

_PRESET_STEPS = f"""{_ALIASES},
steps AS (SELECT p.name, p.pos, coalesce(a.canon, '?') AS opt, p.opt AS given, string_split(p.argtext, ':') AS args
    FROM presets p LEFT JOIN alias a ON a.given = p.opt
  UNION ALL SELECT DISTINCT name, -1, '#preset', '#preset', [name] FROM presets),
walk(root, trail, ord, opt, given, args) AS (
  SELECT name, [name], [pos], opt, given, args FROM steps
  UNION ALL
  SELECT w.root, list_append(w.trail, s.name), list_concat(w.ord, [w.k, s.pos]), s.opt, s.given, s.args
  FROM (SELECT root, trail, ord, unnest(range(0, len(args))) AS k, unnest(args) AS child FROM walk WHERE opt = 'preset') w
  JOIN steps s ON s.name = w.child WHERE NOT list_contains(w.trail, s.name)),
book AS (SELECT root, ord, given, args FROM walk WHERE opt <> 'preset')"""


def _expanded(src):
    """CTE exp(req_id, pos, k, ord, given, args): options of {src}_o with presets inlined."""
    return f"""
exp AS (
  SELECT req_id, pos, 0 AS k, [0] AS ord, given, args, canon FROM {src} WHERE canon IS DISTINCT FROM 'preset'
  UNION ALL
  SELECT c.req_id, c.pos, c.k, coalesce(b.ord, [0]), coalesce(b.given, c.given), coalesce(b.args, [c.child]),
    CASE WHEN b.given IS NULL THEN 'preset' WHEN b.given = '#preset' THEN '#preset' ELSE al.canon END
  FROM (SELECT req_id, pos, given, unnest(range(0, len(args))) AS k, unnest(args) AS child FROM {src} WHERE canon = 'preset') c
  LEFT JOIN book b ON b.root = c.child LEFT JOIN alias al ON al.given = b.given)"""


_EXP_TEXT = """coalesce(string_agg(given || '=' || array_to_string(args, ','), '|' ORDER BY pos, k, ord)
    FILTER (WHERE given <> '#preset'), '') AS options_text"""


def _preset_sql(body, *parts, tables="preset_paths presets"):
    return with_tables(tables, ",".join([_PRESET_STEPS, *parts]) + "\n" + body)


_B64 = """decode(from_base64(rpad(translate(rtrim({v}, '='), '-_', '+/'), CAST(ceil(len(rtrim({v}, '=')) / 4) * 4 AS INTEGER), '=')))"""


def _decode_ctes(src, tail, out, filename):
    cut = "CASE WHEN len(parts) > 1 THEN parts[1:len(parts) - 1] ELSE parts END" if filename else "parts"
    return f"""
{out}_a AS (SELECT *, string_split({tail}, '/') AS parts FROM {src}),
{out}_b AS (SELECT *, parts[1] = 'plain' AND len(parts) > 1 AS pl, CASE WHEN parts[1] = 'plain' AND len(parts) > 1
    THEN string_split(array_to_string(parts[2:], '/'), '@') ELSE string_split(array_to_string({cut}, ''), '.') END AS pc FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN pc[1] = '' OR len(pc) > 2 THEN NULL
    WHEN pl THEN CASE WHEN regexp_matches(regexp_replace(pc[1], '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') THEN NULL ELSE url_decode(pc[1]) END
    WHEN regexp_full_match(rtrim(pc[1], '='), '[A-Za-z0-9_-]*') AND len(rtrim(pc[1], '=')) % 4 <> 1
      THEN {_B64.format(v="pc[1]")} END AS source_url FROM {out}_b),
{out} AS (SELECT *, CASE WHEN source_url IS NULL THEN '' ELSE coalesce(pc[2], '') END AS ext,
    CAST(CASE WHEN source_url IS NULL THEN 404 END AS BIGINT) AS url_status FROM {out}_c)"""


def _hmac_sql(key, salt, path):
    inner = "".join(f"{b ^ 0x36:02x}" for b in key.ljust(64, b"\0"))
    outer = "".join(f"{b ^ 0x5C:02x}" for b in key.ljust(64, b"\0"))
    return (
        f"unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || unhex('{salt.hex()}') || encode('/' || {path})))))"
    )


def _b64u(blob):
    return f"rtrim(translate(to_base64({blob}), '+/', '-_'), '=')"


# The parsed `requests` table, for the queries that start from the whole request.
_REQ = f"""{_PRESET_STEPS},
rq AS (SELECT r.*, regexp_replace(split_part(uri, '?', 1), '^/unsafe/', '') AS path FROM requests r),
{tokens_sql("rq", "rt")},
{_expanded("rt")},
ro AS (SELECT e.req_id, q.ts_us, row_number() OVER (PARTITION BY e.req_id ORDER BY e.pos, e.k, e.ord) AS pos, e.given, e.args,
    CASE WHEN e.given = '#preset' THEN NULL ELSE e.canon END AS canon
  FROM (SELECT * FROM exp UNION ALL
        SELECT rq.req_id, 0, 0, b.ord, b.given, b.args, CASE WHEN b.given = '#preset' THEN '#preset' ELSE al.canon END
        FROM rq JOIN book b ON b.root = 'default' LEFT JOIN alias al ON al.given = b.given) e
  JOIN rq q ON q.req_id = e.req_id WHERE e.given <> '#preset'),
{errors_sql("ro")},
{plan_sql("ro", "rq")},
tl AS (SELECT req_id, substr(path, strpos(path, '/plain/') + 1) AS tail FROM rq),
{_decode_ctes("tl", "tail", "du", False)},
parsed AS (SELECT p.* REPLACE (CASE WHEN d.ext <> '' AND NOT coalesce(p.raw, false) THEN CASE d.ext WHEN 'jpg' THEN 'jpeg'
      ELSE d.ext END ELSE p.format END AS format), d.source_url, d.url_status, option_error,
    CAST(CASE WHEN option_error = 'security_options' THEN 403 WHEN option_error IS NOT NULL THEN 404 END AS BIGINT) AS option_status,
    CASE WHEN d.ext <> '' AND NOT coalesce(p.raw, false) AND d.ext NOT IN {_FMT} THEN 404 END AS ext_status,
    CASE WHEN NOT regexp_matches(d.source_url, '^http://img[^/]*\\.example\\.com/') THEN 404 END AS source_status
  FROM plan p JOIN du d USING (req_id) LEFT JOIN err USING (req_id))"""


def _req_sql(body, extra=""):
    return with_tables("requests presets images", _REQ + extra + "\n" + body)


def _default_sql(field, value):
    lit = f"'{value}'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else (
        f"{value}e0" if isinstance(value, float) else str(value)
    )
    return f"coalesce(p.{field}, {lit}) AS {field}"


_GEO_FROM_PLAN = f""",
geo AS (SELECT p.* REPLACE ({", ".join(_default_sql(f, v) for f, v in options.GEOMETRY_DEFAULTS.items())}),
    i.width AS img_w, i.height AS img_h, i.frames, i.orientation, i.has_alpha, i.format AS src_format
  FROM parsed p JOIN images i USING (source_url)
  WHERE option_status IS NULL AND url_status IS NULL AND ext_status IS NULL AND source_status IS NULL),
{RESULT_CTES}"""

_IP = r"""h0 AS (SELECT id, ip, regexp_full_match(ip, '((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)') AS is4,
    regexp_extract(ip, ':(\d+\.\d+\.\d+\.\d+)$', 1) AS dq FROM source_ips),
h1 AS (SELECT *, CASE WHEN is4 THEN list_transform(string_split(ip, '.'), lambda x: CAST(x AS INTEGER))
    WHEN dq <> '' THEN list_transform(string_split(dq, '.'), lambda x: CAST(x AS INTEGER)) END AS oct FROM h0),
h2 AS (SELECT *, CASE WHEN is4 THEN NULL WHEN dq <> '' THEN substr(ip, 1, len(ip) - len(dq)) ||
    printf('%x:%x', oct[1] * 256 + oct[2], oct[3] * 256 + oct[4]) ELSE lower(ip) END AS t FROM h1),
h3 AS (SELECT *, CASE WHEN t IS NULL OR NOT regexp_full_match(t, '[0-9a-f:]+') OR NOT contains(t, ':') THEN NULL
    WHEN contains(t, '::') THEN list_concat(
      list_filter(string_split(split_part(t, '::', 1), ':'), lambda x: x <> ''),
      list_concat(list_transform(range(0, 8 - len(list_filter(string_split(t, ':'), lambda x: x <> ''))), lambda x: '0'),
        list_filter(string_split(split_part(t, '::', 2), ':'), lambda x: x <> '')))
    ELSE string_split(t, ':') END AS g FROM h2),
h4 AS (SELECT *, CASE WHEN is4 THEN [0, 0, 0, 0, 0, 65535, oct[1] * 256 + oct[2], oct[3] * 256 + oct[4]]
    WHEN g IS NOT NULL AND len(g) = 8 THEN list_transform(g, lambda x: CAST('0x' || x AS INTEGER)) END AS w FROM h3),
h5 AS (SELECT *, w[1:5] = [0, 0, 0, 0, 0] AND w[6] = 65535 AS mapped FROM h4),
h6 AS (SELECT *, CASE WHEN mapped THEN [w[7], w[8]]
    WHEN w[1:6] = [0, 0, 0, 0, 0, 0] THEN [w[7], w[8]]
    WHEN w[1] = 8194 THEN [w[2], w[3]]
    WHEN w[1:6] = [100, 65435, 0, 0, 0, 0] THEN [w[7], w[8]]
    WHEN w[1:3] = [25855, 39681, 0] THEN [w[4], (w[5] & 255) * 256 + (w[6] >> 8)]
    WHEN w[1:2] = [8193, 0] THEN [65535 - w[7], 65535 - w[8]]
    WHEN w[5] IN (0, 512) AND w[6] = 24318 THEN [w[7], w[8]] END AS e FROM h5),
h7 AS (SELECT *, CAST(e[1] AS BIGINT) * 65536 + e[2] AS n FROM h6),
h8 AS (SELECT *,
    coalesce(n = 0 OR n BETWEEN 2130706432 AND 2147483647, false) OR coalesce(w[1:7] = [0, 0, 0, 0, 0, 0, 0] AND w[8] IN (0, 1), false) AS lo,
    coalesce(n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 3758096384 AND 3758096639, false)
      OR coalesce(NOT mapped AND ((w[1] >> 6) = 1018 OR ((w[1] >> 8) = 255 AND (w[1] & 15) = 2)), false) AS ll,
    coalesce(n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055
      OR n BETWEEN 1681915904 AND 1686110207, false) OR coalesce(NOT mapped AND (w[1] >> 9) = 126, false) AS pr FROM h7)
SELECT id, ip, CASE WHEN w IS NULL THEN 'invalid' WHEN lo THEN 'loopback' WHEN ll THEN 'link_local' WHEN pr THEN 'private'
  ELSE 'public' END AS ip_class, w IS NOT NULL AND NOT lo AND NOT ll AND NOT pr AS ip_allowed FROM h8"""


def _json_sql():
    def pair(key, col, kind):
        value = f"""'"' || {col} || '"'""" if kind == "text" else f"CAST({col} AS VARCHAR)"
        return f"""CASE WHEN {col} IS NOT NULL THEN '"{key}":' || {value} END"""

    kinds = lambda c: "text" if c in ("resizing_type", "gravity_type") else "number"
    parts = []
    for group, fields in PLAN_GROUPS.items():
        members = [pair(key, c, kinds(c)) for key, c in fields.items()]
        if group:
            some = " OR ".join(f"{c} IS NOT NULL" for c in fields.values())
            parts.append(f"""CASE WHEN {some} THEN '"{group}":{{' || concat_ws(',', {", ".join(members)}) || '}}' END""")
        else:
            parts.extend(members)
    return f"SELECT req_id, '{{' || concat_ws(',', {', '.join(parts)}) || '}}' AS plan_json FROM plan"


_HINTS = f"""feat AS (SELECT req_id,
  coalesce(CASE WHEN {_ISF.format(v="sec_ch_dpr")} AND CAST(sec_ch_dpr AS DOUBLE) > 0 AND CAST(sec_ch_dpr AS DOUBLE) <= 8
      THEN CAST(sec_ch_dpr AS DOUBLE) END,
    CASE WHEN {_ISF.format(v="dpr_header")} AND CAST(dpr_header AS DOUBLE) > 0 THEN CAST(dpr_header AS DOUBLE) END) AS hint_dpr,
  coalesce(CASE WHEN {_ISINT.format(v="sec_ch_width")} AND CAST(sec_ch_width AS BIGINT) > 0 THEN CAST(sec_ch_width AS BIGINT) END,
    CASE WHEN {_ISINT.format(v="width_header")} AND CAST(width_header AS BIGINT) > 0 THEN CAST(width_header AS BIGINT) END) AS hint_width,
  coalesce(contains(accept, 'image/webp'), false) AS prefer_webp, false AS enforce_webp,
  coalesce(contains(accept, 'image/avif'), false) AS prefer_avif, coalesce(contains(accept, 'image/avif'), false) AS enforce_avif,
  coalesce(contains(accept, 'image/jxl'), false) AS prefer_jxl, false AS enforce_jxl FROM client_headers)"""

_PLAIN_PATH = "regexp_replace(uri, '^/unsafe/', '')"
_SIG1, _SIG2 = _b64u(_hmac_sql(KEY, SALT, "path")), _b64u(_hmac_sql(KEY2, SALT2, "path"))

ORACLES = {
    "flagship_request_megapixels": _req_sql(
        f"""SELECT coalesce(format, src_format) AS out_format, resizing_type, count(*) AS renditions,
  CAST(sum(r.result_w * r.result_h) AS BIGINT) AS result_pixels
FROM geo JOIN ({RESULT_SQL}) r USING (req_id) GROUP BY 1, 2""",
        _GEO_FROM_PLAN,
    ),
    "b01_split_signature": with_tables("uris", _SPLIT + "\nSELECT req_id, signature, path, path_status FROM u2"),
    "b02_redenormalize_path": with_tables("uris", _SPLIT + _B02),
    "b03_tokenize_options": _with_options(
        """SELECT s.req_id, coalesce(string_agg(o.given || '=' || array_to_string(o.args, ','), '|' ORDER BY o.pos), '') AS options_text,
  any_value(array_to_string(s.parts[s.stop:], '/')) AS rest FROM ro_s s LEFT JOIN ro o ON o.req_id = s.req_id GROUP BY s.req_id"""
    ),
    "b04_options_parse": _with_options(
        f"SELECT req_id, {', '.join(PLAN_COLUMNS)}, skip_formats, format_quality FROM plan",
        errors_sql("ro", security=True),
        _GOOD,
        plan_sql("ro", "good"),
    ),
    "b05_argument_errors": _with_options(
        f"SELECT a.req_id, option_error, {_STATUS} FROM option_paths a LEFT JOIN err USING (req_id)", errors_sql("ro")
    ),
    "b06_presets_parse": with_tables(
        "preset_lines",
        """t0 AS (SELECT line_id, trim(line) AS t FROM preset_lines),
t1 AS (SELECT line_id, string_split(t, '=') AS pc FROM t0 WHERE t <> '' AND NOT starts_with(t, '#')),
t2 AS (SELECT line_id, len(pc) AS n, trim(pc[1]) AS name, trim(coalesce(pc[2], '')) AS val FROM t1),
t3 AS (SELECT *, string_split(val, '/') AS sg FROM t2),
t4 AS (SELECT *, CASE WHEN n <> 2 THEN 'invalid preset string' WHEN name = '' THEN 'empty preset name'
  WHEN val = '' THEN 'empty preset value' WHEN list_bool_or(list_transform(sg, lambda s: NOT contains(s, ':')))
  THEN 'invalid preset value' END AS error FROM t3)
SELECT line_id, CASE WHEN error IS NULL THEN name END AS name, error, CASE WHEN error IS NULL THEN array_to_string(
  list_transform(sg, lambda s: string_split(s, ':')[1] || '=' || array_to_string(string_split(s, ':')[2:], ',')), '|')
  ELSE '' END AS options_text FROM t4""",
    ),
    "b07_presets_expand": _preset_sql(
        f"""SELECT req_id, {_EXP_TEXT}, coalesce(string_agg(args[1], ',' ORDER BY pos, k, ord) FILTER (WHERE given = '#preset'), '')
  AS used_presets FROM (SELECT * FROM exp UNION ALL SELECT p.req_id, 0, 0, b.ord, b.given, b.args, NULL
  FROM preset_paths p JOIN book b ON b.root = 'default') GROUP BY req_id""",
        "pp AS (SELECT req_id, 0 AS ts_us, path FROM preset_paths)",
        tokens_sql("pp"),
        _expanded("ro"),
    ),
    "b08_only_presets": _preset_sql(
        f"""SELECT req_id, {_EXP_TEXT}, any_value('plain/http://example.com/' || req_id) AS rest FROM exp GROUP BY req_id""",
        """ro AS (SELECT event_id AS req_id, 1 AS pos, 'preset' AS given, 'preset' AS canon, string_split(CASE event_id % 3
    WHEN 0 THEN 'thumb' WHEN 1 THEN 'thumb:wide' ELSE 'loop_a:nosuch' END, ':') AS args FROM events)""",
        _expanded("ro"),
        tables="presets",
    ),
    "b09_gate_options": _with_options(
        f"SELECT a.req_id, option_error, {_STATUS} FROM option_paths a LEFT JOIN err USING (req_id)",
        errors_sql("ro", allowed=ALLOWED),
    ),
    "b10_decode_source_url": with_tables(
        "source_paths",
        f"""{_decode_ctes("source_paths", "tail", "p1", False).strip()},{_decode_ctes("source_paths", "tail", "p2", True)}
SELECT p1.req_id, p1.source_url, p1.ext, p1.url_status, p2.source_url AS named_url FROM p1 JOIN p2 USING (req_id)""",
    ),
    "b11_rewrite_source_url": with_tables(
        "images",
        r"""r0 AS (SELECT image_id, regexp_replace(regexp_replace(source_url, '^http://img0\.example\.com/([^/]*)/', 's3://bucket/\1/'),
    '^http://img1\.([^/]*)/p/', 'https://cdn.\1/q/') AS u FROM images)
SELECT image_id, CASE WHEN starts_with(u, 'https://') THEN u ELSE 'https://' || u END AS source_url FROM r0""",
    ),
    "b12_check_source_allowed": with_tables(
        "images",
        r"""SELECT image_id, CAST(CASE WHEN regexp_matches(source_url, '^http://img1\.example\.com/')
  OR regexp_matches(source_url, '^http://img2\.[^/]*\.com/p/1[^/]*') OR regexp_matches(source_url, '^http://[^/]*\.example\.com/p/[^/]*\.gif')
  THEN NULL ELSE 404 END AS BIGINT) AS source_status FROM images""",
    ),
    "b13_classify_source_ip": with_tables("source_ips", _IP),
    "b14_request_verdict": _req_sql(
        """SELECT req_id, CAST(coalesce(option_status, url_status, ext_status, source_status, CASE WHEN p.format = 'svg' THEN 422 END,
    CASE WHEN req_id % 50 = 7 THEN 429 END, CASE WHEN i.bytes > 1200000 THEN 422 END, CASE WHEN i.format = 'ico' THEN 422 END, 200)
    AS BIGINT) AS status,
  CASE WHEN coalesce(option_status, url_status, ext_status) IS NOT NULL THEN 'path_parsing' WHEN source_status IS NOT NULL THEN 'security'
    WHEN p.format = 'svg' THEN 'path_parsing' WHEN req_id % 50 = 7 THEN 'queue' WHEN i.bytes > 1200000 THEN 'download'
    WHEN i.format = 'ico' THEN 'path_parsing' END AS error_category
FROM parsed p LEFT JOIN images i USING (source_url)"""
    ),
    "b15_verify_signature": with_tables(
        "requests",
        f"""s0 AS (SELECT req_id, {_PLAIN_PATH} AS path FROM requests)
SELECT req_id, CAST(CASE WHEN req_id % 5 <= 2 THEN NULL ELSE 403 END AS BIGINT) AS status_keys,
  CAST(CASE WHEN req_id % 5 = 4 THEN 403 END AS BIGINT) AS status_open FROM s0""",
    ),
    "b16_sign_urls": with_tables(
        "requests",
        f"""s0 AS (SELECT req_id, {_PLAIN_PATH} AS path FROM requests)
SELECT req_id, '/' || {_SIG1} || '/' || path AS signed_uri,
  '/' || {_b64u(f"unhex(substr(hex({_hmac_sql(KEY, SALT, 'path')}), 1, 16))")} || '/' || path AS short_uri FROM s0""",
    ),
    "b17_encrypt_source_urls": with_tables(
        "images",
        """SELECT image_id, source_url AS decrypted_url,
  CAST(5 + ceil((16 + (len(source_url) // 16 + 1) * 16) * 8 / 6.0) AS BIGINT) AS token_length FROM images""",
    ),
    "b18_client_features": with_tables("client_headers", _HINTS + "\nSELECT * FROM feat"),
    "b19_default_plan": with_tables(
        "option_paths client_headers",
        f"""{_ALIASES},{tokens_sql("option_paths")},{errors_sql("ro", security=True)},{_GOOD},{plan_sql("ro", "good")},{_HINTS}
SELECT req_id, coalesce(width, CAST(round(hint_width / coalesce(hint_dpr, 1.0e0)) AS BIGINT)) AS width, coalesce(dpr, hint_dpr) AS dpr,
  coalesce(auto_rotate, true) AS auto_rotate FROM plan JOIN feat USING (req_id)""",
    ),
    "b20_vary_header": "SELECT event_id AS req_id, CASE WHEN event_id % 2 = 0 THEN 'Accept, Sec-CH-DPR, DPR, Sec-CH-Width, Width' "
    "ELSE 'Accept' END AS vary FROM events",
    "b21_apply_extension": _with_options(
        """, rawf AS (SELECT req_id, max_by(v, pos) FILTER (WHERE canon = 'raw') AS raw, max_by(v, pos) FILTER (WHERE canon = 'format') AS fmt
  FROM (SELECT req_id, pos, canon, CASE args[1] WHEN 'jpg' THEN 'jpeg' ELSE args[1] END AS v FROM ro
        WHERE canon = 'raw' OR (canon = 'format' AND args[1] <> 'tif')) GROUP BY req_id)
SELECT a.req_id, CASE WHEN coalesce(raw, '0') = '1' OR a.req_id % 3 = 2 THEN fmt WHEN a.req_id % 3 = 0 THEN 'webp' END AS format,
  CAST(CASE WHEN coalesce(raw, '0') <> '1' AND a.req_id % 3 = 1 THEN 404 END AS BIGINT) AS ext_status
FROM option_paths a LEFT JOIN rawf USING (req_id)"""
    ),
    "b22_split_raw": _req_sql(
        """SELECT CASE WHEN coalesce(raw, false) THEN 'raw' ELSE 'transform' END AS branch, count(*) AS requests,
  CAST(sum(CASE WHEN coalesce(raw, false) THEN 2 ELSE 0 END) AS BIGINT) AS headers FROM parsed GROUP BY 1"""
    ),
    "b23_plan_json": _with_options(_json_sql(), errors_sql("ro", security=True), _GOOD, plan_sql("ro", "good")),
    "b24_dedupe_renditions": _req_sql(
        f"""SELECT count(*) AS requests, min(req_id) AS first_req FROM parsed
GROUP BY source_url, {", ".join(requests.RENDITION_FIELDS)}"""
    ),
    "b25_expires_check": """SELECT event_id AS req_id,
  CASE WHEN event_id % 4 = 1 THEN 'option_argument' WHEN event_id % 4 > 1 AND 1704067200 + (event_id * 977) % 2592000 < epoch_us(ts) // 1000000
    THEN 'expired_url' END AS option_error,
  CAST(CASE WHEN event_id % 4 = 1 OR (event_id % 4 > 1 AND 1704067200 + (event_id * 977) % 2592000 < epoch_us(ts) // 1000000)
    THEN 404 END AS BIGINT) AS option_status FROM events""",
}

"""Request log -> signature, options, source URL and verdict, one row per request.

All of it is projection; presets, keys and patterns are configuration and enter the
plan as literals or as one scalar map, so requests are never shuffled.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravure.functions.crypto import path_digest
from gravure.functions.numeric import shrink
from gravure.functions.rows import settle
from gravure.functions.text import (
    any_wildcard, b64url_decode, b64url_encode, parse_float, parse_int, path_unescape, wildcard_regex,
)
from gravure.plans import dims
from gravure.plans.options import PLAN_FIELDS, argument_errors, typed_plan

OPTION_TYPE = "array<struct<name: string, given_name: string, args: array<string>, in_url: boolean>>"


def _drop_slash(text: Column) -> Column:
    return F.regexp_replace(text, "^/", "")


def split_signature(df: DataFrame, prefix: str = "", uri: str = "uri") -> DataFrame:
    """First segment is the signature, the rest the path; either missing is a 404."""
    whole = F.substring_index(F.col(uri), "?", 1)
    if prefix:
        whole = F.when(whole.startswith(prefix), F.substr(whole, F.lit(len(prefix) + 1))).otherwise(whole)
    whole = _drop_slash(whole)
    slash = F.instr(whole, "/")
    df = df.withColumns(
        {
            "signature": F.substring_index(whole, "/", 1),
            "path": F.when(slash > 0, F.substr(whole, slash + 1)).otherwise(F.lit("")),
        }
    )
    missing = (F.col("signature") == "") | (F.col("path") == "")
    return df.withColumns(
        {
            "path_status": F.when(missing, 404),
            "signature": F.when(missing, F.lit("")).otherwise(F.col("signature")),
            "path": F.when(missing, F.lit("")).otherwise(F.col("path")),
        }
    )


def redenormalize_path(df: DataFrame, path: str = "path") -> DataFrame:
    """Undo what proxies do to a path: '%3A' in options, 'scheme:/x' in a plain URL."""
    p = F.col(path)
    mark = F.instr(p, "/plain/")
    bare = p.startswith("plain/")
    options = F.when(bare, F.lit("")).when(mark > 0, F.left(p, mark - 1)).otherwise(p)
    plain = F.when(bare, F.substr(p, F.lit(7))).when(mark > 0, F.substr(p, mark + 7))
    scheme = r"^(\S+):/([^/])"
    slashes = F.when(F.regexp_extract(plain, scheme, 1) == "local", F.regexp_replace(plain, scheme, "$1:///$2"))
    fixed = F.coalesce(slashes, F.regexp_replace(plain, scheme, "$1://$2"))
    opened = F.replace(options, F.lit("%3A"), F.lit(":"))
    return df.withColumn(
        path, _drop_slash(F.when(plain.isNull(), opened).otherwise(F.concat(opened, F.lit("/plain/"), fixed)))
    )


def canonical_name(name: Column) -> Column:
    pairs = [F.lit(x) for pair in dims.CANONICAL.items() for x in pair]
    return F.element_at(F.create_map(*pairs), name)


def option_struct(name: Column, args: Column, in_url: bool = True) -> Column:
    return F.struct(
        canonical_name(name).alias("name"),
        name.alias("given_name"),
        args.alias("args"),
        F.lit(in_url).alias("in_url"),
    )


def _segment_option(segment: Column, separator: str) -> Column:
    pieces = F.split(segment, re.escape(separator))
    return option_struct(F.get(pieces, F.lit(0)), F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))))


def tokenize_options(df: DataFrame, separator: str = ":", path: str = "path") -> DataFrame:
    """Leading 'name:arg:...' segments become options; the first other segment starts the URL."""
    parts = F.split(F.col(path), "/")
    df = df.withColumn("_parts", parts)
    stop = F.array_position(F.transform("_parts", lambda p: ~F.contains(p, F.lit(separator))), True)
    df = df.withColumn("_stop", stop)
    count = F.when(F.col("_stop") == 0, F.size("_parts")).otherwise(F.col("_stop") - 1).cast("int")
    head = F.slice("_parts", F.lit(1), count)
    rest = F.when(F.col("_stop") == 0, F.array().cast("array<string>")).otherwise(
        F.slice("_parts", F.col("_stop").cast("int"), F.size("_parts"))
    )
    return df.withColumns(
        {"options": F.transform(head, lambda s: _segment_option(s, separator)), "rest": rest}
    ).drop("_parts", "_stop")


def request_options(df: DataFrame) -> DataFrame:
    """The long form: one row per option of a request, in order."""
    return df.select("req_id", F.posexplode("options").alias("pos", "o")).select(
        "req_id", F.col("pos").cast("bigint").alias("pos"), F.col("o.given_name").alias("name"), F.col("o.args").alias("args")
    )


# --- presets ----------------------------------------------------------------------------


def presets_parse(lines: DataFrame, line: str = "line", separator: str = ":") -> DataFrame:
    """Preset lines -> name, options, error; blank lines and comments are left out."""
    text = F.trim(F.col(line))
    pieces = F.split(text, "=")
    df = lines.withColumns(
        {"_t": text, "name": F.trim(F.get(pieces, F.lit(0))), "_value": F.trim(F.get(pieces, F.lit(1))), "_n": F.size(pieces)}
    ).filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))
    df = df.withColumn("_segments", F.split("_value", "/"))
    trailing = F.exists("_segments", lambda s: ~F.contains(s, F.lit(separator)))
    df = df.withColumn(
        "error",
        F.when(F.col("_n") != 2, F.lit("invalid preset string"))
        .when(F.col("name") == "", F.lit("empty preset name"))
        .when(F.col("_value") == "", F.lit("empty preset value"))
        .when(trailing, F.lit("invalid preset value")),
    )
    options = F.transform("_segments", lambda s: _segment_option(s, separator))
    return df.withColumn(
        "options", F.when(F.col("error").isNull(), options).otherwise(F.array().cast(OPTION_TYPE))
    ).drop("_t", "_value", "_n", "_segments")


def presets_closure(presets: DataFrame) -> DataFrame:
    """Every preset (name, pos, opt, args) with nested presets inlined: root -> ordered options.

    Walks the preset graph with a path per branch; a preset already on its path is
    skipped. A '#preset' marker records each use. The input is configuration: its
    depth and size are those of the preset list.
    """
    spark = presets.sparkSession
    marked = presets.select(
        "name", F.col("pos").cast("int").alias("pos"), canonical_name(F.col("opt")).alias("opt"), F.col("opt").alias("given"), "args"
    )
    markers = marked.select("name").distinct().select(
        "name", F.lit(-1).alias("pos"), F.lit("#preset").alias("opt"), F.lit("#preset").alias("given"),
        F.array("name").alias("args"),
    )
    walked = spark.sql(
        """
        WITH RECURSIVE walk AS (
          SELECT name AS root, array(name) AS path, array(pos) AS ord, opt, given, args FROM {steps}
          UNION ALL
          SELECT w.root, array_append(w.path, p.name), concat(w.ord, array(w.k, p.pos)), p.opt, p.given, p.args
          FROM (SELECT root, path, ord, k, child
                FROM walk LATERAL VIEW posexplode(CASE WHEN opt = 'preset' THEN args END) t AS k, child) w
          JOIN {steps} p ON p.name = w.child
          WHERE NOT array_contains(w.path, p.name)
        )
        SELECT root, ord, opt, given, args FROM walk
        """,
        steps=markers.unionByName(marked),
    )
    names = presets.agg(F.collect_set("name")).scalar()
    nested = F.col("opt") == "preset"
    unknown = F.array_except("args", names)
    steps = walked.withColumn("args", F.when(nested, unknown).otherwise(F.col("args"))).filter(
        ~nested | (F.size("args") > 0)
    )
    step = F.struct(
        "ord", F.col("opt").alias("name"), F.col("given").alias("given_name"), "args", F.lit(False).alias("in_url")
    )
    return steps.groupBy("root").agg(F.array_sort(F.collect_list(step)).alias("steps")).select(
        "root", F.transform("steps", lambda s: s.dropFields("ord")).alias("options")
    )


def _book(closure: DataFrame, literal: bool) -> Column:
    """Preset name -> its options, as one map: a scalar subquery, or a literal for streams.

    A micro-batch does not wait for subqueries reliably, so a stream takes the closed presets
    (configuration, a handful of rows) as a literal when it is defined.
    """
    if not literal:
        return closure.agg(F.map_from_entries(F.collect_list(F.struct("root", "options")))).scalar()
    entries = []
    for row in closure.collect():
        steps = [
            F.struct(
                F.lit(o.name).alias("name"), F.lit(o.given_name).alias("given_name"),
                F.array(*[F.lit(a) for a in o.args]).alias("args"), F.lit(o.in_url).alias("in_url"),
            )
            for o in row.options
        ]
        entries += [F.lit(row.root), F.array(*steps).cast(OPTION_TYPE)]
    return F.create_map(*entries) if entries else F.create_map().cast(f"map<string, {OPTION_TYPE}>")


def presets_expand(df: DataFrame, presets: DataFrame, default: bool = True) -> DataFrame:
    """Inline presets where they stand; the preset `default`, if any, comes before everything."""
    df = df.withColumn("_book", _book(presets_closure(presets), df.isStreaming))
    unknown = lambda p, o: F.array(
        F.struct(
            F.lit("preset").alias("name"), o["given_name"].alias("given_name"), F.array(p).alias("args"),
            o["in_url"].alias("in_url"),
        )
    ).cast(OPTION_TYPE)
    inlined = F.flatten(
        F.transform(
            "options",
            lambda o: F.when(
                o["name"] == "preset",
                F.flatten(F.transform(o["args"], lambda p: F.coalesce(F.try_element_at("_book", p), unknown(p, o)))),
            ).otherwise(F.array(o)),
        )
    )
    if default:
        none = F.array().cast(OPTION_TYPE)
        inlined = F.concat(F.coalesce(F.try_element_at(F.col("_book"), F.lit("default")), none), inlined)
    return df.withColumn("options", inlined).drop("_book")


def only_presets(df: DataFrame, separator: str = ":", path: str = "path") -> DataFrame:
    """The whole first segment lists presets; what follows is the URL."""
    parts = F.split(F.col(path), "/")
    names = F.split(F.get(parts, F.lit(0)), re.escape(separator))
    return df.withColumns(
        {
            "options": F.array(option_struct(F.lit("preset"), names)),
            "rest": F.slice(parts, 2, F.size(parts)),
        }
    )


def gate_options(df: DataFrame, allowed: list[str], security_options: bool) -> DataFrame:
    """Refuse options outside the allow-list and, unless switched on, security options."""
    return argument_errors(df, allowed=allowed, security_options=security_options)


# --- source URL -------------------------------------------------------------------------


def decode_source_url(df: DataFrame, base64_filename: bool = False) -> DataFrame:
    """Plain or base64 source URL with its extension; url_status is 404 where broken."""
    rest = F.col("rest")
    plain = F.coalesce((F.get(rest, F.lit(0)) == "plain") & (F.size(rest) > 1), F.lit(False))
    tail = rest
    if base64_filename:
        tail = F.when(F.size(rest) > 1, F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
    pieces = F.when(plain, F.split(F.array_join(F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))), "/"), "@")).otherwise(
        F.split(F.array_join(tail, ""), r"\.")
    )
    df = df.withColumns({"_plain": plain, "_pieces": pieces})
    first = F.get("_pieces", F.lit(0))
    url = F.when(F.col("_plain"), path_unescape(first)).otherwise(
        b64url_decode(F.rtrim(first, F.lit("="))).cast("string")
    )
    df = df.withColumn("source_url", F.when((first != "") & (F.size("_pieces") <= 2), url))
    return df.withColumns(
        {
            "ext": F.coalesce(F.when(F.col("source_url").isNotNull(), F.get("_pieces", F.lit(1))), F.lit("")),
            "url_status": F.when(F.col("source_url").isNull(), 404),
        }
    ).drop("_plain", "_pieces")


def rewrite_source_url(
    df: DataFrame, rules: list[tuple[str, str]], base: str = "", url: str = "source_url"
) -> DataFrame:
    """Ordered wildcard replacements, then the base URL unless already there."""
    value = F.col(url)
    for pattern, replacement in rules:
        value = F.regexp_replace(value, wildcard_regex(pattern), re.sub(r"\$\{(\w+)\}", r"$\1", replacement))
    df = df.withColumn(url, value)
    if base:
        df = df.withColumn(
            url, F.when(F.col(url).startswith(base), F.col(url)).otherwise(F.concat(F.lit(base), F.col(url)))
        )
    return df


def check_source_allowed(df: DataFrame, patterns: list[str], url: str = "source_url") -> DataFrame:
    """source_status is 404 where no pattern matches the start of the URL."""
    return df.withColumn("source_status", F.when(~any_wildcard(F.col(url), patterns), 404))


# --- source addresses -------------------------------------------------------------------

# Networks that source addresses may be kept from, and their class.
NETWORKS = (
    ("127.0.0.0/8", "loopback"), ("0.0.0.0/32", "loopback"), ("::1/128", "loopback"), ("::/128", "loopback"),
    ("169.254.0.0/16", "link_local"), ("224.0.0.0/24", "link_local"), ("fe80::/10", "link_local"),
    *((f"ff{flags:x}2::/16", "link_local") for flags in range(16)),
    ("10.0.0.0/8", "private"), ("172.16.0.0/12", "private"), ("192.168.0.0/16", "private"), ("100.64.0.0/10", "private"),
    ("fc00::/7", "private"),
)


def network_table(spark: SparkSession, networks: Iterable[tuple[str, str]] = NETWORKS) -> DataFrame:
    """(family, low, high, class): networks as intervals of hex digits, 8 for IPv4 and 32 for IPv6."""
    rows = []
    for text, kind in networks:
        net = ipaddress.ip_network(text)
        digits = net.max_prefixlen // 4
        rows.append((net.version, f"{int(net.network_address):0{digits}x}", f"{int(net.broadcast_address):0{digits}x}", kind))
    return spark.createDataFrame(rows, "family int, low string, high string, class string")


def network_classes(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """(ip, classes) of addresses (ip, family, digits): a range join, by the first two digits of interval and address."""
    byte = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    spread = networks.withColumn("first", F.explode(F.sequence(byte("low"), byte("high"))))
    met = addresses.withColumn("first", byte("digits")).join(spread, ["family", "first"])
    return met.where(F.col("digits").between(F.col("low"), F.col("high"))).groupBy("ip").agg(F.collect_set("class").alias("classes"))


# Groups of one to four hex digits, one "::" at most, no single colon at either end.
IPV6 = "^(?!.*::.*::)(?!.*:::)(?!:[^:])(?!.*[^:]:$)[0-9a-f]{0,4}(:[0-9a-f]{0,4})+$"


def ip_hex(ip: Column) -> Column:
    """32 hex digits of an address (IPv4 as mapped ::ffff:a.b.c.d), NULL where malformed."""
    octet = lambda part: F.lpad(F.lower(F.hex(part.try_cast("int"))), 2, "0")
    quad = lambda dotted: F.array_join(F.transform(F.split(dotted, r"\."), octet), "")
    good_quad = r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)"
    v4 = F.concat(F.lit("0" * 20 + "ffff"), quad(ip))
    dotted = F.nullif(F.regexp_extract(ip, f":({good_quad})$", 1), F.lit(""))
    tail = quad(dotted)
    text = F.lower(
        F.when(
            dotted.isNotNull(),
            F.concat(
                F.left(ip, F.length(ip) - F.length(dotted)), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4)
            ),
        ).otherwise(ip)
    )
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    gap = F.instr(text, "::")
    left = groups(F.when(gap > 0, F.left(text, gap - 1)).otherwise(text))
    right = groups(F.when(gap > 0, F.substr(text, gap + 2)).otherwise(F.lit("")))
    missing = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.when(gap > 0, missing).otherwise(0).cast("int")), right)
    v6 = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    full = F.when(ip.rlike(f"^{good_quad}$"), v4).when(text.rlike(IPV6) & ((gap == 0) | (F.size(left) + F.size(right) < 8)), v6)
    return F.when(full.rlike("^[0-9a-f]{32}$"), full)


def embedded_v4(hexed: Column) -> Column:
    """Eight hex digits of the IPv4 address carried inside an IPv6 address, else NULL."""
    last = F.right(hexed, F.lit(8))
    return (
        F.when(hexed.rlike("^0{20}ffff"), F.lit(None).cast("string"))
        .when(hexed.rlike("^0{24}"), last)
        .when(hexed.rlike("^2002"), F.substring(hexed, 5, 8))
        .when(hexed.rlike("^0064ff9b0{16}"), last)
        .when(hexed.rlike("^64ff9b010000"), F.concat(F.substring(hexed, 13, 4), F.substring(hexed, 19, 4)))
        .when(hexed.rlike("^20010000"), F.translate(last, "0123456789abcdef", "fedcba9876543210"))
        .when(hexed.rlike("^.{16}0[02]005efe"), last)
    )


def classify_source_ip(
    df: DataFrame, ip: str = "ip", allow_loopback: bool = False, allow_link_local: bool = False, allow_private: bool = True,
    networks: DataFrame | None = None,
) -> DataFrame:
    """ip_class (first that applies) and whether the source address is allowed, by a table of networks (see network_table).

    Each different address is looked up once, with the IPv4 address it may carry inside.
    """
    own = df.select(F.col(ip).alias("ip")).where("ip IS NOT NULL").distinct()
    own = settle(own.withColumn("_hex", ip_hex(F.col("ip"))), "_hex")
    mapped = F.col("_hex").rlike("^0{20}ffff")
    four = F.when(mapped, F.right("_hex", F.lit(8))).otherwise(embedded_v4(F.col("_hex")))
    both = F.array(F.struct(F.lit(4).alias("family"), four.alias("digits")), F.struct(F.lit(6).alias("family"), F.when(~mapped, F.col("_hex")).alias("digits")))
    addresses = own.select("ip", F.inline(both)).where("digits IS NOT NULL")
    found = network_classes(addresses, networks if networks is not None else network_table(df.sparkSession))
    known = own.join(found, "ip", "left").select(F.col("ip").alias("_ip"), F.col("_hex").isNotNull().alias("_valid"), F.coalesce("classes", F.array().cast("array<string>")).alias("_in"))
    df = df.join(known, F.col(ip) == F.col("_ip"), "left")
    valid = F.coalesce(F.col("_valid"), F.lit(False))
    has = lambda kind: F.coalesce(F.array_contains("_in", kind), F.lit(False))
    refused = ~valid
    kind = F.when(~valid, "invalid")
    for name, allowed in (("loopback", allow_loopback), ("link_local", allow_link_local), ("private", allow_private)):
        refused = refused if allowed else refused | has(name)
        kind = kind.when(has(name), name)
    return df.withColumns({"ip_class": kind.otherwise("public"), "ip_allowed": ~refused}).drop("_ip", "_valid", "_in")


# --- signatures -------------------------------------------------------------------------


def verify_signature(
    df: DataFrame, pairs: list[tuple[bytes, bytes]], size: int = 32, trusted: tuple[str, ...] = ()
) -> DataFrame:
    """signature_status is 403 where no (key, salt) pair signs the path."""
    signature = F.col("signature")
    if not pairs:
        return df.withColumn("signature_status", F.when(F.contains(signature, F.lit(":")), 403))
    given = b64url_decode(signature)
    match = F.lit(False)
    for key, salt in pairs:
        match = match | F.coalesce(given == path_digest(key, salt, F.col("path"), size), F.lit(False))
    passes = signature.isin(*trusted) | match if trusted else match
    return df.withColumn("signature_status", F.when(~passes, 403))


def sign_urls(df: DataFrame, key: bytes, salt: bytes, size: int = 32) -> DataFrame:
    """signed_uri: '/<signature>/<path>'."""
    digest = path_digest(key, salt, F.col("path"), size)
    return df.withColumn("signed_uri", F.concat(F.lit("/"), b64url_encode(digest), F.lit("/"), F.col("path")))


def encrypt_source_urls(df: DataFrame, key: bytes, iv: Column, url: str = "source_url") -> DataFrame:
    """enc_path: '/enc/' and base64url of IV and AES-CBC ciphertext."""
    sealed = F.aes_encrypt(F.col(url), F.lit(bytearray(key)), F.lit("CBC"), F.lit("PKCS"), iv)
    return df.withColumn("enc_path", F.concat(F.lit("/enc/"), b64url_encode(sealed)))


def decrypt_source_urls(df: DataFrame, key: bytes) -> DataFrame:
    sealed = b64url_decode(F.regexp_replace("enc_path", "^/enc/", ""))
    opened = F.aes_decrypt(sealed, F.lit(bytearray(key)), F.lit("CBC"), F.lit("PKCS"))
    return df.withColumn("decrypted_url", opened.cast("string"))


# --- client features --------------------------------------------------------------------


def client_features(
    df: DataFrame, auto: tuple[str, ...] = (), enforce: tuple[str, ...] = (), client_hints: bool = False
) -> DataFrame:
    """prefer_/enforce_ flags from Accept; DPR and width from client hints."""
    for fmt in ("webp", "avif", "jxl"):
        accepted = F.coalesce(F.contains("accept", F.lit(f"image/{fmt}")), F.lit(False))
        on = fmt in auto or fmt in enforce
        df = df.withColumns(
            {
                f"prefer_{fmt}": accepted if on else F.lit(False),
                f"enforce_{fmt}": accepted if fmt in enforce else F.lit(False),
            }
        )
    ratio = lambda c: F.when((parse_float(F.col(c)) > 0) & (parse_float(F.col(c)) <= 8), parse_float(F.col(c)))
    size = lambda c: F.when(parse_int(F.col(c)) > 0, parse_int(F.col(c)))
    none = F.lit(None)
    return df.withColumns(
        {
            "hint_dpr": F.coalesce(ratio("sec_ch_dpr"), ratio("dpr_header")) if client_hints else none.cast("double"),
            "hint_width": F.coalesce(size("sec_ch_width"), size("width_header"))
            if client_hints
            else none.cast("bigint"),
        }
    )


def default_plan(df: DataFrame) -> DataFrame:
    """Client hints as options that come before the default preset and the URL's own."""
    ratio = F.coalesce("hint_dpr", F.lit(1.0))
    width = shrink("hint_width", ratio)
    entry = lambda name, value: F.when(
        value.isNotNull(), F.array(option_struct(F.lit(name), F.array(value.cast("string")), in_url=False))
    ).otherwise(F.array().cast(OPTION_TYPE))
    hints = F.concat(entry("dpr", F.col("hint_dpr")), entry("width", width))
    return df.withColumn("options", F.concat(hints, F.col("options")))


def vary_header(auto: tuple[str, ...], enforce: tuple[str, ...], client_hints: bool) -> str:
    """Value of the Vary header for a configuration."""
    names = ["Accept"] if auto or enforce else []
    if client_hints:
        names += ["Sec-CH-DPR", "DPR", "Sec-CH-Width", "Width"]
    return ", ".join(names)


def apply_extension(df: DataFrame) -> DataFrame:
    """The URL's extension sets the format last, unless the request is raw."""
    used = (F.col("ext") != "") & ~F.coalesce("raw", F.lit(False))
    named = dims.type_name(F.col("ext"))
    return df.withColumns(
        {
            "ext_status": F.when(used & named.isNull(), 404),
            "format": F.when(used, named).otherwise(F.col("format")),
        }
    )


def split_raw(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, transform): raw requests bypass the image pipeline."""
    raw = F.coalesce("raw", F.lit(False))
    return df.filter(raw), df.filter(~raw)


# --- whole requests ---------------------------------------------------------------------


def parse_requests(
    df: DataFrame, presets: DataFrame | None = None, allowed: list[str] | None = None, security_options: bool = False,
    sources: list[str] | None = None,
) -> DataFrame:
    """Path, options, plan, source URL and the status of every stage, in one projection chain."""
    df = settle(redenormalize_path(split_signature(df)), "signature", "path", "path_status")
    df = tokenize_options(df)
    if presets is not None:
        df = presets_expand(df, presets)
    df = settle(df, "options", "rest")
    df = argument_errors(df, allowed=allowed, security_options=security_options)
    df = settle(decode_source_url(df), "source_url", "ext", "url_status")
    df = apply_extension(typed_plan(df))
    df = check_source_allowed(df, sources or [])
    legacy = F.substring_index("path", "/", 1).isin(*dims.RESIZE_TYPES)
    return df.withColumn("legacy_status", F.when(legacy, 404))


def request_verdict(df: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """First failing stage in order: status (200 when none) and error category."""
    statuses = [F.col(c).cast("int") for c, _ in stages]
    categories = [F.when(F.col(c).isNotNull(), F.lit(category)) for c, category in stages]
    return df.withColumns(
        {"status": F.coalesce(*statuses, F.lit(200)), "error_category": F.coalesce(*categories)}
    )


# --- renditions -------------------------------------------------------------------------

DELIVERY_FIELDS = ("cachebuster", "filename", "return_attachment", "expires")
#: Everything of a plan that can change the result.
RENDITION_FIELDS = tuple(f for f in PLAN_FIELDS if f not in (*DELIVERY_FIELDS, "used_presets"))


def plan_json(df: DataFrame, groups: dict[str, dict[str, str]], name: str = "plan_json") -> DataFrame:
    """Nested JSON of the options that were given; absent ones are left out."""
    parts = []
    for group, fields in groups.items():
        members = [F.col(c).alias(key) for key, c in fields.items()]
        if group:
            some = F.coalesce(*[F.col(c).cast("string") for c in fields.values()]).isNotNull()
            parts.append(F.when(some, F.struct(*members)).alias(group))
        else:
            parts.extend(members)
    return df.withColumn(name, F.to_json(F.struct(*parts)))


def dedupe_renditions(df: DataFrame, fields: Sequence[str] = RENDITION_FIELDS) -> DataFrame:
    """Requests that ask for the same pixels: one row per rendition with its request count.

    Two requests are one rendition if their whole plans agree, but for what only concerns delivery.
    The key is a digest, so the shuffle moves 32 bytes per partial group.
    """
    kept = [f for f in fields if f not in DELIVERY_FIELDS]
    key = F.sha2(F.to_json(F.struct("source_url", *kept)), 256)
    return df.withColumn("rendition_key", key).groupBy("rendition_key").agg(
        F.count(F.lit(1)).alias("requests"), F.min("req_id").alias("first_req")
    )

"""Queries I: delivery decisions, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.operators import delivery as dl
from gravure.registry.fixtures import table, with_tables

BUSTER_US = 1_704_844_800_000_000  # 2024-01-10 00:00:00 UTC
CFG = dl.CacheConfig(
    default_ttl=500_000, fallback_ttl=3_600, passthrough=True, etag_buster="b1", last_modified_buster_us=BUSTER_US
)
PLAIN = dl.CacheConfig()


def _log(spark, sf):
    return table(spark, sf, "headers_log")



def _i01(spark, sf):
    df = dl.cache_control(dl.effective_max_age(_log(spark, sf), CFG), CFG).withColumnRenamed("cache_control", "with_config")
    bare = df.withColumn("max_age", F.lit(None).cast("bigint"))
    return dl.cache_control(bare, PLAIN).select("req_id", "with_config", "cache_control")


def _i04(spark, sf):
    df = dl.conditional_in(_log(spark, sf), CFG).withColumnsRenamed({"send_inm": "busted_inm", "send_ims": "busted_ims"})
    return dl.conditional_in(df, PLAIN).select("req_id", "busted_inm", "busted_ims", "send_inm", "send_ims")


def _i09(spark, sf):
    first = F.create_map(F.lit("Etag"), F.coalesce("etag", F.lit("-")), F.lit("Cookie"), F.lit("c"))
    second = F.create_map(F.lit("Etag"), F.lit("other"), F.lit("Expires"), F.coalesce("origin_expires", F.lit("-")))
    kept = dl.header_passthrough(first, ["Etag", "Expires"])
    return _log(spark, sf).select(
        "req_id",
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(dl.header_merge(kept, second))))).alias("headers"),
    )


QUERIES = {
    "i01_cache_control": _i01,
    "i02_effective_max_age": lambda spark, sf: dl.effective_max_age(_log(spark, sf), CFG).select("req_id", "max_age"),
    "i03_etag_out": lambda spark, sf: dl.etag_out(_log(spark, sf), CFG).select("req_id", "etag_out"),
    "i04_conditional_in": _i04,
    "i05_last_modified_out": lambda spark, sf: dl.last_modified_out(_log(spark, sf), CFG).select(
        "req_id", "last_modified_out"
    ),
    "i06_not_modified": lambda spark, sf: dl.not_modified(_log(spark, sf)).select("req_id", "not_modified"),
    "i07_content_disposition": lambda spark, sf: dl.content_disposition(_log(spark, sf)).select(
        "req_id", "content_disposition"
    ),
    "i08_canonical_link": lambda spark, sf: dl.canonical_link(_log(spark, sf), "url").select("req_id", "link"),
    "i09_header_passthrough": _i09,
    "i10_client_ip": lambda spark, sf: dl.client_ip(_log(spark, sf)).select("req_id", "client_ip"),
}

_US = (
    "epoch_us(try_strptime(CASE WHEN regexp_full_match({v}, '[A-Z][a-z]{{2}}, [0-9]{{2}} [A-Z][a-z]{{2}} [0-9]{{4}} [0-9:]{{8}} GMT') "
    "THEN substr({v}, 6, 20) END, '%d %b %Y %H:%M:%S'))"
)
_AGE = """ag AS (SELECT *, CASE WHEN expires_s IS NOT NULL AND (NOT is_fallback OR CAST(expires_s AS BIGINT) * 1000000 - now_us < 3600000000)
    THEN least(500000, greatest(0, CAST(floor((CAST(expires_s AS BIGINT) * 1000000 - now_us) / 1000000) AS BIGINT)))
    WHEN is_fallback THEN 3600 END AS max_age FROM headers_log)"""
_UNQ = r"""trim(regexp_replace({v}, '^W/', ''), '"')"""
_B64 = (
    "decode(from_base64(rpad(translate({v}, '-_', '+/'), CAST(ceil(len({v}) / 4) * 4 AS INTEGER), '=')))"
)

ORACLES = {
    "i01_cache_control": with_tables(
        "headers_log",
        f"""{_AGE},
ex AS (SELECT *, greatest(0, CAST(floor(({_US.format(v="origin_expires")} - now_us) / 1000000) AS BIGINT)) AS el FROM ag)
SELECT req_id, CASE WHEN max_age > 0 THEN 'max-age=' || max_age || ', public' WHEN status >= 400 THEN NULL
    WHEN origin_cache_control <> '' THEN origin_cache_control WHEN el > 0 THEN 'max-age=' || el || ', public'
    ELSE 'max-age=500000, public' END AS with_config,
  CASE WHEN status < 400 THEN 'max-age=31536000, public' END AS cache_control FROM ex""",
    ),
    "i02_effective_max_age": with_tables("headers_log", _AGE + "\nSELECT req_id, CAST(max_age AS BIGINT) AS max_age FROM ag"),
    "i03_etag_out": with_tables(
        "headers_log",
        """SELECT req_id, CASE WHEN etag <> '' THEN '"b1/' || rtrim(translate(to_base64(encode(etag)), '+/', '-_'), '=') || '"' END AS etag_out
FROM headers_log""",
    ),
    "i04_conditional_in": with_tables(
        "headers_log",
        f"""q AS (SELECT *, nullif(if_none_match, '') AS inm, nullif(if_modified_since, '') AS ims, {_UNQ.format(v="if_none_match")} AS bare FROM headers_log),
r AS (SELECT *, CASE WHEN starts_with(bare, 'b1/') AND regexp_full_match(substr(bare, 4), '[A-Za-z0-9_-]*') THEN substr(bare, 4) END AS tok FROM q)
SELECT req_id, inm AS send_inm, ims AS send_ims, CASE WHEN tok IS NOT NULL THEN {_B64.format(v="tok")} END AS busted_inm,
  CASE WHEN (inm IS NULL OR tok IS NOT NULL) AND {_US.format(v="ims")} > {BUSTER_US} THEN ims END AS busted_ims FROM r""",
    ),
    "i05_last_modified_out": with_tables(
        "headers_log",
        f"""SELECT req_id, CASE WHEN {_US.format(v="last_modified")} < {BUSTER_US} THEN strftime(make_timestamp({BUSTER_US}), '%a, %d %b %Y %H:%M:%S') || ' GMT'
  WHEN {_US.format(v="last_modified")} IS NOT NULL THEN last_modified END AS last_modified_out FROM headers_log""",
    ),
    "i06_not_modified": with_tables(
        "headers_log",
        f"""SELECT req_id, CASE WHEN etag <> '' AND if_none_match <> '' THEN {_UNQ.format(v="etag")} = {_UNQ.format(v="if_none_match")}
  ELSE coalesce({_US.format(v="last_modified")} <= {_US.format(v="if_modified_since")}, false) END AS not_modified FROM headers_log""",
    ),
    "i07_content_disposition": with_tables(
        "headers_log",
        r"""n AS (SELECT *, list_extract(string_split(url, '/'), -1) AS nm FROM headers_log),
m AS (SELECT *, CASE WHEN contains(nm, '.') THEN '.' || list_extract(string_split(nm, '.'), -1) ELSE '' END AS ue FROM n)
SELECT req_id, CASE WHEN attachment THEN 'attachment' ELSE 'inline' END || '; filename="' ||
  replace(coalesce(nullif(filename, ''), nullif(substr(nm, 1, len(nm) - len(ue)), ''), 'image'), '"', '%22') ||
  coalesce(nullif(ext, ''), nullif(ue, ''), CASE content_type WHEN 'image/png' THEN '.png' ELSE '' END) || '"' AS content_disposition FROM m""",
    ),
    "i08_canonical_link": with_tables(
        "headers_log",
        """SELECT req_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN '<' || url || '>; rel="canonical"' END AS link FROM headers_log""",
    ),
    "i09_header_passthrough": with_tables(
        "headers_log",
        """SELECT req_id, '{"Etag":' || to_json(coalesce(etag, '-')) || ',"Expires":' || to_json(coalesce(origin_expires, '-')) || '}' AS headers FROM headers_log""",
    ),
    "i10_client_ip": with_tables(
        "headers_log",
        """SELECT req_id, coalesce(nullif(cf_connecting_ip, ''), CASE WHEN strpos(x_forwarded_for, ',') > 1
    THEN split_part(x_forwarded_for, ',', 1) ELSE nullif(x_forwarded_for, '') END, nullif(x_real_ip, ''), remote_addr) AS client_ip FROM headers_log""",
    ),
}

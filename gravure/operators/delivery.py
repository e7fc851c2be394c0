"""Delivery decisions as columns over the response log: caching, validators, names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravure.functions.http import http_date, http_date_us, unquote_etag
from gravure.functions.text import b64url_decode, b64url_encode
from gravure.plans import dims

SECOND = 1_000_000


@dataclass(frozen=True)
class CacheConfig:
    default_ttl: int = dims.DEFAULT_TTL
    fallback_ttl: int = 0
    passthrough: bool = False
    etag: bool = True
    etag_buster: str = ""
    last_modified: bool = True
    last_modified_buster_us: int | None = None
    canonical: bool = True


def _whole_seconds(us: Column) -> Column:
    """Microseconds as seconds, cut towards zero, never below 0."""
    return F.greatest(F.lit(0), F.floor(us / SECOND)).cast("bigint")


def _public(age: Column) -> Column:
    return F.when(age > 0, F.concat(F.lit("max-age="), age.cast("string"), F.lit(", public")))


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def effective_max_age(log: DataFrame, cfg: CacheConfig) -> DataFrame:
    """max_age after the fallback image's TTL and the request's expiry; NULL while unset."""
    base = F.lit(None).cast("bigint")
    if cfg.fallback_ttl > 0:
        base = F.when(F.col("is_fallback"), F.lit(cfg.fallback_ttl)).cast("bigint")
    df = log.withColumn("max_age", base)
    until = F.col("expires_s") * SECOND - F.col("now_us")
    sooner = F.col("max_age").isNull() | (until < F.col("max_age") * SECOND)
    return df.withColumn(
        "max_age",
        F.when(F.col("expires_s").isNotNull() & sooner, F.least(F.lit(cfg.default_ttl), _whole_seconds(until)))
        .otherwise(F.col("max_age"))
        .cast("bigint"),
    )


def cache_control(log: DataFrame, cfg: CacheConfig) -> DataFrame:
    """Cache-Control of the response (after effective_max_age); NULL where none is set."""
    own = _public(F.col("max_age"))
    origin = F.lit(None).cast("string")
    if cfg.passthrough:
        left = _whole_seconds(http_date_us(F.col("origin_expires")) - F.col("now_us"))
        aged = F.when(_given("origin_expires").isNotNull(), _public(left))
        origin = F.coalesce(_given("origin_cache_control"), aged)
    default = f"max-age={cfg.default_ttl}, public" if cfg.default_ttl > 0 else "no-cache"
    return log.withColumn(
        "cache_control",
        F.when(own.isNotNull(), own).when(F.col("status") < 400, F.coalesce(origin, F.lit(default))),
    )


def etag_out(log: DataFrame, cfg: CacheConfig) -> DataFrame:
    """ETag for the client; with a buster the origin's value is wrapped."""
    value = _given("etag")
    if cfg.etag_buster:
        wrapped = b64url_encode(F.encode(value, "UTF-8"))
        value = F.when(value.isNotNull(), F.concat(F.lit(f'"{cfg.etag_buster}/'), wrapped, F.lit('"')))
    return log.withColumn("etag_out", value if cfg.etag else F.lit(None).cast("string"))


def conditional_in(log: DataFrame, cfg: CacheConfig) -> DataFrame:
    """send_inm and send_ims: validators forwarded to the origin."""
    none = F.lit(None).cast("string")
    inm, ims = _given("if_none_match"), _given("if_modified_since")
    abort = F.lit(False)
    if not cfg.etag:
        inm = none
    elif cfg.etag_buster:
        start = f"{cfg.etag_buster}/"
        bare = unquote_etag(inm)
        own = F.when(bare.startswith(start), b64url_decode(F.substr(bare, F.lit(len(start) + 1))))
        abort = inm.isNotNull() & own.isNull()
        inm = own.cast("string")
    if not cfg.last_modified:
        ims = none
    elif cfg.last_modified_buster_us is not None:
        ims = F.when(http_date_us(ims) > cfg.last_modified_buster_us, ims)
    return log.withColumns({"send_inm": F.when(~abort, inm), "send_ims": F.when(~abort, ims)})


def last_modified_out(log: DataFrame, cfg: CacheConfig) -> DataFrame:
    """Last-Modified for the client, never older than the buster."""
    if not cfg.last_modified:
        return log.withColumn("last_modified_out", F.lit(None).cast("string"))
    stamp = http_date_us(_given("last_modified"))
    value = F.when(stamp.isNotNull(), F.col("last_modified"))
    if cfg.last_modified_buster_us is not None:
        buster = F.lit(cfg.last_modified_buster_us).cast("bigint")
        value = F.when(stamp < buster, http_date(buster)).otherwise(value)
    return log.withColumn("last_modified_out", value)


def not_modified(log: DataFrame) -> DataFrame:
    """Whether the client's copy is current: ETags decide where both exist, dates otherwise."""
    tags = _given("etag").isNotNull() & _given("if_none_match").isNotNull()
    same = unquote_etag(F.col("etag")) == unquote_etag(F.col("if_none_match"))
    older = http_date_us(_given("last_modified")) <= http_date_us(_given("if_modified_since"))
    return log.withColumn("not_modified", F.when(tags, same).otherwise(F.coalesce(older, F.lit(False))))


def content_disposition(df: DataFrame) -> DataFrame:
    """Header from url, filename, ext, content_type, attachment."""
    name = F.regexp_extract("url", "[^/]*$", 0)
    url_ext = F.regexp_extract(name, r"\.[^.]*$", 0)
    stem = F.left(name, F.length(name) - F.length(url_ext))
    by_type = F.lit("")
    for row in dims.IMAGE_TYPES:
        by_type = F.when(F.col("content_type") == row[2], F.lit(row[1])).otherwise(by_type)
    ext = F.coalesce(_given("ext"), F.nullif(url_ext, F.lit("")), by_type)
    stem = F.coalesce(_given("filename"), F.nullif(stem, F.lit("")), F.lit("image"))
    kind = F.when(F.col("attachment"), "attachment").otherwise("inline")
    quoted = F.replace(stem, F.lit('"'), F.lit("%22"))
    return df.withColumn(
        "content_disposition", F.concat(kind, F.lit('; filename="'), quoted, ext, F.lit('"'))
    )


def canonical_link(df: DataFrame, url: str = "source_url") -> DataFrame:
    web = F.col(url).startswith("http://") | F.col(url).startswith("https://")
    return df.withColumn("link", F.when(web, F.concat(F.lit("<"), F.col(url), F.lit('>; rel="canonical"'))))


def header_passthrough(headers: Column, only: list[str]) -> Column:
    """The listed headers of a header map; names are compared without case."""
    return F.map_filter(headers, lambda k, _: F.lower(k).isin(*(name.lower() for name in only)))


def header_merge(first: Column, second: Column) -> Column:
    """Both maps; where both have a header, the first one's value stays."""
    return F.map_concat(first, F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k)))


def client_ip(df: DataFrame) -> DataFrame:
    """Address of the client behind proxies."""
    forwarded = _given("x_forwarded_for")
    first = F.when(F.instr(forwarded, ",") > 1, F.substring_index(forwarded, ",", 1)).otherwise(forwarded)
    return df.withColumn(
        "client_ip", F.coalesce(_given("cf_connecting_ip"), first, _given("x_real_ip"), F.col("remote_addr"))
    )

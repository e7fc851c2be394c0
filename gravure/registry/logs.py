"""Queries J and M: request-log and load-profile analytics, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.operators import logs
from gravure.plans import requests
from gravure.registry.fixtures import table, with_tables
from gravure.registry.requests import _ALIASES, tokens_sql


def _log(spark, sf):
    return table(spark, sf, "request_log")


def _samples(spark, sf):
    return _log(spark, sf).select(
        F.col("format").alias("group"), (F.col("duration_us") / 1000.0).alias("duration_ms"),
        F.col("result_bytes").alias("body_bytes"), "req_id",
    )


def _j10(spark, sf):
    df = requests.tokenize_options(table(spark, sf, "option_paths"))
    day = F.floor(F.col("ts_us") / logs.DAY)
    options = df.select(day.alias("day"), F.explode("options").alias("o")).select(
        "day", F.coalesce("o.name", "o.given_name").alias("name")
    )
    return logs.option_usage(options)


def _m03(spark, sf):
    samples = _samples(spark, sf)
    before = samples.filter((F.col("req_id") % 2 == 0) & (F.col("group") != "gif"))
    after = samples.filter((F.col("req_id") % 2 == 1) & (F.col("group") != "png"))
    return logs.run_compare(logs.group_trends(before), logs.group_trends(after))


QUERIES = {
    "j01_log_level": lambda spark, sf: logs.log_level(_log(spark, sf)).select("req_id", "level"),
    "j02_requests_total": lambda spark, sf: logs.requests_total(_log(spark, sf)),
    "j03_status_codes_total": lambda spark, sf: logs.status_codes_total(_log(spark, sf)),
    "j04_errors_total": lambda spark, sf: logs.errors_total(_log(spark, sf), 4_000_000),
    "j05_duration_histogram": lambda spark, sf: logs.duration_histogram(_log(spark, sf)),
    "j06_span_histogram": lambda spark, sf: logs.span_histogram(table(spark, sf, "span_log")),
    "j07_in_progress": lambda spark, sf: logs.in_progress(_log(spark, sf)),
    "j08_utilisation": lambda spark, sf: logs.utilisation(logs.in_progress(_log(spark, sf)), 16)
    .groupBy(F.floor(F.col("ts_us") / logs.DAY).alias("day"))
    .agg(F.max("pct").alias("peak_pct")),
    "j09_by_origin": lambda spark, sf: logs.by_origin(_log(spark, sf)),
    "j10_option_usage": _j10,
    "j11_byte_savings": lambda spark, sf: logs.byte_savings(_log(spark, sf)),
    "m01_traffic_mix": lambda spark, sf: logs.traffic_mix(
        table(spark, sf, "load_urls").withColumnRenamed("grp", "group"),
        _log(spark, sf).withColumnRenamed("format", "group"),
    ),
    "m02_group_trends": lambda spark, sf: logs.group_trends(_samples(spark, sf)),
    "m03_run_compare": _m03,
}

_LE = "[0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]"
_BOUNDS = f"""bd AS (SELECT CAST(b AS DOUBLE) AS b, CAST(CAST(b AS DOUBLE) AS VARCHAR) AS le FROM (SELECT unnest({_LE}) AS b)
  UNION ALL SELECT CAST('Infinity' AS DOUBLE), '+Inf')"""
_FLIGHT = """ch AS (SELECT start_us AS t, 1 AS d FROM request_log UNION ALL SELECT start_us + duration_us, -1 FROM request_log),
fl AS (SELECT t AS ts_us, CAST(sum(sum(d)) OVER (ORDER BY t) AS BIGINT) AS n FROM ch GROUP BY t)"""


def _trend_sql(v, name):
    r = lambda e: f"round(CAST({e} AS DOUBLE), 6)"
    return f"""count(*) AS {name}_samples, {r(f"sum({v}) / count(*)")} AS {name}_avg, {r(f"min({v})")} AS {name}_min,
  {r(f"quantile_cont({v}, 0.5)")} AS {name}_med, {r(f"max({v})")} AS {name}_max, {r(f"quantile_cont({v}, 0.9)")} AS {name}_p90,
  {r(f"quantile_cont({v}, 0.95)")} AS {name}_p95"""


_SAMPLE = """sm AS (SELECT req_id, format AS grp, duration_us / 1000.0e0 AS ms, floor(result_bytes / 10.24e0 + 0.5e0) / 100.0e0 AS kib FROM request_log)"""

ORACLES = {
    "j01_log_level": with_tables(
        "request_log",
        """SELECT req_id, CASE WHEN status >= 500 OR error_status >= 500 THEN 'error' WHEN status >= 400 OR error_status >= 400 THEN 'warn'
  ELSE 'info' END AS level FROM request_log""",
    ),
    "j02_requests_total": "SELECT count(*) AS n FROM events",
    "j03_status_codes_total": with_tables("request_log", "SELECT status, count(*) AS n FROM request_log GROUP BY status"),
    "j04_errors_total": with_tables(
        "request_log",
        """SELECT CASE WHEN duration_us >= 4000000 THEN 'timeout' ELSE error_category END AS category, count(*) AS n FROM request_log
WHERE duration_us >= 4000000 OR error_category IS NOT NULL GROUP BY 1""",
    ),
    "j05_duration_histogram": with_tables(
        "request_log",
        f"""{_BOUNDS}
SELECT le, count(*) FILTER (WHERE duration_us / 1000000.0e0 <= b) AS n, CAST(sum(duration_us) AS BIGINT) AS sum_us
FROM request_log CROSS JOIN bd GROUP BY le""",
    ),
    "j06_span_histogram": with_tables(
        "span_log",
        f"""{_BOUNDS}
SELECT replace(lower(span), ' ', '_') AS span, le, count(*) FILTER (WHERE duration_us / 1000000.0e0 <= b) AS n,
  CAST(sum(duration_us) AS BIGINT) AS sum_us FROM span_log CROSS JOIN bd GROUP BY 1, 2""",
    ),
    "j07_in_progress": with_tables("request_log", _FLIGHT + "\nSELECT ts_us, n FROM fl"),
    "j08_utilisation": with_tables(
        "request_log",
        _FLIGHT + "\nSELECT ts_us // 86400000000 AS day, max(n / 16.0e0 * 100.0e0) AS peak_pct FROM fl GROUP BY 1",
    ),
    "j09_by_origin": with_tables(
        "request_log",
        "SELECT 'http://' || split_part(split_part(source_url, '://', 2), '/', 1) AS origin, count(*) AS n FROM request_log GROUP BY 1",
    ),
    "j10_option_usage": with_tables(
        "option_paths",
        f"""{_ALIASES},{tokens_sql("option_paths")}
SELECT ts_us // 86400000000 AS day, coalesce(canon, given) AS name, count(*) AS n FROM ro GROUP BY ROLLUP (1, 2)""",
    ),
    "j11_byte_savings": with_tables(
        "request_log",
        """SELECT format, CAST(sum(origin_bytes) AS BIGINT) AS origin_bytes, CAST(sum(result_bytes) AS BIGINT) AS result_bytes,
  CAST(sum(result_bytes) AS DOUBLE) / CAST(sum(origin_bytes) AS DOUBLE) AS ratio FROM request_log GROUP BY format""",
    ),
    "m01_traffic_mix": with_tables(
        "load_urls request_log",
        """e AS (SELECT grp, sum(coalesce(nullif(weight, 0), 1)) AS w FROM load_urls GROUP BY 1),
o AS (SELECT format AS grp, count(*) AS n FROM request_log GROUP BY 1)
SELECT coalesce(e.grp, o.grp) AS "group", CAST(w AS DOUBLE) / (SELECT CAST(sum(w) AS DOUBLE) FROM e) AS expected,
  CAST(n AS DOUBLE) / (SELECT CAST(sum(n) AS DOUBLE) FROM o) AS observed FROM e FULL JOIN o ON e.grp = o.grp""",
    ),
    "m02_group_trends": with_tables(
        "request_log",
        f"""{_SAMPLE}
SELECT grp AS "group", {_trend_sql("ms", "duration")}, {_trend_sql("kib", "body")} FROM sm GROUP BY grp""",
    ),
    "m03_run_compare": with_tables(
        "request_log",
        f"""{_SAMPLE},
a AS (SELECT grp, {_trend_sql("ms", "d")} FROM sm WHERE req_id % 2 = 0 AND grp <> 'gif' GROUP BY grp),
b AS (SELECT grp, {_trend_sql("ms", "d")} FROM sm WHERE req_id % 2 = 1 AND grp <> 'png' GROUP BY grp)
SELECT coalesce(a.grp, b.grp) AS "group", a.d_avg AS before_avg, a.d_p95 AS before_p95, b.d_avg AS after_avg, b.d_p95 AS after_p95,
  round(b.d_avg - a.d_avg, 6) AS avg_delta FROM a FULL JOIN b ON a.grp = b.grp""",
    ),
}

"""Queries L: streaming jobs run over the whole event log, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravure.registry.fixtures import table
from gravure.registry.requests import PLAN_COLUMNS, _plan_select, _req_sql, presets
from gravure.streaming import jobs

TIMEOUT_S = 4


def _events(spark, sf):
    return jobs.table_stream(spark, f"{sf}/events.parquet")


def _us(c):
    return F.unix_micros(c)


def _log(spark, sf):
    status = F.when(F.col("event_type") != "error", 200).otherwise(F.lit(404) + F.col("event_id") % 3)
    return _events(spark, sf).select(
        "event_id", "ts", status.alias("status"), F.round(F.col("value") * 10000).cast("bigint").alias("duration_us"),
        F.col("user_id").alias("client"),
    )


def _l01(spark, sf):
    events = jobs.table_stream(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    requests = table(spark, sf, "requests", events=events)
    plans = _plan_select(jobs.stream_plan(requests, presets(spark, sf), sources=["http://img*.example.com/"]), "source_url", "option_error")
    return jobs.run_available(plans).drop("filename")


def _l03(spark, sf):
    hourly = jobs.run_available(jobs.stream_metrics(_log(spark, sf), "1 hour"))
    sliding = jobs.run_available(jobs.stream_metrics(_log(spark, sf), "6 hours", "2 hours"))
    both = hourly.withColumn("kind", F.lit("tumbling")).unionByName(sliding.withColumn("kind", F.lit("sliding")))
    return both.select("kind", _us("window_start").alias("start_us"), _us("window_end").alias("end_us"), "status", "n", "sum_us")


def _l04(spark, sf):
    events = _events(spark, sf)
    key = F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", (F.col("event_id") % 50).cast("string")), 256)
    return jobs.run_available(jobs.stream_dedupe(events, key)).select("rendition_key")


def _l05(spark, sf):
    sessions = jobs.run_available(jobs.client_sessions(_log(spark, sf)))
    return sessions.select("client", _us("session_start").alias("start_us"), _us("session_end").alias("end_us"), "n")


def _starts_ends(log):
    starts = log.select(F.col("event_id").alias("req_id"), "ts")
    ended = log.filter(F.col("status") != 406)
    end = F.timestamp_add("MICROSECOND", F.col("duration_us").cast("int"), F.col("ts"))
    return starts, ended.select(F.col("event_id").alias("req_id"), end.alias("end_ts"))


def _l06(spark, sf):
    starts, _ = _starts_ends(_log(spark, sf))
    _, ends = _starts_ends(_log(spark, sf))
    late = jobs.run_available(jobs.unfinished_requests(starts, ends, f"{TIMEOUT_S} seconds"))
    return late.select("req_id", _us("ts").alias("start_us"))


def _l06_batch(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") != "error", 200).otherwise(F.lit(404) + F.col("event_id") % 3)
    log = events.select("event_id", "ts", status.alias("status"), F.round(F.col("value") * 10000).cast("bigint").alias("duration_us"))
    starts, ends = _starts_ends(log)
    late = jobs.unfinished_requests(starts, ends, f"{TIMEOUT_S} seconds")
    return late.select("req_id", _us("ts").alias("start_us"))


QUERIES = {
    "l01_stream_plan": _l01,
    "l02_stream_ingest": lambda spark, sf: jobs.run_available(jobs.stream_ingest(spark, sf, "*.parquet")).select(
        F.regexp_extract("path", "[^/]*$", 0).alias("name"), "length", "type_status"
    ),
    "l03_stream_metrics": _l03,
    "l04_stream_dedupe": _l04,
    "l05_client_sessions": _l05,
    "l06_unfinished_requests": _l06,
    "l06_unfinished_batch": _l06_batch,
}

_LOG = """lg AS (SELECT event_id, user_id AS client, epoch_us(ts) AS t, CASE WHEN event_type <> 'error' THEN 200 ELSE 404 + event_id % 3 END AS status,
  CAST(round(value * 10000) AS BIGINT) AS d FROM events),
wm AS (SELECT (max(t) // 1000) * 1000 - 600000000 AS w FROM lg)"""
_METRIC = """SELECT '{kind}' AS kind, s AS start_us, s + {width} AS end_us, status, count(*) AS n, CAST(sum(d) AS BIGINT) AS sum_us
FROM (SELECT *, unnest([t - t % {slide} - k * {slide} FOR k IN range(0, {width} // {slide})]) AS s FROM lg), wm
WHERE s + {width} <= w GROUP BY s, status"""

ORACLES = {
    "l01_stream_plan": _req_sql(
        f"SELECT req_id, source_url, option_error, {', '.join(c for c in PLAN_COLUMNS if c != 'filename')}, skip_formats, format_quality FROM parsed"
    ),
    "l03_stream_metrics": f"WITH {_LOG}\n{_METRIC.format(kind='tumbling', width=3600000000, slide=3600000000)}\nUNION ALL "
    + _METRIC.format(kind="sliding", width=21600000000, slide=7200000000),
    "l04_stream_dedupe": "SELECT DISTINCT sha256(user_id || '/' || event_type || '/' || event_id % 50) AS rendition_key FROM events",
    "l05_client_sessions": f"""WITH {_LOG},
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY client ORDER BY t) < 1800000000 THEN 0 ELSE 1 END AS b FROM lg),
n AS (SELECT *, sum(b) OVER (PARTITION BY client ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT client, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM n GROUP BY client, k
HAVING max(t) + 1800000000 <= (SELECT w FROM wm)""",
    "l06_unfinished_requests": f"""WITH {_LOG}
SELECT event_id AS req_id, t AS start_us FROM lg WHERE (status = 406 OR d > {TIMEOUT_S}000000) AND t + {TIMEOUT_S}000000 < (SELECT w FROM wm)""",
    "l06_unfinished_batch": f"""WITH {_LOG}
SELECT event_id AS req_id, t AS start_us FROM lg WHERE status = 406 OR d > {TIMEOUT_S}000000""",
}

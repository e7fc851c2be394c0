"""Request-log analytics: log(req_id, start_us, duration_us, status, error_category, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravure.functions.text import segment_name, url_origin

# Default histogram bounds of the metrics client, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
SECOND = 1_000_000
DAY = 86_400 * SECOND


def log_level(log: DataFrame) -> DataFrame:
    worst = F.greatest("status", F.coalesce("error_status", F.lit(0)))
    return log.withColumn("level", F.when(worst >= 500, "error").when(worst >= 400, "warn").otherwise("info"))


def requests_total(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("n"))


def status_codes_total(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def errors_total(log: DataFrame, timeout_us: int = 10 * SECOND) -> DataFrame:
    """Errors per category; a timeout overrides any other category."""
    late = F.col("duration_us") >= timeout_us
    category = F.when(late, "timeout").otherwise(F.col("error_category"))
    return (
        log.withColumn("category", category)
        .filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _histogram(log: DataFrame, keys: list[str]) -> DataFrame:
    """One pass: a counter per bound, then one row per bound. No join of bounds to rows."""
    seconds = F.col("duration_us") / F.lit(float(SECOND))
    counters = [F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)]
    wide = log.groupBy(*keys).agg(*counters, F.count(F.lit(1)).alias("total"), F.sum("duration_us").alias("sum_us"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return wide.select(*keys, F.inline(F.array(*cells)), "sum_us")


def duration_histogram(log: DataFrame) -> DataFrame:
    """Cumulative buckets: le, n, sum_us."""
    return _histogram(log, [])


def span_histogram(spans: DataFrame) -> DataFrame:
    """Cumulative buckets per span name."""
    return _histogram(spans.withColumn("span", segment_name(F.col("span"))), ["span"])


def in_progress(log: DataFrame) -> DataFrame:
    """Requests in flight after each instant at which one starts or ends: ts_us, n.

    Running sum in three levels. Changes are first added up per instant, so a window over
    one second holds at most a million rows whatever the load; carries run over the seconds
    of a day and over days.
    """
    change = log.select(
        F.explode(
            F.array(
                F.struct(F.col("start_us").alias("ts_us"), F.lit(1).alias("d")),
                F.struct((F.col("start_us") + F.col("duration_us")).alias("ts_us"), F.lit(-1).alias("d")),
            )
        ).alias("c")
    ).select("c.*")
    instants = (
        change.groupBy("ts_us")
        .agg(F.sum("d").alias("d"))
        .withColumns({"second": F.floor(F.col("ts_us") / SECOND), "day": F.floor(F.col("ts_us") / DAY)})
    )
    seconds = instants.groupBy("day", "second").agg(F.sum("d").alias("d"))
    days = seconds.groupBy("day").agg(F.sum("d").alias("d"))
    before = lambda w: F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    day_carry = days.select("day", before(Window.orderBy("day")).alias("day_carry"))
    second_carry = seconds.select(
        "day", "second", before(Window.partitionBy("day").orderBy("second")).alias("second_carry")
    )
    running = F.sum("d").over(
        Window.partitionBy("second").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = second_carry.join(day_carry, "day").select("second", (F.col("second_carry") + F.col("day_carry")).alias("carry"))
    return (
        instants.withColumn("run", running)
        .join(carried, "second")
        .select("ts_us", (F.col("run") + F.col("carry")).alias("n"))
    )


def utilisation(in_flight: DataFrame, workers: int) -> DataFrame:
    share = F.col("n") / F.lit(float(workers)) * 100.0 if workers else F.lit(0.0)
    return in_flight.withColumn("pct", share)


def by_origin(log: DataFrame, url: str = "source_url") -> DataFrame:
    return log.groupBy(url_origin(F.col(url)).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


def option_usage(options: DataFrame) -> DataFrame:
    """Uses per (day, option), per day and in all; options(day, name)."""
    return options.rollup("day", "name").agg(F.count(F.lit(1)).alias("n"))


def byte_savings(log: DataFrame) -> DataFrame:
    return (
        log.groupBy("format")
        .agg(F.sum("origin_bytes").alias("origin_bytes"), F.sum("result_bytes").alias("result_bytes"))
        .withColumn("ratio", F.col("result_bytes") / F.col("origin_bytes"))
    )


# --- load profile -----------------------------------------------------------------------


def traffic_mix(urls: DataFrame, log: DataFrame) -> DataFrame:
    """Share of traffic expected from URL weights (none or 0: 1) against the share seen, per group."""
    expected = urls.groupBy("group").agg(F.sum(F.coalesce(F.nullif("weight", F.lit(0)), F.lit(1))).alias("weight"))
    observed = log.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy())
    return expected.select("group", share("weight").alias("expected")).join(
        observed.select("group", share("n").alias("observed")), "group", "full_outer"
    )


def body_kib(size: Column) -> Column:
    return F.floor(size / 10.24 + 0.5) / 100.0


def _trend(samples: DataFrame, value: str, name: str) -> DataFrame:
    """avg, min, median, max, p90, p95 of a value per group.

    Equal values are counted before the percentile, which then holds one entry per distinct
    value (bounded by the request timeout and the clock's resolution), not one per request.
    """
    counted = samples.groupBy("group", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    at = F.percentile("v", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)), F.col("n"))
    stats = counted.groupBy("group").agg(
        F.sum("n").alias("samples"),
        F.sum(F.col("v") * F.col("n")).alias("total"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        at.alias("p"),
    )
    fixed = lambda c: F.round(c.cast("double"), 6)
    return stats.select(
        "group",
        F.col("samples").alias(f"{name}_samples"),
        fixed(F.col("total") / F.col("samples")).alias(f"{name}_avg"),
        fixed(F.col("least")).alias(f"{name}_min"),
        fixed(F.get("p", F.lit(0))).alias(f"{name}_med"),
        fixed(F.col("most")).alias(f"{name}_max"),
        fixed(F.get("p", F.lit(1))).alias(f"{name}_p90"),
        fixed(F.get("p", F.lit(2))).alias(f"{name}_p95"),
    )


def group_trends(samples: DataFrame) -> DataFrame:
    """Duration (ms) and body size (KiB) trends per group; samples(group, duration_ms, body_bytes)."""
    sized = samples.withColumn("kib", body_kib(F.col("body_bytes")))
    return _trend(sized, "duration_ms", "duration").join(_trend(sized, "kib", "body"), "group", "full_outer")


def run_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two trend tables side by side; groups missing on a side are kept."""
    a = before.select("group", F.col("duration_avg").alias("before_avg"), F.col("duration_p95").alias("before_p95"))
    b = after.select("group", F.col("duration_avg").alias("after_avg"), F.col("duration_p95").alias("after_p95"))
    return a.join(b, "group", "full_outer").withColumn(
        "avg_delta", F.round(F.col("after_avg") - F.col("before_avg"), 6)
    )

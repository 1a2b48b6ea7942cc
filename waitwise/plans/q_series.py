"""Catalogue: ingestion-side and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitwise.operators import timeseries as T
from waitwise.plans.duck import with_bindings
from waitwise.plans.registry import register
from waitwise.sources import bindings as B

GRAIN = "hour"
ROLL_MINUTES = 180
TRIPLET_MINUTES = 360
ASOF_TOLERANCE = 30
WINDOW_S, WINDOW_F = "2024-01-08 00:00:00", "2024-01-21 23:59:59"

_A4_SQL = """SELECT date_trunc('hour', ts) AS ts, queryid, count(*) AS calls, sum(cents) // 100 AS nrows,
       count(*) FILTER (WHERE wait_event_type <> 'Timeout') AS waits
FROM wait_samples GROUP BY 1, 2"""


def _a4(spark, sf):
    return T.statement_interval_stats(B.wait_samples(spark, sf), GRAIN)


@register("statement_interval_stats", "A4", with_bindings(_A4_SQL, "wait_samples"))
def q_statement_interval_stats(spark, sf):
    """Per hour and queryid: calls, rows, waits."""
    return _a4(spark, sf)


@register("statement_counter_deltas", "A4", with_bindings(_A4_SQL, "wait_samples"))
def q_statement_counter_deltas(spark, sf):
    """Cumulative counters turned back into interval deltas (lag with reset rule)."""
    cum = T.cumulative_counters(_a4(spark, sf))
    return T.statement_interval_stats(cum, cumulative=True)


_A5_SQL = with_bindings("""
SELECT queryid, '{' || string_agg('"' || wait_event_type || '":' || ev, ',' ORDER BY wait_event_type) || '}' AS wait_stats
FROM (SELECT queryid, wait_event_type,
             '{' || string_agg('"' || wait_event || '":' || CAST(n AS VARCHAR), ',' ORDER BY wait_event) || '}' AS ev
      FROM (SELECT queryid, wait_event_type, wait_event, count(*) AS n FROM wait_samples GROUP BY 1, 2, 3) e
      GROUP BY 1, 2) t
GROUP BY queryid""", "wait_samples")


@register("wait_map_build", "A5", _A5_SQL)
def q_wait_map_build(spark, sf):
    """Nested JSON wait map per queryid."""
    return T.wait_map_build(B.wait_samples(spark, sf))


@register("wait_map_explode", "A6", with_bindings(
    "SELECT queryid, wait_event_type, wait_event, count(*) AS n FROM wait_samples GROUP BY 1, 2, 3",
    "wait_samples"))
def q_wait_map_explode(spark, sf):
    """Round trip: JSON map back to (queryid, type, event, n) rows."""
    return T.wait_map_explode(T.wait_map_build(B.wait_samples(spark, sf)))


@register("query_text_dim", "A7", with_bindings(
    "SELECT queryid, arg_max(query, ts) AS query FROM query_texts GROUP BY queryid", "query_texts"))
def q_query_text_dim(spark, sf):
    """Latest statement text per queryid."""
    return T.query_text_dim(B.query_texts(spark, sf))


_AVAIL = "coalesce(mem_available_kb, mem_free_kb + cached_kb)"
_P_SQL = f"""
SELECT ts, cluster, avail_kb, avail_mb, limit_kb, bg_limit_kb, dirty_kb, dirty_pct, dirty_bg_pct FROM (
SELECT ts, cluster, avail_kb, avail_kb // 1024 AS avail_mb,
       CASE WHEN dirty_bytes > 0 THEN dirty_bytes // 1024 WHEN dirty_ratio > 0 THEN avail_kb * dirty_ratio // 100
            ELSE 0 END AS limit_kb,
       CASE WHEN dirty_bg_bytes > 0 THEN dirty_bg_bytes // 1024
            WHEN dirty_bg_ratio > 0 THEN avail_kb * dirty_bg_ratio // 100 ELSE 0 END AS bg_limit_kb,
       nr_dirty * 4 AS dirty_kb,
       CASE WHEN dirty_bytes > 0 THEN 0
            WHEN dirty_ratio > 0 AND avail_kb * dirty_ratio // 100 > 0
            THEN nr_dirty * 4 * 100 // (avail_kb * dirty_ratio // 100) ELSE 0 END AS dirty_pct,
       CASE WHEN dirty_bg_bytes > 0 THEN 0
            WHEN dirty_bg_ratio > 0 AND avail_kb * dirty_bg_ratio // 100 > 0
            THEN nr_dirty * 4 * 100 // (avail_kb * dirty_bg_ratio // 100) ELSE 0 END AS dirty_bg_pct
FROM (SELECT *, {_AVAIL} AS avail_kb FROM dirty_samples) d) q"""


def _p_sql(cols: str) -> str:
    return with_bindings(f"SELECT {cols} FROM ({_P_SQL}) p", "dirty_samples")


@register("available_memory", "P3", _p_sql("ts, cluster, avail_kb, avail_mb"))
def q_available_memory(spark, sf):
    return T.available_memory(B.dirty_samples(spark, sf)).select("ts", "cluster", "avail_kb", "avail_mb")


@register("dirty_limits", "P1", _p_sql("ts, cluster, limit_kb, bg_limit_kb"))
def q_dirty_limits(spark, sf):
    return T.dirty_limits(B.dirty_samples(spark, sf)).select("ts", "cluster", "limit_kb", "bg_limit_kb")


@register("dirty_percent", "P2", _p_sql("ts, cluster, dirty_kb, dirty_pct, dirty_bg_pct"))
def q_dirty_percent(spark, sf):
    return T.dirty_percent(B.dirty_samples(spark, sf)).select("ts", "cluster", "dirty_kb", "dirty_pct",
                                                                "dirty_bg_pct")


@register("operational_speed", "P4", with_bindings(
    f"SELECT ts, queryid, calls, nrows, calls + nrows AS speed FROM ({_A4_SQL}) a", "wait_samples"))
def q_operational_speed(spark, sf):
    return T.operational_speed(_a4(spark, sf)).select("ts", "queryid", "calls", "nrows", "speed")


_TRIPLET_SQL = f"""
SELECT cluster, ts, speed, waits AS waitings, round(speed_slope, 9) AS speed_slope,
       round(waits_slope, 9) AS waits_slope, round(r, 9) AS r,
       CAST(coalesce(round(speed_slope, 9) < 0 AND round(waits_slope, 9) > 0 AND round(r, 9) < 0, false) AS INTEGER)
         AS indicator
FROM (SELECT cluster, ts, speed, waits,
             CASE WHEN count(*) OVER w > 1 THEN regr_slope(speed, epoch(ts) / 60.0) OVER w END AS speed_slope,
             CASE WHEN count(*) OVER w > 1 THEN regr_slope(waits, epoch(ts) / 60.0) OVER w END AS waits_slope,
             CASE WHEN var_pop(speed) OVER w > 0 AND var_pop(waits) OVER w > 0 THEN corr(speed, waits) OVER w END AS r
      FROM cluster_series
      WINDOW w AS (PARTITION BY cluster ORDER BY ts
                   RANGE BETWEEN INTERVAL {TRIPLET_MINUTES} MINUTE PRECEDING AND CURRENT ROW)) q"""


@register("performance_triplet", "P5", with_bindings(_TRIPLET_SQL, "cluster_series"))
def q_performance_triplet(spark, sf):
    """Speed, waitings and the degradation indicator per cluster-hour."""
    return T.performance_triplet(B.cluster_series(spark, sf, GRAIN), minutes=TRIPLET_MINUTES)


@register("time_window_filter", "P6", with_bindings(
    f"SELECT event_id, ts, cluster, queryid, wait_event_type FROM wait_samples "
    f"WHERE ts >= TIMESTAMP '{WINDOW_S}' AND ts <= TIMESTAMP '{WINDOW_F}'", "wait_samples"))
def q_time_window_filter(spark, sf):
    """Samples inside one report interval [s, f] (the operator's own bounds)."""
    ws = B.wait_samples(spark, sf).select("event_id", "ts", "cluster", "queryid", "wait_event_type")
    return T.time_window_filter(ws, WINDOW_S, WINDOW_F)


@register("align_series", "J3", with_bindings("""
SELECT c.cluster, c.ts, CAST(c.speed AS DOUBLE) AS speed, CAST(c.waits AS DOUBLE) AS waits,
       CAST(v.r AS DOUBLE) AS r, CAST(v.b AS DOUBLE) AS b, CAST(v.us AS DOUBLE) AS us, CAST(v.wa AS DOUBLE) AS wa
FROM cluster_series c FULL JOIN vmstat_series v ON c.cluster = v.cluster AND c.ts = v.ts""",
    "cluster_series", "vmstat_series"))
def q_align_series(spark, sf):
    """Cluster and vmstat series aligned on (cluster, hour) by one pivoting aggregation."""
    c = T.to_long(B.cluster_series(spark, sf, GRAIN), ["cluster"], ["speed", "waits"])
    v = T.to_long(B.vmstat_series(spark, sf, GRAIN), ["cluster"], ["r", "b", "us", "wa"])
    return T.align_series([c, v], ["cluster"], ["speed", "waits", "r", "b", "us", "wa"], GRAIN)


@register("align_series_asof", "J4", with_bindings(f"""
SELECT c.cluster, c.ts, c.speed,
       CASE WHEN d.ts >= c.ts - INTERVAL {ASOF_TOLERANCE} MINUTE THEN d.ts END AS right_ts,
       CASE WHEN d.ts >= c.ts - INTERVAL {ASOF_TOLERANCE} MINUTE THEN d.nr_dirty END AS nr_dirty
FROM cluster_series c ASOF LEFT JOIN dirty_samples d ON c.cluster = d.cluster AND c.ts >= d.ts""",
    "cluster_series", "dirty_samples"))
def q_align_series_asof(spark, sf):
    """Hourly cluster rows with the latest one-second dirty sample at or before them (30 min tolerance)."""
    left = B.cluster_series(spark, sf, GRAIN).select("cluster", "ts", "speed")
    right = B.dirty_samples(spark, sf).select("cluster", "ts", "nr_dirty")
    return T.align_series_asof(left, right, ["cluster"], ["nr_dirty"], ASOF_TOLERANCE)


@register("samples_in_interval", "J9", with_bindings("""
SELECT w.event_id, w.ts, p.pass_counter
FROM wait_samples w JOIN load_passes p ON w.ts >= p.start_ts AND w.ts <= p.finish_ts""",
    "wait_samples", "load_passes"))
def q_samples_in_interval(spark, sf):
    """Each sample with the load-test pass whose [start, finish] contains it (bucketed range join)."""
    ws = B.wait_samples(spark, sf).select("event_id", "ts")
    return T.samples_in_interval(ws, B.load_passes(spark, sf), interval_cols=["pass_counter"]).select(
        "event_id", "ts", "pass_counter")


def _roll_sql(table: str, key: str, metrics: list[str]) -> str:
    return f"""
SELECT {key}, ts, metric, value,
       quantile_cont(value, 0.5) OVER (PARTITION BY {key}, metric ORDER BY ts
           RANGE BETWEEN INTERVAL {ROLL_MINUTES} MINUTE PRECEDING AND CURRENT ROW) AS med
FROM (SELECT {key}, ts, metric, CAST(value AS DOUBLE) AS value
      FROM {table} UNPIVOT (value FOR metric IN ({', '.join(metrics)}))) u"""


@register("rolling_median_cluster", "B1", with_bindings(
    _roll_sql("cluster_series", "cluster", B.CLUSTER_METRICS), "cluster_series"))
def q_rolling_median_cluster(spark, sf):
    long = T.to_long(B.cluster_series(spark, sf, GRAIN), ["cluster"], B.CLUSTER_METRICS)
    return T.rolling_median(long, ["cluster", "metric"], ROLL_MINUTES)


@register("rolling_median_vmstat", "B2", with_bindings(
    _roll_sql("vmstat_series", "cluster", B.VMSTAT_METRICS), "vmstat_series"))
def q_rolling_median_vmstat(spark, sf):
    long = T.to_long(B.vmstat_series(spark, sf, GRAIN), ["cluster"], B.VMSTAT_METRICS)
    return T.rolling_median(long, ["cluster", "metric"], ROLL_MINUTES)


@register("rolling_median_iostat", "B3", with_bindings(
    _roll_sql("iostat_series", "cluster, device", B.IOSTAT_METRICS), "iostat_series"))
def q_rolling_median_iostat(spark, sf):
    long = T.to_long(B.iostat_series(spark, sf, GRAIN), ["cluster", "device"], B.IOSTAT_METRICS)
    return T.rolling_median(long, ["cluster", "device", "metric"], ROLL_MINUTES)


@register("statement_medians", "B4", with_bindings(f"""
SELECT queryid, median(calls) AS calls, median(nrows) AS nrows, median(waits) AS waits
FROM ({_A4_SQL}) a GROUP BY queryid""", "wait_samples"))
def q_statement_medians(spark, sf):
    return T.group_medians(_a4(spark, sf), ["queryid"], ["calls", "nrows", "waits"])


@register("statement_wait_medians", "B5", with_bindings("""
SELECT queryid, wait_event_type, wait_event, median(n) AS waits
FROM (SELECT date_trunc('hour', ts) AS ts, queryid, wait_event_type, wait_event, count(*) AS n
      FROM wait_samples GROUP BY 1, 2, 3, 4) e
GROUP BY 1, 2, 3""", "wait_samples"))
def q_statement_wait_medians(spark, sf):
    ws = B.wait_samples(spark, sf)
    per = ws.groupBy(B.bucket("ts", GRAIN).alias("ts"), "queryid", "wait_event_type", "wait_event").agg(
        F.count(F.lit(1)).alias("waits"))
    return T.group_medians(per, ["queryid", "wait_event_type", "wait_event"], ["waits"])


@register("minute_median_dirty", "B6", with_bindings(f"""
SELECT cluster, date_trunc('minute', ts) AS ts, round(median(dirty_kb), 2) AS dirty_kb,
       round(median(dirty_pct), 2) AS dirty_pct, round(median(dirty_bg_pct), 2) AS dirty_bg_pct,
       round(median(avail_mb), 2) AS avail_mb, count(*) AS n
FROM ({_P_SQL}) p GROUP BY 1, 2""", "dirty_samples"))
def q_minute_median_dirty(spark, sf):
    return T.minute_median_dirty(B.dirty_samples(spark, sf))


@register("bounds_report", "B7", with_bindings(f"""
SELECT cluster, metric, min(value) AS min, median(value) AS median, max(value) AS max, count(value) AS n
FROM (SELECT cluster, ts, metric, CAST(value AS DOUBLE) AS value
      FROM vmstat_series UNPIVOT (value FOR metric IN ({', '.join(B.VMSTAT_METRICS)}))) u
GROUP BY 1, 2""", "vmstat_series"))
def q_bounds_report(spark, sf):
    long = T.to_long(B.vmstat_series(spark, sf, GRAIN), ["cluster"], B.VMSTAT_METRICS)
    return T.bounds_report(long, ["cluster"])

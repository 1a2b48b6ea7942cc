"""Catalogue: band labels, settings, kernel parameters, retention, collector text."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitwise.functions.bands import CORRELATION_BANDS, band_label, band_sql
from waitwise.operators import stats
from waitwise.plans.duck import with_bindings
from waitwise.plans.q_stats import VM_PAIRS, _pairs_sql
from waitwise.plans.registry import register
from waitwise.sources import bindings as B
from waitwise.sources import ostext, sinks

EXCLUDED_SETTINGS = ["free_mb"]
RETAIN_DAYS = 7


@register("band_label", "P8", with_bindings(
    f"SELECT cluster, x, y, r, {band_sql('abs(round(r, 9))', CORRELATION_BANDS)} AS strength "
    f"FROM ({_pairs_sql('vmstat_series', 'cluster', VM_PAIRS)}) p", "vmstat_series"))
def q_band_label(spark, sf):
    """Correlation strength band of every vmstat pair (generic half-open band mapping)."""
    c = stats.correlation(B.vmstat_series(spark, sf, "hour"), ["cluster"], VM_PAIRS)
    return c.select("cluster", "x", "y", "r", band_label(F.abs(F.round("r", 9)), CORRELATION_BANDS).alias("strength"))


@register("settings_snapshot_filter", "P9", with_bindings(
    "SELECT host, name, setting FROM settings WHERE NOT pending_restart AND name NOT IN ("
    + ", ".join(f"'{n}'" for n in EXCLUDED_SETTINGS) + ")", "settings"))
def q_settings_snapshot_filter(spark, sf):
    """Settings of every host without pending-restart rows and excluded names."""
    return sinks.settings_snapshot_filter(B.settings(spark, sf), EXCLUDED_SETTINGS)


@register("kernel_params_unpivot", "P10", with_bindings("""
SELECT test_id, pass_counter, name, value FROM kernel_params
UNPIVOT (value FOR name IN (vm_dirty_ratio, vm_dirty_background_ratio, vm_swappiness, vm_dirty_expire_centisecs))""",
    "kernel_params"))
def q_kernel_params_unpivot(spark, sf):
    """Per-pass vm.* kernel parameters as (name, value) rows."""
    return sinks.kernel_params_unpivot(B.kernel_params(spark, sf))


@register("retain_recent", "A14", with_bindings(
    f"SELECT event_id, ts, cluster, queryid FROM wait_samples "
    f"WHERE ts >= (SELECT max(ts) FROM wait_samples) - INTERVAL {RETAIN_DAYS} DAY", "wait_samples"))
def q_retain_recent(spark, sf):
    """Samples inside the retention depth (7 days back from the newest sample)."""
    ws = B.wait_samples(spark, sf).select("event_id", "ts", "cluster", "queryid")
    return sinks.retain_recent(ws, RETAIN_DAYS)


_VM = ", ".join(f"CAST({e} AS BIGINT) AS \"{c}\"" for c, e in zip(ostext.VMSTAT_COLS, (
    "user_id % 7", "user_id % 3", "0", "event_id % 50000", "user_id", "event_id % 9999", "user_id % 2", "user_id % 4", "cents // 100",
    "cents % 100", "user_id * 10", "event_id % 100000", "user_id % 60", "user_id % 30", "100 - user_id % 60 - user_id % 30", "user_id % 5", "0")))


@register("read_vmstat", "A1", with_bindings(f"""
SELECT date_trunc('second', ts) AS ts, {_VM}, cents + 0.25::DOUBLE AS dirty_kb, user_id % 100 + 0.5::DOUBLE AS dirty_pct,
       CAST(user_id % 50 AS DOUBLE) AS dirty_bg_pct, event_id % 16000 + 0.75::DOUBLE AS avail_mb
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) e"""))
def q_read_vmstat(spark, sf):
    """vmstat samples parsed from collector lines of two versions, headers among them."""
    return ostext.parse_vmstat(ostext.vmstat_lines(spark, sf))


@register("read_iostat", "A2", with_bindings("""
SELECT 'iostat-' || strftime(ts, '%Y-%m-%d') || '.log' AS file, block, date_trunc('second', ts) AS ts, 'dev' || CAST(k AS VARCHAR) AS device, metric, m.value AS value
FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS block FROM events) e
CROSS JOIN range(0, 2) d(k)
CROSS JOIN LATERAL (VALUES ('r/s', event_id % 500 + k + 0.5::DOUBLE), ('w/s', CAST(user_id % 90 AS DOUBLE)), ('%util', CAST(user_id % 100 AS DOUBLE)),
                   ('rkB/s', CASE WHEN user_id % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) + 0.25::DOUBLE END)) m(metric, value)
WHERE m.value IS NOT NULL"""))
def q_read_iostat(spark, sf):
    """Device blocks of iostat reports, columns by the header of each block, numbered within their file."""
    io = ostext.parse_iostat(ostext.iostat_lines(spark, sf))
    return io.select("file", "block", "ts", "device", F.explode("metrics").alias("metric", "value"))


@register("read_dirty_samples", "A3", with_bindings("""
SELECT date_trunc('second', ts) AS ts, CAST(round(value * 100) AS BIGINT) AS dirty_kb, user_id % 100 AS dirty_pct, user_id % 50 AS dirty_bg_pct,
       event_id % 16000 AS avail_mb FROM events"""))
def q_read_dirty_samples(spark, sf):
    """One-second dirty-page samples parsed from collector lines."""
    return ostext.parse_dirty_samples(ostext.dirty_lines(spark, sf))

"""Catalogue: diagnostics and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitwise.functions.bands import R2_BANDS, band_sql
from waitwise.operators import diagnostics as G
from waitwise.operators import logs as L
from waitwise.operators import stats
from waitwise.operators import timeseries as T
from waitwise.plans.duck import with_bindings
from waitwise.plans.q_series import TRIPLET_MINUTES, _TRIPLET_SQL
from waitwise.plans.q_stats import _D1_SELECT, _WAIT_LONG_SQL, _pairs_sql
from waitwise.plans.registry import register
from waitwise.session import cut_lineage
from waitwise.sources import bindings as B
from waitwise.sources import serverlog as S

GRAIN = "hour"
CORES = 8
WINDOW_MINUTES = 180


def _incidents(spark, sf, cs=None):
    cs = cs if cs is not None else B.cluster_series(spark, sf, GRAIN)
    tri = T.performance_triplet(cs, minutes=TRIPLET_MINUTES)
    return G.incident_intervals(tri)


_INC_CTES = {
    "tri": _TRIPLET_SQL,
    "tri2": ("SELECT *, lag(indicator) OVER (PARTITION BY cluster ORDER BY ts) AS prev, "
             "lag(ts) OVER (PARTITION BY cluster ORDER BY ts) AS prev_ts FROM tri"),
    "isl": ("SELECT *, sum(CASE WHEN indicator = 1 AND (coalesce(prev, 0) <> 1 "
            "OR ts > prev_ts + INTERVAL 60 MINUTE) THEN 1 ELSE 0 END) "
            "OVER (PARTITION BY cluster ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM tri2"),
    "incidents": """SELECT cluster, cluster || '@' || strftime(min(ts), '%Y-%m-%d %H:%M') AS incident_id,
       CASE WHEN max(abs(r)) >= 0.75 THEN 4 WHEN max(abs(r)) >= 0.5 THEN 3 WHEN max(abs(r)) >= 0.25 THEN 2 ELSE 1 END
         AS priority, min(ts) AS s, max(ts) + INTERVAL 60 MINUTE AS f, count(*) AS n
FROM isl WHERE indicator = 1 GROUP BY cluster, island""",
}


def _inc_sql(select: str, *names: str, extra: dict | None = None) -> str:
    return with_bindings(select, "cluster_series", *names, extra={**_INC_CTES, **(extra or {})})


@register("incident_intervals", "G6", _inc_sql("SELECT * FROM incidents"))
def q_incident_intervals(spark, sf):
    """Incidents = islands of consecutive degraded hours, with priority."""
    return _incidents(spark, sf)


_WIN_SQL = f"""SELECT cluster, incident_id, 'incident' AS interval, s - INTERVAL {WINDOW_MINUTES} MINUTE AS s, s AS f
FROM incidents UNION ALL
SELECT cluster, incident_id, 'baseline', s - INTERVAL {2 * WINDOW_MINUTES} MINUTE, s - INTERVAL {WINDOW_MINUTES} MINUTE
FROM incidents"""


@register("incident_windows", "P7", _inc_sql(f"SELECT * FROM ({_WIN_SQL}) w"))
def q_incident_windows(spark, sf):
    """Incident window [T-3h, T] and baseline [T-6h, T-3h] for every incident."""
    return T.incident_windows(_incidents(spark, sf), WINDOW_MINUTES)


@register("interval_compare", "C16", _inc_sql(f"""
SELECT w.cluster, w.incident_id, l.metric,
       quantile_cont(l.value, 0.5) FILTER (WHERE w.interval = 'baseline') AS med_base,
       quantile_cont(l.value, 0.5) FILTER (WHERE w.interval = 'incident') AS med_incident,
       med_incident - med_base AS diff,
       CASE WHEN med_base <> 0 THEN (med_incident - med_base) / med_base * 100 END AS pct
FROM ({_WIN_SQL}) w
JOIN (SELECT cluster, ts, metric, CAST(value AS DOUBLE) AS value
      FROM cluster_series UNPIVOT (value FOR metric IN ({', '.join(B.CLUSTER_METRICS)}))) l
  ON l.cluster = w.cluster AND l.ts >= w.s AND l.ts <= w.f
GROUP BY 1, 2, 3"""))
def q_interval_compare(spark, sf):
    """Per incident and metric: baseline vs incident medians, absolute and relative change."""
    # read whole in one branch and for the incidents in another: aggregated once and stored (a row a cluster and hour)
    cs = cut_lineage(B.cluster_series(spark, sf, GRAIN))
    win = T.incident_windows(_incidents(spark, sf, cs), WINDOW_MINUTES)
    long = T.to_long(cs, ["cluster"], B.CLUSTER_METRICS)
    return G.interval_compare(long, win)


@register("last_incident_time", "G7", _inc_sql("""
SELECT cluster, ts, last_finish, CAST((epoch(ts) - epoch(last_finish)) / 60 AS BIGINT) AS age_min
FROM (SELECT c.cluster, c.ts, (SELECT max(i.f) FROM incidents i WHERE i.cluster = c.cluster AND i.f <= c.ts)
             AS last_finish FROM cluster_series c) q"""))
def q_last_incident_time(spark, sf):
    """Time since the last finished incident for every cluster-hour."""
    cs = B.cluster_series(spark, sf, GRAIN)          # the second reader needs the keys only
    return G.last_incident_time(cs, _incidents(spark, sf, cs))


@register("incident_count_24h", "B10", _inc_sql("""
SELECT cluster, incident_id, s, count(*) OVER (PARTITION BY cluster ORDER BY s
    RANGE BETWEEN INTERVAL '86399 seconds' PRECEDING AND CURRENT ROW) AS n_24h
FROM incidents"""))
def q_incident_count_24h(spark, sf):
    """Incidents started within the 24 hours up to each incident (rolling count)."""
    return G.incident_count_24h(_incidents(spark, sf))


_G1_SQL = f"""SELECT cluster, ts, cs / {CORES}.0 AS cs_per_core, us, sy, wa FROM vmstat_series
WHERE cs / {CORES}.0 > 50000 AND us + sy < 50 AND wa < 5"""


@register("contention_suspects", "G1", with_bindings(_G1_SQL, "vmstat_series"))
def q_contention_suspects(spark, sf):
    """Hours with heavy context switching per core while CPU is mostly idle and not waiting on IO."""
    return G.contention_suspects(B.vmstat_series(spark, sf, GRAIN), CORES)


@register("contention_correlation", "G2", with_bindings(f"""
SELECT cluster, r_cs_sy, r_cs_us, coalesce(abs(round(r_cs_sy, 9)) >= 0.7 AND abs(round(r_cs_us, 9)) < 0.3, false)
  AS suspect
FROM (SELECT cluster, max(r) FILTER (WHERE x = 'sy' AND y = 'cs') AS r_cs_sy,
             max(r) FILTER (WHERE x = 'us' AND y = 'cs') AS r_cs_us
      FROM ({_pairs_sql('vmstat_series', 'cluster', [('sy', 'cs'), ('us', 'cs')])}) p GROUP BY cluster) q""",
    "vmstat_series"))
def q_contention_correlation(spark, sf):
    """Strong r(cs, sy) with weak r(cs, us) marks lock/scheduler contention."""
    c = stats.correlation(B.vmstat_series(spark, sf, GRAIN), ["cluster"], [("sy", "cs"), ("us", "cs")])
    return G.contention_correlation(c)


_TREND_CTE = {"tt": "SELECT *, (epoch(ts) - min(epoch(ts)) OVER (PARTITION BY cluster)) / 60.0 AS t FROM resource_series"}


def _leak_sql() -> str:
    parts = []
    for m in B.RESOURCE_METRICS:
        parts.append(f"""SELECT cluster, '{m}' AS metric,
  CASE WHEN var_pop(t) > 0 THEN regr_slope({m}, t) END AS slope,
  pow(CASE WHEN var_pop(t) > 0 AND var_pop({m}) > 0 THEN corr(t, {m}) END, 2) AS r2,
  CAST(arg_max({m}, ts) AS DOUBLE) AS last, CAST(max({m}) AS DOUBLE) AS peak
FROM tt GROUP BY cluster""")
    return "\nUNION ALL ".join(parts)


_G3_SQL = f"""SELECT *, coalesce(round(slope, 9) > 0 AND round(r2, 9) >= 0.6 AND last >= peak, false) AS suspect
FROM ({_leak_sql()}) l"""


def _g3(spark, sf):
    res = B.resource_series(spark, sf, GRAIN)
    return G.leak_suspects(T.to_long(res, ["cluster"], B.RESOURCE_METRICS), stats.trend_line(res, ["cluster"], B.RESOURCE_METRICS))


@register("leak_suspects", "G3", with_bindings(_G3_SQL, "resource_series", extra=_TREND_CTE))
def q_leak_suspects(spark, sf):
    """Backends, temporary bytes, resident memory and prepared transactions that rise steadily without returning."""
    return _g3(spark, sf)


_TEMP_MEAN_SQL = f"""(SELECT coalesce(sum(CAST(nullif(regexp_extract(line, '{L.TEMP_SIZE}', 2), '') AS BIGINT)), 0)
         / 1048576.0 / count(*) FROM log_lines WHERE regexp_matches(line, '{L.TEMP_MARK}'))"""
_G4_SQL = f"""
SELECT host, rule, value, label FROM (
  SELECT host, 'random_page_cost_on_ssd' AS rule, random_page_cost AS value,
         'lower random_page_cost on SSD storage' AS label
  FROM sw WHERE random_page_cost > 2.0 AND is_ssd = 1.0
  UNION ALL SELECT host, 'effective_cache_size_low', effective_cache_size_mb,
         'effective_cache_size below free memory + shared_buffers'
  FROM sw WHERE effective_cache_size_mb < free_mb + shared_buffers_mb
  UNION ALL SELECT host, 'autovacuum_default_scale', autovacuum_vacuum_scale_factor,
         'default autovacuum scale factor on large tables'
  FROM sw WHERE autovacuum_vacuum_scale_factor >= 0.2
    AND EXISTS (SELECT 1 FROM host_tables h WHERE h.host = sw.host AND h.size_mb >= {G.LARGE_TABLE_MB})
  UNION ALL SELECT host, 'work_mem_below_temp_files', work_mem_mb, 'work_mem far below the mean temporary file size'
  FROM sw WHERE work_mem_mb * 4 < {_TEMP_MEAN_SQL}) a"""
_W_CTE = {"sw": "SELECT host, " + ", ".join(f"max(setting) FILTER (WHERE name = '{n}') AS {n}" for n in G.SETTING_NAMES)
                + " FROM settings GROUP BY host"}


def _g4(spark, sf):
    tmp = S.log_lines(spark, sf).filter(F.col("line").rlike(L.TEMP_MARK))
    size = F.nullif(F.regexp_extract("line", L.TEMP_SIZE, 2), F.lit("")).cast("bigint")
    mean_mb = tmp.select(F.coalesce(F.sum(size), F.lit(0)) / F.lit(1048576.0) / F.count(F.lit(1))).scalar()
    return G.settings_audit(B.settings(spark, sf), mean_mb, B.host_tables(spark, sf))


@register("settings_audit", "G4", with_bindings(_G4_SQL, "settings", "log_lines", "host_tables", extra=_W_CTE))
def q_settings_audit(spark, sf):
    """Fleet settings audit: SSD page cost, cache size, autovacuum defaults, work_mem vs temp files."""
    return _g4(spark, sf)


# ---------------------------------------------------------------- risk block
def _findings_g1(spark, sf):
    g1 = G.contention_suspects(B.vmstat_series(spark, sf, GRAIN), CORES)
    return g1.select(F.lit("cpu").alias("category"), F.col("cluster").alias("subject"),
                     F.concat(F.lit("context-switch contention at "), F.date_format("ts", "yyyy-MM-dd HH:mm"))
                     .alias("finding"), F.lit("medium").alias("label"))


def _findings_g3(spark, sf):
    g3 = _g3(spark, sf).filter("suspect")
    return g3.select(F.lit("leak").alias("category"), F.concat_ws(":", "cluster", "metric").alias("subject"),
                     F.lit("rising without return").alias("finding"), G.r2_label("r2").alias("label"))


def _findings_g4(spark, sf):
    return _g4(spark, sf).select(F.lit("settings").alias("category"),
                                 F.concat(F.lit("host "), F.col("host").cast("string")).alias("subject"),
                                 F.col("rule").alias("finding"), F.lit("high").alias("label"))


def _findings_waits(spark, sf):
    k = stats.wait_analysis_3stage(B.cluster_series(spark, sf, GRAIN), ["cluster"], B.WAIT_TYPES).filter("kept")
    return k.select(F.lit("waits").alias("category"), F.concat_ws(":", "cluster", "wait_event_type").alias("subject"),
                    F.concat(F.lit("weight "), F.col("weight_band")).alias("finding"), F.col("r2_band").alias("label"))


_F_G1 = (f"SELECT 'cpu' AS category, cluster AS subject, 'context-switch contention at ' || strftime(ts, '%Y-%m-%d %H:%M') "
         f"AS finding, 'medium' AS label FROM ({_G1_SQL}) g1")
_F_G3 = (f"SELECT 'leak' AS category, cluster || ':' || metric AS subject, 'rising without return' AS finding, "
         f"{band_sql('round(r2, 9)', R2_BANDS)} AS label FROM ({_G3_SQL}) g3 WHERE suspect")
_F_G4 = f"SELECT 'settings' AS category, 'host ' || CAST(host AS VARCHAR) AS subject, rule AS finding, 'high' AS label FROM ({_G4_SQL}) g4"


@register("risk_union", "B13", with_bindings(f"{_F_G1} UNION ALL {_F_G4}", "vmstat_series", "settings", "log_lines",
                                             "host_tables", extra=_W_CTE))
def q_risk_union(spark, sf):
    """Union of CPU-contention and settings findings with category and confidence label."""
    return G.risk_union(_findings_g1(spark, sf), _findings_g4(spark, sf))


def _risk_block_sql() -> str:
    waits = (f"SELECT 'waits' AS category, cluster || ':' || wait_event_type AS subject, 'weight ' || weight_band "
             f"AS finding, r2_band AS label FROM ({_D1_SELECT}) d WHERE kept")
    inner = with_bindings("SELECT 1", "cluster_series", "vmstat_series", "resource_series", "settings", "log_lines", "host_tables",
                          extra={**_W_CTE, **_TREND_CTE})
    ctes = inner[len("WITH "):inner.rindex("\nSELECT 1")]
    return (f"WITH {ctes},{_WAIT_LONG_SQL}\n"
            f"{_F_G1} UNION ALL {_F_G3} UNION ALL {_F_G4} UNION ALL {waits}")


@register("risk_block", "G5", _risk_block_sql())
def q_risk_block(spark, sf):
    """All findings: CPU contention, leaks, settings and significant weighted waits."""
    return G.risk_union(_findings_g1(spark, sf), _findings_g3(spark, sf), _findings_g4(spark, sf),
                        _findings_waits(spark, sf))

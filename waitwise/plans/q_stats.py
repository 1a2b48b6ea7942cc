"""Catalogue: correlation / regression / significance reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitwise.functions.bands import R2_BANDS, TREND_BANDS, WEIGHT_BANDS, band_sql
from waitwise.functions.tdist import p_value_duck
from waitwise.operators import stats
from waitwise.plans.duck import with_bindings
from waitwise.plans.registry import register
from waitwise.sources import bindings as B

GRAIN = "hour"
KEY = ["cluster"]
WT = B.WAIT_TYPES


def _sig_sql(r: str = "r", n: str = "n") -> str:
    """DuckDB select-list fragment: t, p, significant."""
    return (f"CASE WHEN {n} > 2 AND abs({r}) < 1 THEN {r} * sqrt(({n} - 2) / (1 - {r} * {r})) END AS t, "
            f"{p_value_duck(r, n)} AS p")


# ---------------------------------------------------------------- D1 / C8 / C9
_WAIT_LONG_SQL = """
grid AS (SELECT cluster, date_trunc('hour', ts) AS ts, count(*) AS waits FROM wait_samples GROUP BY 1, 2),
ct AS (SELECT DISTINCT cluster, wait_event_type FROM wait_samples),
cnt AS (SELECT cluster, date_trunc('hour', ts) AS ts, wait_event_type, count(*) AS c
        FROM wait_samples GROUP BY 1, 2, 3),
x AS (SELECT g.cluster, g.ts, ct.wait_event_type, g.waits, coalesce(cnt.c, 0) AS part
      FROM grid g JOIN ct ON g.cluster = ct.cluster
      LEFT JOIN cnt ON cnt.cluster = g.cluster AND cnt.ts = g.ts AND cnt.wait_event_type = ct.wait_event_type),
s AS (SELECT cluster, wait_event_type, count(*) AS n,
             CASE WHEN var_pop(part) > 0 AND var_pop(waits) > 0 THEN corr(part, waits) END AS r,
             CASE WHEN var_pop(part) > 0 AND var_pop(waits) > 0 THEN regr_r2(waits, part) END AS r2,
             sum(part) / sum(waits) AS share
      FROM x GROUP BY 1, 2),
w AS (SELECT *, r * share AS weight FROM s)"""

def _wait_sql(select: str) -> str:
    body = with_bindings("SELECT 1", "wait_samples")
    ctes = body[len("WITH "):body.rindex("\nSELECT 1")]
    return f"WITH {ctes},{_WAIT_LONG_SQL}\n{select}"


@register("weighted_wait_correlation", "C8", _wait_sql(f"""
SELECT cluster, wait_event_type, n, round(r, 9) AS r, round(r2, 9) AS r2, round(share, 9) AS share,
       round(weight, 9) AS weight, {band_sql('round(weight, 9)', WEIGHT_BANDS)} AS weight_band
FROM w"""))
def q_weighted_wait_correlation(spark, sf):
    """Correlation of each wait type with total waits, weighted by the type's share."""
    return stats.weighted_wait_correlation(B.cluster_series(spark, sf, GRAIN), KEY, WT)


_D1_SELECT = f"""
SELECT cluster, wait_event_type, n, round(r, 9) AS r, round(r2, 9) AS r2, round(share, 9) AS share,
       round(weight, 9) AS weight, {band_sql('round(weight, 9)', WEIGHT_BANDS)} AS weight_band,
       round(t, 9) AS t, round(p, 9) AS p, p < 0.05 AS significant,
       {band_sql('round(r2, 9)', R2_BANDS)} AS r2_band,
       coalesce(p < 0.05 AND round(weight, 9) >= 0.01 AND round(r2, 9) >= 0.2, false) AS kept
FROM (SELECT *, {_sig_sql()} FROM w) z"""


@register("report_wait_types", "D1", _wait_sql(_D1_SELECT))
def q_report_wait_types(spark, sf):
    """Flagship: three-stage wait analysis per cluster and wait type over the whole interval."""
    return stats.wait_analysis_3stage(B.cluster_series(spark, sf, GRAIN), KEY, WT)


@register("wait_analysis_3stage", "C9", _wait_sql(_D1_SELECT + " WHERE coalesce(p < 0.05 AND round(weight, 9) >= 0.01 "
                                                   "AND round(r2, 9) >= 0.2, false)"))
def q_wait_analysis_3stage(spark, sf):
    """Only the wait types that survive significance, weight and R² stages."""
    return stats.wait_analysis_3stage(B.cluster_series(spark, sf, GRAIN), KEY, WT).filter("kept")


# ---------------------------------------------------------------- pair statistics over aligned series
VM = B.VMSTAT_METRICS
CL = ["speed", "waits"]
ALIGNED_SQL = f"""SELECT c.*, {", ".join("v." + m for m in VM)}
FROM cluster_series c JOIN vmstat_series v ON c.cluster = v.cluster AND c.ts = v.ts"""


def _aligned(spark, sf):
    """Cluster and vmstat series on the same (cluster, hour) rows (one aggregation)."""
    return B.aligned_series(spark, sf, GRAIN)


def _r_sql(x: str, y: str) -> str:
    return f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END"


def _pairs_sql(table: str, key: str, pairs, extra: str = "") -> str:
    """One SELECT per pair, UNION ALL: the oracle's independent long form."""
    parts = []
    for x, y in pairs:
        parts.append(
            f"SELECT {key}, '{x}' AS x, '{y}' AS y, count({x} + {y}) AS n, {_r_sql(x, y)} AS r, "
            f"CASE WHEN var_pop({x}) > 0 THEN regr_slope({y}, {x}) END AS slope, "
            f"CASE WHEN var_pop({x}) > 0 THEN regr_intercept({y}, {x}) END AS intercept, "
            f"pow({_r_sql(x, y)}, 2) AS r2 FROM {table} GROUP BY {key}")
    return "\nUNION ALL ".join(parts)


VM_PAIRS = stats.all_pairs(VM)
CV_PAIRS = stats.all_pairs(CL, VM)


def _ps(table_sql_names, pairs, select: str, where: str = "", key: str = "cluster", table: str = "aligned") -> str:
    extra = {"aligned": ALIGNED_SQL} if table == "aligned" else None
    return with_bindings(f"SELECT {select} FROM ({_pairs_sql(table, key, pairs)}) ps {where}",
                         *table_sql_names, extra=extra)


@register("correlation", "C5", _ps(["vmstat_series"], VM_PAIRS, "cluster, x, y, r, n", table="vmstat_series"))
def q_correlation(spark, sf):
    """Pearson r of every vmstat metric pair per cluster, in one aggregation."""
    return stats.correlation(B.vmstat_series(spark, sf, GRAIN), KEY, VM_PAIRS)


@register("correlation_significance", "C6", _ps(
    ["vmstat_series"], VM_PAIRS, f"cluster, x, y, r, n, {_sig_sql()}, p < 0.05 AS significant",
    table="vmstat_series"))
def q_correlation_significance(spark, sf):
    """r with its t statistic and two-sided p-value (n-2 df)."""
    return stats.correlation_significance(stats.correlation(B.vmstat_series(spark, sf, GRAIN), KEY, VM_PAIRS))


@register("correlation_by_sign", "C7", _ps(
    ["vmstat_series"], VM_PAIRS,
    "cluster, x, y, r, n, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS sign, "
    "row_number() OVER (PARTITION BY cluster, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' "
    "ELSE 'none' END ORDER BY round(abs(r), 9) DESC, x, y) AS ord", "WHERE r IS NOT NULL", table="vmstat_series"))
def q_correlation_by_sign(spark, sf):
    """Positive and negative correlations listed separately, strongest first."""
    c = stats.correlation(B.vmstat_series(spark, sf, GRAIN), KEY, VM_PAIRS).withColumn("r", F.round("r", 9))
    return stats.correlation_by_sign(c, KEY)


@register("metric_pairs", "J5", _ps(["cluster_series", "vmstat_series"], CV_PAIRS,
                                    "cluster, x, y, n, r, slope, intercept, r2"))
def q_metric_pairs(spark, sf):
    """All cluster × vmstat metric pairs: r, slope, intercept, R² — no self-join."""
    return stats.pair_stats(_aligned(spark, sf), KEY, CV_PAIRS)


@register("regression_line", "C2", _ps(["cluster_series", "vmstat_series"], [(x, "speed") for x in VM],
                                       "cluster, x, y, slope, intercept, r2, n"))
def q_regression_line(spark, sf):
    """speed = intercept + slope·x for every vmstat metric x."""
    return stats.regression_line(_aligned(spark, sf), KEY, "speed", VM)


@register("r2_band", "C3", _ps(["cluster_series", "vmstat_series"], CV_PAIRS,
                               f"cluster, x, y, r2, {band_sql('round(r2, 9)', R2_BANDS)} AS r2_band"))
def q_r2_band(spark, sf):
    """R² interpretation band of each metric pair."""
    return stats.r2_stage(stats.pair_stats(_aligned(spark, sf), KEY, CV_PAIRS)).select(
        "cluster", "x", "y", "r2", "r2_band")


def _trend_sql(table: str, metrics, select: str) -> str:
    parts = []
    for m in metrics:
        parts.append(f"""SELECT cluster, '{m}' AS metric, count({m}) AS n,
  CASE WHEN var_pop(t) > 0 THEN regr_slope({m}, t) END AS slope,
  CASE WHEN var_pop(t) > 0 THEN regr_intercept({m}, t) END AS intercept, pow({_r_sql('t', m)}, 2) AS r2,
  CASE WHEN max({m}) - min({m}) > 0 THEN regr_slope({m}, t) * (max(t) - min(t)) / (max({m}) - min({m})) END AS k
FROM tt GROUP BY cluster""")
    body = "\nUNION ALL ".join(parts)
    tt = f"SELECT *, (epoch(ts) - min(epoch(ts)) OVER (PARTITION BY cluster)) / 60.0 AS t FROM {table}"
    return with_bindings(f"SELECT {select} FROM ({body}) tr", table, extra={"tt": tt})


_TREND_SEL = f"cluster, metric, n, slope, intercept, r2, k, {band_sql('round(k, 9)', TREND_BANDS)} AS k_band"


@register("trend_line", "C1", _trend_sql("vmstat_series", VM, _TREND_SEL))
def q_trend_line(spark, sf):
    """Least-squares trend of each vmstat metric against minutes since the first sample."""
    return stats.trend_line(B.vmstat_series(spark, sf, GRAIN), KEY, VM)


@register("trend_band", "C4", _trend_sql("cluster_series", B.CLUSTER_METRICS,
                                         f"cluster, metric, k, {band_sql('round(k, 9)', TREND_BANDS)} AS k_band"))
def q_trend_band(spark, sf):
    """Trend coefficient K (scaled slope) of the cluster metrics and its band."""
    return stats.trend_line(B.cluster_series(spark, sf, GRAIN), KEY, B.CLUSTER_METRICS).select(
        "cluster", "metric", "k", "k_band")


@register("report_vmstat_trends", "D2", _trend_sql(
    "vmstat_series", VM, _TREND_SEL + f", {band_sql('round(r2, 9)', R2_BANDS)} AS r2_band"))
def q_report_vmstat_trends(spark, sf):
    """Trend report per vmstat metric: slope, K band and R² band."""
    return stats.r2_stage(stats.trend_line(B.vmstat_series(spark, sf, GRAIN), KEY, VM))


_C10_SEL = (f"cluster, x, y, n, r, slope, p, r2, {band_sql('round(r2, 9)', R2_BANDS)} AS r2_band, "
            f"coalesce(p < 0.05 AND round(r2, 9) >= 0.2, false) AS kept")


@register("metric_analysis_2stage", "C10", with_bindings(
    f"SELECT {_C10_SEL} FROM (SELECT *, {p_value_duck('r', 'n')} AS p FROM ({_pairs_sql('aligned', 'cluster', CV_PAIRS)}) a) b",
    "cluster_series", "vmstat_series", extra={"aligned": ALIGNED_SQL}))
def q_metric_analysis_2stage(spark, sf):
    """Significance then R² stage for cluster × vmstat metric pairs."""
    return stats.metric_analysis_2stage(_aligned(spark, sf), KEY, CV_PAIRS)


WT_VM_PAIRS = [(f"waits_{t}", m) for t in B.WAIT_TYPES for m in VM]
CPU_CORES = 8


RAM_MB = 16384


@register("report_waits_vs_vmstat", "D3", with_bindings(
    f"SELECT {_C10_SEL}, slope / {CPU_CORES}.0 AS slope_per_cpu, m.mean / {RAM_MB}.0 AS ram_share "
    f"FROM (SELECT *, {p_value_duck('r', 'n')} AS p FROM ({_pairs_sql('aligned', 'cluster', WT_VM_PAIRS)}) a) b "
    f"LEFT JOIN (SELECT cluster AS c, metric, avg(value) AS mean FROM (SELECT cluster, {', '.join(B.MEMORY_METRICS)} FROM aligned) "
    f"UNPIVOT (value FOR metric IN ({', '.join(B.MEMORY_METRICS)})) GROUP BY 1, 2) m ON m.c = b.cluster AND m.metric = b.y",
    "cluster_series", "vmstat_series", extra={"aligned": ALIGNED_SQL}))
def q_report_waits_vs_vmstat(spark, sf):
    """Wait type × vmstat metric analysis, slope also per CPU core, memory columns also as a share of RAM."""
    return stats.waits_vs_host(_aligned(spark, sf), KEY, WT_VM_PAIRS, B.MEMORY_METRICS, CPU_CORES, RAM_MB)


IO_PAIRS = [(m, d) for m in [*B.VMSTAT_METRICS, "speed"] for d in B.IOSTAT_METRICS]
IOALIGNED_SQL = f"""SELECT i.cluster, i.device, i.ts, i.r_s, i.w_s, i.await_ms, i.util, c.speed,
       {", ".join("v." + m for m in B.VMSTAT_METRICS)}
FROM iostat_series i JOIN vmstat_series v ON i.cluster = v.cluster AND i.ts = v.ts
JOIN cluster_series c ON i.cluster = c.cluster AND i.ts = c.ts"""
_CRIT_SQL = "abs(r) AS abs_r, r2, 1 - p AS one_minus_p"


def _io_aligned(spark, sf):
    host = _aligned(spark, sf).select("cluster", "ts", "speed", *B.VMSTAT_METRICS)
    return B.iostat_series(spark, sf, GRAIN).join(host, ["cluster", "ts"])


def _io_pairs_sql() -> str:
    return (f"SELECT *, {p_value_duck('r', 'n')} AS p "
            f"FROM ({_pairs_sql('ioaligned', 'cluster, device', IO_PAIRS)}) a WHERE r IS NOT NULL")


def _io_analysis(spark, sf):
    a = stats.metric_analysis_2stage(_io_aligned(spark, sf), ["cluster", "device"], IO_PAIRS)
    return a.filter(F.col("r").isNotNull())


def _crit_df(a):
    return a.select("cluster", "device", "x", "y", F.abs("r").alias("abs_r"), "r2",
                    (1 - F.col("p")).alias("one_minus_p"))


_NORM_SQL = f"""
SELECT cluster, device, x, y, criterion,
       CASE WHEN max(v) OVER g > min(v) OVER g THEN (v - min(v) OVER g) / (max(v) OVER g - min(v) OVER g) ELSE 0.0 END AS z
FROM (SELECT cluster, device, x, y, {_CRIT_SQL} FROM ({_io_pairs_sql()}) q)
UNPIVOT (v FOR criterion IN (abs_r, r2, one_minus_p))
WINDOW g AS (PARTITION BY cluster, device, criterion)"""


@register("criteria_normalise", "C12", with_bindings(
    f"SELECT * FROM ({_NORM_SQL}) n", "iostat_series", "vmstat_series", "cluster_series", extra={"ioaligned": IOALIGNED_SQL}))
def q_criteria_normalise(spark, sf):
    """Min-max scaled criteria (|r|, R², 1-p) of each vmstat × device pair."""
    return stats.criteria_normalise(_crit_df(_io_analysis(spark, sf)), ["cluster", "device"], ["x", "y"],
                                    ["abs_r", "r2", "one_minus_p"])


def _equal_weights(spark):
    # the three CPI criteria with equal default weights (a parameter dimension of 3 rows)
    return spark.createDataFrame([("abs_r", 1.0), ("r2", 1.0), ("one_minus_p", 1.0)], "criterion string, raw_weight double")


_CPI_SQL = f"""
SELECT cluster, device, x, y, cpi,
       row_number() OVER (PARTITION BY cluster, device ORDER BY round(cpi, 9) DESC, x, y) AS ord
FROM (SELECT cluster, device, x, y, sum(z / 3.0) AS cpi FROM ({_NORM_SQL}) n GROUP BY ALL) c"""


@register("priority_index", "C13", with_bindings(
    _CPI_SQL, "iostat_series", "vmstat_series", "cluster_series", extra={"ioaligned": IOALIGNED_SQL}))
def q_priority_index(spark, sf):
    """Correlation priority index of each vmstat × device pair, ranked per device."""
    norm = stats.criteria_normalise(_crit_df(_io_analysis(spark, sf)), ["cluster", "device"], ["x", "y"],
                                    ["abs_r", "r2", "one_minus_p"])
    return stats.priority_index(norm, stats.criteria_weights(_equal_weights(spark)), ["cluster", "device"],
                                ["x", "y"])


@register("report_vmstat_vs_iostat", "D4", with_bindings(f"""
SELECT q.cluster, q.device, q.x, q.y, q.n, q.r, q.slope, q.p, q.r2,
       CASE q.x WHEN 'buff' THEN 'buffering' WHEN 'cache' THEN 'caching' WHEN 'speed' THEN 'speed' ELSE 'vmstat' END AS section,
       {band_sql('round(q.r2, 9)', R2_BANDS)} AS r2_band, coalesce(q.p < 0.05 AND round(q.r2, 9) >= 0.2, false) AS kept,
       c.cpi, c.ord
FROM ({_io_pairs_sql()}) q JOIN ({_CPI_SQL}) c USING (cluster, device, x, y)""",
    "iostat_series", "vmstat_series", "cluster_series", extra={"ioaligned": IOALIGNED_SQL}))
def q_report_vmstat_vs_iostat(spark, sf):
    """Host metric × device metric analysis for all devices in one job, in sections (vmstat, buffering, caching,
    speed), with the CPI ranking."""
    return stats.host_vs_device(_io_aligned(spark, sf), ["cluster", "device"], IO_PAIRS)


@register("criteria_weights", "C11", with_bindings("""
SELECT wait_event_type AS criterion, count(*) / sum(count(*)) OVER () AS w FROM wait_samples GROUP BY 1""",
    "wait_samples"))
def q_criteria_weights(spark, sf):
    """Normalised criterion weights of the wait types (raw weight = samples of the type)."""
    dim = B.wait_samples(spark, sf).groupBy(F.col("wait_event_type").alias("criterion")).agg(
        F.count(F.lit(1)).cast("double").alias("raw_weight"))
    return stats.criteria_weights(dim)


@register("sum_artifact_check", "C14", with_bindings("""
SELECT cluster, ts, total_s, total_s / 60.0 AS ratio,
       CASE WHEN round(total_s / 60.0, 9) > 1.5 THEN 'artefact' WHEN round(total_s / 60.0, 9) > 1.0
            THEN 'check raw logs' ELSE 'fine' END AS verdict
FROM (SELECT cluster, date_trunc('minute', ts) AS ts, CAST(sum(cents) AS DOUBLE) / 100 AS total_s
      FROM wait_samples GROUP BY 1, 2) q""", "wait_samples"))
def q_sum_artifact_check(spark, sf):
    """Summed wait seconds per minute against the 60 s period."""
    return stats.sum_artifact_check(B.wait_samples(spark, sf), KEY, F.col("cents") / F.lit(100.0), 60)


PART_WHOLE = [("calls", "speed"), ("nrows", "speed"), *[(f"waits_{t}", "waits") for t in B.WAIT_TYPES]]
PW_METRICS = ["calls", "nrows", "speed", "waits", *[f"waits_{t}" for t in B.WAIT_TYPES]]
PW_PAIRS = stats.all_pairs(PW_METRICS)


@register("part_of_whole_flag", "C15", with_bindings(f"""
SELECT ps.cluster, ps.x, ps.y, ps.r, ps.n,
       (x IN ('calls', 'nrows') AND y = 'speed') OR (x = 'waits' AND starts_with(y, 'waits_')) OR (y = 'waits' AND starts_with(x, 'waits_')) AS is_part
FROM ({_pairs_sql('cluster_series', 'cluster', PW_PAIRS)}) ps""", "cluster_series"))
def q_part_of_whole_flag(spark, sf):
    """Cluster-metric correlations with pairs where one metric is part of the other flagged."""
    pairs = stats.correlation(B.cluster_series(spark, sf, GRAIN), KEY, PW_PAIRS)
    dim = spark.createDataFrame(PART_WHOLE, "part string, whole string")
    return stats.part_of_whole_flag(pairs, dim)

"""Diagnostic rules and incidents.

Incidents are gaps-and-islands over the per-cluster indicator series: a running sum
of "island starts" numbers the islands, then one aggregation per island. All windows
are partitioned by cluster over the interval series (one row per cluster and
interval), so their size is bounded by time span / grain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwise.functions.bands import R2_BANDS, band_label
from waitwise.sources.bindings import bucket, epoch_seconds

# The reference's thresholds for context-switch contention.
CS_PER_CORE_LIMIT = 50000
US_SY_LIMIT = 50
WA_LIMIT = 5
# Our default priority bands of |r(speed, waits)| inside an incident.
PRIORITY_BANDS = [(0.75, 4), (0.5, 3), (0.25, 2)]


def contention_suspects(vmstat: DataFrame, cores: int) -> DataFrame:
    """G1: intervals with cs per core > 50k/s while us+sy < 50 and wa < 5."""
    cpc = F.col("cs") / F.lit(float(cores))
    return vmstat.filter((cpc > CS_PER_CORE_LIMIT) & (F.col("us") + F.col("sy") < US_SY_LIMIT)
                         & (F.col("wa") < WA_LIMIT)).select(
        "cluster", "ts", cpc.alias("cs_per_core"), "us", "sy", "wa")


def contention_correlation(pairs: DataFrame, strong: float = 0.7, weak: float = 0.3) -> DataFrame:
    """From correlation rows (cluster, x, y, r): strong r(cs, sy) and weak r(cs, us)."""
    p = pairs.groupBy("cluster").agg(
        F.max(F.when((F.col("x") == "sy") & (F.col("y") == "cs"), F.col("r"))).alias("r_cs_sy"),
        F.max(F.when((F.col("x") == "us") & (F.col("y") == "cs"), F.col("r"))).alias("r_cs_us"))
    sus = (F.abs(F.round("r_cs_sy", 9)) >= strong) & (F.abs(F.round("r_cs_us", 9)) < weak)
    return p.withColumn("suspect", F.coalesce(sus, F.lit(False)))


def leak_suspects(long: DataFrame, trends: DataFrame, key: Sequence[str] = ("cluster",),
                  min_r2: float = 0.6) -> DataFrame:
    """Rising trend (slope > 0, R² >= min_r2) whose last value is the running maximum; for metrics that
    should fall again (backends, temporary bytes, resident memory, prepared transactions)."""
    key = list(key)
    last = long.groupBy(*key, "metric").agg(F.max_by("value", "ts").alias("last"), F.max("value").alias("peak"))
    j = trends.select(*key, "metric", "slope", "r2").join(last, [*key, "metric"])
    sus = (F.round("slope", 9) > 0) & (F.round("r2", 9) >= min_r2) & (F.col("last") >= F.col("peak"))
    return j.withColumn("suspect", F.coalesce(sus, F.lit(False)))


SETTING_NAMES = ["random_page_cost", "is_ssd", "effective_cache_size_mb", "free_mb", "shared_buffers_mb",
                 "work_mem_mb", "autovacuum_vacuum_scale_factor"]


#: Size from which a table counts as large for the autovacuum rule (MB; ours).
LARGE_TABLE_MB = 12_000


def settings_audit(settings: DataFrame, temp_file_mean_mb: Column | None = None, tables: DataFrame | None = None,
                   large_mb: int = LARGE_TABLE_MB) -> DataFrame:
    """Per host rule findings (host, rule, value, label) over a fleet's settings snapshot.

    ``tables`` (host, table_name, size_mb) tells which hosts have a table of ``large_mb`` or more: only there
    default autovacuum settings are a finding; without it that rule is not applied.
    """
    w = settings.groupBy("host").pivot("name", SETTING_NAMES).agg(F.first("setting"))
    largest = F.lit(None).cast("double")
    if tables is not None:
        w = w.join(tables.groupBy("host").agg(F.max("size_mb").alias("_largest")), "host", "left")
        largest = F.col("_largest")
    rules = [
        ("random_page_cost_on_ssd", (F.col("random_page_cost") > 2.0) & (F.col("is_ssd") == 1.0),
         F.col("random_page_cost"), "lower random_page_cost on SSD storage"),
        ("effective_cache_size_low",
         F.col("effective_cache_size_mb") < F.col("free_mb") + F.col("shared_buffers_mb"),
         F.col("effective_cache_size_mb"), "effective_cache_size below free memory + shared_buffers"),
        ("autovacuum_default_scale", (F.col("autovacuum_vacuum_scale_factor") >= 0.2) & (largest >= large_mb),
         F.col("autovacuum_vacuum_scale_factor"), "default autovacuum scale factor on large tables"),
    ]
    if temp_file_mean_mb is not None:
        rules.append(("work_mem_below_temp_files", F.col("work_mem_mb") * 4 < temp_file_mean_mb,
                      F.col("work_mem_mb"), "work_mem far below the mean temporary file size"))
    found = F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule"), val.cast("double").alias("value"),
                                            F.lit(label).alias("label"))) for name, cond, val, label in rules])
    return w.select("host", F.explode(F.array_compact(found)).alias("f")).select("host", "f.*")


def incident_intervals(triplet: DataFrame, grain_minutes: int = 60, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """Islands of consecutive intervals with indicator = 1 → incidents.

    Output: *key, incident_id, priority (1-4 from max |r| in the island), s, f (end of the
    last interval), n.
    """
    key = list(key)
    w = Window.partitionBy(*key).orderBy("ts")
    prev = F.lag("indicator").over(w)
    gap = F.col("ts") > F.lag("ts").over(w) + F.expr(f"INTERVAL {grain_minutes} MINUTES")
    starts = F.when((F.col("indicator") == 1) & (prev.isNull() | (prev != 1) | gap), 1).otherwise(0)
    t = triplet.withColumn("_start", starts)
    t = t.withColumn("_island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inc = t.filter(F.col("indicator") == 1).groupBy(*key, "_island").agg(
        F.min("ts").alias("s"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("n"),
        F.max(F.abs(F.round("r", 9))).alias("_absr"))
    prio: Column = F.lit(1)
    for lo, p in reversed(PRIORITY_BANDS):
        prio = F.when(F.col("_absr") >= lo, F.lit(p)).otherwise(prio)
    return inc.select(
        *key, F.concat_ws("@", *[F.col(k) for k in key], F.date_format("s", "yyyy-MM-dd HH:mm")).alias("incident_id"),
        prio.alias("priority"), "s", (F.col("_last") + F.expr(f"INTERVAL {grain_minutes} MINUTES")).alias("f"), "n")


def last_incident_time(series: DataFrame, incidents: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """For every interval the finish of the latest incident finished at or before it and the
    age in minutes (union + last-non-null window, no range join)."""
    key = list(key)
    a = series.select(*key, "ts", F.lit(None).cast("timestamp_ntz").alias("_f"), F.lit(1).alias("_side"))
    b = incidents.select(*key, F.col("f").alias("ts"), F.col("f").alias("_f"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b).withColumn("last_finish", F.last("_f", ignorenulls=True).over(w))
    age = (epoch_seconds("ts") - epoch_seconds("last_finish")) / 60
    return u.filter(F.col("_side") == 1).select(*key, "ts", "last_finish", age.cast("bigint").alias("age_min"))


def incident_count_24h(incidents: DataFrame, key: Sequence[str] = ("cluster",), hours: int = 24) -> DataFrame:
    """B10 (rolling form): for each incident, incidents of the same key started in the
    preceding ``hours`` hours including itself."""
    w = (Window.partitionBy(*key).orderBy(epoch_seconds("s"))
         .rangeBetween(-hours * 3600 + 1, 0))
    return incidents.select(*key, "incident_id", "s", F.count(F.lit(1)).over(w).alias("n_24h"))


def risk_union(*findings: DataFrame) -> DataFrame:
    """Union of findings (category, subject, finding, label)."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out


def interval_compare(long: DataFrame, windows: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """Per incident and metric, medians over the incident and baseline windows.

    ``windows`` = P7 output (key, incident_id, interval, s, f); ``long`` = (key, ts, metric, value).
    Range join bucketed by day (windows exploded over the days they cover).
    """
    key = list(key)
    day = F.expr("INTERVAL 1 DAY")
    wv = windows.withColumn("_d", F.explode(F.sequence(bucket("s", "day"), bucket("f", "day"), day)))
    lv = long.withColumn("_d", bucket("ts", "day"))
    j = lv.join(wv, [*key, "_d"]).filter((F.col("ts") >= F.col("s")) & (F.col("ts") <= F.col("f")))
    agg = j.groupBy(*key, "incident_id", "metric").agg(
        F.percentile(F.when(F.col("interval") == "baseline", F.col("value")), 0.5).alias("med_base"),
        F.percentile(F.when(F.col("interval") == "incident", F.col("value")), 0.5).alias("med_incident"))
    diff = F.col("med_incident") - F.col("med_base")
    return agg.select(*key, "incident_id", "metric", "med_base", "med_incident", diff.alias("diff"),
                      F.when(F.col("med_base") != 0, diff / F.col("med_base") * 100).alias("pct"))


def r2_label(col: str) -> Column:
    return band_label(F.round(col, 9), R2_BANDS)

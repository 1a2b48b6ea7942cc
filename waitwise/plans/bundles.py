"""Report bundles: the reference's interval, incident and log report runs as Spark jobs.

``summary_report`` computes every interval report (SURVEY D1-D13) from the telemetry
tables for [s, f] and writes each one with ``write_report`` (A15). The interval's inputs
are filtered once (the filter reaches the scans) and persisted, so the dozen reports
read them from cache instead of re-scanning — where the reference ran a dozen sequential
SELECTs and a loop per device, this is one job per report with the device as a column.
``incident_report`` runs it for the incident hour and its baseline and adds the
interval comparison (C16); ``log_report`` writes the log summaries for the same slice.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwise.operators import diagnostics as G
from waitwise.operators import logs as L
from waitwise.operators import reports as R
from waitwise.operators import stats
from waitwise.operators import timeseries as T
from waitwise.sources import bindings as B
from waitwise.sources import serverlog as S
from waitwise.sources.sinks import write_report

KEY = ["cluster"]


@dataclass
class Telemetry:
    """Repository tables one report run reads (all keyed by ``cluster`` and ``ts``)."""
    wait_samples: DataFrame
    series: DataFrame            # aligned cluster + vmstat measures per (cluster, interval)
    iostat: DataFrame
    dirty: DataFrame
    texts: DataFrame
    buffers: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str, grain: str = "hour", s: str | None = None,
                    f: str | None = None) -> "Telemetry":
        """The telemetry tables; with ``s``/``f`` the raw samples are filtered on their own
        timestamp before any aggregation, so the filter reaches the parquet scan and a
        report reads only its interval's row groups."""
        ws = T.time_window_filter(B.wait_samples(spark, sf_dir), s, f)
        return cls(ws, B.aligned_from_samples(ws, grain), B.iostat_from_samples(ws, grain),
                   T.time_window_filter(B.dirty_samples(spark, sf_dir), s, f),
                   T.time_window_filter(B.query_texts(spark, sf_dir), s, f), B.buffer_series(spark, sf_dir))

    def window(self, s: str, f: str, persist: bool = True) -> "Telemetry":
        """The same tables restricted to s <= ts <= f (persisted for the report run)."""
        out = {}
        for fld in fields(self):
            df = T.time_window_filter(getattr(self, fld.name), s, f)
            out[fld.name] = df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df
        return Telemetry(**out)

    def release(self) -> None:
        for fld in fields(self):
            getattr(self, fld.name).unpersist()


def interval_reports(t: Telemetry, cpu_cores: int = 8, ram_mb: int = 16384, roll_minutes: int = 60) -> dict[str, DataFrame]:
    """Every interval report as a lazy DataFrame (nothing runs until written)."""
    vm = B.VMSTAT_METRICS
    cv_pairs = stats.all_pairs(["speed", "waits"], vm)
    wt_pairs = [(f"waits_{w}", m) for w in B.WAIT_TYPES for m in vm]
    io_al = t.iostat.join(t.series.select("cluster", "ts", "speed", *vm), ["cluster", "ts"])
    io_pairs = [(m, d) for m in [*vm, "speed"] for d in B.IOSTAT_METRICS]
    vm_long = T.to_long(t.series, KEY, vm)
    io_long = T.to_long(t.iostat, ["cluster", "device"], B.IOSTAT_METRICS)
    dirty_m = T.minute_median_dirty(t.dirty)
    dirty_b = T.bounds_report(T.to_long(dirty_m, KEY, ["dirty_kb", "dirty_pct", "dirty_bg_pct", "avail_mb"]), KEY)
    return {
        "wait_types": stats.wait_analysis_3stage(t.series, KEY, B.WAIT_TYPES),
        "vmstat_trends": stats.r2_stage(stats.trend_line(t.series, KEY, vm)),
        "waits_vs_vmstat": stats.waits_vs_host(t.series, KEY, wt_pairs, B.MEMORY_METRICS, cpu_cores, ram_mb),
        "vmstat_vs_speed": stats.metric_analysis_2stage(t.series, KEY, cv_pairs),
        "vmstat_vs_iostat": stats.host_vs_device(io_al, ["cluster", "device"], io_pairs),
        "cluster_series": t.series.select("cluster", "ts", "speed", "waits",
                                          *[f"waits_{w}" for w in B.WAIT_TYPES]),
        "vmstat_series": R.pivot_series(T.rolling_median(vm_long, ["cluster", "metric"], roll_minutes), KEY, vm),
        "iostat_series": R.pivot_series(T.rolling_median(io_long, ["cluster", "device", "metric"], roll_minutes),
                                        ["cluster", "device"], B.IOSTAT_METRICS),
        "dirty_pages": dirty_b.withColumn("pct_ram", F.when(F.col("metric") == "dirty_kb",
                                                            F.col("max") / 1024.0 / F.lit(float(ram_mb)) * 100)),
        "buffer_cache": R.buffer_cache(t.buffers),
        "pareto_wait_types": R.pareto(t.wait_samples, KEY, ["wait_event_type"]),
        "pareto_queries": R.pareto(t.wait_samples, KEY, ["queryid"], "cents"),
        "pareto_queries_by_owner": R.pareto(t.wait_samples, KEY, ["queryid", "dbname", "rolname"], "cents"),
        "sql_list": T.query_text_dim(t.texts).join(t.wait_samples.select("queryid"), "queryid", "left_semi"),
    }


def summary_report(t: Telemetry, s: str, f: str, out_path: str, interval: str = "interval",
                   fmt: str = "csv", **kw) -> list[str]:
    """Write every interval report for [s, f] under ``out_path/report=<name>/interval=<interval>``."""
    w = t.window(s, f)
    try:
        reports = interval_reports(w, **kw)
        for name, df in reports.items():
            parts = ["device"] if "device" in df.columns and fmt != "csv" else []
            write_report(df, out_path, name, interval, fmt, parts)
        return list(reports)
    finally:
        w.release()


def incident_report(t: Telemetry, at: str, out_path: str, minutes: int = 60, fmt: str = "csv") -> list[str]:
    """Incident at ``at``: reports for [at - minutes, at] ("incident") and the preceding
    window ("baseline"), plus the per-metric comparison of the two."""
    at_dt = dt.datetime.fromisoformat(at)
    fmt_ts = "%Y-%m-%d %H:%M:%S"
    b0 = (at_dt - dt.timedelta(minutes=2 * minutes)).strftime(fmt_ts)
    b1 = (at_dt - dt.timedelta(minutes=minutes)).strftime(fmt_ts)
    at_ts = F.lit(at_dt.strftime(fmt_ts)).cast("timestamp_ntz")
    names = summary_report(t, b1, at, out_path, "incident", fmt)
    summary_report(t, b0, b1, out_path, "baseline", fmt)
    inc = t.series.select("cluster").distinct().select(
        "cluster", F.lit(at).alias("incident_id"), at_ts.alias("s"))
    win = T.incident_windows(inc, minutes)
    cmp_ = G.interval_compare(T.to_long(t.series, KEY, B.CLUSTER_METRICS), win)
    write_report(cmp_, out_path, "interval_compare", "incident", fmt)
    return names + ["interval_compare"]


def log_report(lines: DataFrame, s: str, f: str, out_path: str, interval: str = "interval",
               fmt: str = "csv", codes: DataFrame | None = None) -> list[str]:
    """Log summaries (L2-L6) for the records whose minute lies in [s, f]."""
    spark = lines.sparkSession
    recs = S.records_in_slice(lines, s, f).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        codes = codes if codes is not None else S.sqlstate_dim(spark)
        # the error count greps every physical line of the slice, continuation lines included
        all_lines = recs.select(F.explode(F.split("record", "\n")).alias("line"))
        out = {
            "autovacuum": L.autovacuum_summary(L.autovacuum_events(recs)),
            "checkpoints": L.checkpoint_summary(recs),
            "temp_files": L.temp_file_summary(recs),
            "errors": L.error_counts(all_lines, codes),
            "warnings": L.warning_counts(recs),
        }
        for name, df in out.items():
            write_report(df, out_path, name, interval, fmt)
        return list(out)
    finally:
        recs.unpersist()

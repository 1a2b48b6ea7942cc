"""Report bundles write one report set per interval (CSV with header, partitioned folders)."""

import os

from tests.conftest import SF001
from waitwise.plans import bundles
from waitwise.sources import serverlog as S


def _reports(path):
    return sorted(d.split("=", 1)[1] for d in os.listdir(path) if d.startswith("report="))


def test_summary_and_incident_report(spark, tmpdir_path):
    t = bundles.Telemetry.from_tables(spark, SF001)
    out = os.path.join(tmpdir_path, "summary")
    names = bundles.summary_report(t, "2024-01-05 00:00:00", "2024-01-20 23:59:59", out)
    assert _reports(out) == sorted(names) and len(names) == 14
    wt = spark.read.option("header", True).csv(os.path.join(out, "report=wait_types"))
    assert {"cluster", "wait_event_type", "p", "weight_band", "kept", "interval"} <= set(wt.columns)
    assert wt.count() > 0

    out2 = os.path.join(tmpdir_path, "incident")
    names2 = bundles.incident_report(t, "2024-01-15 12:00:00", out2, minutes=360)
    assert "interval_compare" in names2
    intervals = os.listdir(os.path.join(out2, "report=wait_types"))
    assert sorted(intervals) == ["interval=baseline", "interval=incident"]


def test_log_report(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "logs")
    names = bundles.log_report(S.log_lines(spark, SF001), "2024-01-10 00:00", "2024-01-12 23:59", out)
    assert _reports(out) == sorted(names)
    av = spark.read.option("header", True).csv(os.path.join(out, "report=autovacuum")).collect()
    assert len(av) == 1 and int(av[0]["n"]) > 0


def test_summary_report_matches_direct_computation(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from waitwise.operators import stats
    from waitwise.operators import timeseries as T
    from waitwise.sources import bindings as B
    s, f = "2024-01-03 00:00:00", "2024-01-25 23:59:59"
    t = bundles.Telemetry.from_tables(spark, SF001)
    out = os.path.join(tmpdir_path, "direct")
    bundles.summary_report(t, s, f, out, "probe", fmt="parquet")
    got = spark.read.parquet(os.path.join(out, "report=wait_types", "interval=probe"))
    exp = stats.wait_analysis_3stage(T.time_window_filter(B.aligned_series(spark, SF001), s, f), ["cluster"],
                                     B.WAIT_TYPES)
    cols = ["cluster", "wait_event_type", "n", "kept"]
    assert got.count() == exp.count() > 0
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0
    r = got.select("cluster", "wait_event_type", F.round("r", 9).alias("r")).exceptAll(
        exp.select("cluster", "wait_event_type", F.round("r", 9).alias("r")))
    assert r.count() == 0


def test_windowed_telemetry_pushes_the_interval_to_the_scan(spark):
    t = bundles.Telemetry.from_tables(spark, SF001, s="2024-01-03 00:00:00", f="2024-01-05 23:59:59")
    plan = t.series._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "events.parquet" in ln][0]
    assert "GreaterThanOrEqual(ts" in scan.split("PushedFilters:")[1]
    full = bundles.Telemetry.from_tables(spark, SF001).window("2024-01-03 00:00:00", "2024-01-05 23:59:59",
                                                              persist=False)
    a = sorted(map(tuple, t.series.collect()))
    b = sorted(map(tuple, full.series.collect()))
    assert a == b and len(a) > 0          # hour-aligned window: same series either way

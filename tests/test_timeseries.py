"""Time-series operators against brute force and literal cases."""

import datetime as dt
import os

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import SF001
from waitwise.operators import timeseries as T
from waitwise.sources import bindings as B
from waitwise.sources import ostext


def test_rolling_median_equals_brute_force(spark):
    long = T.to_long(B.vmstat_series(spark, SF001), ["cluster"], ["us", "wa"])
    got = T.rolling_median(long, ["cluster", "metric"], 180).toPandas()
    for (c, m), g in got.groupby(["cluster", "metric"]):
        g = g.sort_values("ts")
        for _, row in g.iterrows():
            win = g[(g.ts <= row.ts) & (g.ts >= row.ts - pd.Timedelta(minutes=180))]
            assert abs(win.value.median() - row.med) < 1e-12


def test_minute_median_counts(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = []
    for minute, n in enumerate([1, 2, 59, 60]):
        for i in range(n):
            rows.append((base + dt.timedelta(minutes=minute, seconds=i), "c", i + 1, 10, 0, 0, 0,
                         2_000_000, 0, 0))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, cluster string, nr_dirty long, dirty_ratio int, "
                                     "dirty_bytes long, dirty_bg_ratio int, dirty_bg_bytes long, mem_available_kb long, "
                                     "mem_free_kb long, cached_kb long")
    got = {r["n"]: r["dirty_kb"] for r in T.minute_median_dirty(df).collect()}
    # dirty_kb = 4 * pages, pages 1..n: median of 1..n times 4
    assert got == {1: 4.0, 2: 6.0, 59: 120.0, 60: 122.0}


def test_dirty_limits_literal_cases(spark):
    rows = [  # nr_dirty, ratio, bytes, bg_ratio, bg_bytes, avail, free, cached
        (100, 20, 268435456, 10, 0, 1_000_000, 1, 1),   # bytes beat ratio
        (100, 0, 0, 0, 0, 1_000_000, 1, 1),             # both zero
        (100, 20, 0, 10, 0, None, 300_000, 500_000),    # MemAvailable missing
        (100, 1, 0, 0, 0, 50, 1, 1),                    # limit rounds down to 0
    ]
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "c", *r) for r in rows],
                               "ts timestamp_ntz, cluster string, nr_dirty long, dirty_ratio int, dirty_bytes long, "
                               "dirty_bg_ratio int, dirty_bg_bytes long, mem_available_kb long, mem_free_kb long, "
                               "cached_kb long")
    out = T.dirty_percent(T.dirty_limits(df)).select("limit_kb", "bg_limit_kb", "dirty_pct", "dirty_bg_pct",
                                                     "avail_mb").collect()
    assert [tuple(r) for r in out] == [
        (262144, 100000, 0, 0, 976),
        (0, 0, 0, 0, 976),
        (160000, 80000, 0, 0, 781),
        (0, 0, 0, 0, 0),
    ]


def test_asof_matches_pandas(spark):
    left = B.cluster_series(spark, SF001).select("cluster", "ts", "speed")
    right = B.dirty_samples(spark, SF001).select("cluster", "ts", "nr_dirty")
    got = T.align_series_asof(left, right, ["cluster"], ["nr_dirty"], 30).toPandas()
    lp = left.toPandas().sort_values("ts")
    rp = right.toPandas().sort_values("ts").rename(columns={"ts": "right_ts"})
    exp = pd.merge_asof(lp, rp, left_on="ts", right_on="right_ts", by="cluster",
                        tolerance=pd.Timedelta(minutes=30))
    m = got.merge(exp, on=["cluster", "ts"], suffixes=("", "_e"))
    assert len(m) == len(lp) == len(got)
    assert ((m.nr_dirty.isna() & m.nr_dirty_e.isna()) | (m.nr_dirty == m.nr_dirty_e)).all()


def test_interval_join_matches_brute_force(spark):
    ws = B.wait_samples(spark, SF001).select("event_id", "ts")
    passes = B.load_passes(spark, SF001)
    got = T.samples_in_interval(ws, passes, interval_cols=["pass_counter"]).select("event_id", "pass_counter")
    p = passes.toPandas()
    w = ws.toPandas()
    exp = sum(((w.ts >= r.start_ts) & (w.ts <= r.finish_ts)).sum() for r in p.itertuples())
    assert got.count() == exp


def test_wait_map_round_trip(spark):
    ws = B.wait_samples(spark, SF001)
    back = T.wait_map_explode(T.wait_map_build(ws))
    direct = ws.groupBy("queryid", "wait_event_type", "wait_event").count().withColumnRenamed("count", "n")
    assert back.exceptAll(direct).count() == 0 and direct.exceptAll(back).count() == 0


def test_counter_reset_rule(spark):
    rows = [(dt.datetime(2024, 1, 1, h), 1, c, c, c) for h, c in enumerate([5, 8, 2, 6])]  # reset after 8
    df = spark.createDataFrame(rows, "ts timestamp_ntz, queryid long, calls long, nrows long, waits long")
    got = [r["calls"] for r in T.statement_interval_stats(df, cumulative=True).orderBy("ts").collect()]
    assert got == [5, 3, 2, 4]


def test_readers(spark, tmpdir_path):
    vm = os.path.join(tmpdir_path, "vmstat.log")
    with open(vm, "w") as f:
        f.write("procs -----------memory---------- ---swap-- -----io---- -system-- ------cpu----- -----timestamp-----\n"
                " r  b   swpd   free   buff  cache   si   so    bi    bo   in   cs us sy id wa st                 UTC\n"
                " 2  0      0  12000    100   3000    0    0    10    20  500  900  5  2 92  1  0 2024-03-01 10:00:00"
                " 128.00 12.50 6.00 14000.00\n"
                " 1  1      0  11900    100   3000    0    0     0    40  450  800  4  3 91  2  0  0 2024-03-01 10:01:00"
                " 130.00 13.00 6.50 13990.00\n")
    v = ostext.read_vmstat(spark, vm).orderBy("ts").collect()
    assert len(v) == 2 and v[0]["cs"] == 900 and v[1]["wa"] == 2 and v[1]["avail_mb"] == 13990.0
    assert str(v[1]["ts"]) == "2024-03-01 10:01:00"

    io = os.path.join(tmpdir_path, "iostat.log")
    with open(io, "w") as f:
        f.write("Linux 6.1 (host)\t03/01/2024\t_x86_64_\t(8 CPU)\n\n"
                "2024-03-01T10:00:00+0000\navg-cpu:  %user   %nice %system %iowait  %steal   %idle\n"
                "           1.00    0.00    0.50    0.10    0.00   98.40\n\n"
                "Device            r/s     w/s  %util\nsda              1.00    2.00   3.00\nsdb   4.00 5.00 6.00\n\n"
                "2024-03-01T10:01:00+0000\nDevice            r/s     w/s  %util\nsda              7.00    8.00   9.00\n\n")
    rows = ostext.read_iostat(spark, io).collect()
    got = sorted((str(r["ts"]), r["device"], r["metrics"]["w/s"]) for r in rows)
    assert got == [("2024-03-01 10:00:00", "sda", 2.0), ("2024-03-01 10:00:00", "sdb", 5.0),
                   ("2024-03-01 10:01:00", "sda", 8.0)]
    last = ostext.read_iostat(spark, io, latest_only=True).collect()
    assert [(r["device"], r["metrics"]["%util"]) for r in last] == [("sda", 9.0)]

    dp = os.path.join(tmpdir_path, "vm_dirty.log")
    with open(dp, "w") as f:
        f.write(" \n01-03-2024 10:00:01 | 512 | 3 | 6 | 14000\n01-03-2024 10:00:02 | 516 | 3 | 6 | 14001\n")
    d = ostext.read_dirty_samples(spark, dp).orderBy("ts").collect()
    assert [(str(r["ts"]), r["dirty_kb"]) for r in d] == [("2024-03-01 10:00:01", 512), ("2024-03-01 10:00:02", 516)]


def test_time_filter_pushed_to_scan(spark):
    ws = B.wait_samples(spark, SF001).select("event_id", "ts")
    plan = T.time_window_filter(ws, "2024-01-08 00:00:00", "2024-01-09 00:00:00")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan
    assert "event_type" not in plan.split("ReadSchema")[1].split("\n")[0]   # column pruning
    assert F is not None


def _random_series(spark, n=400, seed=1):
    import random
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    rows = []
    for c in ("a", "b", "c"):
        t = at
        for _ in range(n):
            t += dt.timedelta(minutes=rng.choice([1, 1, 2, 7, 60, 60, 700]))
            rows.append((c, "m", t, rng.choice([rng.uniform(0, 9), 5.0, None])))
    return spark.createDataFrame(rows, "cluster string, metric string, ts timestamp_ntz, value double")


def test_chunked_median_equals_the_range_form(spark):
    from pyspark.sql import Window
    long = _random_series(spark)
    w = Window.partitionBy("cluster", "metric").orderBy(F.unix_timestamp("ts")).rangeBetween(-180 * 60, 0)
    exp = sorted(map(tuple, long.withColumn("med", F.percentile("value", 0.5).over(w)).collect()), key=repr)
    for chunk in (None, 180, 181, 2000):
        got = T.rolling_median(long, ["cluster", "metric"], 180, chunk_minutes=chunk)
        assert got.columns == [*long.columns, "med"]
        assert sorted(map(tuple, got.collect()), key=repr) == exp


def test_one_series_is_many_tasks(spark):
    long = _random_series(spark).filter("cluster = 'a'")
    got = T.rolling_median(long, ["cluster", "metric"], 180)
    plan = got._jdf.queryExecution().executedPlan().toString()
    window = [x for x in plan.splitlines() if "Window [" in x]
    assert window and all("_chunk" in x.split("], [")[-2] for x in window)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tasks = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("med"), F.count(F.lit(1)).alias("count")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 200


def test_asof_of_any_tolerance_without_replicas(spark):
    left = _random_series(spark, 150, 2).select("cluster", "ts", F.col("value").alias("x"))
    right = _random_series(spark, 60, 3).select("cluster", "ts", "value", F.lit("k").alias("extra"))
    for minutes in (5, 180, 100_000):
        df = T.align_series_asof(left, right, ["cluster"], ["value", "extra"], minutes)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Expand" not in plan
        got = sorted(((r["cluster"], r["ts"], r["right_ts"], r["extra"]) for r in df.collect()), key=repr)
        rs = [(r["cluster"], r["ts"]) for r in right.collect()]
        exp = []
        for r in left.collect():
            best = max((t for c, t in rs if c == r["cluster"] and t <= r["ts"]), default=None)
            if best is not None and best < r["ts"] - dt.timedelta(minutes=minutes):
                best = None
            exp.append((r["cluster"], r["ts"], best, "k" if best else None))
        assert got == sorted(exp, key=repr)


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_retention_touches_the_old_days_and_the_edge_day_only(spark, tmpdir_path):
    from waitwise.sources import sinks
    path = tmpdir_path + "/table"
    rows = [(dt.datetime(2024, 3, d, h), d * 100 + h) for d in range(1, 11) for h in (0, 6, 12, 18)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v int")
    sinks.write_by_day(df, path)
    before = _files(path)
    got = sinks.retain_table(spark, path, 4)          # newest is the 10th, 18:00: the edge is the 6th, 18:00
    after = _files(path)
    assert got == sinks.Retained(tuple(dt.date(2024, 3, d) for d in range(1, 6)), dt.date(2024, 3, 6))
    want = sorted(tuple(r) for r in sinks.retain_recent(df, 4).collect())
    assert sorted((r["ts"], r["v"]) for r in spark.read.parquet(path).collect()) == want
    later = {f: m for f, m in before.items() if f.split("/")[0] > "day=2024-03-06"}
    assert later and {f: m for f, m in after.items() if f.split("/")[0] > "day=2024-03-06"} == later
    assert not any(f < "day=2024-03-06" for f in after)
    # nothing is left to do; a day written again replaces that day only
    assert sinks.retain_table(spark, path, 4) == sinks.Retained((), None)
    assert _files(path) == after
    sinks.write_by_day(spark.createDataFrame([(dt.datetime(2024, 3, 8, 1), 1)], "ts timestamp_ntz, v int"), path)
    assert {f: m for f, m in _files(path).items() if "03-08" not in f} == {f: m for f, m in after.items() if "03-08" not in f}
    assert spark.read.parquet(path).filter("day = DATE'2024-03-08'").count() == 1
    assert sinks.retain_table(spark, tmpdir_path, 4) == sinks.Retained((), None)


def test_report_partitions_are_replaced_alone(spark, tmpdir_path):
    from waitwise.sources import sinks
    cols = "device string, v int"
    sinks.write_report(spark.createDataFrame([("a", 1), ("b", 2)], cols), tmpdir_path, "io", "x", "parquet", ["device"])
    sinks.write_report(spark.createDataFrame([("b", 3)], cols), tmpdir_path, "io", "x", "parquet", ["device"], only_partitions=True)
    assert sorted((r["device"], r["v"]) for r in spark.read.parquet(tmpdir_path + "/report=io/interval=x").collect()) == [("a", 1), ("b", 3)]


def test_iostat_versions_splits_and_reports_without_time(spark):
    text = """Linux 6.1
2024-03-01T10:00:00+0000
avg-cpu:  %user
           1.00

Device            r/s     w/s  %util
sda              1.00    2.00   3.00

2024-03-01T10:01:00+0000
Device:  %util r/s
sda   9.00 8.00
sdb   7.00

avg-cpu:  %user
           1.00
Device            r/s
sdc              5,5""".split("\n")
    want = [(1, "10:00:00", "sda", {"r/s": 1.0, "w/s": 2.0, "%util": 3.0}), (2, "10:01:00", "sda", {"%util": 9.0, "r/s": 8.0}),
            (2, "10:01:00", "sdb", {"%util": 7.0}), (3, "10:01:00", "sdc", {"r/s": None})]
    for k in (1, 2, 3, 5, 100):                       # lines to a split
        rows = [("f", i // k, (i // k, i), x) for i, x in enumerate(text)]
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "file string, chunk int, pos struct<c:int,r:int>, line string")
        got = sorted(((r["block"], str(r["ts"])[11:], r["device"], r["metrics"]) for r in ostext.parse_iostat(df).collect()), key=repr)
        assert got == want
    assert {r["device"] for r in ostext.parse_iostat(df, latest_only=True).collect()} == {"sdc"}
    untimed = spark.createDataFrame([("f", 0, (0, i), x) for i, x in enumerate(text[5:8])], df.schema)
    assert [(r["block"], r["ts"], r["device"]) for r in ostext.parse_iostat(untimed).collect()] == [(1, None, "sda")]

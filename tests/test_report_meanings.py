"""Reports against cases computed by hand."""

import datetime as dt

from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.conftest import SF001
from waitwise.operators import diagnostics as G
from waitwise.operators import reports as R
from waitwise.operators import stats
from waitwise.operators import timeseries as T
from waitwise.plans.q_stats import PART_WHOLE, PW_METRICS
from waitwise.sources import bindings as B

T0 = dt.datetime(2024, 3, 1)


def hours(n):
    return [T0 + dt.timedelta(hours=h) for h in range(n)]


def test_query_history_by_hand(spark):
    # hour 0: query 7 runs four times, two of them waiting on IO and one on Lock; hour 1: twice, Lock only; hour 5: once, IO
    rows = [(0, "IO"), (0, "IO"), (0, "Lock"), (0, "Timeout"), (1, "Lock"), (1, "Lock"), (5, "IO")]
    df = spark.createDataFrame([(T0 + dt.timedelta(hours=h, minutes=3), 7, w, 150) for h, w in rows] + [(T0, 8, "IPC", 990)],
                               "ts timestamp_ntz, queryid long, wait_event_type string, cents long")
    got = {(r["queryid"], r["wait_event_type"], r["ts"].hour): (r["calls"], r["nrows"], r["waits"], r["med_calls"], r["med_waits"])
           for r in R.query_history(df, B.WAIT_TYPES, "hour", 180).collect()}
    assert got == {(7, "IO", 0): (4, 6, 2, 4.0, 2.0), (7, "IO", 1): (2, 3, 0, 3.0, 1.0), (7, "IO", 5): (1, 1, 1, 1.0, 1.0),
                   (7, "Lock", 0): (4, 6, 1, 4.0, 1.0), (7, "Lock", 1): (2, 3, 2, 3.0, 1.5), (7, "Lock", 5): (1, 1, 0, 1.0, 0.0),
                   (7, "Timeout", 0): (4, 6, 1, 4.0, 1.0), (7, "Timeout", 1): (2, 3, 0, 3.0, 0.5), (7, "Timeout", 5): (1, 1, 0, 1.0, 0.0),
                   (8, "IPC", 0): (1, 9, 1, 1.0, 1.0)}
    one = R.query_history(df, ["Lock"], "hour", 180, queryids=[7])
    assert sorted((r["ts"].hour, r["waits"]) for r in one.collect()) == [(0, 1), (1, 2), (5, 0)]


def test_query_history_sorts_one_row_an_interval(spark):
    # types are dealt out after the windows: neither the sort nor a window sees a row once for each type
    plan = R.query_history(B.wait_samples(spark, SF001), B.WAIT_TYPES, "hour", 180)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Sort [") == 1
    assert plan.index("Generate explode(knownnotcontainsnull") < plan.index("Window [") < plan.index("Sort [")


def test_scenario_history_is_of_scenario_statements_only(spark):
    # statements of no scenario leave before the windows, not after them
    plan = queries()["report_scenarios"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window [") < plan.index("LeftSemi")
    samples = B.wait_samples(spark, SF001)
    ids = samples.select("queryid").distinct().filter("queryid % 10 = 0")
    history = R.query_history(samples, B.WAIT_TYPES, "hour", 180)
    some = R.query_history(samples, B.WAIT_TYPES, "hour", 180, statements=ids)
    assert some.count() and sorted(some.collect()) == sorted(history.filter("queryid % 10 = 0").collect())


def test_every_wait_type_is_part_of_waits():
    parts = {p for p, w in PART_WHOLE if w == "waits"}
    assert parts == {f"waits_{t}" for t in B.WAIT_TYPES} and {"waits_BufferPin", "waits_Extension"} <= parts
    assert {p for p, _ in PART_WHOLE} | {"speed", "waits"} == set(PW_METRICS)


def test_ram_share_and_slope_per_core(spark):
    series = spark.createDataFrame([("a", float(i), 2.0 * i + 1, 4096.0 + 1024 * (i % 2)) for i in range(8)],
                                   "cluster string, waits_IO double, us double, free double")
    got = {r["y"]: r for r in stats.waits_vs_host(series, ["cluster"], [("waits_IO", "us"), ("waits_IO", "free")], ["free"], 4, 9216).collect()}
    assert abs(got["us"]["slope_per_cpu"] - 0.5) < 1e-12 and got["us"]["ram_share"] is None
    assert abs(got["free"]["ram_share"] - 4608 / 9216) < 1e-12


def test_device_report_has_its_sections(spark):
    rows = [("a", "sda", float(i), float(i), float(7 - i), float(i * i), float(2 * i)) for i in range(8)]
    df = spark.createDataFrame(rows, "cluster string, device string, util double, buff double, cache double, us double, speed double")
    got = {r["x"]: r for r in stats.host_vs_device(df, ["cluster", "device"], [(m, "util") for m in ("us", "buff", "cache", "speed")]).collect()}
    assert {x: r["section"] for x, r in got.items()} == {"us": "vmstat", "buff": "buffering", "cache": "caching", "speed": "speed"}
    assert abs(got["cache"]["r"] + 1) < 1e-12 and abs(got["speed"]["slope"] - 0.5) < 1e-12
    assert sorted(r["ord"] for r in got.values()) == [1, 2, 3, 4] and got["us"]["ord"] == 4


def test_buffer_cache_moves_with_speed(spark):
    ts = hours(6)
    blocks = spark.createDataFrame([(t, 100 + 10 * i, 50, i, 0) for i, t in enumerate(ts)],
                                   "ts timestamp_ntz, blks_hit long, blks_read long, blks_dirtied long, blks_written long")
    speed = spark.createDataFrame([(t, 3 * i) for i, t in enumerate(ts)], "ts timestamp_ntz, speed long")
    got = {r["x"]: r for r in R.buffer_cache_speed(blocks, speed).collect()}
    assert abs(got["blks_hit"]["r"] - 1) < 1e-12 and abs(got["blks_hit"]["slope"] - 0.3) < 1e-12 and got["blks_hit"]["kept"]
    assert abs(got["blks_dirtied"]["slope"] - 3.0) < 1e-12
    assert got["blks_read"]["r"] is None and not got["blks_read"]["kept"] and got["hit_ratio"]["r"] > 0.9


def test_leaks_are_sought_in_resources(spark):
    ts = hours(24)
    rows = [("a", t, 10 + i % 3, 1000 * i, 512 + 2 * i if i < 20 else 512, 5) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "cluster string, ts timestamp_ntz, numbackends long, temp_bytes long, rss_mb long, prepared long")
    got = G.leak_suspects(T.to_long(df, ["cluster"], B.RESOURCE_METRICS), stats.trend_line(df, ["cluster"], B.RESOURCE_METRICS))
    # temporary bytes rise to the end; memory has come back; backends go up and down; prepared transactions stand still
    assert {r["metric"]: r["suspect"] for r in got.collect()} == {"numbackends": False, "temp_bytes": True, "rss_mb": False, "prepared": False}


def test_default_autovacuum_matters_on_large_tables_only(spark):
    def host(h, scale):
        return [(h, n, v) for n, v in (("random_page_cost", 1.1), ("is_ssd", 0.0), ("effective_cache_size_mb", 99999.0), ("free_mb", 1.0),
                                       ("shared_buffers_mb", 1.0), ("work_mem_mb", 64.0), ("autovacuum_vacuum_scale_factor", scale))]
    settings = spark.createDataFrame(host(1, 0.2) + host(2, 0.2) + host(3, 0.01) + host(4, 0.2), "host int, name string, setting double")
    tables = spark.createDataFrame([(1, "t", 50_000), (1, "s", 3), (2, "t", 10), (3, "t", 50_000)], "host int, table_name string, size_mb int")
    got = G.settings_audit(settings, None, tables).collect()
    assert [(r["host"], r["rule"]) for r in got] == [(1, "autovacuum_default_scale")]
    assert G.settings_audit(settings).count() == 0
    assert G.settings_audit(settings, F.lit(300.0), tables, large_mb=5).filter("rule = 'work_mem_below_temp_files'").count() == 4

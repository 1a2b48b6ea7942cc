"""Streaming = batch on the same input (availableNow triggers, memory sinks)."""

import os
import shutil

from pyspark.sql import functions as F

from tests.conftest import SF001
from waitwise.operators import diagnostics as G
from waitwise.operators import markov as M
from waitwise.operators import timeseries as T
from waitwise.plans import q_markov as QM
from waitwise.sources import bindings as B
from waitwise.streaming import streams as ST


def _events_dir(tmpdir_path):
    d = os.path.join(tmpdir_path, "events")
    os.makedirs(d)
    shutil.copy(f"{SF001}/events.parquet", os.path.join(d, "part-0.parquet"))
    return d


def test_minute_metrics_stream_equals_batch(spark, tmpdir_path):
    src = ST.read_events_stream(spark, _events_dir(tmpdir_path))
    q = ST.start(ST.stream_minute_metrics(src), os.path.join(tmpdir_path, "ck1"), name="f1_out")
    q.awaitTermination()
    got = spark.table("f1_out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    ws = B.wait_samples(spark, SF001)
    batch = T.statement_interval_stats(ws, "minute", key=["cluster"])
    # append mode holds back windows the watermark has not passed: compare closed windows only
    last = got.agg(F.max("ts")).collect()[0][0]
    batch = batch.filter(F.col("ts") <= last)
    assert got.count() == batch.count() > 0
    assert got.select("cluster", "ts", "calls", "nrows", "waits").exceptAll(
        batch.select("cluster", "ts", "calls", "nrows", "waits")).count() == 0


def test_minute_metrics_of_statements_equal_batch(spark, tmpdir_path):
    src = ST.read_events_stream(spark, _events_dir(tmpdir_path))
    ST.start(ST.stream_minute_metrics(src, key=("queryid",)), os.path.join(tmpdir_path, "ck1q"), name="f1q_out").awaitTermination()
    got = spark.table("f1q_out").withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("queryid", "ts", "calls", "nrows", "waits")
    batch = T.statement_interval_stats(B.wait_samples(spark, SF001), "minute").filter(F.col("ts") <= got.agg(F.max("ts")).collect()[0][0])
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


def test_rolling_median_stream_equals_batch(spark, tmpdir_path):
    src = ST.read_events_stream(spark, _events_dir(tmpdir_path))
    q = ST.start(ST.stream_rolling_median(src, "60 minutes", "10 minutes"), os.path.join(tmpdir_path, "ck2"),
                 name="f2_out")
    q.awaitTermination()
    got = spark.table("f2_out")
    ws = B.wait_samples(spark, SF001).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = ws.groupBy("cluster", F.window("ts", "60 minutes", "10 minutes").alias("w")).agg(
        F.percentile("cents", 0.5).alias("med"), F.count(F.lit(1)).alias("n")).select(
        "cluster", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "med", "n")
    last = got.agg(F.max("end")).collect()[0][0]
    batch = batch.filter(F.col("end") <= last)
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch).count() == 0


def test_incident_sessions_equal_islands(spark, tmpdir_path):
    tri = T.performance_triplet(B.cluster_series(spark, SF001), minutes=360)
    d = os.path.join(tmpdir_path, "tri")
    tri.select("cluster", "ts", "indicator").orderBy("ts").coalesce(1).write.parquet(d)  # arrival in time order
    src = spark.readStream.schema("cluster string, ts timestamp_ntz, indicator int").parquet(d)
    q = ST.start(ST.stream_incidents(src), os.path.join(tmpdir_path, "ck3"), name="f3_out")
    q.awaitTermination()
    got = {(r["cluster"], str(r["s"])[:16], r["n"]) for r in spark.table("f3_out").collect()}
    inc = G.incident_intervals(tri)
    # append mode emits a session once the watermark (2 h) has passed its end
    horizon = tri.agg(F.max("ts")).collect()[0][0]
    closed = inc.filter(F.col("f") + F.expr("INTERVAL 3 HOURS") < F.lit(horizon))
    exp = {(r["cluster"], str(r["s"])[:16], r["n"]) for r in closed.collect()}
    assert exp and exp <= got
    assert got <= {(r["cluster"], str(r["s"])[:16], r["n"]) for r in inc.collect()}


def test_transitions_stream_equals_batch(spark, tmpdir_path):
    states = QM._states(spark, SF001)
    d = os.path.join(tmpdir_path, "states")
    states.select("cluster", "ts", "state").repartition(3).write.parquet(d)
    src = spark.readStream.schema("cluster string, ts timestamp_ntz, state int").option(
        "maxFilesPerTrigger", 100).parquet(d)
    q = ST.start(ST.stream_transitions(src), os.path.join(tmpdir_path, "ck4"), name="f4_out")
    q.awaitTermination()
    got = spark.table("f4_out").select("cluster", F.col("ts").cast("timestamp_ntz").alias("ts"), "from_state",
                                       "to_state")
    exp = M.transitions(states).select("cluster", "ts", "from_state", "to_state")
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0


def test_log_import_stream(spark, tmpdir_path):
    from waitwise.operators import logs as L
    from waitwise.sources import serverlog as S
    d = os.path.join(tmpdir_path, "logs")
    os.makedirs(d)
    lines = S.log_lines(spark, SF001).filter(F.col("file").isin("postgresql-2024-01-01.log",
                                                               "postgresql-2024-01-02.log"))
    for f in ("postgresql-2024-01-01.log", "postgresql-2024-01-02.log"):
        txt = [r["line"] for r in lines.filter(F.col("file") == f).orderBy("pos").collect()]
        with open(os.path.join(d, f), "w", encoding="utf-8") as fh:
            fh.write("\n".join(txt) + "\n")
    out = os.path.join(tmpdir_path, "av")
    q = ST.start(ST.stream_log_lines(spark, d), os.path.join(tmpdir_path, "ck5"),
                 foreach_batch=ST.log_import_batch(out))
    q.awaitTermination()
    got = spark.read.parquet(out)
    exp = L.autovacuum_events(S.assemble_records(lines))
    assert got.count() == exp.count() > 0
    assert got.drop("batch_id").exceptAll(exp).count() == 0


def test_transitions_state_across_batches(spark, tmpdir_path):
    import glob
    import time
    states = QM._states(spark, SF001).select("cluster", "ts", "state")
    d = os.path.join(tmpdir_path, "states_in_order")
    os.makedirs(d)
    cuts = ["2024-01-01", "2024-01-10", "2024-01-20", "2024-02-01"]
    for i in range(3):   # three time slices arriving one after another
        part = os.path.join(tmpdir_path, f"slice{i}")
        states.filter((F.col("ts") >= cuts[i]) & (F.col("ts") < cuts[i + 1])).coalesce(1).write.parquet(part)
        for f in glob.glob(os.path.join(part, "*.parquet")):
            shutil.copy(f, os.path.join(d, f"slice{i}.parquet"))
        time.sleep(1.1)
    src = spark.readStream.schema("cluster string, ts timestamp_ntz, state int").option(
        "maxFilesPerTrigger", 1).parquet(d)
    q = ST.start(ST.stream_transitions(src), os.path.join(tmpdir_path, "ck4b"), name="f4b_out")
    q.awaitTermination()
    assert len(q.recentProgress) >= 3
    got = spark.table("f4b_out").select("cluster", F.col("ts").cast("timestamp_ntz").alias("ts"), "from_state",
                                        "to_state")
    exp = M.transitions(QM._states(spark, SF001)).select("cluster", "ts", "from_state", "to_state")
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0

"""Operators on keyed streaming state: order, panes, and records across files and micro-batches."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from waitwise.operators import markov as M
from waitwise.operators import timeseries as T
from waitwise.plans import q_markov as QM
from waitwise.sources import bindings as B
from waitwise.sources import serverlog as S
from waitwise.streaming import stateful as SF
from waitwise.streaming import streams as ST


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    SF.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def arrive(spark, batches, path, schema):
    """One parquet file a micro-batch, in this order."""
    os.makedirs(path)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(os.path.join(path, f"b{i:03d}.parquet"), coerce_timestamps="us")
        os.utime(os.path.join(path, f"b{i:03d}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_transitions_of_rows_out_of_order_equal_batch(spark, tmpdir_path):
    states = QM._states(spark, SF001).select("cluster", "ts", "state")
    rows = sorted(map(tuple, states.collect()), key=lambda r: r[1])
    last, step = rows[-1][1], 40
    # rows swap places with others of up to five hours around, also across micro-batches; some come twice
    rng = random.Random(3)
    order = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 5 * 3600))
    batches = [order[i:i + step] + order[max(0, i - 2):i] for i in range(0, len(order), step)]
    src = arrive(spark, batches, tmpdir_path + "/states", "cluster string, ts timestamp_ntz, state int")
    ST.start(SF.stream_transitions_ordered(src, "6 hours"), tmpdir_path + "/ck", name="f4_ordered").awaitTermination()
    got = spark.table("f4_ordered").select("cluster", F.col("ts").cast("timestamp_ntz").alias("ts"), "from_state", "to_state")
    exp = M.transitions(QM._states(spark, SF001)).select("cluster", "ts", "from_state", "to_state").filter(
        F.col("ts") <= F.lit(str(last)).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect())) and exp.count() > 100


def test_panes_equal_the_hopping_window(spark, tmpdir_path):
    ws = B.wait_samples(spark, SF001).select("cluster", "ts", F.col("cents").cast("double").alias("value"))
    rows = sorted(map(tuple, ws.collect()), key=lambda r: r[1])
    src = arrive(spark, [rows[i:i + 150] for i in range(0, len(rows), 150)], tmpdir_path + "/s", "cluster string, ts timestamp_ntz, value double")
    ST.start(SF.stream_rolling_median_panes(src, "60 minutes", "10 minutes"), tmpdir_path + "/ck", name="f2_panes").awaitTermination()
    got = spark.table("f2_panes")
    exp = ws.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("cluster", F.window("ts", "60 minutes", "10 minutes").alias("w")).agg(
        F.percentile("value", 0.5).alias("med"), F.count(F.lit(1)).alias("n")).select(
        "cluster", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "med", "n")
    exp = exp.filter(F.col("end") <= F.lit(str(rows[-1][1])).cast("timestamp") - F.expr("INTERVAL 2 MINUTES"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect())) and got.count() > 500


def test_panes_of_a_minute_series_equal_the_trailing_median(spark, tmpdir_path):
    ws = B.wait_samples(spark, SF001)
    series = T.statement_interval_stats(ws, "minute", key=["cluster"]).select("cluster", "ts", F.col("nrows").cast("double").alias("value"))
    rows = sorted(map(tuple, series.collect()), key=lambda r: r[1])
    src = arrive(spark, [rows[i:i + 200] for i in range(0, len(rows), 200)], tmpdir_path + "/m", "cluster string, ts timestamp_ntz, value double")
    ST.start(SF.stream_rolling_median_panes(src, "180 minutes", "1 minute"), tmpdir_path + "/ck", name="f2_minutes").awaitTermination()
    long = series.withColumn("metric", F.lit("nrows"))
    b1 = T.rolling_median(long, ["cluster", "metric"], 179)
    end = F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")
    exp = b1.select("cluster", end.alias("end"), "med").filter(F.col("end") <= F.lit(str(rows[-1][1])).cast("timestamp") - F.expr("INTERVAL 2 MINUTES"))
    got = spark.table("f2_minutes").select("cluster", "end", "med")
    assert exp.exceptAll(got).count() == 0 and exp.count() > 500


HEAD = "2024-03-01 10:{:02d}:00.123 UTC| db1| psql| alice| 10.0.0.1| 4242| 00000| "


def log_file(path, lines, at):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    os.utime(path, (at, at))


def test_records_across_files_and_repeated_files(spark, tmpdir_path):
    d, now = tmpdir_path + "/logs", int(time.time()) - 5000
    one = ["orphan", HEAD.format(1) + "LOG: a", "  more of a", HEAD.format(2) + "LOG: cut between files"]
    two = ["  goes on", "  and on", HEAD.format(3) + "LOG: c", HEAD.format(4) + "LOG: cut, and the whole next file is its rest"]
    three = ["  only continuation", "  lines here"]
    four = ["  the end of it", HEAD.format(5) + "LOG: e", HEAD.format(6) + "LOG: open to the end"]
    other = [HEAD.format(1) + "LOG: a", HEAD.format(9) + "LOG: another log"]
    for i, (name, lines) in enumerate((("x/p-1.log", one), ("x/p-2.log", two), ("x/p-3.log", three), ("y/p-1.log", other), ("x/p-4.log", four))):
        log_file(f"{d}/{name}", lines, now + 10 * i)

    def run():
        q = ST.start(SF.stream_log_records(SF.stream_lines(spark, d, max_files=1)), tmpdir_path + "/ck", sink="parquet", path=tmpdir_path + "/out")
        q.awaitTermination()
        return sorted((r["log"], r["record"]) for r in spark.read.parquet(tmpdir_path + "/out").collect())
    text = [x for f in (one, two, three, four) for x in f]
    batch = spark.createDataFrame([("x", 0, i, x) for i, x in enumerate(text)], "file string, chunk long, pos long, line string").coalesce(1)
    want = sorted(("x", r["record"]) for r in S.assemble_records(batch).collect()) + [("y", other[0])]
    want.remove(("x", four[2]))                       # the last record of each log is still open
    assert run() == want and len(want) == 6
    # files delivered again, at other paths: nothing new, and the open records are untouched
    log_file(f"{d}/again/x/p-2.log", two, now + 60)
    log_file(f"{d}/again/x/p-4.log", four, now + 70)
    assert run() == want
    log_file(f"{d}/x/p-5.log", ["  its last line", HEAD.format(7) + "LOG: f"], now + 80)
    assert run() == sorted([*want, ("x", four[2] + "\n  its last line")])

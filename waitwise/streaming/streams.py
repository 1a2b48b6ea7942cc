"""Structured Streaming versions of the per-minute collection.

Each ``stream_*`` function takes a streaming DataFrame and returns the transformed
streaming DataFrame; ``start`` attaches a sink with a checkpoint folder (one
streaming query per checkpoint is the overlap protection the cron flag file gave).
Event time is cast to TIMESTAMP first: watermarks reject TIMESTAMP_NTZ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waitwise.operators import logs as L
from waitwise.sources import serverlog as S

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _limited(reader, max_files: int | None):
    """The reader with at most ``max_files`` files a micro-batch; None reads all that have arrived."""
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def read_events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files of events arriving in ``path`` (one or more files per micro-batch)."""
    return _limited(spark.readStream.schema(EVENT_SCHEMA), max_files).parquet(path)


def _samples(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    return events.select(F.col("ts").cast("timestamp").alias("ts"),
                         F.concat(F.lit("pg"), (u % 3).cast("string")).alias("cluster"),
                         u.alias("queryid"), "event_type",
                         F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def stream_minute_metrics(events: DataFrame, watermark: str = "2 minutes", grain: str = "1 minute",
                          key: Sequence[str] = ("cluster",)) -> DataFrame:
    """per key (``cluster``, or ``queryid`` for statement statistics, or both) and tumbling interval: calls (samples,
    as in A4), nrows, waits (append after the watermark)."""
    s = _samples(events).withWatermark("ts", watermark)
    return s.groupBy(*key, F.window("ts", grain).alias("w")).agg(
        F.count(F.lit(1)).alias("calls"), F.expr("sum(cents) div 100").alias("nrows"),
        F.count(F.when(F.col("event_type") != "error", 1)).alias("waits"),
    ).select(*key, F.col("w.start").alias("ts"), "calls", "nrows", "waits")


def stream_rolling_median(events: DataFrame, length: str = "60 minutes", slide: str = "1 minute",
                          watermark: str = "2 minutes") -> DataFrame:
    """trailing median as a hopping window: median of the sample values in each
    [end - length, end) window, emitted per slide. Exact ``percentile`` per window."""
    s = _samples(events).withWatermark("ts", watermark)
    return s.groupBy("cluster", F.window("ts", length, slide).alias("w")).agg(
        F.percentile(F.col("cents"), 0.5).alias("med"), F.count(F.lit(1)).alias("n")
    ).select("cluster", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "med", "n")


def stream_incidents(indicator_rows: DataFrame, gap: str = "61 minutes", watermark: str = "2 hours") -> DataFrame:
    """incidents as session windows over indicator = 1 rows, keyed by cluster.

    Consecutive hourly rows (gap <= ``gap``) belong to one session = one incident.
    """
    # Rows with the indicator off must still advance event time (so an incident closes
    # once the indicator is seen cleared). A plain filter would be pushed below the
    # watermark; a zero dynamic gap drops those rows inside the session operator instead.
    s = (indicator_rows.select("cluster", F.col("ts").cast("timestamp").alias("ts"), "indicator")
         .withWatermark("ts", watermark))
    dyn_gap = F.when(F.col("indicator") == 1, F.lit(gap)).otherwise(F.lit("0 seconds"))
    return s.groupBy("cluster", F.session_window("ts", dyn_gap).alias("w")).agg(
        F.min("ts").alias("s"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


TRANSITION_SCHEMA = "cluster string, ts timestamp, from_state int, to_state int"


def _transition_fn(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    prev_ts, prev_state = (state.get if state.exists else (None, None))
    for pdf in pdfs:
        pdf = pdf.sort_values("ts").drop_duplicates("ts", keep="first")
        if prev_ts is not None:
            pdf = pdf[pdf["ts"] > prev_ts]          # late or repeated rows are ignored
        if pdf.empty:
            continue
        to_state = pdf["state"].astype("int64").to_numpy()
        from_state = pd.Series(to_state).shift(1).to_numpy()
        from_state[0] = prev_state if prev_state is not None else float("nan")
        out = pd.DataFrame({"cluster": key[0], "ts": pdf["ts"].to_numpy(), "from_state": from_state,
                            "to_state": to_state}).dropna(subset=["from_state"])
        prev_ts, prev_state = pdf["ts"].iloc[-1], int(to_state[-1])
        if len(out):
            yield out.astype({"from_state": "int32", "to_state": "int32"})
    state.update((prev_ts, prev_state))


def stream_transitions(states: DataFrame) -> DataFrame:
    """one-step Markov training: (previous state → state) per cluster, keeping the
    previous state in keyed streaming state (``applyInPandasWithState``). Rows must
    arrive in time order per cluster across micro-batches (late rows are ignored)."""
    s = states.select("cluster", F.col("ts").cast("timestamp").alias("ts"), F.col("state").cast("int"))
    return s.groupBy("cluster").applyInPandasWithState(
        _transition_fn, TRANSITION_SCHEMA, "prev_ts timestamp, prev_state int", "append",
        GroupStateTimeout.NoTimeout)


def log_import_batch(out_path: str) -> Callable[[DataFrame, int], None]:
    """F5 body for ``foreachBatch``: assemble the batch's closed log files into records,
    parse autovacuum events (L1) and write them to ``out_path/batch_id=<n>`` (idempotent)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        # the micro-batch is a static frame still in file-split order: number lines here
        lines = batch.select("file", "chunk", F.monotonically_increasing_id().alias("_mid"), "line").select(
            "file", "chunk", F.struct(F.col("chunk").alias("c"), F.expr("_mid & 8589934591").alias("r")).alias("pos"),
            "line")
        ev = L.autovacuum_events(S.assemble_records(lines))
        # one folder per micro-batch, overwritten on retry: a re-run batch (after an
        # executor or driver failure) replaces its own output instead of appending twice
        ev.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
    return run


def stream_log_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """F5 source: rotated (closed) log files; whole files per micro-batch, so multi-line
    records never straddle batches (daily rotation)."""
    return (_limited(spark.readStream.format("text"), max_files).load(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
                    F.col("value").alias("line")))


def start(sdf: DataFrame, checkpoint: str, sink: str = "memory", name: str | None = None,
          mode: str = "append", available_now: bool = True, foreach_batch=None, path: str | None = None):
    """Attach a sink and start: memory table (tests), parquet files or a foreachBatch body."""
    w = sdf.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if available_now:
        w = w.trigger(availableNow=True)
    if foreach_batch is not None:
        return w.foreachBatch(foreach_batch).start()
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(sink).option("path", path).start()

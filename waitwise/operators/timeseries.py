"""Time-series operators: statement stats, wait maps, alignment, rolling medians,
interval assignment (SURVEY A4-A7, P1-P7, J3, J4, J9, B1-B7).

Scale notes
-----------
* Trailing windows (B1-B3, P5, M1) run per series key and *time chunk*: a chunk also gets
  the rows of the last window length before it (its halo), so one long series is many
  tasks and no task needs a whole one.
* The interval join (J9) is bucketed: an equi-join on (key, bucket) and a residual filter.
* The as-of join (J4) looks inside a (key, bucket) only; what an empty bucket start needs
  is the last value of earlier buckets, carried over a table of one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwise.sources.bindings import bucket, epoch_seconds


# ---------------------------------------------------------------- A4-A7
def statement_interval_stats(samples: DataFrame, grain: str = "hour", cumulative: bool = False,
                             key: Sequence[str] = ("queryid",)) -> DataFrame:
    """A4: per (interval, key) calls, nrows, waits.

    ``cumulative=False``: ``samples`` are raw wait samples (one row per sample).
    ``cumulative=True``: ``samples`` carry cumulative counters (ts, *key, calls, nrows,
    waits); the interval value is x - lag(x), or x itself after a counter reset (x < lag).
    """
    key = list(key)
    if not cumulative:
        return samples.groupBy(bucket("ts", grain).alias("ts"), *key).agg(
            F.count(F.lit(1)).alias("calls"),
            F.expr("sum(cents) div 100").alias("nrows"),
            F.count(F.when(F.col("wait_event_type") != "Timeout", 1)).alias("waits"))
    w = Window.partitionBy(*key).orderBy("ts")
    out = samples
    for c in ("calls", "nrows", "waits"):
        prev = F.lag(c).over(w)
        out = out.withColumn(c, F.when(prev.isNull() | (F.col(c) < prev), F.col(c)).otherwise(F.col(c) - prev))
    return out.select("ts", *key, "calls", "nrows", "waits")


def cumulative_counters(stats: DataFrame, key: Sequence[str] = ("queryid",)) -> DataFrame:
    """Running totals of interval stats (what a counter view would show)."""
    w = Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return stats.select("ts", *key, *[F.sum(c).over(w).alias(c) for c in ("calls", "nrows", "waits")])


def wait_map_build(samples: DataFrame, wait_type: str | None = None) -> DataFrame:
    """A5: per queryid the nested wait map {type: {event: n}} as JSON (optionally one type)."""
    s = samples if wait_type is None else samples.filter(F.col("wait_event_type") == wait_type)
    per_event = s.groupBy("queryid", "wait_event_type", "wait_event").agg(F.count(F.lit(1)).alias("n"))
    per_type = per_event.groupBy("queryid", "wait_event_type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("wait_event", "n")))).alias("events"))
    by_type = F.array_sort(
        F.collect_list(F.struct("wait_event_type", "events")),
        lambda a, b: F.when(a["wait_event_type"] < b["wait_event_type"], -1)
        .when(a["wait_event_type"] > b["wait_event_type"], 1).otherwise(0))
    return per_type.groupBy("queryid").agg(F.to_json(F.map_from_entries(by_type)).alias("wait_stats"))


def wait_map_explode(maps: DataFrame) -> DataFrame:
    """JSON wait map → (queryid, wait_event_type, wait_event, n)."""
    parsed = maps.select("queryid", F.from_json("wait_stats", "map<string,map<string,bigint>>").alias("m"))
    t = parsed.select("queryid", F.explode("m").alias("wait_event_type", "events"))
    return t.select("queryid", "wait_event_type", F.explode("events").alias("wait_event", "n"))


def query_text_dim(texts: DataFrame) -> DataFrame:
    """One text per queryid — the most recently seen."""
    return texts.groupBy("queryid").agg(F.max_by("query", "ts").alias("query"))


# ---------------------------------------------------------------- P1-P7
def available_memory(df: DataFrame) -> DataFrame:
    """MemAvailable, else MemFree + Cached; MB = kB div 1024."""
    avail = F.coalesce(F.col("mem_available_kb"), F.col("mem_free_kb") + F.col("cached_kb"))
    return df.withColumn("avail_kb", avail).withColumn("avail_mb", F.expr("avail_kb div 1024"))


def _limit(bytes_col: str, ratio_col: str) -> Column:
    return (F.when(F.col(bytes_col) > 0, F.expr(f"{bytes_col} div 1024"))
            .when(F.col(ratio_col) > 0, F.expr(f"avail_kb * {ratio_col} div 100"))
            .otherwise(F.lit(0).cast("bigint")))


def dirty_limits(df: DataFrame) -> DataFrame:
    """Dirty and background limits in kB: bytes/1024, else avail*ratio/100, else 0."""
    if "avail_kb" not in df.columns:
        df = available_memory(df)
    return (df.withColumn("limit_kb", _limit("dirty_bytes", "dirty_ratio"))
              .withColumn("bg_limit_kb", _limit("dirty_bg_bytes", "dirty_bg_ratio")))


def _pct(bytes_col: str, ratio_col: str) -> Column:
    lim = F.expr(f"avail_kb * {ratio_col} div 100")
    return (F.when(F.col(bytes_col) > 0, F.lit(0).cast("bigint"))
            .when((F.col(ratio_col) > 0) & (lim > 0), F.expr(f"dirty_kb * 100 div (avail_kb * {ratio_col} div 100)"))
            .otherwise(F.lit(0).cast("bigint")))


def dirty_percent(df: DataFrame) -> DataFrame:
    """dirty_kb = pages*4; percent of the ratio-based limit (0 when bytes rule or no limit)."""
    if "avail_kb" not in df.columns:
        df = available_memory(df)
    df = df.withColumn("dirty_kb", F.col("nr_dirty") * 4)
    return (df.withColumn("dirty_pct", _pct("dirty_bytes", "dirty_ratio"))
              .withColumn("dirty_bg_pct", _pct("dirty_bg_bytes", "dirty_bg_ratio")))


def operational_speed(stats: DataFrame) -> DataFrame:
    """speed = calls + rows, components kept."""
    return stats.withColumn("speed", F.col("calls") + F.col("nrows"))


def time_window_filter(df: DataFrame, s: str | None, f: str | None, ts: str = "ts") -> DataFrame:
    """S <= ts <= f (either bound optional); a plain filter so it reaches the scan."""
    c = F.col(ts)
    if s is not None:
        df = df.filter(c >= F.lit(s).cast("timestamp_ntz"))
    if f is not None:
        df = df.filter(c <= F.lit(f).cast("timestamp_ntz"))
    return df


def rolling(key: Sequence[str], minutes: int, ts: str = "ts") -> Window:
    """Trailing RANGE frame of ``minutes`` on epoch seconds of ``ts``."""
    return (Window.partitionBy(*key).orderBy(epoch_seconds(ts))
            .rangeBetween(-minutes * 60, 0))


#: A time chunk is this many window lengths long, so its halo adds an eighth of its rows.
CHUNK_WINDOWS = 8


def in_chunks(df: DataFrame, key: Sequence[str], minutes: int, ts: str = "ts",
              chunk_minutes: int | None = None) -> tuple[DataFrame, Window]:
    """``df`` dealt into time chunks, and the trailing window of ``minutes`` inside them.

    Rows of the last ``minutes`` of a chunk stand in the next one too, marked ``_halo``; after the
    window is applied, ``without_halo`` leaves each row once, with its whole trailing frame.
    """
    span = 60 * (chunk_minutes or CHUNK_WINDOWS * minutes)
    if span < minutes * 60:
        raise ValueError("a chunk must not be shorter than the window")
    e = epoch_seconds(ts)
    chunk = F.floor(e / span)
    own = F.struct(chunk.alias("_chunk"), F.lit(False).alias("_halo"))
    halo = F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_halo"))
    late = e >= (chunk + 1) * span - minutes * 60
    dealt = df.withColumn("_in", F.explode(F.when(late, F.array(own, halo)).otherwise(F.array(own))))
    dealt = dealt.select(*df.columns, "_in._chunk", "_in._halo")
    return dealt, rolling([*key, "_chunk"], minutes, ts)


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_chunk", "_halo")


def performance_triplet(series: DataFrame, key: Sequence[str] = ("cluster",), minutes: int = 360,
                        ts: str = "ts") -> DataFrame:
    """P5: per interval speed, waitings and the degradation indicator.

    Indicator (our definition): over the trailing window, slope(speed) < 0 and
    slope(waits) > 0 and r(speed, waits) < 0. ``r`` is kept for priority bands.
    """
    t = epoch_seconds(ts) / 60.0
    sp, wt = F.col("speed").cast("double"), F.col("waits").cast("double")
    base, w = in_chunks(series.withColumn("_t", t), key, minutes, ts)
    out = without_halo(base.select(
        *key, ts, "speed", F.col("waits").alias("waitings"),
        F.regr_slope(sp, F.col("_t")).over(w).alias("speed_slope"),
        F.regr_slope(wt, F.col("_t")).over(w).alias("waits_slope"),
        F.try_divide(F.covar_pop(sp, wt).over(w), F.sqrt(F.var_pop(sp).over(w) * F.var_pop(wt).over(w))).alias("r"), "_chunk", "_halo"))
    ind = ((F.round("speed_slope", 9) < 0) & (F.round("waits_slope", 9) > 0) & (F.round("r", 9) < 0))
    return out.withColumn("indicator", F.coalesce(ind, F.lit(False)).cast("int"))


def incident_windows(incidents: DataFrame, length_minutes: int = 60, t_col: str = "s") -> DataFrame:
    """Incident at T → ('incident', T-len, T) and ('baseline', T-2len, T-len)."""
    T = F.col(t_col)
    L = F.expr(f"INTERVAL {length_minutes} MINUTES")
    return incidents.select("cluster", "incident_id", F.inline(F.array(
        F.struct(F.lit("incident").alias("interval"), (T - L).alias("s"), T.alias("f")),
        F.struct(F.lit("baseline").alias("interval"), (T - L - L).alias("s"), (T - L).alias("f")))))


# ---------------------------------------------------------------- J3, J4, J9
def to_long(df: DataFrame, key: Sequence[str], metrics: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.unpivot([*key, ts], list(metrics), "metric", "value").withColumn("value", F.col("value").cast("double"))


def align_series(longs: Sequence[DataFrame], key: Sequence[str], metrics: Sequence[str],
                 grain: str = "hour", ts: str = "ts") -> DataFrame:
    """Union long (key, ts, metric, value) tables, one row per (key, interval), one column per metric.

    The pivot uses the explicit metric list, so it is a single conditional aggregation.
    """
    u = longs[0]
    for other in longs[1:]:
        u = u.unionByName(other)
    return (u.groupBy(*key, bucket(ts, grain).alias(ts)).pivot("metric", list(metrics))
             .agg(F.first("value")))


def align_series_asof(left: DataFrame, right: DataFrame, key: Sequence[str], value_cols: Sequence[str],
                      tolerance_minutes: int, ts: str = "ts", bucket_grain: str = "hour") -> DataFrame:
    """For each left row, the latest right row with right.ts <= left.ts within the tolerance
    (of right rows with one timestamp, the one with the largest values).

    Inside a (key, bucket) a window finds it; a left row that no right row of its bucket precedes takes
    the last one of the earlier buckets, carried forward over one row per bucket. Any tolerance will do,
    and no row is replicated.
    Output: left columns + right_ts + value columns (NULL when none within tolerance).
    """
    key = list(key)
    lcols = left.columns
    b = bucket(ts, bucket_grain)
    found = F.struct(F.col(ts).alias("ts"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(value_cols)])
    r = right.select(*key, b.alias("_b"), F.col(ts).alias("_at"), F.lit(0).alias("_side"), found.alias("_right"))
    row = F.struct(*[F.col(c) for c in lcols if c not in key])
    u = r.unionByName(left.select(*key, b.alias("_b"), F.col(ts).alias("_at"), F.lit(1).alias("_side"), row.alias("_left")), allowMissingColumns=True)
    w = Window.partitionBy(*key, "_b").orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    inside = u.withColumn("_in", F.last("_right", ignorenulls=True).over(w)).filter(F.col("_side") == 1)
    # one row a bucket: the last right row of all buckets before it
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = u.groupBy(*key, "_b").agg(F.max("_right").alias("_last")).select(
        *key, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    out = inside.join(carry, [*key, "_b"], "left").withColumn("_found", F.coalesce("_in", "_carry"))
    ok = F.col("_found.ts") >= F.col("_at") - F.expr(f"INTERVAL {tolerance_minutes} MINUTES")
    return out.select(*[F.col(c) if c in key else F.col(f"_left.{c}").alias(c) for c in lcols],
                      F.when(ok, F.col("_found.ts")).alias("right_ts"),
                      *[F.when(ok, F.col(f"_found.v{i}")).alias(c) for i, c in enumerate(value_cols)])


def samples_in_interval(samples: DataFrame, intervals: DataFrame, s: str = "start_ts", f: str = "finish_ts",
                        ts: str = "ts", bucket_grain: str = "day",
                        interval_cols: Sequence[str] = ()) -> DataFrame:
    """Attach to each sample every interval with s <= ts <= f (inner).

    Intervals are exploded into the buckets they cover, turning the range join into an
    equi-join on the bucket plus a residual filter; AQE broadcasts the interval side
    when its measured size is small and shuffles both sides otherwise.
    """
    step = F.expr(f"INTERVAL 1 {bucket_grain.upper()}")
    iv = intervals.withColumn("_b", F.explode(F.sequence(bucket(s, bucket_grain), bucket(f, bucket_grain), step)))
    sm = samples.withColumn("_b", bucket(ts, bucket_grain))
    j = sm.join(iv.select("_b", s, f, *interval_cols), "_b")
    return j.filter((F.col(ts) >= F.col(s)) & (F.col(ts) <= F.col(f))).drop("_b")


# ---------------------------------------------------------------- B1-B7
def rolling_median(long: DataFrame, key: Sequence[str], minutes: int = 60, ts: str = "ts",
                   value: str = "value", chunk_minutes: int | None = None) -> DataFrame:
    """Trailing median over a RANGE frame of ``minutes`` per (key, metric), in time chunks
    with a halo, so that a long series is spread over many tasks."""
    dealt, w = in_chunks(long, list(key), minutes, ts, chunk_minutes)
    return without_halo(dealt.withColumn("med", F.percentile(F.col(value), 0.5).over(w)))


def group_medians(df: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact median of each column per key (mean of the middle two when even)."""
    return df.groupBy(*key).agg(*[F.median(F.col(c)).alias(c) for c in cols])


def minute_median_dirty(samples: DataFrame, key: Sequence[str] = ("cluster",), grain: str = "minute") -> DataFrame:
    """Per minute, exact medians of dirty_kb, dirty_pct, dirty_bg_pct, avail_mb, 2 decimals."""
    d = dirty_percent(available_memory(samples))
    cols = ["dirty_kb", "dirty_pct", "dirty_bg_pct", "avail_mb"]
    return d.groupBy(*key, bucket("ts", grain).alias("ts")).agg(
        *[F.round(F.median(F.col(c)), 2).alias(c) for c in cols], F.count(F.lit(1)).alias("n"))


def bounds_report(long: DataFrame, key: Sequence[str]) -> DataFrame:
    """Min / median / max / n of each metric over the interval."""
    return long.groupBy(*key, "metric").agg(
        F.min("value").alias("min"), F.median("value").alias("median"), F.max("value").alias("max"),
        F.count("value").alias("n"))

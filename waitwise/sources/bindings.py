"""Telemetry-shaped inputs derived from the driver tables.

The reference reads live database views and OS text logs. The test tables are a
TPC-H-like star schema plus an ``events`` stream, so every operator input is derived
from them here — deterministically, with the same rule as the DuckDB text in
``waitwise.plans.duck`` — so each query's work grows with the tables.

All derivations are narrow projections or one grouped aggregation; nothing is
collected. Money-like doubles with two decimals are carried as integer cents so
that both engines add them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the fixtures (the wait types are the reference's seven classes).
WAIT_TYPES = ["BufferPin", "Extension", "IO", "IPC", "Lock", "LWLock", "Timeout"]
EVENT_TO_WAIT = [("click", "IO"), ("view", "LWLock"), ("purchase", "Lock"), ("signup", "IPC")]
#: vmstat columns; memory in MB, ``intr`` is vmstat's column ``in`` (interrupts a second).
MEMORY_METRICS = ["swpd", "free", "buff", "cache"]
VMSTAT_METRICS = ["r", "b", *MEMORY_METRICS, "si", "so", "bi", "bo", "intr", "cs", "us", "sy", "id", "wa"]
RESOURCE_METRICS = ["numbackends", "temp_bytes", "rss_mb", "prepared"]
IOSTAT_METRICS = ["r_s", "w_s", "await_ms", "util"]
CLUSTER_METRICS = ["calls", "nrows", "speed", "waits"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (lazy). Listed anew on every call, so files appended since are read too."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(ts: Column | str, grain: str) -> Column:
    """Truncate a TIMESTAMP_NTZ to the grain, independent of the session time zone.

    (``date_trunc`` would go through TIMESTAMP in the session zone, which moves local
    times that fall into a daylight-saving gap.)
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    zero = F.lit(0)
    parts = {
        "second": (F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), F.floor(F.second(c))),
        "minute": (F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), zero),
        "hour": (F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), zero, zero),
        "day": (F.year(c), F.month(c), F.dayofmonth(c), zero, zero, zero),
        "month": (F.year(c), F.month(c), F.lit(1), zero, zero, zero),
    }[grain]
    return F.make_timestamp_ntz(*parts)


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a TIMESTAMP_NTZ read as UTC (no session-zone dependence)."""
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)


def _tag(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def wait_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wait sample per event: (cluster, ts, queryid, dbname, rolname, type, event, cents)."""
    ev = table(spark, sf_dir, "events")
    et, uid = F.col("event_type"), F.col("user_id")
    wtype = F.lit("Timeout")
    for src, dst in reversed(EVENT_TO_WAIT):
        wtype = F.when(et == src, dst).otherwise(wtype)
    return ev.select(
        "event_id",
        "ts",
        _tag("pg", uid % 3).alias("cluster"),
        uid.alias("queryid"),
        _tag("db", uid % 5).alias("dbname"),
        _tag("role", uid % 2).alias("rolname"),
        wtype.alias("wait_event_type"),
        F.concat(et, F.lit("_"), (uid % 3).cast("string")).alias("wait_event"),
        et.alias("event_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def cluster_series(spark: SparkSession, sf_dir: str, grain: str = "hour") -> DataFrame:
    """Per (cluster, interval): calls, nrows, speed = calls + nrows, waits and waits by type."""
    ws = wait_samples(spark, sf_dir)
    by_type = [F.count(F.when(F.col("wait_event_type") == t, 1)).alias(f"waits_{t}") for t in WAIT_TYPES]
    agg = ws.groupBy("cluster", bucket("ts", grain).alias("ts")).agg(
        F.countDistinct("queryid").alias("calls"),
        F.expr("sum(cents) div 100").alias("nrows"),
        F.count(F.lit(1)).alias("waits"),
        *by_type,
    )
    return agg.withColumn("speed", F.col("calls") + F.col("nrows"))


def _memory_aggs() -> list[Column]:
    """Memory, swap and interrupt columns of a vmstat interval."""
    return [F.expr(e).alias(c) for c, e in (
        ("swpd", "sum(queryid) % 4096"), ("free", "16384 - sum(event_id) % 8192"), ("buff", "64 + max(cents) % 512"),
        ("cache", "4096 + (sum(cents) div 100) % 4096"), ("si", "count(CASE WHEN event_type = 'error' THEN 1 END) * (1 + max(queryid) % 5)"),
        ("so", "count(CASE WHEN event_type IN ('error', 'purchase') THEN 1 END)"), ("intr", "100 * count(1) + min(queryid) % 100"))]


def vmstat_series(spark: SparkSession, sf_dir: str, grain: str = "hour") -> DataFrame:
    """Per (cluster, interval) vmstat-like integer columns."""
    ws = wait_samples(spark, sf_dir)
    et = F.col("event_type")
    agg = ws.groupBy("cluster", bucket("ts", grain).alias("ts")).agg(
        F.count(F.lit(1)).alias("r"),
        F.count(F.when(et == "error", 1)).alias("b"),
        F.expr("least(100, sum(cents) div (100 * count(1)))").alias("us"),
        F.expr("least(100, 5 * count(CASE WHEN event_type = 'click' THEN 1 END))").alias("sy"),
        (F.countDistinct("queryid") * 100000).alias("cs"),
        F.expr("coalesce(sum(CASE WHEN event_type = 'view' THEN cents END) div 100, 0)").alias("bi"),
        F.expr("coalesce(sum(CASE WHEN event_type = 'purchase' THEN cents END) div 100, 0)").alias("bo"),
        *_memory_aggs(),
    )
    return agg.select(
        "cluster", "ts", "r", "b", "us", "sy",
        F.greatest(F.lit(0).cast("bigint"), 100 - F.col("us") - F.col("sy")).alias("id"),
        F.expr("100 * b div r").alias("wa"),
        "cs", "bi", "bo", *MEMORY_METRICS, "si", "so", "intr",
    )


def aligned_series(spark: SparkSession, sf_dir: str, grain: str = "hour") -> DataFrame:
    """cluster_series ⋈ vmstat_series on (cluster, ts), computed in ONE aggregation.

    Both series come from the same samples and the same (cluster, interval) key, so the
    join is replaced by a single grouped aggregation: one scan, one shuffle.
    """
    return aligned_from_samples(wait_samples(spark, sf_dir), grain)


def aligned_from_samples(ws: DataFrame, grain: str = "hour") -> DataFrame:
    """The aligned series of any (e.g. time-filtered) wait-sample DataFrame."""
    et = F.col("event_type")
    by_type = [F.count(F.when(F.col("wait_event_type") == t, 1)).alias(f"waits_{t}") for t in WAIT_TYPES]
    agg = ws.groupBy("cluster", bucket("ts", grain).alias("ts")).agg(
        F.countDistinct("queryid").alias("calls"),
        F.expr("sum(cents) div 100").alias("nrows"),
        F.count(F.lit(1)).alias("waits"),
        *by_type,
        F.count(F.when(et == "error", 1)).alias("b"),
        F.expr("least(100, sum(cents) div (100 * count(1)))").alias("us"),
        F.expr("least(100, 5 * count(CASE WHEN event_type = 'click' THEN 1 END))").alias("sy"),
        F.expr("coalesce(sum(CASE WHEN event_type = 'view' THEN cents END) div 100, 0)").alias("bi"),
        F.expr("coalesce(sum(CASE WHEN event_type = 'purchase' THEN cents END) div 100, 0)").alias("bo"),
        *_memory_aggs(),
    )
    return agg.select(
        "cluster", "ts", "calls", "nrows", "waits", *[f"waits_{t}" for t in WAIT_TYPES],
        (F.col("calls") + F.col("nrows")).alias("speed"),
        F.col("waits").alias("r"), "b", "us", "sy",
        F.greatest(F.lit(0).cast("bigint"), 100 - F.col("us") - F.col("sy")).alias("id"),
        F.expr("100 * b div waits").alias("wa"),
        (F.col("calls") * 100000).alias("cs"), "bi", "bo", *MEMORY_METRICS, "si", "so", "intr")


def iostat_series(spark: SparkSession, sf_dir: str, grain: str = "hour") -> DataFrame:
    """Per (cluster, device, interval) iostat-like columns; device = 'dev' || user_id % 4."""
    return iostat_from_samples(wait_samples(spark, sf_dir), grain)


def iostat_from_samples(ws: DataFrame, grain: str = "hour") -> DataFrame:
    """The iostat series of any (e.g. time-filtered) wait-sample DataFrame."""
    ws = ws.withColumn("device", _tag("dev", F.col("queryid") % 4))
    et = F.col("event_type")
    return ws.groupBy("cluster", "device", bucket("ts", grain).alias("ts")).agg(
        F.count(F.when(et == "view", 1)).alias("r_s"),
        F.count(F.when(et == "purchase", 1)).alias("w_s"),
        F.max("cents").alias("await_ms"),
        F.expr("least(100, sum(cents) div (100 * count(1)))").alias("util"),
    )


def resource_series(spark: SparkSession, sf_dir: str, grain: str = "hour") -> DataFrame:
    """Per (cluster, interval) what can leak: backends, temporary bytes so far, resident memory, prepared transactions."""
    per = wait_samples(spark, sf_dir).groupBy("cluster", bucket("ts", grain).alias("ts")).agg(
        F.countDistinct("queryid").alias("numbackends"),
        F.expr("coalesce(sum(CASE WHEN event_type = 'view' THEN cents END), 0) * 1024").alias("_temp"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("_rss"),
        F.count(F.when(F.col("event_type") == "signup", 1)).alias("prepared"))
    so_far = Window.partitionBy("cluster").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)   # one row an interval
    return per.select("cluster", "ts", "numbackends", F.sum("_temp").over(so_far).alias("temp_bytes"),
                      (F.lit(512) + F.sum("_rss").over(so_far)).alias("rss_mb"), "prepared")


def host_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each host with their size: (host, table_name, size_mb)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("host"), _tag("t", F.col("l_partkey") % 10).alias("table_name")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")) * 8).alias("size_mb"))


def order_speed(spark: SparkSession, sf_dir: str, grain: str = "month") -> DataFrame:
    """Speed on the clock of ``buffer_series``: (ts, calls, nrows, speed) of the orders of each month."""
    o = table(spark, sf_dir, "orders")
    per = o.groupBy(bucket("o_orderdate", grain).alias("ts")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("o_custkey").alias("nrows"))
    return per.withColumn("speed", F.col("calls") + F.col("nrows"))


def dirty_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-second dirty-page inputs per event (kernel counters and settings)."""
    ev = table(spark, sf_dir, "events")
    uid, eid = F.col("user_id"), F.col("event_id")
    return ev.select(
        "ts",
        _tag("pg", uid % 3).alias("cluster"),
        F.round(F.col("value") * 100).cast("bigint").alias("nr_dirty"),
        ((uid % 3) * 10).alias("dirty_ratio"),
        F.when(uid % 5 == 0, F.lit(268435456)).otherwise(F.lit(0)).cast("bigint").alias("dirty_bytes"),
        ((uid % 2) * 10).alias("dirty_bg_ratio"),
        F.when(uid % 7 == 0, F.lit(134217728)).otherwise(F.lit(0)).cast("bigint").alias("dirty_bg_bytes"),
        F.when(eid % 7 == 0, F.lit(None)).otherwise(eid + 1000000).cast("bigint").alias("mem_available_kb"),
        (eid + 300000).alias("mem_free_kb"),
        (eid + 500000).alias("cached_kb"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("aid"), F.col("c_nationkey").alias("bid"),
                    F.col("c_acctbal").alias("abalance"))


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("bid"))


def tellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tid"),
                                                   F.col("s_nationkey").alias("bid"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to their customer's branch: (bid, aid, delta, mtime)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("bid"), F.col("o_custkey").alias("aid"),
        F.col("o_totalprice").alias("delta"), F.col("o_orderdate").cast("timestamp_ntz").alias("mtime"))


def buffer_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared-buffer block counters per month of lineitem ship dates."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(bucket("l_shipdate", "month").alias("ts")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("blks_hit"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("blks_read"),
        F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("blks_dirtied"),
        F.count(F.when(F.col("l_discount") >= 0.05, 1)).alias("blks_written"),
    )


def load_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One load-test pass per day of events: (test_id, pass_counter, start, finish, load)."""
    ev = table(spark, sf_dir, "events")
    days = ev.groupBy(bucket("ts", "day").alias("start_ts")).agg(
        F.countDistinct("user_id").alias("load"))
    # pass number = days since the first day (scalar subquery; no global window)
    first_day = days.select(F.min("start_ts")).scalar()
    return days.select(
        F.lit(1).alias("test_id"),
        (F.datediff(F.col("start_ts"), first_day) + 1).cast("int").alias("pass_counter"),
        "start_ts",
        (F.col("start_ts") + F.expr("INTERVAL 23 HOURS")).alias("finish_ts"),
        "load",
    )


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement texts sampled with each event: (ts, queryid, query)."""
    ev = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    scen = F.concat(F.lit("select scenario"), (uid % 3 + 1).cast("string"),
                    F.lit("() /* "), F.col("event_type"), F.lit(" */"))
    plain = F.concat(F.lit("SELECT * FROM t"), uid.cast("string"), F.lit(" WHERE kind = '"),
                     F.col("event_type"), F.lit("'"))
    return ev.select("ts", uid.alias("queryid"),
                     F.when(uid % 10 == 0, scen).otherwise(plain).alias("query"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server settings snapshot per host (supplier): long form (host, name, setting, pending_restart)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    h = F.col("s_suppkey")
    wide = s.select(
        h.alias("host"),
        F.when(h % 3 == 0, F.lit(4.0)).otherwise(F.lit(1.1)).alias("random_page_cost"),
        F.when(h % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("is_ssd"),
        F.round(F.col("s_acctbal") * 10).alias("effective_cache_size_mb"),
        F.lit(8192.0).alias("free_mb"),
        F.lit(4096.0).alias("shared_buffers_mb"),
        ((h % 8) * 4 + 4).cast("double").alias("work_mem_mb"),
        (F.when(h % 5 == 0, F.lit(0.2)).otherwise(F.lit(0.05))).alias("autovacuum_vacuum_scale_factor"),
    )
    names = ["random_page_cost", "is_ssd", "effective_cache_size_mb", "free_mb", "shared_buffers_mb",
             "work_mem_mb", "autovacuum_vacuum_scale_factor"]
    long = wide.unpivot("host", names, "name", "setting")
    return long.withColumn("pending_restart", (F.col("name") == "shared_buffers_mb") & (F.col("host") % 11 == 0))


def kernel_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-test vm.* kernel parameters (wide), one row per load pass."""
    p = load_passes(spark, sf_dir)
    return p.select(
        "test_id", "pass_counter",
        (F.col("load") % 40 + 10).alias("vm_dirty_ratio"),
        (F.col("load") % 10 + 5).alias("vm_dirty_background_ratio"),
        F.lit(60).alias("vm_swappiness"),
        (F.col("pass_counter") * 100).alias("vm_dirty_expire_centisecs"),
    )

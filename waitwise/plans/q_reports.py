"""Catalogue: report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitwise.functions.bands import R2_BANDS, WEIGHT_BANDS, band_sql
from waitwise.functions.tdist import p_value_duck
from waitwise.operators import reports as R
from waitwise.operators import stats
from waitwise.operators import timeseries as T
from waitwise.plans.duck import with_bindings
from waitwise.plans.q_stats import _D1_SELECT, _wait_sql
from waitwise.plans.registry import register
from waitwise.sources import bindings as B

GRAIN = "hour"
ROLL_MINUTES = 180
RAM_MB = 16384


@register("top_k_latest", "B8", with_bindings(
    "SELECT event_id, ts, cluster, queryid, wait_event_type FROM wait_samples ORDER BY ts DESC, event_id DESC LIMIT 3",
    "wait_samples"))
def q_top_k_latest(spark, sf):
    """The three latest samples (a top-k report: the limit is the feature)."""
    ws = B.wait_samples(spark, sf).select("event_id", "ts", "cluster", "queryid", "wait_event_type")
    return R.top_k_latest(ws, 3, tiebreak=["event_id"])


# One ledger of all three inputs, one grouped pass per branch.
_LEDGER = """
  SELECT bid, 'home' AS kind, NULL AS aid, NULL AS amount, NULL AS moved_at FROM branches
  UNION ALL SELECT bid, 'held', aid, abalance, NULL FROM accounts
  UNION ALL SELECT bid, 'moved', aid, delta, mtime FROM history, (SELECT max(o_orderdate) AS today FROM orders)
  WHERE mtime + INTERVAL 7 DAY > today"""

_PER_BRANCH = """
  SELECT bid, count(aid) FILTER (WHERE kind = 'held') AS account_count, sum(amount) FILTER (WHERE kind = 'held') AS total_balance,
         avg(amount) FILTER (WHERE kind = 'held') AS avg_balance, count(*) FILTER (WHERE kind = 'moved') AS transaction_count,
         coalesce(sum(amount) FILTER (WHERE kind = 'moved'), 0.0) AS net_flow,
         count(DISTINCT aid) FILTER (WHERE kind = 'moved') AS active_accounts,
         CAST(date_diff('second', min(moved_at), max(moved_at)) // 86400 AS BIGINT) AS activity_days
  FROM ledger GROUP BY bid HAVING bool_or(kind = 'home')"""


def _b9_sql(tail: str) -> str:
    return with_bindings(f"""
SELECT *, coalesce(total_balance / nullif(transaction_count, 0), 0.0) AS balance_per_transaction
FROM (WITH ledger AS ({_LEDGER}) {_PER_BRANCH}) per_branch {tail}""", "branches", "accounts", "history")


def _b9_inputs(spark, sf):
    return B.branches(spark, sf), B.accounts(spark, sf), B.history(spark, sf)


def _as_of(spark, sf):
    """``now()`` of the scenario: the latest order date (one column of one scan, partial max)."""
    return B.table(spark, sf, "orders").select(F.max("o_orderdate").cast("timestamp_ntz")).scalar()


@register("branch_activity", "B9", _b9_sql("WHERE total_balance > 0 ORDER BY total_balance DESC, bid LIMIT 100"))
def q_branch_activity(spark, sf):
    """The OLAP scenario: per-branch balances with 7-day activity, top 100 by balance."""
    return R.branch_activity(*_b9_inputs(spark, sf), as_of=_as_of(spark, sf))


@register("branch_activity_join", "J2", _b9_sql(""))
def q_branch_activity_join(spark, sf):
    """The left-join part of the OLAP scenario for every branch (unmatched → 0)."""
    return R.branch_activity(*_b9_inputs(spark, sf), as_of=_as_of(spark, sf), limit=None)


@register("point_lookup_join", "J1", with_bindings("""
SELECT a.aid, a.bid, a.abalance, n.n_name
FROM accounts a JOIN nation n ON a.bid = n.n_nationkey
WHERE a.aid IN (SELECT aid FROM history WHERE mtime > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY)""",
    "accounts", "history"))
def q_point_lookup_join(spark, sf):
    """Accounts active in the last 30 days (semi-join on the id set) with their branch."""
    h = B.history(spark, sf)
    recent = h.filter(F.col("mtime") > _as_of(spark, sf) - F.expr("INTERVAL 30 DAYS"))
    br = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("bid"), "n_name")
    return R.point_lookup_join(B.accounts(spark, sf), br, recent)


def _pareto_sql(item: str, value: str = "count(*)") -> str:
    return f"""
SELECT cluster, {item}, total, share, cum_share, round(cum_share - share, 9) < 0.8 AS vital
FROM (SELECT cluster, {item}, total, total / sum(total) OVER (PARTITION BY cluster) AS share,
             sum(total) OVER (PARTITION BY cluster ORDER BY total DESC, {item} ROWS UNBOUNDED PRECEDING)
               / sum(total) OVER (PARTITION BY cluster) AS cum_share
      FROM (SELECT cluster, {item}, {value} AS total FROM wait_samples GROUP BY ALL) t) p"""


@register("pareto", "B11", with_bindings(_pareto_sql("wait_event"), "wait_samples"))
def q_pareto(spark, sf):
    """Pareto of wait events per cluster."""
    return R.pareto(B.wait_samples(spark, sf), ["cluster"], ["wait_event"])


@register("pareto_wait_types", "D10", with_bindings(_pareto_sql("wait_event_type"), "wait_samples"))
def q_pareto_wait_types(spark, sf):
    return R.pareto(B.wait_samples(spark, sf), ["cluster"], ["wait_event_type"])


@register("pareto_queries", "D11", with_bindings(_pareto_sql("queryid", "sum(cents)"), "wait_samples"))
def q_pareto_queries(spark, sf):
    """Pareto of statements by total wait time (cents) per cluster."""
    return R.pareto(B.wait_samples(spark, sf), ["cluster"], ["queryid"], "cents")


@register("pareto_queries_by_owner", "D12", with_bindings(
    _pareto_sql("queryid, dbname, rolname", "sum(cents)").replace("ORDER BY total DESC, queryid, dbname, rolname",
                                                                  "ORDER BY total DESC, queryid, dbname, rolname"),
    "wait_samples"))
def q_pareto_queries_by_owner(spark, sf):
    return R.pareto(B.wait_samples(spark, sf), ["cluster"], ["queryid", "dbname", "rolname"], "cents")


@register("load_window", "B12", with_bindings("""
SELECT test_id, min(start_ts) AS s, max(finish_ts) AS f FROM load_passes
WHERE test_id = (SELECT max(test_id) FROM load_passes) AND pass_counter >= 6 GROUP BY test_id""", "load_passes"))
def q_load_window(spark, sf):
    return R.load_window(B.load_passes(spark, sf))


# Fixed values (ours): advice per wait type, crossed with the weight bands by rule.
ADVICE = {
    "IO": "check storage latency, shared buffers and the plans reading most blocks",
    "IPC": "check parallel query settings and replication/background worker pressure",
    "Lock": "find the blocking sessions and shorten the transactions holding row/table locks",
    "LWLock": "look for buffer-mapping or WAL insert contention; review connection count",
    "Timeout": "review sleeps, vacuum delay and statement/lock timeouts",
}


def activity_rows() -> list[tuple[str, float, float, str, str]]:
    rows = []
    edges = [b[0] for b in WEIGHT_BANDS]
    for t, advice in ADVICE.items():
        for i, (lo, band) in enumerate(WEIGHT_BANDS):
            hi = 1e300 if i == 0 else edges[i - 1]
            rows.append((t, -1e300 if lo is None else lo, hi, band, f"{band}: {advice}"))
    return rows


def _act_values() -> str:
    return ", ".join(f"('{t}', {lo!r}, {hi!r}, '{b}', '{a}')" for t, lo, hi, b, a in activity_rows())


@register("activities_for_band", "J7", _wait_sql(f"""
SELECT d.cluster, d.wait_event_type, d.weight, a.band, a.activity
FROM ({_D1_SELECT}) d JOIN (VALUES {_act_values()}) a(wait_event_type, lo, hi, band, activity)
  ON d.wait_event_type = a.wait_event_type AND d.weight >= a.lo AND d.weight < a.hi"""))
def q_activities_for_band(spark, sf):
    """Recommended activity for each wait type's weight band (broadcast range join)."""
    d1 = stats.wait_analysis_3stage(B.cluster_series(spark, sf, GRAIN), ["cluster"], B.WAIT_TYPES)
    dim = spark.createDataFrame(activity_rows(), "wait_event_type string, lo double, hi double, band string, "
                                                 "activity string")
    return R.activities_for_band(d1.select("cluster", "wait_event_type", F.round("weight", 9).alias("weight")),
                                 dim)


SCENARIOS = [(1, 0.7), (2, 0.2), (3, 0.1)]  # fixed values: scenario weights of the load test


def _scen_values() -> str:
    return ", ".join(f"({s}, CAST({w} AS DOUBLE))" for s, w in SCENARIOS)


_J8_SQL = f"""
SELECT s.scenario, s.weight, q.queryid
FROM (VALUES {_scen_values()}) s(scenario, weight)
JOIN (SELECT DISTINCT queryid, CAST(regexp_extract(query, 'select scenario(\\d+)', 1) AS INTEGER) AS scenario
      FROM query_texts WHERE regexp_extract(query, 'select scenario(\\d+)', 1) <> '') q ON s.scenario = q.scenario"""


def _j8(spark, sf):
    scen = spark.createDataFrame(SCENARIOS, "scenario int, weight double")
    return R.scenario_queries(scen, B.query_texts(spark, sf))


@register("scenario_queries", "J8", with_bindings(_J8_SQL, "query_texts"))
def q_scenario_queries(spark, sf):
    """Load-test scenarios mapped to the statements that call them."""
    return _j8(spark, sf)


@register("report_cluster_series", "D5", with_bindings(
    f"SELECT cluster, ts, speed, waits, {', '.join('waits_' + t for t in B.WAIT_TYPES)} FROM cluster_series", "cluster_series"))
def q_report_cluster_series(spark, sf):
    """Chart data: speed, waits and waits by type per cluster-hour."""
    return B.cluster_series(spark, sf, GRAIN).select(
        "cluster", "ts", "speed", "waits", *[f"waits_{t}" for t in B.WAIT_TYPES])


def _series_pivot_sql(table: str, key: str, metrics: list[str]) -> str:
    cols = ", ".join(f"max(med) FILTER (WHERE metric = '{m}') AS med_{m}" for m in metrics)
    return f"""
SELECT {key}, ts, {cols}
FROM (SELECT {key}, ts, metric,
             quantile_cont(value, 0.5) OVER (PARTITION BY {key}, metric ORDER BY ts
                 RANGE BETWEEN INTERVAL {ROLL_MINUTES} MINUTE PRECEDING AND CURRENT ROW) AS med
      FROM (SELECT {key}, ts, metric, CAST(value AS DOUBLE) AS value
            FROM {table} UNPIVOT (value FOR metric IN ({', '.join(metrics)}))) u) m
GROUP BY ALL"""


@register("report_vmstat_series", "D6", with_bindings(
    _series_pivot_sql("vmstat_series", "cluster", B.VMSTAT_METRICS), "vmstat_series"))
def q_report_vmstat_series(spark, sf):
    """Chart data: rolling medians of every vmstat metric, one column each."""
    long = T.rolling_median(T.to_long(B.vmstat_series(spark, sf, GRAIN), ["cluster"], B.VMSTAT_METRICS),
                            ["cluster", "metric"], ROLL_MINUTES)
    return R.pivot_series(long, ["cluster"], B.VMSTAT_METRICS)


@register("report_iostat_series", "D7", with_bindings(
    _series_pivot_sql("iostat_series", "cluster, device", B.IOSTAT_METRICS), "iostat_series"))
def q_report_iostat_series(spark, sf):
    """Chart data per device: rolling medians of the iostat metrics."""
    long = T.rolling_median(T.to_long(B.iostat_series(spark, sf, GRAIN), ["cluster", "device"], B.IOSTAT_METRICS),
                            ["cluster", "device", "metric"], ROLL_MINUTES)
    return R.pivot_series(long, ["cluster", "device"], B.IOSTAT_METRICS)


@register("report_buffer_cache", "D9", with_bindings("""
SELECT ts, blks_hit, blks_read, blks_dirtied, blks_written,
       CASE WHEN blks_hit + blks_read > 0 THEN blks_hit / (blks_hit + blks_read) END AS hit_ratio
FROM buffer_series""", "buffer_series"))
def q_report_buffer_cache(spark, sf):
    """Shared-buffer block counters per month with the hit ratio."""
    return R.buffer_cache(B.buffer_series(spark, sf))


_D9_METRICS = ["blks_hit", "blks_read", "blks_dirtied", "blks_written", "hit_ratio"]
_D9_JOIN = """SELECT b.*, CASE WHEN blks_hit + blks_read > 0 THEN blks_hit / (blks_hit + blks_read) END AS hit_ratio, o.speed
FROM buffer_series b JOIN order_speed o ON b.ts = o.ts"""


def _d9_speed_sql() -> str:
    parts = [f"""SELECT '{m}' AS x, 'speed' AS y, count(speed + {m}) AS n,
       CASE WHEN var_pop({m}) > 0 AND var_pop(speed) > 0 THEN corr({m}, speed) END AS r,
       CASE WHEN var_pop({m}) > 0 THEN regr_slope(speed, {m}) END AS slope FROM bs""" for m in _D9_METRICS]
    return f"""SELECT *, {band_sql('round(r2, 9)', R2_BANDS)} AS r2_band, coalesce(p < 0.05 AND round(r2, 9) >= 0.2, false) AS kept
FROM (SELECT *, pow(r, 2) AS r2, {p_value_duck('r', 'n')} AS p FROM ({' UNION ALL '.join(parts)}) a) b"""


@register("report_buffer_cache_speed", "D9", with_bindings(_d9_speed_sql(), "buffer_series", "order_speed", extra={"bs": _D9_JOIN}))
def q_report_buffer_cache_speed(spark, sf):
    """Block counters and hit ratio per month against the speed of the month."""
    return R.buffer_cache_speed(B.buffer_series(spark, sf), B.order_speed(spark, sf))


@register("report_sql_list", "D13", with_bindings("""
SELECT d.queryid, d.query FROM (SELECT queryid, arg_max(query, ts) AS query FROM query_texts GROUP BY 1) d
WHERE d.queryid IN (SELECT queryid FROM wait_samples)""",
    "query_texts", "wait_samples"))
def q_report_sql_list(spark, sf):
    """Texts of all statements of the interval (semi-join of the text dimension to the distinct ids)."""
    seen = B.wait_samples(spark, sf).select("queryid").distinct()
    return T.query_text_dim(B.query_texts(spark, sf)).join(seen, "queryid", "left_semi")


_D14_SQL = f"""SELECT p.ts, p.queryid, k.wait_event_type, p.calls, p.nrows, coalesce(c.waits, 0) AS waits,
       quantile_cont(p.calls, 0.5) OVER w AS med_calls, quantile_cont(p.nrows, 0.5) OVER w AS med_nrows,
       quantile_cont(coalesce(c.waits, 0), 0.5) OVER w AS med_waits
FROM (SELECT date_trunc('hour', ts) AS ts, queryid, count(*) AS calls, sum(cents) // 100 AS nrows FROM wait_samples GROUP BY 1, 2) p
JOIN (SELECT DISTINCT queryid, wait_event_type FROM wait_samples) k ON k.queryid = p.queryid
LEFT JOIN (SELECT date_trunc('hour', ts) AS ts, queryid, wait_event_type, count(*) AS waits FROM wait_samples GROUP BY 1, 2, 3) c
  ON c.ts = p.ts AND c.queryid = p.queryid AND c.wait_event_type = k.wait_event_type
WINDOW w AS (PARTITION BY p.queryid, k.wait_event_type ORDER BY p.ts RANGE BETWEEN INTERVAL {ROLL_MINUTES} MINUTE PRECEDING AND CURRENT ROW)"""


def _d14(spark, sf, statements=None):
    return R.query_history(B.wait_samples(spark, sf), B.WAIT_TYPES, GRAIN, ROLL_MINUTES, statements=statements)


@register("report_query_history", "D14", with_bindings(_D14_SQL, "wait_samples"))
def q_report_query_history(spark, sf):
    """History of calls, rows and waits of each statement against each wait type it met, with rolling medians."""
    return _d14(spark, sf)


@register("report_scenarios", "D16", with_bindings(
    f"SELECT j.scenario, h.* FROM ({_J8_SQL}) j JOIN ({_D14_SQL}) h ON j.queryid = h.queryid",
    "query_texts", "wait_samples"))
def q_report_scenarios(spark, sf):
    """Query history for every statement of every load-test scenario."""
    of = _j8(spark, sf).select("scenario", "queryid")
    return of.join(_d14(spark, sf, of), "queryid")


@register("report_load_curve", "D15", with_bindings("""
SELECT p.pass_counter, p.load, median(c.speed) AS speed_med, median(c.waits) AS waits_med, count(*) AS n
FROM cluster_series c JOIN load_passes p ON c.ts >= p.start_ts AND c.ts <= p.finish_ts
GROUP BY 1, 2""", "cluster_series", "load_passes"))
def q_report_load_curve(spark, sf):
    """Per load-test pass: load and median speed / waits of the hours inside it."""
    j = T.samples_in_interval(B.cluster_series(spark, sf, GRAIN), B.load_passes(spark, sf),
                              interval_cols=["pass_counter", "load"])
    return R.load_curve(j)


@register("report_dirty_pages", "D8", with_bindings(f"""
SELECT cluster, metric, min(v) AS min, median(v) AS median, max(v) AS max,
       CASE WHEN metric IN ('dirty_kb') THEN max(v) / 1024.0 / {RAM_MB} * 100 END AS pct_ram
FROM (SELECT cluster, ts, metric, v FROM (
        SELECT cluster, date_trunc('minute', ts) AS ts, round(median(dirty_kb), 2) AS dirty_kb,
               round(median(dirty_pct), 2) AS dirty_pct, round(median(dirty_bg_pct), 2) AS dirty_bg_pct,
               round(median(avail_mb), 2) AS avail_mb
        FROM (SELECT cluster, ts, nr_dirty * 4 AS dirty_kb,
                     CASE WHEN dirty_bytes > 0 THEN 0 WHEN dirty_ratio > 0 AND avail_kb * dirty_ratio // 100 > 0
                          THEN nr_dirty * 4 * 100 // (avail_kb * dirty_ratio // 100) ELSE 0 END AS dirty_pct,
                     CASE WHEN dirty_bg_bytes > 0 THEN 0 WHEN dirty_bg_ratio > 0 AND avail_kb * dirty_bg_ratio // 100 > 0
                          THEN nr_dirty * 4 * 100 // (avail_kb * dirty_bg_ratio // 100) ELSE 0 END AS dirty_bg_pct,
                     avail_kb // 1024 AS avail_mb
              FROM (SELECT *, coalesce(mem_available_kb, mem_free_kb + cached_kb) AS avail_kb FROM dirty_samples) d) x
        GROUP BY 1, 2) m
      UNPIVOT (v FOR metric IN (dirty_kb, dirty_pct, dirty_bg_pct, avail_mb))) u
GROUP BY 1, 2""", "dirty_samples"))
def q_report_dirty_pages(spark, sf):
    """Dirty-page statistics of the per-minute medians, with the peak dirty size as % of RAM."""
    m = T.minute_median_dirty(B.dirty_samples(spark, sf))
    long = T.to_long(m, ["cluster"], ["dirty_kb", "dirty_pct", "dirty_bg_pct", "avail_mb"])
    b = T.bounds_report(long, ["cluster"]).drop("n")
    pct = F.when(F.col("metric") == "dirty_kb", F.col("max") / 1024.0 / F.lit(float(RAM_MB)) * 100)
    return b.withColumn("pct_ram", pct)

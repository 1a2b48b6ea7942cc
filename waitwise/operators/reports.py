"""Report operators.

Scale notes
-----------
* ``branch_activity`` aggregates accounts per branch *before* joining the (small)
  branch table, so the big side is reduced by map-side partial aggregation and a
  branch holding a third of all accounts costs no more than any other; the
  COUNT(DISTINCT) is Spark's two-level expand aggregation, shuffled on (bid, aid).
* Pareto windows are partitioned by the report key (cluster). The items are
  statements, wait types or events, whose number per cluster is bounded by the
  statement-statistics capacity of the server, not by data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwise.operators import stats
from waitwise.operators.timeseries import in_chunks, without_halo
from waitwise.sources.bindings import bucket


def top_k_latest(df: DataFrame, k: int = 3, ts: str = "ts", tiebreak: Sequence[str] = ()) -> DataFrame:
    """The k latest rows (TakeOrderedAndProject: a per-partition heap, no full sort)."""
    return df.orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak]).limit(k)


def branch_activity(branches: DataFrame, accounts: DataFrame, history: DataFrame,
                    as_of: Column | None = None, days: int = 7, limit: int | None = 100) -> DataFrame:
    """B9 (+J2): per-branch balance summary joined to its recent transaction summary.

    ``as_of`` defaults to the latest ``mtime`` in ``history`` (a scalar subquery).
    Rows with total_balance > 0, ordered by total_balance desc then bid, first ``limit``.
    """
    if as_of is None:
        as_of = history.select(F.max("mtime")).scalar()
    acc = accounts.groupBy("bid").agg(
        F.count("aid").alias("account_count"), F.sum("abalance").alias("total_balance"),
        F.avg("abalance").alias("avg_balance"))
    bs = branches.select("bid").join(acc, "bid", "left").withColumn(
        "account_count", F.coalesce("account_count", F.lit(0).cast("bigint")))
    recent = history.filter(F.col("mtime") > as_of - F.expr(f"INTERVAL {days} DAYS"))
    ts = recent.groupBy("bid").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.sum("delta").alias("net_flow"),
        F.countDistinct("aid").alias("active_accounts"),
        F.min("mtime").alias("first_transaction"), F.max("mtime").alias("last_transaction"))
    j = bs.join(ts, "bid", "left")
    out = j.select(
        "bid", "account_count", "total_balance", "avg_balance",
        F.coalesce("transaction_count", F.lit(0).cast("bigint")).alias("transaction_count"),
        F.coalesce("net_flow", F.lit(0.0)).alias("net_flow"),
        F.coalesce("active_accounts", F.lit(0).cast("bigint")).alias("active_accounts"),
        F.expr("extract(DAY FROM last_transaction - first_transaction)").cast("bigint").alias("activity_days"),
        F.when(F.col("transaction_count") > 0, F.col("total_balance") / F.col("transaction_count"))
         .otherwise(F.lit(0.0)).alias("balance_per_transaction"))
    if limit is None:
        return out
    return out.filter(F.col("total_balance") > 0).orderBy(F.col("total_balance").desc(), "bid").limit(limit)


def point_lookup_join(accounts: DataFrame, branches: DataFrame, aids: DataFrame) -> DataFrame:
    """Accounts whose aid is in ``aids`` (semi-join) with their branch."""
    sel = accounts.join(aids.select("aid").distinct(), "aid", "left_semi")
    return sel.join(branches, "bid").select("aid", "bid", "abalance", *[c for c in branches.columns if c != "bid"])


def pareto(df: DataFrame, key: Sequence[str], item: Sequence[str], value: str | Column | None = None,
           cut: float = 0.8) -> DataFrame:
    """Per item total, share of the key's total, cumulative share (largest first,
    item as tiebreak) and ``vital`` = the items needed to reach ``cut``."""
    v = F.count(F.lit(1)) if value is None else F.sum(value)
    tot = df.groupBy(*key, *item).agg(v.alias("total"))
    w_all = Window.partitionBy(*key)
    w_cum = Window.partitionBy(*key).orderBy(F.col("total").desc(), *item).rowsBetween(Window.unboundedPreceding, 0)
    out = (tot.withColumn("share", F.col("total") / F.sum("total").over(w_all))
              .withColumn("cum_share", F.sum("total").over(w_cum) / F.sum("total").over(w_all)))
    return out.withColumn("vital", F.round(F.col("cum_share") - F.col("share"), 9) < F.lit(cut))


def load_window(passes: DataFrame, first_pass: int = 6) -> DataFrame:
    """Analysis window of the latest test: passes numbered >= first_pass."""
    latest = passes.select(F.max("test_id")).scalar()
    return (passes.filter((F.col("test_id") == latest) & (F.col("pass_counter") >= first_pass))
                  .groupBy("test_id").agg(F.min("start_ts").alias("s"), F.max("finish_ts").alias("f")))


def activities_for_band(findings: DataFrame, dim: DataFrame, value: str = "weight") -> DataFrame:
    """Range join of findings (wait type, value) to a small recommendation dimension
    (wait_event_type, lo, hi, band, activity) on lo <= value < hi. The dimension is a
    fixed table, so broadcasting it is bounded; the join is an equi-join on the type."""
    d = dim
    cond = ((findings.wait_event_type == d.wait_event_type) & (F.round(findings[value], 9) >= d.lo)
            & (F.round(findings[value], 9) < d.hi))
    return findings.join(d, cond).select(findings["*"], d.band, d.activity)


def scenario_queries(scenarios: DataFrame, texts: DataFrame) -> DataFrame:
    """Scenario ↔ queryid through the 'select scenarioN' call in the statement text."""
    t = texts.select("queryid", F.regexp_extract("query", r"select scenario(\d+)", 1).alias("_s")).filter("_s <> ''")
    t = t.select("queryid", F.col("_s").cast("int").alias("scenario")).distinct()
    return scenarios.join(t, "scenario")


def pivot_series(long: DataFrame, key: Sequence[str], metrics: Sequence[str], value: str = "med",
                 prefix: str = "med_", ts: str = "ts") -> DataFrame:
    """Long (key, ts, metric, value) → wide chart data with an explicit metric list."""
    w = long.groupBy(*key, ts).pivot("metric", list(metrics)).agg(F.first(value))
    return w.select(*key, ts, *[F.col(m).alias(prefix + m) for m in metrics])


def buffer_cache(series: DataFrame) -> DataFrame:
    """Block counters with hit ratio hit / (hit + read), NULL when both are 0."""
    tot = F.col("blks_hit") + F.col("blks_read")
    return series.withColumn("hit_ratio", F.when(tot > 0, F.col("blks_hit") / tot))


def buffer_cache_speed(series: DataFrame, speed: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Each block counter and the hit ratio against speed on the same clock: n, r, slope, p, r2 and its band."""
    key = list(key)
    both = buffer_cache(series).join(speed.select(*key, "ts", "speed"), [*key, "ts"])
    pairs = [(m, "speed") for m in ("blks_hit", "blks_read", "blks_dirtied", "blks_written", "hit_ratio")]
    return stats.metric_analysis_2stage(both, key, pairs)


def query_history(samples: DataFrame, wait_types: Sequence[str], grain: str = "hour", minutes: int = 180,
                  queryids: Sequence[int] | None = None, statements: DataFrame | None = None) -> DataFrame:
    """The history of each query against each wait type that it has met: per interval the calls and rows of
    the query and its waits of the type (0 in intervals without any), and their trailing medians over ``minutes``.

    ``queryids`` (or a frame ``statements`` with a queryid) and ``wait_types`` choose what is reported. Windows run
    over one row an interval and query, with a column a type; rows are dealt out to types afterwards, so sorts hold
    no row twice for its types.
    """
    if queryids is not None:
        samples = samples.filter(F.col("queryid").isin(list(queryids)))
    types = [f"_n{i}" for i in range(len(wait_types))]
    per = samples.groupBy(bucket("ts", grain).alias("ts"), "queryid").agg(
        F.count(F.lit(1)).alias("calls"), F.expr("sum(cents) div 100").alias("nrows"),
        *[F.count(F.when(F.col("wait_event_type") == t, 1)).alias(c) for t, c in zip(wait_types, types)])
    if statements is not None:
        per = per.join(statements.select("queryid"), "queryid", "left_semi")
    # one exchange and one sort serve the window in chunks and the one over a query's intervals
    dealt, w = in_chunks(per.repartition("queryid"), ["queryid"], minutes)
    meds = dealt.select("*", *[F.percentile(F.col(c), 0.5).over(w).alias(f"_med_{c}") for c in ("calls", "nrows", *types)])
    of_query = Window.partitionBy("queryid")                                    # one row an interval
    met = without_halo(meds).select("*", *[(F.max(c).over(of_query) > 0).alias(f"_met{c}") for c in types])
    by_type = F.array(*[F.when(F.col(f"_met{c}"), F.struct(F.lit(t).alias("t"), F.col(c).alias("n"), F.col(f"_med_{c}").alias("m")))
                        for t, c in zip(wait_types, types)])
    out = met.withColumn("_of", F.explode(F.array_compact(by_type)))
    return out.select("ts", "queryid", "calls", "nrows", F.col("_of.t").alias("wait_event_type"), F.col("_of.n").alias("waits"),
                      F.col("_med_calls").alias("med_calls"), F.col("_med_nrows").alias("med_nrows"), F.col("_of.m").alias("med_waits"))


def load_curve(samples_in_pass: DataFrame) -> DataFrame:
    """Per pass its load and the median speed / waits of the intervals inside it."""
    return samples_in_pass.groupBy("pass_counter", "load").agg(
        F.median("speed").alias("speed_med"), F.median("waits").alias("waits_med"),
        F.count(F.lit(1)).alias("n"))

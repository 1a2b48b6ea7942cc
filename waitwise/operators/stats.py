"""Correlation, regression and ranking operators.

Every many-pair statistic is computed in ONE grouped aggregation: each pair becomes
a covariance (plus one mean and variance per column, shared) over the aligned wide table,
and the per-pair results are turned into rows afterwards with ``inline``. There is
no self-join of a long metric table, so the work is one shuffle of partial
aggregates regardless of the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwise.functions.bands import (R2_BANDS, SIGNIFICANCE_ALPHA, TREND_BANDS, WEIGHT_BANDS,
                                      band_label)
from waitwise.functions.tdist import p_value, t_stat
from waitwise.sources.bindings import bucket, epoch_seconds

Pair = tuple[str, str]


def _guard(x: Column, y: Column, value: Column) -> Column:
    """NULL instead of NaN/error when either side is constant over the group."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), value)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r that is NULL (not an ANSI division error) for a constant side."""
    return _guard(x, y, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))))


def pair_stats(df: DataFrame, key: Sequence[str], pairs: Sequence[Pair], with_sums: bool = False) -> DataFrame:
    """Per key and (x, y) pair: n, Pearson r, least-squares y = intercept + slope*x, R².

    Output columns: *key, x, y, n, r, slope, intercept, r2 (+ sum_x, sum_y with ``with_sums``).

    The aggregation holds one mean and one population variance per column (shared by
    every pair using it) and one population covariance per pair; r, slope and
    intercept are derived afterwards. Nullable columns are masked pairwise (only
    rows where both sides are present count), non-nullable ones need no mask.
    """
    nullable = {f.name: f.nullable for f in df.schema.fields}
    # Built as SQL expression text: a wide aggregation written with Column objects costs
    # thousands of driver<->JVM calls to construct; the text form is one call per aggregate.
    aggs: dict[str, str] = {}      # alias -> aggregate expression text
    names: dict[tuple, str] = {}   # (kind, column, mask) -> alias

    def q(c: str) -> str:
        return "`" + c.replace("`", "``") + "`"

    def alias(kind: str, c: str, mask: str | None, expr: str) -> str:
        k = (kind, c, mask)
        if k not in names:
            names[k] = f"_{kind}{len(names)}"
            aggs[names[k]] = expr
        return names[k]

    def col_stats(c: str, other: str) -> tuple[str, str, str, str | None]:
        """(count, mean, var, sum) aggregate aliases for column c in a pair with ``other``."""
        mask = other if (nullable.get(c, True) or nullable.get(other, True)) else None
        raw = q(c) if mask is None else f"CASE WHEN {q(other)} IS NOT NULL THEN {q(c)} END"
        v = f"CAST({raw} AS DOUBLE)"
        out = (alias("n", c, mask, f"count({v})"), alias("m", c, mask, f"avg({v})"),
               alias("v", c, mask, f"var_pop({v})"),
               alias("s", c, mask, f"sum({raw})") if with_sums else None)
        return out

    structs: list[str] = []
    for x, y in pairs:
        nx, mx, vx, sx = col_stats(x, y)
        _, my, vy, sy = col_stats(y, x)
        cov = alias("c", f"{x}|{y}", None, f"covar_pop(CAST({q(x)} AS DOUBLE), CAST({q(y)} AS DOUBLE))")
        r = f"CASE WHEN {vx} > 0 AND {vy} > 0 THEN try_divide({cov}, sqrt({vx} * {vy})) END"
        slope = f"CASE WHEN {vx} > 0 THEN try_divide({cov}, {vx}) END"
        lit_x, lit_y = x.replace("'", "\\'"), y.replace("'", "\\'")
        fields = [f"'x', '{lit_x}'", f"'y', '{lit_y}'", f"'n', {nx}", f"'r', {r}", f"'slope', {slope}",
                  f"'intercept', {my} - ({slope}) * {mx}", f"'r2', pow({r}, 2)"]
        if with_sums:
            fields += [f"'sum_x', {sx}", f"'sum_y', {sy}"]
        structs.append("named_struct(" + ", ".join(fields) + ")")
    wide = df.groupBy(*key).agg(*[F.expr(f"{e} AS {a}") for a, e in aggs.items()])
    return wide.selectExpr(*[q(k) for k in key], "inline(array(" + ", ".join(structs) + "))")


def all_pairs(xs: Sequence[str], ys: Sequence[str] | None = None) -> list[Pair]:
    """x × y pairs, or the m(m-1)/2 unordered pairs of ``xs`` when ``ys`` is None."""
    if ys is None:
        return [(a, b) for i, a in enumerate(xs) for b in xs[i + 1:]]
    return [(a, b) for a in xs for b in ys if a != b]


def correlation(df: DataFrame, key: Sequence[str], pairs: Sequence[Pair]) -> DataFrame:
    """Pearson r per pair → *key, x, y, r, n."""
    return pair_stats(df, key, pairs).select(*key, "x", "y", "r", "n")


def regression_line(df: DataFrame, key: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """y = intercept + slope·x for each x → *key, x, y, slope, intercept, r2, n."""
    return pair_stats(df, key, [(x, y) for x in xs]).select(*key, "x", "y", "slope", "intercept", "r2", "n")


def correlation_significance(df: DataFrame, alpha: float = SIGNIFICANCE_ALPHA) -> DataFrame:
    """Adds t, two-sided p (n-2 df) and ``significant`` = p < alpha to rows with r, n."""
    return (df.withColumn("t", t_stat("r", "n"))
              .withColumn("p", p_value("r", "n"))
              .withColumn("significant", F.col("p") < F.lit(alpha)))


def correlation_by_sign(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sign label and rank by |r| within (key, sign), strongest first, pair as tiebreak."""
    sign = F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none")
    w = Window.partitionBy(*key, "sign").orderBy(F.abs(F.col("r")).desc(), "x", "y")
    return (df.filter(F.col("r").isNotNull()).withColumn("sign", sign)
              .withColumn("ord", F.row_number().over(w)))


def trend_line(df: DataFrame, key: Sequence[str], metrics: Sequence[str], ts: str = "ts",
               bands: list = TREND_BANDS) -> DataFrame:
    """C1 (+C4): y = intercept + slope·t per metric, t = minutes since the group's first sample.

    Also the trend coefficient K = slope of the min-max-scaled series on scaled time
    (= slope·(t_max - t_min)/(y_max - y_min)) and its band.
    Output: *key, metric, n, slope, intercept, r2, k, k_band.
    """
    w = Window.partitionBy(*key)
    t = (epoch_seconds(ts) - F.min(epoch_seconds(ts)).over(w)) / 60.0
    base = df.withColumn("_t", t)
    aggs, structs = [], []
    for i, m in enumerate(metrics):
        y = F.col(m).cast("double")
        tt = F.when(y.isNotNull(), F.col("_t"))
        aggs += [F.count(y).alias(f"n{i}"),
                 F.when(F.var_pop(tt) > 0, F.regr_slope(y, tt)).alias(f"s{i}"),
                 F.when(F.var_pop(tt) > 0, F.regr_intercept(y, tt)).alias(f"i{i}"),
                 F.pow(pearson(tt, y), 2).alias(f"q{i}"),
                 (F.max(tt) - F.min(tt)).alias(f"dt{i}"), (F.max(y) - F.min(y)).alias(f"dy{i}")]
        k = F.when(F.col(f"dy{i}") > 0, F.col(f"s{i}") * F.col(f"dt{i}") / F.col(f"dy{i}"))
        structs.append(F.struct(F.lit(m).alias("metric"), F.col(f"n{i}").alias("n"),
                                F.col(f"s{i}").alias("slope"), F.col(f"i{i}").alias("intercept"),
                                F.col(f"q{i}").alias("r2"), k.alias("k")))
    out = base.groupBy(*key).agg(*aggs).select(*key, F.inline(F.array(*structs)))
    return out.withColumn("k_band", band_label(F.round("k", 9), bands))


def r2_stage(df: DataFrame) -> DataFrame:
    """R² band label."""
    return df.withColumn("r2_band", band_label(F.round("r2", 9), R2_BANDS))


def weighted_wait_correlation(series: DataFrame, key: Sequence[str], wait_types: Sequence[str],
                              total: str = "waits") -> DataFrame:
    """Per wait type r(type, total), share of total, weight = r × share and its band.

    ``series`` is the aligned wide table with one ``waits_<type>`` column per type.
    Output: *key, wait_event_type, n, r, r2, share, weight, weight_band (types seen only).
    """
    cols = [f"waits_{t}" for t in wait_types]
    # one aggregation: pair moments and the column sums for the shares
    stats = pair_stats(series, key, [(c, total) for c in cols], with_sums=True)
    share = F.when(F.col("sum_y") > 0, F.col("sum_x") / F.col("sum_y"))
    return (stats.filter(F.col("sum_x") > 0)
            .select(*key, F.regexp_replace("x", "^waits_", "").alias("wait_event_type"), "n", "r", "r2",
                    share.alias("share"))
            .withColumn("weight", F.col("r") * F.col("share"))
            .withColumn("weight_band", band_label(F.round("weight", 9), WEIGHT_BANDS)))


def wait_analysis_3stage(series: DataFrame, key: Sequence[str], wait_types: Sequence[str],
                         alpha: float = SIGNIFICANCE_ALPHA, min_weight: float = 0.01,
                         min_r2: float = 0.2) -> DataFrame:
    """Significance → weight → R²; ``kept`` marks types passing all three stages."""
    w = weighted_wait_correlation(series, key, wait_types)
    w = r2_stage(correlation_significance(w, alpha))
    kept = (F.col("significant") & (F.round("weight", 9) >= min_weight) & (F.round("r2", 9) >= min_r2))
    return w.withColumn("kept", F.coalesce(kept, F.lit(False)))


def metric_analysis_2stage(series: DataFrame, key: Sequence[str], pairs: Sequence[Pair],
                           alpha: float = SIGNIFICANCE_ALPHA, min_r2: float = 0.2, means: bool = False) -> DataFrame:
    """Significance → R² for metric pairs; output *key, x, y, n, r, slope, p, r2, r2_band, kept
    (+ mean_y with ``means``)."""
    s = r2_stage(correlation_significance(pair_stats(series, key, pairs, with_sums=means), alpha))
    kept = F.coalesce(F.col("significant") & (F.round("r2", 9) >= min_r2), F.lit(False))
    more = [(F.col("sum_y") / F.col("n")).alias("mean_y")] if means else []
    return s.withColumn("kept", kept).select(*key, "x", "y", "n", "r", "slope", "p", "r2", "r2_band", "kept", *more)


def waits_vs_host(series: DataFrame, key: Sequence[str], pairs: Sequence[Pair], memory: Sequence[str],
                  cpu_cores: int, ram_mb: int) -> DataFrame:
    """D3: wait type × vmstat pairs; the slope also per CPU core, and for memory columns (MB) the share of
    RAM that they hold on average."""
    a = metric_analysis_2stage(series, key, pairs, means=True)
    share = F.when(F.col("y").isin(list(memory)), F.col("mean_y") / F.lit(float(ram_mb)))
    return a.withColumn("slope_per_cpu", F.col("slope") / F.lit(float(cpu_cores))).withColumn("ram_share", share).drop("mean_y")


#: D4's sections by the metric that is compared with the device: buffers, page cache, speed; all else is vmstat.
DEVICE_SECTIONS = {"buff": "buffering", "cache": "caching", "speed": "speed"}


def host_vs_device(aligned: DataFrame, key: Sequence[str], pairs: Sequence[Pair]) -> DataFrame:
    """Host metric × device metric pairs in sections, ranked by the priority index over all sections."""
    a = metric_analysis_2stage(aligned, key, pairs).filter(F.col("r").isNotNull())
    section = F.lit("vmstat")
    for metric, name in DEVICE_SECTIONS.items():
        section = F.when(F.col("x") == metric, name).otherwise(section)
    crit = {"abs_r": F.abs("r"), "r2": F.col("r2"), "one_minus_p": 1 - F.col("p")}
    return priority_index_wide(a.withColumn("section", section), key, ["x", "y"], crit)


def criteria_weights(dim: DataFrame) -> DataFrame:
    """C11: normalised weights w / sum(w) of a small (criterion, raw_weight) dimension."""
    total = dim.select(F.sum("raw_weight")).scalar()
    return dim.select("criterion", (F.col("raw_weight") / total).alias("w"))


def criteria_normalise(df: DataFrame, group: Sequence[str], item: Sequence[str],
                       criteria: Sequence[str]) -> DataFrame:
    """Min-max scaling of each criterion within ``group`` → *group, *item, criterion, z.

    A criterion with zero range scales to 0.
    """
    long = df.select(*group, *item, F.inline(F.array(*[
        F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("v")) for c in criteria])))
    w = Window.partitionBy(*group, "criterion")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    z = F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return long.withColumn("z", z).drop("v")


def priority_index(normalised: DataFrame, weights: DataFrame, group: Sequence[str],
                   item: Sequence[str]) -> DataFrame:
    """CPI = Σ w·z per item, ranked within the group (highest first, item tiebreak)."""
    j = normalised.join(weights, "criterion")
    cpi = j.groupBy(*group, *item).agg(F.sum(F.col("w") * F.col("z")).alias("cpi"))
    w = Window.partitionBy(*group).orderBy(F.round("cpi", 9).desc(), *item)
    return cpi.withColumn("ord", F.row_number().over(w))


def priority_index_wide(df: DataFrame, group: Sequence[str], item: Sequence[str],
                        criteria: dict[str, Column], weights: dict[str, float] | None = None) -> DataFrame:
    """C12+C13 in one pass over a wide table: min-max scale each criterion within ``group``
    (windows on the same partitioning), CPI = Σ w·z with normalised weights, ranked.

    Same result as criteria_normalise → priority_index, without the unpivot, the weight
    join and the join back to the items; adds ``cpi`` and ``ord`` to ``df``.
    """
    weights = weights or {c: 1.0 for c in criteria}
    total = float(sum(weights.values()))
    w = Window.partitionBy(*group)
    out = df
    cpi = None
    for name, expr in criteria.items():
        v = expr.cast("double")
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        z = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(F.lit(0.0))
        term = F.lit(weights[name] / total) * z
        cpi = term if cpi is None else cpi + term
    out = out.withColumn("cpi", cpi)
    rank = Window.partitionBy(*group).orderBy(F.round("cpi", 9).desc(), *item)
    return out.withColumn("ord", F.row_number().over(rank))


def sum_artifact_check(samples: DataFrame, key: Sequence[str], value_seconds: Column,
                       period_seconds: int, ts: str = "ts") -> DataFrame:
    """C14: summed parallel time / period per interval; >1.5 artefact, (1, 1.5] check logs, ≤1 fine.

    Returns per interval: *key, ts, total_s, ratio, verdict.
    """
    grain = {60: "minute", 3600: "hour", 86400: "day"}[period_seconds]
    per = samples.groupBy(*key, bucket(ts, grain).alias("ts")).agg(
        F.sum(value_seconds).alias("total_s"))
    ratio = F.col("total_s") / F.lit(float(period_seconds))
    verdict = (F.when(F.round(ratio, 9) > 1.5, "artefact").when(F.round(ratio, 9) > 1.0, "check raw logs")
               .otherwise("fine"))
    return per.withColumn("ratio", ratio).withColumn("verdict", verdict)


def part_of_whole_flag(pairs: DataFrame, dim: DataFrame) -> DataFrame:
    """Flags pairs where one metric is a component of the other (either order).

    ``dim`` has (part, whole).
    """
    d = (dim.select(F.least("part", "whole").alias("_a"), F.greatest("part", "whole").alias("_b"))
            .distinct().withColumn("is_part", F.lit(True)))
    p = pairs.withColumn("_a", F.least("x", "y")).withColumn("_b", F.greatest("x", "y"))
    return (p.join(d, ["_a", "_b"], "left").withColumn("is_part", F.coalesce("is_part", F.lit(False)))
             .drop("_a", "_b"))

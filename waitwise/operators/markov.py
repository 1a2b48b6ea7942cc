"""Markov-chain incident forecast.

State per (cluster, interval) = (correlation of OS load with waits, OS trend, wait
trend) encoded into one of 21·3·3 = 189 ids. Transitions are ``lag`` over the
per-cluster state series; counts, forgetting weights and probabilities are grouped
aggregations; the chain itself is a long table (cluster, from_state, to_state, p) of at
most 189² rows per cluster.

Risk within k steps is r_k = P_abs^k · 1_A, computed for every start state at once by
k (vector × matrix) steps, each a join on (cluster, to_state = state) and a
group-by: 189² multiply-adds per cluster and step, cheaper than squaring 189×189
matrices. Lineage is cut with a reliable checkpoint every few steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwise.operators.timeseries import in_chunks, without_halo
from waitwise.sources.bindings import bucket, epoch_seconds
from waitwise.session import cut_lineage

N_STATES = 189
CRITERIA = ["enough_transitions", "state_coverage", "incident_seen", "stable_matrix", "current_state_known"]


def _sign(c: Column) -> Column:
    return F.coalesce(F.signum(F.round(c, 9)).cast("int"), F.lit(0))


def state_inputs(aligned: DataFrame, os_metric: str = "us", wait_metric: str = "waits", minutes: int = 360,
                 key: Sequence[str] = ("cluster",)) -> DataFrame:
    """M1: rolling r(OS metric, waits), OS trend and wait trend (-1/0/1) per interval."""
    key = list(key)
    x, y = F.col(os_metric).cast("double"), F.col(wait_metric).cast("double")
    t = epoch_seconds("ts") / 60.0
    base, w = in_chunks(aligned.withColumn("_t", t), key, minutes)
    out = without_halo(base.select(
        *key, "ts",
        F.try_divide(F.covar_pop(x, y).over(w), F.sqrt(F.var_pop(x).over(w) * F.var_pop(y).over(w))).alias("r"),
        F.regr_slope(x, F.col("_t")).over(w).alias("_os"), F.regr_slope(y, F.col("_t")).over(w).alias("_wt"), "_chunk", "_halo"))
    return out.select(*key, "ts", F.round("r", 9).alias("r"), _sign(F.col("_os")).alias("os_trend"),
                      _sign(F.col("_wt")).alias("wait_trend"))


def state_id(inputs: DataFrame) -> DataFrame:
    """M2: state = (round(10 r) + 10)·9 + (os_trend + 1)·3 + (wait_trend + 1); NULL r counts as 0."""
    r10 = F.round(F.coalesce(F.col("r"), F.lit(0.0)) * 10).cast("int")
    return inputs.withColumn("state", (r10 + 10) * 9 + (F.col("os_trend") + 1) * 3 + (F.col("wait_trend") + 1))


def state_dimension(spark) -> DataFrame:
    """The 189 state descriptions (a generated dimension, not data)."""
    s = spark.range(N_STATES).select(F.col("id").cast("int").alias("state"))
    return s.select("state", ((F.col("state") / 9).cast("int") - 10).alias("r10"),
                    ((F.col("state") % 9 / 3).cast("int") - 1).alias("os_trend"),
                    (F.col("state") % 3 - 1).alias("wait_trend"))


def transitions(states: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """M3: (ts, from_state, to_state) for consecutive intervals of each cluster."""
    key = list(key)
    w = Window.partitionBy(*key).orderBy("ts")
    return (states.select(*key, "ts", F.lag("state").over(w).alias("from_state"), F.col("state").alias("to_state"))
                  .filter(F.col("from_state").isNotNull()))


def transition_frequencies(tr: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """M4: accumulated transition counts."""
    return tr.groupBy(*key, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def forgetting(tr: DataFrame, alpha: float = 0.05, as_of: Column | None = None,
               key: Sequence[str] = ("cluster",), drift: DataFrame | None = None,
               max_alpha: float = 0.5) -> DataFrame:
    """M5: exponentially forgotten counts w = Σ (1-α)^(age in days), age from ``as_of``
    (default: the latest transition). Derived, never mutated.

    Adaptive variant: with ``drift`` (per key, e.g. ``training_sufficiency`` output) each
    key forgets faster when its matrix drifts: α_key = min(max_alpha, α·(1 + drift)).
    """
    key = list(key)
    if as_of is None:
        as_of = tr.select(F.max("ts")).scalar()
    age = (epoch_seconds(as_of) - epoch_seconds("ts")) / 86400.0
    a = F.lit(alpha)
    if drift is not None:
        # one row per key: small next to the transitions, joined on the grouping key
        tr = tr.join(drift.select(*key, "drift"), key, "left")
        a = F.least(F.lit(max_alpha), a * (1 + F.coalesce(F.col("drift"), F.lit(0.0))))
    return tr.groupBy(*key, "from_state", "to_state").agg(F.sum(F.pow(1 - a, age)).alias("w"))


def transition_probabilities(freq: DataFrame, weight: str = "n", key: Sequence[str] = ("cluster",)) -> DataFrame:
    """M6: row-normalised matrix p = w / Σ_to w."""
    w = Window.partitionBy(*key, "from_state")
    return freq.select(*key, "from_state", "to_state", (F.col(weight) / F.sum(weight).over(w)).alias("p"))


def absorbing_states(states: DataFrame, triplet: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """States observed while the incident indicator is on (SURVEY §2.12 (6))."""
    key = list(key)
    on = triplet.filter(F.col("indicator") == 1).select(*key, "ts")
    return states.join(on, [*key, "ts"], "left_semi").select(*key, "state").distinct()


def absorbing_matrix(p: DataFrame, absorbing: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """M7: drop outgoing rows of absorbing states and add their self-loops of 1."""
    key = list(key)
    a = absorbing.select(*key, F.col("state").alias("from_state"))
    kept = p.join(a, [*key, "from_state"], "left_anti")
    loops = a.select(*key, "from_state", F.col("from_state").alias("to_state"), F.lit(1.0).alias("p"))
    return kept.unionByName(loops)


def risk_1min(p_abs: DataFrame, absorbing: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """M8: probability of being in an absorbing state at the next step, per start state."""
    key = list(key)
    a = absorbing.select(*key, F.col("state").alias("to_state"), F.lit(1.0).alias("_a"))
    j = p_abs.join(a, [*key, "to_state"], "left")
    return j.groupBy(*key, F.col("from_state").alias("state")).agg(
        F.sum(F.col("p") * F.coalesce(F.col("_a"), F.lit(0.0))).alias("risk"))


def risk_k(p_abs: DataFrame, absorbing: DataFrame, ks: Sequence[int] = (15, 30, 60),
           key: Sequence[str] = ("cluster",)) -> DataFrame:
    """M9: P(absorbed within k steps) for every start state and each k in ``ks``.

    r_0 = 1 on absorbing states; r_{j+1}(s) = Σ_t P(s, t) r_j(t). Only states with a
    positive risk are returned (the others cannot reach an incident state in k steps).

    One shuffle groups each cluster's chain (at most 189² rows plus its absorbing
    states — bounded by construction, independent of data volume); the k steps are
    then dense 189-vector products inside the group.
    """
    import numpy as np
    import pandas as pd

    key = list(key)
    kmax = max(ks)
    rows = p_abs.select(*key, "from_state", "to_state", "p", F.lit(False).alias("_abs")).unionByName(
        absorbing.select(*key, F.col("state").alias("from_state"), F.col("state").alias("to_state"),
                         F.lit(0.0).alias("p"), F.lit(True).alias("_abs")))
    key_fields = [f for f in p_abs.schema.fields if f.name in key]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_fields]
                       + ["state int", "k int", "risk double"])

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        states = np.union1d(pdf["from_state"].to_numpy(), pdf["to_state"].to_numpy())
        idx = {s: i for i, s in enumerate(states)}
        m = np.zeros((len(states), len(states)))
        edges = pdf[~pdf["_abs"]]
        np.add.at(m, (edges["from_state"].map(idx).to_numpy(), edges["to_state"].map(idx).to_numpy()),
                  edges["p"].to_numpy())
        r = np.zeros(len(states))
        r[pdf.loc[pdf["_abs"], "from_state"].map(idx).to_numpy()] = 1.0
        out = []
        for j in range(1, kmax + 1):
            r = m @ r
            if j in ks:
                keep = r > 0
                out.append(pd.DataFrame({"state": states[keep].astype("int32"), "k": np.int32(j), "risk": r[keep]}))
        res = pd.concat(out, ignore_index=True)
        for kcol in key:
            res.insert(0, kcol, pdf[kcol].iloc[0])
        return res[[*key, "state", "k", "risk"]]

    return rows.groupBy(*key).applyInPandas(step, schema)


def risk_k_joins(p_abs: DataFrame, absorbing: DataFrame, ks: Sequence[int] = (15, 30, 60),
                 key: Sequence[str] = ("cluster",), checkpoint_every: int = 10) -> DataFrame:
    """M9 as pure DataFrame steps (join + group-by per step, reliable checkpoints to cut
    lineage). Same result as ``risk_k``; kept for engines without Python workers."""
    key = list(key)
    r = absorbing.select(*key, "state", F.lit(1.0).alias("risk"))
    m = p_abs.select(*key, "from_state", F.col("to_state").alias("state"), "p")
    out = []
    for step in range(1, max(ks) + 1):
        r = m.join(r, [*key, "state"]).groupBy(*key, F.col("from_state").alias("state")).agg(
            F.sum(F.col("p") * F.col("risk")).alias("risk"))
        if step in ks:
            r = cut_lineage(r)
            out.append(r.withColumn("k", F.lit(step)))
        elif step % checkpoint_every == 0:
            r = cut_lineage(r)
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.select(*key, "state", "k", "risk")


def current_state(states: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """Latest state per cluster."""
    return states.groupBy(*key).agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("ts"))


def training_sufficiency(tr: DataFrame, key: Sequence[str] = ("cluster",), min_n: int = 100,
                         max_drift: float = 0.5) -> DataFrame:
    """Transitions, state coverage and drift = mean L1 distance between the row
    distributions estimated on the first and second half of each cluster's period."""
    key = list(key)
    wk = Window.partitionBy(*key)
    lo, hi = F.min(epoch_seconds("ts")).over(wk), F.max(epoch_seconds("ts")).over(wk)
    t = tr.withColumn("half", F.when(epoch_seconds("ts") < (lo + hi) / 2, 1).otherwise(2))
    cnt = t.groupBy(*key, "half", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    p = cnt.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*key, "half", "from_state")))
    p1 = p.filter("half = 1").select(*key, "from_state", "to_state", F.col("p").alias("p1"))
    p2 = p.filter("half = 2").select(*key, "from_state", "to_state", F.col("p").alias("p2"))
    both = (p1.select(*key, "from_state").distinct()
              .join(p2.select(*key, "from_state").distinct(), [*key, "from_state"]))
    d = (p1.join(p2, [*key, "from_state", "to_state"], "full")
           .join(both, [*key, "from_state"], "left_semi")
           .groupBy(*key, "from_state").agg(
               F.sum(F.abs(F.coalesce("p1", F.lit(0.0)) - F.coalesce("p2", F.lit(0.0)))).alias("l1")))
    drift = d.groupBy(*key).agg(F.avg("l1").alias("drift"))
    base = tr.groupBy(*key).agg(F.count(F.lit(1)).alias("n"),
                                (F.countDistinct("from_state") / F.lit(float(N_STATES))).alias("coverage"))
    out = base.join(drift, key, "left")
    ok = (F.col("n") >= min_n) & F.coalesce(F.round("drift", 9) < max_drift, F.lit(False))
    return out.withColumn("sufficient", ok)


def forecast_reliability(suff: DataFrame, cur: DataFrame, tr: DataFrame, absorbing: DataFrame,
                         key: Sequence[str] = ("cluster",), min_n: int = 100, min_coverage: float = 0.05,
                         max_drift: float = 0.5, min_seen: int = 3) -> DataFrame:
    """Score 0-5, one point per criterion; forecasts are shown only when score >= 3."""
    key = list(key)
    seen = tr.groupBy(*key, F.col("from_state").alias("state")).agg(F.count(F.lit(1)).alias("seen"))
    inc = absorbing.groupBy(*key).agg(F.count(F.lit(1)).alias("n_absorbing"))
    j = (suff.join(cur.select(*key, "state"), key, "left").join(seen, [*key, "state"], "left")
             .join(inc, key, "left"))
    crit = {
        "enough_transitions": F.col("n") >= min_n,
        "state_coverage": F.round("coverage", 9) >= min_coverage,
        "incident_seen": F.coalesce(F.col("n_absorbing"), F.lit(0)) >= 1,
        "stable_matrix": F.coalesce(F.round("drift", 9) < max_drift, F.lit(False)),
        "current_state_known": F.coalesce(F.col("seen"), F.lit(0)) >= min_seen,
    }
    score = sum(F.col(c).cast("int") for c in CRITERIA)
    return (j.select(*key, "n", "coverage", "drift", F.coalesce("seen", F.lit(0)).alias("seen"),
                     F.coalesce("n_absorbing", F.lit(0)).alias("n_absorbing"),
                     *[v.alias(k) for k, v in crit.items()])
             .withColumn("score", score).withColumn("show_forecast", F.col("score") >= 3))


def reliability_report(rel: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """One row per criterion with its measured value and verdict."""
    key = list(key)
    vals = {"enough_transitions": F.col("n").cast("double"), "state_coverage": F.col("coverage"),
            "incident_seen": F.col("n_absorbing").cast("double"), "stable_matrix": F.col("drift"),
            "current_state_known": F.col("seen").cast("double")}
    return rel.select(*key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("criterion"), vals[c].alias("value"), F.col(c).alias("ok")) for c in CRITERIA])))


def health_check(rel: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """Status, message and the list of failed criteria."""
    key = list(key)
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in CRITERIA]))
    status = F.when(F.col("score") == 5, "OK").when(F.col("score") >= 3, "DEGRADED").otherwise("INSUFFICIENT")
    msg = F.concat(F.lit("reliability "), F.col("score").cast("string"), F.lit("/5"))
    return rel.select(*key, status.alias("status"), msg.alias("message"), failed.alias("description"))


def counts_as_of(tr: DataFrame, until: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """Transition counts as they stood at the start of each day: (*key, day, from_state, to_state, n)
    counts the transitions of earlier days. ``until`` has the last day wanted per key.

    Prefix sums per day; a pair's sum holds until the day of its next change, so the rows are
    pairs x days, whatever the number of transitions.
    """
    key, one = list(key), F.expr("INTERVAL 1 DAY")
    daily = tr.groupBy(*key, "from_state", "to_state", bucket("ts", "day").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*key, "from_state", "to_state").orderBy("_d")
    sums = daily.select(*key, "from_state", "to_state", "_d", F.lead("_d").over(w).alias("_next"),
                        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    sums = sums.join(until.select(*key, F.col("day").alias("_last")), key).withColumn("_to", F.coalesce("_next", "_last"))
    held = sums.filter(F.col("_d") + one <= F.col("_to"))
    return held.select(*key, F.explode(F.sequence(F.col("_d") + one, F.col("_to"), one)).alias("day"), "from_state", "to_state", "n")


def forecasts_as_of(states: DataFrame, triplet: DataFrame, steps: int, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """The forecast that could be made at each interval: (*key, ts, state, risk), risk = P(absorbed within
    ``steps``) from its state under the chain and the incident states of earlier days only.

    Intervals of days without an earlier transition have no forecast. A state that the chain has not
    seen leave has risk 0 (1 if it is an incident state).
    """
    key = list(key)
    by_day = [*key, "day"]
    st = states.select(*key, "ts", "state", bucket("ts", "day").alias("day"))
    until = st.groupBy(*key).agg(F.max("day").alias("day"))
    counts = counts_as_of(transitions(states, key), until, key)
    on = triplet.filter(F.col("indicator") == 1).select(*key, "ts")
    first = st.join(on, [*key, "ts"], "left_semi").groupBy(*key, "state").agg(F.min("day").alias("_d"))
    one = F.expr("INTERVAL 1 DAY")
    first = first.join(until.select(*key, F.col("day").alias("_last")), key).filter(F.col("_d") + one <= F.col("_last"))
    absorbing = first.select(*key, F.explode(F.sequence(F.col("_d") + one, F.col("_last"), one)).alias("day"), "state")
    p = absorbing_matrix(transition_probabilities(counts, key=by_day), absorbing, by_day)
    # at most 189 x 189 rows a key and day in one group
    risk = risk_k(p, absorbing, (steps,), by_day).drop("k")
    model = counts.select(*by_day).distinct()
    return (st.join(model, by_day, "left_semi").join(risk, [*by_day, "state"], "left")
              .select(*key, "ts", "state", F.coalesce("risk", F.lit(0.0)).alias("risk")))


def forecast_quality(forecasts: DataFrame, incidents: DataFrame, horizon_minutes: int,
                     thresholds: Sequence[float], known_until: DataFrame, key: Sequence[str] = ("cluster",)) -> DataFrame:
    """Forecasts made at t against "an incident starts in (t, t+h]" at the same h.

    Brier score and precision/recall per threshold. Forecasts whose outcome is not known yet
    (t + h after ``known_until``.ts of the key) are not scored. The next incident start is the last
    one met when going back in time.
    """
    key = list(key)
    a = forecasts.select(*key, "ts", "risk", F.lit(None).cast("timestamp_ntz").alias("_s"), F.lit(1).alias("_side"))
    b = incidents.select(*key, F.col("s").alias("ts"), F.lit(None).cast("double").alias("risk"),
                         F.col("s").alias("_s"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    u = a.unionByName(b).withColumn("_next", F.last("_s", ignorenulls=True).over(w))
    ends = F.col("ts") + F.expr(f"INTERVAL {horizon_minutes} MINUTES")
    rows = (u.filter(F.col("_side") == 1).join(known_until.select(*key, F.col("ts").alias("_until")), key)
             .filter(ends <= F.col("_until"))
             .withColumn("y", F.coalesce((F.col("_next") <= ends).cast("int"), F.lit(0))))
    th = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    r = rows.select(*key, "risk", "y", th)
    pred = F.round("risk", 9) >= F.col("threshold")
    agg = r.groupBy(*key, "threshold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((pred & (F.col("y") == 1)).cast("bigint")).alias("tp"),
        F.sum(pred.cast("bigint")).alias("predicted"), F.sum(F.col("y").cast("bigint")).alias("actual"),
        F.avg(F.pow(F.col("risk") - F.col("y"), 2)).alias("brier"))
    return agg.select(*key, "threshold", "n", "tp", "predicted", "actual",
                      F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).alias("precision"),
                      F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).alias("recall"), "brier")


def gated_forecast(cur: DataFrame, risk: DataFrame, rel: DataFrame, horizon_minutes: int,
                   key: Sequence[str] = ("cluster",)) -> DataFrame:
    """The forecast for the current state at the configured horizon, shown only when the reliability score
    allows it: (*key, ts, state, horizon_minutes, score, show_forecast, risk), risk NULL when it is not shown."""
    key = list(key)
    j = cur.join(rel.select(*key, "score", "show_forecast"), key).join(risk.select(*key, "state", "risk"), [*key, "state"], "left")
    return j.select(*key, "ts", "state", F.lit(horizon_minutes).alias("horizon_minutes"), "score", "show_forecast",
                    F.when(F.col("show_forecast"), F.coalesce("risk", F.lit(0.0))).alias("risk"))

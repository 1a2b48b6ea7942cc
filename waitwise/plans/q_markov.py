"""Catalogue: Markov-chain forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitwise.operators import diagnostics as G
from waitwise.operators import markov as M
from waitwise.operators import timeseries as T
from waitwise.plans.duck import with_bindings
from waitwise.plans.q_diag import _INC_CTES
from waitwise.plans.q_series import TRIPLET_MINUTES, _TRIPLET_SQL
from waitwise.plans.registry import register
from waitwise.session import cut_lineage
from waitwise.sources import bindings as B

GRAIN = "hour"
STATE_MINUTES = 360
KS = (15, 30, 60)
ALPHA = 0.05
HORIZON_MINUTES = 360
THRESHOLDS = (0.1, 0.25, 0.5)


# ---------------------------------------------------------------- Spark side
def _aligned(spark, sf):
    return B.aligned_series(spark, sf, GRAIN).select("cluster", "ts", "waits", "us")


def _series(spark, sf):
    """The per-(cluster, hour) series every chain step reads, aggregated from the raw
    samples ONCE and checkpointed (it is small: one row per cluster and interval), so
    states, indicator and incidents do not each re-scan and re-aggregate the samples."""
    s = B.aligned_series(spark, sf, GRAIN).select("cluster", "ts", "speed", "waits", "us")
    return cut_lineage(s)


def _states(spark, sf, series=None):
    series = series if series is not None else _aligned(spark, sf)
    return M.state_id(M.state_inputs(series.select("cluster", "ts", "waits", "us"), minutes=STATE_MINUTES))


def _triplet(spark, sf, series=None):
    series = series if series is not None else _series(spark, sf)
    return T.performance_triplet(series.select("cluster", "ts", "speed", "waits"), minutes=TRIPLET_MINUTES)


def _chain(spark, sf):
    series = _series(spark, sf)
    st = _states(spark, sf, series)
    tr = M.transitions(st)
    p = M.transition_probabilities(M.transition_frequencies(tr))
    ab = M.absorbing_states(st, _triplet(spark, sf, series))
    return st, tr, p, ab, M.absorbing_matrix(p, ab)


# ---------------------------------------------------------------- DuckDB side
_CTES = {
    "al": "SELECT c.cluster, c.ts, c.waits, v.us FROM cluster_series c JOIN vmstat_series v USING (cluster, ts)",
    "si": f"""SELECT cluster, ts,
  round(CASE WHEN var_pop(us) OVER w > 0 AND var_pop(waits) OVER w > 0 THEN corr(us, waits) OVER w END, 9) AS r,
  coalesce(CAST(sign(round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(us, epoch(ts) / 60.0) OVER w END, 9))
                AS INTEGER), 0) AS os_trend,
  coalesce(CAST(sign(round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(waits, epoch(ts) / 60.0) OVER w END, 9))
                AS INTEGER), 0) AS wait_trend
FROM al WINDOW w AS (PARTITION BY cluster ORDER BY ts
                     RANGE BETWEEN INTERVAL {STATE_MINUTES} MINUTE PRECEDING AND CURRENT ROW)""",
    "st": ("SELECT *, (CAST(round(coalesce(r, 0) * 10) AS INTEGER) + 10) * 9 + (os_trend + 1) * 3 + (wait_trend + 1)"
           " AS state FROM si"),
    "tr": ("SELECT * FROM (SELECT cluster, ts, lag(state) OVER (PARTITION BY cluster ORDER BY ts) AS from_state, "
           "state AS to_state FROM st) q WHERE from_state IS NOT NULL"),
    "fr": "SELECT cluster, from_state, to_state, count(*) AS n FROM tr GROUP BY ALL",
    "pm": "SELECT cluster, from_state, to_state, n / sum(n) OVER (PARTITION BY cluster, from_state) AS p FROM fr",
    **_INC_CTES,
    "ab": ("SELECT DISTINCT st.cluster, st.state FROM st JOIN tri ON st.cluster = tri.cluster AND st.ts = tri.ts "
           "WHERE tri.indicator = 1"),
    "pa": ("SELECT * FROM pm WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.cluster = pm.cluster AND "
           "ab.state = pm.from_state) UNION ALL SELECT cluster, state, state, CAST(1.0 AS DOUBLE) FROM ab"),
    "r1": ("SELECT pa.cluster, pa.from_state AS state, sum(pa.p * CASE WHEN ab.state IS NULL THEN 0.0 ELSE 1.0 END) "
           "AS risk FROM pa LEFT JOIN ab ON pa.cluster = ab.cluster AND pa.to_state = ab.state GROUP BY 1, 2"),
}
_ = _TRIPLET_SQL  # the incident CTEs above embed it


def _m(select: str, *more: str) -> str:
    return with_bindings(select, "cluster_series", "vmstat_series", *more, extra=_CTES)


@register("state_inputs", "M1", _m("SELECT cluster, ts, r, os_trend, wait_trend FROM si"))
def q_state_inputs(spark, sf):
    """Rolling r(CPU user, waits) and the two trends per cluster-hour."""
    return M.state_inputs(_aligned(spark, sf), minutes=STATE_MINUTES)


@register("state_id", "M2", _m("SELECT cluster, ts, r, os_trend, wait_trend, state FROM st"))
def q_state_id(spark, sf):
    """The encoded state (0-188) per cluster-hour."""
    return _states(spark, sf)


@register("transitions", "M3", _m("SELECT cluster, ts, from_state, to_state FROM tr"))
def q_transitions(spark, sf):
    return M.transitions(_states(spark, sf))


@register("transition_frequencies", "M4", _m("SELECT * FROM fr"))
def q_transition_frequencies(spark, sf):
    return M.transition_frequencies(M.transitions(_states(spark, sf)))


@register("forgetting", "M5", _m(f"""
SELECT cluster, from_state, to_state,
       sum(pow({1 - ALPHA!r}, (epoch((SELECT max(ts) FROM tr)) - epoch(ts)) / 86400.0)) AS w
FROM tr GROUP BY ALL"""))
def q_forgetting(spark, sf):
    """Transition weights decayed by (1-α)^(age in days)."""
    return M.forgetting(M.transitions(_states(spark, sf)), ALPHA)


@register("transition_probabilities", "M6", _m("SELECT * FROM pm"))
def q_transition_probabilities(spark, sf):
    return _chain(spark, sf)[2]


@register("absorbing_matrix", "M7", _m("SELECT * FROM pa"))
def q_absorbing_matrix(spark, sf):
    """Transition matrix with the incident states made absorbing."""
    return _chain(spark, sf)[4]


@register("risk_1min", "M8", _m("SELECT * FROM r1"))
def q_risk_1min(spark, sf):
    """Probability of entering an incident state at the next step, per state."""
    st, tr, p, ab, pa = _chain(spark, sf)
    return M.risk_1min(pa, ab)


@register("risk_k", "M9", with_bindings(f"""
SELECT cluster, state, step AS k, risk FROM rk WHERE step IN ({', '.join(map(str, KS))})""",
    "cluster_series", "vmstat_series", extra={**_CTES, "rk": "placeholder"}).replace(
    "rk AS (placeholder)", f"""rk AS (
  SELECT 0 AS step, cluster, state, CAST(1.0 AS DOUBLE) AS risk FROM ab
  UNION ALL
  SELECT rk.step + 1, pa.cluster, pa.from_state, sum(pa.p * rk.risk)
  FROM pa JOIN rk ON pa.cluster = rk.cluster AND pa.to_state = rk.state
  WHERE rk.step < {max(KS)} GROUP BY rk.step, pa.cluster, pa.from_state)""").replace("WITH ", "WITH RECURSIVE ", 1))
def q_risk_k(spark, sf):
    """Probability of reaching an incident state within 15, 30 and 60 steps, for every start state."""
    st, tr, p, ab, pa = _chain(spark, sf)
    return M.risk_k(pa, ab, KS)


@register("current_state", "M10", _m("SELECT cluster, arg_max(state, ts) AS state, max(ts) AS ts FROM st GROUP BY 1"))
def q_current_state(spark, sf):
    return M.current_state(_states(spark, sf))


_SUFF_CTES = {
    "hv": """SELECT *, CASE WHEN epoch(ts) < (epoch(min(ts) OVER (PARTITION BY cluster))
                                      + epoch(max(ts) OVER (PARTITION BY cluster))) / 2 THEN 1 ELSE 2 END AS half FROM tr""",
    "hc": "SELECT cluster, half, from_state, to_state, count(*) AS n FROM hv GROUP BY ALL",
    "hp": "SELECT *, n / sum(n) OVER (PARTITION BY cluster, half, from_state) AS p FROM hc",
    "dr": """SELECT cluster, avg(l1) AS drift FROM (
  SELECT cluster, from_state, sum(abs(coalesce(a.p, 0.0) - coalesce(b.p, 0.0))) AS l1
  FROM (SELECT * FROM hp WHERE half = 1) a FULL JOIN (SELECT * FROM hp WHERE half = 2) b USING (cluster, from_state, to_state)
  WHERE (cluster, from_state) IN (SELECT cluster, from_state FROM hp WHERE half = 1
                                  INTERSECT SELECT cluster, from_state FROM hp WHERE half = 2)
  GROUP BY 1, 2) d GROUP BY 1""",
    "su": f"""SELECT t.cluster, t.n, t.coverage, dr.drift,
       t.n >= 100 AND coalesce(round(dr.drift, 9) < 0.5, false) AS sufficient
FROM (SELECT cluster, count(*) AS n, count(DISTINCT from_state) / {float(M.N_STATES)!r} AS coverage FROM tr GROUP BY 1) t
LEFT JOIN dr USING (cluster)""",
    "cs": "SELECT cluster, arg_max(state, ts) AS state FROM st GROUP BY 1",
    "rel": """SELECT su.cluster, su.n, su.coverage, su.drift, coalesce(se.seen, 0) AS seen,
       coalesce(na.k, 0) AS n_absorbing, su.n >= 100 AS enough_transitions,
       round(su.coverage, 9) >= 0.05 AS state_coverage, coalesce(na.k, 0) >= 1 AS incident_seen,
       coalesce(round(su.drift, 9) < 0.5, false) AS stable_matrix, coalesce(se.seen, 0) >= 3 AS current_state_known
FROM su LEFT JOIN cs USING (cluster)
LEFT JOIN (SELECT cluster, from_state AS state, count(*) AS seen FROM tr GROUP BY 1, 2) se
  ON se.cluster = su.cluster AND se.state = cs.state
LEFT JOIN (SELECT cluster, count(*) AS k FROM ab GROUP BY 1) na ON na.cluster = su.cluster""",
    "relscore": """SELECT *, CAST(enough_transitions AS INTEGER) + CAST(state_coverage AS INTEGER)
       + CAST(incident_seen AS INTEGER) + CAST(stable_matrix AS INTEGER) + CAST(current_state_known AS INTEGER) AS score
FROM rel""",
}


def _ms(select: str) -> str:
    return with_bindings(select, "cluster_series", "vmstat_series", extra={**_CTES, **_SUFF_CTES})


def _suff(spark, sf):
    st, tr, p, ab, pa = _chain(spark, sf)
    return st, tr, ab, M.training_sufficiency(tr)


def _rel(spark, sf):
    st, tr, ab, su = _suff(spark, sf)
    return M.forecast_reliability(su, M.current_state(st), tr, ab)


@register("training_sufficiency", "M11", _ms("SELECT * FROM su"))
def q_training_sufficiency(spark, sf):
    """Transitions, state coverage and half-period drift of each cluster's chain."""
    return _suff(spark, sf)[3]


@register("forecast_reliability", "M12", _ms("SELECT *, score >= 3 AS show_forecast FROM relscore"))
def q_forecast_reliability(spark, sf):
    """Reliability score 0-5; forecasts shown only from 3."""
    return _rel(spark, sf)


@register("reliability_report", "M13", _ms("""
SELECT cluster, criterion, value, ok FROM (
  SELECT cluster, 'enough_transitions' AS criterion, CAST(n AS DOUBLE) AS value, enough_transitions AS ok FROM rel
  UNION ALL SELECT cluster, 'state_coverage', coverage, state_coverage FROM rel
  UNION ALL SELECT cluster, 'incident_seen', CAST(n_absorbing AS DOUBLE), incident_seen FROM rel
  UNION ALL SELECT cluster, 'stable_matrix', drift, stable_matrix FROM rel
  UNION ALL SELECT cluster, 'current_state_known', CAST(seen AS DOUBLE), current_state_known FROM rel) r"""))
def q_reliability_report(spark, sf):
    return M.reliability_report(_rel(spark, sf))


@register("health_check", "M14", _ms("""
SELECT cluster, CASE WHEN score = 5 THEN 'OK' WHEN score >= 3 THEN 'DEGRADED' ELSE 'INSUFFICIENT' END AS status,
       'reliability ' || CAST(score AS VARCHAR) || '/5' AS message,
       list_filter([CASE WHEN NOT enough_transitions THEN 'enough_transitions' END,
                    CASE WHEN NOT state_coverage THEN 'state_coverage' END,
                    CASE WHEN NOT incident_seen THEN 'incident_seen' END,
                    CASE WHEN NOT stable_matrix THEN 'stable_matrix' END,
                    CASE WHEN NOT current_state_known THEN 'current_state_known' END], lambda x: x IS NOT NULL)
         AS description
FROM relscore"""))
def q_health_check(spark, sf):
    return M.health_check(_rel(spark, sf))


STEPS = HORIZON_MINUTES // 60
_ASOF_CTES = {
    "fd": "SELECT DISTINCT cluster, date_trunc('day', ts) AS day FROM st",
    "ac": """SELECT fd.cluster, fd.day, tr.from_state, tr.to_state, count(*) AS n
FROM fd JOIN tr ON tr.cluster = fd.cluster AND tr.ts < fd.day GROUP BY ALL""",
    "ap": "SELECT *, n / sum(n) OVER (PARTITION BY cluster, day, from_state) AS p FROM ac",
    "aa": """SELECT DISTINCT fd.cluster, fd.day, st.state FROM fd JOIN st ON st.cluster = fd.cluster AND st.ts < fd.day
JOIN tri ON tri.cluster = st.cluster AND tri.ts = st.ts AND tri.indicator = 1""",
    "am": """SELECT cluster, day, from_state, to_state, p FROM ap
WHERE (cluster, day, from_state) NOT IN (SELECT cluster, day, state FROM aa)
UNION ALL SELECT cluster, day, state, state, CAST(1.0 AS DOUBLE) FROM aa""",
    "ar": f"""SELECT 0 AS step, cluster, day, state, CAST(1.0 AS DOUBLE) AS risk FROM aa
UNION ALL
SELECT ar.step + 1, am.cluster, am.day, am.from_state, sum(am.p * ar.risk)
FROM am JOIN ar ON am.cluster = ar.cluster AND am.day = ar.day AND am.to_state = ar.state
WHERE ar.step < {STEPS} GROUP BY ar.step, am.cluster, am.day, am.from_state""",
    "af": f"""SELECT st.cluster, st.ts, st.state, coalesce(ar.risk, 0.0) AS risk
FROM st JOIN (SELECT DISTINCT cluster, day FROM ac) m ON m.cluster = st.cluster AND m.day = date_trunc('day', st.ts)
LEFT JOIN ar ON ar.step = {STEPS} AND ar.cluster = st.cluster AND ar.day = m.day AND ar.state = st.state""",
}


def _masof(select: str) -> str:
    return with_bindings(select, "cluster_series", "vmstat_series", extra={**_CTES, **_ASOF_CTES}).replace("WITH ", "WITH RECURSIVE ", 1)


@register("forecasts_as_of", "M15", _masof("SELECT * FROM af"))
def q_forecasts_as_of(spark, sf):
    """The 6-hour risk that could be forecast at each hour, from earlier days only."""
    series = _series(spark, sf)
    return M.forecasts_as_of(_states(spark, sf, series), _triplet(spark, sf, series), STEPS)


@register("forecast_quality", "M15", _masof(f"""
SELECT cluster, threshold, count(*) AS n,
       CAST(sum(CASE WHEN round(risk, 9) >= threshold AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
       CAST(sum(CASE WHEN round(risk, 9) >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS predicted,
       CAST(sum(y) AS BIGINT) AS actual, avg(pow(risk - y, 2)) AS brier,
       CASE WHEN predicted > 0 THEN tp / predicted END AS precision,
       CASE WHEN actual > 0 THEN tp / actual END AS recall
FROM (SELECT af.cluster, af.ts, af.risk,
             CASE WHEN EXISTS (SELECT 1 FROM incidents i WHERE i.cluster = af.cluster AND i.s > af.ts
                               AND i.s <= af.ts + INTERVAL {HORIZON_MINUTES} MINUTE) THEN 1 ELSE 0 END AS y
      FROM af JOIN (SELECT cluster, max(ts) AS until FROM st GROUP BY 1) e ON e.cluster = af.cluster
      WHERE af.ts + INTERVAL {HORIZON_MINUTES} MINUTE <= e.until) q
CROSS JOIN (VALUES {', '.join(f'(CAST({t!r} AS DOUBLE))' for t in THRESHOLDS)}) th(threshold)
GROUP BY 1, 2"""))
def q_forecast_quality(spark, sf):
    """Forecasts of the past, each by the chain of the days before it, against incidents starting within
    the same 6 hours: Brier, precision, recall."""
    series = _series(spark, sf)
    st, tri = _states(spark, sf, series), _triplet(spark, sf, series)
    until = series.groupBy("cluster").agg(F.max("ts").alias("ts"))
    return M.forecast_quality(M.forecasts_as_of(st, tri, STEPS), G.incident_intervals(tri), HORIZON_MINUTES, THRESHOLDS, until)


_LIVE_CTES = {
    "lw": f"""SELECT cluster, from_state, to_state,
       sum(pow({1 - ALPHA!r}, (epoch((SELECT max(ts) FROM tr)) - epoch(ts)) / 86400.0)) AS w FROM tr GROUP BY ALL""",
    "lp": "SELECT cluster, from_state, to_state, w / sum(w) OVER (PARTITION BY cluster, from_state) AS p FROM lw",
    "lm": """SELECT cluster, from_state, to_state, p FROM lp WHERE (cluster, from_state) NOT IN (SELECT cluster, state FROM ab)
UNION ALL SELECT cluster, state, state, CAST(1.0 AS DOUBLE) FROM ab""",
    "lr": f"""SELECT 0 AS step, cluster, state, CAST(1.0 AS DOUBLE) AS risk FROM ab
UNION ALL
SELECT lr.step + 1, lm.cluster, lm.from_state, sum(lm.p * lr.risk)
FROM lm JOIN lr ON lm.cluster = lr.cluster AND lm.to_state = lr.state
WHERE lr.step < {STEPS} GROUP BY lr.step, lm.cluster, lm.from_state""",
}


@register("gated_forecast", "M9", with_bindings(f"""
SELECT c.cluster, c.ts, c.state, {HORIZON_MINUTES} AS horizon_minutes, r.score, r.score >= 3 AS show_forecast,
       CASE WHEN r.score >= 3 THEN coalesce(lr.risk, 0.0) END AS risk
FROM (SELECT cluster, arg_max(state, ts) AS state, max(ts) AS ts FROM st GROUP BY 1) c
JOIN relscore r ON r.cluster = c.cluster
LEFT JOIN lr ON lr.step = {STEPS} AND lr.cluster = c.cluster AND lr.state = c.state""",
    "cluster_series", "vmstat_series", extra={**_CTES, **_SUFF_CTES, **_LIVE_CTES}).replace("WITH ", "WITH RECURSIVE ", 1))
def q_gated_forecast(spark, sf):
    """The 6-hour risk of the current state by the chain with forgetting, shown from a reliability of 3."""
    st, tr, p, ab, pa = _chain(spark, sf)
    live = M.absorbing_matrix(M.transition_probabilities(M.forgetting(tr, ALPHA), "w"), ab)
    cur = M.current_state(st)
    rel = M.forecast_reliability(M.training_sufficiency(tr), cur, tr, ab)
    return M.gated_forecast(cur, M.risk_k(live, ab, (STEPS,)), rel, HORIZON_MINUTES)

"""Markov chain: literal chains with known absorption, and properties on the fixtures."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF001
from waitwise.operators import markov as M
from waitwise.plans import q_markov as Q


def _chain(spark, rows):
    return spark.createDataFrame(rows, "cluster string, from_state int, to_state int, p double")


def test_two_state_absorption(spark):
    # state 1 -> 1 (0.5) or -> 2 (0.5); 2 is absorbing: P(absorbed within k) = 1 - 0.5^k
    p = _chain(spark, [("c", 1, 1, 0.5), ("c", 1, 2, 0.5), ("c", 2, 1, 1.0)])
    ab = spark.createDataFrame([("c", 2)], "cluster string, state int")
    pa = M.absorbing_matrix(p, ab)
    r = {(x["state"], x["k"]): x["risk"] for x in M.risk_k(pa, ab, (1, 2, 5)).collect()}
    assert abs(r[(1, 1)] - 0.5) < 1e-12 and abs(r[(1, 2)] - 0.75) < 1e-12 and abs(r[(1, 5)] - (1 - 0.5 ** 5)) < 1e-12
    assert r[(2, 5)] == 1.0
    r1 = {x["state"]: x["risk"] for x in M.risk_1min(pa, ab).collect()}
    assert r1 == {1: 0.5, 2: 1.0}


def test_never_left_state_and_single_observation(spark):
    # state 3 is never left (no outgoing row) and not absorbing: it cannot reach the incident
    p = _chain(spark, [("c", 1, 3, 1.0), ("d", 5, 6, 1.0)])
    ab = spark.createDataFrame([("d", 6)], "cluster string, state int")
    r = {(x["cluster"], x["state"], x["k"]): x["risk"] for x in M.risk_k(M.absorbing_matrix(p, ab), ab, (3,)).collect()}
    assert ("c", 1, 3) not in r and r[("d", 5, 3)] == 1.0


def test_joins_version_equals_dense(spark):
    st, tr, p, ab, pa = Q._chain(spark, SF001)
    a = {(r["cluster"], r["state"], r["k"]): r["risk"] for r in M.risk_k(pa, ab, (1, 4)).collect()}
    b = {(r["cluster"], r["state"], r["k"]): r["risk"] for r in M.risk_k_joins(pa, ab, (1, 4), checkpoint_every=2).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_chain_properties(spark):
    st, tr, p, ab, pa = Q._chain(spark, SF001)
    sums = p.groupBy("cluster", "from_state").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)
    states = [r["state"] for r in st.select("state").collect()]
    assert all(0 <= s < M.N_STATES for s in states)
    rk = M.risk_k(pa, ab, (1, 5, 10)).toPandas()
    r1 = {(r["cluster"], r["state"]): r["risk"] for r in M.risk_1min(pa, ab).collect() if r["risk"] > 0}
    k1 = {(r.cluster, r.state): r.risk for r in rk[rk.k == 1].itertuples()}
    assert r1.keys() == k1.keys() and all(abs(r1[k] - k1[k]) < 1e-12 for k in r1)   # M9(1) = M8
    piv = rk.pivot_table(index=["cluster", "state"], columns="k", values="risk").fillna(0.0)
    assert (np.diff(piv.to_numpy(), axis=1) >= -1e-12).all()                          # non-decreasing in k
    assert ((piv.to_numpy() >= 0) & (piv.to_numpy() <= 1 + 1e-12)).all()


def test_state_dimension(spark):
    d = M.state_dimension(spark)
    assert d.count() == 189
    enc = M.state_id(d.select((F.col("r10") / 10.0).alias("r"), "os_trend", "wait_trend"))
    assert enc.filter(F.col("state") < 0).count() == 0
    assert sorted(r["state"] for r in enc.collect()) == list(range(189))


def test_forgetting_weights(spark):
    base = dt.datetime(2024, 1, 10)
    rows = [("c", base - dt.timedelta(days=d), 1, 2) for d in (0, 1, 2)]
    tr = spark.createDataFrame(rows, "cluster string, ts timestamp_ntz, from_state int, to_state int")
    w = M.forgetting(tr, alpha=0.5).collect()[0]["w"]
    assert abs(w - (1 + 0.5 + 0.25)) < 1e-12


def test_adaptive_forgetting(spark):
    base = dt.datetime(2024, 1, 10)
    rows = [(c, base - dt.timedelta(days=d), 1, 2) for c in ("a", "b") for d in (0, 1)]
    tr = spark.createDataFrame(rows, "cluster string, ts timestamp_ntz, from_state int, to_state int")
    drift = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "cluster string, drift double")
    w = {r["cluster"]: r["w"] for r in M.forgetting(tr, alpha=0.1, drift=drift).collect()}
    assert abs(w["a"] - (1 + 0.9)) < 1e-12 and abs(w["b"] - (1 + 0.8)) < 1e-12   # α doubled by drift 1


def test_forecast_is_made_from_earlier_days_only(spark):
    """Rows after t, changed at will, leave the forecast at t as it was."""
    st, tri = Q._states(spark, SF001).select("cluster", "ts", "state"), Q._triplet(spark, SF001)
    days = [r["d"] for r in st.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    cut = F.lit(str(days[len(days) // 2]) + " 09:00:00").cast("timestamp_ntz")
    later = F.col("ts") > cut
    other_st = st.withColumn("state", F.when(later, (F.col("state") * 7 + 3) % 189).otherwise(F.col("state")))
    other_tri = tri.withColumn("indicator", F.when(later, 1 - F.col("indicator")).otherwise(F.col("indicator")))
    fewer = st.filter(~later | (F.hour("ts") % 3 == 0))

    def upto(s, t):
        return sorted(map(tuple, M.forecasts_as_of(s, t, 6).filter(~later).collect()))
    base = upto(st, tri)
    assert base and any(0 < r[3] < 1 for r in base)
    assert upto(other_st, other_tri) == base and upto(fewer, other_tri) == base
    changed = M.forecasts_as_of(other_st, other_tri, 6).filter(later).collect()
    assert sorted(map(tuple, changed)) != sorted(map(tuple, M.forecasts_as_of(st, tri, 6).filter(later).collect()))


def test_forecast_by_hand(spark):
    # day 1: 1 -> 2 twice and 1 -> 3 twice; 3 is an incident state from day 1 on; on day 2 state 1 is met again
    at = [dt.datetime(2024, 1, 1, h) for h in range(8)] + [dt.datetime(2024, 1, 2, 0), dt.datetime(2024, 1, 2, 1)]
    seq = [1, 2, 1, 3, 1, 2, 1, 3, 1, 2]
    st = spark.createDataFrame([("c", t, s) for t, s in zip(at, seq)], "cluster string, ts timestamp_ntz, state int")
    tri = spark.createDataFrame([("c", t, int(s == 3)) for t, s in zip(at, seq)], "cluster string, ts timestamp_ntz, indicator int")
    one = {r["ts"]: r["risk"] for r in M.forecasts_as_of(st, tri, 1).collect()}
    three = {r["ts"]: r["risk"] for r in M.forecasts_as_of(st, tri, 3).collect()}
    # 1 -> 3 with 1/2; 2 -> 1 always; within three steps from 1: 1/2 + 1/2 * 1 * 1/2; from 2: 1/2 in two steps
    assert set(one) == set(at[8:]) and one == {at[8]: 0.5, at[9]: 0.0} and three == {at[8]: 0.75, at[9]: 0.5}
    inc = spark.createDataFrame([("c", dt.datetime(2024, 1, 2, 1))], "cluster string, s timestamp_ntz")
    until = spark.createDataFrame([("c", at[9])], "cluster string, ts timestamp_ntz")
    q = M.forecast_quality(M.forecasts_as_of(st, tri, 1), inc, 60, (0.4,), until).collect()
    # only the forecast of midnight has a known outcome: an incident at 01:00
    assert [(r["n"], r["tp"], r["predicted"], r["actual"], r["brier"]) for r in q] == [(1, 1, 1, 1, 0.25)]


def test_forecast_is_shown_by_its_gate(spark):
    cur = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1)), ("b", 1, dt.datetime(2024, 1, 1)), ("c", 9, dt.datetime(2024, 1, 1))],
                                "cluster string, state int, ts timestamp_ntz")
    rel = spark.createDataFrame([("a", 2, False), ("b", 3, True), ("c", 5, True)], "cluster string, score int, show_forecast boolean")
    risk = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.4)], "cluster string, state int, risk double")
    assert {r["cluster"]: r["risk"] for r in M.gated_forecast(cur, risk, rel, 360).collect()} == {"a": None, "b": 0.4, "c": 0.0}

"""Band edges and the t-distribution p-value (literal unit cases)."""

import math

import pytest
from pyspark.sql import functions as F

from waitwise.functions.bands import R2_BANDS, WEIGHT_BANDS, band_label
from waitwise.functions.tdist import p_value


def _labels(spark, values, bands):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    return [r[0] for r in df.select(band_label("v", bands)).collect()]


def test_r2_band_edges(spark):
    assert _labels(spark, [0.8, 0.7999, 0.6, 0.5999, 0.4, 0.2, 0.1999, 0.0], R2_BANDS) == [
        "exceptional", "good", "good", "acceptable", "acceptable", "weak", "unusable", "unusable"]


def test_weight_band_edges(spark):
    assert _labels(spark, [0.2, 0.19, 0.1, 0.04, 0.0399, 0.01, 0.0099, -0.5], WEIGHT_BANDS) == [
        "critical", "high", "high", "medium", "low", "low", "ignore", "ignore"]


def test_null_band(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.select(band_label("v", R2_BANDS)).collect()[0][0] is None


# two-sided 5 % critical values of Student's t (public tables)
T_CRIT = {1: 12.706205, 2: 4.302653, 3: 3.182446, 10: 2.228139, 11: 2.200985, 30: 2.042272, 9998: 1.960201}


@pytest.mark.parametrize("nu,t", sorted(T_CRIT.items()))
def test_p_value_at_table_points(spark, nu, t):
    r = t / math.sqrt(t * t + nu)
    df = spark.createDataFrame([(r, nu + 2)], "r double, n bigint")
    p = df.select(p_value("r", "n")).collect()[0][0]
    assert abs(p - 0.05) < 2e-6


def test_p_value_edges(spark):
    df = spark.createDataFrame([(0.5, 2), (1.0, 10), (-1.0, 10), (0.0, 50), (None, 10)], "r double, n bigint")
    got = [x[0] for x in df.select(p_value("r", "n")).collect()]
    assert got[0] is None          # n <= 2
    assert got[1] == 0.0 and got[2] == 0.0   # |r| = 1
    assert abs(got[3] - 1.0) < 1e-12          # r = 0
    assert got[4] is None


def test_p_value_symmetric_and_monotone(spark):
    rows = [(r / 10, 30) for r in range(-9, 10)]
    df = spark.createDataFrame(rows, "r double, n bigint").select("r", p_value("r", "n").alias("p"))
    ps = {round(r, 1): p for r, p in df.collect()}
    for k in range(1, 10):
        assert abs(ps[k / 10] - ps[-k / 10]) < 1e-12
        assert ps[k / 10] < ps[(k - 1) / 10]
    assert all(0 <= p <= 1 for p in ps.values())


def test_p_value_matches_duckdb_form(spark, duck):
    from waitwise.functions.tdist import p_value_duck
    rows = [(0.3, 5), (0.25, 40), (-0.12, 300), (0.9, 4), (0.05, 719)]
    df = spark.createDataFrame(rows, "r double, n bigint")
    sp = [x[0] for x in df.select(F.round(p_value("r", "n"), 12)).collect()]
    dd = [duck.execute(f"SELECT round({p_value_duck('r', 'n')}, 12) FROM (SELECT {r}::DOUBLE AS r, {n} AS n)")
          .fetchone()[0] for r, n in rows]
    assert sp == pytest.approx(dd, abs=1e-11)


def test_p_value_work_does_not_grow_with_n(spark):
    """Large n follows the normal tail, and the expression enumerates nothing that depends on n."""
    from waitwise.functions.tdist import p_value_expr
    n = 20_000_001
    df = spark.createDataFrame([(z / math.sqrt(n - 2), n) for z in (0.0, 0.5, 1.96, 4.0)], "r double, n bigint")
    got = [x[0] for x in df.select(p_value("r", "n")).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in (0.0, 0.5, 1.96, 4.0)], abs=1e-6)
    assert "sequence(" not in p_value_expr("r", "n")


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Context:
    def __init__(self, master, conf):
        self.master, self.applicationId, self._conf, self.dir = master, f"app-{id(self)}", conf, None

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    """A session whose settings cannot be changed, as a running one's."""

    def __init__(self, master, **conf):
        self.conf, self.sparkContext = _Conf(conf), _Context(master, _Conf())


def test_checkpoint_folder_of_the_setting_of_a_local_session_and_of_a_cluster():
    import os

    import pytest

    from waitwise.session import checkpoint_dir
    named = _Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://shared/ckpt"})
    assert checkpoint_dir(named) == "hdfs://shared/ckpt" == named.sparkContext.dir
    local = _Session("local[4]")
    path = checkpoint_dir(local)
    assert os.path.isdir(path) and checkpoint_dir(local) == path == local.sparkContext.dir
    assert checkpoint_dir(_Session("local[4]")) != path
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            checkpoint_dir(_Session(master))

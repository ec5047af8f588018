import math

import numpy as np
import pytest

from tradewind.operators import stationarity


def frame(spark, data):
    return spark.createDataFrame([(k, i, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)], "series_id string, ts bigint, id bigint, price double")


def adf(x, maxlag):
    """Least squares by hand: lag by AIC on the common rows, then the level's t value."""
    d = np.diff(x)

    def design(p, start):
        y = d[start:]
        cols = [np.ones(len(y)), x[start:-1]] + [d[start - i : len(d) - i] for i in range(1, p + 1)]
        return np.column_stack(cols), y

    def fit(p, start):
        a, y = design(p, start)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        ssr = float(((y - a @ beta) ** 2).sum())
        return a, y, beta, ssr

    aic = [len(d[maxlag:]) * math.log(fit(p, maxlag)[3] / len(d[maxlag:])) + 2 * (p + 2) for p in range(maxlag + 1)]
    p = int(np.argmin(aic))
    a, y, beta, ssr = fit(p, p)
    cov = ssr / (len(y) - p - 2) * np.linalg.inv(a.T @ a)
    return p, beta[1] / math.sqrt(cov[1, 1])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    noise = rng.normal(size=300)
    ar = [0.0]
    for e in rng.normal(size=179):
        ar.append(0.5 * ar[-1] + e)
    return {"noise": noise, "walk": np.cumsum(rng.normal(size=250)), "ar": np.array(ar)}


@pytest.mark.parametrize("hot", [None, 90])
def test_unit_root_matches_least_squares(spark, data, hot):
    got = {r["series_id"]: r for r in stationarity.unit_root(frame(spark, data), "price", hot_rows=hot).collect()}
    for k, x in data.items():
        maxlag = min(len(x) // 2 - 2, math.ceil(12 * (len(x) / 100) ** 0.25))
        lag, stat = adf(x, maxlag)
        assert got[k]["used_lag"] == lag
        assert got[k]["statistic"] == pytest.approx(stat, rel=1e-6)
    assert got["noise"]["stationary"] and got["ar"]["stationary"] and not got["walk"]["stationary"]


def test_unit_root_p_values(spark):
    from pyspark.sql import functions as F

    # published 5 % and 1 % points of the statistic with constant
    df = spark.createDataFrame([(-2.86,), (-3.43,), (3.0,), (-20.0,)], "s double").select(stationarity.unit_root_p(F.col("s")).alias("p"))
    p = [r["p"] for r in df.collect()]
    assert p[0] == pytest.approx(0.05, abs=2e-3) and p[1] == pytest.approx(0.01, abs=1e-3) and p[2:] == [1.0, 0.0]


@pytest.mark.parametrize("hot", [None, 90])
def test_level_stationarity(spark, data, hot):
    got = {r["series_id"]: r for r in stationarity.level_stationarity(frame(spark, data), "price", hot_rows=hot).collect()}
    for k, x in data.items():
        n, e = len(x), x - x.mean()
        cov = int(n ** (2 / 9))
        s0, s1 = (e @ e) / n, 0.0
        for i in range(1, cov + 1):
            c = 2 * (e[i:] @ e[:-i]) / n
            s0, s1 = s0 + c, s1 + i * c
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
        long = (e @ e + 2 * sum((e[i:] @ e[:-i]) * (1 - i / (lags + 1)) for i in range(1, lags + 1))) / n
        assert got[k]["lags"] == lags
        assert got[k]["statistic"] == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / long, rel=1e-9)
    assert got["noise"]["stationary"] and got["noise"]["p_value"] == 0.1


def test_sums_of_one_series_of_a_slice():
    """A batch of sums is read series by series, not turned into plain values as a whole."""
    import pyarrow as pa

    lists = pa.array([[{"_i": 0, "_v": 1.0}], [{"_i": 1, "_v": 2.0}, {"_i": -1, "_v": 3.0}], [], [{"_i": 5, "_v": 4.0}]]).slice(1)
    assert [stationarity._sums_of(x) for x in lists] == [{1: 2.0, -1: 3.0}, {}, {5: 4.0}]

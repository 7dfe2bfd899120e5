"""Statistics against numpy / statistics closed forms."""

from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from cdcmart.operators import stats


def _data(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 2 + x @ np.array([1.5, -2.0, 0.5]) + rng.normal(scale=0.3, size=n)
    p = np.repeat([2020, 2021], n // 2)
    rows = [(int(p[i]), float(y[i]), *map(float, x[i])) for i in range(n)]
    return x, y, p, spark.createDataFrame(rows, "period int, y double, x1 double, x2 double, x3 double")


def test_ols_multi_and_bayes(spark):
    x, y, p, df = _data(spark)
    coef = {r["term"]: r["coefficient"] for r in stats.ols_multi(df, "y", ["x1", "x2", "x3"]).collect()}
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    assert np.allclose([coef["intercept"], coef["x1"], coef["x2"], coef["x3"]], beta, atol=1e-8)
    ref = stats.bayes_reference(x, y, p)
    got = stats.bayes_update(spark, df, "y", ["x1", "x2", "x3"]).collect()
    for r in got:
        i = ["intercept", "x1", "x2", "x3"].index(r["term"])
        m, sd = ref[r["period"]]
        assert abs(r["post_mean"] - m[i]) < 1e-6 and abs(r["post_sd"] - sd[i]) < 1e-8


def test_qq_and_global_rank(spark):
    _, _, _, df = _data(spark, 200)
    res = df.selectExpr("period", "y - 2 AS residual")
    q = stats.qq_table(res).collect()
    by = {}
    for r in q:
        by.setdefault(r["period"], []).append(r)
    for period, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        n = len(rs)
        assert [r["rank"] for r in rs] == list(range(1, n + 1))
        assert [r["data_quantile"] for r in rs] == sorted(r["data_quantile"] for r in rs)
        assert all(abs(r["normal_quantile"] - NormalDist().inv_cdf(r["rank"] / (n + 1))) < 1e-12 for r in rs)


def test_ols_fit_r2(spark):
    _, _, _, df = _data(spark)
    f = stats.ols_fit(df).collect()
    assert all(0 < r["r_squared"] < 1 and r["var_fit"] < r["var_mean"] for r in f)


def test_normal_quantile_and_null_period(spark):
    ps = [1e-12, 1e-6, 0.01, 0.074, 0.075, 0.3, 0.5, 0.6, 0.925, 0.926, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(F.expr(stats.ppf_sql("p"))).collect()
    for p, (q,) in zip(ps, got, strict=True):
        assert abs(q - NormalDist().inv_cdf(p)) < 1e-9 * max(1, abs(q))
    rows = [(i % 2 or None, float(i)) for i in range(40)]
    table = stats.qq_table(spark.createDataFrame(rows, "period int, residual double")).collect()
    assert len(table) == 40
    for period in (None, 1):
        own = sorted((r["rank"], r["data_quantile"]) for r in table if r["period"] == period)
        assert own == [(i + 1, float(v)) for i, v in enumerate(sorted(x for p, x in rows if p == period))]

"""Statistics (I1-I10): summaries, least squares and a conjugate Bayesian
update. Heavy lifting is one distributed aggregate per model (sufficient
statistics); only k x k matrices reach the driver."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.session import range_partitions


def sig(c: Column, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits, so that sums taken in another
    order compare equal: round(x / 10^e) * 10^e with e = floor(log10|x|) - digits + 1."""
    e = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - (digits - 1))
    return F.when((c == 0) | c.isNull() | F.isnan(c), c).otherwise(F.round(c / e) * e)


def regression_input(lineitem: DataFrame) -> DataFrame:
    """y = extended price; x = quantity, discount, tax; period = ship year."""
    return lineitem.select(
        F.year("l_shipdate").alias("period"),
        F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("x2"),
        F.col("l_tax").alias("x3"),
    )


def describe(df: DataFrame, cols) -> DataFrame:
    """N, mean, sample variance (ddof 1), stddev, min, max per column."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"), F.var_samp(c).alias(f"{c}__var"),
            F.stddev_samp(c).alias(f"{c}__sd"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
        ]
    row = df.agg(*aggs)
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), sig(F.col(f"{c}__mean")).alias("mean"),
                sig(F.col(f"{c}__var")).alias("variance"), sig(F.col(f"{c}__sd")).alias("stddev"),
                F.col(f"{c}__min").cast("double").alias("min"), F.col(f"{c}__max").cast("double").alias("max"),
            )
            for c in cols
        ]
    )
    return row.select(F.inline(parts))


def ols_fit(df: DataFrame, y: str = "y", x: str = "x1", by: str = "period") -> DataFrame:
    """I2-I5 per group: slope, intercept, Var(mean), Var(fit), R^2 and F.

    Var(fit) is the sample variance of the residuals (pred - y); F uses the
    sums of squares with p_extra = 1, p_fit = 2.
    """
    # every statistic over the complete pairs
    g = df.groupBy(by).agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.var_samp(F.when(F.col(x).isNotNull(), F.col(y))).alias("var_mean"),
        F.regr_r2(F.col(y), F.col(x)).alias("_r2"),
    )
    # With an intercept, residuals have mean 0, so Var(fit) = (1 - R^2) Var(mean).
    var_fit = (1 - F.col("_r2")) * F.col("var_mean")
    f_stat = ((F.col("var_mean") - var_fit) / 1) / (var_fit / (F.col("n") - 2))
    return g.select(
        by, "n", sig(F.col("slope")).alias("slope"), sig(F.col("intercept")).alias("intercept"),
        sig(F.col("var_mean")).alias("var_mean"), sig(var_fit).alias("var_fit"),
        sig(F.col("_r2")).alias("r_squared"), sig(f_stat).alias("f_statistic"),
    )


def residuals(df: DataFrame, fit: DataFrame, y: str = "y", x: str = "x1", by: str = "period") -> DataFrame:
    """Prediction and residual (pred - y) per row, rows of the null group
    included. ``fit`` has one row per group; Spark broadcasts it if it is small."""
    f = fit.select(F.col(by).alias("_by"), F.col("slope").alias("_b"), F.col("intercept").alias("_a"))
    out = df.join(f, df[by].eqNullSafe(F.col("_by")), "inner").drop("_by")
    pred = F.col("_a") + F.col("_b") * F.col(x)
    return out.withColumn("pred", pred).withColumn("residual", pred - F.col(y)).drop("_a", "_b")


# --- I6 QQ table ----------------------------------------------------------------


def global_rank(df: DataFrame, order: str, by: str, partitions: int | None = None) -> DataFrame:
    """1..n rank of ``order`` within each ``by`` group without a
    single-partition window: range-partition on (by, order), number rows in
    partition order, then add per-(group, partition) offsets. The offset
    table has one row per (group, partition) a group spans.
    """
    from pyspark.sql import Window

    n = partitions or range_partitions(df)
    ranged = (
        df.repartitionByRange(n, by, order)
        .sortWithinPartitions(by, order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        # Range bounds are sampled per execution: checkpoint so that the counts
        # and the rows below see one partition layout.
        .checkpoint(eager=True)
    )
    # Inside a partition the rows of one group are contiguous and sorted.
    counts = ranged.groupBy(by, "_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_first"))
    wo = Window.partitionBy(by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wo), F.lit(0))).select(by, "_pid", "_off", "_first")
    # null-safe: rows without a group are a group of their own
    same = ranged[by].eqNullSafe(offsets[by]) & (ranged["_pid"] == offsets["_pid"])
    # as many offsets as groups and partitions: no hint, their size decides
    j = ranged.join(offsets, same, "inner").select(ranged["*"], offsets["_off"], offsets["_first"])
    return j.withColumn("rank", F.col("_off") + F.col("_mid") - F.col("_first") + 1).drop(
        "_pid", "_mid", "_first", "_off"
    )


# ---------------------------------------------------------------------------
# FIXED VALUES: coefficients of the published AS241 rational approximation of
# the normal quantile (Wichura 1988), highest power first, as (num, den).
# ---------------------------------------------------------------------------
AS241_CENTRAL = (
    [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
     1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0],
    [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
     5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0],
)
AS241_NEAR = (
    [7.7454501427834140764e-4, 2.2723844989269184583e-2, 2.4178072517745061177e-1, 1.2704582524523683826e0,
     3.6478483247632046050e0, 5.7694972214606914055e0, 4.6303378461565452959e0, 1.4234371107496835773e0],
    [1.0507500716444168432e-9, 5.4759380849953449460e-4, 1.5198666563616457197e-2, 1.4810397642748007459e-1,
     6.8976733498510000455e-1, 1.6763848301838038494e0, 2.0531916266377588219e0, 1.0],
)
AS241_FAR = (
    [2.0103343992922881327e-7, 2.7115555687434875782e-5, 1.2426609473880784386e-3, 2.6532189526576123093e-2,
     2.9656057182850489123e-1, 1.7848265399172913358e0, 5.4637849111641143699e0, 6.6579046435011037772e0],
    [2.0442631033899397856e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.8686913114561329059e-4,
     1.4875361290850614853e-2, 1.3692988092273580531e-1, 5.9983220655588793769e-1, 1.0],
)


def ppf_sql(p: str) -> str:
    """The same approximation as a SQL expression over ``p`` (for twins)."""

    def poly(coefs, r):
        expr = repr(coefs[0])
        for c in coefs[1:]:
            expr = f"({expr} * {r} + {c!r})"
        return expr

    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    central = f"{q} * {poly(AS241_CENTRAL[0], rc)} / {poly(AS241_CENTRAL[1], rc)}"
    rt = f"sqrt(-ln(CASE WHEN {q} <= 0.0 THEN ({p}) ELSE 1.0 - ({p}) END))"
    near = f"{poly(AS241_NEAR[0], f'({rt} - 1.6)')} / {poly(AS241_NEAR[1], f'({rt} - 1.6)')}"
    far = f"{poly(AS241_FAR[0], f'({rt} - 5.0)')} / {poly(AS241_FAR[1], f'({rt} - 5.0)')}"
    tail = f"(CASE WHEN {rt} <= 5.0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {central} WHEN {q} < 0.0 THEN -{tail} ELSE {tail} END)"


def qq_table(res: DataFrame, col: str = "residual", by: str = "period") -> DataFrame:
    """Sorted residuals paired with normal quantiles ppf(i / (n + 1))."""
    n = res.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    r = global_rank(res.select(by, col), col, by)
    # null-safe: residuals without a period are a group of their own
    counted = r.join(n.withColumnRenamed(by, "_by"), r[by].eqNullSafe(F.col("_by")), "inner")
    return counted.withColumn("_p", F.col("rank") / (F.col("_n") + 1)).select(
        by, "rank", F.col(col).alias("data_quantile"), F.expr(ppf_sql("_p")).alias("normal_quantile")
    )


# --- I7 / I8 / I9 ----------------------------------------------------------------


def ols_multi(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Multi-variable OLS with MLlib's normal-equation solver; MSE."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=xs, outputCol="_f").transform(df.select(y, *xs).dropna())
    model = LinearRegression(featuresCol="_f", labelCol=y, solver="normal", regParam=0.0).fit(data)
    s = model.summary
    rows = [("intercept", float(model.intercept))] + [(x, float(c)) for x, c in zip(xs, model.coefficients)]
    spark = df.sparkSession
    out = spark.createDataFrame(rows, "term string, coefficient double")
    return out.withColumn("mse", F.lit(float(s.meanSquaredError))).withColumn("r2", F.lit(float(s.r2)))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """I8: pairwise Pearson correlations in one aggregate pass."""
    pairs = [(a, b) for a in cols for b in cols]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    arr = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), sig(F.col(f"{a}__{b}")).alias("corr"))
                    for a, b in pairs])
    return row.select(F.inline(arr))


def prep_value_counts(lineitem: DataFrame, max_quantity: float = 100) -> DataFrame:
    """Floor the year, drop outliers (quantity < max), rows per year."""
    return (
        lineitem.where(F.col("l_quantity") < max_quantity)
        .select(F.floor(F.year("l_shipdate")).alias("year"))
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# --- I10 Bayesian update ---------------------------------------------------------


def suff_stats(df: DataFrame, y: str, xs: list[str], by: str) -> DataFrame:
    """n, X'X, X'y, y'y per group in one aggregate (X with a leading 1), over the
    rows that have y and every x."""
    df = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (y, *xs)]))
    cols = [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy")]
    for i in range(k):
        aggs.append(F.sum(cols[i] * F.col(y)).alias(f"xy{i}"))
        for j in range(i, k):
            aggs.append(F.sum(cols[i] * cols[j]).alias(f"xx{i}_{j}"))
    return df.groupBy(by).agg(*aggs)


def bayes_update(
    spark: SparkSession, df: DataFrame, y: str, xs: list[str], by: str = "period", prior_sd: float = 100.0
) -> DataFrame:
    """Conjugate Gaussian update per period, each period's posterior is
    the next period's prior. Priors N(0, prior_sd^2) on every coefficient;
    sigma^2 is plugged in from the period's OLS residuals (the source model
    puts a HalfNormal on sigma, so agreement is approximate).

    Spark computes the sufficient statistics (one row per period); the k x k
    solves run on the driver.
    """
    k = len(xs) + 1
    stats = suff_stats(df, y, xs, by).orderBy(by).collect()  # one row per period
    mean = np.zeros(k)
    prec = np.eye(k) / prior_sd**2
    out = []
    for r in stats:
        xtx = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                xtx[i, j] = xtx[j, i] = r[f"xx{i}_{j}"]
        xty = np.array([r[f"xy{i}"] for i in range(k)])
        n = r["n"]
        beta_ols = np.linalg.lstsq(xtx, xty, rcond=None)[0]
        sse = r["yy"] - 2 * beta_ols @ xty + beta_ols @ xtx @ beta_ols
        sigma2 = max(sse / max(n - k, 1), 1e-12)
        post_prec = prec + xtx / sigma2
        post_cov = np.linalg.inv(post_prec)
        post_mean = post_cov @ (prec @ mean + xty / sigma2)
        sd = np.sqrt(np.diag(post_cov))
        for i, term in enumerate(["intercept", *xs]):
            out.append((r[by], term, float(post_mean[i]), float(sd[i]),
                        float(post_mean[i] - 1.96 * sd[i]), float(post_mean[i] + 1.96 * sd[i]), float(np.sqrt(sigma2))))
        mean, prec = post_mean, post_prec
    schema = f"{by} int, term string, post_mean double, post_sd double, ci_low double, ci_high double, sigma double"
    return spark.createDataFrame(out, schema)


def bayes_reference(x: np.ndarray, y: np.ndarray, periods: np.ndarray, prior_sd: float = 100.0):
    """Plain numpy version of :func:`bayes_update` for tests."""
    res = {}
    k = x.shape[1] + 1
    mean = np.zeros(k)
    prec = np.eye(k) / prior_sd**2
    for p in sorted(set(periods.tolist())):
        m = periods == p
        X = np.column_stack([np.ones(m.sum()), x[m]])
        Y = y[m]
        beta = np.linalg.lstsq(X, Y, rcond=None)[0]
        sigma2 = max(float(((Y - X @ beta) ** 2).sum()) / max(len(Y) - k, 1), 1e-12)
        post_prec = prec + X.T @ X / sigma2
        cov = np.linalg.inv(post_prec)
        post_mean = cov @ (prec @ mean + X.T @ Y / sigma2)
        res[p] = (post_mean, np.sqrt(np.diag(cov)))
        mean, prec = post_mean, post_prec
    return res


def union_all(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)

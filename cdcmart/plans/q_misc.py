"""Registered history, ticker and statistics queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cdcmart.operators import history, stats, ticker
from cdcmart.plans.registry import register
from cdcmart.sources.tables import load

# --- history -------------------------------------------------------------------

H_STEPS = """
    (SELECT conv_id AS session_id, turn AS seq,
            CASE role WHEN 'user' THEN 'ASK_USER' WHEN 'assistant' THEN 'USE_TOOL'
                      WHEN 'system' THEN 'USER_CORRECTION' ELSE upper(role) END AS action,
            CASE WHEN role = 'assistant' THEN (['query_department', 'calculate', 'search'])[turn % 3 + 1] END AS tool,
            text AS result
     FROM conversations)"""

PHRASE = """CASE action WHEN 'USE_TOOL' THEN 'Used ' || coalesce(tool, '?')
                   WHEN 'ASK_USER' THEN 'Asked user, got: ' || coalesce(result, '?')
                   WHEN 'USER_CORRECTION' THEN 'User corrected: ' || coalesce(result, '?')
                   WHEN 'FINAL_ANSWER' THEN 'Gave answer'
                   WHEN 'COMPACTED_SUMMARY' THEN coalesce(result, '')
                   ELSE action || ': ' || coalesce(result, '?') END"""

LABEL = """CASE action WHEN 'USE_TOOL' THEN 'USE_TOOL: ' || coalesce(tool, '?') || '({})'
                  WHEN 'ASK_USER' THEN 'ASK_USER: "' || coalesce(result, '?') || '"'
                  WHEN 'USER_CORRECTION' THEN 'USER_CORRECTION: "' || coalesce(result, '?') || '"'
                  WHEN 'FINAL_ANSWER' THEN 'FINAL_ANSWER' ELSE action END"""


def _steps(spark, sf_dir):
    return history.history_from_conversations(load(spark, sf_dir, "conversations"))


@register(
    "history_compact",
    f"""
    SELECT session_id, seq, action, tool, result, CAST(NULL AS BIGINT) AS compacted_count
    FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n,
                 row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rk FROM {H_STEPS})
    WHERE NOT (n > 5 AND rk > 3)
    UNION ALL
    SELECT session_id, min(seq), 'COMPACTED_SUMMARY', CAST(NULL AS VARCHAR),
           'Previously: ' || string_agg({PHRASE}, '. ' ORDER BY seq) || '.', count(*)
    FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n,
                 row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS rk FROM {H_STEPS})
    WHERE n > 5 AND rk > 3
    GROUP BY session_id""",
)
def q_history_compact(spark, sf_dir):
    """H5: compact all but the last 3 steps of sessions longer than 5."""
    return history.compact_history(_steps(spark, sf_dir))


@register(
    "history_trace",
    f"""
    SELECT session_id, count(*) AS total_steps,
           string_agg('  Step ' || rn || ': ' || {LABEL}, chr(10) || '    ↓' || chr(10) ORDER BY seq)
               || chr(10) || chr(10) || 'Total steps: ' || count(*) AS trace
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM {H_STEPS})
    GROUP BY session_id""",
)
def q_history_trace(spark, sf_dir):
    """H6: execution trace per session."""
    return history.execution_trace(_steps(spark, sf_dir))


@register(
    "history_trace_steps",
    f"""
    SELECT session_id, rn AS n, seq, '  Step ' || rn || ': ' || {LABEL} AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM {H_STEPS})""",
)
def q_history_trace_steps(spark, sf_dir):
    """H6, row-level: the trace line of every step."""
    return history.trace_steps(_steps(spark, sf_dir))


@register(
    "session_expiry",
    """
    SELECT user_id AS session_id, max(ts) AS last_write, max(ts) + INTERVAL 24 HOUR AS expires_at,
           max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) AS expired
    FROM events GROUP BY user_id""",
)
def q_session_expiry(spark, sf_dir):
    """H7: sliding 24 h expiry as of the last event."""
    ev = load(spark, sf_dir, "events")
    now = ev.select(F.max(F.col("ts").cast("timestamp"))).scalar()
    return history.session_expiry(ev, now)


@register(
    "approval_expiry",
    """
    SELECT o_orderkey AS approval_id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
           CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR AS expires_at,
           CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR <= (SELECT max(CAST(o_orderdate AS TIMESTAMP)) FROM orders)
               AS expired
    FROM orders""",
)
def q_approval_expiry(spark, sf_dir):
    """H7 approvals: orders stand for approval requests; each expires
    one hour after creation, judged as of the newest one."""
    o = load(spark, sf_dir, "orders")
    now = o.select(F.max(F.col("o_orderdate").cast("timestamp"))).scalar()
    a = o.select(
        F.col("o_orderkey").alias("approval_id"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    return history.approval_expiry(a, now)


@register(
    "split_escalation",
    r"""
    SELECT conv_id, turn, t AS text, escalated,
           CASE WHEN escalated THEN regexp_replace(replace(first_line, 'ESCALATE:', ''), '^\s+|\s+$', '', 'g') END
               AS reason,
           CASE WHEN escalated THEN regexp_replace(rest, '^\s+|\s+$', '', 'g') END AS context
    FROM (SELECT *, starts_with(t, 'ESCALATE:') AS escalated,
                 CASE WHEN strpos(t, chr(10)) > 0 THEN substr(t, 1, strpos(t, chr(10)) - 1) ELSE t END AS first_line,
                 CASE WHEN strpos(t, chr(10)) > 0 THEN substr(t, strpos(t, chr(10)) + 1) ELSE '' END AS rest
          FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'ESCALATE: ' || text ELSE text END AS t
                FROM conversations WHERE role = 'assistant'))""",
)
def q_split_escalation(spark, sf_dir):
    """H8: escalation split of assistant answers (every fourth one escalates)."""
    c = load(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    a = c.select(
        "conv_id", "turn",
        F.when(F.col("turn") % 4 == 1, F.concat(F.lit("ESCALATE: "), F.col("text"))).otherwise(F.col("text")).alias("text"),
    )
    return history.split_escalation(a).select("conv_id", "turn", "text", "escalated", "reason", "context")


@register(
    "history_summary",
    """
    SELECT conv_id AS session_id, turn, count(*) OVER (PARTITION BY conv_id) AS turn_count,
           CASE WHEN role = 'assistant' THEN 'ModelResponse' ELSE 'ModelRequest' END AS type,
           CASE WHEN role = 'tool' THEN '[tool: ' || text || ']' ELSE text END AS part
    FROM conversations""",
)
def q_history_summary(spark, sf_dir):
    """Per-turn display parts with the session's turn count."""
    return history.history_parts(load(spark, sf_dir, "conversations"))


# --- ticker ----------------------------------------------------------------------

R_METRICS = """
    (SELECT repo,
            count(*) FILTER (WHERE kind = 'star' AND created_at <= now) AS stars,
            count(*) FILTER (WHERE kind = 'fork' AND created_at <= now
                             AND created_at >= now - INTERVAL 7 DAY) AS forks_this_week,
            count(*) FILTER (WHERE kind = 'commit' AND created_at <= now
                             AND created_at >= date_trunc('day', now)) AS commits_today,
            count(*) FILTER (WHERE kind = 'issue' AND created_at <= now) AS open_issues,
            now AS fetched_at
     FROM (SELECT 'repo-' || user_id AS repo,
                  CASE event_type WHEN 'view' THEN 'star' WHEN 'click' THEN 'fork' WHEN 'purchase' THEN 'commit'
                                  WHEN 'error' THEN 'issue' END AS kind,
                  ts AS created_at, (SELECT max(ts) FROM events) AS now
           FROM events)
     GROUP BY repo, now)"""

W_STATE = """
    (SELECT client_id, repo FROM (
        SELECT event_id % 7 AS client_id, 'repo-' || user_id AS repo,
               arg_max(CASE WHEN event_id % 4 = 0 THEN 'unsubscribe' ELSE 'subscribe' END, event_id) AS op
        FROM events GROUP BY event_id % 7, 'repo-' || user_id)
     WHERE op = 'subscribe')"""


def _metrics(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    now = ev.select(F.max(F.col("ts").cast("timestamp"))).scalar()
    return ticker.rolling_counts(ticker.repo_events(ev), now)


@register("rolling_counts", f"SELECT * FROM {R_METRICS}")
def q_rolling_counts(spark, sf_dir):
    """Repo metrics as of the last event."""
    return _metrics(spark, sf_dir)


@register(
    "repo_score",
    f"SELECT *, stars + 10 * forks_this_week + 100 * commits_today - 5 * open_issues AS price FROM {R_METRICS}",
)
def q_repo_score(spark, sf_dir):
    """H9: the ticker price."""
    return ticker.repo_score(_metrics(spark, sf_dir))


@register(
    "rolling_series",
    """
    SELECT repo, day, events,
           CAST(sum(events) OVER (PARTITION BY repo ORDER BY d RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT)
               AS events_7d
    FROM (SELECT 'repo-' || user_id AS repo, CAST(ts AS DATE) AS day, count(*) AS events,
                 CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS d
          FROM events WHERE event_type = 'click' GROUP BY 1, 2, 4)""",
)
def q_rolling_series(spark, sf_dir):
    """H10 daily series: forks per repo per day and over the trailing 7 days."""
    return ticker.rolling_series(ticker.repo_events(load(spark, sf_dir, "events")))


def _state(spark, sf_dir):
    return ticker.watchlist_state(ticker.watch_commands(load(spark, sf_dir, "events")))


@register("watchlist_state", f"SELECT * FROM {W_STATE}")
def q_watchlist_state(spark, sf_dir):
    """(client, repo) watch pairs after the subscribe/unsubscribe log."""
    return _state(spark, sf_dir)


@register(
    "watchlists",
    f"SELECT client_id, list(repo ORDER BY repo) AS repos FROM {W_STATE} GROUP BY client_id",
)
def q_watchlists(spark, sf_dir):
    """H11 view: sorted watchlist per client."""
    return ticker.watchlists(_state(spark, sf_dir))


@register("poll_set", f"SELECT DISTINCT repo FROM {W_STATE}")
def q_poll_set(spark, sf_dir):
    """Repos to poll, each once."""
    return ticker.poll_set(_state(spark, sf_dir))


TICK_FANOUT_SQL = f"""
    SELECT w.client_id, w.repo, CASE WHEN m.stars = 0 THEN 'error' ELSE 'tick' END AS kind,
           CASE WHEN m.stars <> 0 THEN m.stars + 10 * m.forks_this_week + 100 * m.commits_today - 5 * m.open_issues END
               AS price,
           CASE WHEN m.stars = 0 THEN 'not found: ' || m.repo END AS message
    FROM {W_STATE} w JOIN {R_METRICS} m ON w.repo = m.repo"""


@register("tick_fanout", TICK_FANOUT_SQL)
def q_tick_fanout(spark, sf_dir):
    """Each repo's tick (or error) to each of its subscribers."""
    return ticker.tick_fanout(ticker.ticks(_metrics(spark, sf_dir)), _state(spark, sf_dir))


# --- statistics ------------------------------------------------------------------

SIG = "CASE WHEN {x} = 0 OR {x} IS NULL OR isnan({x}) THEN {x} ELSE round({x} / power(10.0, floor(log10(abs({x}))) - 8)) * power(10.0, floor(log10(abs({x}))) - 8) END"


def _sig(x, digits: int = 9):
    return SIG.format(x=f"({x})").replace(" - 8)", f" - {digits - 1})")


REG = """(SELECT CAST(year(l_shipdate) AS INTEGER) AS period, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3
          FROM lineitem)"""


def _reg(spark, sf_dir):
    return stats.regression_input(load(spark, sf_dir, "lineitem"))


@register(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, {_sig(f'avg({c})')} AS mean, {_sig(f'var_samp({c})')} AS variance,
                   {_sig(f'stddev_samp({c})')} AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max
            FROM {REG}"""
        for c in ("y", "x1", "x2", "x3")
    ),
)
def q_describe(spark, sf_dir):
    """Summary statistics of the regression input."""
    return stats.describe(_reg(spark, sf_dir), ["y", "x1", "x2", "x3"])


OLS = f"""
    (SELECT period, count(*) AS n, {_sig('regr_slope(y, x1)')} AS slope, {_sig('regr_intercept(y, x1)')} AS intercept,
            {_sig('var_samp(y)')} AS var_mean, {_sig('(1 - regr_r2(y, x1)) * var_samp(y)')} AS var_fit,
            {_sig('regr_r2(y, x1)')} AS r_squared,
            {_sig('(var_samp(y) - (1 - regr_r2(y, x1)) * var_samp(y)) / (((1 - regr_r2(y, x1)) * var_samp(y)) / (count(*) - 2))')}
                AS f_statistic
     FROM {REG} GROUP BY period)"""


@register("ols_fit", f"SELECT * FROM {OLS}")
def q_ols_fit(spark, sf_dir):
    """One-variable OLS per ship year with Var(mean), Var(fit), R^2, F."""
    return stats.ols_fit(_reg(spark, sf_dir))


@register(
    "residuals",
    f"""
    SELECT period, y, x1, pred, {_sig('pred - y')} AS residual
    FROM (SELECT r.period, r.y, r.x1, {_sig('o.intercept + o.slope * r.x1')} AS pred
          FROM {REG} r JOIN {OLS} o ON r.period = o.period)""",
)
def q_residuals(spark, sf_dir):
    """Prediction and residual per line."""
    return _residual_rows(spark, sf_dir)


def _residual_rows(spark, sf_dir):
    d = _reg(spark, sf_dir)
    r = stats.residuals(d.select("period", "y", "x1"), stats.ols_fit(d))
    r = r.select("period", "y", "x1", stats.sig(F.col("pred")).alias("pred"))
    return r.withColumn("residual", stats.sig(F.col("pred") - F.col("y")))


RESIDUALS = f"""
    (SELECT period, y, x1, pred, {_sig('pred - y')} AS residual
     FROM (SELECT r.period, r.y, r.x1, {_sig('o.intercept + o.slope * r.x1')} AS pred
           FROM {REG} r JOIN {OLS} o ON r.period = o.period))"""


@register(
    "qq_table",
    f"""
    SELECT period, rank, residual AS data_quantile,
           {_sig(stats.ppf_sql('CAST(rank AS DOUBLE) / CAST(n + 1 AS DOUBLE)'))} AS normal_quantile
    FROM (SELECT period, residual, row_number() OVER (PARTITION BY period ORDER BY residual) AS rank,
                 count(*) OVER (PARTITION BY period) AS n
          FROM {RESIDUALS})""",
)
def q_qq_table(spark, sf_dir):
    """QQ table of residuals per ship year: distributed rank, normal
    quantiles ppf(i / (n + 1)) (vectorised in a pandas UDF)."""
    q = stats.qq_table(_residual_rows(spark, sf_dir))
    return q.withColumn("normal_quantile", stats.sig(F.col("normal_quantile")))


_C = {f"c{i}{j}": f"covar_samp(x{i}, x{j})" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j}
_V = {f"v{i}": f"covar_samp(x{i}, y)" for i in (1, 2, 3)}
_DET = "(c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13))"
_INV = {
    "i11": "(c22 * c33 - c23 * c23)", "i12": "-(c12 * c33 - c13 * c23)", "i13": "(c12 * c23 - c13 * c22)",
    "i22": "(c11 * c33 - c13 * c13)", "i23": "-(c11 * c23 - c13 * c12)", "i33": "(c11 * c22 - c12 * c12)",
}
OLS_MULTI = f"""
    (SELECT *, avg_y - (b1 * avg_x1 + b2 * avg_x2 + b3 * avg_x3) AS b0,
            (n - 1) * (var_y - (b1 * v1 + b2 * v2 + b3 * v3)) / n AS mse,
            (b1 * v1 + b2 * v2 + b3 * v3) / var_y AS r2
     FROM (SELECT *, ({_INV['i11']} * v1 + {_INV['i12']} * v2 + {_INV['i13']} * v3) / {_DET} AS b1,
                     ({_INV['i12']} * v1 + {_INV['i22']} * v2 + {_INV['i23']} * v3) / {_DET} AS b2,
                     ({_INV['i13']} * v1 + {_INV['i23']} * v2 + {_INV['i33']} * v3) / {_DET} AS b3
           FROM (SELECT count(*) AS n, avg(y) AS avg_y, avg(x1) AS avg_x1, avg(x2) AS avg_x2, avg(x3) AS avg_x3,
                        var_samp(y) AS var_y,
                        {", ".join(f"{v} AS {k}" for k, v in {**_C, **_V}.items())}
                 FROM {REG})))"""


@register(
    "ols_multi",
    " UNION ALL ".join(
        f"SELECT '{t}' AS term, {_sig(b, 7)} AS coefficient, {_sig('mse', 7)} AS mse, {_sig('r2', 7)} AS r2 FROM {OLS_MULTI}"
        for t, b in (("intercept", "b0"), ("x1", "b1"), ("x2", "b2"), ("x3", "b3"))
    ),
)
def q_ols_multi(spark, sf_dir):
    """Y ~ quantity + discount + tax with MLlib's normal-equation solver
    (twin: the closed-form covariance solution)."""
    r = stats.ols_multi(_reg(spark, sf_dir), "y", ["x1", "x2", "x3"])
    return r.select("term", *[stats.sig(F.col(c), 7).alias(c) for c in ("coefficient", "mse", "r2")])


@register(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_sig(f'corr({a}, {b})')} AS corr FROM {REG}"
        for a in ("y", "x1", "x2", "x3")
        for b in ("y", "x1", "x2", "x3")
    ),
)
def q_corr_matrix(spark, sf_dir):
    """I8: correlation matrix."""
    return stats.corr_matrix(_reg(spark, sf_dir), ["y", "x1", "x2", "x3"])


@register(
    "prep_value_counts",
    "SELECT CAST(floor(year(l_shipdate)) AS BIGINT) AS year, count(*) AS rows FROM lineitem WHERE l_quantity < 100 GROUP BY 1",
)
def q_prep(spark, sf_dir):
    """Outlier filter and rows per year."""
    return stats.prep_value_counts(load(spark, sf_dir, "lineitem"))


_TERMS = ("1.0", "x1", "x2", "x3")


def _inverse(m: str) -> dict[tuple[int, int], str]:
    """Entries of the inverse of the symmetric 4 x 4 matrix of columns
    ``<m><i><j>`` (i <= j), by cofactors."""

    def at(i, j):
        return f"{m}{min(i, j)}{max(i, j)}"

    def cofactor(i, j):
        a, b, c = (r for r in range(4) if r != i)
        p, q, r = (s for s in range(4) if s != j)
        det = (f"({at(a, p)} * ({at(b, q)} * {at(c, r)} - {at(b, r)} * {at(c, q)})"
               f" - {at(a, q)} * ({at(b, p)} * {at(c, r)} - {at(b, r)} * {at(c, p)})"
               f" + {at(a, r)} * ({at(b, p)} * {at(c, q)} - {at(b, q)} * {at(c, p)}))")
        return det if (i + j) % 2 == 0 else f"(-{det})"

    det = " + ".join(f"{at(0, j)} * {cofactor(0, j)}" for j in range(4))
    return {(i, j): f"({cofactor(i, j)} / ({det}))" for i in range(4) for j in range(4)}


def _solve(m: str, v: str) -> list[str]:
    inv = _inverse(m)
    return ["(" + " + ".join(f"{inv[i, j]} * {v}{j}" for j in range(4)) + ")" for i in range(4)]


def _bayes_sql() -> str:
    """Precision and precision-weighted means of the normal update add up over
    the periods, so the posteriors are running sums, solved per period."""
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = ", ".join(
        [f"sum({_TERMS[i]} * {_TERMS[j]}) AS a{i}{j}" for i, j in pairs] + [f"sum({t} * y) AS t{i}" for i, t in enumerate(_TERMS)]
    )
    fitted = " - ".join(f"{b} * t{i}" for i, b in enumerate(_solve("a", "t")))
    run = "OVER (ORDER BY period)"
    running = ", ".join(
        [f"sum(a{i}{j} / s2) {run} + {'1e-4' if i == j else '0'} AS p{i}{j}" for i, j in pairs]
        + [f"sum(t{i} / s2) {run} AS b{i}" for i in range(4)]
    )
    inv, mean = _inverse("p"), _solve("p", "b")
    parts = [
        f"SELECT period, '{term}' AS term, {mean[i]} AS m, sqrt({inv[i, i]}) AS sd, sqrt(s2) AS sigma FROM posterior"
        for i, term in enumerate(("intercept", "x1", "x2", "x3"))
    ]
    out = {"post_mean": "m", "post_sd": "sd", "ci_low": "m - 1.96 * sd", "ci_high": "m + 1.96 * sd", "sigma": "sigma"}
    return f"""
    SELECT period, term, {", ".join(f"{_sig(e, 5)} AS {c}" for c, e in out.items())}
    FROM (WITH moments AS (SELECT period, count(*) AS n, sum(y * y) AS yy, {sums} FROM {REG} GROUP BY period),
          noise AS (SELECT *, greatest((yy - {fitted}) / greatest(n - 4, 1), 1e-12) AS s2 FROM moments),
          posterior AS (SELECT period, s2, {running} FROM noise)
          {" UNION ALL ".join(parts)})"""


@register("bayes_update", _bayes_sql())
def q_bayes(spark, sf_dir):
    """Sequential conjugate update per ship year."""
    r = stats.bayes_update(spark, _reg(spark, sf_dir), "y", ["x1", "x2", "x3"])
    return r.select("period", "term", *[stats.sig(F.col(c), 5).alias(c) for c in ("post_mean", "post_sd", "ci_low", "ci_high", "sigma")])


# --- files ------------------------------------------------------------------------


@register(
    "csv_roundtrip",
    "SELECT CAST(floor(year(l_shipdate)) AS BIGINT) AS year, count(*) AS rows FROM lineitem WHERE l_quantity < 100 GROUP BY 1",
)
def q_csv_roundtrip(spark, sf_dir):
    """Lineitem written as CSV and read back with an explicit schema."""
    from cdcmart.sources import files
    from cdcmart.streaming.cdc_stream import scratch

    li = load(spark, sf_dir, "lineitem").select("l_quantity", "l_shipdate")
    path = scratch(spark, "csv")
    files.write_csv(li, path)
    back = files.read_table(spark, path, schema="l_quantity double, l_shipdate timestamp", fmt="csv")
    return stats.prep_value_counts(back)


@register(
    "seed_tables",
    """
    SELECT 'characters' AS section, id, name AS label, rarity AS detail FROM src_characters
    UNION ALL SELECT 'banners', id, name, rate_up_ssr_id FROM src_banners
    UNION ALL SELECT 'topup_packages', package_id, NULL, CAST(count(*) AS VARCHAR) FROM src_transactions GROUP BY package_id""",
)
def q_seed_tables(spark, sf_dir):
    """A5: a seed document made of the catalogues (21 characters, 5 banners, 6
    packages with their sales), loaded back as tables."""
    from cdcmart.sources import adapter, files
    from cdcmart.streaming.cdc_stream import scratch

    characters = adapter.characters(load(spark, sf_dir, "part")).select(
        "id", "name", "rarity", F.struct(F.concat("id", F.lit(".png")).alias("portrait")).alias("visual"))
    banners = adapter.banners(load(spark, sf_dir, "events")).select("id", "name", F.col("rate_up_ssr_id").alias("rate_up_ssr"))
    sold = adapter.transactions(load(spark, sf_dir, "orders")).groupBy(F.col("package_id").alias("id")).agg(
        F.count(F.lit(1)).alias("sold"))

    path = scratch(spark, "seed")
    parts = {"characters": characters, "banners": banners, "topup_packages": sold}
    doc = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        df.select(F.struct(*df.columns).alias(name)) for name, df in parts.items()
    ])
    doc.agg(*[F.collect_list(name).alias(name) for name in parts]).write.json(path)  # catalogues of fixed length
    seed = files.load_seed(spark, path)
    return (
        seed["characters"].select(F.lit("characters").alias("section"), "id", F.col("name").alias("label"), F.col("rarity").alias("detail"))
        .unionByName(seed["banners"].select(F.lit("banners").alias("section"), "id", F.col("name").alias("label"),
                                            F.col("rate_up_ssr_id").alias("detail")))
        .unionByName(seed["topup_packages"].select(F.lit("topup_packages").alias("section"), "id",
                                                   F.lit(None).cast("string").alias("label"), F.col("sold").cast("string").alias("detail")))
    )


@register(
    "query_sql",
    """
    SELECT payment_status, count(*) AS transactions FROM fact_transactions
    WHERE amount_usd >= 10.0 GROUP BY payment_status""",
)
def q_query_sql(spark, sf_dir):
    """Parameterised SQL over a Gold table."""
    from cdcmart.plans.registry import wh
    from cdcmart.sources import files

    return files.query(
        spark,
        "SELECT payment_status, count(*) AS transactions FROM ft WHERE amount_usd >= :lo GROUP BY payment_status",
        args={"lo": 10.0},
        ft=wh(spark, sf_dir).table("fact_transactions"),
    )

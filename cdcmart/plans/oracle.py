"""DuckDB twins of the registered queries.

The CTEs state, from the driver tables alone, what the whole pipeline must
produce: the source tables of the adapter, then the Silver outcome of the
CDC stream (faults included), then Gold. Each registered query's SQL is
``WITH <ctes> <final select>``; unreferenced CTEs are not evaluated.
"""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"

CTES: list[tuple[str, str]] = [
    (
        "src_players",
        """
        SELECT CAST(c.c_custkey AS VARCHAR) AS id, CASE WHEN c.c_custkey % 41 <> 40 THEN c.c_name END AS username,
               r.r_name AS region, CAST(floor(c.c_acctbal) AS INTEGER) AS crystal_balance,
               make_timestamp((1672531200 + c.c_custkey * 60) * 1000000) AS registered_at,
               make_timestamp((1672531200 + c.c_custkey * 60 + CASE WHEN c.c_custkey % 7 IN (3, 4) THEN 2592000 ELSE 0 END)
                              * 1000000) AS updated_at
        FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON r.r_regionkey = CASE WHEN c.c_custkey % 7 = 3 THEN (n.n_regionkey + 1) % 5 ELSE n.n_regionkey END""",
    ),
    (
        "player_msgs",
        """
        SELECT p.id, 'insert' AS event, p.username, CASE WHEN c.c_custkey % 14 NOT IN (3, 4) THEN r.r_name END AS region,
               p.registered_at AS changed_at
        FROM src_players p JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = p.id
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
        UNION ALL
        SELECT id, 'update', username, region, updated_at FROM src_players WHERE updated_at > registered_at""",
    ),
    (
        "player_history",
        """
        SELECT id AS player_id, username, region, changed_at AS valid_from,
               lead(changed_at) OVER (PARTITION BY id ORDER BY changed_at) AS valid_to,
               lead(changed_at) OVER (PARTITION BY id ORDER BY changed_at) IS NULL AS is_current
        FROM (SELECT *, lag(region) OVER mine AS earlier, row_number() OVER mine AS n FROM player_msgs
              WINDOW mine AS (PARTITION BY id ORDER BY changed_at))
        WHERE n = 1 OR region IS DISTINCT FROM earlier""",
    ),
    (
        "src_characters",
        """
        SELECT printf('%s-%03d', lower(rar), num) AS id, p_name AS name, rar AS rarity,
               p_type AS archetype, p_brand AS element, CAST(NULL AS VARCHAR) AS faction,
               '1.0' AS banner_debut
        FROM (SELECT *,
                     CASE WHEN p_partkey < 5 THEN 'SSR' WHEN p_partkey < 13 THEN 'SR' ELSE 'R' END AS rar,
                     CAST(CASE WHEN p_partkey < 5 THEN p_partkey + 1 WHEN p_partkey < 13 THEN p_partkey - 4
                          ELSE p_partkey - 12 END AS INTEGER) AS num
              FROM part WHERE p_partkey < 21)""",
    ),
    (
        "src_banners",
        """
        SELECT event_type AS id, 'Banner ' || event_type AS name,
               CASE WHEN event_type <> 'view' THEN 'limited' ELSE 'permanent' END AS type,
               '1.0' AS version,
               CASE event_type WHEN 'click' THEN 'ssr-001' WHEN 'error' THEN 'ssr-002'
                    WHEN 'purchase' THEN 'ssr-003' WHEN 'signup' THEN 'ssr-004' END AS rate_up_ssr_id,
               CASE WHEN event_type <> 'view' THEN 19723 END AS start_date,
               CASE WHEN event_type <> 'view' THEN 19742 END AS end_date
        FROM (SELECT DISTINCT event_type FROM events)""",
    ),
    (
        "src_pulls",
        """
        SELECT event_id, CAST(event_id AS VARCHAR) AS id,
               CASE WHEN event_id % 23 = 11 THEN 'guest' ELSE CAST(user_id AS VARCHAR) END AS player_id,
               CASE WHEN event_id % 89 = 60 THEN 'retired' ELSE event_type END AS banner_id,
               printf('%s-%03d', lower(rar), CAST(CASE WHEN event_id % 97 = 13 THEN if(rar = 'SSR', 6, 9)
                                                  WHEN rar = 'SSR' THEN event_id % 5 + 1
                                                  ELSE event_id % 8 + 1 END AS INTEGER)) AS character_id,
               rar AS rarity, CAST(event_id % 90 + 1 AS INTEGER) AS pity_count,
               (rar = 'SSR' AND event_id % 3 = 0) AS is_guaranteed,
               CAST(event_id % 10 + 1 AS INTEGER) AS pull_number,
               CASE WHEN event_id % 29 <> 5 THEN CAST(CAST(floor(event_id / 10.0) AS BIGINT) AS VARCHAR) END AS batch_id,
               160 AS crystals_spent, CAST(ts AS TIMESTAMP) AS pulled_at
        FROM (SELECT *, CASE WHEN k < 2 THEN 'SSR' WHEN k < 12 THEN 'SR' ELSE 'R' END AS rar
              FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    ),
    (
        "src_transactions",
        """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS player_id, pkg AS package_id,
               CAST(CASE WHEN st = 'success' THEN
                    CASE pkg WHEN 'pkg-01' THEN 60 WHEN 'pkg-02' THEN 300 WHEN 'pkg-03' THEN 980
                             WHEN 'pkg-04' THEN 1980 WHEN 'pkg-05' THEN 3280 WHEN 'pkg-06' THEN 90 END
                    ELSE 0 END AS INTEGER) AS crystals_added,
               CAST((floor(o_totalprice) % 5000) / 100.0 AS DOUBLE) AS amount_usd,
               CASE o_orderkey % 3 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'google_pay' ELSE 'apple_pay' END
                   AS payment_method,
               st AS payment_status,
               row_number() OVER (PARTITION BY o_custkey, pkg ORDER BY o_orderkey) = 1 AS is_first_buy,
               CAST(o_orderdate AS TIMESTAMP) AS transacted_at
        FROM (SELECT *, 'pkg-0' || substr(o_orderpriority, 1, 1) AS pkg,
                     CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending'
                          WHEN 'P' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'chargeback'
                                             WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'refunded' END END AS st
              FROM orders)""",
    ),
    (
        "pulls_typed",
        """
        SELECT p.*, b.type AS banner_type, b.rate_up_ssr_id
        FROM src_pulls p LEFT JOIN src_banners b ON p.banner_id = b.id""",
    ),
    (
        "pity_rn",
        """
        SELECT *, row_number() OVER (PARTITION BY player_id, banner_type
                                     ORDER BY pulled_at DESC, event_id DESC) AS rn_desc
        FROM pulls_typed""",
    ),
    (
        "src_player_pity",
        """
        SELECT player_id, banner_type,
               CAST(coalesce(min(rn_desc) FILTER (WHERE rarity = 'SSR') - 1, count(*)) AS INTEGER) AS pity_count,
               coalesce(arg_min(coalesce(character_id <> rate_up_ssr_id, true), rn_desc)
                        FILTER (WHERE rarity = 'SSR' AND banner_type = 'limited'), false) AS guaranteed_next,
               max(pulled_at) AS updated_at
        FROM pity_rn GROUP BY player_id, banner_type""",
    ),
    (
        "src_player_inventory",
        """
        SELECT player_id, character_id, CAST(least(count(*) - 1, 6) AS INTEGER) AS constellation,
               min(pulled_at) AS obtained_at, max(pulled_at) AS updated_at
        FROM src_pulls GROUP BY player_id, character_id""",
    ),
    # --- Silver: what survives the CDC stream -------------------------------
    (
        "stg_pulls",
        """
        SELECT id, player_id, banner_id, character_id, rarity, pity_count, is_guaranteed, pull_number,
               batch_id, CAST(CASE WHEN event_id % 5 = 0 THEN 320 ELSE 160 END AS INTEGER) AS crystals_spent,
               pulled_at
        FROM src_pulls
        WHERE event_id % 5 = 0 OR (event_id % 101 <> 0 AND event_id % 103 <> 0)""",
    ),
    ("stg_transactions", "SELECT * FROM src_transactions"),
    ("stg_players", "SELECT * FROM src_players"),
    (
        "stg_player_pity",
        """
        SELECT player_id || ':' || banner_type AS id, player_id, banner_type, pity_count, guaranteed_next,
               updated_at
        FROM src_player_pity""",
    ),
    (
        "stg_player_inventory",
        """
        SELECT player_id || ':' || character_id AS id, player_id, character_id, constellation, obtained_at,
               updated_at
        FROM src_player_inventory""",
    ),
    ("stg_characters", "SELECT * FROM src_characters"),
    (
        "stg_banners",
        """
        SELECT id, name, type, version, rate_up_ssr_id,
               DATE '1970-01-01' + CAST(start_date AS INTEGER) AS start_date,
               DATE '1970-01-01' + CAST(end_date AS INTEGER) AS end_date
        FROM src_banners""",
    ),
    # --- Gold -----------------------------------------------------------------
    (
        "fact_pulls",
        """
        SELECT p.id AS pull_id, p.player_id, pl.region AS player_region, p.banner_id, p.character_id,
               p.rarity, p.pity_count, p.is_guaranteed, p.crystals_spent, p.pulled_at
        FROM stg_pulls p LEFT JOIN (SELECT id, region FROM stg_players) pl ON p.player_id = pl.id""",
    ),
    (
        "fact_transactions",
        """
        SELECT id AS transaction_id, player_id, package_id, crystals_added, amount_usd, payment_method,
               payment_status, is_first_buy, transacted_at
        FROM stg_transactions""",
    ),
    (
        "dim_players",
        "SELECT id AS player_id, username, region, crystal_balance, registered_at FROM stg_players",
    ),
    (
        "dim_characters",
        "SELECT id AS character_id, name, rarity, archetype, element, banner_debut FROM stg_characters",
    ),
    (
        "dim_banners",
        "SELECT id AS banner_id, name, type, version, rate_up_ssr_id, start_date, end_date FROM stg_banners",
    ),
    (
        "agg_player_spending",
        """
        SELECT player_id, count(*) AS total_pulls, CAST(sum(crystals_spent) AS BIGINT) AS total_crystals_spent,
               coalesce(any_value(paid), 0) AS total_usd_spent,
               count(*) FILTER (rarity = 'SSR') AS ssr_count, count(*) FILTER (rarity = 'SR') AS sr_count,
               count(*) FILTER (rarity = 'R') AS r_count, count(DISTINCT character_id) AS unique_characters,
               avg(pity_count) FILTER (rarity = 'SSR') AS avg_pity_to_ssr
        FROM stg_pulls
        LEFT JOIN (SELECT player_id, sum(amount_usd) FILTER (payment_status = 'success') AS paid
                   FROM stg_transactions GROUP BY player_id) USING (player_id)
        GROUP BY player_id""",
    ),
    # --- Bronze expectations (pull stream) ------------------------------------
    (
        "pull_msgs",
        """
        SELECT p.*, 'insert' AS event, epoch_us(pulled_at) // 1000 AS ts_ms, 160 AS crystals
        FROM src_pulls p WHERE event_id % 101 <> 0 AND event_id % 103 <> 0
        UNION ALL -- delivered twice
        SELECT p.*, 'insert', epoch_us(pulled_at) // 1000, 160
        FROM src_pulls p WHERE event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 59 = 7
        UNION ALL
        SELECT p.*, 'update', epoch_us(pulled_at) // 1000 + 60000 + if(event_id % 20 = 0, 1728000000, 0), 320
        FROM src_pulls p WHERE event_id % 5 = 0
        UNION ALL
        SELECT p.*, 'delete', epoch_us(pulled_at) // 1000 + 120000 + if(event_id % 20 = 0, 1728000000, 0), 160
        FROM src_pulls p WHERE event_id % 17 = 0""",
    ),
    (
        "dead_letters",
        """
        SELECT 'missing payload.op' AS reason, 'pulls' AS source_table, id AS row_id
        FROM src_pulls, range(if(event_id % 59 = 7, 2, 1)) -- delivered once or twice
        WHERE event_id % 101 = 0 AND event_id % 103 <> 0
        UNION ALL
        SELECT why, tbl, CASE WHEN has_row THEN id END
        FROM src_pulls JOIN (VALUES
            (0, 'missing payload', NULL, false), (1, 'missing payload.source', NULL, true),
            (2, 'missing payload.ts_ms', 'pulls', true), (3, 'payload.source is not an object', NULL, true),
            (4, 'missing payload.source.table', NULL, true), (5, 'missing payload.source.schema', 'pulls', true),
            (6, 'delete event missing payload.before', 'pulls', true), (7, 'op=''c'' missing payload.after', 'pulls', false),
            (8, 'op=''r'' missing payload.after', 'pulls', false),
            (9, 'unknown payload.source.table', 'audit_log', true)) AS k(kind, why, tbl, has_row)
          ON event_id % 101 = 50 AND event_id // 101 % 10 = kind""",
    ),
    (
        "bronze_keys",
        f"""
        SELECT id, event, make_timestamp(ts_ms * 1000) AS event_timestamp, 'pulls' AS source_table,
               'public' AS source_schema
        FROM pull_msgs
        UNION ALL
        SELECT id, event, make_timestamp(epoch_us(changed_at) // 1000 * 1000), 'players', 'public' FROM player_msgs
        UNION ALL
        SELECT id, 'insert', make_timestamp(1704067200000000), 'characters', 'public' FROM src_characters
        UNION ALL
        SELECT id, 'insert', make_timestamp(1704067200000000), 'banners', 'public' FROM src_banners
        UNION ALL
        SELECT id, 'insert', make_timestamp(epoch_us(transacted_at) // 1000 * 1000), 'transactions', 'public'
        FROM src_transactions
        UNION ALL
        SELECT json_merge_patch('{{}}', json_object( -- without null members
                   'banner_type', banner_type, 'guaranteed_next', guaranteed_next, 'pity_count', pity_count,
                   'player_id', player_id, 'updated_at', strftime(updated_at, {ISO})))::VARCHAR,
               'insert', make_timestamp(epoch_us(updated_at) // 1000 * 1000), 'player_pity', 'public'
        FROM src_player_pity
        UNION ALL
        SELECT json_object('character_id', character_id, 'constellation', constellation,
                           'obtained_at', strftime(obtained_at, {ISO}), 'player_id', player_id,
                           'updated_at', strftime(updated_at, {ISO}))::VARCHAR,
               'insert', make_timestamp(epoch_us(updated_at) // 1000 * 1000), 'player_inventory', 'public'
        FROM src_player_inventory""",
    ),
]


def sql(final: str) -> str:
    """``WITH`` all CTEs, then ``final``."""
    body = ",\n".join(f"{name} AS ({text}\n)" for name, text in CTES)
    return f"WITH {body}\n{final}"


_STATUSES = "['applied', 'sourced', 'shortlisted', 'interviewed', 'offered', 'hired', 'rejected', 'withdrawn']"
_STATUSES9 = _STATUSES[:-1] + ", 'archived']"
VALID_IN = "('applied', 'sourced', 'shortlisted', 'interviewed', 'offered', 'hired', 'rejected', 'withdrawn')"

CTES += [
    (
        "g_apps",
        f"""
        SELECT 'app-' || c_custkey AS id, CAST(c_nationkey AS BIGINT) AS company_id,
               lower(c_mktsegment) AS first_name, CASE WHEN c_custkey % 47 <> 20 THEN substr(c_name, 10) END AS last_name,
               ({_STATUSES})[c_custkey % 8 + 1] AS status,
               CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100.0 END AS role_fit_score,
               CASE c_custkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS has_passed_screening
        FROM customer""",
    ),
    (
        "g_users",
        """
        SELECT 'user-' || n_nationkey AS user_id, CAST(n_nationkey AS BIGINT) AS company_id,
               CASE WHEN n_nationkey % 4 <> 3 THEN 'HR Manager' ELSE 'Recruiter (read-only)' END AS role,
               n_nationkey % 4 <> 3 AS can_move_status, CAST(n_nationkey % 4 + 3 AS INTEGER) AS mutation_cap,
               CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0.01 ELSE 0.1 END AS DOUBLE) AS cost_limit_usd
        FROM nation""",
    ),
    (
        "g_grants",
        """
        SELECT 'user-' || n_nationkey AS user_id, 'sales' AS dataset FROM nation
        UNION ALL SELECT 'user-' || n_nationkey, 'marketing' FROM nation WHERE n_regionkey % 2 = 0
        UNION ALL SELECT 'user-' || n_nationkey, 'hr' FROM nation WHERE n_nationkey % 5 = 0""",
    ),
    (
        "g_status_requests",
        f"""
        SELECT o_orderkey AS request_id, u || ':' || CAST(year(o_orderdate) AS VARCHAR) AS run_id, u AS user_id,
               'app-' || o_custkey AS application_id, ({_STATUSES9})[o_orderkey % 9 + 1] AS new_status,
               o_orderpriority <> '5-LOW' AS approved
        FROM (SELECT o.*, 'user-' || CAST(CASE WHEN o.o_orderkey % 10 = 0 THEN (c.c_nationkey + 1) % 25
                                            ELSE c.c_nationkey END AS VARCHAR) AS u
              FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)""",
    ),
    (
        "g_list_requests",
        f"""
        SELECT CAST(n_nationkey AS BIGINT) AS request_id, 'user-' || n_nationkey AS user_id,
               CASE WHEN n_nationkey % 10 < 8 THEN ({_STATUSES})[n_nationkey % 10 + 1]
                    WHEN n_nationkey % 10 = 8 THEN 'archived' END AS status_filter
        FROM nation""",
    ),
    (
        "g_name_lookups",
        """
        SELECT s_suppkey AS request_id, 'user-' || s_nationkey AS user_id,
               CASE WHEN s_suppkey % 4 = 0 THEN ' House ' ELSE ' ' || substr(s_name, 15, 4) || ' ' END AS term
        FROM supplier""",
    ),
    (
        "g_access_requests",
        """
        SELECT s_suppkey AS request_id, 'user-' || s_nationkey AS user_id,
               (['sales', 'marketing', 'hr'])[s_suppkey % 3 + 1] AS dataset
        FROM supplier""",
    ),
    (
        "g_catalog",
        """
        SELECT * FROM (VALUES ('sales', 'orders'), ('sales', 'products'), ('marketing', 'campaigns'),
                              ('hr', 'employees')) AS c(dataset, table_name)""",
    ),
    (
        "g_query_log",
        """
        SELECT o_orderkey AS query_id, 'user-' || (o_custkey % 25) AS user_id,
               (['SELECT * FROM hr.employees', 'SELECT name, budget FROM Marketing.campaigns',
                 'SELECT count(*) FROM sales.orders'])[o_orderkey % 3 + 1] AS sql
        FROM orders""",
    ),
    (
        "g_hr_query_log",
        """
        SELECT o_orderkey AS query_id, 'user-' || (o_custkey % 25) AS user_id,
               (['SELECT first_name, role_fit_score FROM talent_acquisition.job_application',
                 'SELECT title FROM talent_acquisition.job', 'SELECT id FROM identity.users'])[o_orderkey % 3 + 1] AS sql
        FROM orders""",
    ),
    (
        "g_dept_metrics",
        """
        SELECT lower(c_mktsegment) AS department, count(*) AS headcount,
               count(*) FILTER (WHERE c_acctbal > 0) AS active_today
        FROM customer GROUP BY lower(c_mktsegment)""",
    ),
    (
        "g_dept_requests",
        """
        SELECT CAST(n_nationkey AS BIGINT) AS request_id,
               CASE WHEN n_nationkey % 2 = 0 THEN upper(d) ELSE d END AS department
        FROM (SELECT *, (['automobile', 'building', 'furniture', 'household', 'machinery', 'support'])
                        [n_nationkey % 6 + 1] AS d FROM nation)""",
    ),
    (
        "g_changes",
        f"""
        SELECT o.*, CASE WHEN outcome = 'OK' THEN CAST(before + 1 AS INTEGER) END AS mutation_no,
               okr.old_status
        FROM (SELECT *, CASE WHEN NOT can THEN 'DENIED' WHEN before >= cap THEN 'STOPPED'
                             WHEN NOT valid THEN 'ERROR' WHEN NOT in_tenant THEN 'DENIED'
                             WHEN op_denied THEN 'DENIED_BY_OPERATOR' ELSE 'OK' END AS outcome
              FROM (SELECT *, coalesce(sum(CASE WHEN can AND valid AND in_tenant AND NOT op_denied THEN 1 ELSE 0 END)
                                 OVER (PARTITION BY run_id ORDER BY request_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                    FROM (SELECT r.*, u.role, u.mutation_cap AS cap, coalesce(u.can_move_status, false) AS can,
                                 r.new_status IN {VALID_IN} AS valid,
                                 coalesce(a.company_id = u.company_id, false) AS in_tenant,
                                 r.new_status IN ('hired', 'rejected') AND NOT coalesce(r.approved, true) AS op_denied,
                                 a.first_name, a.last_name, a.status AS current_status
                          FROM g_status_requests r LEFT JOIN g_users u ON r.user_id = u.user_id
                          LEFT JOIN g_apps a ON r.application_id = a.id))) o
        LEFT JOIN (SELECT request_id, coalesce(lag(new_status) OVER (PARTITION BY application_id ORDER BY request_id),
                                              current_status) AS old_status
                   FROM (SELECT *, CASE WHEN NOT can THEN 'DENIED' WHEN before >= cap THEN 'STOPPED'
                                        WHEN NOT valid THEN 'ERROR' WHEN NOT in_tenant THEN 'DENIED'
                                        WHEN op_denied THEN 'DENIED_BY_OPERATOR' ELSE 'OK' END AS outcome
                         FROM (SELECT *, coalesce(sum(CASE WHEN can AND valid AND in_tenant AND NOT op_denied
                                                           THEN 1 ELSE 0 END)
                                            OVER (PARTITION BY run_id ORDER BY request_id
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                               FROM (SELECT r.*, u.mutation_cap AS cap, coalesce(u.can_move_status, false) AS can,
                                            r.new_status IN {VALID_IN} AS valid,
                                            coalesce(a.company_id = u.company_id, false) AS in_tenant,
                                            r.new_status IN ('hired', 'rejected')
                                                AND NOT coalesce(r.approved, true) AS op_denied,
                                            a.status AS current_status
                                     FROM g_status_requests r LEFT JOIN g_users u ON r.user_id = u.user_id
                                     LEFT JOIN g_apps a ON r.application_id = a.id)))
                   WHERE outcome = 'OK') okr ON o.request_id = okr.request_id""",
    ),
]

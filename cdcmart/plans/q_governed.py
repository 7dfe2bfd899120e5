"""Registered governed-access queries."""

from __future__ import annotations

from cdcmart.operators import governed
from cdcmart.plans.oracle import VALID_IN
from cdcmart.plans.registry import register, wh
from cdcmart.sources import governed_inputs as gi
from cdcmart.sources.tables import fingerprint

_VALID_SORTED = "applied, hired, interviewed, offered, rejected, shortlisted, sourced, withdrawn"


def _in(spark, sf_dir):
    return gi.inputs(spark, sf_dir)


_CHANGES: dict[tuple, object] = {}


def _changes(spark, sf_dir):
    """H1 result shared by the status queries of one application (its
    inputs are checkpointed once, so later queries reuse them)."""
    import os

    try:
        app = spark.sparkContext.applicationId
    except Exception:  # remote session
        app = str(id(spark))
    key = (os.path.realpath(sf_dir), fingerprint(spark, sf_dir), app)
    if key not in _CHANGES:
        i = _in(spark, sf_dir)
        _CHANGES[key] = governed.status_changes(i["status_requests"], i["applications"], i["users"])
    return _CHANGES[key]


@register(
    "tenant_applicants",
    f"""
    SELECT r.request_id, a.id AS application_id, a.first_name || ' ' || a.last_name AS name, a.status,
           a.role_fit_score, CAST(NULL AS VARCHAR) AS error
    FROM g_list_requests r LEFT JOIN g_users u ON r.user_id = u.user_id
    JOIN g_apps a ON a.company_id = u.company_id AND (r.status_filter IS NULL OR r.status_filter = a.status)
    WHERE r.status_filter IS NULL OR r.status_filter IN {VALID_IN}
    UNION ALL
    SELECT request_id, NULL, NULL, NULL, NULL,
           '[ERROR] ''' || status_filter || ''' is not valid. Choose from: {_VALID_SORTED}'
    FROM g_list_requests WHERE status_filter IS NOT NULL AND status_filter NOT IN {VALID_IN}""",
)
def q_tenant_applicants(spark, sf_dir):
    """Tenant-scoped applicant lists, optional status filter, score desc nulls last."""
    i = _in(spark, sf_dir)
    return governed.tenant_applicants(i["list_requests"], i["users"], i["applications"])


@register(
    "name_lookup",
    """
    SELECT r.request_id, r.user_id, r.term, count(a.id) OVER (PARTITION BY r.request_id) AS matches,
           CASE WHEN count(a.id) OVER (PARTITION BY r.request_id) = 0 THEN 'NOT_FOUND'
                WHEN count(a.id) OVER (PARTITION BY r.request_id) = 1 THEN 'FOUND' ELSE 'MULTIPLE' END AS outcome,
           a.id AS application_id
    FROM g_name_lookups r LEFT JOIN g_users u ON r.user_id = u.user_id
    LEFT JOIN g_apps a ON a.company_id = u.company_id AND length(trim(r.term)) > 0
         AND contains(lower(a.first_name || ' ' || a.last_name), lower(trim(r.term)))""",
)
def q_name_lookup(spark, sf_dir):
    """Substring name lookup inside the tenant (n-gram probe, exact)."""
    i = _in(spark, sf_dir)
    return governed.name_lookup(i["name_lookups"], i["users"], i["applications"])


@register(
    "applicant_display",
    """
    SELECT id, company_id, first_name || ' ' || last_name AS name, status,
           CASE WHEN role_fit_score IS NULL THEN '—' ELSE printf('%.0f', role_fit_score) END AS role_fit,
           CASE WHEN has_passed_screening THEN '✅' WHEN NOT has_passed_screening THEN '❌' ELSE '—' END AS screening
    FROM g_apps""",
)
def q_applicant_display(spark, sf_dir):
    """Display projection of applications."""
    return governed.applicant_display(_in(spark, sf_dir)["applications"])


@register(
    "access_check",
    """
    SELECT r.request_id, r.user_id, r.dataset, g.user_id IS NOT NULL AS allowed,
           CASE WHEN g.user_id IS NOT NULL THEN 'Tables in ' || r.dataset || ': ' || coalesce(t.tables, '')
                ELSE 'Access denied: no permission for `' || r.dataset || '`' END AS message
    FROM g_access_requests r
    LEFT JOIN g_grants g ON r.user_id = g.user_id AND r.dataset = g.dataset
    LEFT JOIN (SELECT dataset, string_agg(table_name, ', ' ORDER BY table_name) AS tables
               FROM g_catalog GROUP BY dataset) t ON r.dataset = t.dataset""",
)
def q_access_check(spark, sf_dir):
    """Dataset grants per request."""
    i = _in(spark, sf_dir)
    return governed.access_check(i["access_requests"], i["grants"], gi.catalog(spark))


@register(
    "granted_tables",
    "SELECT g.user_id, g.dataset, c.table_name FROM g_grants g JOIN g_catalog c ON g.dataset = c.dataset",
)
def q_granted_tables(spark, sf_dir):
    """The catalog tables each user may list (granted datasets only)."""
    i = _in(spark, sf_dir)
    return governed.granted_tables(i["grants"], gi.catalog(spark))


_COST = """
    (SELECT q.*, u.cost_limit_usd,
            CAST(CASE WHEN contains(lower(q.sql), 'hr.') THEN 50000000000
                      WHEN contains(lower(q.sql), 'marketing.') THEN 2000000000 ELSE 500000000 END AS BIGINT) AS bytes
     FROM g_query_log q LEFT JOIN g_users u ON q.user_id = u.user_id)"""


@register(
    "query_cost_report",
    f"""
    SELECT query_id, user_id, bytes, round(CAST(bytes AS DOUBLE) / CAST(1e12 AS DOUBLE) * 5.0, 4) AS cost_usd,
           cost_limit_usd,
           CASE WHEN CAST(bytes AS DOUBLE) / CAST(1e12 AS DOUBLE) * 5.0 <= cost_limit_usd THEN 'UNDER' ELSE 'OVER' END
               AS status
    FROM {_COST}""",
)
def q_cost_report(spark, sf_dir):
    """Simulated scan cost per logged query vs the user's limit."""
    i = _in(spark, sf_dir)
    return governed.query_cost_report(i["query_log"], i["users"])


@register(
    "query_cost_report_hr",
    """
    SELECT query_id, user_id, bytes, round(CAST(bytes AS DOUBLE) / CAST(1e12 AS DOUBLE) * 5.0, 4) AS cost_usd,
           cost_limit_usd,
           CASE WHEN CAST(bytes AS DOUBLE) / CAST(1e12 AS DOUBLE) * 5.0 <= cost_limit_usd THEN 'UNDER' ELSE 'OVER' END
               AS status
    FROM (SELECT q.*, u.cost_limit_usd,
                 CAST(CASE WHEN contains(lower(q.sql), 'job_application') THEN 50000000000
                           WHEN contains(lower(q.sql), 'talent_acquisition.job') THEN 2000000000
                           ELSE 500000000 END AS BIGINT) AS bytes
          FROM g_hr_query_log q LEFT JOIN g_users u ON q.user_id = u.user_id)""",
)
def q_cost_report_hr(spark, sf_dir):
    """E24, HR dataset sizes (job applications, jobs, other)."""
    i = _in(spark, sf_dir)
    return governed.query_cost_report(i["hr_query_log"], i["users"], variant="hr")


@register(
    "query_cost_by_user",
    f"""
    SELECT user_id, count(*) AS queries,
           count(*) FILTER (WHERE CAST(bytes AS DOUBLE) / CAST(1e12 AS DOUBLE) * 5.0 > cost_limit_usd) AS over_limit,
           round(sum(round(CAST(bytes AS DOUBLE) / CAST(1e12 AS DOUBLE) * 5.0, 4)), 4) AS total_cost_usd
    FROM {_COST} GROUP BY user_id""",
)
def q_cost_by_user(spark, sf_dir):
    """Per-user totals."""
    i = _in(spark, sf_dir)
    return governed.cost_by_user(governed.query_cost_report(i["query_log"], i["users"]))


@register(
    "collection_progress",
    """
    SELECT i.player_id, count(*) AS owned, (SELECT count(*) FROM dim_characters) AS total,
           list(c.character_id ORDER BY CASE c.rarity WHEN 'SSR' THEN 1 WHEN 'SR' THEN 2 ELSE 3 END, c.character_id)
               AS owned_characters
    FROM (SELECT DISTINCT player_id, character_id FROM stg_player_inventory) i
    JOIN dim_characters c ON i.character_id = c.character_id
    GROUP BY i.player_id""",
)
def q_collection_progress(spark, sf_dir):
    """Owned / total characters per player, ordered by rarity."""
    w = wh(spark, sf_dir)
    return governed.collection_progress(w.table("stg_player_inventory"), w.table("dim_characters"))


@register(
    "bought_packages",
    "SELECT DISTINCT player_id, package_id FROM fact_transactions WHERE payment_status = 'success'",
)
def q_bought_packages(spark, sf_dir):
    """Packages already bought successfully."""
    return governed.bought_packages(wh(spark, sf_dir).table("fact_transactions"))


@register(
    "entity_metrics",
    """
    SELECT r.request_id, lower(trim(r.department)) AS department, m.headcount IS NOT NULL AS found,
           m.headcount, m.active_today, m.headcount - m.active_today AS inactive,
           CASE WHEN m.headcount IS NOT NULL THEN round(m.active_today * 100.0 / m.headcount, 1) END AS active_pct,
           CASE WHEN m.headcount IS NOT NULL THEN
                lower(trim(r.department)) || ': ' || m.active_today || ' of ' || m.headcount || ' active ('
                || CAST(round(m.active_today * 100.0 / m.headcount, 1) AS DOUBLE) || '%), '
                || (m.headcount - m.active_today) || ' inactive'
                ELSE 'Unknown department: ' || lower(trim(r.department)) || '. Valid: '
                     || (SELECT string_agg(department, ', ' ORDER BY department) FROM g_dept_metrics) END AS report
    FROM g_dept_requests r LEFT JOIN g_dept_metrics m ON lower(trim(r.department)) = m.department""",
)
def q_entity_metrics(spark, sf_dir):
    """Department metrics report per request."""
    i = _in(spark, sf_dir)
    return governed.entity_metrics(i["dept_requests"], i["dept_metrics"])


_MSG = """
    CASE WHEN outcome = 'OK' THEN '[OK] ' || first_name || ' ' || last_name || ' moved ''' || old_status
                                  || ''' → ''' || new_status || ''' (mutation #' || mutation_no || ' this run)'
         WHEN outcome = 'DENIED' AND NOT can THEN '[DENIED] ' || user_id || ' (' || coalesce(role, 'unknown')
                                  || ') does not have permission to change applicant status.'
         WHEN outcome = 'STOPPED' THEN '[STOPPED] Mutation cap of ' || cap || ' reached. No further changes allowed this run.'
         WHEN outcome = 'ERROR' THEN '[ERROR] ''' || new_status || ''' is not a valid status.'
         WHEN outcome = 'DENIED' THEN '[DENIED] Application ''' || application_id
                                  || ''' not found or belongs to another company.'
         ELSE '[DENIED by operator] ''' || new_status || ''' transition for ' || first_name || ' ' || last_name
              || ' was rejected.' END"""


@register(
    "status_changes",
    f"""
    SELECT request_id, run_id, user_id, application_id, new_status, outcome, mutation_no, old_status,
           {_MSG} AS message
    FROM g_changes""",
)
def q_status_changes(spark, sf_dir):
    """H1: capped, tenant-scoped status changes with per-run mutation count."""
    return _changes(spark, sf_dir)


@register(
    "apply_status",
    """
    SELECT a.id, a.company_id, a.first_name, a.last_name, coalesce(l.new_status, a.status) AS status,
           a.role_fit_score, a.has_passed_screening
    FROM g_apps a LEFT JOIN (SELECT application_id, arg_max(new_status, request_id) AS new_status
                             FROM g_changes WHERE outcome = 'OK' GROUP BY application_id) l
      ON a.id = l.application_id""",
)
def q_apply_status(spark, sf_dir):
    """H2: application states after the successful changes."""
    i = _in(spark, sf_dir)
    ch = _changes(spark, sf_dir)
    return governed.apply_status(i["applications"], ch)


_TRIAGE = """
    SELECT id, company_id, status, role_fit_score, {action} AS action,
           CASE WHEN {action} IN ('shortlisted', 'rejected') THEN {action} ELSE status END AS new_status
    FROM g_apps"""


@register(
    "score_triage",
    _TRIAGE.format(
        action="CASE WHEN role_fit_score IS NULL THEN 'skip' WHEN role_fit_score > 70 THEN 'shortlisted' "
        "WHEN role_fit_score < 50 THEN 'rejected' ELSE 'unchanged' END"
    ),
)
def q_score_triage(spark, sf_dir):
    """H3: score triage >70 shortlisted, <50 rejected."""
    return governed.score_triage(_in(spark, sf_dir)["applications"])


@register(
    "score_triage_threshold",
    _TRIAGE.format(
        action="CASE WHEN role_fit_score IS NULL THEN 'skip' WHEN role_fit_score >= 80 THEN 'shortlisted' "
        "ELSE 'unchanged' END"
    ),
)
def q_score_triage_threshold(spark, sf_dir):
    """H3 variant: >= threshold (80) shortlisted."""
    return governed.score_triage(_in(spark, sf_dir)["applications"], threshold=80)


@register(
    "audit_log",
    """
    SELECT run_id, request_id AS seq, 'move_applicant_status' AS tool,
           json_object('application_id', application_id, 'new_status', new_status)::VARCHAR AS args, outcome
    FROM g_changes""",
)
def q_audit_log(spark, sf_dir):
    """H4: audit rows of the status-change tool calls."""
    return governed.audit_log(_changes(spark, sf_dir))


@register(
    "audit_summary",
    """
    SELECT run_id, count(*) AS calls, count(*) FILTER (WHERE outcome = 'OK') AS ok,
           count(*) FILTER (WHERE outcome = 'DENIED') AS denied, count(*) FILTER (WHERE outcome = 'STOPPED') AS stopped,
           count(*) FILTER (WHERE outcome = 'ERROR') AS errors,
           count(*) FILTER (WHERE outcome = 'DENIED_BY_OPERATOR') AS operator_denials,
           count(*) FILTER (WHERE outcome = 'DENIED_BY_OPERATOR') >= 2 AS replan
    FROM g_changes GROUP BY run_id""",
)
def q_audit_summary(spark, sf_dir):
    """H4: per-run audit summary with the replan flag."""
    return governed.audit_summary(_changes(spark, sf_dir))

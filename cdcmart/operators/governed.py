"""Governed table access and capped status changes.

Per-request tool calls become request tables evaluated in one job: grants
and tenant scope are joins, the mutation cap is a per-run top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcmart.functions.columns import template
from cdcmart.sources.governed_inputs import TERMINAL_STATUSES, VALID_STATUSES

_VALID_SORTED = ", ".join(sorted(VALID_STATUSES))

# ---------------------------------------------------------------------------
# FIXED VALUES: response texts of the governed tools ({name} = filled in)
# ---------------------------------------------------------------------------
TEXTS = {
    "status_filter_invalid": "[ERROR] '{status}' is not valid. Choose from: {valid}",
    "moved": "[OK] {name} moved '{old}' → '{new}' (mutation #{n} this run)",
    "no_permission": "[DENIED] {user} ({role}) does not have permission to change applicant status.",
    "cap_reached": "[STOPPED] Mutation cap of {cap} reached. No further changes allowed this run.",
    "status_invalid": "[ERROR] '{new}' is not a valid status.",
    "not_in_tenant": "[DENIED] Application '{app}' not found or belongs to another company.",
    "operator_denied": "[DENIED by operator] '{new}' transition for {name} was rejected.",
    "tables": "Tables in {dataset}: {tables}",
    "access_denied": "Access denied: no permission for `{dataset}`",
    "unknown_key": "Unknown department: {key}. Valid: {valid}",
}


def _valid(c: Column) -> Column:
    return c.isin(*VALID_STATUSES)


# --- E20 tenant-scoped listing ------------------------------------------------


def full_name() -> Column:
    """'first last' of an application; without one of them there is no name."""
    return F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))


def tenant_applicants(requests: DataFrame, users: DataFrame, apps: DataFrame) -> DataFrame:
    """Per list request, the tenant's applicants (optionally one status).

    ``company_id`` of the requesting user is always applied. An unknown
    status yields one error row naming the valid statuses in sorted order.
    Rows are ordered by score descending with nulls last.
    """
    u = users.select("user_id", F.col("company_id").alias("_tenant"))
    r = requests.join(u, "user_id", "left")
    bad = r.where(F.col("status_filter").isNotNull() & ~_valid(F.col("status_filter")))
    errors = bad.select(
        "request_id",
        F.lit(None).cast("string").alias("application_id"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("double").alias("role_fit_score"),
        template(TEXTS["status_filter_invalid"], status=F.col("status_filter"), valid=_VALID_SORTED).alias("error"),
    )
    good = r.where(F.col("status_filter").isNull() | _valid(F.col("status_filter")))
    a = apps.select(
        F.col("id").alias("application_id"),
        F.col("company_id").alias("_tenant"),
        full_name().alias("name"),
        "status",
        "role_fit_score",
    )
    cond = (good["_tenant"] == a["_tenant"]) & (good["status_filter"].isNull() | (good["status_filter"] == a["status"]))
    rows = good.join(a, cond, "inner").select(
        "request_id", "application_id", "name", "status", "role_fit_score", F.lit(None).cast("string").alias("error")
    )
    return rows.unionByName(errors).orderBy("request_id", F.desc_nulls_last("role_fit_score"), "application_id")


# --- E21 name lookup (substring match inside the tenant) ---------------------


#: Posting lists are dealt over this many keys, so a gram that most names share is
#: read by many tasks.
POSTING_SPLITS = 16


def name_matches(terms: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """Substring matches of distinct ``(tenant, term)`` in ``(tenant, application_id,
    name)``: an inverted index of grams, probed by the rarest gram of each term.

    Every name is listed under its distinct grams (of ``gram`` characters, and of the
    lengths of shorter terms); a term of which one gram is in no name of the tenant
    has no match, any other is compared (``contains``) with the names of its least
    frequent gram alone. Exact; empty and null terms match nothing.
    """
    want = terms.where(F.length("term") > 0).select("tenant", "term").distinct().withColumn("_len", F.least(F.length("term"), F.lit(gram)))
    lens = F.broadcast(want.select("_len").distinct())  # at most ``gram`` rows

    def grams(df: DataFrame, text: str) -> DataFrame:
        fits = F.length(text) >= F.col("_len")
        at = F.when(fits, F.sequence(F.lit(1), F.greatest(F.length(text) - F.col("_len") + 1, F.lit(1))))
        return df.withColumn("_g", F.explode(F.array_distinct(F.transform(at, lambda p: F.substring(F.col(text), p, F.col("_len"))))))

    index = grams(names.where(F.col("name").isNotNull()).select("tenant", "application_id", "name").join(lens), "name")
    sizes = index.groupBy("tenant", "_len", "_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        grams(want, "term")
        .join(sizes, ["tenant", "_len", "_g"], "left")
        .groupBy("tenant", "term", "_len")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_g")).alias("_r"))
        .where(F.col("_r._n") > 0)
    )
    probes = rarest.select(
        "tenant", "term", "_len", F.col("_r._g").alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(POSTING_SPLITS - 1))).alias("_split")
    )
    postings = index.withColumn("_split", F.pmod(F.xxhash64("application_id"), F.lit(POSTING_SPLITS)).cast("int"))
    found = probes.join(postings, ["tenant", "_len", "_g", "_split"]).where(F.col("name").contains(F.col("term")))
    return found.select("tenant", "term", "application_id")


def name_lookup(lookups: DataFrame, users: DataFrame, apps: DataFrame, gram: int = 3) -> DataFrame:
    """Trimmed, lower-cased substring match on 'first last' in the tenant.

    Exact and without a per-tenant cross product: each distinct (tenant, term) is
    matched once (:func:`name_matches`). Returns one row per (request, matched
    application) — a request without matches gets one row with a null id —
    with the request's match count and outcome NOT_FOUND / FOUND / MULTIPLE.
    """
    u = users.select("user_id", F.col("company_id").alias("tenant"))
    req = lookups.join(u, "user_id", "left").withColumn("_t", F.lower(F.trim("term")))
    names = apps.select(F.col("id").alias("application_id"), F.col("company_id").alias("tenant"), F.lower(full_name()).alias("name"))
    hits = name_matches(req.select("tenant", F.col("_t").alias("term")), names, gram).withColumnRenamed("term", "_t")
    # One row per (request, match): the match list is never gathered into
    # one value. Counts come from an aggregate of the distinct terms.
    n = hits.groupBy("tenant", "_t").agg(F.count(F.lit(1)).alias("matches"))
    r = req.select("request_id", "user_id", "term", "tenant", "_t").join(n, ["tenant", "_t"], "left")
    cnt = F.coalesce(F.col("matches"), F.lit(0))
    r = r.select(
        "request_id", "user_id", "term", "tenant", "_t", cnt.alias("matches"),
        F.when(cnt == 0, "NOT_FOUND").when(cnt == 1, "FOUND").otherwise("MULTIPLE").alias("outcome"),
    )
    return r.join(hits, ["tenant", "_t"], "left").select("request_id", "user_id", "term", "matches", "outcome", "application_id")


# --- E22 display projection ---------------------------------------------------


def applicant_display(apps: DataFrame) -> DataFrame:
    """Name, status, score as '%.0f' or an em dash, screening as a symbol."""
    score = F.when(F.col("role_fit_score").isNull(), F.lit("—")).otherwise(
        F.format_number(F.col("role_fit_score"), 0)
    )
    passed = (
        F.when(F.col("has_passed_screening") == True, F.lit("✅"))  # noqa: E712
        .when(F.col("has_passed_screening") == False, F.lit("❌"))  # noqa: E712
        .otherwise(F.lit("—"))
    )
    return apps.select(
        "id",
        "company_id",
        full_name().alias("name"),
        "status",
        F.regexp_replace(score, ",", "").alias("role_fit"),
        passed.alias("screening"),
    )


# --- E23 dataset grants ----------------------------------------------------------


def access_check(requests: DataFrame, grants: DataFrame, catalog: DataFrame) -> DataFrame:
    """Allowed flag per request; granted requests list the dataset's tables."""
    g = grants.select("user_id", "dataset", F.lit(True).alias("_ok")).dropDuplicates(["user_id", "dataset"])
    tables = catalog.groupBy("dataset").agg(F.array_join(F.array_sort(F.collect_list("table_name")), ", ").alias("_t"))
    r = requests.join(g, ["user_id", "dataset"], "left").join(tables, "dataset", "left")
    allowed = F.coalesce(F.col("_ok"), F.lit(False))
    msg = F.when(allowed, template(TEXTS["tables"], dataset=F.col("dataset"), tables=F.coalesce(F.col("_t"), F.lit(""))))
    msg = msg.otherwise(template(TEXTS["access_denied"], dataset=F.col("dataset")))
    return r.select("request_id", "user_id", "dataset", allowed.alias("allowed"), msg.alias("message"))


def granted_tables(grants: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog rows a user may see (semi join on the grants)."""
    return grants.join(catalog, "dataset", "inner").select("user_id", "dataset", "table_name")


# --- E24 cost report ---------------------------------------------------------------

GB = 1_000_000_000


def scan_bytes(sql: Column, variant: str = "warehouse") -> Column:
    """Simulated bytes scanned by a query text (FIXED VALUES of the cost model)."""
    s = F.lower(sql)
    if variant == "warehouse":
        return F.when(s.contains("hr."), F.lit(50 * GB)).when(s.contains("marketing."), F.lit(2 * GB)).otherwise(
            F.lit(GB // 2)
        )
    return (
        F.when(s.contains("job_application"), F.lit(50 * GB))
        .when(s.contains("talent_acquisition.job"), F.lit(2 * GB))
        .otherwise(F.lit(GB // 2))
    )


def query_cost_report(
    query_log: DataFrame, users: DataFrame, price_per_tb: float = 5.0, variant: str = "warehouse"
) -> DataFrame:
    """Cost per query = bytes / 1e12 * price; UNDER when cost <= limit.
    ``variant="hr"`` uses the HR dataset sizes."""
    u = users.select("user_id", "cost_limit_usd")
    q = query_log.join(u, "user_id", "left").withColumn("bytes", scan_bytes(F.col("sql"), variant).cast("long"))
    cost = F.col("bytes").cast("double") / 1e12 * price_per_tb
    return q.select(
        "query_id",
        "user_id",
        "bytes",
        F.round(cost, 4).alias("cost_usd"),
        "cost_limit_usd",
        F.when(cost <= F.col("cost_limit_usd"), "UNDER").otherwise("OVER").alias("status"),
    )


def cost_by_user(report: DataFrame) -> DataFrame:
    return report.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("status") == "OVER").alias("over_limit"),
        F.round(F.sum("cost_usd"), 4).alias("total_cost_usd"),
    )


# --- E25 / E26 --------------------------------------------------------------------


def collection_progress(inventory: DataFrame, characters: DataFrame) -> DataFrame:
    """Owned / total characters per player, owned list by rarity rank SSR, SR, R.

    The total is a scalar subquery over the character dimension.
    """
    total = characters.select(F.count(F.lit(1))).scalar()
    rank = F.when(F.col("rarity") == "SSR", 1).when(F.col("rarity") == "SR", 2).otherwise(3)
    c = characters.select("character_id", rank.alias("_rank"))
    owned = inventory.select("player_id", "character_id").distinct().join(c, "character_id", "inner")
    g = owned.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("owned"),
        F.array_sort(F.collect_list(F.struct("_rank", "character_id"))).alias("_l"),
    )
    return g.select(
        "player_id",
        "owned",
        total.alias("total"),
        F.transform("_l", lambda x: x["character_id"]).alias("owned_characters"),
    )


def bought_packages(transactions: DataFrame) -> DataFrame:
    """Packages a player already bought successfully."""
    return transactions.where(F.col("payment_status") == "success").select("player_id", "package_id").distinct()


# --- E27 entity metrics ---------------------------------------------------------------


def entity_metrics(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Lower-cased key lookup with active percent and inactive count;
    unknown keys get an error naming the valid keys in sorted order."""
    valid = metrics.select(F.array_join(F.array_sort(F.collect_list("department")), ", ")).scalar()
    r = requests.withColumn("_key", F.lower(F.trim("department")))
    j = r.join(metrics.withColumnRenamed("department", "_key"), "_key", "left")
    found = F.col("headcount").isNotNull()
    pct = F.round(F.col("active_today") * 100.0 / F.col("headcount"), 1).cast("double")
    report = F.when(
        found,
        F.concat(
            F.col("_key"), F.lit(": "), F.col("active_today").cast("string"), F.lit(" of "),
            F.col("headcount").cast("string"), F.lit(" active ("), pct.cast("string"), F.lit("%), "),
            (F.col("headcount") - F.col("active_today")).cast("string"), F.lit(" inactive"),
        ),
    ).otherwise(template(TEXTS["unknown_key"], key=F.col("_key"), valid=valid))
    return j.select(
        "request_id",
        F.col("_key").alias("department"),
        found.alias("found"),
        "headcount",
        "active_today",
        (F.col("headcount") - F.col("active_today")).alias("inactive"),
        F.when(found, pct).alias("active_pct"),
        report.alias("report"),
    )


# --- H1-H4 status changes ---------------------------------------------------------------


def status_changes(requests: DataFrame, apps: DataFrame, users: DataFrame, cap: int = 5) -> DataFrame:
    """H1: apply status-change requests in ``request_id`` order within each run.

    A run belongs to one user, whose ``mutation_cap`` is the run's cap (``cap``
    where that column is missing or null).
    First failing rule wins: role may not move -> DENIED; cap successes
    earlier in the run -> STOPPED; unknown status -> ERROR; application not
    in the tenant -> DENIED; terminal without approval -> DENIED_BY_OPERATOR;
    else OK. The first ``cap`` candidates (rows passing every rule but the
    cap) of a run are exactly its successes, so the cap is a per-run top-k:
    ``row_number() <= cap`` over candidates, which Spark evaluates with a
    map-side group limit (a hot run costs ``cap`` rows per task, not a sort
    of the whole run). Later rows of a permitted role are STOPPED once the
    run has ``cap`` successes.
    """
    own_cap = F.coalesce(F.col("mutation_cap") if "mutation_cap" in users.columns else F.lit(None), F.lit(cap)).cast("int")
    u = users.select("user_id", F.col("company_id").alias("_tenant"), "can_move_status", "role", own_cap.alias("_cap"))
    top = max(u.agg(F.max("_cap")).first()[0] or cap, cap)  # a literal bound keeps the map-side group limit
    a = apps.select(
        F.col("id").alias("application_id"), F.col("company_id").alias("_app_tenant"), "first_name", "last_name",
        F.col("status").alias("current_status"),
    )
    r = requests.join(u, "user_id", "left").join(a, "application_id", "left")
    can = F.coalesce(F.col("can_move_status"), F.lit(False))
    valid = _valid(F.col("new_status"))
    in_tenant = F.coalesce(F.col("_app_tenant") == F.col("_tenant"), F.lit(False))
    op_denied = F.col("new_status").isin(*TERMINAL_STATUSES) & ~F.coalesce(F.col("approved"), F.lit(True))
    # The joined request table feeds three branches (all rows, the per-run
    # top-k and its summary): checkpoint it once to the shared folder
    # instead of re-reading and re-joining the inputs per branch.
    r = r.withColumn("_cand", can & valid & in_tenant & ~op_denied).checkpoint(eager=True)

    w = Window.partitionBy("run_id").orderBy("request_id")
    ok = (
        r.where("_cand")
        .select("request_id", "run_id", "_cap", F.row_number().over(w).alias("mutation_no"))
        .where(F.col("mutation_no") <= top)
        .where(F.col("mutation_no") <= F.col("_cap"))
    )
    full_runs = (
        ok.groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("request_id").alias("_last_ok"), F.max("_cap").alias("_run_cap"))
        .where(F.col("_n") >= F.col("_run_cap"))
        .select("run_id", "_last_ok")
    )
    j = r.join(ok.select("request_id", "mutation_no"), "request_id", "left").join(full_runs, "run_id", "left")
    stopped = F.col("_last_ok").isNotNull() & (F.col("request_id") > F.col("_last_ok"))
    outcome = (
        F.when(~can, "DENIED")
        .when(stopped, "STOPPED")
        .when(~valid, "ERROR")
        .when(~in_tenant, "DENIED")
        .when(op_denied, "DENIED_BY_OPERATOR")
        .otherwise("OK")
    )
    j = j.withColumn("outcome", outcome)
    # Old status: the previous successful move of the same application, else
    # current (a last-value scan over the successes; skew-safe per application).
    from cdcmart.operators.scan import segmented_scan

    oks = segmented_scan(
        j.where(F.col("outcome") == "OK"), ["application_id"], ["request_id"],
        {"_prev": ("last", F.col("new_status"), False)},
    ).withColumn("old_status", F.coalesce(F.col("_prev"), F.col("current_status"))).drop("_prev")
    rest = j.where(F.col("outcome") != "OK").withColumn("old_status", F.lit(None).cast("string"))
    res = oks.unionByName(rest)
    name = F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))
    new = F.col("new_status")
    msg = (
        F.when(F.col("outcome") == "OK", template(
            TEXTS["moved"], name=name, old=F.col("old_status"), new=new, n=F.col("mutation_no").cast("string")))
        .when((F.col("outcome") == "DENIED") & ~can, template(
            TEXTS["no_permission"], user=F.col("user_id"), role=F.coalesce(F.col("role"), F.lit("unknown"))))
        .when(F.col("outcome") == "STOPPED", template(TEXTS["cap_reached"], cap=F.col("_cap").cast("string")))
        .when(F.col("outcome") == "ERROR", template(TEXTS["status_invalid"], new=new))
        .when(F.col("outcome") == "DENIED", template(TEXTS["not_in_tenant"], app=F.col("application_id")))
        .otherwise(template(TEXTS["operator_denied"], new=new, name=name))
    )
    return res.select(
        "request_id", "run_id", "user_id", "application_id", "new_status", "outcome",
        F.when(F.col("outcome") == "OK", F.col("mutation_no")).alias("mutation_no"), "old_status", msg.alias("message"),
    )


def apply_status(apps: DataFrame, changes: DataFrame) -> DataFrame:
    """H2: application state after the successful changes (latest wins)."""
    last = (
        changes.where(F.col("outcome") == "OK")
        .groupBy("application_id")
        .agg(F.max_by("new_status", "request_id").alias("_new"))
    )
    j = apps.join(last, apps["id"] == last["application_id"], "left")
    return j.select(*[F.coalesce(F.col("_new"), F.col("status")).alias("status") if c == "status" else F.col(c)
                      for c in apps.columns])


def score_triage(apps: DataFrame, hi: float = 70, lo: float = 50, threshold: float | None = None) -> DataFrame:
    """H3: > hi shortlisted, < lo rejected, null skipped, else unchanged.

    With ``threshold``: >= threshold shortlisted, null skipped, else unchanged.
    """
    s = F.col("role_fit_score")
    if threshold is None:
        action = F.when(s.isNull(), "skip").when(s > hi, "shortlisted").when(s < lo, "rejected").otherwise("unchanged")
    else:
        action = F.when(s.isNull(), "skip").when(s >= threshold, "shortlisted").otherwise("unchanged")
    return apps.select(
        "id", "company_id", "status", "role_fit_score", action.alias("action"),
        F.when(action.isin("shortlisted", "rejected"), action).otherwise(F.col("status")).alias("new_status"),
    )


def audit_log(changes: DataFrame, tool: str = "move_applicant_status") -> DataFrame:
    """H4: the append-only audit rows of tool calls: (run, seq, tool, args, outcome)."""
    return changes.select(
        "run_id",
        F.col("request_id").alias("seq"),
        F.lit(tool).alias("tool"),
        F.to_json(F.struct("application_id", "new_status")).alias("args"),
        "outcome",
    )


def audit_summary(changes: DataFrame, replan_after: int = 2) -> DataFrame:
    """H4: per run: calls and outcomes; >= 2 operator denials flags a replan."""
    o = F.col("outcome")
    return changes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(o == "OK").alias("ok"),
        F.count_if(o == "DENIED").alias("denied"),
        F.count_if(o == "STOPPED").alias("stopped"),
        F.count_if(o == "ERROR").alias("errors"),
        F.count_if(o == "DENIED_BY_OPERATOR").alias("operator_denials"),
    ).withColumn("replan", F.col("operator_denials") >= replan_after)

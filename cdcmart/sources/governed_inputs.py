"""Driver tables -> inputs of the governed-access operators.

applications   customer: tenant = nation, score = acctbal / 100 (null when
               negative), status and screening flag cycle over the key;
               custkey % 47 = 20 has no last name
users          nation: one user per tenant; every fourth is read-only; mutation
               caps cycle over 3 to 6
status_requests orders x customer: a run is (user, order year); every tenth
               request is issued by the next tenant's user
list_requests  nation: status filter cycles over valid, invalid and none
name_lookups   supplier: a digit term or a segment prefix, padded
access_requests supplier: dataset cycles over the three datasets
query_log      orders: three query templates
dept_requests  nation: department names, some upper-cased, one unknown
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cdcmart.sources.tables import load

# FIXED VALUES: application statuses in their declared order; terminal ones.
VALID_STATUSES = ["applied", "sourced", "shortlisted", "interviewed", "offered", "hired", "rejected", "withdrawn"]
TERMINAL_STATUSES = ["hired", "rejected"]
DATASETS = ["sales", "marketing", "hr"]
# Catalog of the governed datasets: (dataset, table).
CATALOG = [("sales", "orders"), ("sales", "products"), ("marketing", "campaigns"), ("hr", "employees")]
QUERY_TEMPLATES = [
    "SELECT * FROM hr.employees",
    "SELECT name, budget FROM Marketing.campaigns",
    "SELECT count(*) FROM sales.orders",
]
HR_QUERY_TEMPLATES = [
    "SELECT first_name, role_fit_score FROM talent_acquisition.job_application",
    "SELECT title FROM talent_acquisition.job",
    "SELECT id FROM identity.users",
]
DEPARTMENTS = ["automobile", "building", "furniture", "household", "machinery", "support"]


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def applications(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        F.concat(F.lit("app-"), k.cast("string")).alias("id"),
        F.col("c_nationkey").cast("long").alias("company_id"),
        F.lower("c_mktsegment").alias("first_name"),
        F.when(k % 47 != 20, F.expr("substring(c_name, 10)")).alias("last_name"),
        _pick(VALID_STATUSES, k % 8).alias("status"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100.0).alias("role_fit_score"),
        F.when(k % 3 == 1, F.lit(True)).when(k % 3 == 2, F.lit(False)).alias("has_passed_screening"),
    )


def users(nation: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    can = n % 4 != 3
    return nation.select(
        F.concat(F.lit("user-"), n.cast("string")).alias("user_id"),
        n.cast("long").alias("company_id"),
        F.when(can, "HR Manager").otherwise("Recruiter (read-only)").alias("role"),
        can.alias("can_move_status"),
        (n % 4 + 3).cast("int").alias("mutation_cap"),
        F.when(n % 2 == 0, 0.01).otherwise(0.1).alias("cost_limit_usd"),
    )


def grants(nation: DataFrame) -> DataFrame:
    """Dataset grants: sales for all; marketing for even regions; hr every fifth nation."""
    n = F.col("n_nationkey")
    ds = F.array(
        F.lit("sales"),
        F.when(F.col("n_regionkey") % 2 == 0, F.lit("marketing")),
        F.when(n % 5 == 0, F.lit("hr")),
    )
    return nation.select(
        F.concat(F.lit("user-"), n.cast("string")).alias("user_id"), F.explode(ds).alias("dataset")
    ).where(F.col("dataset").isNotNull())


def status_requests(orders: DataFrame, customer: DataFrame) -> DataFrame:
    ok = F.col("o_orderkey")
    c = customer.select("c_custkey", "c_nationkey")
    tenant = F.when(ok % 10 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    user = F.concat(F.lit("user-"), tenant.cast("string"))
    return orders.join(c, orders["o_custkey"] == c["c_custkey"]).select(
        ok.alias("request_id"),
        F.concat(user, F.lit(":"), F.year("o_orderdate").cast("string")).alias("run_id"),
        user.alias("user_id"),
        F.concat(F.lit("app-"), F.col("o_custkey").cast("string")).alias("application_id"),
        _pick(VALID_STATUSES + ["archived"], ok % 9).alias("new_status"),
        (F.col("o_orderpriority") != "5-LOW").alias("approved"),
    )


def list_requests(nation: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    idx = n % 10
    status = F.when(idx < 8, _pick(VALID_STATUSES, idx)).when(idx == 8, F.lit("archived"))
    return nation.select(
        n.cast("long").alias("request_id"),
        F.concat(F.lit("user-"), n.cast("string")).alias("user_id"),
        status.alias("status_filter"),
    )


def name_lookups(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    term = F.when(k % 4 == 0, F.lit(" House ")).otherwise(F.concat(F.lit(" "), F.substring("s_name", 15, 4), F.lit(" ")))
    return supplier.select(
        k.alias("request_id"),
        F.concat(F.lit("user-"), F.col("s_nationkey").cast("string")).alias("user_id"),
        term.alias("term"),
    )


def access_requests(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("request_id"),
        F.concat(F.lit("user-"), F.col("s_nationkey").cast("string")).alias("user_id"),
        _pick(DATASETS, k % 3).alias("dataset"),
    )


def query_log(orders: DataFrame, templates=QUERY_TEMPLATES) -> DataFrame:
    ok = F.col("o_orderkey")
    return orders.select(
        ok.alias("query_id"),
        F.concat(F.lit("user-"), (F.col("o_custkey") % 25).cast("string")).alias("user_id"),
        _pick(templates, ok % 3).alias("sql"),
    )


def dept_metrics(customer: DataFrame) -> DataFrame:
    return customer.groupBy(F.lower("c_mktsegment").alias("department")).agg(
        F.count(F.lit(1)).alias("headcount"), F.count_if(F.col("c_acctbal") > 0).alias("active_today")
    )


def dept_requests(nation: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    d = _pick(DEPARTMENTS, n % 6)
    return nation.select(
        n.cast("long").alias("request_id"), F.when(n % 2 == 0, F.upper(d)).otherwise(d).alias("department")
    )


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "dataset string, table_name string")


def inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    cust, nat, sup, orders = (load(spark, sf_dir, t) for t in ("customer", "nation", "supplier", "orders"))
    return {
        "applications": applications(cust),
        "users": users(nat),
        "grants": grants(nat),
        "status_requests": status_requests(orders, cust),
        "list_requests": list_requests(nat),
        "name_lookups": name_lookups(sup),
        "access_requests": access_requests(sup),
        "query_log": query_log(orders),
        "hr_query_log": query_log(orders, HR_QUERY_TEMPLATES),
        "dept_metrics": dept_metrics(cust),
        "dept_requests": dept_requests(nat),
    }

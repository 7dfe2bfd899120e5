"""Metrics ticker: repo metrics, score, watchlists and fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event type -> repo activity kind.
ACTIVITY = {"view": "star", "click": "fork", "purchase": "commit", "error": "issue", "signup": "follow"}


def repo_events(events: DataFrame) -> DataFrame:
    """(repo, kind, created_at) from the event log; an unmapped type keeps its name as kind."""
    m = F.create_map(*[x for k, v in ACTIVITY.items() for x in (F.lit(k), F.lit(v))])
    return events.select(
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo"),
        F.coalesce(F.element_at(m, F.col("event_type")), F.col("event_type"), F.lit("unknown")).alias("kind"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def rolling_counts(repo_ev: DataFrame, now: Column) -> DataFrame:
    """Per repo as of ``now``: stars, forks in the last 7 days, commits
    since UTC midnight, open issues. Counts are whole."""
    t = F.col("created_at")
    seen = t <= now
    k = F.col("kind")
    return repo_ev.groupBy("repo").agg(
        F.count_if(seen & (k == "star")).alias("stars"),
        F.count_if(seen & (k == "fork") & (t >= now - F.expr("INTERVAL 7 DAYS"))).alias("forks_this_week"),
        F.count_if(seen & (k == "commit") & (t >= F.date_trunc("day", now))).alias("commits_today"),
        F.count_if(seen & (k == "issue")).alias("open_issues"),
    ).withColumn("fetched_at", now)


def rolling_series(repo_ev: DataFrame, kind: str = "fork", days: int = 7) -> DataFrame:
    """H10 as a daily series: per repo and day, events of ``kind`` that day
    and in the trailing ``days`` days (a range frame over day numbers; a
    repo's series has one row per active day, so the window stays small)."""
    from pyspark.sql import Window

    daily = (
        repo_ev.where(F.col("kind") == kind)
        .groupBy("repo", F.to_date("created_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("_d", F.unix_date("day"))
    )
    w = Window.partitionBy("repo").orderBy("_d").rangeBetween(-(days - 1), 0)
    return daily.withColumn(f"events_{days}d", F.sum("events").over(w)).drop("_d")


def repo_score(metrics: DataFrame) -> DataFrame:
    """H9: stars + 10*forks_7d + 100*commits_today - 5*open_issues."""
    return metrics.withColumn(
        "price",
        F.col("stars") + 10 * F.col("forks_this_week") + 100 * F.col("commits_today") - 5 * F.col("open_issues"),
    )


def watch_commands(events: DataFrame, clients: int = 7) -> DataFrame:
    """Subscribe/unsubscribe log: client by event id, repo by user; every
    fourth command unsubscribes."""
    eid = F.col("event_id")
    return events.select(
        eid.alias("seq"),
        (eid % clients).alias("client_id"),
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo"),
        F.when(eid % 4 == 0, "unsubscribe").otherwise("subscribe").alias("op"),
    )


def live_ticks(events: DataFrame) -> DataFrame:
    """Ticks of the event log: one per purchase, priced by its ``k``; a price of zero
    is a failed fetch."""
    price = F.get_json_object("props", "$.k").cast("long")
    repo = F.concat(F.lit("repo-"), F.col("user_id").cast("string"))
    return events.where(F.col("event_type") == "purchase").select(
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tick_id"), repo.alias("repo"), price.alias("price"),
        F.when(price == 0, F.concat(F.lit("not found: "), repo)).alias("error"),
    )


def watchlist_state(commands: DataFrame) -> DataFrame:
    """(client, repo) pairs whose last command is a subscribe.

    Idempotent by construction: only the last op per pair counts (map-side
    partial ``max_by``)."""
    last = commands.groupBy("client_id", "repo").agg(F.max_by("op", "seq").alias("_op"))
    return last.where(F.col("_op") == "subscribe").select("client_id", "repo")


def watchlists(state: DataFrame) -> DataFrame:
    """H11 view: one sorted repo list per client."""
    return state.groupBy("client_id").agg(F.sort_array(F.collect_list("repo")).alias("repos"))


def poll_set(state: DataFrame) -> DataFrame:
    """Every repo any client watches, once."""
    return state.select("repo").distinct()


def ticks(metrics: DataFrame, fail: Column | None = None) -> DataFrame:
    """One tick per polled repo; a failed fetch becomes an error tick.
    Default failure rule: a repo with no stars is not found."""
    bad = fail if fail is not None else (F.col("stars") == 0)
    return repo_score(metrics).withColumn("error", F.when(bad, F.concat(F.lit("not found: "), F.col("repo"))))


def tick_fanout(tick: DataFrame, state: DataFrame, drop_errors: bool = False) -> DataFrame:
    """One row per subscriber of each tick; errors fan out as 'error'
    rows unless ``drop_errors`` (the gRPC variant)."""
    j = state.join(tick, "repo", "inner")
    if drop_errors:
        j = j.where(F.col("error").isNull())
    is_err = F.col("error").isNotNull()
    return j.select(
        "client_id",
        "repo",
        F.when(is_err, "error").otherwise("tick").alias("kind"),
        F.when(~is_err, F.col("price")).alias("price"),
        F.when(is_err, F.col("error")).alias("message"),
    )

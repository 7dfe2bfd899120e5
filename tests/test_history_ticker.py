"""History compaction (5, 6, 12 entries), escalation split, watchlists."""

from cdcmart.operators import history, ticker


def steps(spark, n, sid=1):
    rows = [(sid, i, "USE_TOOL" if i % 2 else "ASK_USER", "calc" if i % 2 else None, f"r{i}") for i in range(n)]
    return spark.createDataFrame(rows, "session_id long, seq long, action string, tool string, result string")


def test_compaction_sizes(spark):
    assert steps(spark, 5).count() == history.compact_history(steps(spark, 5)).count()
    six = sorted(history.compact_history(steps(spark, 6)).collect(), key=lambda r: r["seq"])
    assert len(six) == 4 and six[0]["action"] == "COMPACTED_SUMMARY" and six[0]["compacted_count"] == 3
    assert six[0]["result"] == "Previously: Asked user, got: r0. Used calc. Asked user, got: r2."
    twelve = history.compact_history(steps(spark, 12)).collect()
    assert len(twelve) == 4 and max(r["compacted_count"] or 0 for r in twelve) == 9


def test_escalation(spark):
    df = spark.createDataFrame([("ESCALATE:  too hard \n\n more context \n",), ("plain",)], "text string")
    r = history.split_escalation(df).collect()
    assert (r[0]["escalated"], r[0]["reason"], r[0]["context"]) == (True, "too hard", "more context")
    assert (r[1]["escalated"], r[1]["reason"]) == (False, None)


def test_watchlist_idempotent(spark):
    cmds = spark.createDataFrame(
        [(1, 0, "r1", "subscribe"), (2, 0, "r1", "subscribe"), (3, 0, "r2", "subscribe"), (4, 0, "r2", "unsubscribe"),
         (5, 1, "r2", "subscribe")], "seq long, client_id long, repo string, op string")
    st = ticker.watchlist_state(cmds)
    assert {(r["client_id"], tuple(r["repos"])) for r in ticker.watchlists(st).collect()} == {(0, ("r1",)), (1, ("r2",))}
    assert sorted(r["repo"] for r in ticker.poll_set(st).collect()) == ["r1", "r2"]


def test_fold_of_a_million_steps(spark):
    """One session of a million steps among small ones: places and texts in order, no
    task joining more than a fold's pieces."""
    n = 1_000_000
    many = spark.range(n).selectExpr("7L AS session_id", "id * 3 AS seq", "'USE_TOOL' AS action", "cast(id AS string) AS tool", "cast(null AS string) AS result")
    few = spark.createDataFrame([(1, 5, "FINAL_ANSWER", None, None), (1, 2, "ASK_USER", None, "x"), (None, 1, "OTHER", None, "y")], "session_id long, seq long, action string, tool string, result string")
    steps = history.trace_steps(many.unionByName(few))
    assert steps.where("session_id = 7 AND seq <> (n - 1) * 3").count() == 0
    got = {r["session_id"]: r for r in history.execution_trace(many.unionByName(few)).collect()}
    assert got[7]["total_steps"] == n
    lines = got[7]["trace"].removesuffix(f"\n\nTotal steps: {n}").split("\n    ↓\n")
    assert len(lines) == n and lines[0] == "  Step 1: USE_TOOL: 0({})" and lines[-1] == f"  Step {n}: USE_TOOL: {n - 1}({{}})"
    assert all(f" {i + 1}: USE_TOOL: {i}(" in lines[i] for i in range(0, n, 7919))
    assert got[1]["trace"] == '  Step 1: ASK_USER: "x"\n    ↓\n  Step 2: FINAL_ANSWER\n\nTotal steps: 2'
    assert got[None]["total_steps"] == 1
    small = history.compact_history(few.unionByName(many.limit(2500))).where("session_id = 7").collect()
    whole = next(r for r in small if r["action"] == "COMPACTED_SUMMARY")
    assert len(small) == 4 and whole["compacted_count"] == 2497 and whole["result"].startswith("Previously: Used 0. Used 1. ") and whole["result"].count(". ") == 2496


def test_live_fanout_follows_the_watch_state(spark, tmp_path):
    """A subscribe between two ticks shows from the second on, within a micro-batch and
    across a restart; an old command delivered again changes nothing."""
    import datetime as dt

    from cdcmart.streaming import watchlist as wl

    def at(minute):
        return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)

    batches = [
        ([(at(1), 1, 5, "r", "subscribe"), (at(4), 2, 6, "r", "subscribe")], [(at(2), 100, "r", 10, None), (at(5), 101, "r", 11, None)]),
        ([(at(6), 3, 5, "r", "unsubscribe"), (at(1), 1, 5, "r", "subscribe"), (at(6), 4, 7, "other", "subscribe")], [(at(7), 102, "r", 12, None), (at(8), 103, "r", 0, "gone")]),
    ]
    for n, (commands, ticks) in enumerate(batches):
        spark.createDataFrame(commands, "at timestamp, seq long, client_id long, repo string, op string").write.parquet(f"{tmp_path}/c/n={n}")
        spark.createDataFrame(ticks, "at timestamp, tick_id long, repo string, price long, error string").write.parquet(f"{tmp_path}/t/n={n}")
        read = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{k}").schema).parquet(f"{tmp_path}/{k}") for k in "ct"]
        q = (
            wl.live_fanout(*read, buckets=3).writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    got = {(r.tick_id, r.client_id): (r.kind, r.price, r.message) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(100, 5): ("tick", 10, None), (101, 5): ("tick", 11, None), (101, 6): ("tick", 11, None), (102, 6): ("tick", 12, None), (103, 6): ("error", None, "gone")}

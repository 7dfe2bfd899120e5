"""Session history operators (H5-H8, H14) over a step table
``(session_id, seq, action, tool, result)``.

Positions within a session are segmented scans and counts are partial aggregates, so
no session's rows are sorted in one task. Texts of a session (summary, trace) are an
ordered fold: neighbouring steps become chunks of :data:`FOLD` pieces, chunks become
larger chunks, until one is left; every task joins at most FOLD pieces of a session,
the whole text exists in the last step only. ``trace_steps`` is the row-level form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cdcmart.functions.columns import template

# Tools used by assistant steps (by turn) in the history built from chats.
TOOLS = ["query_department", "calculate", "search"]

# ---------------------------------------------------------------------------
# FIXED VALUES: compaction phrases and trace labels per action
# ({name} = filled in; "*" = any other action)
# ---------------------------------------------------------------------------
PHRASES = {
    "USE_TOOL": "Used {tool}",
    "ASK_USER": "Asked user, got: {result}",
    "USER_CORRECTION": "User corrected: {result}",
    "FINAL_ANSWER": "Gave answer",
    "COMPACTED_SUMMARY": "{summary}",
    "*": "{action}: {result}",
}
SUMMARY = "Previously: {parts}."
LABELS = {
    "USE_TOOL": "USE_TOOL: {tool}({})",
    "ASK_USER": 'ASK_USER: "{result}"',
    "USER_CORRECTION": 'USER_CORRECTION: "{result}"',
    "FINAL_ANSWER": "FINAL_ANSWER",
    "*": "{action}",
}
STEP_LINE = "  Step {n}: {label}"
ARROW = "\n    ↓\n"
TOTAL_LINE = "\n\nTotal steps: {n}"


def _by_action(table: dict, action: Column, tool: Column, result: Column) -> Column:
    fill = {
        "tool": F.coalesce(tool, F.lit("?")),
        "result": F.coalesce(result, F.lit("?")),
        "summary": F.coalesce(result, F.lit("")),
        "action": action,
    }
    expr = None
    for act, text in table.items():
        if act == "*":
            continue
        names = [k for k in fill if "{" + k + "}" in text]
        val = template(text, **{k: fill[k] for k in names})
        expr = F.when(action == act, val) if expr is None else expr.when(action == act, val)
    other = table["*"]
    return expr.otherwise(template(other, **{k: fill[k] for k in fill if "{" + k + "}" in other}))


def history_from_conversations(conversations: DataFrame) -> DataFrame:
    """Steps from chat turns: user -> ASK_USER, assistant -> USE_TOOL, system -> USER_CORRECTION."""
    role = F.col("role")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.col("turn") % 3 + 1).cast("int"))
    return conversations.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        F.when(role == "user", "ASK_USER").when(role == "assistant", "USE_TOOL").when(role == "system", "USER_CORRECTION")
        .otherwise(F.upper(role))
        .alias("action"),
        F.when(role == "assistant", tool).alias("tool"),
        F.col("text").alias("result"),
    )


def step_phrase(action: Column, tool: Column, result: Column) -> Column:
    """Summary phrase of one step (compaction wording)."""
    return _by_action(PHRASES, action, tool, result)


#: Pieces that one step of the ordered fold joins.
FOLD = 1_000


def positions(history: DataFrame) -> DataFrame:
    """The steps with their 1-based place in the session (``n``); steps of one ``seq``
    are told apart by a hash of their content."""
    from cdcmart.operators.scan import segmented_scan

    steps = history.select("session_id", "seq", "action", "tool", "result").withColumn("_tie", F.xxhash64("action", "tool", "result"))
    return segmented_scan(steps, ["session_id"], ["seq", "_tie"], {"n": ("count", None, True)}).drop("_tie")


def ordered_text(pieces: DataFrame, keys: list[str], place: str, text: str, sep: str, fold: int = FOLD) -> DataFrame:
    """Per key: ``text`` of all pieces in the order of ``place`` (1, 2, ... without
    gaps), joined by ``sep``. The number of steps is the logarithm of the longest
    key's length to the base ``fold``. Null pieces are left out."""
    longest = pieces.agg(F.coalesce(F.max(place), F.lit(1))).first()[0]
    level = pieces.where(F.col(text).isNotNull()).select(*keys, (F.col(place) - 1).alias("_at"), F.col(text).alias("_t"))
    while True:
        part = F.floor(F.col("_at") / fold).cast("long")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda x: x["_t"]), sep)
        level = level.groupBy(*keys, part.alias("_part")).agg(joined.alias("_t")).withColumnRenamed("_part", "_at")
        longest = -(-longest // fold)
        if longest <= 1:
            return level.select(*keys, F.col("_t").alias(text))


def compact_history(history: DataFrame, threshold: int = 5, keep: int = 3) -> DataFrame:
    """H5: sessions with more than ``threshold`` steps keep their last ``keep``
    steps; all earlier ones become one COMPACTED_SUMMARY row
    ``Previously: a. b. c.`` carrying ``compacted_count``.

    Output: (session_id, seq, action, tool, result, compacted_count); the
    summary row takes the seq of the first step it replaces.
    """
    counts = history.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("session_id", "_s")
    h = positions(history).join(counts, F.col("session_id").eqNullSafe(F.col("_s"))).drop("_s")
    old = (F.col("_n") > threshold) & (F.col("n") <= F.col("_n") - keep)
    recent = h.where(~old).select(
        "session_id", "seq", "action", "tool", "result", F.lit(None).cast("long").alias("compacted_count")
    )
    gone = h.where(old).select("session_id", "seq", "n", step_phrase(F.col("action"), F.col("tool"), F.col("result")).alias("result"))
    texts = ordered_text(gone, ["session_id"], "n", "result", ". ")
    heads = gone.groupBy(F.col("session_id").alias("_s")).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("compacted_count"))
    summary = texts.join(heads, F.col("session_id").eqNullSafe(F.col("_s"))).select(
        "session_id",
        "seq",
        F.lit("COMPACTED_SUMMARY").alias("action"),
        F.lit(None).cast("string").alias("tool"),
        template(SUMMARY, parts=F.col("result")).alias("result"),
        "compacted_count",
    )
    return recent.unionByName(summary)


def step_label(action: Column, tool: Column, result: Column) -> Column:
    return _by_action(LABELS, action, tool, result)


def trace_steps(history: DataFrame) -> DataFrame:
    """H6, row-level: (session_id, n, seq, line) with the line of every step."""
    label = step_label(F.col("action"), F.col("tool"), F.col("result"))
    return positions(history).select("session_id", "n", "seq", template(STEP_LINE, n=F.col("n").cast("string"), label=label).alias("line"))


def execution_trace(history: DataFrame) -> DataFrame:
    """H6: per session, ``Step n: LABEL`` lines joined by arrows, and the total."""
    lines = trace_steps(history)
    total = lines.groupBy(F.col("session_id").alias("_s")).agg(F.count(F.lit(1)).alias("total_steps"))
    text = ordered_text(lines, ["session_id"], "n", "line", ARROW)
    return text.join(total, F.col("session_id").eqNullSafe(F.col("_s"))).select(
        "session_id",
        "total_steps",
        F.concat("line", template(TOTAL_LINE, n=F.col("total_steps").cast("string"))).alias("trace"),
    )


def session_expiry(events: DataFrame, now: Column, ttl_hours: int = 24, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """H7: sliding expiry: a session lives ``ttl`` after its last write."""
    g = events.groupBy(key).agg(F.max(F.col(ts).cast("timestamp")).alias("last_write"))
    exp = F.col("last_write") + F.expr(f"INTERVAL {ttl_hours} HOURS")
    return g.select(
        F.col(key).alias("session_id"), "last_write", exp.alias("expires_at"), (exp <= now).alias("expired")
    )


def approval_expiry(approvals: DataFrame, now: Column, ttl_hours: int = 1, ts: str = "created_at") -> DataFrame:
    """H7 approvals: a fixed expiry ``ttl`` after creation (not sliding)."""
    exp = F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {ttl_hours} HOURS")
    return approvals.withColumn("expires_at", exp).withColumn("expired", exp <= now)


_WS = r"^\s+|\s+$"


def split_escalation(answers: DataFrame, text: str = "text") -> DataFrame:
    """H8: 'ESCALATE:' answers -> flag, reason (rest of the first line,
    stripped) and context (the remaining lines, stripped)."""
    t = F.col(text)
    esc = t.startswith("ESCALATE:")
    nl = F.instr(t, "\n")
    first = F.when(nl > 0, F.expr(f"substring({text}, 1, instr({text}, '\n') - 1)")).otherwise(t)
    rest = F.when(nl > 0, F.expr(f"substring({text}, instr({text}, '\n') + 1)")).otherwise(F.lit(""))
    reason = F.regexp_replace(F.replace(first, F.lit("ESCALATE:"), F.lit("")), _WS, "")
    return answers.withColumn("escalated", esc).withColumn("reason", F.when(esc, reason)).withColumn(
        "context", F.when(esc, F.regexp_replace(rest, _WS, ""))
    )


def _part() -> Column:
    return F.when(F.col("role") == "tool", F.concat(F.lit("[tool: "), F.col("text"), F.lit("]"))).otherwise(F.col("text"))


def _kind() -> Column:
    return F.when(F.col("role") == "assistant", "ModelResponse").otherwise("ModelRequest")


def history_parts(conversations: DataFrame) -> DataFrame:
    """H14, one row per turn: the session's turn count (an aggregate joined
    back), the message type and its part (whole texts; tool parts as
    ``[tool: name]``)."""
    n = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turn_count"))
    return conversations.join(n, "conv_id").select(
        F.col("conv_id").alias("session_id"), "turn", "turn_count", _kind().alias("type"), _part().alias("part")
    )


def history_summary(conversations: DataFrame) -> DataFrame:
    """H14 as one row per session: turn count and the ordered message list."""
    g = conversations.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.array_sort(F.collect_list(F.struct(F.col("turn"), _kind().alias("type"), _part().alias("part")))).alias("_m"),
    )
    return g.select(
        F.col("conv_id").alias("session_id"),
        "turn_count",
        F.transform("_m", lambda x: F.struct(x["type"].alias("type"), x["part"].alias("part"))).alias("messages"),
    )

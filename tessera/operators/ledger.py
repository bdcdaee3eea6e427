"""Analytics over tasks, attempts, rules and chunks: counts, rates, scores, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.filters import at, injectable, unsuperseded

# fixed values
PRIORITY = {"P1": 4.0, "P2": 3.0, "P3": 2.0, "P4": 1.0}
INJECT_LIMIT, INJECT_NEAR, INJECT_BYTES = 20, 18, 2000


def outcome_counts(attempts: DataFrame) -> DataFrame:
    """A row a task that has attempts; the only shuffle is on the task, after partial counts."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return attempts.groupBy("task_id").agg(F.count(F.lit(1)).alias("total_attempts"), n("pending").alias("pending_attempts"), n("rejected").alias("rejected_attempts"), n("accepted").alias("accepted_attempts"), n("unknown").alias("unknown_attempts"))


def task_summaries(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each task with its counts of attempts, 0 where it has none. Attempts are counted before the join."""
    counts = outcome_counts(attempts)
    names = counts.columns[1:]
    return tasks.join(counts, F.col("id") == F.col("task_id"), "left").drop("task_id").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def task_stats(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """As task_summaries, with the minutes from creation to completion (or abandonment); null while open."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return task_summaries(tasks, attempts).withColumn("resolution_minutes", (micros("completed_at") - micros("created_at")) / 6e7)


def portfolio(stats: DataFrame) -> DataFrame:
    """One row: tasks and attempts, the share of rejections (0 without decisions), the mean resolution (null if none)."""
    sums = {c: F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_attempts", "accepted_attempts", "rejected_attempts", "pending_attempts", "unknown_attempts")}
    one = stats.agg(F.count(F.lit(1)).alias("total_tasks"), *sums.values(), F.avg("resolution_minutes").alias("avg_resolution_minutes"))
    decided = F.col("accepted_attempts") + F.col("rejected_attempts")
    return one.withColumn("rejection_rate", F.when(decided > 0, F.col("rejected_attempts") / decided).otherwise(0.0))


def urgency(as_of: str) -> tuple[Column, Column]:
    """(score, explanation): priority, 0.3 a rejection, 0.1 a day of age in whole hours."""
    base = F.coalesce(*[F.when(F.col("priority") == p, F.lit(v)) for p, v in PRIORITY.items()], F.lit(1.0))
    rejected = F.col("rejected_attempts") * F.lit(0.3)
    days = F.timestamp_diff("HOUR", F.col("created_at"), at(as_of)) / 24.0
    parts = F.array(
        F.when(F.col("priority").isNotNull(), F.format_string("%s=%.1f", "priority", base)), F.when(F.col("rejected_attempts") > 0, F.format_string("rejections=%.1f", rejected)),
        F.when(days >= 1, F.format_string("stale=%.1f", days * 0.1)),
    )
    said = F.array_join(F.array_compact(parts), "+")
    return base + rejected + days * 0.1, F.when(said == "", "base").otherwise(said)


def next_steps(summaries: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    """Active and blocked tasks, the most urgent first, with what to do."""
    score, why = urgency(as_of)
    open_tasks = summaries.where(F.col("status").isin("active", "blocked")).withColumn("score", score).withColumn("score_explanation", why)
    action = (
        F.when(F.col("status") == "blocked", F.lit("Unblock this task or re-prioritise it"))
        .when(F.col("pending_attempts") > 0, F.format_string("Resolve %d pending attempt(s)", "pending_attempts"))
        .otherwise(F.lit("Propose an attempt"))
    )
    out = open_tasks.withColumn("action", action).orderBy(F.desc("score"), F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


# fixed values: what a step says
STEP_SAYS = {
    "pending": "[score=%.2f] %sTask '%s' has %d pending attempt(s) awaiting outcome resolution (%s)",
    "active": "[score=%.2f] %sTask '%s' is active (%d attempts, %d rejected) — propose next approach (%s)",
    "blocked": "[score=%.2f] %sTask '%s' is BLOCKED — needs unblocking (%s)",
}


def step_texts(steps: DataFrame) -> DataFrame:
    """next_steps with `text`: score, ticket, description, counts and explanation in a sentence."""
    ticket = F.coalesce(F.concat(F.lit("["), F.col("ticket_number"), F.lit("] ")), F.lit(""))
    start = ["score", ticket, F.coalesce("description", F.lit(""))]
    said = lambda kind, *more: F.format_string(STEP_SAYS[kind], *start, *more, "score_explanation")
    return steps.withColumn("text", F.when(F.col("status") == "blocked", said("blocked")).when(F.col("pending_attempts") > 0, said("pending", "pending_attempts")).otherwise(said("active", "total_attempts", "rejected_attempts")))


def brief(tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a project: active and blocked tasks, lessons in force."""
    t = tasks.groupBy("project_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    r = rules.where(unsuperseded()).groupBy("project_id").agg(F.count_if(F.col("category") == "lesson").alias("lessons"))
    return t.join(r, "project_id", "full").select("project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("active", "blocked", "lessons")])


def nudges(summaries: DataFrame) -> DataFrame:
    """(project_id, nudge): pending attempts come first, then blocked, then active tasks."""
    any_of = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    open_tasks = F.col("status").isin("active", "blocked")
    said = F.when(any_of(open_tasks & (F.col("pending_attempts") > 0)), "pending").when(any_of(F.col("status") == "blocked"), "blocked").when(any_of(F.col("status") == "active"), "active").otherwise("none")
    return summaries.groupBy("project_id").agg(said.alias("nudge"))


def all_children_done(tasks: DataFrame) -> DataFrame:
    done = F.col("status").isin("completed", "abandoned")
    return tasks.where("parent_task_id is not null").groupBy("parent_task_id").agg((F.count(F.lit(1)) == F.count_if(done)).alias("all_done"))


def project_kpis(projects: DataFrame, tasks: DataFrame, attempts: DataFrame, rules: DataFrame) -> DataFrame:
    """A row a project: totals, whole-percent rates (0 without a denominator), knowledge size, attempts a finished task.

    Everything is grouped before it is joined to the few projects.
    """
    size = F.sum(F.octet_length("approach_summary") + F.octet_length("reasoning"))
    per = attempts.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "rejected").alias("rej"), F.count_if(F.col("outcome") == "accepted").alias("acc"), size.alias("bytes"))
    t = tasks.join(per, F.col("id") == F.col("task_id"), "left")
    first = (F.col("status") == "completed") & (F.coalesce("rej", F.lit(0)) == 0) & (F.coalesce("acc", F.lit(0)) > 0)
    t = t.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "active").alias("active"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("rej"), F.lit(0)).alias("rejected"), F.count_if(first).alias("first_try"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("attempt_bytes"),
    )
    r = rules.where(unsuperseded()).groupBy("project_id").agg(F.count(F.lit(1)).alias("rules"), F.sum(F.octet_length("content")).alias("rule_bytes"))
    f = follow_ups(tasks).groupBy("project_id").agg(F.count_distinct("parent_id").alias("followed_up"))
    out = projects.select(F.col("id").alias("project_id"), "name").join(t, "project_id", "left").join(r, "project_id", "left").join(f, "project_id", "left")
    out = out.na.fill(0)
    rate = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 100 div {b}")).otherwise(0).cast("long")
    return out.select(
        "project_id", "name", "tasks", "completed", "active", "attempts", "rejected", "rules", "first_try", (F.col("rule_bytes") + F.col("attempt_bytes")).alias("knowledge_bytes"),
        rate("rejected", "attempts").alias("rejection_pct"), rate("first_try", "completed").alias("first_try_pct"), rate("followed_up", "completed").alias("followup_pct"),
        F.expr("(rule_bytes + attempt_bytes) div 3").alias("knowledge_tokens"), F.when(F.col("completed") > 0, F.format_string("%.1f", F.col("attempts") / F.col("completed"))).otherwise("—").alias("avg_attempts"),
    )


def follow_ups(tasks: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(parent_id, child_id, project_id): children made after their completed parent was finished, but those that links
    (source_task_id, target_task_id) already has."""
    p = tasks.where("status = 'completed' and completed_at is not null").select(F.col("id").alias("parent_id"), "project_id", F.col("completed_at").alias("finished"))
    c = tasks.where("parent_task_id is not null").select(F.col("id").alias("child_id"), F.col("parent_task_id").alias("parent_id"), F.col("created_at").alias("made"))
    found = p.join(c, "parent_id").where("made > finished").select("parent_id", "child_id", "project_id")
    if links is None:
        return found
    return found.join(links.select(F.col("source_task_id").alias("parent_id"), F.col("target_task_id").alias("child_id")), ["parent_id", "child_id"], "left_anti")


def rejection_events(attempts: DataFrame, threshold: int) -> DataFrame:
    """The moment at which a task's rejections come to `threshold`: once a task, not for later ones."""
    w = Window.partitionBy("task_id").orderBy("resolved_at", "created_at", "approach_summary", "reasoning")
    return attempts.where("outcome = 'rejected'").withColumn("n", F.row_number().over(w)).where(F.col("n") == threshold).select("task_id", "resolved_at", F.col("n").cast("long").alias("rejected"))


def injected(rules: DataFrame, as_of: str, limit: int = INJECT_LIMIT, budget: int = INJECT_BYTES) -> DataFrame:
    """(project_id, id, bytes, total): standing rules, oldest first, while the bytes suffice; the first always.

    `total` runs over what is kept. A project has `limit` candidates at most, found before the running sum.
    """
    w = Window.partitionBy("project_id").orderBy("created_at", "id")
    rows = rules.where(injectable(as_of)).select("project_id", "id", "created_at", F.octet_length("content").cast("long").alias("bytes")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    rows = rows.withColumn("total", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("rn") == 1) | ((F.col("total") <= budget) & (F.col("total") - F.col("bytes") < budget))).select("project_id", "id", "bytes", "total")


def injected_block(rules: DataFrame, as_of: str, limit: int = INJECT_LIMIT, budget: int = INJECT_BYTES) -> DataFrame:
    """A row a project: ids in order, total_bytes, truncated."""
    all_rows = rules.where(injectable(as_of)).groupBy("project_id").agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("candidates"))
    kept = injected(rules, as_of, limit, budget).groupBy("project_id").agg(F.count(F.lit(1)).alias("kept"), F.max("total").alias("total_bytes"))
    return all_rows.join(kept, "project_id").select("project_id", "kept", "total_bytes", ((F.col("kept") < F.col("candidates")) | (F.col("total_bytes") > budget)).alias("truncated"))


def cap_levels(rules: DataFrame, as_of: str, near: int = INJECT_NEAR, limit: int = INJECT_LIMIT) -> DataFrame:
    """(project_id, count, level): null below `near`."""
    n = rules.where(injectable(as_of)).groupBy("project_id").agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("level", F.when(F.col("count") > limit, "over_cap").when(F.col("count") == limit, "at_cap").when(F.col("count") >= near, "near_cap"))


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"), F.count("summary").alias("summarised"), F.max("indexed_at").alias("last_indexed"))


def summary_queue(chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks without a summary by file and line, with how many stay behind."""
    todo = chunks.where("summary is null")
    left = todo.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("remaining_after"))  # one row
    return todo.orderBy("file_path", "start_line", "id").limit(limit).crossJoin(F.broadcast(left))


def rules_by_category(rules: DataFrame) -> DataFrame:
    """(project_id, category, n, ids by age)."""
    return rules.where(unsuperseded()).groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("x")).select("project_id", "category", "n", F.transform("x", lambda r: r["id"]).alias("ids"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`; null keys count as equal."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def last_n(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """The last n rows of each key, to be read in rising order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where(F.col("__n") <= n).drop("__n")


def summaries_of(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("summary", tx.summary("description"))

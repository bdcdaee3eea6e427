"""Retention: seven steps over the tables, in a fixed order, as of a given moment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import at, live, older_than
from tessera.operators.state import delete

STALE_REASON = "Auto-escalated: no outcome was logged"


@dataclass(frozen=True)
class Policy:
    # fixed values: the default limits
    pending_hours: int = 72
    unknown_days: int = 7
    attempt_days: int = 30
    snapshot_days: int = 7
    task_days: int = 90
    lesson_days: int = 14
    lesson_accepted: int = 2
    lesson_chars: int = 4096


def escalate(attempts: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """Pending attempts older than that become unknown, resolved now."""
    stale = (F.col("outcome") == "pending") & older_than("created_at", as_of, hours=hours)
    return attempts.withColumns({"outcome": F.when(stale, "unknown").otherwise(F.col("outcome")), "resolved_at": F.when(stale, at(as_of)).otherwise(F.col("resolved_at"))})


def prune_unknown(attempts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    gone = (F.col("outcome") == "unknown") & older_than("resolved_at", as_of, days)
    return attempts.where(~F.coalesce(gone, F.lit(False)))


def prune_attempts(attempts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    gone = (F.col("outcome") != "unknown") & older_than("created_at", as_of, days)
    return attempts.where(~F.coalesce(gone, F.lit(False)))


def prune_snapshots(snapshots: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return snapshots.where(~F.coalesce(older_than("wiped_at", as_of, days), F.lit(False)))


def purgeable(tasks: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    return tasks.where((F.col("status") == "completed") & older_than("completed_at", as_of, days)).select("id")


def sweep_scratch(scratch: DataFrame, as_of: str) -> DataFrame:
    """What readers would still see; they and the sweep are complements."""
    return scratch.where(live(as_of))


def consolidate(tasks: DataFrame, attempts: DataFrame, as_of: str, days: int = 14, accepted: int = 2, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(lessons, attempts left): completed tasks with enough old accepted attempts become one lesson each.

    The lesson lists rejected and accepted approaches by age, as many as it holds; those attempts are then gone.
    """
    old = attempts.where(F.col("outcome").isin("accepted", "rejected") & older_than("resolved_at", as_of, days))
    line = F.concat(F.lit("- "), "approach_summary", F.when(F.coalesce("reasoning", F.lit("")) != "", F.concat(F.lit(": "), "reasoning")).otherwise(""), F.lit("\n"))
    old = old.withColumn("line", line)
    # lines beyond what a lesson holds aren't gathered
    before = Window.partitionBy("task_id", "outcome").orderBy("created_at", "line").rowsBetween(Window.unboundedPreceding, -1)
    old = old.withColumn("line", F.when(F.coalesce(F.sum(F.char_length("line")).over(before), F.lit(0)) < most, F.col("line")))
    pick = lambda o: F.array_sort(F.collect_list(F.when((F.col("outcome") == o) & F.col("line").isNotNull(), F.struct("created_at", F.col("line")))))
    by_task = old.groupBy("task_id").agg(F.count_if(F.col("outcome") == "accepted").alias("n"), pick("rejected").alias("rej"), pick("accepted").alias("acc")).where(F.col("n") >= accepted)
    rows = by_task.join(tasks.where("status = 'completed'").select(F.col("id").alias("task_id"), "project_id", "description"), "task_id")
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(F.transform(c, lambda r: r["line"]), ""))).otherwise("")
    content = F.concat(F.lit("## Task: "), "description", F.lit("\n"), part("### Rejected approaches:\n", F.col("rej")), part("### Accepted approach:\n", F.col("acc")))
    lessons = rows.select(F.col("task_id").alias("source_task_id"), "project_id", F.lit("lesson").alias("category"), F.substring(content, 1, most).alias("content"))
    gone = F.col("outcome").isin("accepted", "rejected") & older_than("resolved_at", as_of, days)
    done = lessons.select(F.col("source_task_id").alias("task_id"), F.lit(1).alias("__hit"))
    left = attempts.join(done, "task_id", "left").where(~F.coalesce(gone & (F.col("__hit") == 1), F.lit(False))).select(attempts.columns)
    return lessons, left


def sweep(tables: dict[str, DataFrame], as_of: str, policy: Policy = Policy()) -> dict[str, DataFrame]:
    """All steps on attempts, context_snapshots, tasks, scratchpad and semantic_rules; the 30 days come before the 14."""
    t = dict(tables)
    a = prune_attempts(prune_unknown(escalate(t["attempts"], as_of, policy.pending_hours), as_of, policy.unknown_days), as_of, policy.attempt_days)
    t |= {"attempts": a, "context_snapshots": prune_snapshots(t["context_snapshots"], as_of, policy.snapshot_days)}
    t = delete(t, "tasks", purgeable(t["tasks"], as_of, policy.task_days))
    t["scratchpad"] = sweep_scratch(t["scratchpad"], as_of)
    lessons, t["attempts"] = consolidate(t["tasks"], t["attempts"], as_of, policy.lesson_days, policy.lesson_accepted, policy.lesson_chars)
    t["semantic_rules"] = t["semantic_rules"].unionByName(lessons, allowMissingColumns=True)
    return t

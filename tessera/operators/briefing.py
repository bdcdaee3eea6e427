"""Compositions of several operators: exports, handoffs, session summaries, active context, the context of a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import graph, ledger, retrieval
from tessera.operators.filters import unsuperseded


def attempt_line(outcome: str = "outcome") -> Column:
    why = F.when(F.coalesce("reasoning", F.lit("")) != "", F.concat("approach_summary", F.lit(": "), "reasoning")).otherwise(F.col("approach_summary"))
    return F.concat(F.lit("  - ["), F.col(outcome), F.lit("] "), why)


_ORDER = ["created_at", "approach_summary", "reasoning", "outcome"]


def recent_attempts(attempts: DataFrame, n: int = 5) -> DataFrame:
    """(task_id, lines): the last n attempts of each task, oldest first."""
    rows = ledger.last_n(attempts, ["task_id"], n, _ORDER).withColumn("line", attempt_line())
    return rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "line"))).alias("x")).select("task_id", F.transform("x", lambda r: r["line"]).alias("lines"))


def _joined(rows: DataFrame, by: list[str], text: Column, sep: str = "\n") -> DataFrame:
    """(project_id, text): texts of a project in order."""
    return rows.withColumn("__t", text).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(*by, "__t"))).alias("x")).select("project_id", F.array_join(F.transform("x", lambda r: r["__t"]), sep).alias("text"))


def handoff(projects: DataFrame, tasks: DataFrame, attempts: DataFrame, rules: DataFrame) -> DataFrame:
    """(project_id, markdown): active tasks with recent attempts, blocked tasks, the last five lessons."""
    a = tasks.where("status = 'active'").join(recent_attempts(attempts), F.col("id") == F.col("task_id"), "left")
    said = F.when(F.size("lines") > 0, F.concat(F.lit("\n- **Recent attempts:**\n"), F.array_join("lines", "\n"))).otherwise("")
    active = _joined(a, ["created_at", "id"], F.concat(F.lit("### "), "description", F.lit("\n- **ID:** `"), "id", F.lit("`"), said), "\n\n")
    blocked = _joined(tasks.where("status = 'blocked'"), ["created_at", "id"], F.concat(F.lit("- `"), "id", F.lit("`: "), "description"))
    lessons = ledger.last_n(rules.where(unsuperseded() & (F.col("category") == "lesson")), ["project_id"], 5, ["created_at", "id"])
    lessons = _joined(lessons, ["created_at", "id"], F.concat(F.lit("- "), tx.preview("content", 200)))
    out = projects.select(F.col("id").alias("project_id"), "name")
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {title}\n\n"), F.col(c), F.lit("\n"))).otherwise("")
    for c, d in (("a", active), ("b", blocked), ("l", lessons)):
        out = out.join(d.withColumnRenamed("text", c), "project_id", "left")
    return out.select("project_id", F.concat(F.lit("# Handoff: "), "name", F.lit("\n\n"), part("Active Tasks", "a"), part("Blocked Tasks", "b"), part("Recent Lessons", "l")).alias("markdown"))


def session_summary(tasks: DataFrame, attempts: DataFrame, max_tasks: int = 10, max_attempts: int = 5) -> DataFrame:
    """Active, then blocked tasks of each project, oldest first, with their last attempts' lines."""
    from pyspark.sql import Window

    w = Window.partitionBy("project_id").orderBy(F.when(F.col("status") == "active", 0).otherwise(1), "created_at", "id")
    rows = tasks.where("status in ('active', 'blocked')").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(25, max(1, max_tasks)))
    rows = rows.join(recent_attempts(attempts, min(10, max(1, max_attempts))), F.col("id") == F.col("task_id"), "left")
    return rows.select("project_id", "rank", "id", "description", "status", "priority", "ticket_number", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def export_markdown(projects: DataFrame, rules: DataFrame, tasks: DataFrame) -> DataFrame:
    """(project_id, markdown): rules in force by category, then tasks."""
    r = _joined(rules.where(unsuperseded()), ["category", "created_at", "id"], F.concat(F.lit("- **"), "category", F.lit("** "), tx.preview("content", 100)))
    t = _joined(tasks, ["created_at", "id"], F.concat(F.lit("- ["), "status", F.lit("] "), "description"))
    out = projects.select(F.col("id").alias("project_id"), "name").join(r.withColumnRenamed("text", "r"), "project_id", "left").join(t.withColumnRenamed("text", "t"), "project_id", "left")
    return out.select("project_id", F.concat(F.lit("# Memory: "), "name", F.lit("\n\n## Rules\n\n"), F.coalesce("r", F.lit("")), F.lit("\n\n## Tasks\n\n"), F.coalesce("t", F.lit("")), F.lit("\n")).alias("markdown"))


def export_json(rules: DataFrame, tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """(kind, id, json): a row for each rule, task and attempt, so that an export needs no single row for a project."""
    one = lambda d, kind, i: d.select(F.lit(kind).alias("kind"), i.cast("string").alias("id"), F.to_json(F.struct(*[c for c in d.columns if c != "embedding"])).alias("json"))
    return one(rules, "rule", F.col("id")).unionByName(one(tasks, "task", F.col("id"))).unionByName(one(attempts, "attempt", F.col("task_id")))


def export_project_json(projects: DataFrame, rules: DataFrame, tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """(project_id, kind, id, json): a row for each rule in force, task and attempt; attempts have their task's project."""
    one = lambda d, kind: d.select("project_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*[F.col(c) for c in d.columns if c not in ("embedding", "reasoning_embedding")])).alias("json"))
    own = attempts.drop("project_id").join(tasks.select(F.col("id").alias("task_id"), "project_id"), "task_id")
    rows = one(rules.where(unsuperseded()), "rule").unionByName(one(tasks, "task")).unionByName(one(own, "attempt"))
    return rows.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")


def export_project_documents(projects: DataFrame, rules: DataFrame, tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """(project_id, json): one document a project, {"project_id", "rules", "tasks", "attempts"}, each list in the order of
    ids. For projects that fit a row; export_project_json has no such bound."""
    rows = export_project_json(projects, rules, tasks, attempts)
    lists = rows.groupBy("project_id").pivot("kind", ["rule", "task", "attempt"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "json"))), lambda r: r["json"]), ","))
    out = projects.select(F.col("id").alias("project_id")).join(lists, "project_id", "left")
    part = lambda c: F.concat(F.lit("["), F.coalesce(F.col(c), F.lit("")), F.lit("]"))
    return out.select("project_id", F.concat(F.lit('{"project_id":"'), F.col("project_id").cast("string"), F.lit('","rules":'), part("rule"), F.lit(',"tasks":'), part("task"), F.lit(',"attempts":'), part("attempt"), F.lit("}")).alias("json"))


def export_report(projects: DataFrame, rules: DataFrame, tasks: DataFrame, attempts: DataFrame, title: str = "Memory Export") -> DataFrame:
    """(project_id, section, seq, markdown): the whole report in parts, which in the order of section and seq make the text.

    Rules in force with category, the first 80 chars, id and full content; tasks with status, description, id, dates and
    attempts with their reasoning as quotes; totals in the headings. A part is one rule or one task, so a report of any
    size needs no row of its own size.
    """
    from pyspark.sql import Window

    own = lambda d: d.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    rules, tasks = own(rules.where(unsuperseded())), own(tasks)
    size = lambda d, c: d.groupBy("project_id").agg(F.count(F.lit(1)).alias(c))
    heads = projects.select(F.col("id").alias("project_id"), "name").join(size(rules, "r"), "project_id", "left").join(size(tasks, "t"), "project_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    row = lambda section, seq, text: [F.lit(section).alias("section"), seq.cast("long").alias("seq"), text.alias("markdown")]
    zero = F.lit(0)
    out = heads.select("project_id", *row(0, zero, F.concat(F.lit(f"# {title} — "), F.coalesce("name", F.lit("Unknown")), F.lit("\n\n"))))
    out = out.unionByName(heads.select("project_id", *row(1, zero, F.concat(F.lit("## Rules ("), n(F.col("r")), F.lit(" total)\n\n")))))
    out = out.unionByName(heads.select("project_id", *row(3, zero, F.concat(F.lit("## Tasks ("), n(F.col("t")), F.lit(" total)\n\n")))))
    at = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "id"))
    rule = F.concat(F.lit("### ["), F.initcap("category"), F.lit("] "), F.substring("content", 1, 80), F.lit("\n- **ID:** `"), F.col("id").cast("string"), F.lit("`\n- **Content:** "), F.col("content"), F.lit("\n\n"))
    out = out.unionByName(rules.select("project_id", *row(2, at, rule)))
    quoted = F.when(F.coalesce("reasoning", F.lit("")) == "", "").otherwise(F.concat(F.regexp_replace(F.regexp_replace("reasoning", r"\r?\n$", ""), r"(?m)^", "  > "), F.lit("\n")))
    said = attempts.withColumn("line", F.concat(F.lit("- **"), F.initcap("outcome"), F.lit("** — "), F.col("approach_summary"), F.lit("\n"), quoted))
    said = said.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "line"))), lambda x: x["line"]), "").alias("lines"))
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm 'UTC'")
    task = F.concat(
        F.lit("### "), F.initcap("status"), F.lit(": "), F.col("description"), F.lit("\n- **ID:** `"), F.col("id").cast("string"), F.lit("`\n- **Created:** "), when("created_at"), F.lit("\n"),
        F.coalesce(F.concat(F.lit("- **Completed:** "), when("completed_at"), F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("\n**Attempts:**\n\n"), F.col("lines")), F.lit("")), F.lit("\n"),
    )
    return out.unionByName(tasks.join(said, F.col("id") == F.col("task_id"), "left").select("project_id", *row(4, at, task)))


def review_ledger(attempts: DataFrame, links: DataFrame, task_id: object, outcome: str | None = None) -> dict[str, DataFrame]:
    """A task's attempts (of one outcome, if named), oldest first, and the links that touch the task."""
    own = attempts.where(F.col("task_id") == task_id)
    own = own if outcome is None else own.where(F.lower("outcome") == outcome.lower())
    return {"attempts": own.orderBy("created_at", *[c for c in ("id",) if c in own.columns]), "task_links": graph.links_of(links, task_id)}


def current_tasks(tasks: DataFrame) -> DataFrame:
    """The oldest active task of each project."""
    return ledger.latest(tasks.where("status = 'active'"), ["project_id"], [F.asc("created_at"), F.asc("id")])


def active_context(tasks: DataFrame, attempts: DataFrame, rules: DataFrame, failures: DataFrame, vector: Sequence[float], project: int, as_of: str) -> dict[str, DataFrame]:
    """What a session on a project needs: the current task, its attempts, five rules, three failures, the standing rules."""
    from tessera.operators.filters import rules_where, searchable

    task = current_tasks(tasks.where(F.col("project_id") == project))
    return {
        "task": task, "attempts": attempts.join(F.broadcast(task.select(F.col("id").alias("task_id"))), "task_id", "left_semi"),  # one task
        "rules": retrieval.vector_top_k(rules_where(rules, project, when=searchable(as_of)), vector, 5),
        "failures": retrieval.vector_top_k(failures.where(F.col("project_id") == project), vector, 3),
        "standing": ledger.injected(rules.where(F.col("project_id") == project), as_of),
    }


def file_context(chunks: DataFrame, edges: DataFrame, links: DataFrame, rules: DataFrame, path: str) -> dict[str, DataFrame]:
    """A file's structure by line, rules by best link, edges of its first five named chunks, and its communities with
    their sizes in the whole project."""
    own = chunks.where(F.col("file_path") == path)
    near = [c for c in ("project_id", "community_id") if c in chunks.columns]
    named = own.where("chunk_name is not null").orderBy("start_line", "id").limit(5).select(F.col("chunk_name").alias("n")).distinct()
    best = ledger.latest(links.join(own.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"), ["rule_id"], [F.desc("similarity"), F.asc("chunk_id")])
    return {
        "structure": own.select("id", "chunk_name", "chunk_kind", F.concat_ws("-", "start_line", "end_line").alias("lines"), "community_id", "start_line").orderBy("start_line", "id").drop("start_line"),
        "rules": best.join(rules.select(F.col("id").alias("rule_id"), "category", "content"), "rule_id"),
        "callers": edges.join(named, F.col("target_entity") == F.col("n"), "left_semi").dropDuplicates(["source_entity", "source_file"]),
        "callees": edges.join(named, F.col("source_entity") == F.col("n"), "left_semi").dropDuplicates(["target_entity", "target_file"]),
        "communities": graph.community_sizes(chunks.join(own.where("community_id is not null").select(near).distinct(), near, "left_semi")),
    }

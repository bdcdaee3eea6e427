"""State transitions: each takes tables and returns new ones; nothing is changed in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.filters import at
from tessera.plans.lineage import kept
from tessera.plans.schemas import REFERENCES

#: Said of attempts that the engine settles itself, where nothing was said before.
AUTO_ACCEPTED, AUTO_REJECTED = "Auto-accepted on task completion", "Auto-rejected: superseded on task completion"


def same(keys: list[str], a: str = "a", b: str = "b") -> Column:
    """Equal keys, nulls included."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def newest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last write of each key; nulls in its values are kept, which max_by wouldn't tell apart in every engine."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_scratch(state: DataFrame | None, writes: DataFrame) -> DataFrame:
    """Entries by (project, task or none, key): the newest value and expiry; the oldest id and time of creation.

    A write without expiry clears it.
    """
    keys = ["project_id", "task_id", "key"]
    rows = writes.withColumn("created_at", F.col("updated_at"))
    if state is not None:
        rows = state.select(rows.columns).unionByName(rows)
    w = Window.partitionBy(*keys)
    down, up = [F.desc("updated_at"), F.desc("id")], [F.asc("created_at"), F.asc("id")]
    rows = rows.withColumns({"__n": F.row_number().over(w.orderBy(*down)), "__id": F.first("id").over(w.orderBy(*up)), "__made": F.min("created_at").over(w)})
    return rows.where("__n = 1").withColumns({"id": F.col("__id"), "created_at": F.col("__made")}).drop("__n", "__id", "__made")


def upsert_chunks(state: DataFrame, new: DataFrame) -> DataFrame:
    """By (project, path, start line): new content; the old vector where the new is null; summary and community stay."""
    keys = ["project_id", "file_path", "start_line"]
    kept = {"embedding": lambda: F.coalesce("b.embedding", "a.embedding"), "summary": lambda: F.coalesce("a.summary", "b.summary"), "community_id": lambda: F.coalesce("a.community_id", "b.community_id"), "id": lambda: F.coalesce("a.id", "b.id")}
    hit = F.col("b.__new").isNotNull()
    cols = [kept[c]().alias(c) if c in kept else F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in state.columns]
    return state.alias("a").join(new.withColumn("__new", F.lit(1)).alias("b"), same(keys), "full").select(*cols)


def last_of(changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key, so that changes that repeat a key don't multiply rows: the last write.

    Later is what is larger in `order`, or in the first of the usual columns of time that is there; between equals, and
    where there is none, all columns decide, so a run gives what another gives.
    """
    order = order or [c for c in ("updated_at", "created_at", "at", "seq") if c in changes.columns][:1]
    rest = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(changes.columns)])).desc()]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order], *rest)
    return changes.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_links(state: DataFrame, new: DataFrame, keys: list[str], value: str, order: list[str] | None = None) -> DataFrame:
    """The new value for a key that is there, a new row for one that isn't; of several writes of a key the last."""
    new = last_of(new, keys, order)
    cols = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in (*keys, value) else F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in state.columns]
    return state.alias("a").join(new.alias("b"), same(keys), "full").select(*cols)


def insert_ignore(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    fresh = new.dropDuplicates(keys).alias("a").join(state.select(keys).alias("b"), same(keys), "left_anti")
    return state.unionByName(fresh.select(state.columns))


def insert_strict(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As a union that fails when it runs if a key is there twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = state.unionByName(new.select(state.columns)).withColumn("__n", n)
    return rows.withColumn("__ok", F.assert_true(F.col("__n") == 1, F.lit("duplicate key"))).where("__ok is null").drop("__n", "__ok")


def get_or_create_projects(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (id, name, root_path) rows whose name and path are both new are added; known ones stay as they are.

    Two anti joins by equality, so neither side is sent whole to every task. Of wanted rows that share a name or a path
    the one with the least id is added.
    """
    fresh = wanted
    for c in ("name", "root_path"):
        fresh = fresh.join(projects.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti")
    for c in ("name", "root_path"):
        w = Window.partitionBy(c).orderBy("id")
        fresh = fresh.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | F.col(c).isNull()).drop("__n")
    return projects.unionByName(fresh.select([c for c in projects.columns if c in wanted.columns]), allowMissingColumns=True)


def patch(state: DataFrame, changes: DataFrame, key: str, cols: list[str], scope: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Columns changed where the change isn't null, for rows of the same `scope` (the project) if one is named.

    Of several changes of a key the last counts.
    """
    on = F.col(f"a.{key}") == F.col(f"b.{key}")
    if scope:
        on = on & (F.col(f"a.{scope}") == F.col(f"b.{scope}"))
    changes = last_of(changes, [key, scope] if scope else [key], order)
    return state.alias("a").join(changes.alias("b"), on, "left").select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in cols else F.col(f"a.{c}") for c in state.columns])


def patch_tasks(tasks: DataFrame, changes: DataFrame, cols: list[str]) -> DataFrame:
    """Three-state changes: null keeps, an empty string clears, a value is set; a new description makes a new summary.

    Of several changes of a task the last counts.
    """
    changes = last_of(changes, ["id"])

    def new(c: str) -> Column:
        return F.when(F.col(f"b.{c}").isNull(), F.col(f"a.{c}")).when(F.col(f"b.{c}") == "", F.lit(None)).otherwise(F.col(f"b.{c}"))

    out = []
    for c in tasks.columns:
        if c == "summary" and "description" in cols:
            own = new(c) if c in cols else F.col("a.summary")
            out.append(F.when(F.coalesce("b.description", F.lit("")) != "", tx.summary("b.description")).otherwise(own).alias(c))
        else:
            out.append(new(c).alias(c) if c in cols else F.col(f"a.{c}"))
    return tasks.alias("a").join(changes.alias("b"), F.col("a.id") == F.col("b.id"), "left").select(*out)


def log_outcomes(attempts: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Outcome, reasoning and git_ref as given (null too), snippet and resolver where given; resolved now, whatever the outcome.

    Of several outcomes of an attempt the last counts.
    """
    outcomes = last_of(outcomes, ["id"])
    hit = F.col("b.id").isNotNull()
    taken, kept = {"outcome", "reasoning", "git_ref"}, {"code_snippet", "resolved_by_agent_id", "resolved_by_session_id"}
    cols = []
    for c in attempts.columns:
        if c == "resolved_at":
            cols.append(F.when(hit, at(as_of)).otherwise(F.col("a.resolved_at")).alias(c))
        elif c in taken and c in outcomes.columns:
            cols.append(F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        elif c in kept and c in outcomes.columns:
            cols.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        else:
            cols.append(F.col(f"a.{c}"))
    return attempts.alias("a").join(outcomes.alias("b"), F.col("a.id") == F.col("b.id"), "left").select(*cols)


def supersede(rules: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """valid_until = now for the ids, unless it was set before."""
    hit = rules.join(ids.select("id").distinct().withColumn("__hit", F.lit(1)), "id", "left")
    return hit.withColumn("valid_until", F.coalesce("valid_until", F.when(F.col("__hit") == 1, at(as_of)))).drop("__hit").select(rules.columns)


def apply_hits(rules: DataFrame, updates: DataFrame) -> DataFrame:
    j = rules.alias("a").join(updates.select("id", "n", F.col("last_used_at").alias("now")).alias("b"), "id", "left")
    new = {"hit_count": F.col("a.hit_count") + F.coalesce("n", F.lit(0)), "last_used_at": F.coalesce("now", "a.last_used_at")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in rules.columns])


def auto_resolve(attempts: DataFrame, as_of: str, order: list[str]) -> DataFrame:
    """Of a task's pending attempts the latest in `order` is accepted and the others are rejected; reasons only where none were."""
    w = Window.partitionBy("task_id", F.col("outcome") == "pending").orderBy(*[F.desc(c) for c in order])
    rows = attempts.withColumn("__n", F.when(F.col("outcome") == "pending", F.row_number().over(w)))
    new = F.when(F.col("__n") == 1, "accepted").when(F.col("__n") > 1, "rejected")
    why = F.when(F.col("__n") == 1, AUTO_ACCEPTED).when(F.col("__n") > 1, AUTO_REJECTED)
    blank = F.coalesce("reasoning", F.lit("")) == ""
    return rows.withColumns({
        "outcome": F.coalesce(new, "outcome"), "reasoning": F.when(F.col("__n").isNotNull() & blank, why).otherwise(F.col("reasoning")),
        "resolved_at": F.when(F.col("__n").isNotNull(), at(as_of)).otherwise(F.col("resolved_at")),
    }).drop("__n")


def set_status(tasks: DataFrame, ids: DataFrame, status: str, as_of: str, batch: bool = False) -> DataFrame:
    """One task: completed_at for completed only. A batch: for abandoned too. Any other status clears it."""
    ends = status in (("completed", "abandoned") if batch else ("completed",))
    hit = tasks.join(ids.select("id").distinct().withColumn("__hit", F.lit(1)), "id", "left")
    on = F.col("__hit") == 1
    new = at(as_of) if ends else F.lit(None).cast("timestamp_ntz")
    return hit.withColumns({"status": F.when(on, status).otherwise(F.col("status")), "completed_at": F.when(on, new).otherwise(F.col("completed_at"))}).drop("__hit").select(tasks.columns)


def complete(tasks: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Completed now, unless they are completed already."""
    hit = tasks.join(ids.select("id").distinct().withColumn("__hit", F.lit(1)), "id", "left")
    on = (F.col("__hit") == 1) & (F.col("status") != "completed")
    return hit.withColumns({"completed_at": F.when(on, at(as_of)).otherwise(F.col("completed_at")), "status": F.when(on, "completed").otherwise(F.col("status"))}).drop("__hit").select(tasks.columns)


def abandon(tasks: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    return set_status(tasks, ids, "abandoned", as_of, batch=True)


def roll_up(tasks: DataFrame, ids: DataFrame, as_of: str, levels: int = 10) -> DataFrame:
    """Parents of `ids` whose children are all done are completed, then theirs, `levels` up at most.

    The work of a level is a join on the parent; the climb stops when no task is left to look at. Who climbs is kept
    after each level, so the plan grows by a join a level only.
    """
    climbing = ids.select("id").distinct()
    for _ in range(levels):
        parents = tasks.join(climbing, "id", "left_semi").where("parent_task_id is not null").select(F.col("parent_task_id").alias("id")).distinct()
        children = tasks.join(parents.withColumnRenamed("id", "parent_task_id"), "parent_task_id", "left_semi")
        done = children.groupBy("parent_task_id").agg(F.bool_and(F.col("status").isin("completed", "abandoned")).alias("ok")).where("ok").select(F.col("parent_task_id").alias("id"))
        climbing = kept(tasks.join(done, "id", "left_semi").select("id"))
        if climbing.isEmpty():
            break
        tasks = complete(tasks, climbing, as_of)
    return tasks


def follow_up_tasks(completed: DataFrame, entries: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(child tasks, links) for entries (id, follow_ups) of tasks that were completed; blank ones are skipped.

    Ids are hashes of the parent and the place, so a repeated run makes the same rows.
    """
    rows = entries.join(completed.select("id", "project_id"), "id").select("id", "project_id", F.posexplode("follow_ups").alias("pos", "text"))
    rows = rows.where(F.trim("text") != "").withColumn("child", F.xxhash64("id", "pos", "text"))
    tasks = rows.select(F.col("child").alias("id"), "project_id", F.col("text").alias("description"), F.lit("active").alias("status"), F.col("id").alias("parent_task_id"), at(as_of).alias("created_at"), tx.summary("text").alias("summary"))
    links = rows.select(F.xxhash64("id", "child").alias("id"), F.col("id").alias("source_task_id"), F.col("child").alias("target_task_id"), F.lit("follow_up").alias("link_type"), at(as_of).alias("created_at"))
    return tasks, links


def lessons(tasks: DataFrame, said: DataFrame, origin: str, as_of: str) -> DataFrame:
    """Lesson rules (from rows id, lesson) of tasks that were completed or abandoned, tagged with their origin."""
    rows = said.where(F.trim("lesson") != "").join(tasks.select("id", "project_id"), "id")
    return rows.select(F.xxhash64("id", "lesson").alias("id"), "project_id", F.lit("lesson").alias("category"), F.col("lesson").alias("content"), F.array(F.lit(f"origin:{origin}")).alias("tags"), F.col("id").alias("source_task_id"), at(as_of).alias("created_at"))


def delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows `ids` of one and what hangs on them; references that may be null are cleared."""
    out = dict(tables)
    gone = ids.select("id").distinct()
    out[table] = out[table].join(gone, "id", "left_anti")
    for child, col, how in REFERENCES.get(table, []):
        if child not in out:
            continue
        key = gone.withColumnRenamed("id", col)
        if how == "cascade":
            lost = out[child].join(key, col, "left_semi").select("id")
            out |= delete(out, child, lost)
        else:
            hit = out[child].join(key.withColumn("__hit", F.lit(1)), col, "left")
            out[child] = hit.withColumn(col, F.when(F.col("__hit").isNull(), F.col(col))).select(out[child].columns)
    return out


def submit_summaries(chunks: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
    """Summaries for aligned lists of at most 100 ids, each of at most 512 bytes."""
    if len(ids) != len(texts) or len(ids) > 100 or any(len(t.encode()) > 512 for t in texts):
        raise ValueError("lists of one length, 100 at most, of summaries of 512 bytes at most")
    new = chunks.sparkSession.createDataFrame(list(zip(ids, texts, strict=True)), "id long, summary string")
    return patch(chunks, new, "id", ["summary"])


def invalidate(chunks: DataFrame, version: int) -> DataFrame:
    """Vectors and summaries of older behaviour versions are cleared."""
    old = F.col("behavior_version") < version
    return chunks.withColumns({c: F.when(~old, F.col(c)) for c in ("embedding", "summary")})


def defaults(kind: str, as_of: str) -> dict[str, Column]:
    """What a new row has where nothing is said; all are created now."""
    of_kind = {
        "rules": {"valid_from": at(as_of), "tags": F.array().cast("array<string>"), "hit_count": F.lit(0), "weight": F.lit(1.0), "is_always_injected": F.coalesce(F.col("category") == "instruction", F.lit(False))},
        "tasks": {"status": F.lit("active")},
        "attempts": {"outcome": F.lit("pending"), "reasoning": F.lit("")},
        "snapshots": {"wiped_at": at(as_of)},
    }
    return of_kind[kind] | {"created_at": at(as_of)}


def insert(state: DataFrame, new: DataFrame, kind: str, as_of: str) -> DataFrame:
    """New rows with defaults: created now; a rule is always given to sessions if it is an instruction, unless said
    otherwise; a task has a summary of its description. Columns of the state that new rows lack are null."""
    known = set(new.columns)
    given = defaults(kind, as_of)
    if kind == "tasks" and "description" in known:
        given["summary"] = tx.summary("description")
    cols = []
    for f in state.schema.fields:
        value = F.col(f.name) if f.name in known else F.lit(None)
        cols.append((F.coalesce(value, given[f.name]) if f.name in given else value).cast(f.dataType).alias(f.name))
    return state.unionByName(new.select(*cols))

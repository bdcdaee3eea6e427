"""Predicates over rules and tasks. The "active" ones differ on purpose: counts, search, injection and deduplication each have their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def unsuperseded() -> Column:
    """For counts and lists."""
    return F.col("valid_until").isNull()


def searchable(as_of: str) -> Column:
    """For search: also not expired."""
    return unsuperseded() & (F.col("expires_at").isNull() | (F.col("expires_at") > at(as_of)))


def injectable(as_of: str) -> Column:
    """For standing instructions: also valid by now and flagged."""
    return searchable(as_of) & (F.col("valid_from") <= at(as_of)) & F.col("is_always_injected")


def comparable() -> Column:
    """For deduplication: with a vector, expired or not."""
    return unsuperseded() & F.col("embedding").isNotNull()


def has_all_tags(tags: Sequence[str], col: str = "tags") -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, tags)), F.col(col))) == 0 if tags else F.lit(True)


def suits(task_type: str | None, col: str = "task_type_affinity") -> Column:
    return F.lit(True) if task_type is None else F.col(col).isNull() | F.array_contains(col, task_type)


def older_than(col: str, as_of: str, days: int = 0, hours: int = 0) -> Column:
    return F.col(col) < at(as_of) - F.expr(f"make_dt_interval({days}, {hours})")


def live(as_of: str) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") > at(as_of))


def rules_where(rules: DataFrame, project: int | None = None, category: str | None = None, tags: Sequence[str] = (), when: Column | None = None) -> DataFrame:
    """The conjunction of what is given."""
    out = rules if when is None else rules.where(when)
    if project is not None:
        out = out.where(F.col("project_id") == project)
    if category is not None:
        out = out.where(F.col("category") == category)
    return out.where(has_all_tags(tags)) if tags else out


def tasks_where(tasks: DataFrame, project: int | None = None, status: str | None = None, priority: str | None = None, task_type: str | None = None, ticket_prefix: str | None = None) -> DataFrame:
    """ticket_prefix is matched without regard to case, and its % and _ are wildcards."""
    for col, value in (("project_id", project), ("status", status), ("priority", priority), ("task_type", task_type)):
        if value is not None:
            tasks = tasks.where(F.col(col) == value)
    return tasks if ticket_prefix is None else tasks.where(F.col("ticket_number").ilike(ticket_prefix + "%"))


SORTS = {"created_at", "completed_at", "priority", "status", "task_type", "ticket_number"}


def page(tasks: DataFrame, sort: str | None = None, descending: bool = True, number: int = 1, per_page: int = 50) -> DataFrame:
    """A page of tasks in a whitelisted order, nulls last and then by id; by default priority first, then age."""
    if sort is not None and sort not in SORTS:
        raise ValueError(f"no sorting by {sort}")
    way = lambda c, down: F.desc_nulls_last(c) if down else F.asc_nulls_last(c)
    order = [way(sort, descending)] if sort else [way("priority", False), way("created_at", descending)]
    per_page, number = min(200, max(1, per_page)), max(1, number)
    return tasks.orderBy(*order, "id").offset((number - 1) * per_page).limit(per_page)


def pages(rows: int, per_page: int) -> int:
    return -(-rows // min(200, max(1, per_page)))

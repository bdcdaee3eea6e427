"""The data model: schemas of the stored tables, their keys, value sets and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the model's enumerations
CATEGORIES = ["preference", "fact", "constraint", "lesson", "instruction"]
STATUSES = ["active", "completed", "abandoned", "blocked"]
OUTCOMES = ["pending", "accepted", "rejected", "unknown"]
LINK_TYPES = ["blocks", "related_to", "caused_by", "duplicate_of", "follow_up"]
CODE_EDGE_TYPES = ["calls", "uses", "contains"]

_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()
_V, _A = T.ArrayType(T.FloatType()), T.ArrayType(T.StringType())


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


SCHEMAS: dict[str, T.StructType] = {
    "projects": _schema(id=_L, name=_S, root_path=_S, created_at=_TS, ticket_url_template=_S),
    "semantic_rules": _schema(id=_L, project_id=_L, category=_S, content=_S, embedding=_V, source_task_id=_L, created_at=_TS, expires_at=_TS, hit_count=_L, last_used_at=_TS, weight=_D, task_type_affinity=_A, tags=_A, valid_from=_TS, valid_until=_TS, is_always_injected=_B),
    "tasks": _schema(id=_L, project_id=_L, description=_S, status=_S, parent_task_id=_L, created_at=_TS, completed_at=_TS, resolved_attempt_id=_L, priority=_S, task_type=_S, summary=_S, description_embedding=_V, ticket_number=_S),
    "attempts": _schema(id=_L, task_id=_L, approach_summary=_S, code_snippet=_S, outcome=_S, reasoning=_S, reasoning_embedding=_V, git_ref=_S, token_cost=_I, created_at=_TS, resolved_at=_TS, agent_id=_S, session_id=_S, resolved_by_agent_id=_S, resolved_by_session_id=_S),
    "context_snapshots": _schema(id=_L, task_id=_L, wiped_at=_TS, token_count_before=_I, last_attempt_id=_L, agent_id=_S, session_id=_S),
    "code_chunks": _schema(id=_L, project_id=_L, file_path=_S, start_line=_I, end_line=_I, language=_S, content=_S, embedding=_V, file_hash=_S, indexed_at=_TS, summary=_S, behavior_version=_I, chunk_name=_S, chunk_kind=_S, community_id=_I),
    "task_links": _schema(id=_L, source_task_id=_L, target_task_id=_L, link_type=_S, created_at=_TS),
    "knowledge_edges": _schema(id=_L, source_entity=_S, target_entity=_S, edge_type=_S, confidence=_D, source_task_id=_L, project_id=_L, created_at=_TS),
    "codebase_edges": _schema(id=_L, project_id=_L, source_entity=_S, target_entity=_S, edge_type=_S, source_file=_S, target_file=_S, created_at=_TS),
    "rule_chunk_links": _schema(id=_L, rule_id=_L, chunk_id=_L, similarity=_D, created_at=_TS),
    "scratchpad": _schema(id=_L, project_id=_L, task_id=_L, key=_S, value=_S, expires_at=_TS, created_at=_TS, updated_at=_TS),
}

KEYS: dict[str, list[str]] = {
    "projects": ["name"], "code_chunks": ["project_id", "file_path", "start_line"], "task_links": ["source_task_id", "target_task_id", "link_type"],
    "knowledge_edges": ["source_entity", "target_entity", "edge_type", "project_id"], "codebase_edges": ["project_id", "source_entity", "target_entity", "edge_type"],
    "rule_chunk_links": ["rule_id", "chunk_id"], "scratchpad": ["project_id", "task_id", "key"],
}

#: What a delete takes along (cascade) or clears (set null): parent table -> (child, column, how).
REFERENCES: dict[str, list[tuple[str, str, str]]] = {
    "projects": [("semantic_rules", "project_id", "cascade"), ("tasks", "project_id", "cascade"), ("code_chunks", "project_id", "cascade"), ("knowledge_edges", "project_id", "cascade"), ("codebase_edges", "project_id", "cascade"), ("scratchpad", "project_id", "cascade")],
    "tasks": [("attempts", "task_id", "cascade"), ("context_snapshots", "task_id", "cascade"), ("task_links", "source_task_id", "cascade"), ("task_links", "target_task_id", "cascade"), ("scratchpad", "task_id", "cascade"), ("tasks", "parent_task_id", "null"), ("semantic_rules", "source_task_id", "null"), ("knowledge_edges", "source_task_id", "null")],
    "semantic_rules": [("rule_chunk_links", "rule_id", "cascade")],
    "code_chunks": [("rule_chunk_links", "chunk_id", "cascade")],
}


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def violations(df: DataFrame, table: str) -> DataFrame:
    """Keys of `table` that occur more than once, with their count; nulls count as equal."""
    return df.groupBy(*KEYS[table]).count().where("count > 1")


def one_of(col: str | Column, allowed: list[str]) -> Column:
    """Whether a value, whatever its case, is allowed; null when it is null."""
    return F.lower(F.col(col) if isinstance(col, str) else col).isin(allowed)


# fixed values: byte caps of the inputs
CAPS = {"description": 4096, "approach": 2048, "reasoning": 4096, "summary": 512, "name": 256, "code_snippet": 32768}
TTL_SECONDS = (1, 315_360_000)


CONFIDENCE = (0.0, 1.0)
RANGES = {"confidence": CONFIDENCE, "ttl_secs": TTL_SECONDS}


def problems(df: DataFrame, caps: dict[str, int], required: tuple[str, ...] = (), ranges: dict[str, tuple[float, float]] = RANGES) -> Column:
    """What is wrong with a row as one string, null where nothing is: blank required columns, byte caps passed, and
    numbers out of their range (nulls are in it; a NaN isn't)."""
    checks = [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} must not be blank")) for c in required if c in df.columns]
    checks += [F.when(F.octet_length(F.col(c)) > n, F.lit(f"{c} exceeds {n} bytes")) for c, n in caps.items() if c in df.columns]
    checks += [F.when(~F.col(c).between(a, b), F.lit(f"{c} must be between {a} and {b}")) for c, (a, b) in ranges.items() if c in df.columns]
    if not checks:
        return F.lit(None).cast("string")
    said = F.array_join(F.filter(F.array(*checks), lambda x: x.isNotNull()), "; ")
    return F.when(said != "", said)


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that were given; a null argument makes no condition."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def scrubbed(df: DataFrame, caps: dict[str, int], required: tuple[str, ...] = (), scrub: bool = True) -> DataFrame:
    """Inputs as they are stored: secrets taken out of every capped text first (if `scrub`), then `problem` found, so that
    lengths are those of what is kept."""
    from tessera.functions.text import scrub as redact

    out = df.withColumns({c: redact(c) for c in caps if c in df.columns}) if scrub else df
    return out.withColumn("problem", problems(out, caps, required))

"""The test tables seen as the engine's model, for Spark and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.batches import settle

RULES_AS_OF, LEDGER_AS_OF, EVENTS_AS_OF = "2025-01-01 00:00:00", "2001-10-01 00:00:00", "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("/"), F.lower("n_name")).alias("root_path"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, lead = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").when(key % 2 == 0, "blocked").otherwise("abandoned")
    return rows.select(
        key.alias("id"), F.col("c_nationkey").cast("long").alias("project_id"), F.concat(F.lit("order "), key).alias("description"), status.alias("status"),
        F.when(lead.isin("1", "2", "3", "4"), F.concat(F.lit("P"), lead)).alias("priority"), F.col("c_mktsegment").alias("task_type"), F.col("o_orderdate").alias("created_at"),
        F.when(status.isin("completed", "abandoned"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 20 + 1 as int))")).alias("completed_at"),
        F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.lit("-"), key).alias("ticket_number"), F.when(key % 7 == 0, key - 1).alias("parent_task_id"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    outcome = F.when(flag == "A", "accepted").when(flag == "R", "rejected").when(line == "O", "pending").otherwise("unknown")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.concat(F.lit("part "), F.col("l_partkey")).alias("approach_summary"), F.concat(F.lit("supp "), F.col("l_suppkey")).alias("reasoning"),
        outcome.alias("outcome"), F.col("l_shipdate").alias("created_at"), F.when(outcome != "pending", F.expr("l_shipdate + make_dt_interval(1)")).alias("resolved_at"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("v", F.col("doc_id") % 500)
    rows = d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding"), "v")
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 300 + {n} as int))")
    i = F.col("doc_id")
    category = F.element_at(F.array(*map(F.lit, ["constraint", "instruction", "lesson", "fact", "preference"])), (i % 5 + 1).cast("int"))
    return rows.select(
        i.alias("id"), (i % 25).alias("project_id"), category.alias("category"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"), "embedding", (i % 17).alias("hit_count"),
        day(0).alias("created_at"), F.when(i % 3 == 0, day(5)).alias("last_used_at"), F.when(i % 11 == 0, day(200)).alias("expires_at"), F.when(i % 13 == 0, day(40)).alias("valid_until"),
        F.when(i % 10 == 0, F.lit(1.5)).alias("weight"), (i % 20 == 0).alias("is_always_injected"), F.lit(None).cast("long").alias("source_task_id"), day(0).alias("valid_from"),
    )


def attempt_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("project_id"), (F.col("event_id") % 500).alias("v"))
    return e.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding"), "v").drop("v")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("task_id"), F.col("value").cast("int").alias("token_count_before"), F.col("ts").alias("wiped_at"))


def scratch_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    expires = F.when(F.col("event_id") % 4 != 0, F.expr("ts + make_dt_interval(cast(event_id % 20 as int))"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.lit(None).cast("long").alias("task_id"), F.col("event_type").alias("key"), F.col("props").alias("value"), expires.alias("expires_at"), F.col("ts").alias("updated_at"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 25).alias("project_id"), F.concat_ws("/", "source", F.concat("doc_id", F.lit("."), "lang")).alias("file_path"), F.col("text").alias("content"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source_entity"), F.concat(F.lit("s"), "l_suppkey").alias("target_entity")).distinct()


#: The same views for an SQL engine that has the test tables as views.
SQL = """
projects AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, '/' || lower(n_name) AS root_path FROM nation),
tasks0 AS (SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS project_id, 'order ' || o_orderkey AS description,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderkey % 2 = 0 THEN 'blocked' ELSE 'abandoned' END AS status,
    CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3', '4') THEN 'P' || substr(o_orderpriority, 1, 1) END AS priority,
    c_mktsegment AS task_type, o_orderdate AS created_at, upper(substr(c_mktsegment, 1, 3)) || '-' || o_orderkey AS ticket_number,
    CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS parent_task_id
  FROM orders JOIN customer ON o_custkey = c_custkey),
tasks AS (SELECT *, CASE WHEN status IN ('completed', 'abandoned') THEN created_at + to_days(CAST(id % 20 + 1 AS INTEGER)) END AS completed_at FROM tasks0),
attempts AS (SELECT l_orderkey AS task_id, 'part ' || l_partkey AS approach_summary, 'supp ' || l_suppkey AS reasoning, l_shipdate AS created_at,
    CASE WHEN l_returnflag = 'A' THEN 'accepted' WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'unknown' END AS outcome,
    CASE WHEN l_returnflag IN ('A', 'R') OR l_linestatus <> 'O' THEN l_shipdate + INTERVAL 1 DAY END AS resolved_at
  FROM lineitem),
rules AS (SELECT doc_id AS id, doc_id % 25 AS project_id, ['constraint', 'instruction', 'lesson', 'fact', 'preference'][CAST(doc_id % 5 + 1 AS INTEGER)] AS category,
    text AS content, [lang, source] AS tags, CAST(embedding AS DOUBLE[]) AS embedding, doc_id % 17 AS hit_count,
    TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) AS created_at,
    CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 + 5 AS INTEGER)) END AS last_used_at,
    CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 + 200 AS INTEGER)) END AS expires_at,
    CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 + 40 AS INTEGER)) END AS valid_until,
    CASE WHEN doc_id % 10 = 0 THEN 1.5 END AS weight, doc_id % 20 = 0 AS is_always_injected
  FROM documents JOIN embeddings ON doc_id % 500 = vec_id),
attempt_vectors AS (SELECT event_id AS id, user_id % 25 AS project_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM events JOIN embeddings ON event_id % 500 = vec_id WHERE event_type = 'error'),
snapshots AS (SELECT event_id AS task_id, CAST(trunc(value) AS INTEGER) AS token_count_before, ts AS wiped_at FROM events WHERE event_type = 'signup'),
scratch_writes AS (SELECT event_id AS id, user_id AS project_id, event_type AS key, props AS value, ts AS updated_at,
    CASE WHEN event_id % 4 <> 0 THEN ts + to_days(CAST(event_id % 20 AS INTEGER)) END AS expires_at FROM events),
code_files AS (SELECT doc_id AS id, doc_id % 25 AS project_id, source || '/' || doc_id || '.' || lang AS file_path, text AS content FROM documents),
supply_edges AS (SELECT DISTINCT 'p' || l_partkey AS source_entity, 's' || l_suppkey AS target_entity FROM lineitem),
query_vec AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
"""

"""Streaming forms: entries of the scratchpad with expiry, and escalation of attempts left pending."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.state import upsert_scratch


def merge_scratch(writes: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fold a stream of scratch writes into a table of the newest entry by key, a version of it for each batch.

    A batch's version is a folder named by its number and overwritten if the batch is repeated, so the result is the
    same after a restart.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v={number - 1}") if number else None
        upsert_scratch(before, batch).write.mode("overwrite").parquet(f"{path}/v={number}")

    w = writes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


_SCRATCH_KEY = ["project_id", "task_id", "key"]


def merge_scratch_buckets(writes: DataFrame, path: str, checkpoint: str, buckets: int = 64, available_now: bool = True) -> StreamingQuery:
    """As merge_scratch, for large states: entries are dealt to buckets by a hash of their key, and a batch writes only the
    buckets that it touches.

    A small table for each batch tells which batch wrote each bucket last. A repeated batch starts from the table of the
    batch before and overwrites its own folders, so the result is the same after a restart.
    """
    bucket = F.pmod(F.xxhash64(*_SCRATCH_KEY), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{path}/written/v={number - 1}").collect()} if number else {}
        touched = sorted(r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect())  # `buckets` rows at most
        old = [f"{path}/rows/v={held[b]}/bucket={b}" for b in touched if b in held]
        if touched:
            before = spark.read.parquet(*old) if old else None
            upsert_scratch(before, batch).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/v={number}")
        now = held | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{path}/written/v={number}")

    w = writes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def scratch_of_buckets(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The entries after a batch."""
    held = spark.read.parquet(f"{path}/written/v={number}").collect()  # a row a bucket
    return spark.read.parquet(*[f"{path}/rows/v={r['batch']}/bucket={r['bucket']}" for r in held])


def pending_too_long(attempts: DataFrame, hours: int = 72) -> DataFrame:
    """(task_id, hour, pending): attempts that came in as pending, by task and hour of event time; late ones beyond the
    watermark of `hours` are dropped from the count."""
    return attempts.withWatermark("created_at", f"{hours} hours").where("outcome = 'pending'").groupBy(F.window("created_at", "1 hour").alias("hour"), "task_id").agg(F.count(F.lit(1)).alias("pending"))


def webhook_events(events: DataFrame, allowed: list[str], send: Callable[[list[dict]], None], checkpoint: str) -> StreamingQuery:
    """Hand allowed events (event, project, data, timestamp) to `send`, a batch at a time from the tasks."""

    def deliver(batch: DataFrame, _: int) -> None:
        batch.where(F.col("event").isin(allowed)).foreachPartition(lambda rows: send([r.asDict() for r in rows]))

    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

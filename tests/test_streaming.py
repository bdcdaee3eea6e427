"""The streaming forms give what the batch forms give."""

from tessera.operators.state import upsert_scratch
from tessera.sources.fixtures import scratch_writes
from tessera.streaming import memory

SF = "/root/testdata/sf0.001"


def test_scratch_stream(spark, tmp_path):
    writes = scratch_writes(spark, SF)
    for k in range(2):
        writes.where(f"id % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    (tmp_path / "flat").mkdir()
    for i, f in enumerate(sorted((tmp_path / "in").rglob("*.parquet"))):
        f.rename(tmp_path / "flat" / f"{i}.parquet")
    stream = spark.readStream.schema(writes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    q = memory.merge_scratch(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[2:]))
    got = sorted(map(str, spark.read.parquet(str(last)).select("project_id", "key", "value", "expires_at", "created_at").collect()))
    want = sorted(map(str, upsert_scratch(None, writes).select("project_id", "key", "value", "expires_at", "created_at").collect()))
    assert got == want and last.name == "v=1"


def test_scratch_stream_in_buckets(spark, tmp_path):
    writes = scratch_writes(spark, SF)
    (tmp_path / "in").mkdir()
    rows = writes.orderBy("id").collect()
    for k, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 : -3], rows[-3:])):
        spark.createDataFrame(part, writes.schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        # a batch a file, in this order; each run goes on where the last ended
        q = memory.merge_scratch_buckets(spark.readStream.schema(writes.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), buckets=7)
        q.awaitTermination(120)
    cols = ["project_id", "key", "value", "expires_at", "created_at"]
    got = sorted(map(str, memory.scratch_of_buckets(spark, str(tmp_path / "out"), 2).select(cols).collect()))
    assert got == sorted(map(str, upsert_scratch(None, writes).select(cols).collect()))
    assert len(list((tmp_path / "out" / "rows" / "v=2").glob("bucket=*"))) <= 3  # only what the last batch touched


def test_pending_by_hour(spark, tmp_path):
    rows = spark.createDataFrame([(1, "pending", "2026-01-01 08:10:00"), (1, "pending", "2026-01-01 08:50:00"), (1, "accepted", "2026-01-01 08:55:00"), (2, "pending", "2026-01-01 09:00:00")], "task_id long, outcome string, created_at string")
    rows.selectExpr("task_id", "outcome", "cast(created_at as timestamp) created_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task_id long, outcome string, created_at timestamp").parquet(str(tmp_path / "in"))
    q = memory.pending_too_long(stream).writeStream.format("memory").queryName("pending_by_hour").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r["task_id"], r["hour"]["start"].hour, r["pending"]) for r in spark.table("pending_by_hour").collect()) == [(1, 8, 2), (2, 9, 1)]


def test_webhook_events(spark, tmp_path):
    spark.createDataFrame([("a", "p", "x"), ("b", "p", "y"), ("a", "q", "z")], "event string, project string, data string").write.parquet(str(tmp_path / "in"))
    where = str(tmp_path / "sent")

    def send(rows):
        import os
        import uuid

        if rows:
            os.makedirs(where, exist_ok=True)
            with open(f"{where}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(r["data"] for r in rows))

    memory.webhook_events(spark.readStream.schema("event string, project string, data string").parquet(str(tmp_path / "in")), ["a"], send, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(x for f in (tmp_path / "sent").iterdir() for x in f.read_text().split("\n")) == ["x", "z"]

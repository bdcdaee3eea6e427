"""Keyed streams with timers: a run in the middle of which the stream restarts gives what the batch forms give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import filters, ledger, state
from tessera.sources import fixtures as fx
from tessera.streaming import stateful

SF = "/root/testdata/sf0.001"


def run(spark, parts, kind, build, tmp_path):
    """Each part is a file and a run of the stream of its own, which goes on where the last ended; rows and states after each."""
    (tmp_path / "in").mkdir()
    states = []
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        q = build(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None)
    return spark.read.parquet(str(tmp_path / "out")), states


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scratch_expires_as_in_batches(spark, tmp_path):
    writes = fx.scratch_writes(spark, SF)
    rows = writes.orderBy("updated_at", "id").collect()
    half = next(i for i in range(len(rows) // 2, len(rows)) if rows[i]["updated_at"] > rows[i - 1]["updated_at"])
    end = dt.datetime(2026, 1, 1)  # a last write, long after: all that can expire has
    last = [rows[0].asDict() | {"id": 10**9, "project_id": -1, "key": "end", "value": "v", "expires_at": None, "updated_at": end}]
    df = lambda r: spark.createDataFrame(r, writes.schema)
    parts = [df(rows[:half]), df(rows[half:]), df(last), df([last[0] | {"id": 10**9 + 1, "key": "more"}])]
    changes, states = run(spark, parts, writes.schema, stateful.scratch_changes, tmp_path)
    cols = ["project_id", "task_id", "key", "id", "value", "expires_at", "created_at", "updated_at"]
    got = changes.where("project_id >= 0").select(*cols, "event").collect()
    batch = state.upsert_scratch(None, df(rows))
    keep = lambda d: sorted(map(str, d.select(cols).collect()))
    newest = state.newest(changes.where("project_id >= 0"), ["project_id", "task_id", "key"], ["updated_at", "last", "event"])
    # what never expires is the same, with its history; the rest is gone, and said so once
    assert keep(newest.where("event = 'put' AND expires_at IS NULL")) == keep(changes.where("project_id >= 0 AND event = 'put' AND expires_at IS NULL").join(batch.where("expires_at IS NULL").select("project_id", "key", "updated_at"), ["project_id", "key", "updated_at"], "left_semi"))
    want = {(r["project_id"], r["key"], r["value"], r["updated_at"]) for r in batch.where(filters.live("2025-12-31 00:00:00")).collect()}
    gone = {(r["project_id"], r["key"], r["updated_at"]) for r in got if r["event"] == "expired"}
    live = {(r["project_id"], r["key"], r["value"], r["updated_at"]) for r in newest.where("event = 'put'").collect() if (r["project_id"], r["key"], r["updated_at"]) not in gone}
    assert live == want and len(want) > 0
    assert {(r["project_id"], r["key"], r["updated_at"]) for r in batch.where("expires_at IS NOT NULL").collect()} <= gone
    assert states[-1] < states[1]  # state holds what is alive


def test_a_write_in_time_puts_expiry_off(spark, tmp_path):
    kind = "id long, project_id long, task_id long, key string, value string, expires_at timestamp_ntz, updated_at timestamp_ntz"
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    df = lambda *r: spark.createDataFrame(list(r), kind)
    parts = [df((1, 1, None, "a", "x", at(10), at(0)), (2, 1, 7, "a", "y", at(10), at(1))), df((3, 1, None, "a", "z", at(30), at(5))), df((4, 2, None, "b", None, None, at(20))), df((5, 2, None, "b", "w", None, at(40)))]
    changes, _ = run(spark, parts, kind, stateful.scratch_changes, tmp_path)
    got = sorted((r["project_id"], r["task_id"] or 0, r["key"], r["value"] or "", r["id"], r["event"]) for r in changes.collect())
    assert got == sorted([(1, 0, "a", "x", 1, "put"), (1, 7, "a", "y", 2, "put"), (1, 0, "a", "z", 1, "put"), (1, 7, "a", "y", 2, "expired"), (2, 0, "b", "", 4, "put"), (1, 0, "a", "z", 1, "expired"), (2, 0, "b", "w", 4, "put")])


def test_pending_attempts_escalate_once(spark, tmp_path):
    kind = "attempt_id long, task_id long, outcome string, created_at timestamp_ntz, said_at timestamp_ntz"
    day = lambda d, h=0: dt.datetime(2026, 1, d, h)
    df = lambda *r: spark.createDataFrame(list(r), kind)
    parts = [
        df((1, 10, "pending", day(1), day(1)), (2, 10, "pending", day(1, 5), day(1, 5)), (3, 11, "accepted", day(1), day(1, 6))),
        df((2, 10, "accepted", day(1, 5), day(2)), (4, 12, "pending", day(3), day(3))), df((5, 13, "pending", day(5), day(5))), df((6, 13, "rejected", day(9), day(9))), df((7, 13, "rejected", day(9), day(10))),
    ]
    found, states = run(spark, parts, kind, stateful.escalations, tmp_path)
    assert sorted((r["attempt_id"], r["task_id"], r["outcome"], r["resolved_at"]) for r in found.collect()) == [(1, 10, "unknown", day(4)), (4, 12, "unknown", day(6)), (5, 13, "unknown", day(8))]
    assert states[-1] == 0


def test_rejections_come_to_the_threshold_once(spark, tmp_path):
    attempts = fx.attempts(spark, SF).where("outcome = 'rejected'")
    rows = attempts.orderBy("resolved_at", "created_at", "approach_summary", "reasoning").collect()
    cuts = [next(i for i in range(len(rows) * k // 3, len(rows)) if rows[i]["resolved_at"] > rows[i - 1]["resolved_at"]) for k in (1, 2)]
    df = lambda r: spark.createDataFrame(r, attempts.schema)
    parts = [df(rows[: cuts[0]]), df(rows[cuts[0] : cuts[1]]), df(rows[cuts[1] :])]
    found, _ = run(spark, parts, attempts.schema, lambda s: stateful.rejection_stream(s, 2), tmp_path)
    pick = lambda d: sorted((r["task_id"], r["resolved_at"], r["rejected"]) for r in d.collect())
    want = pick(ledger.rejection_events(attempts, 2))
    assert pick(found) == want and len(want) > 10

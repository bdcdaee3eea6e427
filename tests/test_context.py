"""What a session needs, summaries, invalidated versions, vectors filled in later, links and follow-ups."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import briefing, embed, graph, ledger, retrieval, state

NOW = "2026-01-01 00:00:00"


def day(n):
    return dt.datetime(2025, 1, n)


def test_active_context(spark):
    tasks = spark.createDataFrame([(1, 7, "active", day(2)), (2, 7, "active", day(1)), (3, 7, "completed", day(1)), (4, 8, "active", day(1))], "id long, project_id long, status string, created_at timestamp_ntz")
    attempts = spark.createDataFrame([(10, 2, "pending"), (11, 1, "pending"), (12, 2, "rejected"), (13, 4, "accepted")], "id long, task_id long, outcome string")
    kind = "id long, project_id long, category string, content string, tags array<string>, embedding array<double>, created_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, expires_at timestamp_ntz, is_always_injected boolean, source_task_id long"
    rule = lambda i, project, v, standing=False, until=None: (i, project, "fact", f"rule {i}", ["x"], v, day(i % 28 + 1), day(1), until, None, standing, None)
    rules = spark.createDataFrame([rule(i, 7, [1.0, i / 10]) for i in range(8)] + [rule(20, 8, [1.0, 0.0], True), rule(21, 7, [0.0, 1.0], True), rule(22, 7, [1.0, 0.0], until=day(3)), rule(23, 7, None)], kind)
    failures = spark.createDataFrame([(i, 7 + i % 2, [1.0, i / 10]) for i in range(9)], "id long, project_id long, embedding array<double>")
    got = briefing.active_context(tasks, attempts, rules, failures, [1.0, 0.0], 7, NOW)
    ids = {k: [r["id"] for r in v.collect()] for k, v in got.items()}
    assert ids["task"] == [2] and sorted(ids["attempts"]) == [10, 12] and ids["standing"] == [21]
    assert ids["rules"] == [0, 1, 2, 3, 4] and ids["failures"] == [0, 2, 4]
    none = briefing.active_context(tasks, attempts, rules, failures, [1.0, 0.0], 99, NOW)
    assert all(v.count() == 0 for v in none.values())


CHUNKS = "id long, summary string, embedding array<float>, behavior_version int"


def test_summaries_are_submitted_by_id(spark):
    chunks = spark.createDataFrame([(1, None, [1.0], 1), (2, "old", [2.0], 1), (3, "kept", None, 1)], CHUNKS)
    got = {r["id"]: r["summary"] for r in state.submit_summaries(chunks, [1, 2, 9], ["one", "two", "nobody"]).collect()}
    assert got == {1: "one", 2: "two", 3: "kept"}
    for ids, texts in (([1], []), (list(range(101)), ["x"] * 101), ([1], ["é" * 257])):
        with pytest.raises(ValueError):
            state.submit_summaries(chunks, ids, texts)
    assert state.submit_summaries(chunks, [1], ["é" * 256]).where("id = 1").first()["summary"] == "é" * 256


def test_older_versions_are_invalidated(spark):
    chunks = spark.createDataFrame([(1, "a", [1.0], 1), (2, "b", [2.0], 2), (3, "c", [3.0], 3)], CHUNKS)
    got = {r["id"]: (r["summary"], r["embedding"]) for r in state.invalidate(chunks, 2).collect()}
    assert got == {1: (None, None), 2: ("b", [2.0]), 3: ("c", [3.0])}


def test_backfill_takes_the_smallest_ids_that_lack_a_vector(spark):
    rows = spark.createDataFrame([(5, "five", None), (1, "one", [9.0]), (2, "", None), (3, None, None), (4, "four", None), (6, "four", None)], "id long, content string, embedding array<float>")
    got = {r["id"]: r["embedding"] for r in embed.backfill(rows, "content", limit=2, make=lambda: embed.provider("hashed", 8)).collect()}
    assert set(got) == {4, 5} and np.allclose(got[4], embed.hashed("four", 8)) and np.allclose(got[5], embed.hashed("five", 8))
    assert embed.backfill(rows.limit(0), "content").count() == 0


def test_follow_ups_leave_out_what_is_linked(spark):
    kind = "id long, project_id long, status string, created_at timestamp_ntz, completed_at timestamp_ntz, parent_task_id long"
    tasks = spark.createDataFrame([(1, 1, "completed", day(1), day(3), None), (2, 1, "active", day(4), None, 1), (3, 1, "active", day(5), None, 1), (4, 1, "active", day(2), None, 1), (5, 1, "active", day(9), None, 2)], kind)
    links = spark.createDataFrame([(1, 2), (2, 1), (None, 3)], "source_task_id long, target_task_id long")
    pick = lambda d: sorted((r["parent_id"], r["child_id"]) for r in d.collect())
    assert pick(ledger.follow_ups(tasks)) == [(1, 2), (1, 3)] and pick(ledger.follow_ups(tasks, links)) == [(1, 3)]


def test_orders_and_limits_of_reports(spark):
    members = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", 3), ("e", 3), ("f", None)], "node string, community_id int")
    assert [tuple(r) for r in graph.community_sizes(members).collect()] == [(2, 2), (3, 2), (None, 1), (1, 1)]
    v = spark.createDataFrame([(i, [1.0, i / 50]) for i in range(12)], "id long, embedding array<double>")
    top = retrieval.top_pairs(v, 0.5, k=5).collect()
    assert [(r["a"], r["b"]) for r in top][0] == (10, 11) and len(top) == 5 and [r["similarity"] for r in top] == sorted((r["similarity"] for r in top), reverse=True)


def test_first_ranks_of_several_kinds_in_one_pass(spark):
    df = spark.createDataFrame([(i, float(-i % 7), None if i % 3 else float(i)) for i in range(30)], "id long, a double, b double")
    got = sorted((r["kind"], r["at"], r["id"]) for r in retrieval.first_ranks(df, {"x": F.col("a"), "y": -F.col("b")}, 4).collect())
    rows = df.collect()
    want = [("x", n, r["id"]) for n, r in enumerate(sorted(rows, key=lambda r: (r["a"], r["id"]))[:4], 1)]
    want += [("y", n, r["id"]) for n, r in enumerate(sorted((r for r in rows if r["b"] is not None), key=lambda r: (-r["b"], r["id"]))[:4], 1)]
    assert got == want
    plan = retrieval.first_ranks(df, {"x": F.col("a")}, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # a task sends on its first ranks only

"""Behaviours that the test tables don't show, on inline rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import cosine
from tessera.operators import briefing, embed, evaluation, filters, graph, ingest, ledger, retention, retrieval, state
from tessera.plans import schemas

NOW = "2024-06-01 00:00:00"


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f("t").alias("x")).first()["x"]


# -- text

SECRETS = [
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIi.c2ln", "AKIA" + "A1" * 8, "ghp_" + "a" * 36,
    "postgres://u:p@h/db", "Bearer abc.def-ghi", "api_key = 'abcdefghijklmnop1'", 'password: "ABCDEFGHIJKLMNOPQ"',
]


@pytest.mark.parametrize("secret", SECRETS)
def test_scrub(spark, secret):
    out = one(spark, f"before {secret} after", tx.scrub)
    assert out == "before [REDACTED] after" or (out.startswith("before") and secret not in out)
    assert one(spark, out, tx.scrub) == out
    assert one(spark, f"before {secret}", lambda c: tx.scrub(c, enabled=False)) == f"before {secret}"


@pytest.mark.parametrize("clean", ["plain text", "token = short", "AKIA123", "ghp_short", "eyJonly.one"])
def test_scrub_leaves_clean_text(spark, clean):
    assert one(spark, clean, tx.scrub) == clean


def test_previews_count_chars_and_bytes(spark):
    e = "é" * 100
    assert one(spark, e, tx.summary) == e and one(spark, e + e, tx.summary) == "é" * 117 + "..."
    assert one(spark, e, lambda c: tx.clipped(c, 120)) == e[:117] + "..." and one(spark, "a" * 120, lambda c: tx.clipped(c, 120)) == "a" * 120


def test_urls_and_dates(spark):
    assert one(spark, "A b*~é/", tx.percent_encoded) == "A%20b%2A~%C3%A9%2F"
    assert one(spark, "X-1", lambda c: tx.ticket_url(F.lit("http://t/{ticket}?x"), c)) == "http://t/X-1?x"
    assert one(spark, "2024-02-03 04:05:06", tx.day) == "03-02-2024" and one(spark, "not a date at all", tx.day) == "not a date"


@pytest.mark.parametrize("text,want", [("use std::collections::HashMap;", "std::collections::HashMap"), ("use a::{b, c};", "a"), ("from foo.bar import baz", "foo.bar"), ("import os", "os"), ("import { x } from 'y';", "y"), ("import java.util.List;", "java.util.List"), ("other", "other")])
def test_import_path(spark, text, want):
    assert one(spark, text, tx.import_path) == want


@pytest.mark.parametrize("path,want", [("a/b.rs", "rust"), ("x.PY", None), ("noext", None), ("a.b/c.tsx", "tsx"), (".py", None), ("x.kts", "kotlin")])
def test_language(spark, path, want):
    assert one(spark, path, tx.language) == want


# -- ingestion


def test_indexable(spark):
    paths = {"src/a.py": True, "a.png": False, "target/x.rs": False, "sub/target/x.rs": True, "Cargo.lock": False, ".hidden/x.py": False, "lib/.env": False, "pkg/x": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ingest.indexable("p").alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in got} == paths


def chunks_slow(text, lang, most):
    lines = text.removesuffix("\n").split("\n") if text else []
    starts = [i for i, x in enumerate(lines) if i == 0 or any(x.lstrip().startswith(p) for p in ingest.BOUNDARIES.get(lang, []))]
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        out += [(i + 1, min(i + most, b)) for i in range(a, b, most)]
    return out


@pytest.mark.parametrize("lang", ["python", "rust", None])
def test_chunks_by_boundaries(spark, lang):
    text = "import x\n\ndef f():\n  a\n  b\n  c\n\nclass A:\n    def g(self):\n        pass\nfn x() {}\npub struct Y;\n" + "z\n" * 9
    df = spark.createDataFrame([(1, text, lang), (2, "", lang), (3, None, lang), (4, "one", lang)], "id int, content string, language string")
    got = [(r["id"], r["start_line"], r["end_line"]) for r in ingest.chunk_lines(df, most=4).orderBy("id", "start_line").collect()]
    assert got == [(1, *c) for c in chunks_slow(text, lang, 4)] + [(4, 1, 1)]


def test_python_edges(spark):
    code = "import os\nfrom a.b import c\n\ndef f(x):\n    g(x)\n    return os.path.join(x)\n\nclass K:\n    def m(self):\n        f(1)\n\nf(2)\n"
    df = spark.createDataFrame([(1, "m.py", code), (1, "bad.py", "def ("), (1, "x.rs", "fn main() { a(); }")], "project_id long, file_path string, content string")
    got = {(r["source_entity"], r["target_entity"], r["edge_type"]) for r in ingest.python_edges(df).collect()}
    assert got == {("m.py", "os", "uses"), ("m.py", "a.b", "uses"), ("f", "g", "calls"), ("f", "os.path.join", "calls"), ("m", "f", "calls"), ("<module>", "f", "calls")}
    assert {(r["chunk_name"], r["chunk_kind"], r["start_line"], r["end_line"]) for r in ingest.python_chunks(df).collect()} == {("f", "function", 4, 6), ("K", "class", 8, 10)}
    assert one(spark, "a::b::c::d", ingest.callee) == "c::d" and one(spark, "b::c", ingest.callee) == "b::c"


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.py").write_text("x = 1\n")
    (tmp_path / "b.png").write_bytes(b"\x89")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    assert [(r["file_path"], r["content"]) for r in ingest.scan(spark, str(tmp_path)).collect()] == [("sub/a.py", "x = 1\n")]


def test_merge_chunks(spark):
    cols = "id long, project_id long, file_path string, start_line int, end_line int, content string, embedding array<float>, file_hash string, summary string, community_id int"
    old = spark.createDataFrame([(1, 1, "a", 1, 5, "x", [1.0], "h", "s", 3), (2, 1, "a", 6, 9, "y", [1.0], "h", None, None), (3, 1, "gone", 1, 2, "z", [1.0], "h", None, None)], cols)
    new = spark.createDataFrame([(9, 1, "a", 1, 7, "xx", None, "h2", None, None)], cols)
    plan = spark.createDataFrame([("a", "h2", "index"), ("gone", None, "delete")], "file_path string, file_hash string, action string")
    (row,) = ingest.merge_chunks(old, new, plan).collect()
    assert (row["id"], row["end_line"], row["content"], list(row["embedding"]), row["summary"], row["community_id"]) == (1, 7, "xx", [1.0], "s", 3)
    assert ingest.merge_chunks(old, new.limit(0), plan.where("action = 'delete'")).count() == 3


# -- vectors


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), (None, [1.0])]
    got = [r["c"] for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(cosine("a", "b").alias("c")).collect()]
    assert got[:3] == [0.0, 0.0, pytest.approx(1)] and got[3] is None


@given(st.integers(1, 12), st.floats(0, 1), st.integers(0, 1000))
@settings(max_examples=60, deadline=None)
def test_mmr_order(k, diversity, seed):
    rng = np.random.default_rng(seed)
    v, q = rng.normal(size=(10, 4)), rng.normal(size=4)
    got = retrieval.mmr_order(q, v, k, diversity)
    assert len(got) == min(10, max(k, min(k, 10))) or len(got) == 10
    assert len(set(got)) == len(got)


def test_nearest_is_brute_force_in_blocks(spark):
    v = np.random.default_rng(3).normal(size=(60, 8))
    v[41] = v[7]  # a tie
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    got = {}
    for r in retrieval.nearest(df, df, 5, others=True, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: [j for j in np.lexsort((np.arange(60), -s[i])) if j != i][:5] for i in range(60)}


def test_every_vector_is_a_query(spark):
    from tessera.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r["query_id"] for r in QUERIES["mmr_rerank"](spark, sf).collect()} == ids
    assert {r["case_id"] for r in QUERIES["precision_recall_mrr_all"](spark, sf).collect()} == ids


def test_mmr_prefers_the_different():
    v = np.array([[1, 0, 0], [0.99, 0.01, 0], [0, 1, 0], [0.98, 0.02, 0]])
    assert retrieval.mmr_order(np.array([1.0, 0, 0]), v, 2, 0.8) == [0, 2]
    assert retrieval.mmr_order(np.array([1.0, 0, 0]), v, 4, 0.8) == [0, 1, 2, 3]
    assert retrieval.mmr_order(np.array([1.0, 0]), np.array([[1.0, 0], [1.0, 0], [0, 1.0]]), 1, 0)[0] == 1  # the last of equal ones


def test_pairs_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 6))
    v[7] = 0
    df = spark.createDataFrame([(i, i % 2, [float(x) for x in r]) for i, r in enumerate(v)], "id long, p long, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    s = u @ u.T
    for within in (None, "p"):
        want = {(a, b) for a in range(40) for b in range(a + 1, 40) if s[a, b] >= 0.4 and (within is None or a % 2 == b % 2)}
        got = [(r["a"], r["b"]) for r in retrieval.similar_pairs(df, 0.4, within, block=7).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_insert_decisions_follow_the_order(spark):
    a, near = [1.0, 0.0], [1.0, 0.01]
    cols = "id long, project_id long, embedding array<double>, valid_until timestamp_ntz"
    new = spark.createDataFrame([(1, 1, a, None), (2, 1, near, None), (3, 1, [1.0, 0.6], None), (4, 2, a, None)], cols)
    old = spark.createDataFrame([(100, 2, near, None)], cols)
    got = {r["id"]: (r["stored"], list(r["duplicates"]), list(r["contradictions"])) for r in retrieval.insert_decisions(new, old).collect()}
    assert got == {1: (True, [], []), 2: (False, [1], []), 3: (True, [], [1]), 4: (False, [100], [])}


def test_query_signs():
    assert retrieval.sanitised("it's a:b | (c) !") == "its & ab & c" and not retrieval.has_words("!! ()") and retrieval.has_words("a*")


def test_hybrid_falls_back_to_vectors(spark):
    cols = "id long, project_id long, category string, content string, tags array<string>, embedding array<double>, hit_count long, created_at timestamp_ntz, last_used_at timestamp_ntz, expires_at timestamp_ntz, valid_until timestamp_ntz, weight double"
    import datetime

    d = datetime.datetime(2024, 1, 1)
    rows = [(1, 1, "fact", "alpha beta", ["x"], [1.0, 0.0], 0, d, None, None, None, None), (2, 2, "fact", "alpha", ["x"], [0.9, 0.1], 0, d, None, None, None, None)]
    df = spark.createDataFrame(rows, cols)
    assert [r["id"] for r in retrieval.hybrid_rules(df, [1.0, 0.0], "()", 2, NOW).collect()] == [1, 2]
    assert [r["id"] for r in retrieval.hybrid_rules(df, [1.0, 0.0], "alpha", 2, NOW, project=2).collect()] == [2, 1]
    assert retrieval.grouped(df.withColumn("score", F.lit(1.0))).count() == 3


@pytest.mark.parametrize("name", ["hashed", "constant"])
def test_providers(spark, name):
    v = embed.provider(name, 48)(["a", "b", "a"])
    assert v.shape == (3, 48) and (v[0] == v[2]).all()
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id long, content string")
    got = {r["id"]: r["embedding"] for r in embed.embed(df, make=lambda: embed.provider(name, 48)).collect()}
    assert got[2] is None and got[1] == got[3] and len(got[1]) == 48
    with pytest.raises(ValueError):
        embed.provider("custom", 3, lambda t: np.zeros((1, 2)))(["x"])


# -- ledger, state, retention


def tasks_of(spark, rows):
    return spark.createDataFrame(rows, "id long, project_id long, description string, status string, parent_task_id long, created_at timestamp_ntz, completed_at timestamp_ntz, priority string, summary string")


def test_roll_up_stops_after_ten_levels(spark):
    import datetime

    d = datetime.datetime(2024, 1, 1)
    chain = tasks_of(spark, [(i, 1, "t", "completed" if i == 12 else "active", i - 1 if i else None, d, None, None, None) for i in range(13)])
    got = {r["id"]: r["status"] for r in state.roll_up(chain, chain.where("id = 12"), NOW).collect()}
    assert [i for i in range(13) if got[i] == "completed"] == list(range(2, 13))
    open_child = tasks_of(spark, [(0, 1, "p", "active", None, d, None, None, None), (1, 1, "c", "completed", 0, d, d, None, None), (2, 1, "c", "blocked", 0, d, None, None, None)])
    assert {r["status"] for r in state.roll_up(open_child, open_child.where("id = 1"), NOW).where("id = 0").collect()} == {"active"}


def test_urgency(spark):
    import datetime

    d = datetime.datetime(2024, 5, 22)
    t = tasks_of(spark, [(1, 1, "t", "active", None, d, None, "P1", None), (2, 1, "t", "active", None, datetime.datetime(2024, 5, 31, 0, 30), None, None, None)]).withColumn("rejected_attempts", F.lit(3))
    score, why = ledger.urgency(NOW)
    a, b = t.select(score.alias("s"), why.alias("w")).orderBy("id").collect()
    assert a["s"] == pytest.approx(4 + 0.9 + 1.0) and a["w"] == "P1=4.0+rejections=0.9+stale=1.0"
    assert b["s"] == pytest.approx(1 + 0.9 + 0.1 * 23 / 24) and b["w"] == "rejections=0.9"


def test_task_patches_have_three_states(spark):
    import datetime

    t = tasks_of(spark, [(1, 1, "old", "active", None, datetime.datetime(2024, 1, 1), None, "P1", "old")])
    c = spark.createDataFrame([(1, "x" * 130, "")], "id long, description string, priority string")
    r = state.patch_tasks(t, c, ["description", "priority"]).first()
    assert r["priority"] is None and r["summary"] == "x" * 117 + "..." and r["status"] == "active"


def test_status_updates(spark):
    import datetime

    d = datetime.datetime(2024, 1, 1)
    t = tasks_of(spark, [(1, 1, "t", "completed", None, d, d, None, None)])
    assert state.set_status(t, t, "abandoned", NOW).first()["completed_at"] is None
    assert str(state.set_status(t, t, "abandoned", NOW, batch=True).first()["completed_at"]) == NOW
    assert state.complete(t, t, NOW).first()["completed_at"] == d
    kids, links = state.follow_up_tasks(t, spark.createDataFrame([(1, ["do a", " ", "do b"])], "id long, follow_ups array<string>"), NOW)
    assert kids.count() == links.count() == 2
    assert state.lessons(t, spark.createDataFrame([(1, "learned")], "id long, lesson string"), "abandoned", NOW).first()["tags"] == ["origin:abandoned"]


def test_scratch_is_idempotent(spark):
    import datetime

    d = lambda n: datetime.datetime(2024, 1, n)
    cols = "id long, project_id long, task_id long, key string, value string, expires_at timestamp_ntz, updated_at timestamp_ntz"
    w = spark.createDataFrame([(1, 1, None, "k", "a", d(9), d(1)), (2, 1, None, "k", "b", None, d(2)), (3, 1, 5, "k", "c", None, d(1))], cols)
    once = state.upsert_scratch(None, w)
    twice = state.upsert_scratch(once, w)
    rows = lambda x: sorted((r["id"], r["task_id"] or 0, r["value"], r["expires_at"], r["created_at"]) for r in x.collect())
    assert rows(once) == rows(twice) == [(1, 0, "b", None, d(1)), (3, 5, "c", None, d(1))]


def test_links(spark):
    s = spark.createDataFrame([(1, 1, 0.5)], "rule_id long, chunk_id long, similarity double")
    n = spark.createDataFrame([(1, 1, 0.7), (1, 2, 0.6)], s.schema)
    key = ["rule_id", "chunk_id"]
    assert sorted(map(tuple, state.upsert_links(s, n, key, "similarity").collect())) == [(1, 1, 0.7), (1, 2, 0.6)]
    assert sorted(map(tuple, state.insert_ignore(s, n, key).collect())) == [(1, 1, 0.5), (1, 2, 0.6)]
    with pytest.raises(Exception, match="duplicate key"):
        state.insert_strict(s, n, key).collect()
    assert schemas.violations(s.unionByName(n), "rule_chunk_links").count() == 1


def test_delete_takes_children_along(spark):
    t = {
        "projects": spark.createDataFrame([(1,), (2,)], "id long"), "tasks": spark.createDataFrame([(1, 1, None), (2, 2, 1)], "id long, project_id long, parent_task_id long"),
        "attempts": spark.createDataFrame([(1, 1), (2, 2)], "id long, task_id long"), "semantic_rules": spark.createDataFrame([(1, 2, 1)], "id long, project_id long, source_task_id long"),
    }
    out = state.delete(t, "projects", t["projects"].where("id = 1"))
    assert [r["id"] for r in out["tasks"].collect()] == [2] and out["tasks"].first()["parent_task_id"] is None
    assert [r["id"] for r in out["attempts"].collect()] == [2] and out["semantic_rules"].first()["source_task_id"] is None


def test_sweep_order(spark):
    import datetime

    day = lambda n: datetime.datetime(2024, 6, 1) - datetime.timedelta(days=n)
    a = spark.createDataFrame(
        [(1, 1, "a", "", "accepted", day(20), day(19)), (2, 1, "b", "why", "accepted", day(21), day(18)), (3, 1, "r", "no", "rejected", day(22), day(18)), (4, 1, "old", "", "accepted", day(40), day(39)), (5, 1, "p", "", "pending", day(4), None), (6, 1, "fresh", "", "accepted", day(2), day(1))],
        "id long, task_id long, approach_summary string, reasoning string, outcome string, created_at timestamp_ntz, resolved_at timestamp_ntz",
    )
    t = tasks_of(spark, [(1, 1, "work", "completed", None, day(50), day(15), None, None), (2, 1, "ancient", "completed", None, day(300), day(200), None, None)])
    tables = {
        "attempts": a, "tasks": t, "context_snapshots": spark.createDataFrame([(1, 1, day(9)), (2, 1, day(2))], "id long, task_id long, wiped_at timestamp_ntz"),
        "scratchpad": spark.createDataFrame([(1, None, day(1)), (2, None, None)], "id long, task_id long, expires_at timestamp_ntz"), "semantic_rules": schemas.empty(spark, "semantic_rules"),
    }
    out = retention.sweep(tables, NOW)
    assert {r["id"]: r["outcome"] for r in out["attempts"].collect()} == {5: "unknown", 6: "accepted"}
    assert [r["id"] for r in out["tasks"].collect()] == [1] and out["scratchpad"].count() == 1 and out["context_snapshots"].count() == 1
    assert out["semantic_rules"].first()["content"] == "## Task: work\n### Rejected approaches:\n- r: no\n### Accepted approach:\n- b: why\n- a\n"


def test_filters(spark):
    df = spark.createDataFrame([(1, ["rust", "async"]), (2, ["rust"]), (3, [])], "id long, tags array<string>")
    assert [r["id"] for r in df.where(filters.has_all_tags(["async", "rust"])).collect()] == [1] and df.where(filters.has_all_tags([])).count() == 3
    with pytest.raises(ValueError):
        filters.page(df, sort="id; drop table")
    rows = spark.createDataFrame([(" ", "x" * 600), ("ok", "y"), ("é" * 200, "y")], "name string, summary string")
    got = [r["p"] for r in rows.select(schemas.problems(rows, schemas.CAPS, ("name",)).alias("p")).collect()]
    assert got == ["name must not be blank; summary exceeds 512 bytes", None, "name exceeds 256 bytes"]


# -- graphs

TWO_TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", 1) for a, b in pairs], "source_entity string, target_entity string, edge_type string, project_id long")


def test_louvain(spark):
    got = graph.louvain_one(TWO_TRIANGLES)
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"] and graph.louvain_one([]) == {}
    assert graph.louvain(edges_of(spark, TWO_TRIANGLES)).select("community_id").distinct().count() == 2


@pytest.mark.parametrize("same,want", [(True, 0.5), (False, 0.0)])
def test_modularity(spark, same, want):
    com = spark.createDataFrame([("a", 0), ("b", 0 if same else 1)], "node string, community_id int")
    assert graph.modularity(edges_of(spark, [("a", "b")]), com).first()[0] == want


def bfs(pairs, start, directed):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        if not directed:
            near.setdefault(b, set()).add(a)
    depth, level = {start: 0}, [start]
    while level:
        level = sorted({y for x in level for y in near.get(x, ()) if y not in depth})
        depth |= dict.fromkeys(level, max(depth.values()) + 1)
    return depth


@pytest.mark.parametrize("directed", [True, False])
def test_search(spark, directed):
    rng = np.random.default_rng(3)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 14, (16, 2))]
    e = edges_of(spark, pairs)
    want = bfs(pairs, "n1", directed)
    got = {r["node"]: r["depth"] for r in graph.reach(e, "n1", 3, directed).collect()}
    assert got == {n: d for n, d in want.items() if d <= 3}
    far = max((d, n) for n, d in want.items() if d <= 4)
    path = graph.shortest_path(e, "n1", far[1], directed=directed)
    assert len(path) == far[0] and (not path or (path[0][0] == "n1" and path[-1][1] == far[1] and all(x[1] == y[0] for x, y in zip(path, path[1:], strict=False))))
    assert graph.shortest_path(e, "n1", "nowhere", directed=directed) == []


def test_paths_to_oneself(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")])
    assert graph.shortest_path(e, "a", "a") == [] and graph.shortest_path(e, "a", "a", directed=True) == [("a", "b"), ("b", "c"), ("c", "a")]
    assert graph.k_hop_edges(e, "a").count() == 2 and graph.k_hop_edges(e, "a", 2).count() == 3 and graph.k_hop_edges(e, "a", 1, "uses").count() == 0


# -- evaluation and briefings


def test_metrics(spark):
    rows = [("1", "d", ["a", "b"], ["x", "a", "b"]), ("2", "d", ["a"], []), ("3", "d", [], []), ("4", "d", [], ["x"])]
    m = evaluation.case_metrics(spark.createDataFrame(rows, "case_id string, dataset string, expected array<string>, returned array<string>"), 2)
    got = {r["case_id"]: r.asDict() for r in m.collect()}
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["rr"]) == (0.5, 0.5, 0.5) and got["2"]["precision"] == 0
    assert got["3"]["negative_pass"] and not got["4"]["negative_pass"] and got["3"]["precision"] is None
    d = evaluation.dataset_metrics(m).first()
    assert (d["mean_precision"], d["negative_pass_rate"]) == (0.25, 0.5)
    s = evaluation.set_metrics(spark.createDataFrame([("1", "d", ["a", "b"], ["a", "c", "a"])], "case_id string, dataset string, expected array<string>, returned array<string>")).first()
    assert (s["context_precision"], s["context_recall"]) == (0.5, 0.5)


def test_baseline_tolerance(spark):
    cols = "dataset string, metric string, value double"
    now = spark.createDataFrame([("d", "a", 0.48), ("d", "b", 0.47), ("e", "a", 1.0)], cols)
    base = spark.createDataFrame([("d", "a", 0.5), ("d", "b", 0.5), ("f", "a", 1.0)], cols)
    assert {(r["dataset"], r["metric"]): r["verdict"] for r in evaluation.diff(now, base).collect()} == {("d", "a"): "ok", ("d", "b"): "regression", ("e", "a"): "extra", ("f", "a"): "missing"}
    assert evaluation.changed_rows(base, now).count() == 3


def test_file_context(spark):
    chunks = spark.createDataFrame([(1, "f.py", 1, 5, "go", "function", 2), (2, "f.py", 6, 9, None, None, None)], "id long, file_path string, start_line int, end_line int, chunk_name string, chunk_kind string, community_id int")
    edges = spark.createDataFrame([("x", "go", "calls", "o.py", None), ("x", "go", "calls", "o.py", None), ("go", "y", "calls", "f.py", None)], "source_entity string, target_entity string, edge_type string, source_file string, target_file string")
    links = spark.createDataFrame([(7, 1, 0.9), (7, 2, 0.8)], "rule_id long, chunk_id long, similarity double")
    rules = spark.createDataFrame([(7, "fact", "text")], "id long, category string, content string")
    got = briefing.file_context(chunks, edges, links, rules, "f.py")
    assert got["structure"].first()["lines"] == "1-5" and got["rules"].first()["similarity"] == 0.9 and got["callers"].count() == 1 and got["callees"].count() == 1


def test_communities(spark):
    chunks = spark.createDataFrame([(1, "a.py", 1, "f", None), (1, "b.py", 1, "f", None), (1, "b.py", 9, "g", 4)], "project_id long, file_path string, start_line int, chunk_name string, community_id int")
    members = spark.createDataFrame([("f", "a.py", 1), ("f", None, 2)], "chunk_name string, file_path string, community_id int")
    assert {(r["file_path"], r["chunk_name"]): r["community_id"] for r in graph.assign_communities(chunks, members).collect()} == {("a.py", "f"): 1, ("b.py", "f"): 2, ("b.py", "g"): 4}

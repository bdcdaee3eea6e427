"""English full text, exports, defaults, validation, replay, baselines, and changes that repeat a key."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import english
from tessera.operators import briefing, evaluation, graph, ingest, ledger, retrieval, state
from tessera.plans import schemas
from tessera.sources import evaluation as files

NOW = "2026-01-01 00:00:00"


@pytest.mark.parametrize(
    "word,want",
    [w.split() for w in "consigned consign;consistency consist;consolations consol;conspicuously conspicu;knackeries knackeri;knives knive;running run;hopping hop;hoping hope;happy happi;relational relat;generously generous;communism communism;skies sky;dying die;cries cri;ties tie;gas gas;gaps gap;kiwis kiwi;agreed agre;luxuriated luxuri;conflated conflat;by by;say say;nationally nation;adoption adopt;replacement replac;university univers;proceed proceed;inning inning".split(";")],
)
def test_stemmer(word, want):
    assert english.stem(word) == want


def test_cover_density_by_hand():
    q = english.wanted("quick foxes")
    assert english.density("the quick brown fox", q) == pytest.approx(0.05)  # one word between
    assert english.density("Fox, and then a quick fox", q) == pytest.approx(0.1 + 0.1 / 4)  # two covers: 'fox ... quick', 'quick fox'
    assert english.density("a quick dog", q) is None and english.density(None, q) is None
    assert english.wanted("the of and") == frozenset() and english.density("the of", english.wanted("the")) is None
    assert english.density("Élan vital", english.wanted("élan")) == pytest.approx(0.1)


def rules_table(spark, rows):
    return spark.createDataFrame([tuple({"id": i, "project_id": 1, "category": "fact", "content": c, "embedding": v, "hit_count": 0, "weight": 1.0, "tags": []}.get(f.name) for f in schemas.SCHEMAS["semantic_rules"].fields) for i, c, v in rows], schemas.SCHEMAS["semantic_rules"]).withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))


def test_hybrid_search_in_english(spark):
    rules = rules_table(spark, [(1, "running shoes were bought", [1.0, 0.0]), (2, "nothing of the kind", [0.0, 1.0]), (3, "he runs and a shoe is there", [0.5, 0.5])])
    plain = retrieval.matches("content", "run shoe")[0]
    assert rules.where(plain).count() == 0
    got = {r["id"]: r["__rank"] for r in retrieval.said_order(rules, "run shoe", True)[0].collect()}
    assert set(got) == {1, 3} and got[1] > got[3]
    assert [r["id"] for r in retrieval.hybrid_rules(rules, [1.0, 0.0], "run shoe", 2, NOW, english=True).collect()] == [1, 3]


def test_diverse_code_search(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1, f"f{i}.py", 1, 2, "python", "alpha beta" if i % 2 else "gamma", [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "id long, project_id long, file_path string, start_line int, end_line int, language string, content string, embedding array<float>")
    found = retrieval.hybrid_chunks(chunks, [1, 0, 0, 0], "alpha", 12).collect()
    got = retrieval.hybrid_chunks_diverse(chunks, [1, 0, 0, 0], "alpha", 3, 0.5).collect()
    found.sort(key=lambda r: (-r["score"], r["id"]))
    order = retrieval.mmr_order(np.array([1, 0, 0, 0.0]), np.array([r["embedding"] for r in found]), 3, 0.5)
    assert [r["id"] for r in got] == [found[i]["id"] for i in order[:3]] and [r["rank"] for r in got] == [1, 2, 3]
    hit = retrieval.code_hits(chunks.withColumn("summary", F.lit(None).cast("string"))).where("file = 'f3.py'").first()
    assert (hit["lines"], hit["language"], hit["summary"]) == ("1:2", "python", None)


def test_fresh_pairs_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, i % 4 == 0, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, p long, fresh boolean, embedding array<float>")
    new = {r[0] for r in rows if r[2]}
    want = {(r["a"], r["b"]) for r in retrieval.similar_pairs(df, 0.3, "p").collect() if r["a"] in new or r["b"] in new}
    assert want == {(r["a"], r["b"]) for r in retrieval.similar_pairs(df, 0.3, "p", block=5, fresh="fresh").collect()} and want


def test_decision_messages(spark):
    rules = rules_table(spark, [(1, "x" * 300, [1.0, 0.0]), (2, "y" * 300, [0.0, 1.0])])
    new = rules_table(spark, [(7, "n", [1.0, 0.0]), (8, "m", [0.45, 0.9])])
    made = retrieval.insert_decisions(new, rules)
    caps = spark.createDataFrame([(1, 21, "over_cap")], "project_id long, count long, level string")
    got = {r["id"]: r for r in retrieval.decision_messages(made, rules, caps).collect()}
    assert not got[7]["stored"] and got[7]["previews"] == ["x" * 100] and got[8]["stored"] and got[8]["conflicts"] == ["y" * 150]
    assert got[8]["cap_level"] == "over_cap" and got[8]["cap_count"] == 21


def test_changes_that_repeat_a_key(spark):
    tasks = spark.createDataFrame([(1, "old", "s"), (2, "b", "t")], "id long, description string, summary string")
    changes = spark.createDataFrame([(1, "first", "2026-01-01"), (1, "second", "2026-01-02")], "id long, description string, updated_at string")
    for got in (state.patch(tasks, changes, "id", ["description"]), state.patch_tasks(tasks, changes, ["description"])):
        assert sorted((r["id"], r["description"]) for r in got.collect()) == [(1, "second"), (2, "b")]
    attempts = spark.createDataFrame([(1, "pending", "", None)], "id long, outcome string, reasoning string, resolved_at timestamp_ntz")
    said = spark.createDataFrame([(1, "rejected", "no", "2026-01-01"), (1, "accepted", "yes", "2026-01-03")], "id long, outcome string, reasoning string, at string")
    (row,) = state.log_outcomes(attempts, said, NOW).collect()
    assert (row["outcome"], row["reasoning"]) == ("accepted", "yes") and row["resolved_at"] is not None
    links = spark.createDataFrame([(1, 2, 0.5)], "rule_id long, chunk_id long, similarity double")
    new = spark.createDataFrame([(1, 2, 0.9, 1), (1, 2, 0.7, 2), (3, 4, 0.1, 1)], "rule_id long, chunk_id long, similarity double, seq int")
    assert sorted(map(tuple, state.upsert_links(links, new, ["rule_id", "chunk_id"], "similarity").collect())) == [(1, 2, 0.7), (3, 4, 0.1)]


def test_get_or_create_projects(spark):
    cols = "id long, name string, root_path string"
    known = spark.createDataFrame([(1, "a", "/a"), (2, "n", None)], cols)
    wanted = spark.createDataFrame([(5, "a", "/x"), (6, "b", "/a"), (7, "c", "/c"), (8, "c", "/d"), (9, "e", None), (10, "f", None)], cols)
    assert sorted(r["id"] for r in state.get_or_create_projects(known, wanted).collect()) == [1, 2, 7, 9, 10]


def test_insert_with_defaults(spark):
    rules = schemas.empty(spark, "semantic_rules")
    new = spark.createDataFrame([(1, 1, "instruction", "do"), (2, 1, "fact", "is")], "id long, project_id long, category string, content string")
    got = {r["id"]: r for r in state.insert(rules, new, "rules", NOW).collect()}
    assert got[1]["is_always_injected"] and not got[2]["is_always_injected"] and got[1]["tags"] == [] and got[2]["hit_count"] == 0 and got[1]["created_at"] is not None
    said = state.insert(rules, new.withColumn("is_always_injected", F.lit(False)), "rules", NOW)
    assert said.where("is_always_injected").count() == 0
    task = state.insert(schemas.empty(spark, "tasks"), spark.createDataFrame([(1, 1, "x" * 200)], "id long, project_id long, description string"), "tasks", NOW).first()
    assert task["status"] == "active" and len(task["summary"]) == 120
    assert state.insert(schemas.empty(spark, "attempts"), spark.createDataFrame([(1, 1, "try")], "id long, task_id long, approach_summary string"), "attempts", NOW).first()["outcome"] == "pending"


def test_validation_after_scrubbing(spark):
    df = spark.createDataFrame([("k", 0.5, 60), ("k", 1.5, 0), ("", None, None), ("password = '" + "q" * 400 + "'", 0.0, 1)], "name string, confidence double, ttl_secs long")
    got = [r["problem"] for r in schemas.scrubbed(df, {"name": 256}, ("name",)).collect()]
    assert got[0] is None and got[1] == "confidence must be between 0.0 and 1.0; ttl_secs must be between 1 and 315360000" and got[2] == "name must not be blank" and got[3] is None
    assert schemas.scrubbed(df, {"name": 256}, (), scrub=False).collect()[3]["problem"] == "name exceeds 256 bytes"


def test_exports(spark):
    projects = spark.createDataFrame([(1, "p", "/p"), (2, "q", "/q")], "id long, name string, root_path string")
    rules = rules_table(spark, [(1, "c" * 90, [1.0])])
    ts = lambda d: d.withColumn("created_at", F.to_timestamp_ntz("created_at"))
    tasks = ts(spark.createDataFrame([(10, 1, "do it", "active", "2026-01-01 08:00:00", None)], "id long, project_id long, description string, status string, created_at string, completed_at timestamp_ntz"))
    attempts = ts(spark.createDataFrame([(100, 10, "second", "accepted", "", "2026-01-03 00:00:00"), (99, 10, "first", "rejected", "why\nnot", "2026-01-02 00:00:00")], "id long, task_id long, approach_summary string, outcome string, reasoning string, created_at string"))
    parts = briefing.export_report(projects, rules, tasks, attempts).where("project_id = 1").orderBy("section", "seq").collect()
    assert "".join(r["markdown"] for r in parts) == (
        "# Memory Export — p\n\n## Rules (1 total)\n\n### [Fact] " + "c" * 80 + "\n- **ID:** `1`\n- **Content:** " + "c" * 90 + "\n\n## Tasks (1 total)\n\n### Active: do it\n- **ID:** `10`\n"
        "- **Created:** 2026-01-01 08:00 UTC\n\n**Attempts:**\n\n- **Rejected** — first\n  > why\n  > not\n- **Accepted** — second\n\n"
    )
    docs = {r["project_id"]: json.loads(r["json"]) for r in briefing.export_project_documents(projects, rules, tasks, attempts).collect()}
    assert [a["id"] for a in docs[1]["attempts"]] == [100, 99] and docs[1]["attempts"][0]["project_id"] == 1 and docs[2] == {"project_id": "2", "rules": [], "tasks": [], "attempts": []}
    links = spark.createDataFrame([(10, 11), (12, 10), (1, 2)], "source_task_id long, target_task_id long")
    got = briefing.review_ledger(attempts, links, 10, "REJECTED")
    assert [r["approach_summary"] for r in got["attempts"].collect()] == ["first"] and got["task_links"].count() == 2


def test_file_context_by_line(spark):
    rows = [(1, 1, "a.py", 10, 12, "late", "function", 7), (2, 1, "a.py", 2, 5, "early", "function", 7), (3, 1, "b.py", 1, 2, "other", "function", 7), (4, 2, "a2.py", 1, 2, "foreign", "function", 7)]
    chunks = spark.createDataFrame(rows, "id long, project_id long, file_path string, start_line int, end_line int, chunk_name string, chunk_kind string, community_id int")
    edges = spark.createDataFrame([], schemas.SCHEMAS["codebase_edges"])
    links = spark.createDataFrame([], schemas.SCHEMAS["rule_chunk_links"])
    got = briefing.file_context(chunks, edges, links, schemas.empty(spark, "semantic_rules"), "a.py")
    assert [r["lines"] for r in got["structure"].collect()] == ["2-5", "10-12"]
    assert [tuple(r) for r in got["communities"].collect()] == [(7, 3)]  # in the whole project


def test_communities_of_common_names(spark):
    chunks = spark.createDataFrame([(1, "a.py", 1, "main", None), (1, "b.py", 1, "main", None), (1, "c.py", 1, "none", 3)], "project_id long, file_path string, start_line int, chunk_name string, community_id int")
    members = spark.createDataFrame([("main", None, 5), ("main", None, 4), ("main", "b.py", 9), ("main", "z.py", 1)], "chunk_name string, file_path string, community_id int")
    assert sorted((r["file_path"], r["community_id"]) for r in graph.assign_communities(chunks, members).collect()) == [("a.py", 4), ("b.py", 9), ("c.py", 3)]


def test_every_import_is_an_edge(spark):
    got = ingest.python_edges(spark.createDataFrame([(1, "m.py", "import a, b.c\nfrom . import d")], "project_id long, file_path string, content string")).collect()
    assert {r["target_entity"] for r in got} == {"a", "b.c", "."}


def test_step_texts(spark):
    rows = [("active", "A", "T-1", 2, 5, 1, 3.456, "base"), ("blocked", "B", None, 0, 0, 0, 1.0, "x"), ("active", "C", None, 0, 4, 2, 2.0, "y")]
    df = spark.createDataFrame(rows, "status string, description string, ticket_number string, pending_attempts long, total_attempts long, rejected_attempts long, score double, score_explanation string")
    assert [r["text"] for r in ledger.step_texts(df).collect()] == [
        "[score=3.46] [T-1] Task 'A' has 2 pending attempt(s) awaiting outcome resolution (base)", "[score=1.00] Task 'B' is BLOCKED — needs unblocking (x)", "[score=2.00] Task 'C' is active (4 attempts, 2 rejected) — propose next approach (y)",
    ]


TAPE = [
    {"id": "one", "dataset": "own", "events": [{"kind": "remember_rule", "label": "tabs", "category": "preference", "content": "indent with tabs"}, {"kind": "remember_rule", "label": "tests", "category": "instruction", "content": "run the tests before a commit"},
                             {"kind": "recall_rules", "query": "running tests", "expected_hits": ["tests"]}, {"kind": "get_active_context", "expected_procedural_labels": ["tests"]}]},
    {"id": "two", "dataset": "own", "events": [{"kind": "recall_rules", "query": "anything", "expected_hits": []}, {"kind": "remember_rule", "label": "x", "category": "fact", "content": "the sky is blue"}, {"kind": "recall_rules", "query": "blue skies", "expected_hits": ["x", "unknown"]}]},
]


def test_replay_and_baseline(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps(TAPE))
    run = evaluation.replay(files.read_cases(spark, str(tmp_path / "cases.json")), NOW, procedural=True)
    recalls, contexts = run.recalls, run.contexts
    got = evaluation.summarised(evaluation.case_metrics(recalls), evaluation.set_metrics(contexts))
    r = got.first()
    # case one returns both rules, the wanted one first; case two passes its negative, then finds one of two
    assert (r["k"], r["num_cases"], r["num_recalls"], r["num_scored"], r["num_negative"], r["num_contexts"], r["num_contexts_scored"], r["num_contexts_negative"]) == (10, 2, 3, 2, 1, 1, 1, 0)
    assert r["mean_precision_at_k"] == pytest.approx(0.75) and r["mean_recall_at_k"] == pytest.approx(0.75) and r["mean_mrr"] == pytest.approx(1.0)
    assert (r["negative_pass_rate"], r["mean_context_precision"], r["mean_context_recall"]) == (1.0, 1.0, 1.0)
    path = str(tmp_path / "baseline.json")
    files.write_baseline(got, path, {"k": "10"})
    base = files.read_baseline(spark, path)
    assert {x["verdict"] for x in evaluation.compared(got, base).collect()} == {"ok"} and evaluation.shape_mismatches(got, base).count() == 0
    worse = got.withColumns({"mean_mrr": F.lit(0.5), "num_cases": F.lit(3).cast("long")})
    assert [x["metric"] for x in evaluation.compared(worse, base).where("verdict = 'regression'").collect()] == ["mean_mrr"]
    assert [x["mismatch"] for x in evaluation.shape_mismatches(worse, base).collect()] == ["num_cases: baseline=2 current=3"]
    told = json.loads((tmp_path / "baseline.json").read_text())
    for broken in (told | {"more": 1}, told | {"version": 2}, {"version": 1}):
        (tmp_path / "broken.json").write_text(json.dumps(broken))
        with pytest.raises(files.FormatError):
            files.read_baseline(spark, str(tmp_path / "broken.json"))
    (tmp_path / "broken.json").write_text(json.dumps([{"id": "a", "events": [], "x": 1}]))
    with pytest.raises(files.FormatError):
        files.read_cases(spark, str(tmp_path / "broken.json"))


def test_ignore_rules(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".gitignore").write_text("# notes\n*.log\n/top.txt\nout/\n!keep.log\n")
    (tmp_path / "sub" / ".gitignore").write_text("*.tmp\n!../x\na/**/z.py\n")
    for name in ("a.log", "keep.log", "top.txt", "sub/top.txt", "sub/b.log", "sub/c.tmp", "c.tmp", "out/x.py", "sub/out/y.py", "sub/a/b/z.py", "sub/a/z.py", "sub/q.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {r["file_path"] for r in ingest.scan(spark, str(tmp_path)).collect()}
    assert got == {"keep.log", "sub/top.txt", "c.tmp", "sub/q.py"}


def test_definitions_and_edges_of_other_languages(spark):
    files = [
        (1, "a.rs", "use std::io::{Read};\npub fn load(x: u8) {\n    let y = parse::inner::deep(x);\n    if (y) { helper(y) }\n}\nstruct Own;\nimpl Own {\n  fn hidden() { load(1); }\n}"),
        (1, "b.ts", "import { x } from './mod';\nexport class Box {\n  go() { x.run(); }\n}\nconst make = () => Box();"),
        (1, "c.go", "import \"fmt\"\nfunc Main() {\n  fmt.Println(low())\n}\nfunc low() int { return 1 }"),
        (1, "D.java", "import java.util.List;\npublic class D {\n}"),
        (1, "e.py", "def f():\n    g()\nclass _C: pass"),
        (1, "n.md", "call(me)"),
    ]
    df = spark.createDataFrame(files, "project_id long, file_path string, content string")
    got = {(r["file_path"], r["chunk_name"], r["chunk_kind"], r["visibility"], r["start_line"]) for r in ingest.definitions(df).collect()}
    assert got == {
        ("a.rs", "load", "function", "public", 2), ("a.rs", "Own", "struct", "private", 6), ("a.rs", "Own", "impl", "private", 7),
        ("b.ts", "Box", "export", "public", 2), ("b.ts", "make", "const", "private", 5), ("c.go", "Main", "function", "public", 2), ("c.go", "low", "function", "private", 5),
        ("D.java", "D", "class", "public", 2), ("e.py", "f", "function", "public", 1), ("e.py", "_C", "class", "private", 3),
    }
    edges = {(r["source_entity"], r["target_entity"], r["edge_type"]) for r in ingest.code_edges(df).collect()}
    assert {("a.rs", "std::io", "uses"), ("load", "inner::deep", "calls"), ("load", "helper", "calls"), ("hidden", "load", "calls"), ("b.ts", "./mod", "uses"), ("go", "x.run", "calls"), ("<module>", "Box", "calls"), ("Main", "fmt.Println", "calls"), ("Main", "low", "calls"), ("D.java", "java.util.List", "uses"), ("f", "g", "calls")} <= edges
    assert not any(e[0] in ("Box", "K") or e[1] in ("if", "go") for e in edges if e[2] == "calls")

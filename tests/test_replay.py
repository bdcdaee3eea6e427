"""Tapes of cases gone through at once, against one case and one event at a time; decisions in rounds against in order."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import english
from tessera.operators import embed, evaluation, retrieval
from tessera.sources import evaluation as files

NOW = "2026-01-01 00:00:00"


def in_order(n, pairs):
    earlier = {}
    for a, b in pairs:
        earlier.setdefault(max(a, b), set()).add(min(a, b))
    taken = set()
    for i in range(n):
        if not earlier.get(i, set()) & taken:
            taken.add(i)
    return {i: i in taken for i in range(n)}


@pytest.mark.parametrize("seed,n,edges", [(1, 40, 60), (2, 30, 200), (3, 12, 0), (4, 25, "path"), (5, 20, "all")])
def test_first_independent_is_the_greedy_set(spark, seed, n, edges):
    rng = random.Random(seed)
    pairs = {(i, i + 1) for i in range(n - 1)} if edges == "path" else {(i, j) for i in range(n) for j in range(i)} if edges == "all" else {tuple(rng.sample(range(n), 2)) for _ in range(edges)}
    pairs = {(min(p), max(p)) for p in pairs}
    before = spark.createDataFrame([(b, a) for a, b in pairs], "id long, earlier long")
    got = retrieval.first_independent(spark.range(n), before).collect()
    assert len(got) == n and {r["id"]: r["stored"] for r in got} == in_order(n, pairs)


def decided_in_order(new, old, duplicate, low):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out, kept = {}, [(i, p, unit(v)) for i, p, v in old]
    for i, p, v in sorted(new):
        near = sorted(((round(float(unit(v) @ w), 9), j) for j, q, w in kept if q == p), key=lambda x: (-x[0], x[1]))
        near = [(s, j) for s, j in near if s >= low]
        dup = [j for s, j in near if s >= duplicate][:5]
        out[i] = (not dup, dup, [] if dup else [j for _, j in near][:5])
        if not dup:
            kept.append((i, p, unit(v)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_insert_decisions_are_those_in_order(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 4))
    vector = lambda: (base[rng.integers(12)] + rng.normal(size=4) * 0.25).tolist()
    rows = [(int(i), int(rng.integers(3)), vector()) for i in range(120)]
    new, old = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    df = lambda x: spark.createDataFrame([(i, p, v, None) for i, p, v in x], "id long, project_id long, embedding array<double>, valid_until timestamp_ntz")
    got = {r["id"]: (r["stored"], r["duplicates"], r["contradictions"]) for r in retrieval.insert_decisions(df(new), df(old)).collect()}
    assert got == decided_in_order(new, old, retrieval.DUPLICATE, retrieval.CONTRADICTION)
    none = retrieval.insert_decisions(df(new).limit(0), df(old))
    assert none.count() == 0


def gone_through(case, k=10):
    """The recalls of a case, one event at a time."""
    rules, out, attempts = [], [], {}
    for seq, e in enumerate(case["events"]):
        if e["kind"] == "remember_rule":
            v = embed.hashed(e["content"]).astype(float)
            if all(float(v @ r["v"]) < 0.95 for r in rules):
                rules.append({"seq": seq, "v": v, "hits": 0, **e})
        elif e["kind"] == "recall_rules":
            q = embed.hashed(e["query"]).astype(float)
            by_v = sorted(rules, key=lambda r: (-float(q @ r["v"]), r["seq"]))[: 3 * k]
            said = {r["seq"]: d for r in rules if (d := english.density(r["content"], english.wanted(e["query"]))) is not None}
            by_t = sorted(said, key=lambda s: (-said[s], s))[: 3 * k]
            most = max([1, *(r["hits"] for r in rules)])
            place = {r["seq"]: i for i, r in enumerate(by_v, 1)}
            score = {}
            for r in rules:
                s = r["seq"]
                if s in place or s in by_t:
                    v = 1 / (60 + place[s]) if s in place else 0
                    t = 1 / (61 + by_t.index(s)) if s in by_t else 0
                    score[s] = 0.35 * v + 0.25 * t + 0.2 * retrieval.CATEGORY[r["category"]] + 0.1 + 0.1 * np.log1p(r["hits"]) / np.log1p(most)
            got = sorted(score, key=lambda s: (-round(score[s], 12), s))[:k]
            for r in rules:
                r["hits"] += r["seq"] in got
            label = {r["label"]: r["seq"] for r in rules}
            out.append((seq, [label.get(x, -1 - n) for n, x in enumerate(e["expected_hits"])], got))
        elif e["kind"] == "propose_attempt":
            n = sum(a.startswith(e["task_ref"] + "-a") for a in attempts) + 1
            attempts[f"{e['task_ref']}-a{n}"] = "pending"
        elif e["kind"] == "log_outcome":
            attempts[e["attempt_ref"]] = e["outcome"]
    return out, attempts


def cases():
    rng = random.Random(3)
    words = ["cache", "query", "index", "retry", "deploy", "schema", "token", "merge", "lock", "stream"]
    out = []
    for c in range(4):
        events = []
        for t in range(2):
            events += [{"kind": "start_task", "task_ref": f"t{t}", "description": "d"}]
            events += [{"kind": "propose_attempt", "task_ref": f"t{t}", "approach": f"p{a}"} for a in range(2)]
        for i in range(25):
            text = " ".join(rng.choices(words, k=5))
            events.append({"kind": "remember_rule", "content": text, "category": rng.choice(list(retrieval.CATEGORY)), "label": f"r{i}"})
            if i % 6 == 3:  # the same again isn't stored
                events.append({"kind": "remember_rule", "content": text, "category": "fact", "label": f"again{i}"})
            if i % 8 == 7:
                events.append({"kind": "recall_rules", "query": f"{rng.choice(words)} {rng.choice(words)}s", "expected_hits": [f"r{i}", f"r{i - 3}", f"again{i}"]})
        events += [{"kind": "log_outcome", "attempt_ref": "t0-a2", "outcome": "rejected", "reasoning": "no"}, {"kind": "log_outcome", "attempt_ref": "t0-a2", "outcome": "accepted", "reasoning": "yes"}]
        events += [{"kind": "recall_rules", "query": "the of", "expected_hits": []}, {"kind": "get_active_context", "expected_procedural_labels": []}]
        out.append({"id": f"case-{c}", "dataset": "made", "events": events, "expected": {"recall_hit_ids": [], "task_completion": None}})
    return out


def read(spark, tmp_path, tape):
    (tmp_path / "tape.json").write_text(json.dumps(tape))
    return files.read_cases(spark, str(tmp_path / "tape.json"))


def test_replay_is_the_cases_one_by_one(spark, tmp_path):
    tape = cases()
    run = evaluation.replay(read(spark, tmp_path, tape), NOW)
    got = {}
    for r in run.recalls.collect():
        got.setdefault(r["case_id"], []).append((r["seq"], list(r["expected"]), list(r["returned"])))
    want = {c["id"]: gone_through(c) for c in tape}
    assert {c: sorted(x) for c, x in got.items()} == {c: x for c, (x, _) in want.items()}
    made = {}
    for r in run.attempts.collect():
        made.setdefault(r["case_id"], {})[r["own_ref"]] = r["outcome"]
    assert made == {c: x for c, (_, x) in want.items()}
    assert {r["label"] for r in run.deduplicated.collect()} == {f"again{i}" for i in (3, 9, 15, 21)}
    labels = {(r["case_id"], r["label"]): r["id"] for r in run.labels.collect()}
    assert labels["case-0", "task-t1"] == 3 and labels["case-0", "attempt-t1-a2"] == 5 and ("case-0", "again3") not in labels
    assert [list(r["returned"]) for r in run.contexts.collect()] == [[]] * 4


@pytest.mark.parametrize(
    "event,problem",
    [
        ({"kind": "propose_attempt", "task_ref": "t9", "approach": "x"}, "unknown task: t9"), ({"kind": "log_outcome", "attempt_ref": "t1-a2", "outcome": "accepted"}, "unknown attempt: t1-a2"),
        ({"kind": "sing"}, "unknown event: sing"), ({"kind": "log_outcome", "attempt_ref": "t1-a1", "outcome": "great"}, "unknown outcome: great"),
    ],
)
def test_problems_of_tapes(spark, tmp_path, event, problem):
    tape = [{"id": "a", "dataset": "d", "events": [{"kind": "start_task", "task_ref": "t1", "description": "x"}, {"kind": "propose_attempt", "task_ref": "t1", "approach": "x"}, event]}]
    df = read(spark, tmp_path, tape)
    assert [r["problem"] for r in evaluation.tape_problems(evaluation.taped(df)).collect()] == [problem]
    with pytest.raises(ValueError, match=problem):
        evaluation.replay(df, NOW)


def test_an_empty_tape(spark):
    run = evaluation.replay(spark.createDataFrame([], evaluation.CASES), NOW)
    assert run.recalls.count() == run.labels.count() == run.contexts.count() == 0
    assert evaluation.summarised(evaluation.case_metrics(run.recalls), evaluation.set_metrics(run.contexts)).count() == 0

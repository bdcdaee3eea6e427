"""What larger tables need: equal pairs with equal values, few copies of vectors, edges that stay where they are."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, graph, retrieval


def vectors(spark, v, p=1):
    return spark.createDataFrame([(i, i % p, x.tolist()) for i, x in enumerate(v)], "id long, p long, embedding array<double>")


def shuffled(df):
    """Rows that the stages of df have written to shuffles."""
    tracker, sc = df.sparkSession.sparkContext.statusTracker(), df.sparkSession.sparkContext
    sc.setJobGroup("growth", "growth")
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = sc._jsc.sc().statusStore()
    ids = {s for j in tracker.getJobIdsForGroup("growth") for s in tracker.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in ids)


def shuffled_by_known(df):
    """The same of the stages that are still known: in a long session those that were skipped are forgotten at once."""
    sc = df.sparkSession.sparkContext
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    sc.setJobGroup("known", "known")
    before = {*tracker.getJobIdsForGroup("known")}
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    sc.setLocalProperty("spark.jobGroup.id", None)
    ids = {s for j in {*tracker.getJobIdsForGroup("known")} - before for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in ids if tracker.getStageInfo(s) is not None)


def test_equal_pairs_are_equally_similar(spark):
    base = np.random.default_rng(0).normal(size=(20, 64))
    df = vectors(spark, base[np.arange(1021) % 20])
    seen = {}
    for r in retrieval.similar_pairs(df, 0.2).collect():
        seen.setdefault(tuple(sorted((r["a"] % 20, r["b"] % 20))), set()).add(r["similarity"])
    assert len(seen) > 20 and {len(s) for s in seen.values()} == {1}


def test_pairs_of_copies_are_made_of_lists(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "LISTED", 64)
    base = np.random.default_rng(3).normal(size=(6, 4))
    base[4], base[5] = 0, np.nan
    n = 1200
    df = vectors(spark, base[np.arange(n) % 6], 2).withColumn("p", F.expr("nullif(p, 1)"))
    u = base[:4] / np.linalg.norm(base[:4], axis=1, keepdims=True)
    kind = np.arange(n) % 6
    for within, copies in ((None, retrieval.COPIES), ("p", retrieval.COPIES), ("p", 300)):
        monkeypatch.setattr(retrieval, "COPIES", copies)
        found = retrieval.similar_pairs(df, 0.1, within, places=6)
        got = {(r["a"], r["b"]): r["similarity"] for r in found.collect()}
        want = {(a, b): round(float(u[kind[a]] @ u[kind[b]]), 6) for a in range(n) for b in range(a + 1, n) if max(kind[a], kind[b]) < 4 and (within is None or a % 2 == b % 2) and u[kind[a]] @ u[kind[b]] >= 0.1}
        assert got == want and found.count() == len(want) > 50_000
        assert 0 < shuffled_by_known(found) < n / 2  # pieces of lists, and neither vectors nor pairs
    single = retrieval.similar_pairs(vectors(spark, np.concatenate([base[:4], base[:1]])), 0.1).collect()
    assert {(r["a"], r["b"]) for r in single} >= {(0, 4)} and len({(r["a"], r["b"]) for r in single}) == len(single)


def test_first_pairs_are_those_of_all(spark):
    df = vectors(spark, np.random.default_rng(2).normal(size=(90, 4)).round(0), 2)
    for within in (None, "p"):
        every = retrieval.similar_pairs(df, 0.5, within).collect()
        want = sorted((-round(r["similarity"], 12), r["a"], r["b"]) for r in every)[:15]
        assert [(r["a"], r["b"]) for r in retrieval.top_pairs(df, 0.5, 15, within).collect()] == [w[1:] for w in want]
        assert len(every) > 15 and retrieval.similar_pairs(df, 0.5, within, k=15).count() <= 15 * (2 if within else 1)


def test_copies_are_compared_once(spark):
    base = np.random.default_rng(4).normal(size=(5, 8))
    n = 400
    df = vectors(spark, base[np.arange(n) % 5])
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)[np.arange(n) % 5][:, np.arange(n) % 5]
    got = {}
    found = retrieval.nearest(df, df, 3, others=True, block=16, digits=9)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: [j for j in np.lexsort((np.arange(n), -s[i])) if j != i][:3] for i in range(n)}
    assert shuffled(found) < 6 * n


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e")], [(f"n{i}", f"n{i * i % 31}") for i in range(31)]])
def test_louvain_by_numbers_is_louvain_by_names(spark, pairs):
    once = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    rows = [(a, b, p) for p in (1, None) for a, b in once]
    e = spark.createDataFrame(rows, "source_entity string, target_entity string, project_id long")
    for given, simple in ((e, True), (e.unionByName(e), False)):
        got = {(r["project_id"], r["node"]): r["community_id"] for r in graph.louvain(given, simple=simple).collect()}
        assert got == {(p, n): c for p in (1, None) for n, c in graph.louvain_one(pairs).items()}


def one_by_one(near, sweeps=50):
    """Louvain's moves, a node and a community at a time."""
    k = [float(len(x)) for x in near]
    com, total, m2 = list(range(len(near))), dict(enumerate(k)), sum(k)
    for _ in range(sweeps):
        before = list(com)
        for i, x in enumerate(near):
            count = Counter(com[j] for j in x.tolist())
            own = count[com[i]] / m2 - k[i] * (total[com[i]] - k[i]) / m2**2
            best, to = 1e-12, com[i]
            for c in sorted(count):
                gain = count[c] / m2 - k[i] * total[c] / m2**2 - own
                if c != com[i] and gain > best:
                    best, to = gain + 1e-12, c
            total[com[i]] -= k[i]
            total[to] += k[i]
            com[i] = to
        if com == before:
            break
    number = {}
    return [number.setdefault(c, len(number)) for c in com]


def blocks_of_friends(n, groups, seed, inside=0.5, outside=0.05):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, groups, n)
    tie = np.triu(rng.random((n, n)) < np.where(group[:, None] == group, inside, outside), 1)
    return [np.flatnonzero(r).astype(np.int32) for r in tie | tie.T]


@pytest.mark.parametrize(("run", "part"), [(64, 1 << 20), (7, 500), (1, 1)])
def test_nodes_that_are_looked_at_together_move_one_by_one(monkeypatch, run, part):
    monkeypatch.setattr(graph, "RUN", run)
    monkeypatch.setattr(graph, "PART", part)
    for near in (blocks_of_friends(160, 4, 1), blocks_of_friends(160, 12, 2, 0.3, 0.1), blocks_of_friends(90, 90, 3, 0.2, 0.2)):
        degree = np.array([len(x) for x in near])
        parts = graph._parts(degree)
        got = graph._settled(degree, lambda near=near, parts=parts: (np.concatenate(near[a:b]) for a, b in parts), 50)
        assert got.tolist() == one_by_one(near)


def test_louvain_holds_no_edges(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(graph, "PART", 1 << 12)
    near = blocks_of_friends(1500, 5, 4)
    edges = sum((near[i] < 700).sum() if i < 700 else (near[i] >= 700).sum() for i in range(1500))

    def batches():
        for a in range(0, 1500, 40):  # two projects meet in a batch
            p = [None if i < 700 else 7 for i in range(a, min(a + 40, 1500))]
            rows = [near[i][near[i] < 700] if i < 700 else near[i][near[i] >= 700] - 700 for i in range(a, a + len(p))]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(range(a, a + len(p)), pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["project_id", "at", "near"])

    tracemalloc.start()
    got = list(graph._moved_on_disk(50)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = pa.Table.from_batches(got).to_pylist()
    assert edges > 100_000 and peak < 4 * edges, (peak, edges)
    for p, a, b in ((None, 0, 700), (7, 700, 1500)):
        want = one_by_one([near[i][(near[i] >= a) & (near[i] < b)] - a for i in range(a, b)])
        assert [r["community_id"] for r in got if r["p"] == p] == want and [r["i"] for r in got if r["p"] == p] == list(range(b - a))


def test_edges_stay_where_they_are(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 3000}", 1) for i in range(3000)]
    e = spark.createDataFrame(ring, "source_entity string, target_entity string, project_id long")
    assert {r["node"]: r["depth"] for r in graph.reach(e, "n0", 2).collect()} == {"n0": 0, "n1": 1, "n2999": 1, "n2": 2, "n2998": 2}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sc = spark.sparkContext
        sc.setJobGroup("reach", "reach")
        graph.reach(e, "n0", 2)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        ids = {s for j in tracker.getJobIdsForGroup("reach") for s in tracker.getJobInfo(j).stageIds}
        assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in ids) < 300
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "distinct" not in str(graph.degrees(e, simple=True)._jdf.queryExecution().optimizedPlan()).lower()
    assert sorted({r["degree"] for r in graph.degrees(e, simple=True).collect()}) == [2]
    com = graph.degrees(e).selectExpr("node", "cast(substring(node, 2) as long) div 1500 AS community_id")
    assert graph.modularity(e, com, simple=True).first()[0] == pytest.approx(graph.modularity(e, com).first()[0])


def test_an_index_that_leaves_nothing_out_makes_no_pairs(spark, tmp_path):
    from tessera.operators.vector_index import VectorIndex

    df = vectors(spark, np.random.default_rng(6).normal(size=(600, 8)), 2)
    index = VectorIndex.build(df, str(tmp_path / "index"), carry=["p"])
    found = index.search(df, 3, probes=1 << 12, shortlist=1 << 30, where="p = 1", others=True)
    want = retrieval.nearest(df, df.where("p = 1"), 3, others=True)
    pick = lambda d: sorted((r["query_id"], r["id"], r["rank"]) for r in d.collect())
    assert pick(found) == pick(want)
    assert shuffled(found) < 20 * 600  # and not the 180,000 pairs


def test_products_are_made_in_steps():
    import tracemalloc

    from tessera.operators import vector_index

    rng = np.random.default_rng(7)
    x, c = rng.normal(size=(20_000, 16)).astype(np.float32), rng.normal(size=(1000, 16)).astype(np.float32)
    tracemalloc.start()
    got = vector_index.nearest_centre(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and (got[:50] == ((x[:50, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_parts_of_blocks_are_merged_together():
    import pandas as pd

    from tessera.operators import text_index as ti

    rng = np.random.default_rng(8)
    term, ids, places = rng.integers(0, 40, 4000), rng.integers(0, 300, 4000), rng.integers(0, 60, 4000)
    parts = [(0, t, *rest) for a in range(0, 4000, 500) for t, *rest in ti._packed(term[a : a + 500], ids[a : a + 500], places[a : a + 500], 128)]
    rows = pd.DataFrame(parts, columns=["bucket", "term", "block", "n", "most", "ids", "counts", "places"]).sort_values(["bucket", "term", "block"], ignore_index=True)
    got = list(ti._merged(rows, 128).itertuples(index=False, name=None))
    assert got == [(0, t, *rest) for t, *rest in ti._packed(term, ids, places, 128)]
    want = {}
    for t, i, p in zip(term.tolist(), ids.tolist(), places.tolist(), strict=True):
        want.setdefault((t, i // 128), {}).setdefault(i % 128, set()).add(p)
    for _, t, block, n, most, *packed in got:
        at, ends, where = ti.decode(*packed)
        held = {i: where[ends[k] : ends[k + 1]].tolist() for k, i in enumerate(at.tolist())}
        assert held == {i: sorted(p) for i, p in want[t, block].items()} and n == len(held) and most == max(map(len, held.values()))


def test_texts_of_a_tape_stay_where_they_are(spark):
    rng = np.random.default_rng(6)
    event = lambda kind, **x: {**dict.fromkeys(n.split(":")[0].strip() for n in evaluation.CASES.split("struct<")[1].split(">>")[0].replace("array<string", "").replace(">", "").split(",")), "kind": kind, **x}
    tape = [{"id": f"c{c}", "dataset": "d", "events": [event("remember_rule", content=rng.bytes(50_000).hex(), category="fact", label="a"), event("recall_rules", query="x y", expected_hits=["a"]), event("recall_rules", query="z", expected_hits=["a"])]} for c in range(8)]
    cases = spark.createDataFrame(tape, evaluation.CASES)
    sc = spark.sparkContext
    sc.setJobGroup("tape", "tape")
    run = evaluation.replay(cases, "2026-01-01 00:00:00")
    got = run.recalls.collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    ids = {s for j in tracker.getJobIdsForGroup("tape") for s in tracker.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    moved = [store.lastStageAttempt(s) for s in ids]
    assert sorted((r["seq"], list(r["returned"])) for r in got) == [(1, [0])] * 8 + [(2, [0])] * 8
    assert sum(s.shuffleWriteBytes() + s.outputBytes() + s.diskBytesSpilled() for s in moved) < 8 * 100_000 / 2

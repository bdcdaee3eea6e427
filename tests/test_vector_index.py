"""The vector index: recall against the exact way, pruned scans, filters, changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval, vector_index
from tessera.operators.vector_index import VectorIndex


def vectors(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return VectorIndex.build(vectors(spark, "sf0.01"), str(tmp_path_factory.mktemp("index") / "i"), carry=["label"])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_at_ten(spark, tmp_path, sf):
    rows = vectors(spark, sf)
    asked = rows.where("id % 50 = 0")
    found = VectorIndex.build(rows, str(tmp_path / "i")).search(asked, 10)
    got = vector_index.recall(found, retrieval.nearest(asked, rows, 10), 10).agg(F.sum("hits"), F.sum("k"), F.count("*")).first()
    assert got[2] == asked.count() and got[0] / got[1] >= 0.9


def test_scores_are_exact_and_ranked(spark, index):
    rows = {r["id"]: np.array(r["embedding"], dtype=float) for r in vectors(spark, "sf0.01").collect()}
    got = index.search(vectors(spark, "sf0.01").where("id in (3, 7)"), 4, others=True).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, r) for q in (3, 7) for r in (1, 2, 3, 4)]
    for r in got:
        a, b = rows[r["query_id"]], rows[r["id"]]
        assert r["query_id"] != r["id"] and r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)


def test_all_cells_and_a_long_shortlist_are_exact(spark, index):
    asked = vectors(spark, "sf0.01").where("id % 50 = 0")
    got = index.search(asked, 10, probes=10**6, shortlist=10**6)
    want = retrieval.nearest(asked, vectors(spark, "sf0.01"), 10)
    pick = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert pick(got) == pick(want)


def test_only_probed_cells_are_read(spark, index):
    asked = vectors(spark, "sf0.01").where("id = 5")
    cells = [r["cell"] for r in index.probed(asked, 3).select("cell").distinct().collect()]
    assert len(cells) == 3
    plan = index.search(asked, 5, probes=3)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line and "cell" in line]
    assert scans and all(all(str(c) in line.split("PartitionFilters")[1] for c in cells) for line in scans)
    files = index.rows().where(F.col("cell").isin(cells)).select(F.input_file_name()).distinct().collect()
    assert all(any(f"/cell={c}/" in r[0] for c in cells) for r in files)
    # ids and codes for all, vectors for the shortlist
    assert any("code" in line and "vector" not in line.split("ReadSchema")[1] for line in plan.splitlines() if "ReadSchema" in line and "code" in line)


def test_filters_inside_cells(spark, index):
    rows = vectors(spark, "sf0.01")
    asked = rows.where("id < 4")
    got = index.search(asked, 6, probes=10**6, shortlist=10**6, where="label % 3 = 1")
    want = retrieval.nearest(asked, rows.where("label % 3 = 1"), 6)
    pick = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert pick(got) == pick(want) and got.count() == 24


def test_changes(spark, tmp_path):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 8))
    df = lambda rows: spark.createDataFrame([(int(i), v if v is None else [float(x) for x in v]) for i, v in rows], "id long, embedding array<float>")
    index = VectorIndex.build(df(enumerate(base)), str(tmp_path / "i"), cells=6)
    probe = df([(-1, base[17])])
    best = lambda ix: [r["id"] for r in sorted(ix.search(probe, 2, probes=6).collect(), key=lambda r: r["rank"])]
    assert best(index)[0] == 17
    index.remove(df([(17, None)]))
    assert 17 not in best(index)
    index.upsert(df([(17, base[17]), (900, base[17] * 2), (18, None)]))
    assert best(VectorIndex(spark, str(tmp_path / "i"))) == [17, 900]
    index.upsert(df([(17, -base[17])]))
    assert best(index)[0] == 900 and index.rows().count() == 300
    small = index.compact(str(tmp_path / "c"))
    assert best(small) == best(index) and small.rows().count() == 300 and {r["batch"] for r in small.rows().collect()} == {0}
    assert small.search(df([(5, base[5])]), 1, probes=6).first()["id"] == 5


def test_awkward_vectors(spark, tmp_path):
    kind = "id long, embedding array<float>, code string"
    rows = spark.createDataFrame([(1, None, "x"), (2, [0.0] * 4, "x"), (3, [1.0, 0.0, 0.0, 0.0], "x"), (4, [1.0, 0.0, 0.0, 0.0], "y"), (4, [1.0, 0.0, 0.0, 0.0], "y")], kind)
    index = VectorIndex.build(rows, str(tmp_path / "i"))
    got = index.search(rows.where("id = 3"), 9, probes=9).collect()
    assert sorted((r["id"], r["score"]) for r in got) == [(2, 0.0), (3, 1.0), (4, 1.0), (4, 1.0)]
    assert index.search(rows.where("id = 2"), 2, probes=9).count() == 2 and index.search(rows.where("id = 1"), 2).count() == 0
    empty = VectorIndex.build(rows.limit(0), str(tmp_path / "e"))
    assert empty.search(rows, 3).count() == 0

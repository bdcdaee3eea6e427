"""The inverted index: ids and order equal to the scan of all texts, pruned files, skipped blocks, changes."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.english import cover_density
from tessera.operators import retrieval, text_index
from tessera.operators.text_index import TextIndex

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@pytest.fixture(scope="module")
def common(docs):
    """Words from frequent to rare."""
    from collections import Counter

    count = Counter(w for r in docs.collect() for w in set(text_index.plain_words(r["content"])))
    words = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    return [words[0], words[5], words[60], words[400]]


@given(st.dictionaries(st.integers(0, text_index.SPAN - 1), st.sets(st.integers(0, 10**6), min_size=1, max_size=5), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(found):
    ids = sorted(found)
    at, ends, places = text_index.decode(*text_index.encode(np.array(ids), [np.array(sorted(found[i])) for i in ids]))
    assert at.tolist() == ids and [places[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [sorted(found[i]) for i in ids]


@pytest.fixture(scope="module", params=[False, True])
def index(request, docs, tmp_path_factory):
    patch = pytest.MonkeyPatch()
    patch.setattr(text_index, "SPAN", 16)  # many blocks
    yield TextIndex.build(docs, str(tmp_path_factory.mktemp("text") / "i"), english=request.param)
    patch.undo()


def scanned(docs, query, english):
    got, order = retrieval.said_order(docs, query, english)
    return {r["id"]: r["n"] for r in got.select("id", (-order).cast("double").alias("n")).collect()}


def test_matches_are_those_of_the_scan(docs, index, common):
    for query in (common[0], f"{common[0]} {common[2]}", " ".join(common), f"{common[3]} {common[3].upper()}!"):
        want = scanned(docs, query, index.english)
        got = {r["id"]: r["rank"] for r in index.matches(query).collect()}
        assert got == pytest.approx(want) and len(want) > 0
    assert index.matches("").count() == index.matches("qqqqqq zzzzzz").count() == index.matches(f"{common[0]} qqqqqq").count() == 0


@pytest.mark.parametrize("first", [1, 3, 1000])
def test_top_skips_blocks_and_loses_nothing(docs, index, common, first, monkeypatch):
    monkeypatch.setattr(text_index, "FIRST", first)
    for query in (common[0], f"{common[1]} {common[2]}"):
        want = sorted(scanned(docs, query, index.english).items(), key=lambda x: (-round(x[1], 9), x[0]))[:7]
        got = index.top(query, 7).collect()
        assert [r["id"] for r in got] == [i for i, _ in want]


def test_bounds_hold(docs, index, common):
    terms = index.terms(f"{common[0]} {common[1]}")
    bound = {r["block"]: r["bound"] for r in index._heads(index.postings(terms), terms).collect()}
    for i, rank in scanned(docs, f"{common[0]} {common[1]}", index.english).items():
        assert bound[i // text_index.SPAN] >= rank - 1e-9


def test_other_terms_stay_unread(index, common):
    terms = index.terms(common[3])
    df = index.postings(terms)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket") or "PartitionFilters" in plan
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1]
    files = {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    bucket = index.spark.createDataFrame([(t,) for t in terms], "term string").select(text_index._bucket(F.col("term"))).first()[0]
    assert files and all(f"/bucket={bucket}/" in f for f in files)
    heads = index._heads(df, terms)._jdf.queryExecution().executedPlan().toString()
    assert "places" not in heads.split("ReadSchema")[1].splitlines()[0]


def test_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "SPAN", 4)
    df = lambda *rows: spark.createDataFrame(list(rows), "id long, content string")
    first = [(i, f"alpha {'beta ' * (i % 3)}w{i}") for i in range(20)] + [(None, "alpha"), (50, None)]
    index = TextIndex.build(df(*first), str(tmp_path / "i"))
    ids = lambda q: sorted(r["id"] for r in index.matches(q).collect())
    assert ids("alpha") == list(range(20)) and ids("beta") == [i for i in range(20) if i % 3]
    index.update(df((1, "gamma"), (2, None), (30, "alpha beta beta beta beta"), (3, "beta")))
    assert ids("alpha") == [0, *range(4, 20), 30] and ids("gamma") == [1] and 3 in ids("beta") and 2 not in ids("beta")
    index.update(df((1, "alpha again"), (30, "nothing")))
    assert ids("alpha") == [0, 1, *range(4, 20)] and ids("gamma") == []
    again = TextIndex(spark, str(tmp_path / "i"))
    assert [r["id"] for r in again.top("beta", 2).collect()] == [5, 8]
    empty = TextIndex.build(df(), str(tmp_path / "e"), english=True)
    assert empty.matches("alpha").count() == 0 and empty.top("alpha", 3).count() == 0


def test_rank_by_positions_is_the_texts(spark, tmp_path):
    texts = ["the running dogs ran over a lazy dog", "dog dog run", "runs; the dog's run", "nothing", "dog and then a very long way to run"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {r["id"]: r["rank"] for r in TextIndex.build(df, str(tmp_path / "i"), english=True).matches("dogs running").collect()}
    want = {r["id"]: r["d"] for r in df.select("id", cover_density("content", "dogs running").alias("d")).where("d is not null").collect()}
    assert got == pytest.approx(want) and len(got) == 4

"""The pipeline against a brute-force version of each stage's decision."""

import re
from collections import Counter

import corpus_pipeline
from tessera.llm import packing, quality, toxicity
from tests.llm.test_operators import classes_slow, hits_slow

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SF)
        if name == "packing":
            tok = packing.WordTokenizer(packing._default_tokenizer()).tok
            want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before}
            got = Counter()
            for r in out.collect():
                got[r["doc_id"]] += r["length"]
            assert got == want
            break
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / str(k))).collect()}
        if name == "quality":
            want = {r["doc_id"] for r in quality.score(docs, quality.train(docs, labels)).where("predicted = 1").collect()}
        elif name == "toxicity":
            want = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            want = {int(d) for d, c, _ in classes_slow(before) if d == c}
        else:
            want = {i for i, t in before if hits_slow(t, items)[1] == 0} if len(before) < 60 else fast_clean(before, items)
        assert after == want, name
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_leave_columns_alone(spark):
    """Columns named like what the operators make come out as they went in."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "n_words", "n_hit", "items", "spans", "contaminated", "label", "key", "bands", "__runs"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in names)
    clash = docs.withColumns({"sequence_id": F.lit("x"), "offset": F.lit("y"), "piece": F.lit("z")})
    packed = corpus_pipeline.STAGES[-1][1](spark, clash, SF)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() >= docs.count()


def fast_clean(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    wins = set()
    for _, t in items:
        w = word.findall(low(t))
        wins |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in wins}
    out = set()
    for i, t in texts:
        w = word.findall(low(t))
        if not any(tuple(w[k : k + s]) in wins for s in sizes for k in range(len(w) - s + 1)):
            out.add(i)
    return out

"""The ten operators against brute force, round trips and held-out labels, on small tables with awkward rows."""

import hashlib
import io
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontamination, feistel, fingerprints, maxent, ngram_join, packing, quality, rollup, toxicity, warc
from tessera.llm.common import append_columns, fresh_path, hash_words, split_words, translated, WORDS

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row_number int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(texts):
    """Documents with extra columns whose names clash with results."""
    return [(i, t, "en", "src0", len(t or ""), "x", 7) for i, t in texts]


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [(0, None), (1, ""), (2, "   \n\t"), (3, "one"), (4, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k"), (None, "no id"), (8, LONG), (9, "ÀÉ ñ ü ß 日本語 \x00 é"), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(rows(AWKWARD), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- helpers


def test_split_words_is_python_split():
    texts = ["", " a  b ", "x", "\ta\nb\x0bc\x0cd ", "é ü"]
    first, codes, words = split_words(translated(pa.array(texts), bytes(range(256))))
    words = words.to_pylist()
    assert [[words[c] for c in codes[a:b]] for a, b in itertools.pairwise(first)] == [[w.decode() for w in t.encode().split()] for t in texts]


@given(st.lists(st.text(max_size=12), max_size=30, unique=True), st.integers(0, 3))
@settings(max_examples=100, deadline=None)
def test_word_hashes_depend_on_the_word_alone(words, k):
    got = hash_words(pa.array(words, pa.string()).slice(k))
    assert len(set(got.tolist())) == len(got) and got.tolist() == [int(hash_words(pa.array([w]))[0]) for w in words[k:]]


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_translated_on_slices(texts, k):
    got = translated(pa.array(texts, pa.string()).slice(k), WORDS)
    assert got.to_pylist() == ["".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t or "") for t in texts[k:]]


def test_append_replaces_clashing_columns(spark, awkward):
    from pyspark.sql import types as T

    got = append_columns(awkward, ["text"], [T.StructField("Score", T.LongType())], lambda: lambda t: [[len(x or "") for x in t.to_pylist()]])
    assert [c.lower() for c in got.columns].count("score") == 1 and got.count() == len(AWKWARD)


# -- 1


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 300
    pages = [(3, "http://a/ü b\r\nX: y", big), (1, None, big), (2, "u", None), (4, "u", ""), (5, "u", "s"), (6, "u", "s"), (7, "http://z", "é" * 5000), (None, "n", big), (8, "u", "é" * 5000)]
    df = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, payload string, digest int")
    manifest, where = warc.archive_pages(df)
    got = {(r["record_id"], r["payload_digest"]): r for r in warc.read_warc(manifest, where).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        body = (html or "").encode()
        r = got[f"urn:page:{'null' if i is None else i}", hashlib.sha256(body).hexdigest()]
        assert r["payload_bytes"] == len(body)
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        first = i == min(same) or len(body) < 100
        assert r["record_type"] == ("response" if first else "revisit") and (r["payload"] == body if first else r["payload"] is None)
        assert r["refers_to"] == (None if first else f"urn:page:{min(same)}")
    empty, where = warc.archive_pages(df.limit(0))
    assert warc.read_warc(empty, where).count() == 0


def test_warc_with_groups_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i, "u", "x" * 120 if i % 3 else "y") for i in range(30)], "page_id long, url string, html string")
    got = [r["record_type"] for r in warc.read_warc(*warc.archive_pages(df)).collect()]
    assert len(got) == 30 and got.count("revisit") == 19


def test_warc_archive_bytes():
    dictionary = warc.train_dictionary([(f"<html><p>page {i} common text of all pages</p>" * 20).encode() for i in range(200)], 2048)
    assert dictionary
    for known in (dictionary, b""):
        out = io.BytesIO()
        pack = warc.begin(out, known)
        records = [warc.record(f"urn:page:{i}", "http://x", b"p" * i) for i in range(50)]
        for r in records:
            out.write(pack.compress(r))
        assert list(warc.frames(io.BytesIO(out.getvalue()))) == records
        assert (out.getvalue()[:4] == b"\x5d\x2a\x4d\x18") == bool(known)
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(out.getvalue()[:-3])))
    assert list(warc.frames(io.BytesIO(b""))) == []


@pytest.mark.parametrize("broken", [lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), lambda r: r + b"x", lambda r: r[:-1], lambda r: r.replace(b"WARC-Record-ID", b"WARC-Other-ID"), lambda r: r.replace(b"payload", b"paxload"), lambda r: re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: no\r\n\r\nHTTP", r)])
def test_warc_validation(broken):
    good = warc.record("urn:page:1", "u", b"the payload")
    assert warc.parse(good)["payload"] == b"the payload"
    with pytest.raises(warc.WarcError):
        warc.parse(broken(good))


# -- 2 and 9


def labelled(spark, n=1200):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(300)]
    out, labels = [], []
    for i in range(n):
        words = list(rng.choice(base, 60))
        bad = i % 5 == 0
        if bad:
            words[rng.integers(60)] = "vileword"
        low = i % 3 == 0
        text = " ".join(w.upper() + "!!" if low else w for w in words)
        out.append((i, text, "en", "s", len(text), "x", 1))
        labels.append((i, int(not low), int(bad)))
    return spark.createDataFrame(out, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_hold_out(spark, awkward, none, module, label):
    docs, labels = labelled(spark)
    model = module.train(docs, labels)
    got = module.score(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).toPandas()
    assert (got["predicted"] == got[label]).mean() > 0.97
    scored = module.score(awkward, model).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if not (r["text"] or "").strip()}) == 1
    assert module.score(none, model).count() == 0
    one = module.train(docs.limit(0), labels)  # nothing to learn from
    assert module.score(awkward, one).count() == len(AWKWARD)


def test_classifier_sample_is_bounded_after_the_join(spark):
    docs = spark.createDataFrame([(1, f"text {i % 90}") for i in range(300)] + [(i, "other") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(-500, 60)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", rows=50).collect()
    assert 20 < len(got) <= 50 and len({(r["id"], r["text"]) for r in got}) == len(got)
    few = toxicity.labelled_sample(docs.where("doc_id > 1"), labels, "toxic", rows=50).collect()
    assert {r["id"] for r in few} == {i for i in range(2, 40) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert toxicity.train(docs, labels, rows=50, most=40).bits == toxicity.BITS


def test_toxicity_score_by_hand(spark):
    """The score is the logistic of the bias and the weights of the text's distinct features, one at a time."""
    docs, labels = labelled(spark, 600)
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.index.tolist(), model.weight.astype(float).tolist(), strict=True))
    h = lambda w, seed=0: hash_words(pa.array([w]), seed)
    for r in toxicity.score(docs, model).limit(40).collect():
        w, found = lower(r["text"]).split(), set()
        w = [re.sub("[^a-z0-9]", "", x) for x in w]
        for i in range(len(w)):
            found.add(int(toxicity.mix(h(w[i]) * toxicity._MUL[0])[0]) >> (64 - model.bits))
            found |= {int(toxicity.mix(h(w[i][:n], n) * toxicity._MUL[0])[0]) >> (64 - model.bits) for n in toxicity.STEMS if len(w[i]) > n}
            for gap in (1, 2):
                if i >= gap:
                    found.add(int(toxicity.mix(h(w[i - gap]) * toxicity._MUL[gap] + h(w[i]) * toxicity._MUL[3] + np.uint64(gap))[0]) >> (64 - model.bits))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(weight.get(f, 0.0) for f in found)))), abs=1e-5)


def quality_tokens(text):
    """The tokens of a text, one word at a time."""
    out, before = [], None
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        for piece in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+", w):
            out += [quality.CAPITALS] * (len(piece) > 1 and piece.isupper()) + [piece.lower()]
        out += [quality.AGAIN] * (w.lower() == before)
        before = w.lower()
    return out


def test_quality_tokens_keep_case_signs_and_repeats():
    assert quality_tokens("Buy buy NOW!!! é-É A don't") == ["buy", "buy", quality.AGAIN, quality.CAPITALS, "now", "!!!", "é", "-", "é", "a", "don", "'", "t"]
    texts = [None, "", "Buy buy NOW!!! é-É A don't", " \t", "x", "X x\x0bx y", "$$ $$ $$"]
    first, got = quality.token_rows(pa.array(texts))
    assert [got[a:b].tolist() for a, b in itertools.pairwise(first)] == [[int(quality._rows_of([t])[0]) for t in quality_tokens(x)] for x in texts]


def test_quality_vectors_and_score_by_hand(spark):
    """Word vectors from neighbours, one token at a time, and the network on the pooled text."""
    docs, labels = labelled(spark, 90)
    texts = [r["text"] for r in docs.collect()]
    where, sign = quality.index_vectors()
    want = np.zeros((quality.ROWS, quality.DIM))
    rows_of = lambda t: [int(quality._rows_of([x])[0]) for x in quality_tokens(t)]
    for t in texts:
        rows_ = rows_of(t)
        for i in range(len(rows_)):
            for j in range(max(0, i - quality.WINDOW), min(len(rows_), i + quality.WINDOW + 1)):
                if j != i:
                    np.add.at(want[rows_[i]], where[rows_[j]], sign[rows_[j]])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    vectors, net = quality.train(docs, labels)
    assert np.abs(vectors - want).max() < 1e-6
    for r in quality.score(docs, (vectors, net)).limit(20).collect():
        x = np.zeros(2 * quality.DIM)
        rows_ = rows_of(r["text"])
        for row in rows_:
            x[: quality.DIM] += vectors[row] / len(rows_)
            np.add.at(x[quality.DIM :], where[row], sign[row] / len(rows_))
        logit = float(np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1) @ net.w2 + net.b2)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit / net.temperature)), abs=1e-4)


def area(got, label):
    """The share of pairs of a row of each kind whose scores stand in the right order."""
    ranks = got["score"].rank()
    n = int((got[label] == 1).sum())
    return (ranks[got[label] == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n))


def test_quality_comes_through_its_vectors(spark):
    """Context vectors alone tell the held-out rows apart, and nothing is left where all words share one vector."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    vectors, net = quality.train(docs, labels)
    held = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = lambda v, n: quality.score(held, (v, n)).toPandas()
    assert area(got(vectors, net), "quality") > 0.95
    context_alone = quality.Network(net.mean, net.scale, net.w1.copy(), net.b1, net.w2, net.b2, net.temperature)
    context_alone.w1[quality.DIM :] = 0
    assert area(got(vectors, context_alone), "quality") > 0.9
    same = np.repeat(vectors.mean(axis=0, keepdims=True), quality.ROWS, axis=0).astype(np.float32)
    assert area(got(same, context_alone), "quality") < 0.7
    mixed = vectors[np.random.default_rng(0).permutation(quality.ROWS)]
    assert area(got(mixed, context_alone), "quality") < 0.9


def test_toxicity_features_are_the_stated_ones():
    (got,) = toxicity.distinct_features(pa.array(["a b c a b"]))
    assert len(got) == 3 + 3 + 3  # words; ab bc ca; a.c b.a c.b
    assert [len(x) for x in toxicity.distinct_features(pa.array(["x y", None, "y"]))] == [3, 0, 1]
    assert [len(x) for x in toxicity.distinct_features(pa.array(["abcde", "éééé", "ééééé abcde", "abcdefghi"]))] == [2, 1, 5, 4]
    shared = [set(x.tolist()) for x in toxicity.distinct_features(pa.array(["nations", "national", "nation"]))]
    assert len(shared[0] & shared[1]) == 2 and len(shared[0] & shared[2]) == 1


def test_toxicity_held_out(spark):
    """Most toxic rows outside the training folds are found, and hardly any other is."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = toxicity.score(held, toxicity.train(docs, labels)).toPandas()
    assert got["predicted"][got["toxic"] == 1].mean() >= 0.8 and got["predicted"][got["toxic"] == 0].mean() <= 0.003


def test_ftrl_is_sparse():
    f = toxicity.Ftrl(bits=10, alpha=0.15, l1=1.5, l2=1.0)
    rng = np.random.default_rng(1)
    for _ in range(400):
        y = int(rng.random() < 0.5)
        f.learn(np.unique(np.append(rng.integers(10, 1000, 20), 5 if y else 6)), y)
    s = f.sparse()
    w = dict(zip(s.index, s.weight, strict=True))
    assert w[5] > 0.5 > -0.5 > w[6] and len(w) < 300


# -- 3


def test_rollup(spark, tmp_path):
    kept = rollup.TokenRollup(spark, str(tmp_path / "r"))
    cols = "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long"
    df = lambda *r: spark.createDataFrame(list(r), cols)
    first = df(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None), ("insert", "b", "en", "v2", 7, None))
    assert kept.totals().count() == 0
    assert kept.commit("1", first) and not kept.commit("1", first)
    assert kept.commit("2", df(("revise", "a", "en", "v1", 8, 10), ("delete", "b", "en", "v2", 7, None)))
    assert kept.commit("3", df())
    got = {(r["source"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in rollup.TokenRollup(spark, str(tmp_path / "r")).totals().collect()}
    assert got == {("a", "v1"): (2, 13), (None, "v1"): (1, 0)}
    again = rollup.TokenRollup(spark, str(tmp_path / "r"))
    assert again.compact(grace=0) and again.committed() == ["1", "2", "3"] and not again.commit("2", first)
    assert {(r["source"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in again.totals().collect()} == got
    assert again.commit("2b", df(("insert", "a", "en", "v1", 1, None))) and again.compact(grace=0) and again.committed() == ["1", "2", "2b", "3"]
    assert {r["source"]: r["n_tokens"] for r in again.totals().collect()} == {"a": 14, None: 0} and again._names("batch=") == [] and len(again._names("base=")) == 1
    with pytest.raises(Exception, match="unknown op"):
        kept.commit("4", df(("upsert", "a", "en", "v1", 1, None)))
    assert kept.committed() == ["1", "2", "2b", "3"]


def test_rollup_readers_outlive_a_compaction(spark, tmp_path):
    kept = rollup.TokenRollup(spark, str(tmp_path / "r"))
    df = lambda n: spark.createDataFrame([("insert", "a", "en", "v", n, None)], "op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long")
    kept.commit("1", df(1))
    kept.commit("2", df(2))
    read = lambda t: [(r["n_docs"], r["n_tokens"]) for r in t.collect()]
    before = kept.totals()
    assert kept.compact() and read(before) == [(2, 3)] == read(kept.totals())
    assert kept._names("batch=") == ["1", "2"] and not kept.commit("1", df(1))
    kept.commit("3", df(4))
    later = kept.totals()  # reads the base and batch 3
    assert kept.compact() and read(later) == [(3, 7)] == read(kept.totals()) and len(kept._names("base=")) == 2
    # a compaction between a reader's listing and its reading loses no batch
    slow = rollup.TokenRollup(spark, str(tmp_path / "r"))
    listed = slow._listed()
    kept.commit("4", df(8))
    kept.compact()
    slow._listed = lambda: listed
    assert read(slow.totals()) == [(3, 7)] and read(kept.totals()) == [(4, 15)]
    kept.clean(grace=0)
    assert kept._names("batch=") == [] and len(kept._names("base=")) == 1 and read(kept.totals()) == [(4, 15)] and kept.committed() == ["1", "2", "3", "4"]


def test_rollup_query_counts_all(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.queries import op3_token_rollup

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r["text"]:
            want[r["source"], r["lang"], "word_bpe_49k/1"] += len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
            want[r["source"], r["lang"], "white_space/1"] += len(r["text"].split())
    assert {(r["source"], r["lang"], r["tokenizer_version"]): r["n_tokens"] for r in op3_token_rollup(spark, SF).collect()} == want


# -- 4


def test_lm_base_scores_and_gain(spark, docs, awkward, none):
    small = docs.limit(150).unionByName(awkward.select(docs.columns)).where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in maxent.score_texts(small, lookup=2000).collect()}  # most words are beyond the lookup
    tok = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"])), "\0end"] for r in small.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    c = Counter(w for i, ws in tok.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert got.keys() == tok.keys()
    for i, ws in tok.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert r["score"] < 0
    assert maxent.score_texts(none).count() == 0


def lm_inner(voc, w, f, hashes):
    """The probability of each word's leaf given the contexts f, one a word."""
    rank, _ = voc.look(hashes)
    tokens, at, bias, branch = voc.decisions(f, voc.leaves(hashes, rank), len(w))
    return np.exp(np.bincount(tokens, weights=np.log(maxent._probability(w, at, bias)[np.arange(len(branch)), branch]), minlength=len(hashes)))


@pytest.mark.parametrize("buckets", [1, 4])
def test_lm_probabilities_sum_to_one_and_depend_on_context(buckets):
    hashes = maxent.mix(np.arange(1, 3001, dtype=np.uint64))
    counts = np.sort(np.random.default_rng(0).integers(1, 50, 3000))[::-1]
    bucket = (hashes[2500:] & np.uint64(buckets - 1)).astype(int)
    tail = np.bincount(bucket, weights=counts[2500:] + 1.0, minlength=buckets) + 1
    voc = maxent.Vocabulary.of(hashes[:2500], counts[:2500], int(counts.sum()), 3000, tail)
    rows = 2 * maxent.ROWS
    w = np.random.default_rng(1).normal(0, 0.1, (rows, maxent.WIDTH)).astype(np.float32)
    given_context = []
    for word in (5, 6):
        f = np.repeat(maxent.contexts(np.array([0, 2]), np.array([word, 7], dtype=np.uint64))[1:], 3000, axis=0)
        inner = lm_inner(voc, w, f, hashes)
        share = inner.copy()
        share[2500:] *= (counts[2500:] + 1) / tail[bucket]
        unknown = sum(inner[2500:][bucket == b][0] / tail[b] for b in range(buckets))  # a slot of each bucket
        assert share.sum() + unknown == pytest.approx(1, abs=1e-4)
        given_context.append(inner)
    assert (np.abs(np.log(given_context[0] / given_context[1])) > 1e-6).all()


def test_lm_score_is_the_stated_product(spark):
    """score against a slow version: for each token the softmaxes from the root down to its leaf, one at a time."""
    texts = [(i, " ".join(f"v{(i * k * 7 + k) % 23}" for k in range(i % 40))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {}
    real = maxent.train_weights
    try:
        maxent.train_weights = lambda docs, voc, *a: kept.setdefault("w", (voc, real(docs, voc, *a)))[1]
        got = {r["doc_id"]: r["score"] for r in maxent.score_texts(docs, lookup=12).collect()}
    finally:
        maxent.train_weights = real
    voc, w = kept["w"]
    learned = Counter(t for i, x in texts if zlib.crc32(str(i).encode()) % 7 != 2 for t in [*x.split(), None])
    h = lambda t: maxent.END if t is None else hash_words(pa.array([t]))[0]
    for i, x in texts:
        tokens, total = [*x.split(), None], 0.0
        f = maxent.contexts(np.array([0, len(tokens)]), np.array([h(t) for t in tokens], dtype=np.uint64))
        for k, t in enumerate(tokens):
            at = np.flatnonzero(voc.hashes == h(t))
            bucket = int(h(t)) & (len(voc.tail) - 1)
            leaf = int(voc.ranks[at[0]]) if len(at) else len(voc.hashes) + bucket
            if not len(at):
                total += np.log10((learned[t] + 1) / voc.tail[bucket])
            node, branch = int(voc.leaf_node[leaf]), int(voc.leaf_branch[leaf])
            while node >= 0:
                z = voc.node_bias[node].astype(float) + sum(w[int(maxent.mix(np.array([(int(x) + (node + 1) * int(maxent._MUL[5])) % 2**64], dtype=np.uint64))[0]) % len(w)].astype(float) for x in f[k])
                total += (z[branch] - np.logaddexp.reduce(z)) / np.log(10)
                node, branch = int(voc.parent[node]), int(voc.parent_branch[node])
        assert got[i] == pytest.approx(total, abs=1e-3)


def test_lm_beats_the_unigram_on_held_out_texts(spark):
    rows_ = maxent.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert rows_[0] / rows_[2] > rows_[1] / rows_[2] + 0.1


def test_lm_frequent_fills_up_to_its_bound(spark):
    counts = spark.createDataFrame([(i, 1 + (i < 10)) for i in range(5000)], "h long, c long")
    got = [r["h"] for r in maxent.frequent(counts, 1000).collect()]
    assert set(range(10)) <= set(got) and 900 < len(got) <= 1000 and sorted(got) == sorted(r["h"] for r in maxent.frequent(counts.repartition(3), 1000).collect())
    assert maxent.frequent(counts, 5000).count() == 5000 and maxent.frequent(counts.limit(0), 10).count() == 0


def test_lm_weights_grow_with_the_vocabulary(spark):
    voc = maxent.Vocabulary.of(np.arange(1, 4, dtype=np.uint64), np.array([3, 2, 1]), 6, 500_000)
    one = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    assert maxent.train_weights(one, voc, rounds=1).shape == (1 << 18, maxent.WIDTH)


# -- 5


@pytest.fixture(scope="module")
def real_tokenizer():
    return packing.WordTokenizer(packing._default_tokenizer(), most=50)


@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAéÀß '’.,!<|>x09\t\n\x1ć")), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_word_tokenizer_is_exact(real_tokenizer, texts):
    first, flat = real_tokenizer.ids(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert flat[a:b].tolist() == real_tokenizer.tok.encode(t, add_special_tokens=False).ids


def test_word_tokenizer_keeps_parts_from_batch_to_batch():
    """A batch has more than 131,072 different words: those of the one before are known all the same."""

    class Counted:
        def __init__(self, own):
            self.own, self.calls = own, 0

        def __getattr__(self, name):
            got = getattr(self.own, name)
            if name == "model":
                got = Counted(got)
                got.tokenize = self.count(got.own.tokenize)
            return self.count(got) if name == "encode" else got

        def count(self, f):
            def run(*args, **kw):
                self.calls += 1
                return f(*args, **kw)

            return run

    tok = packing.WordTokenizer(packing._default_tokenizer())
    tok.tok = Counted(tok.tok)
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghijklmnopqrst", repeat=4), 140_000)]
    first, flat = tok.ids(pa.array([" ".join(words)]))
    assert tok.tok.calls >= len(words)
    tok.tok.calls = 0
    again, same = tok.ids(pa.array([" ".join(w.upper() + "," for w in words), " ".join(words)]))
    assert tok.tok.calls <= 1 and same[again[1] :].tolist() == flat.tolist() and again[1] == len(flat) + len(words)


@given(st.lists(st.integers(1, 100), max_size=120))
@settings(max_examples=150, deadline=None)
def test_pack_lengths(lengths):
    first = packing.best_fit(lengths, 100)
    bins = packing.improve(first, lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(0 < sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(first)


def test_local_search_empties_bins():
    lengths = [6, 5, 5, 4, 4, 3, 3, 2, 2, 2, 2, 2]  # 40 in four bins of 10
    assert len(packing.improve([[0, 5], [1, 3], [2, 4], [6, 7, 8, 9], [10, 11]], lengths, 10)) == 4
    one = packing.improve([[0, 1], [2, 3], [4]], [7, 2, 6, 3, 2], 10)  # 9 and 9 and 2: one for one, then a move
    assert len(one) == 2


def test_local_search_goes_on_until_nothing_changes():
    assert len(packing.pack_lengths([38, 25, 32, 52, 24, 22], 100)) == 2


def test_packing_tables(spark, awkward, none, real_tokenizer):
    got = packing.pack(packing.token_pieces(awkward), group=4).toPandas()
    want = Counter()
    for i, t in AWKWARD:
        want[i] += len(real_tokenizer.tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert got.assign(doc_id=got["doc_id"].map(lambda x: None if x != x else int(x))).groupby("doc_id", dropna=False)["length"].sum().to_dict().get(8) == want[8]
    assert got["length"].sum() == sum(want.values()) and (got["ids"].map(len) == 4 * got["length"]).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == np.concatenate([[0], s["length"].cumsum()[:-1]]).tolist() and s["length"].sum() <= 2048
    assert packing.pack(packing.token_pieces(none)).count() == 0


@given(st.lists(st.integers(1, 10), max_size=7))
@settings(max_examples=80, deadline=None)
def test_pack_lengths_against_the_optimum(lengths):
    """Small cases against all partitions: never more than one bin beyond the fewest."""

    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        n, out = rest[0], fewest(rest[1:], (*rooms, 10 - rest[0]))
        for k, r in enumerate(rooms):
            if r >= n:
                out = min(out, fewest(rest[1:], (*rooms[:k], r - n, *rooms[k + 1 :])))
        return out

    assert fewest(sorted(lengths, reverse=True), ()) <= len(packing.pack_lengths(lengths, 10)) <= fewest(sorted(lengths, reverse=True), ()) + 1


def test_packing_query_ids_by_hand(spark):
    from tokenizers import Tokenizer

    from tessera.llm.queries import op5_bestfit_packing

    tok = Tokenizer.from_file(packing._default_tokenizer())
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    got = op5_bestfit_packing(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(w[3] for w in want) // 2048) + 1  # none has fewer than the total needs


def test_packing_deals_repeated_ids_to_all_groups(spark):
    pieces = spark.createDataFrame([(None, 0, 0, 1 + i % 7, 5, "x") for i in range(900)], "doc_id long, piece int, start long, length long, offset int, sequence_id string")
    pieces.write.parquet(path := fresh_path(spark, "pieces"))
    got = packing.pack(spark.read.parquet(path), group=100).collect()
    assert len({r["sequence_id"] >> 32 for r in got}) == 9 and sum(r["length"] for r in got) == sum(1 + i % 7 for i in range(900))


# -- 6


@given(st.integers(1, 3000), st.integers(0, 2**60))
@settings(max_examples=60, deadline=None)
def test_feistel_is_a_permutation(n, key):
    assert sorted(feistel.permute(np.arange(n), n, key)) == list(range(n))
    assert feistel.permute(np.array([n - 1]), n, key)[0] == feistel.permute(np.arange(n), n, key)[-1]


def test_sharding(spark, awkward, none):
    got = feistel.shard(awkward, 3).toPandas()
    assert sorted(got["place"]) == list(range(len(AWKWARD))) and sorted(got["row_number"]) == list(range(len(AWKWARD)))
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 8 for _, t in AWKWARD)
    again = feistel.shard(awkward.repartition(7), 3).toPandas()
    key = ["size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    assert feistel.shard(none).count() == 0


def test_sharding_columns_by_hand(spark):
    from tessera.llm.queries import op6_feistel_sharding

    want = {r["doc_id"]: ((r["text"] or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op6_feistel_sharding(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(want) and len(got) == len(want)
    order = {d: k for k, d in enumerate(sorted(want))}
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(want[r["doc_id"]]) + 8, zlib.crc32(want[r["doc_id"]]), "rows", None)
        place = int(feistel.permute(np.array([order[r["doc_id"]]]), len(want), 20240229)[0])
        assert (r["shard"], r["slot"]) == (place % 24, place // 24)


# -- 7


def gear_slow(data):
    out, h = [], 0
    for b in data:
        h = (h << 1) + int(fingerprints._GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    return out


@given(st.binary(max_size=300))
@settings(max_examples=80, deadline=None)
def test_chunks(data):
    assert fingerprints.gear(np.frombuffer(data, dtype=np.uint8)).tolist() == gear_slow(data)
    cut = fingerprints.chunks(data)
    assert b"".join(data[a:b] for a, b in cut) == data
    h = gear_slow(data)
    begin = 0
    for a, b in cut:
        assert a == begin and b - a <= fingerprints.MOST
        end = next((k + 1 for k in range(a + fingerprints.LEAST - 1, len(data)) if h[k] >> (32 - (fingerprints.STRICT if k + 1 - a < fingerprints.NORMAL else fingerprints.LOOSE)) == 0), len(data))
        assert b == (min(end, a + fingerprints.MOST, len(data)) if len(data) - a > fingerprints.LEAST else len(data))
        begin = b


def test_chunks_resist_shifts():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(500))
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint("some words before " + text)
    assert fingerprints.containment(a, b) > 0.95 and fingerprints.decoded(fingerprints.encoded(a)) == a
    assert fingerprints.containment({}, {}) == 1 and fingerprints.containment({}, a) == 0


def test_edit_likeness(spark, awkward, none):
    got = fingerprints.edit_likeness(awkward).toPandas()
    order = sorted(AWKWARD, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        a, b = fingerprints.fingerprint(t), fingerprints.fingerprint(e)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.encoded(a), fingerprints.encoded(b), fingerprints.containment(a, b), fingerprints.containment(a, fingerprints.fingerprint(n))))
    have = [(None if r[0] != r[0] else int(r[0]), *r[1:]) for r in got.values.tolist()]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert fingerprints.edit_likeness(none).count() == 0
    assert fingerprints.edit_likeness(awkward.where("doc_id = 4")).first()["near_next"] == 1


# -- 8


def hits_slow(text, items, size=10):
    w = WORD.findall(lower(text))
    hit, found = set(), set()
    for i, t in items:
        x = WORD.findall(lower(t))
        wins = {tuple(x[k : k + size]) for k in range(max(1, len(x) - size + 1))} if x else set()
        for k in range(len(w)):
            for win in wins:
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, awkward, none, block):
    items = [(1, "A, b! C d e f g h i J k"), (2, "one"), (3, None), (4, "..."), (5, "x y z"), (1, "A, b! C d e f g h i J k"), (None, "two"), (11, "É ñ"), (12, "b c d e f g h i j")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(awkward, bench, block_bytes=block).collect()
    real = [(i, t) for i, t in items if i is not None]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted((str(i), *hits_slow(t, real)) for i, t in AWKWARD)
    for r in got:
        assert r["contaminated"] == (r["n_hit"] > 0) and sum(len(WORD.findall(lower(r["text"][s["begin"] : s["end"]]))) for s in r["spans"]) == r["n_hit"]
    assert decontamination.find_contamination(none, bench).count() == 0
    assert decontamination.find_contamination(awkward, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_counts_items_without_id(spark):
    bench = spark.createDataFrame([(None, "one two three four five six seven eight nine ten eleven"), (2, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y"), (2, "z a b c")], "doc_id long, text string")
    for block in (1 << 24, 8):
        got = decontamination.find_contamination(docs, bench, block_bytes=block).orderBy("doc_id").collect()
        assert [(r["n_hit"], r["items"], r["contaminated"]) for r in got] == [(10, [], True), (3, ["2"], True)]


@given(st.lists(st.lists(st.integers(0, 5), max_size=14), max_size=5), st.lists(st.lists(st.integers(0, 6), max_size=40), max_size=4), st.integers(1, 10))
@settings(max_examples=200, deadline=None)
def test_scanner_finds_every_window(items, texts, window):
    items = [(i, " ".join(f"w{x}" for x in item)) for i, item in enumerate(items)]
    texts = [" ".join(f"w{x}" for x in t) for t in texts]
    scanner = decontamination.Scanner(decontamination.Items.of([i for i, _ in items], pa.array([t for _, t in items], pa.string()), window))
    many, runs, found = scanner.scan(pa.array(texts, pa.string()))
    got = [(int(n), sum(b - a for a, b in r), f) for n, r, f in zip(many, runs, found, strict=True)]
    assert got == [hits_slow(t, items, window) for t in texts]


def test_scanner_takes_memory_in_proportion_to_the_items():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(1000)]
    s = decontamination.Scanner(decontamination.Items.of(list(range(1000)), pa.array(texts), 10))
    assert s.found.get_stats()["total_size"] < 30 * sum(map(len, texts)) and len(s.places) <= 10 * 1000  # all windows: 51 for each


def test_decontamination_of_a_text_of_many_steps(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(1_200_000))  # 10 MB
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, long + " " + item), (2, item.upper() + " " + long[:1000])], "doc_id long, text string")
    got = decontamination.find_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(1_200_010, 10, ["1"]), (10 + len(long[:1000].split()), 10, ["1"])]


# -- 10


def classes_slow(texts):
    sets = []
    for _, t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    links = [0] * len(texts)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            links[i] += 1
            links[j] += 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((str(d), str(least.get(top(i), d)), links[i]) for i, (d, _) in enumerate(texts))


def test_banding_meets_its_recall():
    bands, rows_ = ngram_join.banding()
    assert bands * rows_ <= 256 and 1 - (1 - 0.8**rows_) ** bands >= 0.999


@pytest.mark.parametrize("block,band,rows_", [(256, 1024, 200_000), (3, 4, 0)])
def test_jaccard_classes(spark, awkward, none, monkeypatch, block, band, rows_):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BAND_BLOCK", band)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", max(1, rows_))
    rng = np.random.default_rng(9)
    base = [f"t{i}" for i in rng.integers(0, 5000, 200)]
    near = []
    for k in range(30):
        w = list(base)
        for p in rng.integers(0, 200, k % 5):
            w[p] = f"n{k}"
        near.append((100 + k, " ".join(w)))
    texts = AWKWARD + near + [(200, near[3][1]), (201, near[3][1].upper())]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in ngram_join.jaccard_classes(df).collect())
    assert got == classes_slow(texts)
    assert ngram_join.jaccard_classes(none).count() == 0


@given(st.lists(st.lists(st.integers(0, 2), min_size=6, max_size=6), min_size=1, max_size=14), st.sampled_from([0.5, 0.8]))
@settings(max_examples=150, deadline=None)
def test_leaders_connect_what_pairs_connect(sketches, least):
    x = np.array(sketches, dtype=np.uint8)

    def classes(edges):
        root = list(range(len(x)))

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in edges:
            root[max(top(i), top(j))] = min(top(i), top(j))
        return [top(i) for i in range(len(x))]

    assert classes(ngram_join.leaders(x, least)) == classes([(i, j) for i, j in itertools.combinations(range(len(x)), 2) if (x[i] == x[j]).sum() >= least * 6])


def test_join_recall_against_all_rows(spark):
    """Links of the rows whose id is divisible by 50 against all rows, by brute force: at least 0.99 of them are counted."""
    sf = "/root/testdata/sf0.01"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sets = {}
    for i, t in texts:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    want = {i: sum(1 for j, b in sets.items() if j != i and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)) for i, a in sets.items() if i % 50 == 0 or i % 7 == 0}
    assert all(got[i] <= n for i, n in want.items()) and sum(want.values()) > 0
    assert sum(got[i] for i in want) >= 0.99 * sum(want.values())


def test_drop_near_duplicates(spark, awkward):
    got = ngram_join.drop_near_duplicates(awkward)
    assert got.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in got.collect())
    assert ids == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, None: 1, 8: 1, 9: 1, 10: 1}


def test_drop_near_duplicates_by_row(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    docs = spark.createDataFrame([(5, a), (7, a), (5, b), (3, b), (3, b), (3, "i j k l m n o")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in ngram_join.drop_near_duplicates(docs).collect())
    assert got == [(3, "i j k l m n o"), (3, b), (5, a)]


def test_lm_steps_and_chosen_branches_are_those_of_plain_sums():
    rng = np.random.default_rng(8)
    n, size = maxent.CACHED + 77, 1 << 13
    rows, branch = rng.integers(0, size // 2, (n, maxent.FEATURES)), rng.integers(0, maxent.WIDTH, n)
    w, bias = rng.normal(size=(size, maxent.WIDTH)).astype(np.float32), -rng.random((n, maxent.WIDTH)).astype(np.float32)
    z = bias.astype(float) + w[rows].astype(float).sum(axis=1)
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    p = maxent._probability(w, rows, bias.copy())
    assert np.allclose(p, want, atol=1e-6)
    assert np.allclose(maxent._log_chosen(w, rows, bias.copy(), branch), np.log(want[np.arange(n), branch]), atol=1e-5)
    p[np.arange(n), branch] -= 1
    made, g = maxent.Learner(w), np.zeros((size, maxent.WIDTH))
    made.step(rows, p)
    for k in range(maxent.FEATURES):
        np.add.at(g, rows[:, k], p.astype(float))
    met = np.bincount(rows.ravel(), minlength=size)
    squares = 0.5 * maxent.WIDTH + (g * g).sum(axis=1) / np.maximum(met, 1)
    rate = maxent.RATE * np.sqrt(maxent.WIDTH / (np.maximum(met, 1) * squares))
    assert (made.seen == met).all() and np.allclose(made.w, w - g * rate[:, None], atol=1e-5) and (made.w[size // 2 :] == w[size // 2 :]).all()

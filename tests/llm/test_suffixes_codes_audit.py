"""Suffix-array deduplication, vector codes and the filter audit against brute force."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import filter_audit, suffix_dedup, vector_codes
from tessera.llm.queries import op11_suffix_dedup, op12_vector_codes, op13_filter_audit
from tessera.llm.suffix_array import common_prefixes, repeated_starts, smaller_than_next, suffix_array
from tests.llm.test_operators import AWKWARD, SCHEMA, rows

# -- 11


@given(st.binary(max_size=60), st.sampled_from([2, 3, 200]))
@settings(max_examples=200, deadline=None)
def test_suffix_array_is_the_sorted_order(data, letters):
    data = bytes(x % letters for x in data)
    x, n = np.frombuffer(data, dtype=np.uint8), len(data)
    want = sorted(range(n), key=lambda i: data[i:])
    order = suffix_array(x, 1 << 20)
    assert order.tolist() == want
    assert smaller_than_next(x).tolist() == [data[i:] < data[i + 1 :] for i in range(n)]
    lcp = common_prefixes(x, order)
    for a, b in itertools.pairwise(want):
        k = next((k for k in range(n) if data[a + k : a + k + 1] != data[b + k : b + k + 1] or b + k >= n), n)
        assert lcp[b] == k


@given(st.lists(st.text("ab\0é", max_size=20), max_size=6), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_repeated_starts_are_the_counted_ones(texts, length):
    strings = [t.encode() for t in texts]
    count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    got = repeated_starts(strings, length)
    assert [g.tolist() for g in got] == [[count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]


@pytest.mark.parametrize("size", [1, 5, 48, 64, 200])
def test_string_hashes_depend_on_the_string_alone(size):
    data = np.random.default_rng(0).integers(0, 3, 700).astype(np.uint8)
    got = suffix_dedup.string_hashes(data, size)
    assert len(got) == len(data) - size + 1
    assert [int(suffix_dedup.string_hashes(data[i : i + size].copy(), size)[0]) for i in (0, 1, 77, len(got) - 1)] == [int(got[i]) for i in (0, 1, 77, len(got) - 1)]


def test_runs_hold_each_passage_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEP", 300)
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    rng = random.Random(2)
    strings = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 5, 39, 40, 41, 500]))).encode() for _ in range(30)] + [b"z" * 900]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    string, first, count, anchor, often = suffix_dedup.runs(data, offsets, 40, 16)
    seen = Counter((int(s), int(f) + k) for s, f, c in zip(string, first, count, strict=True) for k in range(c))
    assert seen == Counter((i, k) for i, s in enumerate(strings) for k in range(len(s) - 39))
    least = {}
    for s, f, c, a, o in zip(string, first, count, anchor, often, strict=True):
        for k in range(c):
            passage = strings[s][f + k : f + k + 40]
            assert least.setdefault(passage, int(a)) == int(a)
        whole = strings[s][f : f + c + 39]
        h = suffix_dedup.string_hashes(np.frombuffer(whole, dtype=np.uint8), 16).view(np.int64)
        assert s == len(strings) - 1 or o == (h == a).sum()


def without_repeats(texts, length):
    strings = [(t or "").encode() for t in texts]
    count = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    out = []
    for s in strings:
        gone = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if count[s[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(s, gone, strict=True) if not g)
        out.append((len(s), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def digested(left):
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return [tuple(r) for r in left.select("doc_id", "n_bytes", removed, F.size("removed"), F.sha2("kept", 256)).collect()]


def planted():
    rng = random.Random(1)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    phrase, passage = text("abcdef ghé", 120), text("klmnop ", 260)
    out = [text("abcdefgh ", 150) + phrase + text("xyz", rng.randint(0, 150)) for _ in range(40)]
    out += [text("abc ", 90) + passage + text("abc ", 90) for _ in range(5)] + [passage + out[3], out[7], out[7]]
    out += ["a" * 5000, "a" * 700, "", None, "é" * 300, text("ab ", 199), "xy" * 120 + text("pqr", 50)]
    return out + [("q" * i) + out[1][100:] for i in range(1, 8)]


@pytest.mark.parametrize("most,piece", [(suffix_dedup.MOST_RUNS, suffix_dedup.PIECE), (2, 3000)])
def test_suffix_dedup_removes_what_repeats(spark, monkeypatch, most, piece):
    """Also where anchors have more runs than a task shall hold, so that longer anchors and whole passages cut them up."""
    monkeypatch.setattr(suffix_dedup, "MOST_RUNS", most)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    texts = planted()
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, key int, spans string")
    assert sorted(digested(suffix_dedup.remove_repeats(df))) == [(i, *w) for i, w in enumerate(without_repeats(texts, 200))]


def test_suffix_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", -1)
    texts = planted()[35:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = suffix_dedup.remove_repeats(df).collect()
    want = without_repeats(texts, 200)
    assert sorted((r["doc_id"], r["n_bytes"], sum(s["high"] - s["low"] for s in r["removed"]), len(r["removed"])) for r in left) == [(i, *w[:3]) for i, w in enumerate(want)]
    assert {r["doc_id"]: hashlib.sha256(r["kept"]).hexdigest() for r in left} == {i: w[3] for i, w in enumerate(want)}


def test_runs_that_are_settled_are_not_sorted(spark, monkeypatch):
    """Anchors whose runs all have copies need no suffixes; the others are sorted with all their runs."""

    class Frame:
        sparkSession = spark
        select = repartition = sortWithinPartitions = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    seen = []
    monkeypatch.setattr(suffix_dedup, "repeated_starts", lambda strings, length: seen.extend(strings) or repeated_starts(strings, length))
    monkeypatch.setattr(suffix_dedup, "PIECE", 8)
    table = [(1, 0, 1, 2, b"abcdef"), (2, 0, 1, 1, b"uvwxy"), (2, 0, 2, 3, b"tuvwx"), (3, 0, 1, 1, b"ababab"), (4, 0, 1, 4, b"mnop"), (4, 0, 2, 2, b"mnoq"), (5, 0, 1, 1, b"hijk")]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*table, strict=True)], names=["anchor", "c1", "c2", "copies", "bytes"])
    got = {}
    for b in suffix_dedup._sorted_spans(Frame(), 4)(iter([batch.slice(0, 5), batch.slice(5)])):
        for r in b.to_pylist():
            got[r["anchor"], r["c2"]] = {x for s in r["spans"] for x in range(s["low"], s["high"])}
    assert got == {(1, 1): {0, 1, 2}, (2, 1): {0}, (2, 2): {0, 1}, (3, 1): {0, 2}, (4, 1): {0}, (4, 2): {0}}
    assert sorted(seen) == sorted(r[4] for r in table if r[0] in (2, 3, 5))


def test_suffix_dedup_awkward_and_empty(spark):
    df = spark.createDataFrame(rows([*AWKWARD, (11, AWKWARD[8][1][5000:])]), SCHEMA)
    texts = [r["text"] for r in df.collect()]
    assert sorted(map(repr, digested(suffix_dedup.remove_repeats(df)))) == sorted(repr((r["doc_id"], *w)) for r, w in zip(df.collect(), without_repeats(texts, 200), strict=True))
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


# -- 12


@given(st.integers(0, 10_000))
@settings(max_examples=80, deadline=None)
def test_filtering_finds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    n, k, d = rng.integers(1, 200), rng.integers(1, 40), rng.integers(1, 5)
    x = rng.integers(-6, 7, (n, d)) * (1 if seed % 5 else 1_000_000)
    book = x[rng.integers(0, n, k)] + (rng.integers(0, 2, (k, d)) if seed % 2 else 0)
    tree = vector_codes._unpack(vector_codes._pack(vector_codes.build(x, 4)))
    got, total, count = vector_codes.assign(tree, x, book)
    want = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    sums = np.zeros_like(book)
    np.add.at(sums, want, x)
    assert (got == want).all() and (total == sums).all() and (count == np.bincount(want, minlength=k)).all()


def test_filtering_assigns_subtrees_at_once():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 10, (500, 3)), rng.integers(1000, 1010, (500, 3))])
    tree = vector_codes.build(x)
    tree.left[1:] = -1  # below the two halves nothing may be needed
    points = np.full_like(x, 10**6)  # nor the points
    got, _, count = vector_codes.assign(tree, points, np.array([[5, 5, 5], [1005, 1005, 1005]]))
    assert got.tolist() == [0] * 500 + [1] * 500 and count.tolist() == [500, 500]


def lloyd(vectors, parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v], label) for i, v, label in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    x = np.array([r[1] for r in kept]).reshape(len(kept), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    nearest = lambda: np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)], axis=1)
    for _ in range(rounds):
        near = nearest()
        for p in range(parts):
            for e in set(near[:, p].tolist()):
                own = x[near[:, p] == e, p]
                books[p][e] = own.sum(axis=0) // len(own)
    near = nearest()
    errors = sum(((x[:, p] - books[p][near[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    by = Counter()
    for r, e in zip(kept, errors.tolist(), strict=True):
        by[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1)).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in n), e, by[r[2]], digest) for r, n, e in zip(kept, near.tolist(), errors.tolist(), strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int"


def coded(spark, tmp_path, vectors, extra=()):
    df = spark.createDataFrame(vectors, VECTORS).repartition(3)
    for c in extra:
        df = df.withColumn(c, F.lit(1))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r) for r in op12_vector_codes(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("n", [700, 3, 0])
def test_vector_codes_are_lloyds(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(vector_codes, "CHUNK", 100)
    rng = np.random.default_rng(n)
    base = rng.normal(0, 0.1, (n, 8)).astype(np.float32)
    base[: n // 3] = np.round(base[: n // 3], 1)
    vectors = [(int(i) // 2 if i % 9 == 0 else int(i), v.tolist(), [None, 1, 2, 2][i % 4]) for i, v in enumerate(base)]
    vectors += [(5, None, 1), (-7, [1.0] * 7 + [None], 1), (-8, [float("nan")] + [0.0] * 7, 1), (-9, [float("-inf")] + [0.0] * 7, None), (None, [0.5] * 8, None), (None, [0.5] * 8, 3), (10**6, [], 2), (10**6, [0.1] * 4, 2)]
    want = lloyd(vectors)
    assert sorted(map(repr, coded(spark, tmp_path, vectors, ["whole", "codes", "none"]))) == sorted(map(repr, want)) and len(want) == (n + 2 if n else 1)


def test_vector_codes_of_nothing(spark, tmp_path):
    assert coded(spark, tmp_path, [(1, None, 1)]) == []


# -- 13


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for k in filter_audit.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def audited(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    space = " \t\n\x0b\x0c\r"
    fails = []
    for i, t, part in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in space else c for c in t).split(" ") if w]
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        fails.append((part or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [f for f in left if x in f[1]]
                again = sum(x in f[1] and bool(f[1] & set(order[:k])) for f in own)
                left = [f for f in left if x not in f[1]]
                shapley[part, x] += len(gone)
                out[part, order, k + 1] = (len(left), len(gone), again, sum(f[1] == {x} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone))
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def test_filter_audit_counts_every_order(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "Cc", "D#", "e", "f%", "ÀÉ", "日本"]) + (str(k) if i % 2 else "") for k in range(rng.choice([0, 3, 55, 80]))) for i in range(40)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "\x85\xa0 x", "AB", "a|b", *texts[:9], *texts[:4]]
    docs = [(rng.choice([i, i, i // 2, None]), t, rng.choice(["s", "t", "", None])) for i, t in enumerate(texts)]
    docs += docs[:5]
    labels = [(rng.randrange(50) if k % 7 else None, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(60)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, n int, mask string")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, labels)
    assert filter_audit.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_new_queries_give_a_row_each(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert op11_suffix_dedup(spark, sf).count() == docs.count()
    assert op13_filter_audit(spark, sf).count() == 600 * docs.select(F.coalesce("source", F.lit(""))).distinct().count()

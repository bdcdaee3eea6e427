"""Product codes of vectors: Lloyd's rounds by filtering, a kd-tree over each part of a chunk of vectors.

The trees are built once and written to the shared folder. A node holds its box, the sum and the count of its points; in
each round it is entered with the codebook entries that can be nearest to any point of its box. With one such entry left
the whole subtree goes to it, by its cached sum. Numbers are whole throughout, so ties and sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import parallelism, staged, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a tree spans at most, and points that a leaf holds at most.
CHUNK, LEAF = 8192, 16
#: Whole components beyond this would overflow sums of squares in 64 bits.
LARGEST = 1 << 26
#: Pairs of nodes and entries that are tested in one step.
_PAIRS = 1 << 16


@dataclass
class Tree:
    """A kd-tree over points: order of the points; of each node its range in it, children (-1: a leaf), box, sum."""

    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree: a node of more than `leaf` points is halved at the median of the dimension in which it is widest."""
    order = np.arange(len(points), dtype=np.int32)
    begin, end, left, right = [0], [len(points)], [-1], [-1]
    at = 0
    while at < len(begin):
        a, b = begin[at], end[at]
        own = points[order[a:b]]
        spread = own.max(axis=0) - own.min(axis=0) if b > a else np.zeros(1)
        if b - a > leaf and spread.max() > 0:
            dim, half = int(spread.argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, dim], half)]
            left[at], right[at] = len(begin), len(begin) + 1
            begin += [a, a + half]
            end += [a + half, b]
            left += [-1, -1]
            right += [-1, -1]
        at += 1
    begin, end = np.array(begin, dtype=np.int32), np.array(end, dtype=np.int32)
    dealt = points[order].astype(np.int64)
    cumulated = np.concatenate([np.zeros((1, points.shape[1]), dtype=np.int64), np.cumsum(dealt, axis=0)])
    low = np.array([dealt[a:b].min(axis=0) for a, b in zip(begin, end, strict=True)])
    high = np.array([dealt[a:b].max(axis=0) for a, b in zip(begin, end, strict=True)])
    return Tree(order, begin, end, np.array(left, dtype=np.int32), np.array(right, dtype=np.int32), low, high, cumulated[end] - cumulated[begin])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by floating point where that is exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if bound < 2**52 else a @ b.T


def assign(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each point (ties: the lower index), and each entry's sum and count of points.

    An entry leaves a box if the one nearest to the box's middle is nearer to all its points, or as near with a lower
    index: that is seen at the corner of the box that is farthest in the entry's direction.
    """
    k, dims = book.shape
    nearest = np.empty(len(points), dtype=np.int64)
    total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    norms = (book * book).sum(axis=1)
    farthest = np.iinfo(np.int64).max
    nodes, alive = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
    while len(nodes):
        then_nodes, then_alive = [], []
        for a in range(0, len(nodes), max(1, _PAIRS // k)):
            node, mask = nodes[a : a + max(1, _PAIRS // k)], alive[a : a + max(1, _PAIRS // k)]
            low, high = tree.low[node], tree.high[node]
            # twice the distance to the middle, up to what is the same for all entries; then the best by index
            mid = np.where(mask, 2 * norms - 2 * _products(low + high, book), farthest)
            best = mid.argmin(axis=1)
            where, entry = np.nonzero(mask)
            toward = book[entry] - book[best[where]]
            corner = np.where(toward > 0, high[where], low[where])
            gap = norms[entry] - norms[best[where]] - 2 * (toward * corner).sum(axis=1)
            stays = (gap < 0) | ((gap == 0) & (entry <= best[where]))
            mask = mask.copy()
            mask[where, entry] = stays
            left = mask.sum(axis=1)
            one = left == 1
            for n, e in zip(node[one].tolist(), mask[one].argmax(axis=1).tolist(), strict=True):
                nearest[tree.order[tree.begin[n] : tree.end[n]]] = e
            np.add.at(total, mask[one].argmax(axis=1), tree.total[node[one]])
            np.add.at(count, mask[one].argmax(axis=1), (tree.end - tree.begin)[node[one]])
            leaf = ~one & (tree.left[node] < 0)
            for n, own in zip(node[leaf], mask[leaf], strict=True):
                at = tree.order[tree.begin[n] : tree.end[n]]
                entries = np.flatnonzero(own)
                x = points[at].astype(np.int64)
                got = entries[(norms[entries] - 2 * _products(x, book[entries])).argmin(axis=1)]
                nearest[at] = got
                np.add.at(total, got, x)
                np.add.at(count, got, 1)
            inner = ~one & ~leaf
            then_nodes += [tree.left[node[inner]], tree.right[node[inner]]]
            then_alive += [mask[inner], mask[inner]]
        nodes, alive = np.concatenate(then_nodes).astype(np.int64), np.concatenate(then_alive)
    return nearest, total, count


def _cuts(dims: int, parts: int) -> list[tuple[int, int]]:
    """Where each part of a vector begins and ends; the first parts are one longer if they can't be equal."""
    size, more = divmod(dims, parts)
    ends = np.cumsum([size + (i < more) for i in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vectors whose components are all finite, with `whole`: each component times `scale`, floored."""
    v = F.col(f"`{vec_col}`")
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return vectors.where(v.isNotNull() & ok).withColumn("whole", F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, codes array<int>, error) of each vector that is kept, and the codebook of each part.

    Null vectors and those with null or non-finite components go. All vectors must be as long as that of the least id
    (others go too, as do empty ones). The codebooks begin with the vectors of the least ids, with equal ids in the order
    of the vectors, null ids last; fewer vectors than `entries` make as many entries; repeated rows are coded alike; no
    vectors give no rows and no codebook. Components times 1,024 must lie within 2^26, or it fails.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, id_col, vec_col).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), "whole").where(F.size("whole") > 0)
    id_type, label_type = (kept.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    order = [F.col("vec_id").asc_nulls_last(), F.col("whole")]
    dims = kept.orderBy(*order).select(F.size("whole")).limit(1).collect()
    shape = f"vec_id {id_type}, label {label_type}, codes array<int>, error long"
    if not dims:
        return spark.createDataFrame([], shape), []
    dims = dims[0][0]
    kept = kept.where(F.size("whole") == dims)
    over = kept.where(F.array_max("whole") >= LARGEST).limit(1).count() + kept.where(F.array_min("whole") < -LARGEST).limit(1).count()
    if over:
        raise ValueError(f"components times {SCALE} beyond {LARGEST}")
    first = np.array([r[0] for r in kept.orderBy(*order).limit(entries).select("whole").collect()], dtype=np.int64)
    cuts = _cuts(dims, parts)
    books = [np.ascontiguousarray(first[:, a:b]) for a, b in cuts]
    trees = staged(_trees(kept, cuts, id_type, label_type), "trees")
    for _ in range(rounds):
        sums = {(r["part"], r["entry"]): r for r in _round(trees, books, len(first)).collect()}  # a row an entry: parts * entries
        for p, book in enumerate(books):
            for e in range(len(book)):
                if (p, e) in sums:
                    r = sums[p, e]
                    book[e] = [x // r["n"] for x in r["total"]]  # floors, as // does
    return _coded(trees, books, cuts, shape), books


_TREE = ["order", "begin", "end", "left", "right", "low", "high", "total"]


def _pack(tree: Tree) -> bytes:
    """A tree's arrays one after another, each with its shape; boxes in 32 bits."""
    out = []
    for name in _TREE:
        x = getattr(tree, name)
        x = x.astype(np.int32) if name in ("low", "high") else x
        head = np.array([x.itemsize, *x.shape, 0][:3], dtype=np.int64)
        out += [head.tobytes(), np.ascontiguousarray(x).tobytes()]
    return b"".join(out)


def _unpack(data: bytes) -> Tree:
    got, at = {}, 0
    for name in _TREE:
        size, n, dims = np.frombuffer(data, dtype=np.int64, count=3, offset=at).tolist()
        x = np.frombuffer(data, dtype=np.int32 if size == 4 else np.int64, count=n * max(1, dims), offset=at + 24)
        got[name] = x.reshape(n, dims) if dims else x
        at += 24 + x.nbytes
    return Tree(**got | {name: got[name].astype(np.int64) for name in ("low", "high")})


def _trees(kept: DataFrame, cuts: list[tuple[int, int]], id_type: str, label_type: str) -> DataFrame:
    """A row a chunk of vectors: ids, labels, and for each part its points and its tree."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, wholes, held = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            points = np.concatenate(wholes)
            lists = [pa.ListArray.from_arrays(pa.array([0, held], pa.int32()), pa.concat_arrays(c)) for c in (ids, labels)]
            of = [np.ascontiguousarray(points[:, a:b]) for a, b in cuts]
            blobs = [[x.astype(np.int32).tobytes() for x in of], [_pack(build(x)) for x in of]]
            return pa.RecordBatch.from_arrays([*lists, *[pa.array([b], pa.list_(pa.binary())) for b in blobs]], names=["ids", "labels", "points", "trees"])

        for b in batches:
            whole = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
            at = 0
            while at < b.num_rows:
                take = min(b.num_rows - at, CHUNK - held)
                ids.append(b.column(0).slice(at, take))
                labels.append(b.column(1).slice(at, take))
                wholes.append(whole[at : at + take])
                held, at = held + take, at + take
                if held == CHUNK:
                    yield chunk()
                    ids, labels, wholes, held = [], [], [], 0
        if held:
            yield chunk()

    return kept.mapInArrow(run, f"ids array<{id_type}>, labels array<{label_type}>, points array<binary>, trees array<binary>")


def _points(blob: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.int32).reshape(-1, dims)


def _round(trees: DataFrame, books: list[np.ndarray], entries: int) -> DataFrame:
    """(part, entry, n, total): how many points are nearest to each entry, and their sum; a row an entry and task before the sum."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros(b.shape, dtype=np.int64) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for points, packed in zip(batch.column(0), batch.column(1), strict=True):
                for p, book in enumerate(books):
                    _, total, count = assign(_unpack(packed[p].as_buffer().to_pybytes()), _points(points[p].as_buffer(), book.shape[1]), book)
                    totals[p] += total
                    counts[p] += count
        rows = [(p, e, int(counts[p][e]), totals[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "total"])

    longest = max(b.shape[1] for b in books)
    sums = trees.select("points", "trees").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(d))).alias(f"t{d}") for d in range(longest)])
    return sums.select("part", "entry", "n", F.filter(F.array(*[f"t{d}" for d in range(longest)]), lambda x: x.isNotNull()).alias("total"))


def _coded(trees: DataFrame, books: list[np.ndarray], cuts: list[tuple[int, int]], shape: str) -> DataFrame:
    """(vec_id, label, codes, error) by the final codebooks."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                codes, error = np.empty((len(ids), len(books)), dtype=np.int32), np.zeros(len(ids), dtype=np.int64)
                for p, book in enumerate(books):
                    x = _points(batch.column(2)[i][p].as_buffer(), book.shape[1])
                    codes[:, p], _, _ = assign(_unpack(batch.column(3)[i][p].as_buffer().to_pybytes()), x, book)
                    off = x.astype(np.int64) - book[codes[:, p]]
                    error += (off * off).sum(axis=1)
                flat = pa.array(codes.reshape(-1), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(books)), flat)
                yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    return trees.mapInArrow(run, shape)


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, with commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (staged) with label_error, the error summed over rows of equal label, nulls together."""
    key = [F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of")]
    sums = staged(coded.groupBy(*key).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.withColumns({"none": key[0], "of": key[1]}).join(sums, ["none", "of"]).drop("none", "of")

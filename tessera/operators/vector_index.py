"""An index for vectors: coarse cells, product codes of what is left, exact re-ranking.

The model (centres of the cells, codebooks of the residuals' parts) is fitted on a bounded sample; every row is indexed. A
row is in the cell of its nearest centre, in a table partitioned by cell, so a search reads the cells that it probes and
no others: first ids and codes, a few bytes a row, and then the vectors of a shortlist, which are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval

#: Rows that the model is fitted on at most (those of least hash), cells and entries of a codebook at most.
SAMPLE, MOST_CELLS, ENTRIES = 65_536, 4096, 256
PARTS, ROUNDS = 16, 12
#: The share of true neighbours in the probed cells that the number of probes is chosen for, by so many of the sample's
#: rows as queries and so many neighbours of each.
TARGET, TRIALS, NEIGHBOURS = 0.96, 512, 10
#: Rows of a cell, and queries, that a task multiplies at a time.
BLOCK = 4096
#: Products that a task holds at a time.
STEP = 1 << 20
#: Rows of a broadcast table at most.
BROADCAST_ROWS = 100_000


def unit(vectors: Sequence) -> np.ndarray:
    """Rows at unit length; zero vectors stay."""
    m = np.array([np.asarray(v, dtype=np.float32) for v in vectors], dtype=np.float32)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, so many rows at a time that the products stay within STEP."""
    own, n = (centres * centres).sum(axis=1), max(1, STEP // max(1, len(centres)))
    return np.concatenate([np.empty(0, dtype=np.int64), *((own - 2 * x[a : a + n] @ centres.T).argmin(axis=1) for a in range(0, len(x), n))])


def lloyd(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most k centres of x; a centre that loses all its points takes one of the largest cell's."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        for c in np.flatnonzero(~full):
            centres[c] = x[rng.choice(np.flatnonzero(near == count.argmax()))]
    return centres


def _cuts(width: int, parts: int) -> list[slice]:
    ends = np.linspace(0, width, min(parts, width) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Model:
    """Centres of cells and, for each part of a residual, its codebook: of a fixed size, so tasks may each have it."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books, self.cuts = centres, books, _cuts(centres.shape[1], len(books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest_centre(x, self.centres)
        left = x - self.centres[cell]
        return cell, np.stack([nearest_centre(left[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """About the dot products of queries with the coded rows of a cell: the centre's, and a table look-up a part."""
        out = np.repeat(q @ self.centres[cell][:, None], len(codes), axis=1)
        for p, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, c] @ b.T)[:, codes[:, p]]
        return out


def _probes(x: np.ndarray, centres: np.ndarray) -> int:
    """In how many of a query's nearest cells TARGET of its neighbours are, over the sample."""
    q = x[:TRIALS]
    n = min(NEIGHBOURS, len(x) - 1)
    if n < 1:
        return len(centres)
    near, step = [], max(1, STEP // len(x))
    for a in range(0, len(q), step):
        s = q[a : a + step] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near.append(np.argpartition(-s, n - 1, axis=1)[:, :n])
    near = np.concatenate(near)
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
    ranks = np.take_along_axis(place, nearest_centre(x, centres)[near], axis=1)
    return int(np.quantile(ranks, TARGET, method="higher")) + 1


def _fitted(sample: DataFrame, cells: int, parts: int) -> DataFrame:
    """(part, entry, vector) of a model: part -1 has the centres, the entry of part -2 is the number of probes.

    The sample is bounded; each part is fitted in a task.
    """
    kind = "part int, entry int, vector array<float>"

    def rows(part: int, m: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"part": part, "entry": range(len(m)), "vector": list(m.astype(np.float32))})

    def coarse(pdf: pd.DataFrame) -> pd.DataFrame:
        return rows(-1, lloyd(unit(pdf.sort_values("id")["v"]), cells))

    centres = sample.groupBy().applyInPandas(coarse, kind).collect()  # MOST_CELLS rows at most
    if not centres:
        return sample.sparkSession.createDataFrame([], kind)
    known = np.array([r["vector"] for r in sorted(centres, key=lambda r: r["entry"])], dtype=np.float32)
    cuts = _cuts(known.shape[1], parts)

    def fine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf.sort_values("id")["v"])
        if key[0] == -2:
            return pd.DataFrame({"part": [-2], "entry": [_probes(x, known)], "vector": [[]]})
        left = x - known[nearest_centre(x, known)]
        return rows(key[0], lloyd(np.ascontiguousarray(left[:, cuts[key[0]]]), ENTRIES))

    each = sample.withColumn("part", F.explode(F.array(*map(F.lit, [-2, *range(len(cuts))]))))
    return each.groupBy("part").applyInPandas(fine, kind).unionByName(sample.sparkSession.createDataFrame([(-1, i, v.tolist()) for i, v in enumerate(known)], kind))


class VectorIndex:
    """An index in a folder: model, rows by cell, and ids that were removed. Changes add files, which `compact` merges."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        by: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/model").collect():  # of a fixed size
            by.setdefault(r["part"], []).append((r["entry"], r["vector"]))
        self.probes = by.pop(-2)[0][0] if -2 in by else 1
        table = {p: np.array([v for _, v in sorted(e)], dtype=np.float32) for p, e in by.items()}
        self.model = Model(table.pop(-1), [table[p] for p in sorted(table)]) if table else None

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, col: str = "embedding", carry: Sequence[str] = ()) -> VectorIndex:
        """An index of vectors (id, `col`); `carry` are columns that searches may filter by.

        Null vectors are left out; zero vectors are like nothing; all must be of one length. cells: about the root of the
        number of rows where not given, MOST_CELLS at most. Without rows the index is empty.
        """
        rows = vectors.where(F.col(col).isNotNull())
        cells = cells or min(MOST_CELLS, max(1, round(rows.count() ** 0.5)))
        sample = rows.select("id", F.col(col).alias("v")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(SAMPLE)
        _fitted(sample, cells, parts).coalesce(1).write.parquet(f"{path}/model")
        index = cls(vectors.sparkSession, path)
        index._write(vectors, 0, col, [c for c in carry if c not in ("id", col)])
        return index

    def _write(self, vectors: DataFrame, batch: int, col: str, carry: Sequence[str]) -> None:
        rows = vectors.where(F.col(col).isNotNull()).select("id", *carry, F.col(col).cast("array<float>").alias("vector"))
        model = self.model

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    cell, codes = model.encode(unit(pdf["vector"]))
                    yield pdf.assign(code=[c.tobytes() for c in codes], cell=cell.astype(np.int32))

        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", code binary, cell int"
        done = rows.mapInPandas(coded, kind) if model else rows.withColumns({"code": F.lit(b""), "cell": F.lit(0)}).where("false")
        # cells of very different sizes: small ones share a file's task, large ones are cut
        done.withColumn("batch", F.lit(batch)).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def _table(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def rows(self) -> DataFrame:
        """The live rows: those that no later change has removed."""
        rows = self._table("rows")
        if rows is None:
            return self.spark.createDataFrame([], "id long, vector array<float>, code binary, batch int, cell int")
        gone = self._table("removed")
        if gone is None:
            return rows
        gone = gone.groupBy(F.col("id").alias("gone_id")).agg(F.max("batch").alias("gone_at"))
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
        return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("batch") <= F.col("gone_at")), "left_anti")

    def _last(self) -> int:
        found = [t.agg(F.max("batch")).first()[0] for t in (self._table("rows"), self._table("removed")) if t is not None]
        return max([0, *(x for x in found if x is not None)])

    def remove(self, ids: DataFrame) -> None:
        """Rows of these ids (a frame with id) are found no longer."""
        ids.select("id", F.lit(self._last()).alias("batch")).write.mode("append").parquet(f"{self.path}/removed")

    def upsert(self, vectors: DataFrame, col: str = "embedding") -> None:
        """New rows, or new vectors (or none, for null ones) of old ids; coded by the model as it is."""
        batch, before = self._last() + 1, self._table("rows")
        carry = [] if before is None else [c for c in before.columns if c not in ("id", "vector", "code", "batch", "cell")]
        vectors.select("id", F.lit(batch - 1).alias("batch")).write.mode("append").parquet(f"{self.path}/removed")
        self._write(vectors, batch, col, carry)

    def probed(self, queries: DataFrame, probes: int, col: str = "embedding") -> DataFrame:
        """(query_id, v, cell): for each query its `probes` cells of largest dot product."""
        model = self.model

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    q = unit(pdf["v"])
                    n = min(probes, len(model.centres))
                    best = np.argpartition(-(q @ model.centres.T), n - 1, axis=1)[:, :n]
                    yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), n), "v": [v for v in pdf["v"] for _ in range(n)], "cell": best.ravel().astype(np.int32)})

        asked = queries.where(F.col(col).isNotNull()).select(F.col("id").alias("query_id"), F.col(col).cast("array<float>").alias("v"))
        kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, v array<float>, cell int"
        return asked.mapInPandas(cells, kind) if model else asked.withColumn("cell", F.lit(0)).where("false")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, shortlist: int | None = None, where: str | Column | None = None, others: bool = False, col: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank): about the k rows of highest cosine to each query (id, `col`), scores exact.

        probes: as many as the sample needed where not given. `where` filters rows inside the cells, before any is scored; `others` leaves out the query's own id. With all
        cells probed and a shortlist as long as the table it is exact. The shortlist has 20 times k rows at least.
        """
        if self.model and shortlist and (probes or self.probes) >= len(self.model.centres):
            held = self.rows() if where is None else self.rows().where(where)
            if held.count() <= shortlist:  # nothing is left out, so codes tell nothing and no pair needs to be written
                asked = queries.select("id", F.col(col).cast("array<float>").alias("vector")).dropDuplicates(["id"])
                return retrieval.nearest(asked, held.select("id", "vector"), k, others, col="vector")
        short = shortlist or max(20 * k, 100)
        asked = self.probed(queries, probes or self.probes, col)
        wanted = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # MOST_CELLS at most
        live = self.rows()
        live = live.where(F.col("cell").isin(wanted)) if wanted else live.where("false")
        held = live if where is None else live.where(where)
        id_kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((live, "id"), (asked, "query_id")))
        many = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
        sizes = F.broadcast(many(asked, "kq").join(many(held, "kr"), "cell"))  # a row a cell
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = asked.join(sizes, "cell").select("cell", own("query_id", "kq").alias("l"), every("kr").alias("r"), "query_id", "v")
        right = held.select("cell", "id", "code").join(sizes, "cell").select("cell", every("kq").alias("l"), own("id", "kr").alias("r"), "id", "code")
        model = self.model

        def best(key: tuple, asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(asks) or not len(rows):
                return pd.DataFrame({"query_id": asks["query_id"][:0], "id": rows["id"][:0], "cell": np.empty(0, dtype=np.int32), "about": np.empty(0)})
            q, codes = np.array(asks["v"].tolist(), dtype=np.float32), np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
            n, step, at, about = min(short, len(rows)), max(1, STEP // len(rows)), [], []
            for a in range(0, len(q), step):
                s = model.scores(q[a : a + step], key[0], codes)
                at.append(np.argpartition(-s, n - 1, axis=1)[:, :n])
                about.append(np.take_along_axis(s, at[-1], axis=1))
            return pd.DataFrame({"query_id": np.repeat(asks["query_id"].to_numpy(), n), "id": rows["id"].to_numpy()[np.concatenate(at).ravel()], "cell": np.int32(key[0]), "about": np.concatenate(about).ravel().astype(float)})

        keys = ["cell", "l", "r"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"query_id {query_kind}, id {id_kind}, cell int, about double")
        found = found.where("query_id <> id") if others else found
        nearest = Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
        found = found.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= short).select("query_id", "id", "cell").distinct()
        pairs = held.select("cell", "id", "vector").join(found, ["cell", "id"])
        pairs = pairs.join(asked.dropDuplicates(["query_id"]).select("query_id", "v"), "query_id")

        def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    a, b = (np.array(pdf[c].tolist(), dtype=np.float64) for c in ("v", "vector"))
                    n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                    s = np.divide((a * b).sum(axis=1), n, out=np.zeros(len(n)), where=n > 0)
                    yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "score": np.round(s, 12)})

        scored = pairs.select("query_id", "id", "v", "vector").mapInPandas(exact, f"query_id {query_kind}, id {id_kind}, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def compact(self, path: str) -> VectorIndex:
        """The live rows, in fewer files, as an index of its own in another folder."""
        self.spark.read.parquet(f"{self.path}/model").coalesce(1).write.parquet(f"{path}/model")
        self.rows().withColumn("batch", F.lit(0)).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
        return VectorIndex(self.spark, path)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, k): how many of the k that the exact way finds for a query the index finds too."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("k"))

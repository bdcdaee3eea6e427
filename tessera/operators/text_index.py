"""An inverted index with positions: a text is split and stemmed when it is written, never when it is searched for.

The postings of a term are cut by ranges of SPAN ids into blocks, so that no row is unbounded, whatever the term. A block
has its ids and positions as differences and the largest count of the term in a text. Blocks are partitioned by a hash of
the term and sorted by term, so a search reads the files of its terms. What changes is written as a new segment; older
postings of changed ids don't count any more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import english

SPAN = 4096
#: Folders that terms are dealt to by their hash.
BUCKETS = 64
#: Blocks of the largest bounds that a top-k search scores first.
FIRST = 32
#: Rows of a broadcast table at most.
BROADCAST_ROWS = 100_000

_BLOCK = "bucket int, term string, block long, n int, most int, ids binary, counts binary, places binary"
_PLAIN = re.compile("[a-z0-9]+")


def plain_words(text: str | None) -> list[str | None]:
    return _PLAIN.findall((text or "").lower())


def encode(ids: np.ndarray, places: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """Rising offsets of ids in their block, and the rising places in each text, as differences, with the counts of places."""
    counts = np.array([len(p) for p in places], dtype=np.uint32)
    gaps = [np.diff(p, prepend=0) for p in places]
    return np.diff(ids, prepend=0).astype(np.uint16).tobytes(), counts.tobytes(), np.concatenate(gaps).astype(np.uint32).tobytes()


def decode(ids: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of ids, where each one's places begin (and the last's end), all places."""
    n = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    total = np.cumsum(np.frombuffer(places, dtype=np.uint32).astype(np.int64))
    before = np.concatenate([[0], total])[ends[:-1]]
    return np.cumsum(np.frombuffer(ids, dtype=np.uint16).astype(np.int64)), ends, total - np.repeat(before, n)


def _packed(term: np.ndarray, ids: np.ndarray, places: np.ndarray, span: int) -> Iterator[tuple]:
    """(term, block, n, most, ids, counts, places) of a block of `span` ids each, from tokens in any order; a place of a text
    counts once."""
    order = np.lexsort((places, ids, term))
    term, ids, places = term[order], ids[order], places[order]
    if not len(ids):
        return
    starts = lambda *cols: np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]))
    once = starts(term, ids, places)
    term, ids, places = term[once], ids[once], places[once]
    text = starts(term, ids)  # where a text's places begin
    counts = np.diff(text, append=len(ids)).astype(np.uint32)
    gaps = np.diff(places, prepend=0)
    gaps[text] = places[text]
    gaps = gaps.astype(np.uint32)
    term, ids = term[text], ids[text]
    first = starts(term, ids // span)  # where a block's texts begin
    jumps = np.diff(ids % span, prepend=0)
    jumps[first] = ids[first] % span
    jumps = jumps.astype(np.uint16)
    ends, most = [*first[1:].tolist(), len(ids)], np.maximum.reduceat(counts, first).tolist()
    at = [*text.tolist(), len(places)]
    for a, b, t, block, m in zip(first.tolist(), ends, term[first].tolist(), (ids[first] // span).tolist(), most, strict=True):
        yield t, block, b - a, m, jumps[a:b].tobytes(), counts[a:b].tobytes(), gaps[at[a] : at[b]].tobytes()


def _merged(rows: pd.DataFrame, span: int) -> pd.DataFrame:
    """A row a block from sorted parts of blocks; an id that is in several parts has the places of all."""
    key = rows[["bucket", "term", "block"]]
    part = (key != key.shift()).any(axis=1).cumsum().to_numpy() - 1  # the number of the block that a row is of
    if not len(rows) or part[-1] == len(rows) - 1:
        return rows
    whole = lambda c, kind: np.frombuffer(b"".join(rows[c]), dtype=kind).astype(np.int64)

    def summed(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What differences come to, from 0 again after each of the sizes, none of which is 0."""
        total, first = np.cumsum(steps), np.cumsum(sizes) - sizes
        return total - np.repeat(total[first] - steps[first], sizes)

    texts, counts = rows["n"].to_numpy(dtype=np.int64), whole("counts", np.uint32)
    ids, places = summed(whole("ids", np.uint16), texts), summed(whole("places", np.uint32), counts)
    packed = _packed(np.repeat(np.repeat(part, texts), counts), np.repeat(ids, counts), places, span)
    first = rows[np.diff(part, prepend=-1) > 0].reset_index(drop=True)
    return first.assign(**dict(zip(["n", "most", "ids", "counts", "places"], zip(*(row[2:] for row in packed), strict=True), strict=True)))


class TextIndex:
    """An index in a folder, of terms as they stand or of English stems without stop words."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.english = bool(spark.read.parquet(f"{path}/about").first()["english"])

    @classmethod
    def build(cls, docs: DataFrame, path: str, english: bool = False, col: str = "content") -> TextIndex:
        """An index of docs (id long, `col`); null texts have no terms, rows of one id count as one text."""
        spark = docs.sparkSession
        spark.createDataFrame([(english,)], "english boolean").coalesce(1).write.parquet(f"{path}/about")
        index = cls(spark, path)
        index._write(docs, 0, col)
        return index

    def terms(self, query: str) -> list[str]:
        return sorted(english.wanted(query) if self.english else set(plain_words(query)))

    def _write(self, docs: DataFrame, segment: int, col: str) -> None:
        split = english.stems if self.english else plain_words

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 500):
                    code: dict[str | None, int] = {None: -1}  # a place that has no term
                    texts = [[code.setdefault(t, len(code) - 1) for t in split(text)] for text in pdf["text"].iloc[a : a + 500].tolist()]
                    sizes = np.array([len(t) for t in texts])
                    term = np.fromiter((t for each in texts for t in each), dtype=np.int64, count=sizes.sum())
                    ids = np.repeat(pdf["id"].iloc[a : a + 500].to_numpy(), sizes)
                    places = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    said, names = term >= 0, list(code)[1:]
                    rows = [(0, names[t], *rest) for t, *rest in _packed(term[said], ids[said], places[said], SPAN)]
                    yield pd.DataFrame(rows, columns=["bucket", "term", "block", "n", "most", "ids", "counts", "places"])

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for pdf in batches:
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                if len(pdf):
                    done = _merged(pdf, SPAN)
                    yield done.iloc[:-1]
                    held = done.iloc[-1:]  # the next batch may have more of it
            if held is not None:
                yield held

        rows = docs.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col(col).alias("text")).mapInPandas(parts, _BLOCK)
        rows = rows.withColumn("bucket", _bucket(F.col("term")))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a common term's blocks go to many tasks, and a task writes few folders
        dealt = rows.repartition(n, F.col("bucket"), F.pmod(F.hash("block"), F.lit(max(1, n // BUCKETS)))).sortWithinPartitions("bucket", "term", "block")
        dealt.mapInPandas(whole, _BLOCK).withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def _changed(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.path}/changed")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def update(self, docs: DataFrame, col: str = "content") -> None:
        """New texts, or new texts of old ids (null: the id is found no longer), as one more segment."""
        before = self._changed()
        last = 0 if before is None else before.agg(F.max("segment")).first()[0] or 0
        docs.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.lit(last + 1).alias("segment")).distinct().write.mode("append").parquet(f"{self.path}/changed")
        self._write(docs, last + 1, col)

    def postings(self, terms: list[str]) -> DataFrame:
        """The blocks of these terms; other terms' folders aren't read."""
        kind = f"{_BLOCK}, segment int"
        buckets = sorted(r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()) if terms else []
        read = self.spark.read.schema(kind).parquet(f"{self.path}/postings")
        return read.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def _heads(self, blocks: DataFrame, terms: list[str]) -> DataFrame:
        """(block, bound): blocks that have all terms, and the most that a text in them can count."""
        sizes = blocks.groupBy("block", "term").agg(F.max("most").alias("most"))
        return sizes.groupBy("block").agg(F.count(F.lit(1)).alias("terms"), F.sum("most").alias("bound")).where(F.col("terms") == len(terms)).select("block", (F.col("bound") * self._weight()).alias("bound"))

    def _weight(self) -> float:
        """What one occurrence adds to a rank at most."""
        return english.PLAIN if self.english else 1.0

    def _scored(self, blocks: DataFrame, terms: list[str], k: int | None = None) -> DataFrame:
        """(id, rank) of the texts that have all terms, of each block the k first."""
        by_stem, n, wanted = self.english, len(terms), frozenset(terms)

        def score(rows: pd.DataFrame, changed: pd.DataFrame | None = None) -> pd.DataFrame:
            none = pd.DataFrame({"id": np.empty(0, dtype=np.int64), "rank": np.empty(0)})
            newest = np.zeros(SPAN, dtype=np.int64)
            if changed is not None and len(changed):
                newest[changed["id"].to_numpy() % SPAN] = changed["segment"].to_numpy()
            if rows["term"].nunique() < n:
                return none
            of: dict[str, dict[int, np.ndarray]] = {}
            for term, segment, ids, counts, places in rows[["term", "segment", "ids", "counts", "places"]].itertuples(index=False, name=None):
                at, ends, where = decode(ids, counts, places)
                own = of.setdefault(term, {})
                for j in np.flatnonzero(newest[at] == segment).tolist():
                    own[int(at[j])] = where[ends[j] : ends[j + 1]]
            both = set.intersection(*(set(x) for x in of.values())) if len(of) == n else set()
            base = int(rows["block"].iloc[0]) * SPAN
            ids, ranks = sorted(both), []
            for i in ids:
                if by_stem:
                    ranks.append(english.density_at(sorted((p, t) for t, x in of.items() for p in x[i].tolist()), wanted))
                else:
                    ranks.append(float(sum(len(x[i]) for x in of.values())))
            found = pd.DataFrame({"id": np.array(ids, dtype=np.int64) + base, "rank": np.array(ranks, dtype=float)})
            return found if k is None else found.sort_values(["rank", "id"], ascending=[False, True], ignore_index=True).head(k)

        slim = blocks.select("block", "term", "segment", "ids", "counts", "places")
        changed = self._changed()
        if changed is None:
            return slim.groupBy("block").applyInPandas(lambda rows: score(rows), "id long, rank double")
        newest = changed.groupBy("id").agg(F.max("segment").alias("segment")).withColumn("block", F.floor(F.col("id") / SPAN))
        kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("rank", T.DoubleType())])
        return slim.groupBy("block").cogroup(newest.groupBy("block")).applyInPandas(lambda rows, new: score(rows, new), kind)

    def matches(self, query: str) -> DataFrame:
        """(id, rank) of every text that has all terms of the query; none where it has no terms."""
        terms = self.terms(query)
        return self._scored(self.postings(terms), terms)

    def top(self, query: str, k: int) -> DataFrame:
        """(id, rank) of the k texts of highest rank, the id breaks ties.

        The blocks of the largest bounds are scored first; of the others only those whose bound reaches the k-th rank.
        """
        terms = self.terms(query)
        blocks = self.postings(terms)
        heads = self._heads(blocks, terms)
        first = [r["block"] for r in heads.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        order = [F.desc("rank"), "id"]
        best = self._scored(blocks.where(F.col("block").isin(first)), terms, k).orderBy(*order).limit(k).collect()  # k rows
        found = self.spark.createDataFrame([tuple(r) for r in best], "id long, rank double")
        if len(first) < FIRST:
            return found.orderBy(*order).limit(k)
        rest = heads.where(~F.col("block").isin(first))
        if len(best) >= k:
            rest = rest.where(F.col("bound") >= best[-1]["rank"] - 1e-12)
        left = self._scored(blocks.join(rest.select("block"), "block", "left_semi"), terms, k)
        return found.unionByName(left).orderBy(*order).limit(k)


def _bucket(term):
    return F.pmod(F.hash(term), F.lit(BUCKETS)).cast("int")
